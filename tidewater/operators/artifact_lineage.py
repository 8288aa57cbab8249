"""Whether what model artifacts say of their features agrees with the registry: one row a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import registry

CRITICAL, WARNING, INFO = "critical", "warning", "info"


def _finding(df: DataFrame, check: str, severity: str | Column, detail: Column, feature: str | None = "feature") -> DataFrame:
    name = F.col(feature) if feature else F.lit(None).cast("string")
    return df.select(F.lit(check).alias("check"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.col("model") if "model" in df.columns else F.lit(None).cast("string").alias("model"), name.alias("feature"), detail.alias("detail"))


def findings(spark: SparkSession, models: DataFrame, features: DataFrame, edges: DataFrame, rollbacks: DataFrame | None = None) -> DataFrame:
    """(check, severity, model, feature, detail) of artifacts ``models`` (model, features, versions, vintage) against ``features`` (name, version, vintage) and ``edges`` (child, parent).

    Of a feature the version that the artifact asks for is looked at, else the highest.

    - artifact_features_present: an artifact lists no feature
    - feature_registered: a feature is not registered at all
    - feature_version_match: the version asked for is not registered
    - feature_vintage_match (warning): the feature's vintage is not the artifact's
    - lineage_registered: something that a feature descends from is not registered
    - lineage_cycle: a feature descends from itself, or something it descends from does
    - artifact_lineage_coverage: features found of those listed; information if all are
    - rollback_impact: of ``rollbacks`` (feature, baseline, rollback, allowed), a warning
      if the metric grows by more than is allowed; a warning if none is given

    Features listed twice count once; null names are no features.
    """
    versions = F.coalesce(F.col("versions"), F.create_map().cast("map<string,string>"))
    listed = models.select("model", "vintage", versions.alias("versions"), F.array_distinct(F.array_compact(F.coalesce("features", F.array().cast("array<string>")))).alias("features"))
    used = listed.select("model", "vintage", F.explode("features").alias("feature"), "versions").select("model", "vintage", "feature", F.try_element_at("versions", F.col("feature")).alias("asked"))
    known = features.groupBy(F.col("name").alias("feature")).agg(F.max(F.struct("version", "vintage")).alias("top"))
    exact = features.groupBy(F.col("name").alias("feature"), F.col("version").cast("string").alias("asked")).agg(F.max("vintage").alias("own"))
    joined = used.join(known, "feature", "left").join(exact, ["feature", "asked"], "left").withColumn("there", F.col("top").isNotNull())
    got = F.when(F.col("own").isNotNull(), F.col("asked")).otherwise(F.col("top.version").cast("string"))
    seen = joined.withColumn("version", got).withColumn("found", F.coalesce("own", "top.vintage"))

    here = seen.where("there")
    above = registry.ancestors(spark, edges)
    names = features.select(F.col("name").alias("ancestor")).distinct()
    lost = above.where("depth > 0").join(names, "ancestor", "left_anti").select(F.col("node").alias("feature"), "ancestor")
    round_ = edges.join(above.select(F.col("node").alias("parent"), F.col("ancestor").alias("child")), ["parent", "child"], "left_semi").select(F.col("child").alias("ancestor")).distinct()
    cyclic = above.join(round_, "ancestor").select(F.col("node").alias("feature")).distinct()
    covered = listed.where(F.size("features") > 0).select("model", F.size("features").alias("expected")).join(seen.groupBy("model").agg(F.count_if("there").alias("resolved")), "model")
    parts = [
        _finding(listed.where(F.size("features") == 0), "artifact_features_present", CRITICAL, F.lit("no features"), None),
        _finding(seen.where(~F.col("there")), "feature_registered", CRITICAL, F.lit("not registered")),
        _finding(here.where("asked is not null and asked <> version"), "feature_version_match", CRITICAL, F.concat(F.lit("asked "), "asked", F.lit(", found "), "version")),
        _finding(here.where("vintage is not null and not (found <=> vintage)"), "feature_vintage_match", WARNING, F.concat(F.lit("artifact "), "vintage", F.lit(", feature "), F.coalesce("found", F.lit("none")))),
        _finding(here.select("model", "feature").join(lost, "feature"), "lineage_registered", CRITICAL, F.concat(F.lit("not registered: "), "ancestor")),
        _finding(here.select("model", "feature").join(cyclic, "feature"), "lineage_cycle", CRITICAL, F.lit("descends from a cycle")),
        _finding(covered, "artifact_lineage_coverage", F.when(F.col("resolved") == F.col("expected"), INFO).otherwise(CRITICAL), F.concat("resolved", F.lit(" of "), "expected"), None),
    ]
    if rollbacks is None:
        one = spark.range(1)
        parts.append(_finding(one, "rollback_impact", WARNING, F.lit("no rollback was measured"), None))
    else:
        worse = F.col("rollback") - F.col("baseline")
        parts.append(_finding(rollbacks, "rollback_impact", F.when(worse <= F.col("allowed"), INFO).otherwise(WARNING), F.concat(F.lit("worse by "), F.format_number(worse, 4))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def passed(found: DataFrame) -> DataFrame:
    """(model, passed): whether each artifact has no critical finding."""
    return found.where("model is not null").groupBy("model").agg((F.count_if(F.col("severity") == CRITICAL) == 0).alias("passed"))
