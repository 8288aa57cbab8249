"""Queries on the registry of models and on mixed-frequency forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import calibrate, lags, mixed, model_registry
from tidewater.plans.base import orders_by_priority, query, rounded, table


def _models(spark, sf_dir):
    """A model a brand, registered twice: first on the names of its small parts, then of all; the second takes over production where the brand has parts of the largest size."""
    part = table(spark, sf_dir, "part")
    rows = part.groupBy(F.col("p_brand").alias("name")).agg(
        F.array_sort(F.collect_set(F.when(F.col("p_size") <= 25, F.col("p_name")))).alias("small"), F.array_sort(F.collect_set("p_name")).alias("all"), F.max("p_size").alias("size")
    )
    tags = F.create_map(F.lit("size"), F.col("size").cast("string")).alias("tags")
    none = spark.createDataFrame([], "name string, version int, uri string, stage string, features array<string>, tags map<string, string>")
    first = model_registry.register(none, rows.select("name", F.lit("runs:/1/model").alias("uri"), F.col("small").alias("features"), tags))
    both = model_registry.register(first, rows.select("name", F.lit("runs:/2/model").alias("uri"), F.col("all").alias("features"), tags))
    both = model_registry.promote(both, rows.select("name", F.lit(1).alias("version"), F.lit("Production").alias("stage")))
    return model_registry.promote(both, rows.where("size = 50").select("name", F.lit(2).alias("version"), F.lit("Production").alias("stage")), archive_existing=True)


_MODELS = """m AS (SELECT p_brand AS name, max(p_size) AS size FROM part GROUP BY 1),
    v AS (SELECT name, 1 AS version, CASE WHEN size = 50 THEN 'Archived' ELSE 'Production' END AS stage FROM m UNION ALL SELECT name, 2, CASE WHEN size = 50 THEN 'Production' ELSE 'None' END FROM m),
    u AS (SELECT DISTINCT p_name AS feature, name, version, stage FROM v JOIN part ON p_brand = name WHERE version = 2 OR p_size <= 25)"""
_KNOWN = """f AS (SELECT p_name AS name, min(p_type) AS source, max(p_size) AS version FROM part WHERE p_size > 10 GROUP BY 1)"""


def _known(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size > 10").groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("source"), F.max("p_size").alias("version"))


@query(f"WITH {_MODELS} SELECT name, version, stage, size::VARCHAR AS size FROM v JOIN m USING (name)")
def model_versions(spark, sf_dir):
    """Versions of models after promotions, with a tag."""
    return _models(spark, sf_dir).select("name", "version", "stage", F.col("tags")["size"].alias("size"))


@query(f"WITH {_MODELS} SELECT name, max(version) AS version FROM v WHERE stage = 'Production' GROUP BY 1")
def models_in_production(spark, sf_dir):
    """Of each model the version in production."""
    return model_registry.in_stage(_models(spark, sf_dir), "Production").select("name", "version")


@query(f"WITH {_MODELS} SELECT feature, name, version, stage FROM u")
def models_by_feature(spark, sf_dir):
    """Versions that use each feature."""
    return model_registry.uses(_models(spark, sf_dir))


@query(f"WITH {_MODELS}, {_KNOWN} SELECT u.name, u.version, feature, f.version AS feature_version, source FROM u LEFT JOIN f ON f.name = feature")
def model_lineage(spark, sf_dir):
    """What is registered of the features of each version."""
    return model_registry.feature_lineage(_models(spark, sf_dir), _known(spark, sf_dir))


@query(f"WITH {_MODELS}, {_KNOWN} SELECT DISTINCT u.name, u.version, source FROM u JOIN f ON f.name = feature")
def model_sources(spark, sf_dir):
    """Data sources of each version."""
    return model_registry.data_sources(_models(spark, sf_dir), _known(spark, sf_dir))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, 0.5 * 1400 * l_quantity + 0.2 * 36000 + 0.3 * 1600 * l_quantity AS f, 1300 * l_quantity AS q5, 1700 * l_quantity AS q95, l_quantity - 10 AS a, CASE WHEN l_tax > 0 THEN 40 END AS b FROM lineitem),
    s AS (SELECT greatest(stddev_pop(y - f), 1) AS scale FROM x),
    h AS (SELECT *, greatest(scale * (1 + greatest(0, least(31, CASE WHEN b IS NULL THEN a ELSE (a + b) / 2 END)) / 31), 0.5, (q95 - q5) / 2) AS half FROM x, s)
    SELECT l_orderkey, l_linenumber, round(f, 2) AS forecast, round(f - half, 2) AS low, round(f + half, 2) AS high FROM h""")
def widened_intervals(spark, sf_dir):
    """A weighted forecast and its interval, wider where sources are stale."""
    q = F.col("l_quantity")
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), (1400 * q).alias("dfm"), F.lit(36_000.0).alias("midas"), (1600 * q).alias("xgboost"), (1300 * q).alias("q5"), (1700 * q).alias("q95"), (q - 10).alias("a"), F.when(F.col("l_tax") > 0, 40).alias("b"))
    forecast = calibrate.blend(mixed.COMPONENTS, mixed.component_weights(own, "y", mixed.COMPONENTS, {"dfm": 0.5, "midas": 0.2, "xgboost": 0.3}))
    half = mixed.half_width(mixed.residual_scale(own, "y", forecast), ["a", "b"], "q5", "q95")
    out = own.withColumn("forecast", forecast).withColumn("half", half)
    return rounded(out.select("l_orderkey", "l_linenumber", "forecast", (F.col("forecast") - F.col("half")).alias("low"), (F.col("forecast") + F.col("half")).alias("high")), 2, "forecast", "low", "high")


def mixed_rows(spark, sf_dir):
    """(rows, lag columns by source, recency columns): monthly order totals beside the last days of two priorities."""
    daily = orders_by_priority(spark, sf_dir).groupBy("series", "ts").agg(F.sum("value").alias("value"))
    months = daily.groupBy(F.last_day("ts").alias("target")).agg(F.sum("value").alias("y"))
    sources = {name: (daily.where(F.col("series") == series).select("ts", "value"), 3) for name, series in (("urgent", "1-URGENT"), ("low", "5-LOW"))}
    made = lags.bridge(sources, months.select("target"), "9999-12-31", degree=None, recency=True)
    return made.join(months, "target"), {name: [f"{name}_lag_{k}" for k in range(3)] for name in sorted(sources)}, [f"{name}_recency_days" for name in sorted(sources)]
