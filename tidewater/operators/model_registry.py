"""A registry of models as a table: versions, stages, the features that each version uses, and where those come from.

A model table has the columns name, version (int), uri, stage, features (array of
names) and tags (map of text). A change gives a new table; nothing is edited in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stages that a version can be in. Fixed values.
STAGES = ("Staging", "Production", "Archived", "None")
KEY = ["name", "version"]


def register(models: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (name, uri, features, tags) as new versions: each one more than the highest of its name, from 1, in order of uri; stage None."""
    top = models.groupBy("name").agg(F.max("version").alias("__top"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("uri"))
    new = rows.withColumn("__at", place).join(top, "name", "left").withColumn("version", (F.coalesce("__top", F.lit(0)) + F.col("__at")).cast("int"))
    new = new.withColumn("stage", F.lit("None")).withColumn("features", F.coalesce("features", F.array().cast("array<string>")))
    return models.unionByName(new.select(*models.columns))


def promote(models: DataFrame, changes: DataFrame, archive_existing: bool = False) -> DataFrame:
    """Versions moved to the stages of ``changes`` (name, version, stage), one row a version.

    With ``archive_existing`` other versions of the name in that stage are archived.
    A stage or a version that does not exist is an error.
    """
    odd = changes.where(~F.coalesce(F.col("stage").isin(*STAGES), F.lit(False))).select("stage").limit(1).collect()
    if odd:
        raise ValueError(f"no such stage: {odd[0]['stage']}")
    lost = changes.join(models, KEY, "left_anti").select(*KEY).limit(1).collect()
    if lost:
        raise ValueError(f"no such version: {lost[0]['name']} {lost[0]['version']}")
    out = models.join(changes.select(*KEY, F.col("stage").alias("__to")), KEY, "left")
    if archive_existing:
        taken = changes.select("name", "stage").distinct().withColumn("__taken", F.lit(True))
        out = out.join(taken, ["name", "stage"], "left").withColumn("__to", F.coalesce("__to", F.when(F.col("__taken"), F.lit("Archived"))))
    return out.withColumn("stage", F.coalesce("__to", "stage")).select(*models.columns)


def link_features(models: DataFrame, links: DataFrame) -> DataFrame:
    """Versions with the features of ``links`` (name, version, features) in place of their own."""
    new = links.select(*KEY, F.col("features").alias("__features"))
    return models.join(new, KEY, "left").withColumn("features", F.coalesce("__features", "features")).select(*models.columns)


def latest(models: DataFrame) -> DataFrame:
    """Of each name the highest version."""
    rest = [c for c in models.columns if c != "name"]
    return models.groupBy("name").agg(F.max_by(F.struct(*rest), "version").alias("__row")).select("name", "__row.*").select(*models.columns)


def in_stage(models: DataFrame, stage: str) -> DataFrame:
    """Of each name the highest version in ``stage``."""
    return latest(models.where(F.col("stage") == stage))


def uses(models: DataFrame) -> DataFrame:
    """(feature, name, version, stage): every version that uses a feature, to be looked up by feature."""
    return models.select(F.explode(F.array_distinct("features")).alias("feature"), "name", "version", "stage")


def feature_lineage(models: DataFrame, features: DataFrame) -> DataFrame:
    """(name, version, feature, feature_version, source): what is registered of each version's features; nulls where nothing is."""
    known = features.select(F.col("name").alias("feature"), F.col("version").alias("feature_version"), "source")
    return uses(models).drop("stage").join(known, "feature", "left").select("name", "version", "feature", "feature_version", "source")


def data_sources(models: DataFrame, features: DataFrame) -> DataFrame:
    """(name, version, source) once each."""
    return feature_lineage(models, features).where(F.col("source").isNotNull()).select("name", "version", "source").distinct()
