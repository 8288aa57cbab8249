"""A feature registry as tables: upserts by key, search, versions, and lineage by a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.folders import materialize

#: Columns that a search may name. Fixed values.
SEARCHABLE = ("name", "source", "frequency", "status", "vintage_date", "version")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` replace rows of equal keys; the others stay. Of equal keys in ``rows`` the last in order of all other columns counts."""
    rest, kinds = [c for c in rows.columns if c not in keys], dict(rows.dtypes)
    order = [F.to_json(F.struct(c)) if "map<" in kinds[c] else F.col(c) for c in rest]  # maps have no order of their own
    fresh = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest]) if rest else rows.distinct()
    return table.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def register(features: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert on (name, vintage_date); a name's version is one more than its highest, from 1."""
    top = features.groupBy("name").agg(F.max("version").alias("__top"))
    new = rows.drop("version").join(top, "name", "left").withColumn("version", (F.coalesce("__top", F.lit(0)) + 1).cast("int")).drop("__top")
    return upsert(features, new, ["name", "vintage_date"])


def search(features: DataFrame, limit: int | None = None, offset: int = 0, **equal) -> DataFrame:
    """Rows whose columns equal the values given, in order of name and version."""
    if odd := set(equal) - set(SEARCHABLE):
        raise ValueError(f"not searchable: {sorted(odd)}")
    for c, v in equal.items():
        features = features.where(F.col(c) == F.lit(v))
    out = features.orderBy("name", "version").offset(offset)
    return out if limit is None else out.limit(limit)


def register_with_edges(features: DataFrame, edges: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features after register(), and edges (child, parent) with those of the new rows' depends_on in place of their old ones."""
    gone = rows.select(F.col("name").alias("child")).distinct()
    return register(features, rows), edges.join(gone, "child", "left_anti").unionByName(edges_of(rows)).distinct()


def lineage_view(features: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, version, parent, parent_version): each active feature with what it depends on, if it is registered; roots have nulls."""
    latest = latest_versions(active(features))
    up = edges.join(latest.select(F.col("name").alias("parent"), F.col("version").alias("parent_version")), "parent", "left")
    return latest.join(up, latest["name"] == up["child"], "left").select("name", "version", "parent", "parent_version")


def latest_versions(features: DataFrame) -> DataFrame:
    return features.groupBy("name").agg(F.max("version").alias("version"))


def delete(features: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return features.join(keys.select(*on), on, "left_anti")


def update(table: DataFrame, changes: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ``changes`` with the changed columns; a null there leaves the value as it is.

    A key that ``changes`` has twice, or that the table has not, is an error, and so is
    a column that the table has not.
    """
    if odd := set(changes.columns) - set(table.columns):
        raise ValueError(f"no such columns: {sorted(odd)}")
    if twice := changes.groupBy(*on).count().where("count > 1").limit(1).collect():
        raise ValueError(f"changed twice: {twice[0].asDict()}")
    if lost := changes.join(table, on, "left_anti").limit(1).collect():
        raise KeyError(f"not found: {[lost[0][c] for c in on]}")
    new = [c for c in changes.columns if c not in on]
    given = changes.select(*on, *[F.col(c).alias(f"__{c}") for c in new])
    return table.join(given, on, "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def active(features: DataFrame) -> DataFrame:
    return features.where(F.col("status") == "active")


def edges_of(features: DataFrame) -> DataFrame:
    """(child, parent) of the array depends_on."""
    return features.select(F.col("name").alias("child"), F.explode("depends_on").alias("parent")).distinct()


def ancestors(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth): each node itself at 0 and all it descends from, however far, by the shortest way.

    Round by round the pairs that were new climb one edge; what is known already
    drops out, so neither many ways to one ancestor nor cycles make more rows, and
    the rounds end when there is nothing new. Each round is written to the shared folder.
    """
    own = edges.select("child", "parent").distinct()
    known = materialize(own.select(F.col("child").alias("node")).union(own.select("parent")).distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")), "ancestors")
    new = known
    while not new.isEmpty():
        up = new.join(own, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth")).distinct()
        new = materialize(up.join(known, ["node", "ancestor"], "left_anti"), "ancestors")
        known = known.union(new)
    return known


def descendants(edges: DataFrame, name: str) -> DataFrame:
    """Direct children."""
    return edges.where(F.col("parent") == name).select("child")


def impact(ancestry: DataFrame) -> DataFrame:
    """(ancestor, dependents): how many nodes a rollback of each would touch."""
    return ancestry.where("depth > 0").groupBy("ancestor").agg(F.count_distinct("node").alias("dependents"))


def unregistered(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Parents that no feature of the registry has."""
    return edges.join(features.select(F.col("name").alias("parent")).distinct(), "parent", "left_anti").select("parent").distinct()
