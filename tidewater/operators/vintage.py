"""Dated, immutable snapshots: Parquet partitioned by source and vintage date."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VintageStore:
    """Snapshots under one folder: ``{base}/source=.../vintage_date=...``. A written vintage is never changed."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, source: str, day: date) -> str:
        return f"{self.base}/source={source}/vintage_date={day.isoformat()}"

    def write(self, df: DataFrame, source: str, day: date, *, if_exists: str = "error", provenance: dict[str, str] | None = None) -> None:
        """Write one vintage. ``if_exists``: "error" raises, "ignore" leaves what is there. Empty data is an error.

        Provenance becomes constant columns, which survive every reader.
        """
        if df.isEmpty():
            raise ValueError("an empty vintage is not written")
        for k, v in (provenance or {}).items():
            df = df.withColumn(k, F.lit(v))
        df.write.mode({"error": "errorifexists", "ignore": "ignore"}[if_exists]).parquet(self._path(source, day))

    def _all(self, source: str) -> DataFrame:
        return self.spark.read.option("basePath", self.base).parquet(f"{self.base}/source={source}")

    def dates(self, source: str) -> list[date]:
        """Vintage dates in order, from the partitions alone."""
        try:
            found = self._all(source).select(F.col("vintage_date").cast("date")).distinct().collect()
        except AnalysisException:
            return []
        return sorted(r[0] for r in found)

    def exists(self, source: str, day: date) -> bool:
        return day in self.dates(source)

    def load(self, source: str, day: date) -> DataFrame:
        if not self.exists(source, day):
            raise FileNotFoundError(f"{source} has no vintage {day}")
        return self._all(source).where(F.col("vintage_date").cast("date") == F.lit(day))

    def latest(self, source: str) -> date | None:
        return max(self.dates(source), default=None)

    def as_of(self, source: str, day: date) -> date | None:
        """The last vintage on or before a day."""
        return max((d for d in self.dates(source) if d <= day), default=None)

    def load_as_of(self, source: str, day: date) -> DataFrame:
        found = self.as_of(source, day)
        if found is None:
            raise FileNotFoundError(f"{source} has no vintage on or before {day}")
        return self.load(source, found)

    def state(self, sources: list[str], day: date) -> tuple[dict[str, DataFrame], dict[str, date]]:
        """What was known on a day: a lazy table for each source that has a vintage, and the dates used."""
        used = {s: d for s in sources if (d := self.as_of(s, day)) is not None}
        return {s: self.load(s, d) for s, d in used.items()}, used

    def common_dates(self, sources: list[str]) -> list[date]:
        return sorted(set.intersection(*[set(self.dates(s)) for s in sources])) if sources else []


def as_of_rows(versions: DataFrame, key: list[str], vintage: str, day) -> DataFrame:
    """Of dated versions of rows, the last of each key on or before ``day``: one map-side combined maximum."""
    rest = [c for c in versions.columns if c not in (*key, vintage)]
    known = versions.where(F.col(vintage) <= F.lit(day))
    return known.groupBy(*key).agg(F.max_by(F.struct(vintage, *rest), F.struct(vintage, *rest)).alias("row")).select(*key, f"row.{vintage}", *[F.col(f"row.{c}") for c in rest])


def honesty(df: DataFrame, observed: str, vintage_date: date, as_of: date) -> DataFrame:
    """One row: whether the vintage, and all it observes, were known on the day."""
    last = F.max(F.col(observed).cast("date"))
    return df.agg(last.alias("last_observed"), F.count_if(F.col(observed).cast("date") > F.lit(as_of)).alias("after_as_of")).select(
        "last_observed",
        "after_as_of",
        F.lit(vintage_date <= as_of).alias("vintage_known"),
        F.coalesce(F.col("last_observed") <= F.lit(vintage_date), F.lit(True)).alias("observations_known"),
        (F.lit(vintage_date <= as_of) & F.coalesce(F.col("last_observed") <= F.lit(vintage_date), F.lit(True)) & (F.col("after_as_of") == 0)).alias("honest"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and two hashes that do not depend on their order: equal tables give equal fingerprints.

    A row is hashed by SHA-256 of its values as text, one a line, null as ``\\N``.
    """
    text = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns])
    digest = F.sha2(text, 256)
    part = [F.conv(F.substring(digest, a, 10), 16, 10).cast("long") for a in (1, 11)]
    return df.agg(F.count("*").alias("rows"), F.bit_xor(part[0]).alias("xor"), F.sum(part[1]).alias("sum"))
