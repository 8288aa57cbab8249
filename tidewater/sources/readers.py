"""Readers with declared schemas. What Spark reads by itself it reads; text that can't be parsed becomes null."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A reply of the labour statistics interface: series, each with a list of periods.
SERIES_REPLY = "Results struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,periodName:string,value:string,footnotes:array<struct<code:string,text:string>>>>>>>"


def read_series_replies(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, year, period, period_name, value, footnotes) of JSON replies, one reply a file."""
    raw = spark.read.schema(SERIES_REPLY).option("multiLine", True).json(path)
    series = raw.select(F.explode("Results.series").alias("s")).select(F.col("s.seriesID").alias("series_id"), F.explode("s.data").alias("d"))
    return series.select("series_id", F.col("d.year").try_cast("int").alias("year"), F.col("d.period").alias("period"), F.col("d.periodName").alias("period_name"), F.col("d.value").try_cast("double").alias("value"), F.col("d.footnotes").alias("footnotes"))


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """Delimited text, gzip too, with a header whose names are trimmed and lower-cased; values that don't parse are null."""
    return trimmed(spark.read.csv(path, header=True, sep=separator, schema=schema, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))


def trimmed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def read_row_arrays(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """JSON that is an array of arrays of text, the first of which is the header: one row for each of the others."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("rows"))
    rows = raw.select(F.col("rows")[0].alias("head"), F.posexplode("rows").alias("at", "row")).where("at > 0")
    return rows.select(*[F.try_element_at("row", F.array_position("head", c).cast("int")).alias(c) for c in columns])


class PagedReader(DataSourceReader):
    """Pages of a table behind a function, read one after the other by one task: each says whether there is a next.

    A first page that fails is an error; a later one that fails, or an empty one, ends the table.
    """

    def __init__(self, schema, options):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.options["fetch"].partition(":")
        fetch: Callable[[int], list[tuple]] = getattr(__import__(module, fromlist=[name]), name)
        for page in range(int(self.options.get("pages", 1 << 31))):
            try:
                rows = list(fetch(page))
            except Exception:
                if page == 0:
                    raise
                return
            if not rows:
                return
            yield from rows


class PagedSource(DataSource):
    """``spark.read.format("paged")`` with options fetch (module:function of a page number), pages (at most so many), and columns (a schema)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)


def laus_series(states: dict[str, str]) -> list[str]:
    """Ids of local unemployment series: four national ones, and two of each state (name to FIPS code)."""
    national = ["LNS14000000", "LNS13000000", "LNS12000000", "LNS11000000"]
    return national + [f"LASST{fips}0000000000{m}" for fips in sorted(states.values()) for m in ("003", "005")]


def write_feature(df: DataFrame, base: str, name: str) -> None:
    """One folder a feature set."""
    df.withColumn("feature", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature").parquet(base)


def synthetic(df: DataFrame, by: str) -> DataFrame:
    """Rows made up where a source could not be read, marked in every row."""
    return df.withColumn("is_synthetic", F.lit(True)).withColumn("generated_by", F.lit(by))
