"""A table of Parquet files that is upserted by key: only the partitions of the keys that come are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.folders import materialize
from tidewater.operators.registry import upsert


class KeyedTable:
    """Rows by key in ``path``, in partitions by a hash of the key: ``buckets`` of them, the same for the table's life."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        where = hadoop.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("__bucket")

    def upsert(self, rows: DataFrame) -> None:
        """``rows`` replace those of equal keys; of equal keys among them the last in order of all other columns counts.

        The new partitions are first made whole in the shared folder, where an error
        leaves the table as it was; Spark's committer then stages them beside the
        table and puts each in its old one's place. A run that is lost on the way is
        run again with the same rows, and ends in the same table. One writer at a
        time; a null key is a key.
        """
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = materialize(rows, "upserts")
        touched = [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most as many as buckets
        if not touched:
            return
        old = self.spark.read.parquet(self.path).where(F.col("__bucket").isin(touched)).drop("__bucket") if self.exists() else rows.limit(0)
        named = lambda df: df.withColumns({f"__k{i}": F.coalesce(F.to_json(F.struct(F.col(k))), F.lit("")) for i, k in enumerate(self.keys)})  # noqa: E731  a null is told apart from all values
        plain = [f"__k{i}" for i in range(len(self.keys))]
        merged = upsert(named(old), named(rows), plain).drop(*plain).withColumn("__bucket", bucket)
        merged = materialize(merged, "merged")
        merged.repartition(self.buckets, "__bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("__bucket").parquet(self.path)
