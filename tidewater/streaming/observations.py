"""New observations as a stream: late rows told apart, windows put out once, and vintages written by micro-batch.

A late observation is a revision: it goes to the next vintage, none is changed.
Spark's stateful operators drop late rows without a trace, so ``split_late`` takes them
out before: what it accepts is never late for the watermark of ``closed_windows``, as
that one lags at least as far behind.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_folder(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).parquet(path)


def windowed(stream: DataFrame, *, key: str, ts: str, value: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(key, start, n, total, mean) of tumbling windows; rows later than the watermark allows are left to the next vintage."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(key, F.col("window.start").alias("start"), "n", "total", "mean")


def write_vintages(stream: DataFrame, base: str, source: str, day: date, checkpoint: str) -> StreamingQuery:
    """What arrives until the run ends becomes the vintage of ``day``, readable by VintageStore.

    Each micro-batch has a folder of its number inside the vintage: a batch that is
    run again overwrites itself only.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{base.rstrip('/')}/source={source}/vintage_date={day.isoformat()}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(stream: DataFrame, base: str, *, ts: str, delay: str, checkpoint: str) -> StreamingQuery:
    """Deal the rows of each micro-batch out to ``base``/accepted and ``base``/late, in a folder of the batch's number.

    A row is late if its time is no later than the latest time of all batches before
    its own, less ``delay``. That mark is written with each batch and read by the
    next, so a run that begins again goes on with it; a batch that is run again
    overwrites its own folders. Rows without a time are late.
    """
    base = base.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{base}/marks/batch={number - 1}").first()["mark"] if number else None
        batch = batch.persist()
        try:
            late = F.col(ts).isNull() if before is None else F.coalesce(F.col(ts) <= F.lit(before) - F.expr(f"interval {delay}"), F.lit(True))
            batch.where(~late).write.mode("overwrite").parquet(f"{base}/accepted/batch={number}")
            batch.where(late).write.mode("overwrite").parquet(f"{base}/late/batch={number}")
            latest = batch.agg(F.greatest(F.max(ts), F.lit(before).cast("timestamp")).alias("mark"))
            latest.coalesce(1).write.mode("overwrite").parquet(f"{base}/marks/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_windows(stream: DataFrame, path: str, *, id: list[str], key: str, ts: str, value: str, width: str, delay: str, checkpoint: str) -> StreamingQuery:
    """Append (key, start, n, total, mean) of tumbling windows to Parquet in ``path``, each once, when the watermark has passed its end.

    Rows that repeat ``id`` within the watermark count once. Windows that are still
    open when the input ends are not put out; they stay in the checkpoint for the
    next run. Spark's file sink commits a batch as a whole, and once.
    """
    once = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(id)
    sums = once.groupBy(F.window(ts, width), key).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    out = sums.select(key, F.col("window.start").alias("start"), "n", "total", "mean")
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
