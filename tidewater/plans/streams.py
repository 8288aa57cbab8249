"""Queries on streams, run until what is there has been read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans.base import day, query, rounded, table
from tidewater.folders import fresh
from tidewater.streaming.observations import closed_windows, read_folder, split_late, windowed


@query("""SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def streamed_days(spark, sf_dir):
    """Daily sums of events read as a stream; the complete table after all files."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    path = fresh(spark, "streamed")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(path)  # the whole table after each batch: the last one stays

    sums = windowed(stream.withColumn("ts", F.col("ts").cast("timestamp")), key="event_type", ts="ts", value="value")
    sums.writeStream.outputMode("complete").option("checkpointLocation", f"{path}-state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(path).select("event_type", day("start").alias("day"), "n", F.col("total"))
    return rounded(out, 4, "total")


#: Files come every five days; every 97th event comes ten days after its time, and every 50th twice, in its own file and the next.
_ARRIVALS = """e AS (SELECT event_id, event_type, ts, value, day(ts) // 5 + CASE WHEN event_id % 97 = 0 THEN 2 ELSE 0 END AS b FROM events),
    a AS (SELECT * FROM e UNION ALL SELECT event_id, event_type, ts, value, b + 1 FROM e WHERE event_id % 50 = 1),
    m AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 6 DAY AS mark, max(max(ts)) OVER () - INTERVAL 6 DAY AS watermark FROM a GROUP BY 1),
    l AS (SELECT a.*, mark, watermark, coalesce(ts <= mark, false) AS late FROM a JOIN m USING (b))"""


@query(f"""WITH {_ARRIVALS}, o AS (SELECT event_type, ts::DATE AS d, value, watermark FROM l WHERE NOT late QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY b) = 1)
    SELECT 'window' AS part, event_type, strftime(d, '%Y-%m-%d') AS day, count(value) AS n, round(sum(value), 4) AS total FROM o WHERE d + INTERVAL 1 DAY <= watermark GROUP BY 2, 3
    UNION ALL SELECT 'next vintage', event_type, strftime(ts::DATE, '%Y-%m-%d'), count(*), round(sum(value), 4) FROM l WHERE late GROUP BY event_type, ts::DATE""")
def closed_days(spark, sf_dir):
    """Events that come as files in order, some late and some twice: daily sums put out once when closed, and late rows for the next vintage."""
    own = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    e = own.withColumn("b", F.floor(F.dayofmonth("ts") / 5).cast("int") + F.when(F.col("event_id") % 97 == 0, 2).otherwise(0))
    a = e.union(e.where("event_id % 50 = 1").withColumn("b", F.col("b") + 1)).persist()
    base = fresh(spark, "stream")
    for b in sorted(r[0] for r in a.select("b").distinct().collect()):  # one file after another
        a.where(F.col("b") == b).drop("b").coalesce(1).write.mode("append").parquet(f"{base}/in")
    a.unpersist()
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    split_late(stream, base, ts="ts", delay="6 days", checkpoint=f"{base}/state-late").awaitTermination()
    accepted = read_folder(spark, f"{base}/accepted", own.schema)
    closed_windows(accepted, f"{base}/windows", id=["event_id"], key="event_type", ts="ts", value="value", width="1 day", delay="6 days", checkpoint=f"{base}/state-windows").awaitTermination()
    windows = spark.read.parquet(f"{base}/windows").select(F.lit("window").alias("part"), "event_type", day("start").alias("day"), "n", "total")
    late = spark.read.schema(own.schema).parquet(f"{base}/late").groupBy("event_type", day("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(windows.unionByName(late.select(F.lit("next vintage").alias("part"), "event_type", "day", "n", "total")), 4, "total")
