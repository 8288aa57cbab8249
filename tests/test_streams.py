"""Streams: late rows, windows that close once, and runs that begin again; intermediate folders."""

import datetime
import os

from tidewater import folders
from tidewater.streaming.observations import closed_windows, read_folder, split_late

SCHEMA = "id int, k string, ts timestamp, v double"
AT = lambda d, h=12: datetime.datetime(2024, 1, d, h)


def test_late_rows_and_closed_windows_over_two_runs(spark, tmp_path):
    base = f"file://{tmp_path}"
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def arrive(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        split_late(stream, base, ts="ts", delay="2 days", checkpoint=f"{base}/a").awaitTermination()
        closed_windows(read_folder(spark, f"{base}/accepted", SCHEMA), f"{base}/out", id=["id"], key="k", ts="ts", value="v", width="1 day", delay="2 days", checkpoint=f"{base}/b").awaitTermination()
        closed = sorted((r.k, r.start.day, r.n, r.total) for r in spark.read.parquet(f"{base}/out").collect())
        late = sorted(r.id for r in spark.read.schema(SCHEMA).parquet(f"{base}/late").collect())
        return closed, late

    try:
        arrive((1, "x", AT(1), 1.0), (2, "x", AT(1), 2.0), (3, "y", AT(2), None))
        arrive((2, "x", AT(1), 2.0), (4, "x", AT(5), 4.0), (5, "x", None, 9.0))
        closed, late = run()
        assert closed == [("x", 1, 2, 3.0), ("y", 2, 0, None)] and late == [5]
        arrive((6, "x", AT(3), 6.0), (7, "x", AT(4), 7.0))  # the mark is noon of the fifth: what is before noon of the third is late
        arrive((8, "y", AT(9), 8.0), (9, "x", AT(2), 9.0))
        closed, late = run()
        assert closed == [("x", 1, 2, 3.0), ("x", 4, 1, 7.0), ("x", 5, 1, 4.0), ("y", 2, 0, None)] and late == [5, 6, 9]
        assert run() == (closed, late)  # nothing new, nothing twice
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_intermediate_folders_can_be_dropped(spark):
    df = folders.materialize(spark.range(3), "three")
    assert df.count() == 3
    place = f"{folders.shared(spark)}/tidewater/{spark.sparkContext.applicationId}".removeprefix("file://")
    assert os.path.isdir(place)
    folders.clean(spark)
    assert not os.path.exists(place)
