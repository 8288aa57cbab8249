"""Where intermediate tables go: the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Setting by which Spark deletes the shuffle files of a query once it has ended, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset, as in
    tests on one machine, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"tidewater-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and the rows stay the same for every later reader.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the shuffles of this one write go with its end: what they held is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


