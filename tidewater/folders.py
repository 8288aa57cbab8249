"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on one machine, where none is set, a temporary one, made once a context."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = context._tidewater_scratch = getattr(context, "_tidewater_scratch", None) or "file://" + tempfile.mkdtemp(prefix="tidewater-")
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A folder that nothing else uses, among those of this application."""
    return f"{shared(spark)}/tidewater/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: to be called once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared(spark)}/tidewater/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: a lost executor costs a re-read, and every later reader sees the same rows."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` made once, and broadcast in joins if it has at most ``most`` rows: a join with few keys then sends no rows of the other side anywhere."""
    own = materialize(df, "small")
    return F.broadcast(own) if own.count() <= most else own
