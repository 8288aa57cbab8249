"""Resampling to gap-free weeks and months.

A series table is long: (series, ts, value). All operators take any number of
series at once. A spine has every bin from a series' first to its last; it is as
large as the result, and it joins on the bins of the data by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import calendar

#: Bins by name: (label of a day's bin, distance of bins). Weeks are labelled by the Sunday that closes them.
BINS = {"D": (lambda d: d.cast("date"), "1 day"), "W": (calendar.week, "7 days"), "MS": (calendar.month, "1 month")}


def spine(bins: DataFrame, key: str, bin: str, every: str) -> DataFrame:
    """(key, bin) for every bin between a key's first and last."""
    return bins.groupBy(key).agg(F.min(bin).alias("lo"), F.max(bin).alias("hi")).select(key, F.explode(F.sequence("lo", "hi", F.expr(f"interval {every}"))).alias(bin))


def resample(df: DataFrame, freq: str, methods: tuple[str, ...], *, key: str = "series", ts: str = "ts", value: str = "value", tie: str | None = None) -> DataFrame:
    """(key, bin, one column per method): mean, sum, last, first of each bin; empty bins give null, and 0 for sum.

    last and first skip null values; equal times go by ``tie``.
    """
    label, every = BINS[freq]
    order = F.struct(ts, tie) if tie else F.col(ts)
    seen = F.col(value).isNotNull()
    made: dict[str, Column] = {
        "mean": F.avg(value),
        "sum": F.sum(value),
        "last": F.max_by(F.when(seen, F.col(value)), F.when(seen, order)),
        "first": F.min_by(F.when(seen, F.col(value)), F.when(seen, order)),
    }
    binned = df.select("*", label(F.col(ts)).alias("bin")).groupBy(key, "bin").agg(*[made[m].alias(m) for m in methods])
    out = spine(binned, key, "bin", every).join(binned, [key, "bin"], "left")
    return out.na.fill(0.0, ["sum"]) if "sum" in methods else out


def infer_frequency(df: DataFrame, *, key: str = "series", ts: str = "ts") -> DataFrame:
    """(key, gap, freq): D, W or M by the median gap in days (at most 1.5, 8, 32), else null."""
    days = df.select(key, F.col(ts).cast("date").alias("d")).distinct()
    gaps = days.withColumn("gap", F.datediff("d", F.lag("d").over(Window.partitionBy(key).orderBy("d"))))
    out = gaps.groupBy(key).agg(F.percentile("gap", F.lit(0.5)).alias("gap"))
    return out.withColumn("freq", F.when(F.col("gap") <= 1.5, "D").when(F.col("gap") <= 8, "W").when(F.col("gap") <= 32, "M"))


#: Observations of the finer frequency to one of the coarser. Fixed values.
RATIOS = {("D", "W"): 7, ("D", "M"): 30, ("W", "M"): 4}


def frequency_ratio(source: str, target: str) -> int:
    if source == target:
        return 1
    if (source, target) not in RATIOS:
        raise ValueError(f"no ratio from {source} to {target}")
    return RATIOS[source, target]


def convert(df: DataFrame, target: str, method: str = "mean", *, source: str, **columns) -> DataFrame:
    """Daily or weekly series to weeks or months. Monthly sources are as coarse as it gets."""
    if source not in ("D", "W"):
        raise ValueError("a monthly series can't be converted")
    return resample(df, target, (method,), **columns).withColumnRenamed(method, columns.get("value", "value"))
