"""Mixed-frequency features: lags known at a target date, weights, alignment, gap filling.

Observations and target dates are sorted together and a running window looks
back, so a target sees exactly what is dated on or before it: n log n, no
inequality join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidewater.operators import windows


#: Sources of mixed frequency: frequency, date column, value column, lags, aggregation. Fixed values.
SOURCES = {"treasury_withholdings": ("D", "date", "daily_withholding", 20, "sum"), "ui_claims": ("W", "report_date", "initial_claims", 8, "last"), "bls_ces": ("M", "date", "all_employees", 1, "last")}


def source_frame(df: DataFrame, source: str) -> DataFrame | None:
    """(ts, value) of one of SOURCES: its value column or else the first numeric one; None without a date column or a number."""
    _, date, value, _, _ = SOURCES[source]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if date not in df.columns or (value not in df.columns and not numbers):
        return None
    return df.select(F.col(date).cast("date").alias("ts"), F.col(value if value in df.columns else numbers[0]).alias("value"))


def infer_targets(sources: dict[str, DataFrame]) -> DataFrame:
    """(target): months that all sources (ts, value) cover; where they share none, all months that any covers."""
    spans = [df.agg(F.trunc(F.min("ts"), "MM").alias("a"), F.trunc(F.max("ts"), "MM").alias("b")) for df in sources.values()]
    spans = reduce(lambda x, y: x.unionAll(y), spans).agg(F.max("a").alias("a"), F.min("b").alias("b"), F.min("a").alias("lo"), F.max("b").alias("hi"))
    apart = F.col("a") > F.col("b")
    months = F.sequence(F.when(apart, F.col("lo")).otherwise(F.col("a")), F.when(apart, F.col("hi")).otherwise(F.col("b")), F.expr("interval 1 month"))
    return spans.select(F.explode(months).alias("target"))


def almon_weights(n: int, degree: float = 2.0) -> list[float]:
    """exp(-(i / n) ** degree), normalised; degree 0 weighs all alike."""
    raw = [1.0 if degree == 0 else math.exp(-((i / n) ** degree)) for i in range(n)]
    return [x / sum(raw) for x in raw]


def _together(obs: DataFrame, targets: DataFrame, key: str, ts: str, value: str, target: str) -> DataFrame:
    """Observations (1: before targets of the same time) and targets (2) of every series in one table."""
    if key in targets.columns:
        wanted = targets.select(key, target).distinct()
    else:  # a calendar for all series: one row with its dates, which a calendar bounds
        days = targets.agg(F.array_sort(F.collect_set(F.col(target).cast("date"))).alias("__days"))
        wanted = obs.select(key).distinct().join(F.broadcast(days)).select(key, F.explode("__days").alias(target))
    rows = obs.select(key, F.col(ts).cast("date").alias("t"), F.col(value).cast("double").alias("v"), F.lit(1).alias("kind"))
    return rows.unionByName(wanted.select(key, F.col(target).cast("date").alias("t"), F.lit(None).cast("double").alias("v"), F.lit(2).alias("kind")))


def lags(obs: DataFrame, targets: DataFrame, n: int, *, key: str = "series", ts: str = "ts", value: str = "value", target: str = "target", degree: float | None = None) -> DataFrame:
    """(key, target, lags, available, recency_days) for every series and target date.

    ``lags`` holds the last n observed values on or before the target, newest
    first, null where there are fewer; times Almon weights if ``degree`` is given.
    Observations are one row a series and date. Targets without a key column go
    with every series; they are a short list of dates.
    """
    w = Window.partitionBy(key).orderBy("t", "kind")
    known = F.when(F.col("kind") == 1, F.struct("t", "v"))
    rows = _together(obs, targets, key, ts, value, target)
    # Positions count observations only; a target reads the n observations at its position.
    placed = rows.withColumn("__n", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seen = placed.withColumn("__t", F.max(F.when(F.col("kind") == 1, F.col("t"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Observations after the same position share it with the targets that follow; lag over observations alone keeps frames short.
    own = seen.where("kind = 1")
    by_place = Window.partitionBy(key).orderBy("__n")
    history = own.select(key, "__n", *[F.lag("v", k).over(by_place).alias(f"lag_{k}") if k else F.col("v").alias("lag_0") for k in range(n)])
    out = seen.where("kind = 2").join(history, [key, "__n"], "left")
    weights = [1.0] * n if degree is None else almon_weights(n, degree)
    return out.select(key, F.col("t").alias(target), F.array(*[F.col(f"lag_{k}") * weights[k] for k in range(n)]).alias("lags"), F.least(F.col("__n"), F.lit(n)).cast("int").alias("available"), F.datediff("t", "__t").alias("recency_days"))


def align(obs: DataFrame, targets: DataFrame, method: str, *, key: str = "series", ts: str = "ts", value: str = "value", target: str = "target") -> DataFrame:
    """(key, target, value): last, mean or sum of everything on or before the target."""
    w = Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    made: Column = {"last": F.last("v", ignorenulls=True), "mean": F.avg("v"), "sum": F.sum("v")}[method].over(w)
    return _together(obs, targets, key, ts, value, target).withColumn("__out", made).where("kind = 2").select(key, F.col("t").alias(target), F.col("__out").alias(value))


def fill_gaps(df: DataFrame, columns: list[str], key: str, *order: str, look_ahead: bool = False) -> DataFrame:
    """Forward, then, if ``look_ahead``, backward, then the series' median, then 0."""
    w = windows.over(key, *order)
    medians = df.groupBy(key).agg(*[F.percentile(c, F.lit(0.5)).alias(f"__m_{c}") for c in columns])
    filled = df.withColumns({c: windows.forward_fill(c, w) for c in columns})
    if look_ahead:
        filled = filled.withColumns({c: windows.backward_fill(c, w) for c in columns})
    return filled.join(medians, key, "left").withColumns({c: F.coalesce(c, f"__m_{c}", F.lit(0.0)) for c in columns}).drop(*[f"__m_{c}" for c in columns])


def bridge(sources: dict[str, tuple[DataFrame, int]], targets: DataFrame, vintage: str, *, ts: str = "ts", value: str = "value", target: str = "target", degree: float | None = 2.0, recency: bool = False) -> DataFrame:
    """One row a target date with lag columns of every source (name -> (one series, lags)), cut off at the vintage date, gaps filled forward.

    With ``recency`` also <name>_recency_days, the days since each source's last value.
    """
    out = targets.select(F.col(target).cast("date").alias(target)).distinct()
    names: list[str] = []
    for name in sorted(sources):
        obs, n = sources[name]
        cut = windows.keep_last(obs.where(F.col(ts) <= F.lit(vintage).cast("date")).select(F.lit(name).alias("series"), F.col(ts).cast("date").alias(ts), value), ["series", ts], value)
        made = lags(cut, targets, n, ts=ts, value=value, target=target, degree=degree)
        columns = [f"{name}_lag_{k}" for k in range(n)]
        days = [F.col("recency_days").alias(f"{name}_recency_days")] if recency else []
        out = out.join(made.select(target, *[F.col("lags")[k].alias(c) for k, c in enumerate(columns)], *days), target, "left")
        names += columns
    return fill_gaps(out.withColumn("__all", F.lit(1)), names, "__all", target).drop("__all")
