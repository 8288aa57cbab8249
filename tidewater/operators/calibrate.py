"""Conformal intervals, isotonic calibration, and weights of an ensemble."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.folders import small
from tidewater.operators import isotonic as rising_fit
from tidewater.operators import nearby, order


def conformal_width(df: DataFrame, y: str, f: str, level: float = 0.9, by: list[str] | None = None) -> DataFrame:
    """(by, width): the exact quantile of |y - f| at min(1, level + 1 / (n + 1)), found by range: no task holds a series."""
    by = by or []
    rows = df.select(*by, F.abs(F.col(y) - F.col(f)).alias("r")).where("r is not null")
    return order.quantiles(rows, "r", F.lit(level) + 1 / (F.col("n") + 1), by, "width").select(*by, "width")


def conformal_intervals(df: DataFrame, calibration: DataFrame, y: str, f: str, level: float = 0.9) -> DataFrame:
    """``df`` with low and high around its forecasts, as wide as the residuals of ``calibration`` ask."""
    width = conformal_width(calibration, y, f, level)
    return df.join(F.broadcast(width)).withColumn("low", F.col(f) - F.col("width")).withColumn("high", F.col(f) + F.col("width")).drop("width")  # one row


def adaptive_width(df: DataFrame, calibration: DataFrame, y: str, f: str, level: float = 0.9, gamma: float = 0.1, mix: float = 0.7, quantile: float = 0.9) -> DataFrame:
    """``df`` with ``width``: wider where calibration rows with forecasts near this one had large residuals.

    ``mix`` of the residual at ``quantile`` of the calibration rows' weights, sorted
    by residual, and the rest of the plain width. A row weighs
    exp(-|its forecast - this forecast| / (gamma * deviation of its forecasts)).
    The calibration set can have any size. A deviation of 0 weighs all rows alike; a
    forecast near no row, or a missing one, takes the largest residual.
    """
    own = calibration.select(F.abs(F.col(y) - F.col(f)).cast("double").alias("r"), F.col(f).cast("double").alias("p")).where("r is not null")
    asked = df.select((F.col(f).cast("double") + 0.0).alias("f")).where("f is not null and not isnan(f)").distinct()
    near, last = nearby.quantiles(own, asked, quantile, gamma)
    near = small(near.select(F.col("f").alias("__f"), F.col("r").alias("__r")))
    plain = conformal_width(calibration, y, f, level)
    rows = df.join(F.broadcast(plain)).join(near, F.col(f).cast("double") == F.col("__f"), "left")  # one row
    return rows.withColumn("width", mix * F.coalesce("__r", F.lit(last).cast("double")) + (1 - mix) * F.col("width")).drop("__f", "__r")


def coverage_by_stratum(df: DataFrame, y: str, f: str, low: str, high: str, strata: int = 5) -> DataFrame:
    """(stratum, n, coverage, width): by order of forecasts, in ``strata`` parts of equal size; the last takes what is left.

    A forecast's part follows from how many forecasts lie before it: counts of the
    distinct values are added up in one short window, no row is sorted.
    """
    counts = df.where(F.col(f).isNotNull()).groupBy(F.col(f).alias("__f")).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    bins = counts.repartitionByRange("__f").sortWithinPartitions("__f").select("__f", "__n", F.spark_partition_id().alias("__p"))
    before = bins.groupBy("__p").agg(F.sum("__n").alias("__m"))
    earlier = before.select("__p", F.coalesce(F.sum("__m").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a task
    placed = bins.join(F.broadcast(earlier), "__p").withColumn("__at", F.col("__before") + F.sum("__n").over(Window.partitionBy("__p").orderBy("__f")) - F.col("__n"))
    rows = df.join(placed.select("__f", "__at"), F.col(f) == F.col("__f")).join(F.broadcast(total))  # one row
    size = F.floor(F.col("__all") / strata)
    part = F.least(F.lit(strata - 1), F.floor(F.try_divide(F.col("__at"), size))).cast("int")
    return rows.withColumn("stratum", F.coalesce(part, F.lit(strata - 1))).groupBy("stratum").agg(F.count("*").alias("n"), F.avg(F.col(y).between(F.col(low), F.col(high)).cast("double")).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("width"))


def isotonic(train: DataFrame, df: DataFrame, p: str, y: str, into: str = "calibrated") -> DataFrame:
    """Probabilities mapped by a rising function fitted on ``train``, clipped to [0, 1]."""
    out = rising_fit.apply(df, rising_fit.pools(train, p, y), p, into)
    return out.withColumn(into, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(into))))


def simplex_weights(df: DataFrame, y: str, forecasts: list[str], rounds: int = 2_000) -> dict[str, float]:
    """Weights of 0 or more that sum to 1 and minimise the squared error: moments from Spark, projected gradient on the driver."""
    k = len(forecasts)
    own = df.where(" and ".join(f"`{c}` is not null" for c in [y, *forecasts]))
    row = own.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"g{i}:{j}") for i, a in enumerate(forecasts) for j, b in enumerate(forecasts)], *[F.sum(F.col(a) * F.col(y)).alias(f"b{i}") for i, a in enumerate(forecasts)]).first()
    if row["b0"] is None:
        return dict.fromkeys(forecasts, 1 / k)
    g = np.array([[row[f"g{i}:{j}"] for j in range(k)] for i in range(k)])
    b = np.array([row[f"b{i}"] for i in range(k)])
    w, rate = np.full(k, 1 / k), 1 / max(np.linalg.eigvalsh(g)[-1], 1e-12)
    for _ in range(rounds):
        w = onto_simplex(w - rate * (g @ w - b))
    return dict(zip(forecasts, w.tolist(), strict=True))


def onto_simplex(x: np.ndarray) -> np.ndarray:
    u = np.sort(x)[::-1]
    over = np.cumsum(u) - 1
    k = np.flatnonzero(u * np.arange(1, len(x) + 1) > over)[-1]
    return np.maximum(x - over[k] / (k + 1), 0)


def blend(forecasts: list[str], weights: dict[str, float] | None = None) -> Column:
    """Mean, or weighted mean by given weights, of forecasts that are there."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for c in forecasts:
        w = 1.0 if weights is None else weights[c]
        top, bottom = top + F.coalesce(F.col(c) * w, F.lit(0.0)), bottom + F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    return F.try_divide(top, bottom)


def rising(quantiles: list[str]) -> list[Column]:
    """Quantile columns without crossing, pooled as an isotonic fit pools them: each is the largest mean of what ends at it over the smallest of what begins there."""
    k = len(quantiles)

    def mean(a: int, b: int) -> Column:
        out = F.col(quantiles[a])
        for i in range(a + 1, b + 1):
            out = out + F.col(quantiles[i])
        return out / (b - a + 1)

    def least(xs: list[Column]) -> Column:
        return F.least(*xs) if len(xs) > 1 else xs[0]

    def most(xs: list[Column]) -> Column:
        return F.greatest(*xs) if len(xs) > 1 else xs[0]

    return [most([least([mean(a, b) for b in range(i, k)]) for a in range(i + 1)]).alias(quantiles[i]) for i in range(k)]
