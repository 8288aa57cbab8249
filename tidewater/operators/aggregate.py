"""Roll-ups of series: sums, weighted means, weights, pivots, monthly summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import calendar
from tidewater.functions.nulls import ratio, zero_sum


def total(df: DataFrame, by: list[str], value: str, into: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(zero_sum(value).alias(into))


def weighted_mean(df: DataFrame, weights: DataFrame, by: list[str], on: str, value: str, weight: str, *, missing: str = "drop", into: str = "weighted_mean") -> DataFrame:
    """sum(value * weight) / sum(weight); rows with a null value still count in the weights.

    ``missing`` weights: "error", "fill_zero", or "drop" (null, which sums skip).
    """
    if missing not in ("error", "fill_zero", "drop"):
        raise ValueError(missing)
    joined = df.join(weights.select(on, weight), on, "left")
    w = F.col(weight)
    if missing == "error":
        w = F.when(w.isNull(), F.raise_error(F.concat(F.lit("no weight for "), F.col(on).cast("string"))).cast("double")).otherwise(w)
    elif missing == "fill_zero":
        w = F.coalesce(w, F.lit(0.0))
    return joined.groupBy(*by).agg(ratio(F.sum(F.col(value) * w), F.sum(w)).alias(into))


def weighted_sum(df: DataFrame, weights: DataFrame, by: list[str], on: str, value: str, weight: str, into: str = "weighted_sum") -> DataFrame:
    """sum(value * weight); a missing weight counts 0, and nothing is normalised."""
    return df.join(weights.select(on, weight), on, "left").groupBy(*by).agg(zero_sum(F.col(value) * F.coalesce(weight, F.lit(0.0))).alias(into))


def shares(df: DataFrame, value: str, within: list[str] | None = None, into: str = "weight") -> DataFrame:
    """Each row's share of the total; negative values are an error, a total of 0 gives equal weights."""
    v = F.when(F.col(value) < 0, F.raise_error(F.lit("a weight can't be negative")).cast("double")).otherwise(F.coalesce(F.col(value), F.lit(0.0)))
    by = within or []
    sums = df.groupBy(*by).agg(F.sum(v).alias("__total"), F.count("*").alias("__n"))
    joined = df.join(sums, by) if by else df.join(F.broadcast(sums))  # one row
    return joined.withColumn(into, F.when(F.col("__total") == 0, 1 / F.col("__n")).otherwise(v / F.col("__total"))).drop("__total", "__n")


def pivot_sum(df: DataFrame, by: str, column: str, values: list[str], value: str) -> DataFrame:
    """A column for each of ``values``: named up front, so one pass does."""
    return df.groupBy(by).pivot(column, values).agg(F.sum(value)).select(by, *[F.col(v) for v in values])


def distinct_joined(column: str, separator: str = ", ") -> Column:
    """Distinct values in order, as one string."""
    return F.array_join(F.sort_array(F.collect_set(column)), separator)


def monthly_flow(df: DataFrame, *, key: list[str], ts: str, value: str, balance: str, tie: str) -> DataFrame:
    """By month: sum, mean, standard deviation (n - 1), rows, last balance, last day."""
    return df.groupBy(*key, calendar.month(F.col(ts)).alias("month")).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("days"), F.max_by(balance, F.struct(ts, tie)).alias("month_end_balance"), F.max(F.col(ts).cast("date")).alias("last_date"))


def flag_above_percentile(df: DataFrame, value: str, q: float, into: str) -> DataFrame:
    """Rows over the exact q-quantile of all rows."""
    bound = df.agg(F.percentile(value, F.lit(q)).alias("__bound"))
    return df.join(F.broadcast(bound)).withColumn(into, F.col(value) > F.col("__bound")).drop("__bound")  # one row


def top_by(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order: kept by each task, then merged."""
    return df.orderBy(*order).limit(n)


def rank_within(df: DataFrame, by: list[str], *order: Column, into: str = "rank") -> DataFrame:
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
