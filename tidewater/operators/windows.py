"""Windows over the rows of each series. Orders carry a tie-breaker; a window is partitioned by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(key: str | list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def change(value: str, w: WindowSpec, k: int = 1) -> Column:
    """Difference to the row k before: positional, a gap shifts it."""
    return F.col(value) - F.lag(value, k).over(w)


def rolling_mean(value: str, w: WindowSpec, k: int) -> Column:
    """Mean of the last k rows, of fewer at the start."""
    return F.avg(value).over(w.rowsBetween(-(k - 1), 0))


def centred_mean(value: str, w: WindowSpec) -> Column:
    """Mean of the row and its two neighbours; null where one is missing."""
    around = w.rowsBetween(-1, 1)
    return F.when(F.count(value).over(around) == 3, F.avg(value).over(around))


def forward_fill(value: str, w: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(value: str, w: WindowSpec) -> Column:
    """The next known value. It looks ahead: not for honest backtests."""
    return F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def increases_in_a_row(df: DataFrame, value: str, key: str, *order: str) -> DataFrame:
    """``df`` with ``streak``: how many times in a row the value rose up to this row."""
    w = over(key, *order)
    up = F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(False))
    marked = df.withColumn("__up", up).withColumn("__island", F.sum(F.when(F.col("__up"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum(F.col("__up").cast("int")).over(inside)).drop("__up", "__island")


def last_rows(df: DataFrame, n: int, key: str, *order) -> DataFrame:
    """The last n rows of each series by ``order`` (given as descending columns)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= n).drop("__at")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by a map-side combined maximum rather than a sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, *[F.col(f"row.{c}") for c in rest])


def slope_of_last(df: DataFrame, value: str, n: int, key: str, order: str) -> DataFrame:
    """(key, slope): least-squares slope of the last n values over their positions."""
    tail = df.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where(F.col("__at") <= n)
    return tail.groupBy(key).agg(F.regr_slope(F.col(value), -F.col("__at").cast("double")).alias("slope"))


def turning_points(df: DataFrame, value: str, key: str, *order: str) -> DataFrame:
    """``df`` with ``turn``: 1 at a local maximum, -1 at a local minimum, else 0."""
    w = over(key, *order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    v = F.col(value)
    return df.withColumn("turn", F.when((v > before) & (v > after), 1).when((v < before) & (v < after), -1).otherwise(0))


def mean_absolute_step(df: DataFrame, value: str, key: str, *order: str) -> DataFrame:
    return df.withColumn("__step", F.abs(change(value, over(key, *order)))).groupBy(key).agg(F.avg("__step").alias("mean_step"))


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the last by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, *[F.col(f"row.{c}") for c in rest])
