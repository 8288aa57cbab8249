"""Scalers fitted in Spark: moments and ends in one aggregate, exact quantiles by range, each transform a projection.

A scaler is fitted on the rows it is given; keeping later rows out is up to the
caller.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.folders import small
from tidewater.operators import order


@dataclass
class Scaler:
    """``fit`` learns two numbers a column; ``transform`` and ``inverse_transform`` apply them."""

    columns: list[str]
    learned: dict[str, tuple[float, float]] = field(default_factory=dict)

    def measures(self, c: str) -> tuple[Column, Column]:
        raise NotImplementedError

    def shares(self) -> tuple[float, ...]:
        """The quantiles that are measured, where no plain aggregate is."""
        return ()

    def of_quantiles(self, cuts: list[float]) -> tuple[float, float]:
        raise NotImplementedError

    def finish(self, a: float, b: float) -> tuple[float, float]:
        """(shift, scale); a scale of 0 counts as 1."""
        return a, b or 1.0

    def fit(self, df: DataFrame) -> Scaler:
        return fit_together([self], df)[0]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - a) / b for c, (a, b) in self.learned.items()})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * b + a for c, (a, b) in self.learned.items()})


class StandardScaler(Scaler):
    """Mean 0, standard deviation (n - 1) 1."""

    def measures(self, c):
        return F.avg(c), F.stddev_samp(c)


class MinMaxScaler(Scaler):
    """To [0, 1], clipped; a constant column becomes 0."""

    def measures(self, c):
        return F.min(c), F.max(c) - F.min(c)

    def transform(self, df):
        return df.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - a) / b)) for c, (a, b) in self.learned.items()})


class RobustScaler(Scaler):
    """Exact median and distance of quartiles."""

    def measures(self, c):
        return F.percentile(c, F.lit(0.5)), F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))

    def shares(self):
        return 0.25, 0.5, 0.75

    def of_quantiles(self, cuts):
        return cuts[1], cuts[2] - cuts[0]


@dataclass
class Winsorizer(Scaler):
    """Clips at exact quantiles. What it cuts is gone: there is no inverse."""

    lower: float = 0.05
    upper: float = 0.95

    def measures(self, c):
        return F.percentile(c, F.lit(self.lower)), F.percentile(c, F.lit(self.upper))

    def shares(self):
        return self.lower, self.upper

    def of_quantiles(self, cuts):
        return cuts[0], cuts[1]

    def finish(self, a, b):
        return a, b

    def transform(self, df):
        return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(a), F.least(F.lit(b), F.col(c)))) for c, (a, b) in self.learned.items()})

    def inverse_transform(self, df):
        raise ValueError("a winsorizer has no inverse")


@dataclass
class ScalerPipeline:
    """Scalers one after the other, each fitted on what the ones before give."""

    steps: list[tuple[str, Scaler]]

    def fit(self, df: DataFrame) -> ScalerPipeline:
        for _, step in self.steps:
            df = step.fit(df).transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step.transform(df)
        return df

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for _, step in reversed(self.steps):
            df = step.inverse_transform(df)
        return df


def fit_together(scalers: list[Scaler], df: DataFrame) -> list[Scaler]:
    """Fit scalers that don't build on each other: one pass over ``df`` for all aggregates, and one a column for its quantiles, which no single task holds."""
    found: dict[tuple[int, str], tuple[float | None, float | None]] = {}
    plain = [(s, c) for s, scaler in enumerate(scalers) if not scaler.shares() for c in scaler.columns]
    if plain:
        row = df.agg(*[m.alias(f"{s}:{c}:{k}") for s, c in plain for k, m in enumerate(scalers[s].measures(c))]).first()
        found |= {(s, c): (row[f"{s}:{c}:0"], row[f"{s}:{c}:1"]) for s, c in plain}
    wanted = [(s, c) for s, scaler in enumerate(scalers) if scaler.shares() for c in scaler.columns]
    for column in dict.fromkeys(c for _, c in wanted):
        own = [s for s, c in wanted if c == column]
        cuts = order.quantiles(df.select(F.col(column).alias("__v")), "__v", [q for s in own for q in scalers[s].shares()]).first()["quantile"]
        for s in own:
            mine, cuts = cuts[: len(scalers[s].shares())], cuts[len(scalers[s].shares()) :]
            found[s, column] = (None, None) if None in mine else scalers[s].of_quantiles(mine)
    for (s, c), (a, b) in found.items():
        scalers[s].learned[c] = scalers[s].finish(0.0 if a is None else a, 0.0 if b is None else b)
    return scalers


def by_series(df: DataFrame, key: str, value: str, measure: Callable[[str], tuple[Column, Column]], into: str) -> DataFrame:
    """(value - shift) / scale with both measured in each series: one aggregate and a join on the series."""
    a, b = measure(value)
    learned = small(df.groupBy(key).agg(a.alias("__a"), b.alias("__b")))
    scale = F.when(F.coalesce(F.col("__b"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("__b"))
    return df.join(learned, key).withColumn(into, (F.col(value) - F.col("__a")) / scale).drop("__a", "__b")


def scores_by_series(df: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with ``z``, the distance from the series' mean in deviations (n - 1), and ``robust``, that from its median in quartile distances.

    Both come from one table of the series and one join; the quartiles are found by
    range, and few series are broadcast, so no task holds a series. A spread of 0, or of
    one row, counts as 1.
    """
    sums = df.groupBy(F.col(key).alias("__key")).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__spread"))
    cuts = order.quantiles(df.select(key, value), value, [0.25, 0.5, 0.75], [key], "__q").select(F.col(key).alias("__own"), "__q")
    learned = small(sums.join(cuts, F.col("__key").eqNullSafe(F.col("__own")), "left").drop("__own"))
    one = lambda c: F.when(F.coalesce(c, F.lit(0.0)) == 0, 1.0).otherwise(c)
    out = df.join(learned, F.col(key).eqNullSafe(F.col("__key")))
    scores = {"z": (F.col(value) - F.col("__mean")) / one(F.col("__spread")), "robust": (F.col(value) - F.col("__q")[1]) / one(F.col("__q")[2] - F.col("__q")[0])}
    return out.withColumns(scores).drop("__key", "__mean", "__spread", "__q")
