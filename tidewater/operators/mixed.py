"""Mixed-frequency forecasts: lag columns of several sources, three models, their weighted mean, and intervals that widen with stale sources.

The models are factors with a ridge head, lags under softmax weights and boosted quantiles. They
are fitted by jobs of Spark; what is kept of them has the size of a model.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import boosting, calibrate, dynamic_factors, lag_fit, models

#: Days beyond which a source does not count as staler. Fixed value.
STALEST = 31.0
COMPONENTS = ["dfm", "midas", "xgboost"]


def component_weights(df: DataFrame, y: str, forecasts: list[str], given: dict[str, float] | None = None, optimise: bool = False) -> dict[str, float]:
    """Weights that minimise the squared error if ``optimise``, else those given, else equal ones."""
    if optimise:
        return calibrate.simplex_weights(df, y, forecasts)
    return given or dict.fromkeys(forecasts, 1 / len(forecasts))


def residual_scale(df: DataFrame, y: str, forecast: Column, least: float = 1.0) -> float:
    """Spread (n) of what a forecast misses, at least ``least``."""
    spread = df.agg(F.stddev_pop(F.col(y) - forecast).alias("s")).first()["s"]
    return max(spread or 0.0, least)


def half_width(scale: float, recency: list[str], low: str | None = None, high: str | None = None, least_width: float = 1.0) -> Column:
    """Half of the quantile range, but no less than the residual scale times 1 to 2 for sources of 0 to 31 days, nor than half of ``least_width``.

    ``recency`` are columns of days since each source's last value; their mean
    leaves nulls out and is 0 if all are null. Without quantiles the rest decides.
    """
    total, there = F.lit(0.0), F.lit(0)
    for c in recency:
        total, there = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0)), there + F.col(c).isNotNull().cast("int")
    days = F.coalesce(F.try_divide(total, there), F.lit(0.0))
    stale = 1 + F.greatest(F.lit(0.0), F.least(F.lit(STALEST), days)) / STALEST
    out = F.greatest(scale * stale, F.lit(least_width / 2))
    return out if low is None or high is None else F.greatest(out, (F.col(high) - F.col(low)) / 2)


@dataclass
class Mixed:
    columns: list[str]
    factors: models.Factors | dynamic_factors.Nowcast
    midas: models.Linear
    trees: boosting.Booster
    low: str
    high: str
    weights: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    least_width: float = 1.0

    def components(self, df: DataFrame) -> DataFrame:
        """``df`` with dfm, midas, xgboost and the ends of the quantile range."""
        made = self.factors.transform(self.trees.predict(df))
        return made.select(*df.columns, self.factors.head.predict().alias("dfm"), self.midas.predict().alias("midas"), F.col("q_50").alias("xgboost"), F.col(self.low).alias("__low"), F.col(self.high).alias("__high"))

    def predict(self, df: DataFrame, recency: list[str] | None = None) -> DataFrame:
        """``df`` with the three forecasts, forecast, low and high."""
        wide = half_width(self.scale, recency or [], "__low", "__high", self.least_width)
        out = self.components(df).withColumn("forecast", calibrate.blend(COMPONENTS, self.weights)).withColumn("__half", wide)
        return out.withColumn("low", F.col("forecast") - F.col("__half")).withColumn("high", F.col("forecast") + F.col("__half")).drop("__low", "__high", "__half")


def fit(train: DataFrame, groups: dict[str, list[str]], y: str, *, n_factors: int = 2, confidence: float = 0.9, given: dict[str, float] | None = None, optimise: bool = False, least_width: float = 1.0, least_scale: float = 1.0, trees: int = 100, depth: int = 5, ts: str | None = None) -> Mixed:
    """The three models on bridged lag columns (source -> its columns, not weighted before), their weights and the residual scale.

    With ``ts``, the target dates, the factors are fitted by likelihood in their order
    and the penalty of their head is chosen on later rows; without, they are principal
    axes with a fixed penalty.
    """
    if not 0 < confidence < 1 or least_width <= 0 or least_scale <= 0:
        raise ValueError("confidence is between 0 and 1, least_width and least_scale are positive")
    if train.where(F.col(y).isNull()).limit(1).count() or train.limit(1).count() == 0:
        raise ValueError("targets are empty or have gaps")
    columns, tail = [c for g in groups.values() for c in g], (1 - confidence) / 2
    train = train.select(*columns, y, *([ts] if ts else [])).persist()  # a row a target date, read again for every tree
    quantiles = (round(tail, 6), 0.5, round(1 - tail, 6))
    grown = boosting.fit(train, columns, y, quantiles, trees=trees, depth=depth)
    k = min(n_factors, len(columns))
    head = dynamic_factors.nowcast(train, columns, y, k, ts, rounds=40) if ts else models.factors(train, columns, k, y)
    out = Mixed(columns, head, lag_fit.nonlinear_midas(train, groups, y), grown, f"q_{round(quantiles[0] * 100, 6):g}", f"q_{round(quantiles[2] * 100, 6):g}", least_width=least_width)
    known = out.components(train)
    out.weights = component_weights(known, y, COMPONENTS, given, optimise)
    out.scale = residual_scale(known, y, calibrate.blend(COMPONENTS, out.weights), least_scale)
    train.unpersist()
    return out
