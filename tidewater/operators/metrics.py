"""Forecast metrics as aggregates, cross-validation folds, and selection gates."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import order


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rmse(y, f) -> Column:
    return F.sqrt(F.avg((_c(y) - _c(f)) * (_c(y) - _c(f))))


def mae(y, f) -> Column:
    return F.avg(F.abs(_c(y) - _c(f)))


def mape(y, f) -> Column:
    """Percent; a denominator under 1e-10 counts as 1e-10."""
    return 100 * F.avg(F.abs(_c(y) - _c(f)) / F.greatest(F.abs(_c(y)), F.lit(1e-10)))


def smape(y, f) -> Column:
    """100 * mean(|e| / ((|y| + |f|) / 2)); a denominator of 0 counts as 1e-10."""
    half = (F.abs(_c(y)) + F.abs(_c(f))) / 2
    return 100 * F.avg(F.abs(_c(y) - _c(f)) / F.when(half == 0, 1e-10).otherwise(half))


def coverage(y, low, high) -> Column:
    """Percent of rows inside their interval; the ends count as inside."""
    return 100 * F.avg(_c(y).between(_c(low), _c(high)).cast("double"))


def interval_score(y, low, high, alpha: float) -> Column:
    """Width plus 2 / alpha times the distance outside."""
    y, low, high = _c(y), _c(low), _c(high)
    return F.avg((high - low) + 2 / alpha * (F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0))))


def brier(y, p) -> Column:
    return F.avg((_c(p) - _c(y)) * (_c(p) - _c(y)))


def log_loss(y, p) -> Column:
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), _c(p)))
    return -F.avg(_c(y) * F.log(q) + (1 - _c(y)) * F.log(1 - q))


def sharpness(p) -> Column:
    """How far probabilities spread: their deviation over all rows. Of intervals see interval_sharpness."""
    return F.stddev_pop(_c(p))


def interval_sharpness(df: DataFrame, low: str, high: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, mean_width, median_width, std_width, min_width, max_width, cv_width) of intervals.

    The median is exact, the spread that of all rows (n), the variation spread over
    mean. Rows without an end are left out; an interval that ends before it begins
    is an error.
    """
    by = by or []
    width = F.when(F.col(high) >= F.col(low), F.col(high) - F.col(low)).otherwise(F.raise_error(F.lit("an interval ends before it begins")).cast("double"))
    rows = df.where(F.col(low).isNotNull() & F.col(high).isNotNull()).select(*by, width.cast("double").alias("__w"))
    w = F.col("__w")
    sums = rows.groupBy(*by).agg(F.avg(w).alias("mean_width"), F.stddev_pop(w).alias("std_width"), F.min(w).alias("min_width"), F.max(w).alias("max_width"))
    middle = order.quantiles(rows, "__w", 0.5, by, "median_width")
    both = sums.join(middle.withColumnsRenamed({c: f"__{c}" for c in by}), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]) if by else sums.join(F.broadcast(middle))  # one row each
    return both.select(*by, "n", "mean_width", "median_width", "std_width", "min_width", "max_width", (F.col("std_width") / (F.col("mean_width") + 1e-10)).alias("cv_width"))


def erf(x: Column) -> Column:
    """The error function, which Spark lacks: 2 / sqrt(pi) * exp(-x^2) * sum of x (2 x^2)^n / (1 * 3 * ... * (2n + 1)), as far as it matters; 1 or -1 beyond 6."""

    def series(v: Column) -> Column:
        begin = F.struct(v.alias("term"), v.alias("sum"))
        total = F.aggregate(F.sequence(F.lit(1), 10 + F.ceil(4 * F.least(v * v, F.lit(36.0))).cast("int")), begin, lambda a, n: F.struct((a["term"] * 2 * v * v / (2 * n + 1)).alias("term"), (a["sum"] + a["term"] * 2 * v * v / (2 * n + 1)).alias("sum")))
        return F.when(F.abs(v) > 6, F.signum(v)).otherwise(2 / math.sqrt(math.pi) * F.exp(-v * v) * total["sum"])

    return F.transform(F.array(x.cast("double")), series)[0]


def crps_normal(y, mean, sd) -> Column:
    """Continuous ranked probability score of a normal forecast."""
    z = (_c(y) - _c(mean)) / _c(sd)
    pdf = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return _c(sd) * (z * erf(z / math.sqrt(2)) + 2 * pdf - 1 / math.sqrt(math.pi))


def reliability(df: DataFrame, y: str, p: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """By equal bins of p, closed on the left, 1 in the last: rows, mean p, share of 1, and its Wilson 95 % interval."""
    edges = [k / bins for k in range(1, bins)]
    bin = reduce(lambda a, b: a + b, [(F.col(p) >= e).cast("int") for e in edges], F.lit(0))
    z = 1.959963984540054
    out = df.groupBy(*(by or []), bin.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("share"))
    n, s = F.col("n"), F.col("share")
    middle, spread = (s + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(s * (1 - s) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return out.withColumn("low", middle - spread).withColumn("high", middle + spread)


def calibration_error(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """One row: expected and maximal calibration error."""
    gap = F.abs(F.col("mean_p") - F.col("share"))
    return reliability(df, y, p, bins).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def turning_point_accuracy(df: DataFrame, key: str, order: str, y: str, f: str) -> DataFrame:
    """(key, accuracy): percent of turns of y with a turn of f, of either kind, at most one row away; 100 without turns."""
    w = Window.partitionBy(key).orderBy(order)

    def turn(c: str) -> Column:
        v, a, b = F.col(c), F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce(((v > a) & (v > b)) | ((v < a) & (v < b)), F.lit(False))

    marked = df.select(key, order, turn(y).alias("ty"), turn(f).alias("tf"))
    near = F.col("tf") | F.lag("tf", 1, False).over(w) | F.lead("tf", 1, False).over(w)
    hit = marked.withColumn("hit", F.when(F.col("ty"), near.cast("double")))
    return hit.groupBy(key).agg(F.coalesce(100 * F.avg("hit"), F.lit(100.0)).alias("accuracy"))


def direction_accuracy(y, f) -> Column:
    """Percent of revisions y whose sign the forecast revision f has; 0 is a sign of its own."""
    return 100 * F.avg((F.signum(_c(y)) == F.signum(_c(f))).cast("double"))


def state_mae(df: DataFrame, by: list[str], state: str, y: str, f: str, most: float = 12_000.0) -> DataFrame:
    """(by, states, states_passing): states, and those whose mean absolute error is at most ``most``."""
    each = df.groupBy(*by, state).agg(F.round(mae(y, f), 6).alias("__mae"))
    return each.groupBy(*by).agg(F.count("*").alias("states"), F.count_if(F.col("__mae") <= most).alias("states_passing"))


def expanding_folds(n: int, initial: int, step: int, horizon: int, gap: int = 0) -> list[tuple[int, int, int]]:
    """(train end, test start, test end) of folds over rows 0 to n - 1: training begins at 0 and grows."""
    return [(e, e + gap, e + gap + horizon) for e in range(initial, n - gap - horizon + 1, step)]


def assign_folds(df: DataFrame, key: str, order: str, *, initial: int, step: int, horizon: int, gap: int = 0) -> DataFrame:
    """``df`` with (fold, part) for every fold a row is in: train or test. Folds follow from positions, so no fold table is joined."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(key))
    last = F.floor((F.col("__n") - gap - horizon - initial) / step)
    rows = df.withColumn("__at", at).withColumn("__n", n).where(last >= 0)
    end = lambda k: initial + k * step
    test = lambda k: (F.col("__at") >= end(k) + gap) & (F.col("__at") < end(k) + gap + horizon)
    parts = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda k: F.struct(k.alias("fold"), F.when(F.col("__at") < end(k), "train").when(test(k), "test").alias("part")))
    return rows.withColumn("__p", F.explode(F.filter(parts, lambda x: x["part"].isNotNull()))).select(*df.columns, "__p.fold", "__p.part")


def cross_validate(folds: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], scores: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """(fold, by, scores) of a model fitted anew for each fold of assign_folds().

    ``fit`` takes the training rows of one fold and returns what predicts its test
    rows; ``scores`` are aggregates over these. Folds are few: one fit each.
    """
    numbers = sorted(r[0] for r in folds.select("fold").distinct().collect())
    parts = []
    for k in numbers:
        own = folds.where(F.col("fold") == k)
        predict = fit(own.where("part = 'train'"))
        scored = predict(own.where("part = 'test'")).groupBy("fold", *(by or []))
        parts.append(scored.agg(*[v.alias(c) for c, v in scores.items()]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def fold_summary(scores: DataFrame, value: str) -> DataFrame:
    """mean, standard deviation (n), min, max over folds."""
    return scores.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def split_dates(df: DataFrame, ts: str, train_end: str, test_start: str) -> tuple[DataFrame, DataFrame]:
    """Inclusive on both sides; parts that overlap are an error."""
    if test_start <= train_end:
        raise ValueError("train and test overlap")
    return df.where(F.col(ts) <= F.lit(train_end)), df.where(F.col(ts) >= F.lit(test_start))


#: Gates of a deployment by name: (metric, least, most). Fixed values.
GATES = {
    "smape": ("smape", None, 20.0),
    "rmse": ("rmse", None, 50_000.0),
    "forecast_stability": ("max_abs_forecast", None, 2_000_000.0),
    "hierarchical_coherence": ("max_reconciliation_error", None, 100.0),
    "coverage_90": ("coverage_90", 85.0, 95.0),
    "probability_coherence": ("probability_sum_error", None, 0.001),
    "probability_stability": ("avg_probability_change", None, 0.15),
    "ece": ("ece", None, 0.05),
    "revision_mae": ("revision_mae", None, 30_000.0),
    "revision_direction_accuracy": ("revision_direction_accuracy", 50.0, None),
    "turning_point_precision": ("turning_point_precision", 55.0, None),
    "state_level_accuracy": ("states_passing", 3.0, None),
}
#: What a metric adds to the score that models are ranked by, a unit of it; coverage adds its distance from 90. Fixed values.
SCORED = {"smape": 1.0, "rmse": 1e-3, "ece": 100.0, "probability_sum_error": 1000.0, "revision_mae": 1e-3, "max_reconciliation_error": 1e-2, "avg_probability_change": 10.0}


def select_models(scores: DataFrame, gates: dict = GATES, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Models (model, and a column a metric) with failed gates, eligibility, score and rank: eligible first, then score (less is better), then name.

    A gate whose metric is missing or null is not asked, and the metric adds 0 to
    the score. ``excluded`` models are never eligible.
    """
    failed = []
    for name, (metric, least, most) in gates.items():
        if metric in scores.columns:
            low = F.col(metric) < least if least is not None else F.lit(False)
            high = F.col(metric) > most if most is not None else F.lit(False)
            failed.append(F.when(low | high, F.lit(name)))
    parts = [F.coalesce(F.col(m) * w, F.lit(0.0)) for m, w in SCORED.items() if m in scores.columns]
    if "coverage_90" in scores.columns:
        parts.append(F.coalesce(F.abs(F.col("coverage_90") - 90), F.lit(0.0)))
    total = reduce(lambda a, b: a + b, parts, F.lit(0.0))
    out = scores.withColumn("failed", F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")).withColumn("score", F.round(total, 6))
    out = out.withColumn("eligible", (F.size("failed") == 0) & ~F.col("model").isin(*excluded) if excluded else F.size("failed") == 0)
    # A handful of candidate models: the one place where a ranking over all rows is meant.
    return out.withColumn("rank", F.row_number().over(Window.orderBy((~F.col("eligible")).cast("int"), "score", "model")))



#: Bounds of a model run: largest forecast, that of unstable factor models, coverage, smape. Fixed values.
HEALTH = {"hard": 2_000_000.0, "watch": 1_000_000.0, "coverage_low": 85.0, "coverage_high": 95.0, "smape": 20.0}


def model_health(runs: DataFrame, *, model: str = "model", y: str = "y", f: str = "f", low: str = "low", high: str = "high", warnings: str | None = None) -> DataFrame:
    """(model, issue, severity, observed): what is wrong with each model's forecasts; a sound model has no row.

    Missing, NaN or infinite forecasts and actuals are CRITICAL, as are forecasts
    over the hard bound; ``warnings`` names a column with the number of
    convergence warnings of the row. Accuracy and coverage are judged only if all
    values they need are finite.
    """

    def finite(c: str) -> Column:
        return F.coalesce(F.abs(F.nanvl(F.col(c).cast("double"), F.lit(None))) < float("inf"), F.lit(False))

    whole = F.bool_and(finite(f)), F.bool_and(finite(y)), F.bool_and(finite(low) & finite(high))
    size = F.max(F.when(finite(f), F.abs(f)))
    got = runs.groupBy(model).agg(
        F.count_if(~finite(f)).cast("double").alias("odd"),
        F.count_if(~finite(y)).cast("double").alias("odd_actuals"),
        F.count_if(~(finite(low) & finite(high))).cast("double").alias("odd_intervals"),
        size.alias("largest"),
        F.when(whole[0] & whole[1], smape(y, f)).alias("smape"),
        F.when(whole[1] & whole[2], coverage(y, low, high)).alias("coverage"),
        (F.sum(warnings) if warnings else F.lit(0)).cast("double").alias("warned"),
    )
    name, largest = F.lower(model), F.col("largest")
    hard = largest > HEALTH["hard"]
    issues = [
        (F.col("odd") > 0, F.lit("prediction_finite"), "CRITICAL", F.col("odd")),
        (hard, F.lit("forecast_magnitude_hard_gate"), "CRITICAL", largest),
        (~hard & (name == "dfm") & (largest > HEALTH["watch"]), F.lit("dfm_instability"), "WARNING", largest),
        (F.col("warned") > 0, F.when(name == "midas", "midas_convergence").otherwise("model_convergence"), "WARNING", F.col("warned")),
        (F.col("odd_actuals") > 0, F.lit("actuals_finite"), "CRITICAL", F.col("odd_actuals")),
        (F.col("smape") > HEALTH["smape"], F.lit("smape_gate"), "WARNING", F.col("smape")),
        (F.col("odd_intervals") > 0, F.lit("interval_finite"), "CRITICAL", F.col("odd_intervals")),
        (F.col("coverage") < HEALTH["coverage_low"], F.lit("coverage_low"), "WARNING", F.col("coverage")),
        (F.col("coverage") > HEALTH["coverage_high"], F.lit("coverage_high"), "WARNING", F.col("coverage")),
    ]
    rows = F.array(*[F.when(when, F.struct(issue.alias("issue"), F.lit(severity).alias("severity"), seen.alias("observed"))) for when, issue, severity, seen in issues])
    return got.select(model, F.inline(F.array_compact(rows)))
