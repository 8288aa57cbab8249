"""Forecasting models fitted in Spark: normal equations and moments are aggregates, dense algebra of model size runs on the driver."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.lags import almon_weights


@dataclass
class Linear:
    columns: list[str]
    intercept: float
    weights: list[float]

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for c, w in zip(self.columns, self.weights, strict=True):
            out = out + F.col(c) * float(w)
        return out

    def importance(self) -> list[tuple[str, float]]:
        return sorted(((c, abs(w)) for c, w in zip(self.columns, self.weights, strict=True)), key=lambda x: (-x[1], x[0]))


def moments(df: DataFrame, columns: list[str], y: str, weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray, float, np.ndarray]:
    """(n, means, cross products about the means, mean of y, products with y) of complete rows, in two passes for accuracy."""
    w = F.col(weight) if weight else F.lit(1.0)
    own = df.where(" and ".join(f"`{c}` is not null" for c in [*columns, y]))
    first = own.agg(F.sum(w).alias("n"), *[(F.sum(F.col(c) * w) / F.sum(w)).alias(f"m{i}") for i, c in enumerate([*columns, y])]).first()
    k = len(columns)
    if not first["n"]:
        return 0.0, np.zeros(k), np.eye(k), 0.0, np.zeros(k)
    mean = np.array([first[f"m{i}"] for i in range(k + 1)])
    centred = [F.col(c) - float(m) for c, m in zip([*columns, y], mean, strict=True)]
    row = own.agg(*[F.sum(w * centred[i] * centred[j]).alias(f"g{i}:{j}") for i in range(k + 1) for j in range(i, k + 1)]).first()
    g = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            g[i, j] = g[j, i] = row[f"g{i}:{j}"]
    return float(first["n"]), mean[:k], g[:k, :k], float(mean[k]), g[:k, k]


def ridge(df: DataFrame, columns: list[str], y: str, penalty: float = 1.0, standardise: bool = True) -> Linear:
    """Least squares with ``penalty`` on squared weights of standardised (n) columns; the intercept is free."""
    n, mean, g, my, b = moments(df, columns, y)
    scale = np.sqrt(np.maximum(np.diag(g) / max(n, 1), 0)) if standardise else np.ones(len(columns))
    scale[scale == 0] = 1.0
    w = np.linalg.solve(g / np.outer(scale, scale) + (penalty + 1e-12) * np.eye(len(columns)), b / scale) / scale
    return Linear(columns, my - float(mean @ w), w.tolist())


def revision_model(df: DataFrame, columns: list[str], first: str, final: str) -> Linear:
    """What is later added to a first release, as a ridge on standardised columns."""
    return ridge(df.withColumn("__revision", F.col(final) - F.col(first)), columns, "__revision", 1.0)


def midas(df: DataFrame, groups: dict[str, list[str]], y: str, degrees: tuple[float, ...] = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0)) -> Linear:
    """One coefficient a source on Almon-weighted lags; each source's decay is chosen from ``degrees`` by coordinate descent on the squared error.

    Moments of the lag columns are gathered once; every trial works on them.
    """
    columns = [c for g in groups.values() for c in g]
    n, mean, g, my, b = moments(df, columns, y)
    own = df.agg(F.var_pop(y).alias("v")).first()["v"] or 0.0
    chosen = dict.fromkeys(groups, 1.0)

    def solved(choice: dict[str, float]) -> tuple[float, np.ndarray]:
        mix = np.zeros((len(columns), len(groups)))
        at = 0
        for k, (name, lags) in enumerate(groups.items()):
            mix[at : at + len(lags), k] = almon_weights(len(lags), choice[name])
            at += len(lags)
        small = mix.T @ g @ mix + 1e-9 * np.trace(g) / max(len(columns), 1) * np.eye(len(groups))
        beta = np.linalg.solve(small + 1e-12 * np.eye(len(groups)), mix.T @ b)
        w = mix @ beta
        return own * n - 2 * float(w @ b) + float(w @ g @ w), w

    for _ in range(3):
        for name in groups:
            chosen[name] = min(degrees, key=lambda d: (solved(chosen | {name: d})[0], d))
    w = solved(chosen)[1]
    return Linear(columns, my - float(mean @ w), w.tolist())


@dataclass
class Factors:
    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    head: Linear | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with factor_1, factor_2, ...: standardised columns, nulls at their mean, on the loadings."""
        z = [(F.coalesce(F.col(c), F.lit(float(m))) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)]
        out = {}
        for k in range(self.loadings.shape[1]):
            total = F.lit(0.0)
            for x, w in zip(z, self.loadings[:, k], strict=True):
                total = total + x * float(w)
            out[f"factor_{k + 1}"] = total
        return df.withColumns(out)


def factors(df: DataFrame, columns: list[str], k: int, y: str | None = None, penalty: float = 1.0) -> Factors:
    """Principal factors of the standardised (n) columns, signs fixed, and a ridge head on them if ``y`` is given."""
    n, mean, g, _, _ = moments(df.withColumn("__0", F.lit(0.0)), columns, "__0")
    scale = np.sqrt(np.maximum(np.diag(g) / max(n, 1), 0))
    scale[scale == 0] = 1.0
    _, axes = np.linalg.eigh(g / np.outer(scale, scale))
    loadings = axes[:, ::-1][:, :k]
    loadings = loadings * np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])] < 0, -1, 1)
    out = Factors(columns, mean, scale, loadings)
    if y is not None:
        out.head = ridge(out.transform(df), [f"factor_{i + 1}" for i in range(k)], y, penalty)
    return out


def kalman_level(rows: pd.DataFrame, q: float = 0.1, r: float = 1.0) -> pd.DataFrame:
    """Filtered level of one series (ts, value), a random walk plus noise; missing values carry the prediction on."""
    level, variance, out = np.nan, 1e6, []
    for v in rows["value"].to_numpy(float):
        variance += q
        if np.isnan(level):
            level = v
        elif not np.isnan(v):
            gain = variance / (variance + r)
            level, variance = level + gain * (v - level), (1 - gain) * variance
        out.append(level)
    return rows.assign(level=out)


def filtered_levels(df: DataFrame, *, key: str = "series", ts: str = "ts", value: str = "value", q: float = 0.1, r: float = 1.0) -> DataFrame:
    """(key, ts, value, level) by a filter run over each series in order: the recursion is what Spark's windows can't state. A series is one group."""
    kind = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return kalman_level(rows.sort_values(ts).rename(columns={value: "value"}), q, r).rename(columns={"value": value})[[key, ts, value, "level"]]

    return df.select(key, ts, value).groupBy(key).applyInPandas(run, f"`{key}` {kind[key]}, `{ts}` {kind[ts]}, `{value}` double, level double")


def quantile_forest(train: DataFrame, columns: list[str], y: str, quantiles: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95), rounds: int = 3, trees: int = 100, depth: int = 5, seed: int = 42):
    """Boosted trees for each quantile: squared error, refitted with weights q above the last fit and 1 - q below it.

    The first round is the same for all quantiles and made once; then the quantiles
    are fitted side by side, as each leaves most cores idle between its small jobs.
    """
    make = VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="keep")
    base = make.transform(train).select("__x", F.col(y).cast("double").alias("__y"))
    make_model = lambda: GBTRegressor(featuresCol="__x", labelCol="__y", weightCol="__w", predictionCol="__f", maxIter=trees, maxDepth=depth, seed=seed)
    first = make_model().fit(base.withColumn("__w", F.lit(1.0)))

    def fit(q: float):
        model = first
        for _ in range(rounds - 1):
            rows = model.transform(base).withColumn("__w", F.when(F.col("__y") > F.col("__f"), q).otherwise(1 - q)).select("__x", "__y", "__w")
            model = make_model().fit(rows)
        return model

    with ThreadPoolExecutor(len(quantiles)) as pool:
        fitted = list(pool.map(inheritable_thread_target(train.sparkSession)(fit), quantiles))
    return make, {q: model.copy() for q, model in zip(quantiles, fitted, strict=True)}


def predict_quantiles(df: DataFrame, fitted) -> DataFrame:
    """``df`` with q_10, q_50, ... in rising order."""
    from tidewater.operators.calibrate import rising

    make, models = fitted
    out = make.transform(df)
    names = []
    for q in sorted(models):
        names.append(f"q_{round(q * 100)}")
        out = models[q].setPredictionCol(names[-1]).transform(out)
    return out.select(*df.columns, *rising(names))


def closest_quantile(available: list[float], wanted: float, tolerance: float = 0.01) -> float:
    best = min(available, key=lambda q: abs(q - wanted))
    if abs(best - wanted) > tolerance:
        raise ValueError(f"no quantile near {wanted}")
    return best


def stable(transition: np.ndarray, most: float = 0.99) -> bool:
    """Whether a transition matrix dies out: all eigenvalues within ``most`` of 0."""
    return bool(np.abs(np.linalg.eigvals(transition)).max(initial=0.0) < most)


def companion(coefficients: list[np.ndarray]) -> np.ndarray:
    """The transition matrix of a vector autoregression."""
    k, p = len(coefficients[0]), len(coefficients)
    out = np.zeros((k * p, k * p))
    out[:k] = np.hstack(coefficients)
    out[k:, :-k] = np.eye(k * (p - 1))
    return out
