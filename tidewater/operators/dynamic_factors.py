"""A dynamic factor model of many panels, fitted by likelihood.

A panel is one short multivariate series (a region, a product, a firm), read in
order of time: x_t = loadings f_t + noise, f_t = transition f_{t-1} + shock, with
shocks of unit covariance. All panels share the parameters. Fitting is by
expectation and maximisation: tasks run the Kalman filter and smoother over their
panels, many panels side by side, and return the moments that the maximisation
needs; Spark adds these up, and only sums as large as the model reach the driver.
The filter takes the panel's observations as they are: what is missing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.folders import materialize
from tidewater.operators import ridge_head

#: Least share of a column's variance that counts as noise: below, likelihoods cannot be told apart.
LEAST_NOISE = 1e-9


@dataclass
class DynamicFactors:
    """The model: of standardised, clipped columns. ``log_likelihood`` has a value for each round of fitting."""

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    low: np.ndarray
    high: np.ndarray
    loadings: np.ndarray
    transition: np.ndarray
    noise: np.ndarray
    start: np.ndarray
    log_likelihood: list[float] = field(default_factory=list)
    converged: bool = False

    @property
    def stable(self) -> bool:
        return bool(np.abs(np.linalg.eigvals(self.transition)).max(initial=0.0) < 1)

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, self.low, self.high)

    def project(self, df: DataFrame) -> DataFrame:
        """``df`` with factor_1, ...: each row's standardised, clipped columns on the pseudo-inverse of the loadings; what is missing counts as the mean."""
        inverse = np.linalg.pinv(self.loadings)
        z = []
        for c, m, s, low, high in zip(self.columns, self.mean, self.scale, self.low, self.high, strict=True):
            x = (F.col(c).cast("double") - float(m)) / float(s)
            x = F.when(F.abs(x) < float("inf"), x)
            x = x if np.isinf(low) else F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))
            z.append(F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0)))
        return df.withColumns({f"factor_{k + 1}": sum((x * float(w) for x, w in zip(z[1:], inverse[k, 1:], strict=True)), z[0] * float(inverse[k, 0])) for k in range(len(inverse))})

    def transform(self, df: DataFrame, ts: str, key: str | None = None, smoothed: bool = False) -> DataFrame:
        """(key, ts, factor_1, ...): what is known of the factors at each time from values up to then, or from all if ``smoothed``."""
        k, model = self.loadings.shape[1], self
        keys = [key] if key else []
        kinds = dict(df.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, length = padded(batch, len(model.columns))
                state = passes(model.standardised(x), model, smooth=smoothed)
                f = state["smooth" if smoothed else "filtered"]
                lists = [pa.array([row[:n].tolist() for row, n in zip(f[:, :, j], length, strict=True)], pa.list_(pa.float64())) for j in range(k)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), *lists], ["key", "at", *(f"f{j}" for j in range(k))])

        held = panels(df, self.columns, ts, key)
        kind = f"key {kinds[key] if key else 'int'}, at array<{kinds[ts]}>, " + ", ".join(f"f{j} array<double>" for j in range(k))
        out = held.mapInArrow(run, kind).select("key", F.explode(F.arrays_zip("at", *(f"f{j}" for j in range(k)))).alias("r"))
        named = [F.col("key").alias(key)] if keys else []
        return out.select(*named, F.col("r.at").alias(ts), *[F.col(f"r.f{j}").alias(f"factor_{j + 1}") for j in range(k)])


def panels(df: DataFrame, columns: list[str], ts: str, key: str | None) -> DataFrame:
    """A row a panel: its times in order and its values, one array after another. Of rows with one time the later in order of values counts as later."""
    own = F.col(key) if key else F.lit(0)
    values = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select(own.alias("key"), F.struct(F.col(ts).alias("at"), values.alias("x")).alias("r")).where(F.col("r.at").isNotNull())
    held = rows.groupBy("key").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return held.select("key", F.col("r.at").alias("at"), F.flatten(F.col("r.x")).alias("x"))


def padded(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Values as (panel, time, column), not a number where missing or past the end, and each panel's length."""
    rows = batch.column("x")
    length = np.array([len(x) // p for x in rows], np.int64)
    out = np.full((len(rows), max(length, default=0), p), np.nan)
    for i, x in enumerate(rows):
        out[i, : length[i]] = np.array([np.nan if v is None else v for v in x.as_py()], float).reshape(-1, p)
    out[~np.isfinite(out)] = np.nan
    return out, length


def passes(x: np.ndarray, m: DynamicFactors, smooth: bool = True) -> dict[str, np.ndarray]:
    """Filter (and smoother) over all panels at once, in the information form: noise is independent by column."""
    b, t, p = x.shape
    k = m.loadings.shape[1]
    seen = np.isfinite(x)
    z = np.where(seen, x, 0.0)
    ahead, ahead_cov = np.zeros((b, t, k)), np.zeros((b, t, k, k))
    now, now_cov = np.zeros((b, t, k)), np.zeros((b, t, k, k))
    likely = np.zeros(b)
    outer = np.einsum("pk,pl->pkl", m.loadings, m.loadings) / m.noise[:, None, None]
    f, cov = np.zeros((b, k)), np.broadcast_to(m.start, (b, k, k))
    for s in range(t):
        if s:
            f = now[:, s - 1] @ m.transition.T
            cov = m.transition @ now_cov[:, s - 1] @ m.transition.T + np.eye(k)
        ahead[:, s], ahead_cov[:, s] = f, cov
        own = seen[:, s]
        missed = np.where(own, z[:, s] - f @ m.loadings.T, 0.0)
        weighed = (missed / m.noise) @ m.loadings
        after = np.linalg.inv(np.linalg.inv(cov) + np.einsum("bp,pkl->bkl", own.astype(float), outer))
        after = (after + after.transpose(0, 2, 1)) / 2
        now[:, s], now_cov[:, s] = f + np.einsum("bkl,bl->bk", after, weighed), after
        some = own.any(axis=1)
        spread = own @ np.log(2 * np.pi * m.noise) + np.linalg.slogdet(cov)[1] - np.linalg.slogdet(after)[1]
        distance = (missed**2 / m.noise).sum(1) - np.einsum("bk,bkl,bl->b", weighed, after, weighed)
        likely -= np.where(some, 0.5 * (spread + distance), 0.0)
    out = {"filtered": now, "likely": likely, "seen": seen, "z": z}
    if not smooth:
        return out
    back, back_cov, lag = now.copy(), now_cov.copy(), np.zeros((b, t, k, k))
    for s in range(t - 2, -1, -1):
        gain = now_cov[:, s] @ m.transition.T @ np.linalg.inv(ahead_cov[:, s + 1])
        back[:, s] = now[:, s] + np.einsum("bkl,bl->bk", gain, back[:, s + 1] - ahead[:, s + 1])
        back_cov[:, s] = now_cov[:, s] + gain @ (back_cov[:, s + 1] - ahead_cov[:, s + 1]) @ gain.transpose(0, 2, 1)
        lag[:, s + 1] = back_cov[:, s + 1] @ gain.transpose(0, 2, 1)
    return out | {"smooth": back, "smooth_cov": back_cov, "lag": lag}


def shapes(p: int, k: int) -> dict[str, tuple[int, ...]]:
    """The moments of a round, in the order in which they are laid out."""
    return {"likely": (1,), "panels": (1,), "steps": (1,), "now": (k, k), "lagged": (k, k), "before": (k, k), "start": (k, k), "n": (p,), "squares": (p,), "with_x": (p, k), "seen": (p, k, k)}


def moments_of(x: np.ndarray, length: np.ndarray, m: DynamicFactors) -> np.ndarray:
    state = passes(x, m)
    f, cov, lag, seen, z = (state[c] for c in ("smooth", "smooth_cov", "lag", "seen", "z"))
    inside = np.arange(x.shape[1])[None] < length[:, None]
    second = cov + np.einsum("btk,btl->btkl", f, f)
    cross = lag[:, 1:] + np.einsum("btk,btl->btkl", f[:, 1:], f[:, :-1])
    later = inside[:, 1:].astype(float)
    some = (length > 0).astype(float)
    parts = {
        "likely": [state["likely"].sum()],
        "panels": [some.sum()],
        "steps": [later.sum()],
        "now": np.einsum("bt,btkl->kl", later, second[:, 1:]),
        "lagged": np.einsum("bt,btkl->kl", later, cross),
        "before": np.einsum("bt,btkl->kl", later, second[:, :-1]),
        "start": np.einsum("b,bkl->kl", some, second[:, 0]) if x.shape[1] else np.zeros((f.shape[2],) * 2),
        "n": seen.sum((0, 1)),
        "squares": (z**2).sum((0, 1)),
        "with_x": np.einsum("btp,btk->pk", z, f),
        "seen": np.einsum("btp,btkl->pkl", seen.astype(float), second),
    }
    return np.concatenate([np.ravel(v) for v in parts.values()])


def expected(held: DataFrame, m: DynamicFactors) -> dict[str, np.ndarray]:
    """The moments of all panels, summed by Spark."""
    p = len(m.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, len(batch), 256):
                x, length = padded(batch.slice(a, 256), p)
                own = moments_of(m.standardised(x), length, m)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    rows = held.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat, out, at = np.zeros(len(rows)), {}, 0
    for r in rows:
        flat[r["at"]] = r["v"]
    for name, shape in shapes(p, m.loadings.shape[1]).items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def improved(m: DynamicFactors, e: dict[str, np.ndarray], least: np.ndarray) -> None:
    """The parameters that maximise the expected likelihood, then in units in which shocks have unit covariance."""
    k = m.loadings.shape[1]
    for i in range(len(m.columns)):
        if e["n"][i]:
            m.loadings[i] = np.linalg.solve(e["seen"][i] + 1e-14 * np.trace(e["seen"][i]) * np.eye(k), e["with_x"][i])
            m.noise[i] = max((e["squares"][i] - m.loadings[i] @ e["with_x"][i]) / e["n"][i], least[i])
    m.start = e["start"] / max(e["panels"][0], 1)
    if e["steps"][0]:
        m.transition = np.linalg.solve(e["before"].T, e["lagged"].T).T
        shock = (e["now"] - m.transition @ e["lagged"].T) / e["steps"][0]
        shock = (shock + shock.T) / 2 + 1e-14 * np.trace(shock) * np.eye(k)
        turned(m, np.linalg.cholesky(shock))


def turned(m: DynamicFactors, by: np.ndarray) -> None:
    """The same model with factors g, where f = by g."""
    inverse = np.linalg.inv(by)
    m.loadings, m.transition, m.start = m.loadings @ by, inverse @ m.transition @ by, inverse @ m.start @ inverse.T


def canonical(m: DynamicFactors) -> None:
    """Factors by falling information, the largest loading of each positive: what a rotation leaves open is settled."""
    values, axes = np.linalg.eigh((m.loadings / m.noise[:, None]).T @ m.loadings)
    axes = axes[:, np.argsort(-values)]
    by_factor = m.loadings @ axes
    axes = axes * np.where(by_factor[np.abs(by_factor).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    turned(m, axes)


def fit(df: DataFrame, columns: list[str], k: int, ts: str, key: str | None = None, *, rounds: int = 100, tolerance: float = 1e-6, clip: float | None = 0.01) -> DynamicFactors:
    """Fit by expectation and maximisation, at most ``rounds``, until the likelihood rises by less than ``tolerance`` of itself.

    Columns are standardised (n) over all panels and clipped at their exact
    quantiles ``clip`` and 1 - ``clip``, unless these are equal or ``clip`` is None.
    Nulls, NaN and infinite values are missing. There are at most one fewer factors
    than columns (but one). Rows with a null time are left out; an empty table is an
    error. A panel is one group of a task, as its recursion has to be.
    """
    if k < 1:
        raise ValueError("at least one factor")
    k = max(1, min(k, len(columns) - 1))
    finite = df.select(*[F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    finite = finite.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in finite.columns])
    quantiles = [] if clip is None else [F.percentile(c, F.array(F.lit(clip), F.lit(1 - clip))).alias(f"q{i}") for i, c in enumerate(finite.columns)]
    row = finite.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(finite.columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(finite.columns)], *quantiles).first()
    if not row["n"]:
        raise ValueError("no rows to fit")
    each = range(len(columns))
    mean = np.array([row[f"m{i}"] or 0.0 for i in each])
    scale = np.array([row[f"s{i}"] or 1.0 for i in each])
    low, high = np.full(len(columns), -np.inf), np.full(len(columns), np.inf)
    for i in each if clip is not None else ():
        a, b = row[f"q{i}"] or (0.0, 0.0)
        if not np.isclose(a, b):
            low[i], high[i] = (a - mean[i]) / scale[i], (b - mean[i]) / scale[i]
    held = materialize(panels(df, columns, ts, key), "panels")
    # A start: principal axes of the columns, nothing clipped, missing ones at their mean.
    z = [(F.coalesce(F.col(f"c{i}"), F.lit(mean[i])) - float(mean[i])) / float(scale[i]) for i in each]
    products = finite.agg(*[F.avg(z[i] * z[j]).alias(f"{i}:{j}") for i in each for j in each if j >= i]).first()
    gram = np.array([[products[f"{min(i, j)}:{max(i, j)}"] for j in each] for i in each])
    values, axes = np.linalg.eigh(gram)
    loadings = axes[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 1e-6)) * 0.7
    variance = np.maximum(np.diag(gram), 1e-6)
    m = DynamicFactors(columns, mean, scale, low, high, loadings, np.eye(k) * 0.5, np.maximum(variance - (loadings**2).sum(1), 0.1 * variance), np.eye(k) / 0.75)
    least = LEAST_NOISE * variance
    for _ in range(rounds):
        e = expected(held, m)
        m.log_likelihood.append(float(e["likely"][0]))
        if len(m.log_likelihood) > 1 and m.log_likelihood[-1] - m.log_likelihood[-2] < tolerance * abs(m.log_likelihood[-2]):
            m.converged = True
            break
        improved(m, e, least)
    canonical(m)
    return m


@dataclass
class Nowcast:
    """Factors, and a ridge on them beside the columns themselves; its penalty was chosen on later rows."""

    factors: DynamicFactors
    head: ridge_head.Head

    def transform(self, df: DataFrame) -> DataFrame:
        return self.factors.project(df)


def nowcast(df: DataFrame, columns: list[str], y: str, k: int, ts: str, key: str | None = None, *, direct: bool = True, penalties: tuple[float, ...] = ridge_head.PENALTIES, **how) -> Nowcast:
    """Fit the factors of ``columns`` by likelihood, then the head for ``y`` on each row's projection and, if ``direct``, the columns too."""
    m = fit(df, columns, k, ts, key, **how)
    inputs = [f"factor_{i + 1}" for i in range(m.loadings.shape[1])]
    return Nowcast(m, ridge_head.chosen(m.project(df), [*inputs, *(columns if direct else [])], y, ts, penalties=penalties))
