"""Lag models with weights on a softmax of a polynomial, fitted by Gauss-Newton on moments.

The prediction is linear in the columns, with coefficients that are a nonlinear
function of few parameters. So the squared error, its gradient and its Gauss-Newton
matrix all follow from one matrix of products of the columns, which Spark gathers once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.models import Linear, moments


@dataclass
class LagModel(Linear):
    lag_weights: dict[str, list[float]] | None = None
    slopes: dict[str, list[float]] | None = None
    loss: float = 0.0
    rounds: int = 0


def softmax_weights(n: int, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of n lags by exp(theta_1 u + theta_2 u**2 + ...), u = lag / n, that sum to 1, and their derivatives (n, degree)."""
    powers = (np.arange(n) / n)[:, None] ** np.arange(1, len(theta) + 1)
    score = powers @ theta
    w = np.exp(score - score.max(initial=0.0))
    w /= w.sum() if n else 1.0
    return w, w[:, None] * (powers - w @ powers)


def nonlinear_midas(df: DataFrame, groups: dict[str, list[str]], y: str, *, degree: int = 2, slopes: str = "source", rounds: int = 200, tolerance: float = 1e-13) -> LagModel:
    """Least squares over sources -> their lag columns, newest first.

    ``slopes`` "source": one slope a source on weights that sum to 1. "lag": a slope
    for every lag beside the weights of its source, which fits as closely as free
    coefficients do. Columns are scaled to unit spread for the search. Rows with a
    null are left out; constant columns have no weight in effect. A constant of the
    polynomial cancels in the softmax and is left out; degree 0 are equal weights.
    """
    if slopes not in ("source", "lag") or degree < 0:
        raise ValueError("slopes are by source or by lag, the degree is 0 or more")
    columns = [c for g in groups.values() for c in g]
    n, mean, g, my, b = moments(df, columns, y)
    if not n:
        raise ValueError("no complete rows to fit")
    whole = df.where(" and ".join(f"`{c}` is not null" for c in [*columns, y])).agg(F.var_pop(y).alias("v")).first()["v"] * n
    # One scale a source, so that its slopes and weights keep their meaning.
    sizes = [len(c) for c in groups.values()]
    ends = np.cumsum([0, *sizes])
    scale = np.concatenate([np.full(s, np.sqrt(max(np.diag(g)[a : a + s].mean() / n, 0)) or 1.0) for s, a in zip(sizes, ends, strict=False)])
    target = np.sqrt(whole / n) or 1.0
    g, b, total = g / np.outer(scale, scale) / n, b / scale / target / n, whole / n / target**2
    per = [1 if slopes == "source" else s for s in sizes]

    def laid_out(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of all columns, and their derivatives by all parameters."""
        a, jacobian, at = np.zeros(len(columns)), np.zeros((len(columns), len(x))), 0
        for i, s in enumerate(sizes):
            own = slice(ends[i], ends[i + 1])
            beta, theta = x[at : at + per[i]], x[at + per[i] : at + per[i] + degree]
            w, slope = softmax_weights(s, theta)
            a[own] = beta * w
            jacobian[own, at : at + per[i]] = w[:, None] if per[i] == 1 else np.diag(w)
            jacobian[own, at + per[i] : at + per[i] + degree] = (beta if per[i] > 1 else np.full(s, beta[0]))[:, None] * slope
            at += per[i] + degree
        return a, jacobian

    def loss(a: np.ndarray) -> float:
        return float(total - 2 * a @ b + a @ g @ a)

    x = np.concatenate([np.r_[np.full(p, 0.1), np.zeros(degree)] for p in per]) if per else np.zeros(0)
    if slopes == "source":  # slopes that are best for equal weights
        mix = np.zeros((len(columns), len(sizes)))
        for i, s in enumerate(sizes):
            mix[ends[i] : ends[i + 1], i] = 1 / s
        best = np.linalg.lstsq(mix.T @ g @ mix, mix.T @ b, rcond=None)[0]
        at = 0
        for i in range(len(sizes)):
            x[at], at = best[i], at + 1 + degree
    a, jacobian = laid_out(x)
    now, damp, done = loss(a), 1e-3, 0
    for done in range(1, rounds + 1):
        gauss, down = jacobian.T @ g @ jacobian, jacobian.T @ (b - g @ a)
        step = np.linalg.lstsq(gauss + damp * np.diag(np.maximum(np.diag(gauss), 1e-12)), down, rcond=None)[0]
        further, its = laid_out(x + step)
        after = loss(further)
        if after <= now:
            gained = now - after
            x, a, jacobian, now, damp = x + step, further, its, after, max(damp / 5, 1e-15)
            if gained <= tolerance * total and np.abs(down).max(initial=0.0) < 1e-9:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    real = a * target / scale
    weights, betas, at = {}, {}, 0
    for i, (name, s) in enumerate(zip(groups, sizes, strict=True)):
        w = softmax_weights(s, x[at + per[i] : at + per[i] + degree])[0]
        weights[name] = w.tolist()
        betas[name] = (x[at : at + per[i]] * target / scale[ends[i] : ends[i] + per[i]]).tolist()
        at += per[i] + degree
    return LagModel(columns, my - float(mean @ real), real.tolist(), weights, betas, max(now, 0.0) * n * target**2, done)
