"""Coherence of hierarchies and minimum-trace reconciliation.

Error moments are Spark aggregates; the projection is a matrix as large as the
hierarchy, computed on the driver and applied as linear combinations of columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incoherence(df: DataFrame, total: str, parts: list[str]) -> Column:
    out = F.col(total)
    for p in parts:
        out = out - F.coalesce(F.col(p), F.lit(0.0))
    return out


def coherent(df: DataFrame, total: str, parts: list[str], tolerance: float = 1e-6) -> DataFrame:
    """One row: whether every row's total equals its parts, and the largest gap."""
    gap = F.abs(incoherence(df, total, parts))
    return df.agg(F.coalesce(F.bool_and(gap < tolerance), F.lit(True)).alias("coherent"), F.max(gap).alias("largest_gap"))


def summing_matrix(n: int) -> np.ndarray:
    """A total over n parts: the total first."""
    return np.vstack([np.ones(n), np.eye(n)])


def shrunk(errors: DataFrame, nodes: list[str]) -> tuple[np.ndarray, float]:
    """The covariance (n) of complete rows shrunk to the mean variance, and the weight of that, as Ledoit and Wolf estimate it.

    The weight needs the fourth moments only through the squared lengths of the
    centred rows, which are summed beside the products.
    """
    k = len(nodes)
    rows = errors.where(" and ".join(f"`{c}` is not null" for c in nodes))
    means = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(nodes)]).first()
    n = means["n"]
    if n < 2:
        raise ValueError("at least two complete rows")
    x = [F.col(c) - means[f"m{i}"] for i, c in enumerate(nodes)]
    length = sum((v * v for v in x[1:]), x[0] * x[0])
    row = rows.agg(F.sum(length * length).alias("fourth"), *[F.sum(x[i] * x[j]).alias(f"{i}:{j}") for i in range(k) for j in range(i, k)]).first()
    e = np.array([[row[f"{min(i, j)}:{max(i, j)}"] for j in range(k)] for i in range(k)]) / n
    mean = float(np.trace(e)) / k
    apart = float((e**2).sum()) - k * mean**2  # the squared distance from the target
    noise = (row["fourth"] / n - float((e**2).sum())) / n
    weight = 0.0 if min(noise, apart) <= 0 else min(noise, apart) / apart
    return (1 - weight) * e + weight * mean * np.eye(k), weight


def positive_definite(w: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """``w`` with eigenvalues of ``least`` at least."""
    values, vectors = np.linalg.eigh((w + w.T) / 2)
    out = (vectors * np.maximum(values, least)) @ vectors.T
    return (out + out.T) / 2


def covariance(errors: DataFrame, nodes: list[str], method: str = "mint_shrink") -> np.ndarray:
    """Of forecast errors: "ols" (identity), "wls" (variances), "mint_sample", or "mint_shrink" to the mean variance."""
    k = len(nodes)
    if method == "ols":
        return np.eye(k)
    if method == "mint_shrink":
        return positive_definite(shrunk(errors, nodes)[0])
    if method not in ("wls", "mint_sample"):
        raise ValueError(method)
    row = errors.agg(*[F.covar_samp(a, b).alias(f"{i}:{j}") for i, a in enumerate(nodes) for j, b in enumerate(nodes) if j >= i]).first()
    w = np.array([[row[f"{min(i, j)}:{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    variances = np.maximum(np.diag(w), 1e-8)
    if method == "wls":
        return np.diag(variances)
    np.fill_diagonal(w, variances)
    return positive_definite(w)


def check_weights(w: np.ndarray, kind: str = "auto", tolerance: float = 1e-6) -> tuple[bool, str]:
    """Whether a weight matrix can be used, and why not: square, positive diagonal, and if "full" symmetric and positive definite."""
    w = np.asarray(w, float)
    if kind not in ("auto", "diagonal", "full"):
        return False, f"unknown kind {kind}"
    if w.ndim != 2 or w.shape[0] != w.shape[1]:
        return False, f"not square: {w.shape}"
    if not (np.diag(w) > 0).all():
        return False, f"diagonal not positive at {np.flatnonzero(~(np.diag(w) > 0)).tolist()}"
    if kind == "diagonal" or kind == "auto" and np.allclose(w, np.diag(np.diag(w)), atol=tolerance):
        return True, "diagonal weights"
    if not np.allclose(w, w.T, atol=tolerance):
        return False, "not symmetric"
    least = float(np.linalg.eigvalsh(w).min())
    return (True, f"full weights, condition {np.linalg.cond(w):.3g}") if least > tolerance else (False, f"not positive definite: least eigenvalue {least:.3g}")


def precision(w: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """The inverse of a covariance, with ``ridge`` added to its diagonal; ValueError if that is singular."""
    try:
        return np.linalg.inv(np.asarray(w, float) + ridge * np.eye(len(w)))
    except np.linalg.LinAlgError as e:
        raise ValueError(f"the covariance is singular with a ridge of {ridge}") from e


def projection(w: np.ndarray) -> np.ndarray:
    """S (S' W^-1 S)^-1 S' W^-1 for a total and its parts: base forecasts in, coherent ones out.

    If that cannot be computed, the gap is split equally among the parts and the total stays.
    """
    n = len(w) - 1
    s = summing_matrix(n)
    try:
        inverse = precision(w)
        return s @ np.linalg.solve(s.T @ inverse @ s, s.T @ inverse)
    except (ValueError, np.linalg.LinAlgError):
        return s @ np.hstack([np.full((n, 1), 1 / n), np.eye(n) - 1 / n])


def reconcile(forecasts: DataFrame, errors: DataFrame | None, total: str, parts: list[str], method: str = "mint_shrink", weights: np.ndarray | None = None) -> DataFrame:
    """``forecasts`` with total and parts made coherent, by ``weights`` if given (of the total first; checked), else by a covariance of ``errors``."""
    nodes = [total, *parts]
    if weights is not None:
        fine, why = check_weights(weights)
        if not fine or len(weights) != len(nodes):
            raise ValueError(why if not fine else f"{len(weights)} weights for {len(nodes)} nodes")
    p = projection(covariance(errors, nodes, method) if weights is None else np.asarray(weights, float))

    def combined(row: np.ndarray) -> Column:
        out = F.lit(0.0)
        for c, x in zip(nodes, row, strict=True):
            out = out + F.col(c) * float(x)
        return out

    return forecasts.withColumns({c: combined(p[i]) for i, c in enumerate(nodes)})
