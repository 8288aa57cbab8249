"""A ridge on standardised columns whose penalty is chosen on the last fifth of the rows.

One aggregate gathers the products of all columns for the earlier and the later rows
apart. The error that each penalty would make on the later rows follows from these two
matrices, and so does the final fit on all rows: nothing is fitted again on data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.models import Linear
from tidewater.operators.order import at_places

PENALTIES = (0.1, 1.0, 10.0, 100.0)
#: Rows below which the first penalty is taken, rows that are fitted at least, and rows to validate on at least.
LEAST_ROWS, LEAST_FITTED, LEAST_VALIDATED = 24, 5, 3


@dataclass
class Head(Linear):
    penalty: float = 0.0
    errors: dict[float, float] | None = None


def solved(products: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept from sums of products of (1, columns, y): the intercept is free."""
    n = products[0, 0]
    mean = products[0, 1:] / n
    centred = products[1:, 1:] - n * np.outer(mean, mean)
    weights = np.linalg.pinv(centred[:-1, :-1] + penalty * np.eye(len(centred) - 1)) @ centred[:-1, -1]
    return weights, float(mean[-1] - mean[:-1] @ weights)


def chosen(df: DataFrame, columns: list[str], y: str, order: str, *, penalties: tuple[float, ...] = PENALTIES, share: float = 0.8) -> Head:
    """The ridge with the least squared error on the rows after the first ``share`` of the order, refitted on all rows.

    Columns and target are standardised (n) over all rows; null columns count as
    their mean, rows with a null target or order are left out. Rows that share the
    order's value at the border are earlier rows. Under 24 rows, or with under 3 to
    validate on, the first penalty is taken. Ties go to the penalty given first.
    """
    if any(p < 0 for p in penalties):
        raise ValueError("penalties are 0 or more")
    rows = df.where(F.col(y).isNotNull() & F.col(order).isNotNull())
    k = len(columns)
    both = [*columns, y]
    first = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(both)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(both)]).first()
    n = first["n"]
    if not n:
        raise ValueError("no rows to fit")
    mean, scale = np.array([first[f"m{i}"] or 0.0 for i in range(k + 1)]), np.array([first[f"s{i}"] or 1.0 for i in range(k + 1)])
    border = max(LEAST_FITTED, int(n * share))
    split = len(penalties) > 1 and n >= LEAST_ROWS and n - border >= LEAST_VALIDATED
    if split:
        last = at_places(rows, order, [], F.array(F.lit(border - 1))).first()[order]
        rows = rows.withColumn("__later", F.col(order) > F.lit(last))
    z = [F.lit(1.0), *[(F.coalesce(F.col(c), F.lit(mean[i])) - float(mean[i])) / float(scale[i]) for i, c in enumerate(both)]]
    pairs = [(i, j) for i in range(k + 2) for j in range(i, k + 2)]
    parts = {r["later"]: r for r in rows.groupBy((F.col("__later") if split else F.lit(False)).alias("later")).agg(*[F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()}
    products = {}
    for later, r in parts.items():
        products[later] = np.zeros((k + 2, k + 2))
        for i, j in pairs:
            products[later][i, j] = products[later][j, i] = r[f"p{i}_{j}"]
    penalty, errors = penalties[0], {}
    if split and True in products:
        for p in penalties:
            w, b = solved(products[False], p)
            miss = np.concatenate([[-b], -w, [1.0]])
            errors[p] = float(miss @ products[True] @ miss / products[True][0, 0])
        penalty = min(penalties, key=lambda p: (errors[p], penalties.index(p)))
    w, b = solved(sum(products.values()), penalty)
    w = w * scale[-1] / scale[:-1]
    return Head(columns, float(mean[-1] + scale[-1] * b - w @ mean[:-1]), w.tolist(), penalty, errors)
