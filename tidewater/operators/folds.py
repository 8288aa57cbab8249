"""Cross-validation over expanding folds in one job: a fold is a key, and its training moments are running sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.folders import materialize


def cross_validate_linear(df: DataFrame, key: str, order: str, columns: list[str], y: str, scores: dict[str, Column], *, initial: int, step: int, horizon: int, gap: int = 0, penalty: float = 0.0) -> DataFrame:
    """(fold, key, scores) of a linear fit (with intercept; of no columns, the mean) for each series and expanding fold.

    Fold k trains on the first ``initial`` + k * ``step`` rows of a series and is tested
    on ``horizon`` rows after ``gap`` more. Products of the columns are summed once for
    each stretch of rows between two folds; a fold's sums are those of all stretches
    before it. ``scores`` are aggregates over test rows that have a column ``f``, the
    forecast. Rows with a null column or target teach nothing and are not forecast or
    scored; they keep their place. Series too short for a fold have no row.
    """
    names = [*columns, y]
    k = len(columns) + 1
    own = Window.partitionBy(key)
    rows = df.select(key, order, *names).withColumn("__at", F.row_number().over(own.orderBy(order)) - 1).withColumn("__n", F.count("*").over(own))
    rows = rows.withColumn("__last", F.floor((F.col("__n") - gap - horizon - initial) / step)).where("__last >= 0").withColumn("__whole", F.lit(True) if not names else F.expr(" and ".join(f"`{c}` is not null" for c in names)))
    rows = materialize(rows, "folds")
    stretch = F.when(F.col("__at") < initial, 0).otherwise(F.floor((F.col("__at") - initial) / step) + 1).cast("int")
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    each = rows.groupBy(key, stretch.alias("fold")).agg(F.max("__last").alias("last"), *[F.coalesce(F.sum(F.when(F.col("__whole"), z[i] * z[j])), F.lit(0.0)).alias(f"p{i}_{j}") for i, j in pairs])
    running = Window.partitionBy(key).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    sums = each.where("fold <= last").select(key, "fold", F.array(*[F.sum(f"p{i}_{j}").over(running) for i, j in pairs]).alias("sums"))

    @F.pandas_udf("array<double>")
    def solved(of: pd.Series) -> pd.Series:
        out = []
        for flat in of:
            m = np.zeros((k + 1, k + 1))
            for (i, j), v in zip(pairs, flat, strict=True):
                m[i, j] = m[j, i] = v
            if m[0, 0] == 0:
                out.append(None)
                continue
            mean = m[0, 1:] / m[0, 0]
            c = m[1:, 1:] - m[0, 0] * np.outer(mean, mean)
            w = np.linalg.pinv(c[:-1, :-1] + penalty * np.eye(k - 1), hermitian=True) @ c[:-1, -1] if k > 1 else np.zeros(0)
            out.append([float(mean[-1] - mean[:-1] @ w), *w.tolist()])
        return pd.Series(out)

    fitted = sums.select(key, "fold", solved("sums").alias("__b"))
    low = F.greatest(F.lit(0), F.ceil((F.col("__at") - gap - horizon + 1 - initial) / step))
    high = F.least(F.col("__last"), F.floor((F.col("__at") - gap - initial) / step))
    tested = rows.where("__whole").where(low <= high).withColumn("fold", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    forecast = F.col("__b")[0]
    for i, c in enumerate(columns):
        forecast = forecast + F.col("__b")[i + 1] * F.col(c)
    return tested.join(fitted, [key, "fold"]).where(F.col("__b").isNotNull()).withColumn("f", forecast).groupBy("fold", key).agg(*[v.alias(c) for c, v in scores.items()])
