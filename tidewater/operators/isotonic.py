"""A rising fit by pooling of adjacent violators, without a task or driver that sees all values.

Equal values are summed first. They are dealt out by range and every task pools its
own. After that only pools move: tasks whose last pool lies above the next one's first
are joined, chains of them as one group, until no border violates the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.folders import materialize

POOL = "task int, low double, high double, weight double, total double"


def pooled(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
    """Adjacent pools merged until means rise from each to the next: strictly, so that equal ones are one."""
    out: list[list[float]] = []
    for pool in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist(), strict=True):
        a, b, w, t = pool
        while out and out[-1][3] * w >= t * out[-1][2]:
            a, _, w2, t2 = out.pop()
            w, t = w + w2, t + t2
        out.append([a, b, w, t])
    return [np.array(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 4


def pools(train: DataFrame, p: str, y: str, weight: str | None = None) -> DataFrame:
    """(low, high, weight, value): stretches of ``p`` and the mean of ``y`` on each, rising. Rows with a null or NaN, or a weight of 0, are left out."""
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    x, t = F.col(p).cast("double"), F.col(y).cast("double")
    rows = train.select(x.alias("low"), w.alias("weight"), (w * t).alias("total")).where("low = low and not isnan(low) and not isnan(total) and total is not null and weight > 0")
    sums = rows.groupBy("low").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), None
        for batch in batches:
            low, weight, total = (batch.column(c).to_numpy() for c in ("low", "weight", "total"))
            own = [low, low, weight, total] if held is None else [np.concatenate(v) for v in zip(held, (low, low, weight, total), strict=True)]
            held = pooled(*own)
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held[0]), task, np.int32)), *map(pa.array, held)], ["task", "low", "high", "weight", "total"])

    def again(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("low").to_numpy())
        out = pooled(*(table.column(c).to_numpy()[order] for c in ("low", "high", "weight", "total")))
        return pa.table({"task": pa.array(np.full(len(out[0]), table.column("task")[0].as_py(), np.int32)), **dict(zip(("low", "high", "weight", "total"), map(pa.array, out), strict=True))})

    now = materialize(sums.repartitionByRange("low").sortWithinPartitions("low").mapInArrow(first, POOL), "pools")
    while True:
        ends = now.groupBy("task").agg(F.min(F.struct("low", "weight", "total")).alias("a"), F.max(F.struct("low", "weight", "total")).alias("b")).collect()
        ends.sort(key=lambda r: r["a"]["low"])  # two pools a task
        group, at = {}, -1
        for i, r in enumerate(ends):
            before = ends[i - 1]["b"] if i else None
            if not i or before["total"] * r["a"]["weight"] < r["a"]["total"] * before["weight"]:
                at += 1
            group[r["task"]] = at
        if len(group) == at + 1:
            return now.select("low", "high", "weight", (F.col("total") / F.col("weight")).alias("value"))
        moved = F.broadcast(now.sparkSession.createDataFrame(list(group.items()), "task int, grp int"))
        sizes = {g: list(group.values()).count(g) for g in set(group.values())}
        joined = now.join(moved, "task").withColumn("task", F.col("grp"))
        alone = F.col("grp").isin([g for g, n in sizes.items() if n == 1])
        merged = joined.where(~alone).drop("grp").groupBy("task").applyInArrow(again, POOL)
        now = materialize(joined.where(alone).drop("grp").unionByName(merged), "pools")


def apply(df: DataFrame, found: DataFrame, p: str, into: str) -> DataFrame:
    """``df`` with the fitted value of ``p``: a pool's value on its stretch, in proportion between two, the nearest one's beyond the ends.

    The different values of ``p`` are sorted together with the ends of the pools and
    dealt out by range; what lies beyond a task's own ends comes from a table of one
    row a task. Null and NaN give null.
    """
    ends = found.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("x"), F.lit(0).alias("kind"), "value")
    asked = df.select(F.col(p).cast("double").alias("x")).where("x is not null and not isnan(x)").distinct().select("x", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("value"))
    both = materialize(ends.unionByName(asked).repartitionByRange("x", "kind").sortWithinPartitions("x", "kind").withColumn("task", F.spark_partition_id()), "ends")
    end = F.when(F.col("kind") == 0, F.struct("x", "value"))
    tasks = both.groupBy("task").agg(F.min("x").alias("at"), F.min(end).alias("first"), F.max(end).alias("last")).orderBy("at").collect()
    kind = "struct<x: double, value: double>"
    rows, before = [], None
    for r in tasks:
        rows.append([r["task"], before, None])
        before = r["last"] or before
    after = None
    for row, r in zip(reversed(rows), reversed(tasks), strict=True):
        row[2] = after
        after = r["first"] or after
    around = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in rows], f"task int, earlier {kind}, later {kind}"))
    w = Window.partitionBy("task").orderBy("x", "kind")
    low = F.coalesce(F.last(end, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("earlier"))
    high = F.coalesce(F.first(end, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("later"))
    placed = both.join(around, "task").select("x", "kind", low.alias("a"), high.alias("b")).where("kind = 1")
    between = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * F.coalesce(F.try_divide(F.col("x") - F.col("a.x"), F.col("b.x") - F.col("a.x")), F.lit(0.0))
    fitted = placed.select(F.col("x").alias("__x"), F.when(F.col("a").isNull(), F.col("b.value")).when(F.col("b").isNull() | (F.col("a.x") == F.col("x")), F.col("a.value")).otherwise(between).alias("__fitted"))
    out = df.drop(into) if into in df.columns and into != p else df
    return out.join(fitted, out[p].cast("double") == fitted["__x"], "left").withColumn(into, F.col("__fitted")).drop("__x", "__fitted")
