"""Places in the order of a whole table, and exact quantiles, without a task that holds a series.

Equal values are counted first, so a value that a third of all rows have is one row.
The different ones are dealt out by range, every task adds up its own counts, and the
tasks' totals, one number each, say how many rows lie before a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.folders import materialize, small


def placed(df: DataFrame, order: list[str], n: str = "n") -> DataFrame:
    """(order, n, before) of the different values of ``order``: their rows and the rows that come before them."""
    counts = df.groupBy(*order).agg(F.count("*").alias(n))
    kinds = dict(counts.dtypes)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            if len(batch):
                running = pc.add(pc.cumulative_sum(batch.column(n)), total)
                total = running[-1].as_py()
                yield pa.RecordBatch.from_arrays([*batch.columns, pc.subtract(running, batch.column(n)), pa.array([task] * len(batch), pa.int32())], [*order, n, "before", "task"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in order), f"`{n}` long", "before long", "task int"])
    own = materialize(counts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sums, schema), "places")
    tasks, earlier, add = sorted((r["task"], r["rows"]) for r in own.groupBy("task").agg(F.sum(n).alias("rows")).collect()), 0, {}
    for task, rows in tasks:  # as many as there are tasks
        add[task], earlier = earlier, earlier + rows
    offsets = df.sparkSession.createDataFrame(list(add.items()) or [(0, 0)], "task int, earlier long")
    return own.join(F.broadcast(offsets), "task").select(*order, n, (F.col("before") + F.col("earlier")).alias("before"))


def at_places(df: DataFrame, value: str, by: list[str], places: Column, within: str = "n") -> DataFrame:
    """(by, value, n, place, at) of the rows that hold the wanted places of their series.

    ``places`` is an array of places from 0 in the order of ``value``, made from the
    series' number of rows, the column ``within``. Nulls are no rows.
    """
    rows = placed(df.where(F.col(value).isNotNull()).select(*by, value), [*by, value], "__n")
    keys = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    ends = rows.groupBy(*by).agg(F.sum("__n").alias(within), F.min("before").alias("__first"))
    ends = ends.select(*[F.col(c).alias(f"__{c}") for c in by], within, "__first", places.alias("__places"))
    joined = rows.join(small(ends), keys) if by else rows.join(F.broadcast(ends))  # one row
    own = F.col("before") - F.col("__first")
    found = F.filter(F.transform("__places", lambda p: p.cast("long")), lambda p: (p >= own) & (p < own + F.col("__n")))
    return joined.select(*by, value, within, "__places", F.explode(found).alias("place"))


def quantiles(df: DataFrame, value: str, share: Column | float | list[float], by: list[str] | None = None, into: str = "quantile") -> DataFrame:
    """(by, n, into): the exact quantile at ``share`` of each series, between its two neighbours in proportion.

    ``share`` is a number, a list of numbers (``into`` is then an array), or an
    expression of the series' number of rows ``n``. A series without values has no row;
    without ``by`` there is one row, with nulls if there are no values.
    """
    by, many = by or [], isinstance(share, list)
    shares = [F.lit(float(s)) for s in share] if many else [share if isinstance(share, Column) else F.lit(float(share))]
    exact = [(F.col("n") - 1) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) for s in shares]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(e), F.least(F.floor(e) + 1, F.col("n") - 1)).cast("array<long>") for e in exact])))
    found = at_places(df, value, by, wanted).groupBy(*by).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("place", value))).alias("__at"))

    def between(e: Column) -> Column:
        low, high = F.floor(e), F.least(F.floor(e) + 1, F.col("n") - 1)
        a, b = F.col("__at")[low.cast("long")].cast("double"), F.col("__at")[high.cast("long")].cast("double")
        return a + (b - a) * (e - low)

    out = [between(e) for e in exact]
    return found.select(*by, "n", (F.array(*out) if many else out[0]).alias(into))
