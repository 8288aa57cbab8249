"""Quantiles of residuals under weights that fall with the distance of forecasts, to any size.

Residuals are cut into chunks by their order, forecasts into blocks by their value.
The weight exp(-distance) of rows beyond a block's end is one sum an end and chunk, so
a forecast meets, row by row, only the rows of its block, which tells the chunk in
which its quantile lies, and then those of that chunk. Equal forecasts are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.folders import materialize
from tidewater.operators import order

#: Different forecasts of a block; blocks at most, whose sums by chunk the driver adds up; parts of a chunk's forecasts.
BLOCK, MOST_BLOCKS, SALTS = 4_000, 1_024, 16


def quantiles(rows: DataFrame, forecasts: DataFrame, share: float, gamma: float, chunks: int = 256, block: int = BLOCK) -> tuple[DataFrame, float | None]:
    """(f, r) of different forecasts ``f``, and the largest residual of all.

    ``r`` is the residual, of ``rows`` (r, p) in order of both, at which the running
    weight reaches ``share`` of all weight plus 1e-10; the largest one if none does. A
    row weighs exp(-|p - f| / (gamma * deviation of p)), or 1 if that deviation is 0.
    """
    own = order.placed(rows, ["r", "p"])
    total, last = own.agg(F.sum("n"), F.max("r")).first()
    if not total:
        return forecasts.select("f", F.lit(None).cast("double").alias("r")), None
    scale = gamma * rows.agg(F.stddev_pop("p")).first()[0]
    rate, size = 1 / scale if scale else 0.0, -(-total // chunks)
    different = own.select("p").union(forecasts.select("f")).distinct()
    blocks = min(MOST_BLOCKS, max(1, different.count() // block))
    edges = sorted(set(different.agg(F.percentile_approx("p", [k / blocks for k in range(1, blocks)])).first()[0])) if blocks > 1 else []
    ends = F.array(*map(F.lit, edges)).cast("array<double>")
    block_of = lambda c: F.size(F.filter(ends, lambda e: e < F.col(c)))  # noqa: E731  a block ends with its edge
    own = own.withColumns({"chunk": F.floor(F.col("before") / size).cast("int"), "block": block_of("p")})
    fade = lambda d: F.coalesce(F.sum(F.col("n") * F.exp(-d * rate)), F.lit(0.0))
    sums = own.groupBy("block", "chunk").agg(fade(F.get(ends, F.col("block")) - F.col("p")).alias("up"), fade(F.col("p") - F.get(ends, F.col("block") - 1)).alias("down")).collect()  # blocks times chunks at most
    up, down = np.zeros((2, len(edges) + 1, chunks))
    for s in sums:
        up[s["block"], s["chunk"]], down[s["block"], s["chunk"]] = s["up"], s["down"]
    below, above = np.zeros((2, len(edges) + 1, chunks))  # seen from the block's lower and upper end
    for b in range(1, len(edges) + 1):
        below[b] = up[b - 1] + (below[b - 1] * np.exp((edges[b - 2] - edges[b - 1]) * rate) if b > 1 else 0)
    for b in range(len(edges) - 1, -1, -1):
        above[b] = down[b + 1] + (above[b + 1] * np.exp((edges[b] - edges[b + 1]) * rate) if b + 1 < len(edges) else 0)
    beyond = rows.sparkSession.sparkContext.broadcast((below, above))

    def chunk_of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The chunk of each forecast of a block, the weight before it and the weight to reach; chunk -1 if it isn't reached."""
        b, f = key[0].as_py(), left.column("f").to_numpy()
        p, at, n = (right.column(c).to_numpy() for c in ("p", "chunk", "n"))
        found = [[], [], []]
        for a in range(0, len(f), 1024):
            x = f[a : a + 1024]
            w = np.zeros((len(x), chunks))
            if b > 0:
                w += np.exp((edges[b - 1] - x) * rate)[:, None] * beyond.value[0][b]
            if b < len(edges):
                w += np.exp((x - edges[b]) * rate)[:, None] * beyond.value[1][b]
            for i in range(0, len(p), 4096):
                q = p[i : i + 4096]
                counts = np.zeros((len(q), chunks))
                counts[np.arange(len(q)), at[i : i + 4096]] = n[i : i + 4096]
                w += np.exp(-np.abs(x[:, None] - q) * rate) @ counts
            running = w.cumsum(1)
            want = share * (running[:, -1] + 1e-10)
            reached = running >= want[:, None]
            chunk = np.where(reached.any(1), reached.argmax(1), -1)
            for out, v in zip(found, (chunk, np.where(chunk > 0, running[np.arange(len(x)), chunk - 1], 0.0), want), strict=True):
                out.append(v)
        chunk, before, want = (np.concatenate(v) if v else np.zeros(0) for v in found)
        return pa.table({"f": f, "chunk": pa.array(chunk.astype(np.int32)), "before": before.astype(float), "want": want.astype(float)})

    def row_of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The residual of each forecast among the rows of its chunk."""
        f, before, want = (left.column(c).to_numpy() for c in ("f", "before", "want"))
        r, p, n = (right.sort_by([("r", "ascending"), ("p", "ascending")]).column(c).to_numpy() for c in ("r", "p", "n"))
        found, step = [np.zeros(0)], max(1, 2_000_000 // max(1, len(r)))
        for a in range(0, len(f), step):
            x = f[a : a + step, None]
            reached = before[a : a + step, None] + (n * np.exp(-np.abs(x - p) * rate)).cumsum(1) >= want[a : a + step, None]
            found.append(r[np.where(reached.any(1), reached.argmax(1), len(r) - 1)])
        return pa.table({"f": f, "r": np.concatenate(found)})

    counts = own.groupBy("block", "p", "chunk").agg(F.sum("n").alias("n"))
    asked = forecasts.select("f", block_of("f").alias("block"))
    placed = materialize(asked.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(chunk_of, "f double, chunk int, before double, want double"), "chunks")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("f"), F.lit(SALTS)).cast("int"))
    reached = placed.where("chunk >= 0")
    wanted = reached.select(F.col("chunk").alias("at"), F.col("salt").alias("copy")).distinct()  # SALTS a chunk at most
    copies = own.select("r", "p", "n", "chunk").join(F.broadcast(wanted), F.col("chunk") == F.col("at")).select("r", "p", "n", "at", "copy")
    inner = reached.groupBy("chunk", "salt").cogroup(copies.groupBy("at", "copy")).applyInArrow(row_of, "f double, r double")
    return inner.union(placed.where("chunk < 0").select("f", F.lit(float(last)).alias("r"))), float(last)
