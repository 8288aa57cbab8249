"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors of cosine s or more lie within eps = sqrt(2 - 2 s) of each other, and
no further apart on any projection. Vectors are projected to leading principal
directions and sorted by label and grid cell of width eps, direction by
direction. Runs of the sorted sequence are blocks with bounding boxes. Blocks meet
through an equi-join on the cells they reach, if their boxes are within eps. A
task joins two blocks by halving the longer interval again and again, leaving
out what the boxes prove to be too far, and compares short intervals exactly.

The directions come from a bounded sample; any orthonormal directions give the
same links, good ones give fewer comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import components, local_forest
from tidewater.llm.storage import materialize

#: Vectors, at most, that the principal directions are computed from.
SAMPLE = 4_000
#: Intervals of at most so many vectors are compared outright.
LEAF = 64


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def kinds_of(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow, no underflow to 0
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(classes: DataFrame, vector: str, size: int) -> dict[int, np.ndarray]:
    """Leading principal directions of unit vectors, for each length of vector in the sample."""
    n = classes.count()
    some = classes if n <= SAMPLE else classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    got: dict[int, list] = {}
    for r in some.select(vector).limit(2 * SAMPLE).collect():
        got.setdefault(len(r[0]), []).append(r[0])
    out = {}
    for d, rows in got.items():
        x = _unit(np.array(rows, np.float64))
        _, axes = np.linalg.eigh(x.T @ x)
        out[d] = axes[:, ::-1][:, :size].copy()
    return out


def _boxes_apart(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether the bounding boxes of two sets of points are more than eps apart."""
    gap = np.maximum(0, np.maximum(b.min(0) - a.max(0), a.min(0) - b.max(0)))
    return float(gap @ gap) > eps * eps


def interval_join(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, similarity: float, eps: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of x and y with a cosine of at least ``similarity``; i < j if both are the same block."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    open_pairs = [(0, len(x), 0, len(y))]
    while open_pairs:
        a, b, c, d = open_pairs.pop()
        if (same and a >= d) or _boxes_apart(px[a:b], py[c:d], eps):
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= similarity)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            found.append((i, j))
        elif b - a >= d - c:
            m = (a + b) // 2
            open_pairs += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            open_pairs += [(a, b, c, m), (a, b, m, d)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def blocks(classes: DataFrame, axes: dict[int, np.ndarray], *, vector: str, eps: float, size: int, block: int) -> DataFrame:
    """(label, d, block, reps, copies, vectors, lo, hi): runs of the epsilon grid order."""
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("d").to_numpy()
            points = np.zeros((len(length), size))
            for d in np.unique(length):
                own = np.flatnonzero(length == d)
                axis = shared.value.get(int(d), np.eye(int(d))[:, :size])
                points[own, : axis.shape[1]] = _unit(_matrix(batch.column(vector).take(pa.array(own)))) @ axis
            cells = np.floor(points / eps).astype(np.int32)
            offsets = pa.array(np.arange(len(points) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(points.ravel())), pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))], [*batch.schema.names, "point", "cell"])

    kinds = dict(classes.dtypes)
    placed = classes.mapInArrow(project, ", ".join(f"`{c}` {kinds[c]}" for c in classes.columns) + ", point array<double>, cell array<int>")
    placed = materialize(placed, "grid")
    ordered = placed.repartitionByRange("label", "d", "cell", "rep").sortWithinPartitions("label", "d", "cell", "rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            label, length = batch.column("label").to_pylist(), batch.column("d").to_numpy()
            at = 0
            while at < len(label):
                to = at
                while to < len(label) and to - at < block and label[to] == label[at] and length[to] == length[at]:
                    to += 1
                own = batch.slice(at, to - at)
                points = _matrix(own.column("point"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label[at]], batch.schema.field("label").type), pa.array([int(length[at])], pa.int32()), pa.array([number], pa.int64())]
                    + [pa.array([own.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("rep", "copies")]
                    + [pa.array([own.column(vector).flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([points.min(0).tolist()], pa.list_(pa.float64())), pa.array([points.max(0).tolist()], pa.list_(pa.float64()))],
                    ["label", "d", "block", "reps", "copies", "vectors", "lo", "hi"],
                )
                number += 1
                at = to

    return ordered.mapInArrow(cut, f"label {kinds['label']}, d int, block long, reps binary, copies binary, vectors binary, lo array<double>, hi array<double>")


def block_pairs(cut: DataFrame, eps: float, size: int, keyed: int = 2) -> DataFrame:
    """(a, b): blocks of one label whose boxes are within eps, each pair once, a <= b. They meet on cells of the first directions."""
    meta = cut.select("label", "d", "block", "lo", "hi")
    reach, wide = meta, meta
    for k in range(keyed):
        low, high = F.col("lo")[k], F.col("hi")[k]
        reach = reach.withColumn(f"c{k}", F.explode(F.sequence(F.floor(low / eps), F.floor(high / eps))))
        wide = wide.withColumn(f"c{k}", F.explode(F.sequence(F.floor((low - eps) / eps - 1e-9), F.floor((high + eps) / eps + 1e-9))))
    keys = ["label", "d", *(f"c{k}" for k in range(keyed))]
    met = reach.withColumnsRenamed({"block": "x", "lo": "xlo", "hi": "xhi"}).join(wide.withColumnsRenamed({"block": "y", "lo": "ylo", "hi": "yhi"}), keys)
    gaps = [F.greatest(F.lit(0.0), F.col("ylo")[k] - F.col("xhi")[k], F.col("xlo")[k] - F.col("yhi")[k]) for k in range(size)]
    near = met.where(reduce(lambda a, b: a + b, [g * g for g in gaps]) <= eps * eps * (1 + 1e-9))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(rows: DataFrame, *, similarity: float, key: str = "vec_id", vector: str = "embedding", label: str = "label", size: int = 6, block: int = 2_048) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``rows``.

    Rows with equal labels and a cosine of at least ``similarity`` (double
    precision) are linked. A null label or key, and a vector that is null, empty,
    all zero, or has a null or non-finite component, links with nothing; vectors
    of different lengths do not link. Equal vectors are compared once, and each
    row of theirs counts as a vector of its own. A row without a link is its own
    component; with a null key the component is null and the row is kept. An empty
    table gives no rows; other columns are not read.
    """
    eps = float(np.sqrt(2 - 2 * similarity)) + 1e-9
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    value = F.col("v")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size(value) > 0, F.lit(False))
    fine = fine & F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False))
    # A negative zero equals a zero; adding zero makes the arrays equal too.
    own = own.withColumn("v", F.when(fine, F.transform(value, lambda x: x + F.lit(0).cast("float")))).withColumn("label", F.when(fine, F.col("label")))
    own = materialize(own, "vectors")
    classes = own.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("d", F.size("v"))
    classes = materialize(classes, "classes")
    axes = directions(classes, "v", size)
    cut = materialize(blocks(classes, axes, vector="v", eps=eps, size=size, block=block), "blocks")
    pairs = block_pairs(cut, eps, size)
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")).join(cut.select("block", "d", "reps", "copies", "vectors"), "block")
    number = np.float32 if kinds_of(classes, "v") == "array<float>" else np.float64
    shared = rows.sparkSession.sparkContext.broadcast(axes)  # one matrix for each length of vector

    def compare(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        held = {}
        for r in table.to_pylist():
            reps = np.frombuffer(r["reps"], np.int64)
            x = _unit(np.frombuffer(r["vectors"], number).astype(np.float64).reshape(len(reps), -1))
            held[r["block"]] = reps, np.frombuffer(r["copies"], np.int64), x, x @ shared.value.get(r["d"], np.eye(r["d"])[:, :size])
        (ra, ca, xa, pa_), (rb, cb, xb, pb) = held[a], held[b]
        i, j = interval_join(xa, xb, pa_, pb, similarity, eps, a == b)
        ids = np.concatenate([ra, rb]) if a != b else ra
        at = j + len(ra) if a != b else j
        n = np.bincount(i, cb[j], len(ids)) + np.bincount(at, ca[i], len(ids))
        node, root = local_forest(i, at, len(ids)) if len(i) else (i, i)
        some = np.flatnonzero(n)
        return pa.table({"a": pa.array(np.concatenate([ids[some], ids[node]])), "b": pa.array(np.concatenate([np.full(len(some), -1), ids[root]])), "n": pa.array(np.concatenate([n[some].astype(np.int64), np.zeros(len(node), np.int64)]))})

    found = materialize(sides.groupBy("a", "b").applyInArrow(compare, "a long, b long, n long"), "found")
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(found.where("n = 0")).select(F.col("node").alias("rep"), "component")
    classes = classes.join(counts, "rep", "left").join(joined, "rep", "left").select("label", "v", F.coalesce("n", F.lit(0)).alias("n"), "copies", F.coalesce("component", "rep").alias("component"))
    out = own.join(classes, ["label", "v"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
