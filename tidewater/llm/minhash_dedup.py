"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each document's set of word shingles is hashed once; the k smallest hashes
   are its sketch. Documents with equal sets form a class; from here on one
   document, the smallest id, stands for its class.
2. Retained values are counted. A value in one class only links nothing. Of a
   sketch, the rarest ``k - need + 1`` values go into inverted lists, rarity
   being (count, value), one order for all. Two sketches that share ``need``
   values must then meet in a list, so a value that a common passage puts into
   very many sketches makes no list as long as rarer ones do the work.
3. Each list links its members to its smallest one. The components of these
   links hold every pair that can qualify. A component is cut by set size (a
   pair that qualifies is in the same class of sizes or the next) and into
   blocks of bounded size; pairs of blocks are the tasks.
4. A task holds two blocks of full sets. The union sketch of a pair (the k
   smallest of both sketches) estimates its similarity; pairs below the bound
   are skipped, the rest is confirmed on the full sets, most similar first. A
   pair that confirmed pairs already join needs no look: components are what
   is returned. A task returns at most one link a document.

``need`` values of k are shared, for a similarity at the threshold, but for a
probability of about 4e-10 (k = 64, threshold 0.85); sets of at most k shingles
are held whole in their sketch and are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import text as T
from tidewater.llm.components import components, local_forest
from tidewater.llm.storage import materialize

#: Added to shingle hashes for the second half of a set's hash.
SECOND = 0x5851F42D4C957F2D


def _sets(table: pa.Table, text: str, shingle: int, fold: bool) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data, offsets = T.raw(table.column(text))
    words = T.words(data, offsets)
    h = words.hashes(fold)
    rolled = T.rolled(h, shingle)
    out = []
    for i in range(len(table)):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= shingle:
            out.append(np.unique(rolled[a : b - shingle + 1]))
        elif b > a:  # fewer words than a shingle has: the whole sequence is the one shingle
            out.append(T.mix(T.rolled(h[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _ragged(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(T.signed(np.concatenate(rows) if rows else np.zeros(0, np.uint64)), kind))


def _hashed(sets: list[np.ndarray], plus: int = 0) -> np.ndarray:
    return np.array([np.add.reduce(T.mix(s + np.uint64(plus))) for s in sets], np.uint64)


def sketches(docs: DataFrame, *, text: str, key: str, shingle: int, k: int, fold: bool) -> DataFrame:
    """(doc, n, k1, k2, sketch) for every row; k1 and k2 are a 128-bit hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.small_batches(batch, text):
                sets = _sets(part, text, shingle, fold)
                one, two = _hashed(sets), _hashed(sets, SECOND)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array(T.signed(one)), pa.array(T.signed(two)), _ragged([s[:k] for s in sets], pa.int64())],
                    ["doc", "n", "k1", "k2", "sketch"],
                )

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "doc long, n long, k1 long, k2 long, sketch array<long>")


def needed(threshold: float, k: int, miss: float = 1e-9) -> int:
    """The most values that two sketches of k share but for a probability ``miss``, at the threshold."""
    total = 0.0
    for x in range(k + 1):
        total += math.comb(k, x) * threshold**x * (1 - threshold) ** (k - x)
        if total > miss:
            return max(1, x)
    return k


def _linked(rows: list[np.ndarray], ids: np.ndarray, left: np.ndarray, right: np.ndarray, k: int, need: int, percent: int):
    """Of one pair of blocks: the confirmed links as a star (node, root)."""
    n = len(rows)
    size = np.array([len(r) for r in rows])
    kept = [r[:k] for r in rows]
    who = np.repeat(np.arange(n), [len(r) for r in kept])
    values, code = np.unique(np.concatenate(kept), return_inverse=True)
    held = np.zeros((n, len(values)), np.float32)
    held[who, code] = 1
    shared = held[left] @ held[right].T
    small = np.minimum(size[left][:, None], size[right][None, :])
    large = np.maximum(size[left][:, None], size[right][None, :])
    least = np.minimum(need, np.ceil(small * percent / 100))
    i, j = np.nonzero((shared >= least) & (100 * small >= percent * large))
    order = np.argsort(-shared[i, j], kind="stable")
    i, j = left[i][order], right[j][order]
    once = i != j if left is not right else i < j
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(i[once].tolist(), j[once].tolist(), strict=True):
        a, b = root(x), root(y)
        if a == b:
            continue
        if min(size[x], size[y]) > k:  # union sketch: of the k smallest of both, those in both
            union = np.union1d(kept[x], kept[y])[:k]
            both = np.intersect1d(kept[x], kept[y], assume_unique=True)
            if np.count_nonzero(both <= union[-1]) < need:
                continue
        common = len(np.intersect1d(rows[x], rows[y], assume_unique=True))
        if 100 * common >= percent * (size[x] + size[y] - common):
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(x) for x in range(n)])
    node = np.flatnonzero(roots != np.arange(n))
    return ids[node], ids[roots[node]]


def links(docs: DataFrame, reps: DataFrame, *, text: str, key: str, shingle: int, k: int, fold: bool, percent: int, block: int) -> DataFrame:
    """(a, b): links between classes whose components are those of all links."""
    threshold = percent / 100
    need = needed(threshold, k)
    values = reps.select("rep", "n", F.explode("sketch").alias("v"))
    counts = values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    shared = values.join(counts, "v")
    by_doc = Window.partitionBy("rep")
    held = F.least(F.col("n"), F.lit(k))
    # Sets that may meet a larger one, not held whole, also go by the bound for k values.
    must = F.when(F.col("n") <= math.floor(k * threshold), F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(need))
    prefix = (
        shared.withColumn("at", F.row_number().over(by_doc.orderBy("c", "v")))
        .withColumn("with", F.count("*").over(by_doc))
        .where(F.col("at") + held - F.col("with") <= held - F.least(must, held) + 1)
        .select("rep", "v")
    )
    prefix = materialize(prefix, "lists")
    heads = prefix.groupBy("v").agg(F.min("rep").alias("head"), F.count("*").alias("c")).where("c > 1").drop("c")
    near = components(prefix.join(heads, "v").select(F.col("rep").alias("a"), F.col("head").alias("b")))

    # Blocks: by component and class of sizes; a size class reaches a factor of 1 / threshold.
    cells = near.join(reps.select(F.col("rep").alias("node"), "doc", "k1", "n"), "node").select(
        F.col("node").alias("rep"), "doc", "k1", F.col("component").alias("c"), F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int").alias("s")
    )
    cells = materialize(cells, "cells")
    counts = cells.groupBy("c", "s").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    around = counts.select("c", "s", "blocks").join(counts.select("c", (F.col("s") - 1).alias("s"), F.col("blocks").alias("above")), ["c", "s"], "left").join(counts.select("c", (F.col("s") + 1).alias("s"), F.col("blocks").alias("below")), ["c", "s"], "left").na.fill(0)
    placed = cells.join(around, ["c", "s"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def pairs(end: str, count: str):
        """Keys of the pairs of blocks that a member of block b takes part in: with blocks of its own size class, the next, or the one before."""
        rest = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        if end == "same":
            return F.transform(rest, lambda x: F.struct(F.col("s").alias("s"), F.lit(0).alias("up"), F.least("b", x).alias("x"), F.greatest("b", x).alias("y"), (F.col("b") == F.greatest("b", x)).cast("int").alias("side")))
        if end == "low":
            return F.transform(rest, lambda x: F.struct(F.col("s").alias("s"), F.lit(1).alias("up"), F.col("b").alias("x"), x.alias("y"), F.lit(0).alias("side")))
        return F.transform(rest, lambda x: F.struct((F.col("s") - 1).alias("s"), F.lit(1).alias("up"), x.alias("x"), F.col("b").alias("y"), F.lit(1).alias("side")))

    # Full sets are made again, of the texts that are in a component only; of texts that share an id, each class finds its own by its hash.
    own = ["rep", "c", "s", "b", "blocks", "above", "below"]
    tasks = placed.select("doc", "k1", *own)
    texts = docs.select(F.col(key).cast("long").alias("doc"), text)
    texts = texts.join(tasks.hint("merge"), "doc")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.small_batches(batch, text):
                sets = _sets(part, text, shingle, fold)
                mine = np.flatnonzero(_hashed(sets) == part.column("k1").to_numpy().view(np.uint64))
                rows = part.select(own).take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in own), _ragged([sets[i] for i in mine], pa.int64())], [*own, "full"])

    sets = texts.select("k1", *own, text).mapInArrow(full, "rep long, c long, s int, b int, blocks int, above int, below int, full array<long>")
    sets = sets.select("rep", "c", "full", F.inline(F.concat(pairs("same", "blocks"), pairs("low", "above"), pairs("high", "below"))))

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        column = table.column("full").combine_chunks()
        flat, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
        order = np.argsort(ids, kind="stable")
        order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]] if len(order) else order  # a repeated row counts once
        rows = [flat[offsets[x] : offsets[x + 1]] for x in order]
        side, up = table.column("side").to_numpy()[order], table.column("up")[0].as_py()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        every = np.arange(len(order))
        if not up and x == y:
            left = right = every
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = _linked(rows, ids[order], left, right, k, need, percent) if len(left) and len(right) and len(order) > 1 else (ids[:0], ids[:0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sets.groupBy("c", "s", "up", "x", "y").applyInArrow(compare, "a long, b long")


def with_sets(docs: DataFrame, into: tuple[str, str, str] = ("__n", "__k1", "__k2"), *, text: str = "text", shingle: int = 5, fold: bool = True) -> DataFrame:
    """``docs`` with three columns of the names ``into``: size and 128-bit hash of each row's set."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.small_batches(batch, text):
                sets = _sets(part, text, shingle, fold)
                new = [pa.array([len(s) for s in sets], pa.int64()), pa.array(T.signed(_hashed(sets))), pa.array(T.signed(_hashed(sets, SECOND)))]
                yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in names), *new], [*names, *into])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in [*docs.dtypes, *((c, "long") for c in into)]))


def near_sets(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80, k: int = 64, fold: bool = True, block: int = 256) -> DataFrame:
    """(doc, n, k1, k2, component_id, kept) for every row of ``docs``, as near_duplicates; n, k1 and k2 tell the sets of one key apart."""
    rows = materialize(sketches(docs, text=text, key=key, shingle=shingle, k=k, fold=fold), "sketches")
    some = rows.where("n > 0 and doc is not null")
    reps = materialize(some.groupBy("n", "k1", "k2").agg(F.min("doc").alias("doc"), F.first("sketch").alias("sketch")), "classes")
    twice = materialize(reps.groupBy("doc").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "n")).alias("low")).where("c > 1").select("doc", "low"), "shared-ids")
    clash = not twice.isEmpty()
    if clash:  # of classes with one smallest id, all but the first are nodes of their own
        other = F.col("low").isNotNull() & (F.col("low") != F.struct("k1", "k2", "n"))
        reps = materialize(reps.join(twice, "doc", "left").withColumn("rep", F.when(other, F.xxhash64("doc", "k1", "k2", "n")).otherwise(F.col("doc"))).drop("low"), "classes")
    else:
        reps = reps.withColumn("rep", F.col("doc"))
    found = components(links(docs, reps, text=text, key=key, shingle=shingle, k=k, fold=fold, percent=percent, block=block))
    found = found.select(F.col("node").alias("rep"), F.col("component").alias("head"), F.col("component").alias("first"))
    if clash:  # a component goes by its smallest id, not its smallest node
        heads = found.join(reps.select("rep", "doc"), "rep").groupBy("first").agg(F.min(F.struct("doc", "rep")).alias("low"))
        found = found.drop("head").join(heads, "first").select("rep", F.col("low.doc").alias("head"), F.col("low.rep").alias("first"))
    labelled = reps.select("n", "k1", "k2", "rep", F.col("doc").alias("least")).join(found, "rep", "left")
    labelled = labelled.select("n", "k1", "k2", F.coalesce("head", "least").alias("component_id"), F.coalesce(F.col("first") == F.col("rep"), F.lit(True)).alias("leads"))
    out = rows.drop("sketch").join(labelled, ["n", "k1", "k2"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    kept = F.coalesce((F.col("doc") == component) & F.coalesce("leads", F.lit(True)), F.lit(True))
    return out.select("doc", "n", "k1", "k2", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80, k: int = 64, fold: bool = True, block: int = 256) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``.

    Two documents are linked if 100 * shared >= percent * united distinct
    ``shingle``-word shingles (A-Z lower-cased if ``fold``). Fewer words than a
    shingle has: their whole sequence is the one shingle. Documents without words
    and null texts have an empty set, link with nothing and are kept. A row with a
    null key links with nothing, has no component and is kept. Rows that repeat a
    key: each distinct set of it is compared by itself, and each row is returned, kept
    if its own set leads its component. An empty table gives no rows; other columns
    are not read.
    """
    out = near_sets(docs, text=text, key=key, shingle=shingle, percent=percent, k=k, fold=fold, block=block)
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id", "kept")
