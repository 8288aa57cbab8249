"""Which terms a source uses more than its language does, and how far sources are from each other.

Terms are counted per task by their exact strings, and written once with a 64-bit
digest beside each string. From then on only digests move: document frequencies by
(language, digest) settle which terms are kept, counts by (group, digest) settle
everything else. Strings are looked at again in two places. Kept digests get their
least and greatest string; where these differ, the digest stands for several terms,
which are given digests of their own before anything is counted. And the few terms
that are put out get their text by a join.

Distances between sources are sums over blocks of a language's kept terms: a block
is a small matrix of all its sources, so no pairs are made for each term. The table
of distances itself has a row for each pair of sources of a language, as it must.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import text as T
from tidewater.llm.storage import materialize

#: Bytes of text whose terms are counted at once, and sources times terms of a block of distances. A block has at least as many
#: terms as sources, so that the pairs it puts out are no more than what it reads.
CHUNK_BYTES, BLOCK_CELLS = 16 << 20, 1 << 14
#: Kept terms up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_TERMS = 500_000
SCALE, SMOOTHING = 1_000_000_000, 5

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in order, as an array of strings, and the row of each: runs of letters A-Z, a-z and characters over 0x7F, A-Z lower-cased."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _INSIDE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1]
    start = inside & ~before
    start[edges] |= inside[edges]
    start = np.flatnonzero(start)
    kept = np.flatnonzero(inside[:-1])
    bounds = np.append(np.searchsorted(kept, start), len(kept)).astype(np.int64)
    array = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[kept]]))
    return array, np.searchsorted(offsets, start, "right") - 1


def counts_of_tasks(docs: DataFrame, *, text: str) -> DataFrame:
    """(language, grp, term, n, docs): occurrences and documents of each term of a group, in one stretch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held)
            array, row = terms(*T.raw(table.column(text)))
            if not len(array):
                return
            coded = array.dictionary_encode()
            code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            groups = table.column("grp").to_numpy()
            language = table.column("language").to_numpy()
            names, first, group = np.unique(groups, return_index=True, return_inverse=True)
            of_doc, n = np.unique(row * len(words) + code, return_counts=True)  # (document, term)
            doc, code = np.divmod(of_doc, len(words))
            key = group[doc] * len(words) + code
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            g, code = np.divmod(key[begin], len(words))
            for a in range(0, len(begin), 1 << 17):
                cut = slice(a, a + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(language[first[g[cut]]]), pa.array(names[g[cut]]), words.take(pa.array(code[cut])).cast(pa.string()), pa.array(np.add.reduceat(n, begin)[cut].astype(np.int64)), pa.array(np.diff(np.append(begin, len(key)))[cut].astype(np.int64))],
                    ["language", "grp", "term", "n", "docs"],
                )

        for batch in batches:
            for part in T.small_batches(batch, text, CHUNK_BYTES):
                held.append(part)
                size += part.column(text).nbytes
                if size >= CHUNK_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        T.release()

    return docs.select("language", "grp", text).mapInArrow(run, "language long, grp long, term string, n long, docs long")


def numbered(docs: DataFrame, names: list[str]) -> tuple[DataFrame, int]:
    """The different ``names`` with a number each, and the seed by which ``number`` gives all of them different ones."""
    groups = materialize(docs.select(*names).distinct(), "groups")
    for seed in range(100):
        with_numbers = groups.select("*", number(names, seed).alias("grp"), number(names[:1], seed).alias("language"))
        if with_numbers.agg((F.count_distinct("grp") == F.count("*")) & (F.count_distinct("language") == F.count_distinct(names[0]))).first()[0]:
            return materialize(with_numbers, "numbered-groups"), seed
    raise RuntimeError("groups cannot be told apart by 64 bits")


def number(names: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in names])


def told_apart(counts: DataFrame, *, least: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The counts with a digest that stands for one term among a language's kept ones, and these: (language, digest, docs, term)."""
    digest = F.xxhash64("term") if bits >= 64 else F.xxhash64("term").bitwiseAND(F.lit((1 << bits) - 1))
    counts = materialize(counts.withColumn("digest", digest), "term-counts")
    for turn in range(1, 20):
        frequent = materialize(counts.groupBy("language", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least), "frequent-digests")
        few = frequent.count() <= BROADCAST_TERMS
        some = frequent.select("language", "digest")
        strings = counts.select("language", "digest", "term").join(F.broadcast(some) if few else some, ["language", "digest"], "left_semi")
        bounds = materialize(strings.groupBy("language", "digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "digest-strings")
        shared = bounds.where("low < high").select("language", "digest", F.lit(True).alias("shared"))
        if shared.isEmpty():
            return counts, materialize(frequent.join(bounds, ["language", "digest"]).select("language", "digest", "docs", F.col("low").alias("term")), "kept-terms")
        own = F.when(F.col("shared"), F.xxhash64(F.lit(turn), F.lit("own"), "term")).otherwise(F.col("digest"))
        counts = materialize(counts.join(shared, ["language", "digest"], "left").select("language", "grp", "term", "n", "docs", own.alias("digest")), "term-counts")
    raise RuntimeError("terms cannot be told apart by 64 bits")


def share(count: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * kept)), exactly; null where no term is kept."""
    lower = f"cast(total + {SMOOTHING} * kept AS decimal(19, 0))"
    return F.expr(f"CASE WHEN kept > 0 THEN 1 + cast({SCALE} AS decimal(10, 0)) * cast({count} + {SMOOTHING} AS decimal(19, 0)) div {lower} END")


def distances(shares: DataFrame, groups: DataFrame, cells: int) -> DataFrame:
    """(language, a, b, value): the summed absolute difference of shares of two groups, each pair once, also where no term is kept."""
    size = groups.groupBy("language").agg(F.count("*").alias("sources"), F.max("kept").alias("terms"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("sources") * F.col("terms") / F.greatest(F.lit(cells), F.col("sources") * F.col("sources")))).cast("int")
    size = materialize(size.select("language", blocks.alias("blocks")), "language-blocks")
    heads = groups.join(size, "language").select("language", "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("digest"), F.coalesce(share("0"), F.lit(0)).alias("p"))
    cells_of = shares.join(size, "language").select("language", "grp", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block"), "digest", "p")

    def sums(table: pa.Table) -> pa.Table:
        """Of a block: every source has the share of no occurrence where it has no row."""
        head = np.asarray(table.column("digest").is_null())
        grp, p = table.column("grp").to_numpy(), table.column("p").to_numpy()
        names, absent = grp[head], p[head]
        by = np.argsort(names)
        names, absent = names[by], absent[by]
        _, term = np.unique(table.column("digest").to_numpy()[~head], return_inverse=True)
        of = np.repeat(absent[:, None], term.max() + 1 if len(term) else 0, 1).astype(np.int64)
        of[np.searchsorted(names, grp[~head]), term] = p[~head]
        a, b, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(names) - 1):
            a.append(np.full(len(names) - 1 - i, names[i]))
            b.append(names[i + 1 :])
            value.append(np.abs(of[i + 1 :] - of[i]).sum(1))
        a, b, value = map(np.concatenate, (a, b, value))
        return pa.table({"language": pa.array(np.full(len(a), table.column("language")[0].as_py() if len(table) else 0, np.int64)), "a": pa.array(a), "b": pa.array(b), "value": pa.array(value)})

    parts = heads.unionByName(cells_of).groupBy("language", "block").applyInArrow(sums, "language long, a long, b long, value long")
    return parts.groupBy("language", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, top: int = 50, digest_bits: int = 64, cells: int = BLOCK_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank), in two parts of one table, for every (lang, source) that occurs.

    A language keeps the terms that at least ``least_docs`` of its rows have; V is
    their number. A group of N kept occurrences gives a term that it has c times
    the share 1 + floor(10**9 (c + 5) / (N + 5 V)). ``pair``: the other sources of
    the language, with the summed difference of shares over all kept terms (0 if
    none is kept), largest first. ``term``: the kept terms of the group whose share
    is over that of the whole language, with the difference, the ``top`` ones. Ties
    go by the item's bytes. Null text, lang and source count as empty text. Rows
    that repeat count as often as they stand. Other columns are not read. An empty
    table gives no rows.
    """
    read = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    groups, seed = numbered(read, ["lang", "source"])
    counts, kept = told_apart(counts_of_tasks(read.select("text", number(["lang"], seed).alias("language"), number(["lang", "source"], seed).alias("grp")), text="text"), least=least_docs, bits=digest_bits)

    some = kept.select("language", "digest")
    some = F.broadcast(some) if some.count() <= BROADCAST_TERMS else some
    found = materialize(counts.select("language", "grp", "digest", "n").join(some, ["language", "digest"], "left_semi").groupBy("language", "grp", "digest").agg(F.sum("n").alias("n")), "group-counts")

    sizes = kept.groupBy("language").agg(F.count("*").alias("kept"))
    totals = found.groupBy("grp").agg(F.sum("n").alias("total"))
    groups = materialize(groups.join(sizes, "language", "left").join(totals, "grp", "left").na.fill(0, ["kept", "total"]), "group-totals")
    of_language = groups.groupBy("language").agg(F.max("kept").alias("kept"), F.sum("total").alias("total"))

    shares = found.join(groups.select("grp", "total", "kept"), "grp").select("language", "grp", "digest", share("n").alias("p"))
    usual = found.groupBy("language", "digest").agg(F.sum("n").alias("n")).join(of_language, "language").select("language", "digest", share("n").alias("q"))
    over = shares.join(usual, ["language", "digest"]).where("p > q").select("language", "grp", "digest", (F.col("p") - F.col("q")).alias("value"))
    place = F.rank().over(Window.partitionBy("grp").orderBy(F.desc("value")))
    first = over.withColumn("place", place).where(F.col("place") <= top).drop("place")  # with all that tie with the last
    # The text comes back here, and only here; it also orders those that tie.
    named = first.join(kept.select("language", "digest", F.col("term").alias("item")), ["language", "digest"]).select("grp", F.lit("term").alias("part"), "item", "value")

    apart = distances(shares, groups, cells)
    both = apart.select(F.col("a").alias("grp"), F.col("b").alias("other"), "value").unionByName(apart.select(F.col("b").alias("grp"), F.col("a").alias("other"), "value"))
    pairs = both.join(groups.select(F.col("grp").alias("other"), F.col("source").alias("item")), "other").select("grp", F.lit("pair").alias("part"), "item", "value")

    place = F.row_number().over(Window.partitionBy("grp", "part").orderBy(F.desc("value"), "item"))
    ranked = named.unionByName(pairs).withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.join(groups.select("grp", "lang", "source"), "grp").select("lang", "source", "part", "item", "value", "rank")
