"""Removal of passages that also stand earlier in the corpus.

Every window of ``window`` consecutive words gets a Rabin-Karp hash. A map task
takes documents in chunks; within a chunk all but the first window of each hash
are settled, and one entry a hash goes on. Spark deals the entries out by hash
range, counts them and finds the first of each hash over the corpus; all others
repeat it. So a passage that stands in a third of all documents costs one entry a
chunk and never meets in one task as a group of documents. Positions come back
to their documents, adjoining and overlapping windows merge into maximal
intervals, and their words go.

Entries travel packed: a row holds the entries of one chunk for one bucket of
hashes, 12 bytes a window and one or two for its place. Windows are equal if
both hashes are, 96 bits in all: among 10**13 windows the chance that any is taken
for another is below 0.001. A bucket holds some 250,000 entries
however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import text as T
from tidewater.llm.storage import materialize, shuffle_partitions

#: Words of the documents that a map task settles among themselves at once.
CHUNK_WORDS = 1_000_000
#: Entries of a bucket, on average: what one Python worker holds at once, at some 100 bytes each.
BUCKET_ENTRIES = 250_000
#: Fewer bytes than a word and the space after it have in any usual text.
WORD_BYTES = 6
#: Added to word hashes for the second hash of a window.
SECOND = np.uint64(0x5851F42D4C957F2D)


def _planes(x: np.ndarray, size: int = 4) -> bytes:
    """Numbers of ``size`` bytes by byte planes: the high bytes, mostly 0, stand together and compress to nothing."""
    return x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def _unplanes(b: bytes, size: int = 4) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(size, -1).T.copy().view(f"<u{size}").ravel().astype(np.int64)


def _packed(doc: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places sorted by document, then start: each id as its distance to the one before, places of each, and each place likewise."""
    runs = _runs(doc)
    places = np.diff(start, prepend=0)
    places[runs] = start[runs]
    return _planes(np.diff(doc[runs], prepend=0), 8), _planes(np.diff(np.r_[runs, len(doc)])), _planes(places)


def _unpacked(ids: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts, places = _unplanes(counts), _unplanes(places)
    total, begin = np.cumsum(places), np.cumsum(counts) - counts
    return np.repeat(np.cumsum(_unplanes(ids, 8)), counts), total - np.repeat(total[begin] - places[begin], counts)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


ENTRY = "kind int, at long, ids binary, counts binary, hashes binary, more binary, places binary"
PLACES = "at long, ids binary, counts binary, places binary"


def _by_document(doc: np.ndarray, start: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Places as packed rows, one for each bucket of documents."""
    bucket = (T.mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((start, doc, bucket))
    doc, start, bucket = doc[by], start[by], bucket[by]
    for a, b in _spans(bucket):
        yield int(bucket[a]), *_packed(doc[a:b], start[a:b])


def _chunk(ids: np.ndarray, h: list[np.ndarray], g: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Rows of one chunk of documents: of kind 0 what goes to a bucket, of kind 1 the settled repeats."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    count = np.array([len(h[i]) for i in order])
    keys, more = np.concatenate([h[i] for i in order]), np.concatenate([g[i] for i in order])
    doc = np.repeat(np.arange(len(ids)), count)
    start = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
    by = np.argsort(keys, kind="stable")  # equal hashes in order of (id, start)
    # Where one first hash has windows of two second ones, some that are equal stay apart here and are settled later.
    new = np.r_[True, (keys[by[1:]] != keys[by[:-1]]) | (more[by[1:]] != more[by[:-1]])]
    head = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same_place = (ids[doc[by]] == ids[doc[head]]) & (start[by] == start[head])  # a row that repeats an id
    first = np.zeros(len(keys), bool)
    first[by[new]] = True
    later = np.zeros(len(keys), bool)
    later[by] = ~new & ~same_place
    gone = np.flatnonzero(later)
    for at, own, counts, places in _by_document(ids[doc[gone]], start[gone], buckets):
        yield 1, at, own, counts, None, None, places
    del by, new, head, same_place, later, gone
    kept = np.flatnonzero(first)
    bucket = (keys[kept] >> np.uint64(40)) % np.uint64(buckets)
    kept = kept[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket)
    for a, b in _spans(bucket):
        part = kept[a:b]
        own, counts, places = _packed(ids[doc[part]], start[part])
        yield 0, int(bucket[a]), own, counts, keys[part].tobytes(), more[part].tobytes(), places


def _spans(x: np.ndarray) -> Iterator[tuple[int, int]]:
    runs = _runs(x).tolist()
    yield from zip(runs, [*runs[1:], len(x)][: len(runs)], strict=True)


def repeated_windows(docs: DataFrame, *, text: str, key: str, window: int, buckets: int) -> DataFrame:
    """(doc, start, end): for each document that loses words, arrays of its maximal intervals of words to remove."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[np.ndarray] = []
        more: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            out = list(zip(*_chunk(np.array(ids, np.int64), rows, more, buckets), strict=True))
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out or [[]] * 7, kinds, strict=True)], ["kind", "at", "ids", "counts", "hashes", "more", "places"])

        for batch in batches:
            for part in T.small_batches(batch, text):
                words = T.words(*T.raw(part.column(text)))
                hashes = words.hashes()
                rolled, second = T.rolled(hashes, window), (T.rolled(T.mix(hashes + SECOND), window) >> np.uint64(32)).astype(np.uint32)
                for i, doc in enumerate(part.column(key).to_pylist()):
                    n = words.first[i + 1] - words.first[i] - window + 1
                    if n > 0:
                        ids.append(doc)
                        rows.append(rolled[words.first[i] : words.first[i] + n])
                        more.append(second[words.first[i] : words.first[i] + n])
                        held += n
                if held >= CHUNK_WORDS:
                    yield flush()
                    ids, rows, more, held = [], [], [], 0
        if ids:
            yield flush()
        rows.clear()
        more.clear()
        T.release()

    def settle(table: pa.Table) -> pa.Table:
        """Of a bucket of hashes: every entry but the first of its hash. What is settled passes."""
        parts = [table.column(c).to_pylist() for c in ("ids", "counts", "places")]
        if table.column("kind")[0].as_py():
            return pa.table({"at": table.column("at"), **dict(zip(("ids", "counts", "places"), (table.column(c) for c in ("ids", "counts", "places")), strict=True))})
        doc, start = (np.concatenate(x) for x in zip(*map(_unpacked, *parts), strict=True))
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()])
        more = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("more").to_pylist()])
        by = np.argsort(keys)
        sorted_keys = keys[by]
        equal = sorted_keys[1:] == sorted_keys[:-1]
        by = by[np.r_[False, equal] | np.r_[equal, False]]  # the others are alone
        keys, more, doc, start = keys[by], more[by], doc[by], start[by]
        by = np.lexsort((start, doc, more, keys))
        keys, more, doc, start = keys[by], more[by], doc[by], start[by]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])] if len(keys) else np.zeros(0, bool)
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[head]) | (start != start[head])
        out = list(zip(*_by_document(doc[later], start[later], buckets), strict=True)) or [[]] * 4
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("at", "ids", "counts", "places"), out, (pa.int64(), *[pa.binary()] * 3), strict=True)})

    def gather(table: pa.Table) -> pa.Table:
        """Of a bucket of documents: windows that meet or overlap become one interval."""
        doc, start = (np.concatenate(x) for x in zip(*map(_unpacked, *(table.column(c).to_pylist() for c in ("ids", "counts", "places"))), strict=True))
        by = np.lexsort((start, doc))
        doc, start = doc[by], start[by]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + window)]
        begin = np.flatnonzero(new)
        first, last, doc = start[begin], start[np.r_[begin[1:], len(start)] - 1] + window, doc[begin]
        runs = _runs(doc)
        offsets = pa.array(np.r_[runs, len(doc)].astype(np.int32))
        return pa.table({"doc": pa.array(doc[runs]), "start": pa.ListArray.from_arrays(offsets, pa.array(first.astype(np.int32))), "end": pa.ListArray.from_arrays(offsets, pa.array(last.astype(np.int32)))})

    rows = docs.select(F.col(key).cast("long").alias(key), text).where(F.col(key).isNotNull()).mapInArrow(entries, ENTRY)
    gone = rows.groupBy("kind", "at").applyInArrow(settle, PLACES)
    return gone.groupBy("at").applyInArrow(gather, "doc long, start array<int>, end array<int>")


def deduplicate(docs: DataFrame, *, text: str = "text", key: str = "doc_id", window: int = 20, buckets: int | None = None) -> DataFrame:
    """``docs`` with removed words taken out of ``text``, and columns n_words, n_removed, kept_words.

    A word goes if a window that covers it has a word sequence that also starts
    earlier: in a smaller key, or in the same document before. Windows are judged
    on the input. ``kept_words`` are the other words, joined by one space.
    ``text`` keeps its own white space between kept words; a text that loses
    nothing is unchanged, and null stays null (no words). Texts shorter than a
    window lose nothing. Rows with a null key are left as they are and settle
    nothing. Rows that repeat a key count as one document: a repeat of the same
    place is not earlier, and each row is returned. An empty table gives no rows.
    Columns named like the three new ones are replaced; all others stay.
    """
    spark = docs.sparkSession
    if buckets is None:
        whole = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        buckets = max(shuffle_partitions(spark), -(-whole // (WORD_BYTES * BUCKET_ENTRIES)))
    gone = materialize(repeated_windows(docs, text=text, key=key, window=window, buckets=buckets), "intervals").select("doc", F.struct("start", "end").alias("cut"))
    kind = dict(docs.dtypes)
    others = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_words")]
    fields = [docs.schema[c] for c in others]
    mark, own_key = "__cut", "__doc"
    while mark in others:
        mark += "_"
    while own_key in others:
        own_key += "_"
    # Joined by shuffle at every size: the intervals grow with the corpus, so a broadcast that fits a small one is no guide.
    joined = docs.select(*others).join(gone.select(F.col("doc").alias(own_key), F.col("cut").alias(mark)).hint("merge"), F.col(key).cast("long") == F.col(own_key), "left").drop(own_key)
    schema = ", ".join([f"`{f.name}` {kind[f.name]}" for f in fields] + ["n_words long", "n_removed long", "kept_words string"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.small_batches(batch, text):
                column = part.column(text).combine_chunks()
                data, offsets = T.raw(column)
                words = T.words(data, offsets)
                keep = np.ones(len(words), bool)
                change = np.zeros(len(part), bool)
                for i, cuts in enumerate(part.column(mark).to_pylist()):
                    n = int(words.first[i + 1] - words.first[i])
                    for a, b in zip(cuts["start"], cuts["end"], strict=True) if cuts else ():
                        if b <= n:
                            keep[words.first[i] + a : words.first[i] + b] = False
                            change[i] = True
                kept_words, whole = [], []
                blob = data.tobytes()
                was_null = column.is_null().to_numpy(zero_copy_only=False)
                for i in range(len(part)):
                    a, b = words.first[i], words.first[i + 1]
                    own = np.flatnonzero(keep[a:b]) + a
                    pieces = [blob[s:e] for s, e in zip(words.start[own].tolist(), words.end[own].tolist(), strict=True)]
                    kept_words.append(b" ".join(pieces))
                    if not change[i]:
                        whole.append(None if was_null[i] else blob[offsets[i] : offsets[i + 1]])
                        continue
                    # Each kept word with the white space before it.
                    before = np.r_[offsets[i], words.end[a : b - 1]][own - a] if len(own) else own
                    whole.append(b"".join(blob[s:e] for s, e in zip(before.tolist(), words.end[own].tolist(), strict=True)).lstrip(b" \t\n\x0b\x0c\r"))
                n = np.diff(words.first)
                lost = n - np.add.reduceat(np.r_[keep, False].astype(np.int64), words.first[:-1]) * (n > 0) if len(part) else n
                columns = [pa.array(whole, pa.binary()).cast(pa.string()) if c == text else part.column(c).combine_chunks() for c in others]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept_words, pa.binary()).cast(pa.string())], [*others, "n_words", "n_removed", "kept_words"])

    return joined.mapInArrow(cut, schema)
