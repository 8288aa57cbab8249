"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are tokenised in map tasks; the rows that go on hold numbers, no text.
The plan is made on counts: there are at most ``size`` different lengths, so the
histogram, and the plan with it, has a bound that does not grow with the corpus.
Best fit decreasing treats all pieces of one length, and all bins with the same
room, at once. Pieces then take the planned slots by their rank within their
length. The rank is a piece's rank in its task plus the pieces of that length in
earlier tasks, so a length that a third of all pieces have is never gathered.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm import text as T
from tidewater.llm.storage import materialize

#: Words after which a worker lays its ids aside and begins anew, for speed alone; it looks among those laid aside, too. Some 70 MB in all.
KEPT_WORDS = 220_000
#: A run of Latin letters, and perhaps one mark after it: one token run, or two. Others are encoded by themselves.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")
#: Plain words that are encoded as one line.
LINE = 200


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True


def parted(data: np.ndarray, words: T.Words) -> tuple[np.ndarray, T.Words]:
    """The same text with fewer different words: A-Z lower-cased, and a mark after a last letter as a word of its own.

    The tokenizer does both anyhow. Lower case could make a special token of a
    text that is none, so a batch with its opening brackets stays as it is.
    """
    if b"<|" not in data.tobytes():
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    last = words.end - 1
    split = (words.end - words.start > 1) & _MARK[data[last]] & _LETTER[data[last - 1]] if len(words) else np.zeros(0, bool)
    start = np.sort(np.concatenate([words.start, last[split]]))
    end = np.sort(np.concatenate([words.end, last[split]]))
    return data, T.Words(data, start, end, np.searchsorted(start, np.append(words.start, len(data))[words.first]))


#: What parted() and PLAIN rely on: lower case, and no token over white space or over the end of a run of letters.
LOWERS, SPLITS = {"type": "Lowercase"}, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def checked(spec: str) -> str:
    """``spec``, if it is the JSON of a tokenizer whose words can be encoded one by one; else ValueError."""
    parts = json.loads(spec)
    lowers = LOWERS in (parts["normalizer"] or {}).get("normalizers", [])
    splits = any(x.get("pattern") == {"Regex": SPLITS} for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", []))
    if not (lowers and splits and parts["model"].get("end_of_word_suffix") == "</w>"):
        raise ValueError("pack() needs a tokenizer that lower-cases, splits at white space and ends words with </w>")
    return spec


class WordTokenizer:
    """Ids of whole texts by a tokenizer that splits at white space and marks the end of each token run.

    White space ends a token in such a tokenizer, so each word is encoded once
    and its ids are reused. New plain words are encoded as lines and told apart
    by the end marks of their runs. Made in the worker from the tokenizer's JSON.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def known(self, texts: list[bytes]) -> list[bytes]:
        """Ids of different words. Words in use stay; those not seen for long go."""
        if len(self.ids) > KEPT_WORDS:
            self.older, self.ids = self.ids, {}
        new = []
        for x in texts:
            if x not in self.ids:
                old = self.older.get(x)
                if old is None:
                    new.append(x)
                else:
                    self.ids[x] = old
        self.learn(new)
        return [self.ids[x] for x in texts]

    def learn(self, new: list[bytes]) -> None:
        """Keep the ids of new words."""
        plain: list[tuple[bytes, str]] = []
        runs: list[int] = []
        other: list[bytes] = []
        for x in new:
            word = x.decode()
            if m := PLAIN.fullmatch(word):
                plain.append((x, word))
                runs.append(2 if m[2] else 1)
            else:
                other.append(x)
        lines = self.tokenizer.encode_batch_fast([" ".join(w for _, w in plain[a : a + LINE]) for a in range(0, len(plain), LINE)], add_special_tokens=False)
        for k, line in enumerate(lines):
            own = plain[k * LINE : (k + 1) * LINE]
            ids = np.array(line.ids, "<u4")
            last = np.cumsum(runs[k * LINE : (k + 1) * LINE])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != last[-1]:
                other += [x for x, _ in own]
                continue
            cuts = np.r_[0, ends[last - 1]] * 4
            blob = ids.tobytes()
            for (x, _), a, b in zip(own, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                self.ids[x] = blob[a:b]
        for x, e in zip(other, self.tokenizer.encode_batch_fast([x.decode() for x in other], add_special_tokens=False), strict=True):
            self.ids[x] = np.array(e.ids, "<u4").tobytes()

    def encode(self, data: np.ndarray, words: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and where each row's ids begin (one more than rows)."""
        data, words = parted(data, words)
        lengths = words.end - words.start
        packed = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~T.SPACE[data]]))])
        coded = packed.dictionary_encode()
        code, texts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        own = self.known(texts)
        count = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), "<u4")
        begin = np.cumsum(count) - count
        n = count[code]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[code], n)
        return flat[at], np.r_[0, np.cumsum(n)][words.first]


_MADE: dict[int, WordTokenizer] = {}


def word_tokenizer(spec: str) -> WordTokenizer:
    """One tokenizer a worker."""
    made = _MADE.get(key := zlib.crc32(spec.encode()))
    if made is None:
        _MADE.clear()
        made = _MADE[key] = WordTokenizer(spec)
    return made


PIECE = "row long, doc_id long, piece int, start long, length int, ids_crc32 long, task int, own_rank long"


def pieces(docs: DataFrame, spec: str, *, text: str, key: str, size: int, end_id: int) -> DataFrame:
    """A row for each piece: numbers of its ids, its task, and its rank in that task among pieces of its length."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(shared.value)
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        at = 0
        for batch in batches:
            for part in T.small_batches(batch, text, 1 << 21):
                data, offsets = T.raw(part.column(text))
                ids, first = tokenizer.encode(data, T.words(data, offsets))
                out: list[tuple] = []
                for i, doc in enumerate(part.column(key).to_pylist()):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, a in enumerate(range(0, len(own), size)):
                        cut = own[a : a + size]
                        out.append(((task << 40) + at, doc, k, a, len(cut), zlib.crc32(cut.tobytes()), task, int(seen[len(cut)])))
                        seen[len(cut)] += 1
                        at += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "doc_id", "piece", "start", "length", "ids_crc32", "task", "own_rank"])
        T.release()

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, PIECE)


def plan(histogram: dict[int, int], size: int) -> np.ndarray:
    """Best fit decreasing over counts.

    Returns rows (length, first rank, first sequence, sequences, per sequence,
    offset), sorted by length and rank: pieces of a length with ranks from the
    first one fill the sequences one after the other, ``per sequence`` in each.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences
    next_sequence, out = 0, []

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            rooms.setdefault(room, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        later: list[tuple[int, int, int]] = []
        tight = sorted(r for r in rooms if r >= length)
        for room in tight:
            per = room // length
            while left and rooms[room]:
                first, count = rooms[room].pop()
                full = min(count, left // per)
                if full:
                    out.append((length, rank, first, full, per, size - room))
                    later.append((room - per * length, first, full))
                    rank, left, first, count = rank + full * per, left - full * per, first + full, count - full
                if left and count:  # fewer than fill one
                    out.append((length, rank, first, 1, left, size - room))
                    later.append((room - left * length, first, 1))
                    rank, left, first, count = rank + left, 0, first + 1, count - 1
                if count:
                    rooms[room].append((first, count))
            if not rooms[room]:
                del rooms[room]
            if not left:
                break
        per = size // length
        if full := left // per:
            out.append((length, rank, next_sequence, full, per, 0))
            later.append((size - per * length, next_sequence, full))
            rank, left, next_sequence = rank + full * per, left - full * per, next_sequence + full
        if left:
            out.append((length, rank, next_sequence, 1, left, 0))
            later.append((size - left * length, next_sequence, 1))
            next_sequence += 1
        for x in later:
            put(*x)
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer_path: str, *, text: str = "text", key: str = "doc_id", size: int = 4096, end_id: int = 1) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids (no special tokens added) and then ``end_id``; null and
    empty texts are the end id alone. Only longer ones are cut, into pieces of
    ``size``. Rows that repeat a key, and null keys, are packed as rows of their
    own. An empty table gives no rows. Other columns are not read.
    A text of any length is read whole, one text at a time. A tokenizer whose words
    cannot be encoded one by one is refused (see checked()).
    """
    spark: SparkSession = docs.sparkSession
    spec = checked(Path(tokenizer_path).read_text())
    rows = materialize(pieces(docs, spec, text=text, key=key, size=size, end_id=end_id), "pieces")
    counts = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = plan(histogram, size)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.join(counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")), ["length", "task"]).withColumn("rank", F.col("earlier") + F.col("own_rank"))
    steps = spark.sparkContext.broadcast((slots[:, 0] << 44) + slots[:, 1] if len(slots) else np.zeros(0, np.int64))
    table = spark.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            slot = table.value[np.searchsorted(steps.value, (length << 44) + rank, "right") - 1]
            within = rank - slot[:, 1]
            sequence, offset = slot[:, 2] + within // slot[:, 4], slot[:, 5] + within % slot[:, 4] * length
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("piece"), batch.column("start"), pa.array(length), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)], [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"`{key}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
