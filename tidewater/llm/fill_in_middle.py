"""Fill-in-the-middle examples: texts cut at two unit boundaries and put in another order.

A batch of whole texts is one run of bytes. Each byte has one of five classes, and
a wavelet matrix over these classes answers how many bytes of a class stand before
a place. Sums of such ranks count units (lines, words or characters) and characters
of any stretch, and a bisection on them finds the place of a cut, for all texts of a
batch at once. Nothing is shuffled and no text is split into a list of its units.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import text as T

#: Classes of bytes: inside of a word, a later byte of a character, a newline, other white space, the first byte of a word.
INSIDE, LATER, NEWLINE, SPACE, FIRST = range(5)
LEVELS = 3


class Bits:
    """A vector of bits that counts its ones before a place: 64-bit words, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(np.append(bits, np.zeros(64 + -len(bits) % 64, bool)), bitorder="little").view("<u8")
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, mask = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks of symbols: one Bits a level, the highest bit first; each level orders symbols by the bit before, stably."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.levels = []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level) & 1 == 1
            self.levels.append((level, Bits(bits), len(bits) - int(np.count_nonzero(bits))))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place."""
        begin = np.zeros(1, np.int64)
        for level, bits, zeros in self.levels:
            if symbol >> level & 1:
                begin, at = zeros + bits.rank(begin), zeros + bits.rank(at)
            else:
                begin, at = begin - bits.rank(begin), at - bits.rank(at)
        return at - begin


@dataclass(frozen=True)
class Unit:
    """Bytes that bound a unit: it ends after one of ``classes``, or begins with one."""

    classes: tuple[int, ...]
    begins: bool


#: A line keeps its newline. A word keeps the white space after it, and the first one that before it. A character is a code point.
UNITS = {"lines": Unit((NEWLINE,), False), "words": Unit((FIRST,), True), "characters": Unit((INSIDE, NEWLINE, SPACE, FIRST), True)}


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 texts that lie one after another."""
    space = T.SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    edges = offsets[:-1]
    before[edges[edges < len(data)]] = True
    out = np.where(space, np.where(data == 10, NEWLINE, SPACE), np.where((data & 0xC0) == 0x80, LATER, np.where(before, FIRST, INSIDE)))
    return out.astype(np.uint8)


class Boundaries:
    """Unit boundaries of the texts of a batch, by ranks alone."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: Unit):
        symbols = classes(data, offsets)
        self.begin, self.end, self.unit = offsets[:-1], offsets[1:], unit
        self.matrix = WaveletMatrix(symbols)
        self.base = self.bounds(self.begin)
        self.own = self.bounds(self.end) - self.base
        some = self.end > self.begin
        if unit.begins:
            self.n = np.maximum(self.own, some)
        else:
            last = symbols[np.maximum(self.end - 1, 0)] if len(symbols) else np.zeros(len(some), np.uint8)
            self.n = self.own + (some & ~np.isin(last, unit.classes))

    def bounds(self, at: np.ndarray) -> np.ndarray:
        """Bytes before each place that bound a unit: the ranks of all its classes together."""
        return sum(self.matrix.rank(c, at) for c in self.unit.classes)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The place after the first ``units`` units of each text."""
        wanted = self.base + units + self.unit.begins
        low, high = self.begin.copy(), self.end.copy()  # the least place with so many bounds before it
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.bounds(middle) >= wanted
            high = np.where(enough & (low < high), middle, high)
            low = np.where(enough | (low >= high), low, middle + 1)
        place = low - self.unit.begins
        return np.where(units <= 0, self.begin, np.where(units >= self.n, self.end, place))

    def characters(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return b - a - (self.matrix.rank(LATER, b) - self.matrix.rank(LATER, a))


def draws(key: str | Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 that a key and a seed settle: 8-digit groups of the SHA-256 of ``seed:key``. A null key counts as empty text."""
    of = F.col(key) if isinstance(key, str) else key
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(of.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _checked(marks: dict[str, str]) -> None:
    """Refuse marks that could be found across a border, or inside each other."""
    of = list(marks.values())
    ends = {x[-n:] for x in of for n in range(1, len(x))}
    begins = {x[:n] for x in of for n in range(1, len(x))}
    if not all(of) or len({*of}) < len(of) or ends & (begins | {*of}) or any(x in y for x in of for y in of if x != y):
        raise ValueError(f"marks must be distinct, and none may overlap with another or itself: {of}")


MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}


def fill_in_middle(docs: DataFrame, *, text: str = "text", key: str = "doc_id", units: str = "lines", seed: int = 7, rate: int = 100, suffix_first: int = 50, marks: dict[str, str] = MARKS) -> DataFrame:
    """``docs`` with columns n_units, form, prefix_chars, middle_chars and output.

    The first two draws of a row's key, modulo n_units + 1, say after how many
    units the prefix and the middle end; ``rate`` of a hundred texts are put in
    another order, and ``suffix_first`` of a hundred of these with the suffix first
    (form ``spm``, else ``psm``). A text stays as it is (form ``plain``, null
    lengths) if it is empty or holds one of the marks. A null text is empty and
    gives an empty output. Rows with equal keys are drawn alike, also those with a
    null key. A text of one unit is cut before or after it. Lengths are in code
    points. Columns named like new ones are replaced, others stay; an empty table
    gives no rows. ``restored`` takes the output back.
    """
    _checked(marks)
    unit, new = UNITS[units], ["n_units", "form", "prefix_chars", "middle_chars", "output"]
    others = [c for c in docs.columns if c not in new]
    names = []
    for k in range(4):
        name = f"__draw{k}"
        while name in others:
            name += "_"
        names.append(name)
    drawn = docs.select(*others, *[h.alias(x) for h, x in zip(draws(key, seed), names, strict=True)])
    p, s, m = (marks[x].encode() for x in ("prefix", "suffix", "middle"))

    def rearranged(part: pa.Table) -> list[pa.Array]:
        data, offsets = T.raw(part.column(text))
        h = [part.column(x).to_numpy() for x in names]
        found = Boundaries(data, offsets, unit)
        one, two = h[0] % (found.n + 1), h[1] % (found.n + 1)
        a, b = found.cut(np.minimum(one, two)), found.cut(np.maximum(one, two))
        blob, forms, output = data.tobytes(), [], []
        first = h[3] % 100 < suffix_first
        for begin, x, y, end, asked, spm in zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), (h[2] % 100 < rate).tolist(), first.tolist(), strict=True):
            whole = blob[begin:end]
            if not asked or not whole or p in whole or s in whole or m in whole:
                forms.append("plain")
                output.append(whole)
            elif spm:
                forms.append("spm")
                output.append(b"".join((s, blob[y:end], p, blob[begin:x], m, blob[x:y])))
            else:
                forms.append("psm")
                output.append(b"".join((p, blob[begin:x], s, blob[y:end], m, blob[x:y])))
        plain = np.array([f == "plain" for f in forms], bool)
        sizes = [pa.array(found.characters(*at).astype(np.int64), mask=plain) for at in ((offsets[:-1], a), (a, b))]
        return [pa.array(found.n.astype(np.int64)), pa.array(forms, pa.string()), *sizes, pa.array(output, pa.binary()).cast(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.small_batches(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in others), *rearranged(part)], [*others, *new])
        T.release()

    kind = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kind[c]}" for c in others] + ["n_units long", "form string", "prefix_chars long", "middle_chars long", "output string"])
    return drawn.mapInArrow(run, schema)


def restored(output: str | Column = "output", form: str | Column = "form", marks: dict[str, str] = MARKS) -> Column:
    """The exact text that an output was made of."""
    _checked(marks)
    of, kind = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(of, "|".join(f"\\Q{x}\\E" for x in marks.values()), -1)
    return F.when(kind == "psm", F.concat(parts[1], parts[3], parts[2])).when(kind == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(of)
