"""Words of whole texts as arrays: no Python object is made for a word.

A word is a run of bytes outside the space and 0x09 to 0x0D. In UTF-8 these
bytes are never part of another character, so bytes can be split directly.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Characters that end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd, so that each has an inverse modulo 2**64.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def lean() -> None:
    """Arrays of 1 MB or more go back to the system once freed.

    Spark keeps Python workers for later tasks; without this an idle one holds the
    most that any of its tasks took. Where the C library differs nothing is set.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass


lean()


def release() -> None:
    """At the end of a task: what was freed in small parts goes back, too."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _table(fold: bool) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z if folded."""
    out = np.random.default_rng(20_240_501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        out[65:91] = out[97:123]
    return out


_PLAIN, _FOLDED = _table(False), _table(True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some documents: byte positions, and where each document's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of rows + 1

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, fold: bool = False) -> np.ndarray:
        """64-bit hash of each word's bytes: a polynomial in BYTE_BASE over random values of bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        powers, inverse = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _PLAIN)[self.data] * powers, out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))


_INVERSE = np.uint64(pow(int(BYTE_BASE), -1, 1 << 64))
_KEPT: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BYTE_BASE and of its inverse; those for usual batches are kept."""
    out = []
    for base in (BYTE_BASE, _INVERSE):
        at = _KEPT.get(str(base))
        if at is None or len(at) < n:
            at = np.full(max(n, 1 << 17), base, np.uint64)
            at[0] = 1
            np.cumprod(at, out=at)
            if len(at) <= 1 << 21:
                _KEPT[str(base)] = at
        out.append(at[:n])
    return out[0], out[1]


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Split documents, given as raw() does, into words."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(SPACE[data], out=inside[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1]
    start_mask = inside & ~before
    start_mask[edges] |= inside[edges]  # a word does not reach over the end of a document
    end_mask = before & ~inside
    end_mask[edges] |= before[edges]
    start, end = np.flatnonzero(start_mask), np.flatnonzero(end_mask)
    return Words(data, start, end, np.searchsorted(start, offsets))


def small_batches(batch: pa.RecordBatch | pa.Table, text: str, most: int = 1 << 20) -> Iterator[pa.Table]:
    """Cut a batch between rows so that each part has about ``most`` bytes of text, or one row."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    _, offsets = raw(table.column(text))
    at = 0
    while at < len(table):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield table.slice(at, to - at)
        at = to


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every n consecutive word hashes (across documents too; the caller masks those)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= WORD_BASE
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def whole_windows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and start (counted from the row's first word) of each n-word window inside one row."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return row, start
