"""Boosted histogram trees for many quantiles at once, with the pinball loss.

Columns are binned once, and a task keeps its rows by cell: rows whose bins are all
equal have equal forecasts for ever, so a tree asks only how many rows of a cell lie
above its forecast. If a table has few cells, the targets of each are sorted once
(``_Sorted``): a job a tree finds these counts by bisection, all levels are grown from
them, and another takes from the cells of each leaf the few rows around its quantile,
so a tree's work hardly grows with the table. Else a level of the trees of all
quantiles takes one job, in which every task adds up its cells by (quantile, node,
column, bin). Both are whole numbers that add up in any order, and give the same trees.
A leaf's value is the exact quantile of its residuals; small leaves send them, large
ones are narrowed down by counts first. The parts of all tasks are added up and judged
in tasks too: splits, values, ranges and counts of few cells reach the driver, however
many rows there are.

Rows are kept as blocks of numbers in a persisted RDD, the one place here where
rounds of imperative work on the same partitions ask for it; what is lost is read
again from the binned table. Where cells are many, forecasts lie with the rows, and
are written every ``keep_every`` trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.folders import fresh, materialize

#: Residuals of a leaf that are sent as they are, and parts into which the range of more is cut at a time.
SENT, PARTS = 1024, 256
#: Different cells up to which they are kept sorted and their counts gathered.
MOST_CELLS = 20_000
#: Of sorted cells: rows of a block, rows from which there are more tasks, and rows that one task holds at most; cuts of a cell, and of all cells.
SORTED_ROWS, SORTED_TASK, SORTED_MOST, CUTS, ALL_CUTS = 2_000_000, 500_000, 8_000_000, 1024, 200_000
#: Residuals of a leaf of sorted cells that are sent as they are, in units of SENT: they come from the few around its quantile alone.
NEAR = 64
#: Rows of a block, and of a task: there are hundreds of short jobs, so small tables get few tasks.
BLOCK_ROWS, TASK_ROWS = 50_000, 25_000


@dataclass
class Tree:
    """Nodes in an array: column (-1 for a leaf), bin up to which a row goes left, children, value."""

    column: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.column) if c < 0]

    def split(self, node: int, column: int, at: int, gain: float) -> None:
        self.column[node], self.bin[node], self.gain[node] = column, at, gain
        self.left[node], self.right[node] = len(self.column), len(self.column) + 1
        for _ in range(2):
            for x, v in ((self.column, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
                x.append(v)

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        column, at, left, right = (np.array(x) for x in (self.column, self.bin, self.left, self.right))
        now = np.zeros(len(codes), np.int64)
        while True:
            inner = np.flatnonzero(column[now] >= 0)
            if not len(inner):
                return now
            own = now[inner]
            now[inner] = np.where(codes[inner, column[own]] <= at[own], left[own], right[own])


@dataclass
class Booster:
    columns: list[str]
    edges: list[np.ndarray]
    quantiles: tuple[float, ...]
    start: np.ndarray
    rate: float
    trees: list[list[Tree]] = field(default_factory=list)

    def forecasts(self, codes: np.ndarray) -> np.ndarray:
        out = np.repeat(self.start[:, None], len(codes), 1)
        for round_ in self.trees:
            for q, tree in enumerate(round_):
                out[q] += self.rate * np.array(tree.value)[tree.nodes(codes)]
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with q_10, q_50, ... in rising order. A missing value goes right at every split."""
        from tidewater.operators.calibrate import rising

        names = [f"q_{round(q * 100, 6):g}" for q in self.quantiles]
        kept = [c for c in df.columns if c not in names]
        inputs = []
        for i in range(len(self.columns)):
            name = f"__x{i}"
            while name in kept:
                name += "_"
            inputs.append(name)
        shared, kinds = df.sparkSession.sparkContext.broadcast(self), dict(df.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[bytes, np.ndarray] = {}  # forecasts of cells: rows of a cell have the same
            for batch in batches:
                own = shared.value
                cells, of = _distinct(coded(batch, inputs, own.edges))
                keys = [c.tobytes() for c in cells]
                if len(known) > MOST_CELLS:
                    known.clear()
                new = [i for i, key in enumerate(keys) if key not in known]
                if new:
                    known.update(zip((keys[i] for i in new), own.forecasts(cells[new]).T, strict=True))
                f = np.stack([known[key] for key in keys], 1)[:, of] if keys else np.zeros((len(names), 0))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, f)], [*kept, *names])

        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"`{c}` double" for c in names)])
        out = df.select(*kept, *[F.col(c).cast("double").alias(x) for c, x in zip(self.columns, inputs, strict=True)]).mapInArrow(run, schema)
        return out.select(*kept, *(rising(names) if len(names) > 1 else names))

    def importance(self, quantile: float = 0.5) -> list[tuple[str, float]]:
        """Columns by the summed gain of their splits in the trees of the quantile nearest to the one asked."""
        q = min(range(len(self.quantiles)), key=lambda i: abs(self.quantiles[i] - quantile))
        total = dict.fromkeys(self.columns, 0.0)
        for round_ in self.trees:
            for c, g in zip(round_[q].column, round_[q].gain, strict=True):
                if c >= 0:
                    total[self.columns[c]] += g
        return sorted(total.items(), key=lambda x: (-x[1], x[0]))


def coded(batch: pa.RecordBatch, columns: list[str], edges: list[np.ndarray]) -> np.ndarray:
    """Bins of values: as many edges as lie below them; missing ones in the last bin of all."""
    out = np.zeros((len(batch), len(columns)), np.uint8)
    for i, (c, e) in enumerate(zip(columns, edges, strict=True)):
        x = np.array(batch.column(c).to_numpy(zero_copy_only=False), float)
        out[:, i] = np.where(np.isnan(x), len(e) + 1, np.searchsorted(e, x, "left"))
    return out


def edges_of(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Upper ends of bins, the last one open: all values of a column that has at most ``bins``, else its quantiles."""
    out = []
    numbers = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    few = {c: [r[0] for r in numbers.where(F.col(c).isNotNull() & ~F.isnan(c)).select(c).distinct().limit(bins + 1).collect()] for c in numbers.columns}
    many = [c for c in numbers.columns if len(few[c]) > bins]
    ends = numbers.agg(*[F.percentile_approx(c, [k / bins for k in range(1, bins)], 10_000).alias(c) for c in many]).first() if many else {}
    for c in numbers.columns:
        values = [v for v in ends[c] or [] if v == v] if c in many else few[c]
        out.append(np.array(sorted(set(values))[: None if c in many else -1]))
    return out


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of bins in rising order, and which of them each row is."""
    if codes.shape[1] > 8:
        cells, of = np.unique(codes, axis=0, return_inverse=True)
        return cells, of.ravel()
    key = np.zeros(len(codes), np.uint64)
    for c in range(codes.shape[1]):
        key = key << np.uint64(8) | codes[:, c]
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    return codes[first], of.ravel()


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # cells, where each begins, targets, forecasts and rows above by (quantile, cell)


def _by_cell(codes: np.ndarray, y: np.ndarray, quantiles: int) -> Block:
    cells, of = _distinct(codes)
    order = np.argsort(of, kind="stable")
    start = np.r_[0, np.cumsum(np.bincount(of, minlength=len(cells)))]
    f = np.zeros((quantiles, len(cells)))
    return cells, start, y[order], f, _above(y[order], start, f)


def _reduced(parts: RDD, add, finish=lambda whole: whole):
    """``finish`` of the parts of all tasks as one: a task adds them up, many are added up by groups before, and only what it makes of them is sent to the driver."""
    n = parts.getNumPartitions()
    if n == 1:
        return parts.map(finish).collect()[0]
    groups = int(n**0.5) if n > 32 else 1
    if groups > 1:
        parts = parts.mapPartitionsWithIndex(lambda i, own: ((i % groups, x) for x in own)).reduceByKey(add, groups).values()
    return parts.map(lambda x: (0, x)).reduceByKey(add, 1).map(lambda x: finish(x[1])).collect()[0]


def _above(y: np.ndarray, start: np.ndarray, f: np.ndarray) -> np.ndarray:
    n = np.diff(start)
    return np.stack([np.add.reduceat((y > np.repeat(own, n)).astype(np.int64), start[:-1]) for own in f]) if len(n) else np.zeros(f.shape, np.int64)


def _cells_of(codes: RDD, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All different cells and their rows, if there are at most ``most``."""

    def merged(parts: list[tuple | None]) -> tuple | None:
        if any(p is None for p in parts):
            return None
        cells, of = _distinct(np.concatenate([p[0] for p in parts]))
        if len(cells) > most:
            return None
        return cells, np.bincount(of, np.concatenate([p[1] for p in parts]), len(cells)).astype(np.int64)  # exact below 2**53

    def own(blocks: Iterator[np.ndarray]) -> Iterator[list]:
        found: list = []
        for b in blocks:
            if found != [None]:
                cells, of = _distinct(b)
                found = [merged([*found, (cells, np.bincount(of))])]
        yield found

    whole = _reduced(codes.mapPartitions(own), lambda a, b: [merged([*a, *b])] if a and b else a or b)
    return whole[0] if whole else None


def _level(trees: list[Tree], open_nodes: list[list[int]], quantiles: tuple[float, ...], bins: int):
    """Of cells: rows, and rows above the forecast, by (quantile, open node, column, bin)."""

    def count(blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        most = max(map(len, open_nodes))
        out = None
        for cells, rows, above in blocks:
            k = cells.shape[1]
            if out is None:
                out = np.zeros((2, len(quantiles), most, k, bins), np.int64)
            for q, (tree, nodes) in enumerate(zip(trees, open_nodes, strict=True)):
                if not nodes:
                    continue
                place = np.full(len(tree.column), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[tree.nodes(cells)]
                own = at >= 0
                for c in range(k):
                    key = at[own] * bins + cells[own, c]
                    for side, weight in ((0, rows), (1, above[q])):
                        out[side, q, :, c] += np.bincount(key, weight[own], most * bins).astype(np.int64).reshape(most, bins)
        if out is not None:
            yield out

    return count


def _splits(counts: np.ndarray, quantiles: tuple[float, ...], least_leaf: int) -> list[list[tuple[float, int, int]]]:
    """The best split of each open node: (gain, column, bin); gain 0 if there is none. Ties go to the first column, then the lowest bin."""
    out = []
    for q, share in enumerate(quantiles):
        best = []
        for node in range(counts.shape[2]):
            n, above = counts[0, q, node].astype(float), counts[1, q, node].astype(float)
            pull = above - (1 - share) * n  # the summed negative gradient: share above the forecast, share - 1 below
            left_n, left = np.cumsum(n, 1)[:, :-1], np.cumsum(pull, 1)[:, :-1]
            all_n, whole = n.sum(1)[:, None], pull.sum(1)[:, None]
            right_n, right = all_n - left_n, whole - left
            fits = (left_n >= least_leaf) & (right_n >= least_leaf)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, left**2 / left_n + right**2 / right_n - whole**2 / all_n, 0.0)
            if not gain.size or gain.max() <= 1e-9:
                best.append((0.0, -1, -1))
            else:
                column, at = np.unravel_index(int(np.argmax(gain > gain.max() * (1 - 1e-12))), gain.shape)
                best.append((float(gain[column, at]), int(column), int(at)))
        out.append(best)
    return out


def _leaf_quantiles(blocks: RDD, trees: list[Tree], quantiles: tuple[float, ...], most: int, parts: int) -> list[dict[int, float]]:
    """The exact quantile of residuals of each leaf, between its two neighbours in proportion."""
    leaves = [t.leaves() for t in trees]

    def residuals(block: Block, q: int, tree: Tree) -> Iterator[tuple[int, np.ndarray]]:
        """Of a block: the residuals of each leaf."""
        cells, start, y, f, _ = block
        n = np.diff(start)
        at = np.repeat(tree.nodes(cells).astype(np.uint16), n)
        order = np.argsort(at, kind="stable")
        r = (y - np.repeat(f[q], n))[order]
        at = at[order]
        cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
        for a, b in zip(cuts, [*cuts[1:], len(at)], strict=False):
            yield int(at[a]), r[a:b]

    def extent(rows: Iterator[Block]) -> Iterator[dict]:
        out: dict = {}
        for block in rows:
            for q, tree in enumerate(trees):
                for leaf, own in residuals(block, q, tree):
                    n, low, high, sent = out.get((q, leaf), (0, np.inf, -np.inf, []))
                    n += len(own)
                    sent = None if sent is None or n > most else [*sent, own]
                    out[q, leaf] = (n, min(low, own.min()), max(high, own.max()), sent)
        yield out

    def joined(a: dict, b: dict) -> dict:
        for k, (n, low, high, sent) in b.items():
            m, l2, h2, s2 = a.get(k, (0, np.inf, -np.inf, []))
            a[k] = (n + m, min(low, l2), max(high, h2), None if sent is None or s2 is None or n + m > most else [*s2, *sent])
        return a

    def settled(found: dict) -> dict:
        """Of leaves: their rows with the value if all residuals came, else the ends of their range."""
        out = {}
        for (q, leaf), (n, low, high, sent) in found.items():
            value = None
            if sent is not None:
                r, place = np.sort(np.concatenate(sent)), (n - 1) * quantiles[q]
                a, b = int(place), min(int(place) + 1, n - 1)
                value = float(r[a] + (r[b] - r[a]) * (place - int(place)))
            out[q, leaf] = (n, float(low), float(high), value)
        return out

    found = _reduced(blocks.mapPartitions(extent), joined, settled)
    out: list[dict[int, float]] = [dict.fromkeys(own, 0.0) for own in leaves]
    wanted: dict[tuple[int, int], list[float]] = {}
    targets: dict[tuple[int, int, int], list] = {}  # (quantile, leaf, which neighbour) -> [place inside, low, high]
    for (q, leaf), (n, low, high, value) in found.items():
        place = (n - 1) * quantiles[q]
        wanted[q, leaf] = [int(place), min(int(place) + 1, n - 1), place - int(place)]
        if value is not None:
            out[q][leaf] = value
        else:
            for side in (0, 1):
                targets[q, leaf, side] = [wanted[q, leaf][side], low, high]
    values: dict[tuple[int, int, int], float] = {}
    while targets:
        now = {k: (low, high) for k, (_, low, high) in targets.items()}

        def narrow(rows: Iterator[Block], now: dict = now) -> Iterator[dict]:
            found: dict = {}
            for block in rows:
                for q, tree in enumerate(trees):
                    for leaf, r in residuals(block, q, tree):
                        for side in (0, 1):
                            if (key := (q, leaf, side)) not in now:
                                continue
                            low, high = now[key]
                            own = r[(r >= low) & (r <= high)]
                            hist = np.bincount(np.searchsorted(_cuts(low, high, parts), own, "right"), minlength=parts)
                            had = found.get(key)
                            sent = own if had is None else None if had[1] is None else np.concatenate([had[1], own])
                            found[key] = (hist if had is None else had[0] + hist, sent if sent is not None and len(sent) <= most else None)
            yield found

        def added(a: dict, b: dict) -> dict:
            for k, (hist, sent) in b.items():
                if k in a:
                    mine = a[k]
                    both = None if sent is None or mine[1] is None or len(sent) + len(mine[1]) > most else np.concatenate([mine[1], sent])
                    a[k] = (mine[0] + hist, both)
                else:
                    a[k] = (hist, sent)
            return a

        def judged(found: dict, now: dict = dict(targets)) -> dict:  # noqa: B006  as it is in this round
            """Of targets: the value, or the place within a smaller range and its ends."""
            out = {}
            for key, (hist, sent) in found.items():
                place, low, high = now[key]
                if sent is not None:
                    out[key] = float(np.sort(sent)[place])
                    continue
                before = np.cumsum(hist)
                part = int(np.searchsorted(before, place, "right"))
                ends = np.concatenate([[low], _cuts(low, high, parts), [high]])
                # A part holds its lower end; the upper one belongs to the next.
                down, up = float(ends[part]), float(ends[part + 1]) if part == parts - 1 else float(np.nextafter(ends[part + 1], -np.inf))
                out[key] = down if down >= up else [place - int(before[part] - hist[part]), down, up]
            return out

        for key, own in _reduced(blocks.mapPartitions(narrow), added, judged).items():
            if isinstance(own, list):
                targets[key] = own
            else:
                values[key] = own
                del targets[key]
    for q, leaf in {k[:2] for k in values}:
        a, b = values[q, leaf, 0], values[q, leaf, 1]
        out[q][leaf] = a + (b - a) * wanted[q, leaf][2]
    return out


def _cuts(low: float, high: float, parts: int) -> np.ndarray:
    """Inner borders of equal parts of a range, never falling."""
    return np.maximum.accumulate(np.clip(low + (high - low) * (np.arange(1, parts) / parts), low, high))


def _edge(y: np.ndarray, first: np.ndarray, end: np.ndarray, f: np.ndarray, t: np.ndarray, after: bool) -> np.ndarray:
    """Of stretches of rising targets: the first place whose residual lies at ``t`` or above, or above it alone (``after``)."""
    a, b = first.copy(), end.copy()
    while len(live := np.flatnonzero(a < b)):
        middle = (a[live] + b[live]) >> 1
        r = y[middle] - f[live]
        goes = r <= t[live] if after else r < t[live]
        a[live[goes]] = middle[goes] + 1
        b[live[~goes]] = middle[~goes]
    return a


@dataclass
class _Ask:
    """A leaf's residuals from ``low`` to ``high``, among which those at ``places`` (in the order of all of the leaf) lie."""

    quantile: int
    leaf: int
    places: tuple[int, ...]
    low: float
    high: float


class _Sorted:
    """Rows of few cells, kept by cell and in rising order of targets: what lies on one side of a number is found by bisection.

    A residual rises with its target, so a leaf's rows around a quantile are a stretch
    of each of its cells. Counts at some targets of each cell (``cuts``, ends included)
    tell the driver where that stretch lies; the rows of it decide.
    """

    def __init__(self, binned: RDD, cells: np.ndarray, rows: np.ndarray, quantiles: tuple[float, ...], sent: int, parts: int):
        self.cells, self.rows, self.quantiles, self.most, self.parts = cells, rows, quantiles, sent, parts
        self.f = np.zeros((len(quantiles), len(cells)))
        places, k = {c.tobytes(): i for i, c in enumerate(cells)}, cells.shape[1]

        def block(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            y = np.concatenate([np.frombuffer(r["y"], float) for r in parts])
            own, of = _distinct(np.concatenate([np.frombuffer(r["codes"], np.uint8) for r in parts]).reshape(len(y), k))
            return np.array([places[c.tobytes()] for c in own]), np.r_[0, np.cumsum(np.bincount(of))], y[np.lexsort((y, of))]

        def opened(found: Iterator) -> Iterator[tuple]:
            parts, n = [], 0
            for r in found:
                parts.append(r)
                n += len(r["y"]) // 8
                if n >= SORTED_ROWS:
                    yield block(parts)
                    parts, n = [], 0
            if n:
                yield block(parts)

        self.state = binned.mapPartitions(opened).persist(StorageLevel.MEMORY_AND_DISK)
        self.cuts = self._drawn(max(8, min(CUTS, ALL_CUTS // len(cells), int(rows.max()))))
        self.below, self.upto = self._counted()

    def _drawn(self, n: int) -> np.ndarray:
        """Of each cell: ``n`` of its targets in rising order, the least and the greatest among them."""

        def thinned(y: np.ndarray) -> np.ndarray:
            return y if len(y) <= n else y[np.linspace(0, len(y) - 1, n).astype(np.int64)]

        def added(a: dict, b: dict) -> dict:
            for i, y in b.items():
                a[i] = thinned(np.sort(np.concatenate([a[i], y]))) if i in a else y
            return a

        def own(blocks: Iterator[tuple]) -> Iterator[dict]:
            found: dict = {}
            for ids, start, y in blocks:
                found = added(found, {int(i): thinned(y[a:b]) for i, a, b in zip(ids, start, start[1:], strict=False)})
            yield found

        found = _reduced(self.state.mapPartitions(own), added)
        return np.stack([found[i][np.linspace(0, len(found[i]) - 1, n).astype(np.int64)] for i in range(len(self.cells))])

    def _counted(self) -> np.ndarray:
        """Of each cell and cut: rows below it, and rows up to it."""
        cuts = self.state.context.broadcast(self.cuts)

        def own(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
            out = np.zeros((2, *cuts.value.shape), np.int64)
            for ids, start, y in blocks:
                for i, a, b in zip(ids, start, start[1:], strict=False):
                    for side, of in enumerate(("left", "right")):
                        out[side, i] += np.searchsorted(y[a:b], cuts.value[i], of)
            yield out

        return _reduced(self.state.mapPartitions(own), np.add)

    def above(self) -> np.ndarray:
        """Rows above the forecast, by (quantile, cell)."""
        f = self.f

        def own(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
            out = np.zeros(f.shape, np.int64)
            for ids, start, y in blocks:
                first, end = (np.tile(x, len(f)) for x in (start[:-1], start[1:]))
                out[:, ids] += (end - _edge(y, first, end, np.zeros(len(end)), f[:, ids].ravel(), True)).reshape(len(f), -1)
            yield out

        return _reduced(self.state.mapPartitions(own), np.add)

    def counts(self):
        """``finish`` of what a level counts in the cells of all rows."""
        whole = self.cells, self.rows, self.above()
        return lambda count, finish: finish(next(count(iter([whole]))))

    def _asked(self, q: int, leaf: int, cells: np.ndarray, places: tuple[int, ...]) -> _Ask:
        """Rows below a cut have residuals up to its own, and rows from it on none below: so counts at cuts bound the places of residuals."""
        r, n = (self.cuts[cells] - self.f[q, cells, None]).ravel(), self.rows[cells, None]
        order = np.argsort(r, kind="stable")
        before = np.r_[0, np.cumsum(np.diff(np.c_[self.below[cells], n], axis=1).ravel()[order])[:-1]]  # at most so many residuals lie below
        upto = np.cumsum(np.diff(np.c_[0 * n, self.upto[cells]], axis=1).ravel()[order])  # at least so many do not lie above
        low, high = (int(np.searchsorted(before, places[0], "right")) - 1, int(np.searchsorted(upto, places[-1] + 1, "left")))
        return _Ask(q, leaf, places, float(r[order[low]]), float(r[order[high]]))

    def leaf_values(self, trees: list[Tree]) -> list[dict[int, float]]:
        """The exact quantile of residuals of each leaf, between its two neighbours in proportion."""
        nodes = np.stack([t.nodes(self.cells) for t in trees])
        out: list[dict[int, float]] = [dict.fromkeys(t.leaves(), 0.0) for t in trees]
        shares: dict[tuple[int, int], tuple[int, int, float]] = {}
        asks: list[_Ask] = []
        for q, tree in enumerate(trees):
            for leaf in tree.leaves():
                cells = np.flatnonzero(nodes[q] == leaf)
                if n := int(self.rows[cells].sum()):
                    place = (n - 1) * self.quantiles[q]
                    a, b = int(place), min(int(place) + 1, n - 1)
                    shares[q, leaf] = a, b, place - a
                    asks.append(self._asked(q, leaf, cells, (a, b)))
        values: dict[tuple[int, int, int], float] = {}
        while asks:
            for ask in asks:
                if ask.low >= ask.high:
                    values.update({(ask.quantile, ask.leaf, p): ask.low for p in ask.places})
            if asks := [a for a in asks if a.low < a.high]:
                found, asks = self._answers(asks, nodes)
                values.update(found)
        for (q, leaf), (a, b, share) in shares.items():
            low, high = values[q, leaf, a], values[q, leaf, b]
            out[q][leaf] = low + (high - low) * share
        return out

    def _answers(self, asks: list[_Ask], nodes: np.ndarray) -> tuple[dict[tuple[int, int, int], float], list[_Ask]]:
        """Values by (quantile, leaf, place), and narrower ranges of those that have more residuals than are sent."""
        f, most, parts = self.f, self.most, self.parts
        quantile, leaf, low, high = (np.array([getattr(a, c) for a in asks]) for c in ("quantile", "leaf", "low", "high"))
        of = [np.flatnonzero(quantile == q) for q in range(len(f))]

        def hist(r: np.ndarray, j: int) -> np.ndarray:
            """Of residuals in rising order: rows by part of the range; a part holds its lower end."""
            return np.diff(np.r_[0, np.searchsorted(r, _cuts(low[j], high[j], parts), "left"), len(r)])

        def counts(own: tuple, j: int) -> np.ndarray:
            return own[1] if own[2] is None else hist(np.sort(own[2]), j)

        def joined(a: dict, b: dict) -> dict:
            """(rows below the range, rows by part, residuals): either of the last two is None."""
            for j, own in b.items():
                if j not in a:
                    a[j] = own
                elif a[j][2] is None or own[2] is None or len(a[j][2]) + len(own[2]) > most:
                    a[j] = (a[j][0] + own[0], counts(a[j], j) + counts(own, j), None)
                else:
                    a[j] = (a[j][0] + own[0], None, np.concatenate([a[j][2], own[2]]))
            return a

        def own(blocks: Iterator[tuple]) -> Iterator[dict]:
            found: dict = {}
            for ids, start, y in blocks:
                here: dict = {}
                for q, js in enumerate(of):
                    j, i = np.nonzero(nodes[q, ids] == leaf[js, None])
                    j, g = js[j], f[q, ids[i]]
                    first = _edge(y, start[i], start[i + 1], g, low[j], False)
                    end = _edge(y, first, start[i + 1], g, high[j], True)
                    for x in np.split(np.arange(len(j)), np.flatnonzero(np.diff(j)) + 1):
                        if not len(x):
                            continue
                        ask, before = int(j[x[0]]), int((first[x] - start[i[x]]).sum())
                        stretches = [y[first[at] : end[at]] - g[at] for at in x]
                        if sum(map(len, stretches)) > most:
                            here[ask] = (before, sum(hist(r, ask) for r in stretches), None)
                        else:
                            here[ask] = (before, None, np.concatenate(stretches))
                found = joined(found, here)
            yield found

        def judged(found: dict) -> tuple[dict, list[_Ask]]:
            values, left = {}, []
            for j, (before, hist, sent) in found.items():
                ask = asks[j]
                if sent is not None:
                    sent = np.sort(sent)
                    values.update({(ask.quantile, ask.leaf, p): float(sent[p - before]) for p in ask.places})
                    continue
                upto = before + np.cumsum(hist)
                ends = np.concatenate([[ask.low], _cuts(ask.low, ask.high, parts), [ask.high]])
                by_part: dict[int, list[int]] = {}
                for p in ask.places:
                    by_part.setdefault(int(np.searchsorted(upto, p, "right")), []).append(p)
                for part, places in by_part.items():
                    # A part holds its lower end; the upper one belongs to the next.
                    up = float(ends[part + 1]) if part == parts - 1 else float(np.nextafter(ends[part + 1], -np.inf))
                    left.append(_Ask(ask.quantile, ask.leaf, tuple(places), float(ends[part]), up))
            return values, left

        return _reduced(self.state.mapPartitions(own), joined, judged)

    def move(self, trees: list[Tree], rate: float) -> None:
        """Forecasts take a step."""
        self.f = np.stack([self.f[q] + rate * np.array(t.value)[t.nodes(self.cells)] for q, t in enumerate(trees)])

    def close(self) -> None:
        self.state.unpersist()


def fit(df: DataFrame, columns: list[str], y: str, quantiles: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95), *, trees: int = 100, depth: int = 5, leaves: int = 31, rate: float = 0.1, bins: int = 64, least_leaf: int = 20, keep_every: int = 50, partitions: int | None = None, sent: int = SENT, parts: int = PARTS, most_cells: int = MOST_CELLS) -> Booster:
    """Fit the trees of all quantiles side by side.

    The first forecast is the exact quantile of all targets. A leaf has ``least_leaf``
    rows at least. Rows with a null or infinite target are left out; missing values of
    columns have a bin of their own, beyond all others. A column with one value is
    never split. An empty table is an error. ``sent`` and ``parts`` bound what a leaf
    sends at once: its residuals, or the counts of parts of their range.
    """
    if not quantiles or not all(0 < q < 1 for q in quantiles) or bins > 250:
        raise ValueError("quantiles lie between 0 and 1, and there are at most 250 bins")
    quantiles = tuple(sorted(quantiles))
    spark = df.sparkSession
    target = F.col(y).cast("double")
    rows = df.where(F.abs(target) < float("inf")).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], target.alias("y"))
    names = [f"x{i}" for i in range(len(columns))]
    edges = edges_of(rows, names, bins)
    width = max(map(len, edges), default=0) + 2

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), BLOCK_ROWS):
                own = batch.slice(a, BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([coded(own, names, edges).tobytes()]), pa.array([np.array(own.column("y").to_numpy(zero_copy_only=False), float).tobytes()])], ["codes", "y"])

    total = rows.count()
    if not total:
        raise ValueError("no rows to fit")
    tasks = partitions or min(spark.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    dealt = rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows  # one small file is one task else
    binned = materialize(dealt.mapInArrow(blocks_of, "codes binary, y binary"), "binned")
    k = len(columns)

    def opened(r) -> Block:
        y = np.frombuffer(r["y"], float)
        return _by_cell(np.frombuffer(r["codes"], np.uint8).reshape(len(y), k), y, len(quantiles))

    blocks = binned.rdd
    codes = binned.select("codes", F.octet_length("y").alias("size")).rdd.map(lambda r: np.frombuffer(r["codes"], np.uint8).reshape(r["size"] // 8, k))
    if (found := _cells_of(codes, most_cells) if most_cells > 0 else None) is not None:
        few = partitions or max(min(spark.sparkContext.defaultParallelism, -(-total // SORTED_TASK)), -(-total // SORTED_MOST))
        own = _Sorted(blocks.coalesce(min(blocks.getNumPartitions(), few)), *found, quantiles, sent * NEAR, parts)
    else:
        state = blocks.coalesce(min(blocks.getNumPartitions(), max(tasks, -(-total // TASK_ROWS)))).map(opened).persist(StorageLevel.MEMORY_AND_DISK)
        own = _Spread(spark, state, quantiles, sent, parts, keep_every)
    begin = [values[0] for values in own.leaf_values([Tree() for _ in quantiles])]
    model = Booster(columns, edges, quantiles, np.array(begin), rate)
    own.move([Tree(value=[float(v)]) for v in begin], 1.0)
    for number in range(trees):
        count = own.counts()
        grown = [Tree() for _ in quantiles]
        open_nodes = [[0] for _ in quantiles]
        for _ in range(depth):
            if not any(open_nodes):
                break
            splits = count(_level(grown, open_nodes, quantiles, width), lambda counts: _splits(counts, quantiles, least_leaf))
            for q, best in enumerate(splits):
                after = []
                room = leaves - len(grown[q].leaves())
                for (gain, column, at), node in sorted(zip(best, open_nodes[q], strict=False), key=lambda x: (-x[0][0], x[1])):
                    if column >= 0 and room > 0:
                        grown[q].split(node, column, at, gain)
                        after += [grown[q].left[node], grown[q].right[node]]
                        room -= 1
                open_nodes[q] = sorted(after)
        for tree, values in zip(grown, own.leaf_values(grown), strict=True):
            for leaf, value in values.items():
                tree.value[leaf] = value
        model.trees.append(grown)
        if number + 1 < trees:
            own.move(grown, rate)
    own.close()
    return model


class _Spread:
    """Rows of many cells: forecasts and counts lie with the rows, and every step reads them all."""

    def __init__(self, spark: SparkSession, state: RDD, quantiles: tuple[float, ...], sent: int, parts: int, keep_every: int):
        self.spark, self.state, self.last, self.steps = spark, state, None, 0
        self.quantiles, self.most, self.parts, self.keep_every = quantiles, sent, parts, keep_every

    def counts(self):
        def judged(count, finish):
            out = _reduced(self.state.map(lambda b: (b[0], np.diff(b[1]), b[4])).mapPartitions(count), np.add, finish)
            self._drop()
            return out

        return judged

    def leaf_values(self, trees: list[Tree]) -> list[dict[int, float]]:
        return _leaf_quantiles(self.state, trees, self.quantiles, self.most, self.parts)

    def move(self, trees: list[Tree], rate: float) -> None:
        self._drop()
        moved = _moved(self.state, trees, rate)
        if self.steps and self.steps % self.keep_every == 0:
            path = fresh(self.spark, "forecasts")
            moved.saveAsPickleFile(path)
            moved.unpersist()
            moved = self.spark.sparkContext.pickleFile(path).persist(StorageLevel.MEMORY_AND_DISK)
        self.state, self.last, self.steps = moved, self.state, self.steps + 1

    def _drop(self) -> None:
        """The forecasts before the last step go once counts have read those that were made of them."""
        if self.last is not None:
            self.last.unpersist()
            self.last = None

    def close(self) -> None:
        self._drop()
        self.state.unpersist()


def _moved(state: RDD, trees: list[Tree], rate: float) -> RDD:
    """Blocks whose forecasts have taken a step."""

    def step(block: Block) -> Block:
        cells, start, y, f, _ = block
        f = np.stack([f[q] + rate * np.array(t.value)[t.nodes(cells)] for q, t in enumerate(trees)])
        return cells, start, y, f, _above(y, start, f)

    return state.map(step).persist(StorageLevel.MEMORY_AND_DISK)
