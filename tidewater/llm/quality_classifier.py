"""Quality scores by ridge regression on random Fourier features, with isotonic calibration.

Document statistics are standardised and mapped to cosines of random
projections, whose inner products approximate a Gaussian kernel. Each partition
sums its rows' normal equations; Spark adds the sums, and the driver solves a
system whose size is the number of features. Scores of labelled rows kept from
that fit are counted by score step and pooled to a rising function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import quality_rules
from tidewater.llm.storage import materialize

#: Steps that scores are counted by for calibration.
STEPS = 400


def inputs() -> dict[str, Column]:
    """What the kernel sees of the statistics, on scales that compare."""
    named = quality_rules.features()
    return named | {"words": F.log1p(named["words"]), "duplicate_lines": F.log1p(named["duplicate_lines"]), "symbols": F.least(named["symbols"], F.lit(5.0)), "marks": F.least(named["marks"], F.lit(5.0)), "word_length": F.least(named["word_length"], F.lit(40.0))}


@dataclass
class FourierRidge:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores, rising
    values: np.ndarray  # calibrated scores at these

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising function nearest to y at rising x, as its corner points."""
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([b, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, _, last = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * n) / (blocks[-1][1] + n), blocks[-1][1] + n, blocks[-1][2], last]
    points = sorted({(p, b[0]) for b in blocks for p in (b[2], b[3])})
    return np.array([p for p, _ in points]), np.array([v for _, v in points])


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])


def fit(labelled: DataFrame, *, calibrate: Column, label: str = "label", size: int = 96, width: float = 2.0, ridge: float = 1e-2, seed: int = 3) -> FourierRidge:
    """Fit on ``labelled``: columns of inputs(), ``label`` (0 or 1), and ``calibrate``, true for rows kept for calibration.

    All labelled rows count; null labels teach nothing. Rows with one label only,
    or none, give a constant score (the mean label, 0.5 without rows).
    """
    spark = labelled.sparkSession
    names = list(inputs())
    d = len(names)
    rows = materialize(labelled.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in names], F.col(label).cast("double").alias("y"), calibrate.alias("held")), "kernel-rows")
    first = rows.where("not held").agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(0, 1 / width, (d, size)), rng.uniform(0, 2 * np.pi, size)
    constant = FourierRidge(np.zeros(d), np.ones(d), directions, phases, np.zeros(size + 1), np.array([0.0]), np.array([0.5 if first["y"] is None else first["y"]]))
    if not first["n"] or first["y"] in (0.0, 1.0):
        return constant
    model = FourierRidge(np.array([first[f"m_{c}"] for c in names]), np.maximum([first[f"s_{c}"] for c in names], 1e-6), directions, phases, np.zeros(size + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    shared = spark.sparkContext.broadcast(model)
    upper = np.triu_indices(size + 1)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]) + size + 1)
        for batch in batches:
            z, y = shared.value.features(_matrix(batch, names)), batch.column("y").to_numpy()
            total += np.r_[(z.T @ z)[upper], z.T @ y]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "part"])

    sums = rows.where("not held").drop("held").mapInArrow(equations, "at long, part double").groupBy("at").agg(F.sum("part").alias("total"))
    total = np.zeros(len(upper[0]) + size + 1)
    for r in sums.collect():  # size * size / 2 rows
        total[r["at"]] = r["total"]
    gram = np.zeros((size + 1, size + 1))
    gram[upper] = total[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    penalty = ridge * first["n"] / size * np.eye(size + 1)
    penalty[-1, -1] = 1e-9  # the constant is free
    model.weights = np.linalg.solve(gram + penalty, total[len(upper[0]) :])
    held = score(rows.where("held"), model, "s", raw=True).groupBy(F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("s"))) * STEPS).alias("at")).agg(F.avg("s").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("at").collect()
    if held:
        model.steps, model.values = isotonic(*(np.array([r[c] for r in held], float) for c in ("x", "y", "n")))
    return model


def score(rows: DataFrame, model: FourierRidge, into: str, raw: bool = False) -> DataFrame:
    """``rows`` with a column of scores, calibrated unless ``raw``."""
    names = list(inputs())
    others = [c for c in rows.columns if c != into]
    kinds = dict(rows.dtypes)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, names)
            got = shared.value.raw(x) if raw else shared.value.score(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(got)], [*others, into])

    return rows.select(*others).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in others] + [f"`{into}` double"]))


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", teach: Column | None = None, calibrate: Column | None = None, threshold: float = 0.3, **options) -> DataFrame:
    """(key, score, predicted) for every row of ``docs``: score in 0 to 1, predicted 1 from ``threshold`` on.

    Learns from rows of ``labels`` whose key ``teach`` admits; a quarter of those
    (by hash, or by ``calibrate``) is kept for calibration. Empty and null texts
    are scored by their statistics, all 0. Null keys learn nothing but are scored.
    Rows that repeat a key are scored each, texts of any length whole; several labels of a
    key all count. An empty table gives no rows; other columns, also those named
    as inputs(), are not read.
    """
    stats = quality_rules.statistics(docs, text=text, key=key)
    rows = materialize(stats.select(key, *[v.alias(k) for k, v in inputs().items()]), "inputs")
    kept = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(4)) == 0 if calibrate is None else calibrate
    known = rows.join(labels.select(key, F.col(label).alias("label")), key)
    known = known.where(teach) if teach is not None else known
    model = fit(known, calibrate=kept, **options)
    return score(rows, model, "score").select(key, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

