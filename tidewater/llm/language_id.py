"""Language of a text by a small convolutional network over bytes, trained and applied with numpy.

Bytes are embedded; filters of several widths run over a window of fixed length,
each filter keeps its maximum, and a softmax layer reads the maxima. A document's
windows cover all its bytes, and its prediction is the mean of theirs, weighted
by the bytes in each. Training takes whole texts of a bounded number of labelled
documents; prediction takes every byte of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import text as T
from tidewater.llm.storage import materialize

#: Predicted where there is nothing to judge.
UNDETERMINED = "und"


@dataclass
class ByteCNN:
    """Embedding (256, e), filters (most * e, f) with zeros where a width is less than the most, bias, and the softmax layer."""

    window: int
    most: int
    labels: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def _columns(self, codes: np.ndarray) -> np.ndarray:
        """Embedded bytes of each position and its followers, (windows * positions, most * e)."""
        x = self.embed[codes]
        n, width, e = x.shape
        return np.concatenate([x[:, j : width - self.most + 1 + j] for j in range(self.most)], axis=2).reshape(-1, self.most * e)

    def pooled(self, codes: np.ndarray) -> np.ndarray:
        """The filters' maxima of each window of codes (windows, window)."""
        return (self._columns(codes) @ self.filters).reshape(len(codes), -1, self.filters.shape[1]).max(axis=1) + self.bias

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return _softmax(np.maximum(self.pooled(codes), 0) @ self.out + self.out_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows over every byte: codes, row of each window, and bytes in it.

    A-Z are lower-cased. A last window that is not full is padded with spaces;
    an empty document has no window.
    """
    n = np.diff(offsets)
    per = -(-n // window)
    row = np.repeat(np.arange(len(n)), per)
    at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = offsets[:-1][row] + at * window
    length = np.minimum(n[row] - at * window, window)
    place = begin[:, None] + np.arange(window)[None, :]
    codes = _FOLD[np.r_[data, np.uint8(32)]][np.minimum(place, len(data))]
    codes[np.arange(window)[None, :] >= length[:, None]] = 32
    return codes, row, length


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def train(texts: list[str], labels: list[str], *, window: int = 256, widths: tuple[int, ...] = (2, 3, 4), filters: int = 8, embed: int = 8, epochs: int = 3, least_steps: int = 600, batch: int = 128, rate: float = 0.004, seed: int = 7) -> ByteCNN:
    """Fit by Adam on every window of the texts, each label weighing the same.

    A small sample is gone through more often, for ``least_steps`` steps.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    parts = []
    for a in range(0, len(texts), 200):  # windows of few texts at once: their places take 8 bytes a byte
        codes, row, length = windows(*T.raw(pa.array(texts[a : a + 200], pa.large_string())), window)
        parts.append((codes, row + a, length))
    codes, row, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    target = np.searchsorted(names, np.array(labels))[row]
    share = np.bincount(target, minlength=len(names))
    weight = (len(target) / (len(names) * np.maximum(share, 1)))[target].astype(np.float32)
    # Short windows come up too: a part of them is cut to a random length.
    cut = rng.random(len(codes)) < 0.3
    codes[cut] = np.where(np.arange(window)[None, :] < rng.integers(16, window, cut.sum())[:, None], codes[cut], 32)
    most, f = max(widths), filters * len(widths)
    live = np.concatenate([np.repeat(np.arange(most) < w, embed) for w in widths for _ in range(filters)]).reshape(f, -1).T
    model = ByteCNN(window, most, names, rng.normal(0, 0.5, (256, embed)).astype(np.float32), (rng.normal(0, 0.3, live.shape) * live).astype(np.float32), np.zeros(f, np.float32), rng.normal(0, 0.3, (f, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    parts = [model.embed, model.filters, model.bias, model.out, model.out_bias]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(max(epochs, -(-least_steps // max(1, len(codes) // batch)))):
        for own in np.array_split(rng.permutation(len(codes)), max(1, len(codes) // batch)):
            x = model._columns(codes[own])
            z = (x @ model.filters).reshape(len(own), -1, f)
            best = z.argmax(axis=1)
            pooled = np.take_along_axis(z, best[:, None], 1)[:, 0] + model.bias
            hidden = np.maximum(pooled, 0)
            wrong = _softmax(hidden @ model.out + model.out_bias)
            wrong[np.arange(len(own)), target[own]] -= 1
            wrong *= weight[own, None] / len(own)
            back = (wrong @ model.out.T) * (pooled > 0)
            rows = (np.arange(len(own))[:, None] * z.shape[1] + best).ravel()
            d_filters = np.zeros_like(model.filters)
            seen = x[rows].reshape(len(own), f, -1)
            d_filters += np.einsum("nf,nfk->kf", back, seen)
            d_embed = np.zeros_like(model.embed)
            down = (back[:, :, None] * model.filters.T[None]).reshape(len(own), f, most, embed)
            byte = codes[own][np.arange(len(own))[:, None, None], best[:, :, None] + np.arange(most)]
            np.add.at(d_embed, byte.ravel(), down.reshape(-1, embed))
            step += 1
            for p, g, m, v in zip(parts, [d_embed, d_filters * live, back.sum(0), hidden.T @ wrong, wrong.sum(0)], first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fit(labelled: DataFrame, *, text: str = "text", label: str = "lang", most_documents: int = 500, most_bytes: int = 1 << 26, seed: int = 7, **options) -> ByteCNN:
    """Train on at most ``most_documents`` different whole texts of each label, of ``most_bytes`` together: those that hash lowest.

    Rows with a null or empty text or label teach nothing. The sample has fixed
    bounds, is drawn from all rows, and does not depend on their order or on how often a
    text stands there: equal texts count once, under the first of their labels in
    order. A label whose lowest text alone has more than ``most_bytes`` teaches by that text.
    Without such rows the model knows no language. The driver holds the sample's texts.
    """
    from pyspark.sql import Window

    h, size = F.xxhash64("text", F.lit(seed)).alias("h"), F.octet_length("text").alias("size")
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("label")).where("length(text) > 0 and label is not null")
    # Different texts are told apart by hash, so that no text moves before it is chosen.
    different = materialize(rows.select(h, size, "label").groupBy("h", "size").agg(F.min("label").alias("label")), "different-texts")
    low = F.pmod("h", F.lit(1 << 20))
    lowest = Window.partitionBy("label").orderBy(low, "h", "size")
    counts = different.groupBy("label").agg(F.count("*").alias("n"))  # a row a label
    ranked = lambda some: some.withColumn("at", F.row_number().over(lowest)).where(F.col("at") <= most_documents)
    # A threshold that leaves about four times as many as are wanted spares the rest the ranking; if it leaves too few, all are ranked.
    near = different.join(F.broadcast(counts), "label").where(low < F.ceil(4.0 * most_documents / F.col("n") * (1 << 20)))
    chosen = materialize(ranked(near), "chosen-texts")
    found = chosen.groupBy("label").agg(F.count("*").alias("got"))
    if not counts.join(found, "label", "left").where(F.coalesce("got", F.lit(0)) < F.least("n", F.lit(most_documents))).isEmpty():
        chosen = ranked(different)
    chosen = chosen.withColumn("bytes", F.sum("size").over(lowest)).where((F.col("bytes") <= most_bytes) | (F.col("at") == 1)).select("h", "size", F.col("label").alias("own"))
    got = rows.select("text", h, size).join(F.broadcast(chosen), ["h", "size"]).select("own", "h", "text").distinct().orderBy("own", "h", "text").collect()
    if not got:
        return ByteCNN(1, 1, [], *[np.zeros(0, np.float32)] * 5)
    return train([r["text"] for r in got], [r["own"] for r in got], seed=seed, **options)


def predict(docs: DataFrame, model: ByteCNN, *, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with columns lang_pred and score (the mean probability of that language, 0 to 1).

    A null text or one without a letter is ``und`` with score 0, as is all else if
    the model knows no language. Columns of these
    names are replaced, others stay. Ties go to the label first in order. A text of
    any length is read whole, 32 windows at a time; repeated rows are judged each.
    An empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in (prediction, score)]
    kinds = dict(docs.dtypes)
    if not model.labels:
        return docs.select(*others, F.lit(UNDETERMINED).alias(prediction), F.lit(0.0).alias(score))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + [f"`{prediction}` string", f"`{score}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn: ByteCNN = shared.value
        names = np.array([*cnn.labels, UNDETERMINED], object)
        for batch in batches:
            for part in T.small_batches(batch, text):
                column = part.column(text).combine_chunks()
                codes, row, length = windows(*T.raw(column), cnn.window)
                total = np.zeros((len(part), len(cnn.labels)))
                for a in range(0, len(codes), 32):
                    p = cnn.probabilities(codes[a : a + 32]) * length[a : a + 32, None]
                    np.add.at(total, row[a : a + 32], p)
                total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
                best = total.argmax(axis=1)
                spoken = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                best[~spoken] = len(cnn.labels)
                value = np.where(spoken, np.minimum(total.max(axis=1, initial=0.0), 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in others), pa.array(names[best].tolist(), pa.string()), pa.array(value)], [*others, prediction, score])

    return docs.select(*others).mapInArrow(run, schema)


def held_out(key: str, folds: int, fold: int):
    """Rows whose crc32 of the key's decimal text has the remainder ``fold``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))
