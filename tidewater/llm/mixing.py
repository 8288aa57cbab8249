"""Mixing domains to target weights when the domain of a document is not known.

A softmax classifier over hashed words, trained on a labelled table, gives every
document a posterior over domains. Document rates r >= 0 are then chosen so that
the expected tokens of each domain, sum of r * tokens * posterior, match the
targets: least squares by projected gradient. A step needs one number a domain
from the corpus, which Spark sums; a document's rate follows from its own
posterior and those numbers, so no document meets another.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import text as T
from tidewater.llm.storage import materialize


def hashed_words(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each word of each text, and words of each row."""
    words = T.words(*T.raw(column))
    return words.row(), (words.hashes(fold=True) % np.uint64(buckets)).astype(np.int64), np.diff(words.first)


def posterior(column: pa.Array, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Domain probabilities of each text and its number of words."""
    row, bucket, n = hashed_words(column, len(weights))
    score = np.stack([np.bincount(row, weights[bucket, k], len(n)) for k in range(weights.shape[1])], axis=1) / np.sqrt(np.maximum(n, 1))[:, None] + bias
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True), n


def sample(labelled: DataFrame, *, text: str, domain: str, most: int, seed: int) -> tuple[list[str], list[str]]:
    """At most ``most`` different labelled texts, those that hash lowest, whatever their domain: shares among different texts stay as they are. Null domains are left out."""
    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(domain).alias("domain")).where("domain is not null")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(seed)))
    chosen = _lowest(rows.select("h", "domain"), most, "h", "domain")  # no text moves before it is chosen
    got = rows.join(F.broadcast(chosen), ["h", "domain"]).select("domain", "text").distinct().orderBy("domain", "text").collect()
    return [r["text"] for r in got], [r["domain"] for r in got]


def _lowest(rows: DataFrame, most: int, h: str, tie: str) -> DataFrame:
    """The ``most`` different (h, tie) whose hash is lowest; every task keeps its own ``most`` first."""
    return rows.select(h, tie).distinct().orderBy(F.pmod(h, F.lit(1 << 20)), h, tie).limit(most)


def sample_keys(labels: DataFrame, *, key: str, domain: str, most: int, seed: int = 1) -> DataFrame:
    """Of narrow labels (key, domain; of several domains of a key the first in order) at most ``most``, those whose keys hash lowest: a bounded table, so texts can be joined to it without a shuffle."""
    rows = labels.select(F.col(key).alias("key"), F.col(domain).alias("domain")).where("key is not null and domain is not null").groupBy("key").agg(F.min("domain").alias("domain"))
    h = F.xxhash64("key", F.lit(seed))
    return rows.orderBy(F.pmod(h, F.lit(1 << 20)), h, "key").limit(most).select(F.col("key").alias(key), F.col("domain").alias(domain))


def train(texts: list[str], domains: list[str], *, buckets: int = 1 << 14, epochs: int = 120, rate: float = 0.3, decay: float = 1e-4) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Softmax regression by Adam over all texts at once: (domains, weights, bias)."""
    names = sorted(set(domains))
    target = np.searchsorted(names, np.array(domains))
    rows, hashed, counts = [], [], []
    for a in range(0, len(texts), 200):  # hashing takes some 40 bytes a byte of text
        r, b, c = hashed_words(pa.array(texts[a : a + 200], pa.large_string()), buckets)
        rows.append((r + a).astype(np.int32))
        hashed.append(b.astype(np.int32))
        counts.append(c)
    row, bucket, n = np.concatenate(rows), np.concatenate(hashed), np.concatenate(counts)
    value = 1 / np.sqrt(np.maximum(n, 1))[row]
    weights, bias = np.zeros((buckets, len(names))), np.zeros(len(names))
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    share = np.bincount(target, minlength=len(names)) / len(target)
    bias += np.log(share)
    for step in range(1, epochs + 1):
        z = np.stack([np.bincount(row, weights[bucket, k] * value, len(n)) for k in range(len(names))], axis=1) + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), target] -= 1
        p /= len(p)
        g = np.stack([np.bincount(bucket, p[row, k] * value, buckets) for k in range(len(names))], axis=1) + decay * weights
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= rate * p.sum(axis=0)
    return names, weights, bias


def domain_posteriors(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], *, text: str, tokens: str, into: str) -> DataFrame:
    """``docs`` with its number of words and array of domain probabilities."""
    names, weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))
    others = [c for c in docs.columns if c not in (tokens, into)]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.small_batches(batch, text):
                p, n = posterior(part.column(text), *shared.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in others), pa.array(n, pa.int64()), lists], [*others, tokens, into])

    return docs.select(*others).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in others] + [f"`{tokens}` long", f"`{into}` array<double>"]))


def rate_of(p: Column, steps: list[np.ndarray]) -> Column:
    """A document's rate after the steps taken: from 1, each step moves it and the projection holds it at 0 or more."""
    out = F.lit(1.0)
    if steps:
        moves = F.transform(F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps]), lambda s: reduce(lambda a, b: a + b, [p[k] * s[k] for k in range(len(steps[0]))]))
        out = F.aggregate(moves, F.lit(1.0), lambda r, move: F.greatest(F.lit(0.0), r - move))
    return out


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, text: str = "text", domain: str = "domain", total: float = 1.0, whole: str | None = None, most_labelled: int = 4_000, rounds: int = 40, tolerance: float = 1e-3, seed: int = 11, tokens: str = "n_tokens", posteriors: str = "posteriors", rate: str = "rate") -> DataFrame:
    """``docs`` with columns n_tokens, posteriors (array by domain name in order) and rate.

    ``targets`` weighs every domain of ``labelled`` (text, domain); missing ones get
    0. Rates bring the expected tokens of domain k to
    ``total`` * all tokens * target k, as near as rates of 0 or more can. The
    distance is taken relative to all tokens and a document's step does not
    depend on its length. Documents without words have the prior as posterior,
    weigh nothing, and get a rate all the same. Without a labelled text there is
    one domain and every rate is ``total``. If a domain ``whole`` is named,
    ``total`` is raised until its goal is a tenth above what it has: its own
    documents then get rates over 1. Repeated rows get equal rates; an
    empty table gives no rows. Columns of the new names are replaced. At most
    ``most_labelled`` whole texts are learned from, in the shares that the table
    has. The column of posteriors has the names of its domains in its metadata,
    and how far each one's total stays from its goal, as a share of all tokens.

    A step that makes the miss larger is halved, and at last replaced by one along
    the plain gradient. Rates that get no nearer are final, even if targets cannot
    be met; a warning then tells the miss.
    """
    texts, domains = sample(labelled, text=text, domain=domain, most=most_labelled, seed=seed)
    model = train(texts, domains) if texts else ([""], np.zeros((1, 1)), np.zeros(1))
    names = model[0]
    scored = materialize(domain_posteriors(docs, model, text=text, tokens=tokens, into=posteriors), "posteriors")
    own = scored.where(F.col(tokens) > 0).select(F.col(tokens).cast("double").alias("n"), F.col(posteriors).alias("p"))
    k = len(names)
    p = F.col("p")
    have = list(own.agg(F.sum("n"), *[F.sum(F.col("n") * p[i]) for i in range(k)]).first())
    steps: list[np.ndarray] = []
    miss = np.zeros(k)
    if have[0]:
        held = np.array(have[1:]) / have[0]
        weight = np.array([max(0.0, targets.get(x, 0.0)) for x in names])
        goal = total * weight / weight.sum() if weight.any() else total * held
        if whole in names and goal[names.index(whole)]:
            goal *= max(1.0, 1.1 * held[names.index(whole)] / goal[names.index(whole)])
        best, before, bound, tries = np.inf, np.zeros(k), None, 0
        for _ in range(rounds):
            rated = own.select("n", "p", rate_of(p, steps).alias("r"))
            free = F.when(F.col("r") > 0, F.col("n")).otherwise(0.0)
            sums = list(rated.agg(*[F.sum(F.col("n") * p[i] * F.col("r")) for i in range(k)], *[F.sum(free * p[i] * p[j]) for i in range(k) for j in range(k)]).first())
            miss = np.array(sums[:k]) / have[0] - goal
            gram = np.array(sums[k:]).reshape(k, k) / have[0]
            bound = np.linalg.eigvalsh(gram)[-1] if bound is None else bound  # of all rows, which all begin at 1
            size = np.linalg.norm(miss)
            if np.abs(miss).max() < tolerance:
                break
            if size >= best:  # too far: half as far, and then along the plain gradient, which cannot be worse
                tries += 1
                if tries > 3:
                    steps.pop()
                    miss = before
                    break
                steps[-1] = steps[-1] / 2 if tries < 3 else before / bound
                continue
            if best - size < 1e-3 * best:
                break
            best, before, tries = size, miss, 0
            # The gradient in the metric of the rows that can still move: exact where the projection holds no further row.
            steps.append(np.linalg.solve(gram + 1e-6 * np.eye(k), miss))
        if np.abs(miss).max() >= tolerance:
            warnings.warn(f"targets missed by up to {np.abs(miss).max():.4f} of all tokens", stacklevel=2)
    scored = scored.withColumn(posteriors, F.col(posteriors).alias(posteriors, metadata={"domains": names, "miss": list(map(float, miss))}))
    return scored.withColumn(rate, rate_of(F.col(posteriors), steps))


def draw(key: str, seed: int = 5) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def copies(docs: DataFrame, key: str, rate: str = "rate", seed: int = 5) -> DataFrame:
    """Each row as often as its rate says: the whole part, and one more with the rest as probability, by a hash of the key.

    Equal keys share their draw. A rate that is null counts as 0; a null key has a draw of its own.
    """
    n = F.floor(F.coalesce(F.col(rate), F.lit(0.0)) + draw(key, seed)).cast("int")
    own = "__copies"
    while own in docs.columns:
        own += "_"
    return docs.withColumn(own, n).where(F.col(own) > 0).withColumn(own, F.explode(F.sequence(F.lit(1), own))).drop(own)


def posterior_of(mixed: DataFrame, name: str, posteriors: str = "posteriors") -> Column:
    """The posterior of one domain of what mix() returned; 0 if no labelled text has it."""
    names = mixed.schema[posteriors].metadata["domains"]
    return F.col(posteriors)[names.index(name)] if name in names else F.lit(0.0)


def thin(docs: DataFrame, key: str, rate: str = "rate", seed: int = 5, keep: Column | None = None) -> DataFrame:
    """Rows kept with probability min(1, rate), by a hash of the key; a row with a rate of 1 or more, or that ``keep`` names, stays, once."""
    stays = draw(key, seed) < F.coalesce(F.col(rate), F.lit(0.0))
    return docs.where(stays if keep is None else stays | keep)
