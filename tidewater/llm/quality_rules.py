"""Quality rules: ordered threshold rules learned from labelled statistics of texts.

The statistics are column expressions. A rule is a conjunction of thresholds,
grown one condition at a time by information gain on two thirds of the labelled
rows and pruned on the others (sequential covering); rows that a rule covers
leave, and the next rule is grown from the rest. The list becomes one CASE
expression. Learning reads counts by bin, which Spark sums; DataFrame operations
only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.storage import materialize

WORD_END = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    """Characters of the text that are none of these."""
    return F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words in ``size``-word windows that stand in the text twice or more; windows are compared by 64-bit hash."""
    hashes = F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda x, i: F.when(i + 1 < F.size(at), F.least(F.lit(size), F.get(at, i + 1) - x)).otherwise(F.lit(size)))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    def equal(s: Column) -> Column:
        """Positions whose hash has a neighbour of the same value in sorted order."""
        twin = F.transform(s, lambda x, i: F.when((F.get(s, i + 1)["h"] == x["h"]) | F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(False), x["i"]))
        return let(F.sort_array(F.filter(twin, lambda x: x.isNotNull())), covered)

    def some(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(placed), equal))

    return let(hashes, some)


def statistics(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_digits, n_marks), all long.

    Of whole texts, however long; a null text has no words. n_marks counts ``!``
    and ``?``. Each row is counted by itself, repeated ones too, and an empty table
    gives no rows. Other columns are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(
        F.filter(F.split(whole, WORD_END, -1), lambda x: x != ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    rows = docs.select(F.col(key), F.length(whole).alias("n"), whole.alias("x"), counted.alias("w"), let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"))
    x = F.col("x")
    return rows.select(
        F.col(key),
        F.col("w.n_words"),
        _without(x, _SPACES).cast("long").alias("word_chars"),
        (F.col("n") - _without(x, "#*$%&|<>")).cast("long").alias("n_symbols"),
        "n_dup_lines",
        F.col("w.n_repeat_words"),
        (F.col("n") - _without(x, _UPPER)).cast("long").alias("n_upper"),
        (F.col("n") - _without(x, "0123456789")).cast("long").alias("n_digits"),
        (F.col("n") - _without(x, "!?")).cast("long").alias("n_marks"),
    )


def features() -> dict[str, Column]:
    """What rules ask of the statistics, by name."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbols": F.col("n_symbols") / n,
        "duplicate_lines": F.col("n_dup_lines").cast("double"),
        "repeats": F.col("n_repeat_words") / n,
        "capitals": F.col("n_upper") / chars,
        "digits": F.col("n_digits") / chars,
        "marks": F.col("n_marks") / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # at least the threshold, else below it
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a row that none fits is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def which(self) -> Column:
        """The first rule that fits, as text, else null; of columns named as features()."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            fits = reduce(lambda a, b: a & b, [c.column() for c in rule])
            out = F.when(fits, F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gained by covering p and n instead of p0 and n0."""
    return p * (math.log2((p + 0.5) / (p + n + 1)) - math.log2((p0 + 0.5) / (p0 + n0 + 1))) if p else 0.0


def learn(stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", bins: int = 24, most_rules: int = 8, most_conditions: int = 4, most_rows: int = 200_000, min_precision: float = 0.75, min_cover: int = 3) -> DecisionList:
    """Rules for label 0 from ``stats`` joined with ``labels``.

    At most about ``most_rows`` labelled rows, by a hash of the key, are learned
    from. Null keys and labels teach nothing; labels that disagree about a key all
    count. Without rows of both labels the list is empty.
    """
    named = features()
    rows = stats.join(labels.select(key, F.col(label).alias("__label")).where("__label is not null"), key).select(key, (F.col("__label") == 0).cast("int").alias("bad"), *[v.alias(k) for k, v in named.items()])
    rows = materialize(rows, "labelled")
    total = rows.count()
    if total > most_rows:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * most_rows / total))
    share = [i / bins for i in range(1, bins)]
    cuts_of = rows.agg(*[F.percentile_approx(k, share, 1000).alias(f"all_{k}") for k in named], *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(k)), share, 1000).alias(f"bad_{k}") for k in named]).first()
    # Thresholds stand half-way between quantiles of all rows or of label 0.
    cuts: dict[str, list[float]] = {}
    for k in named:
        values = sorted({*(cuts_of[f"all_{k}"] or ()), *(cuts_of[f"bad_{k}"] or ())})
        cuts[k] = sorted({(a + b) / 2 for a, b in zip(values, values[1:], strict=False)} | {v for v in values[:1]})
    cells = [F.array(*[reduce(lambda a, b: a + b, [(F.col(k) >= c).cast("int") for c in cuts[k]] or [F.lit(0)]) for k in named]).alias("bins")]
    prune = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(3)) == 0
    table = rows.select(*cells, "bad", prune.cast("int").alias("prune")).groupBy("bins").agg(*[F.count_if((F.col("bad") == b) & (F.col("prune") == p)).alias(f"{'pn'[1 - b]}{p}") for b in (1, 0) for p in (0, 1)])
    table = materialize(table, "cells")
    order = list(named)

    def fits(rule: list[tuple[int, bool, int]]) -> Column:
        return reduce(lambda a, b: a & b, [(F.col("bins")[f] > c) if above else (F.col("bins")[f] <= c) for f, above, c in rule], F.lit(True))

    rules: list[tuple[Condition, ...]] = []
    left = F.lit(True)
    failed: set[int] = set()  # features that began a rule which the rows kept for pruning refute
    while len(rules) < most_rules:
        rule: list[tuple[int, bool, int]] = []
        history: list[tuple[float, float]] = []  # of the rows kept for pruning, by number of conditions
        while True:
            spread = table.where(left & fits(rule)).select(F.posexplode("bins").alias("f", "b"), "p0", "n0", "p1", "n1")
            got = spread.groupBy("f", "b").agg(*[F.sum(c).alias(c) for c in ("p0", "n0", "p1", "n1")]).collect()  # features x bins
            own = [r for r in got if r["f"] == 0]
            p0, n0, p1, n1 = (sum(r[c] for r in own) for c in ("p0", "n0", "p1", "n1"))
            history.append((p1, n1))
            if not p0 or not n0 or len(rule) == most_conditions:
                break
            best = (1e-9, None)
            for f, k in enumerate(order):
                if not rule and f in failed:
                    continue
                for c in range(len(cuts[k])):
                    for above in (True, False):
                        side = [r for r in got if r["f"] == f and (r["b"] > c) == above]
                        gain = _gain(sum(r["p0"] for r in side), sum(r["n0"] for r in side), p0, n0)
                        best = max(best, (gain, (f, above, c)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # Of the prefixes, the one that does best on the rows kept for pruning; a longer one only if it is better.
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in history]
        to = max(range(1, len(rule) + 1), key=lambda i: (worth[i], -i))
        p, n = history[to]
        if p < min_cover or p / (p + n) < min_precision:
            failed.add(rule[0][0])
            continue
        rule = rule[:to]
        left = left & ~fits(rule)
        rules.append(tuple(Condition(order[f], above, cuts[order[f]][c]) for f, above, c in rule))
    return DecisionList(tuple(rules))


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    """Fewer than ``min_words`` words, or more than ``repeat_percent`` percent of words in repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def apply(stats: DataFrame, rules: DecisionList, *, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """``stats`` with base_failed, rule (the learned rule that rejects, else null) and kept.

    base_failed: see base_failed(). Empty and null texts fail. Every row is
    returned once; an empty table gives no rows. Columns of the new names, or named
    as features(), are replaced.
    """
    failed = base_failed(min_words, repeat_percent)
    rows = stats.select("*", failed.alias("base_failed"), *[v.alias(k) for k, v in features().items()])
    return rows.withColumn("rule", rules.which()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*features())
