"""The divergence of sources against a plain count with whole numbers, and the cases the docstring defines."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import source_divergence as D
from tidewater.llm import text as T

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows, least, top):
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        found = TERM.findall(lower(text))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        docs[lang].update(set(found))
        n[lang, source].update(found)
    out = set()
    kept = {lang: [t for t, c in docs[lang].items() if c >= least] for lang, _ in groups}

    def shares(counts, terms):
        total = sum(counts[t] for t in terms)
        return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(terms)) for t in terms}

    p = {g: shares(n[g], kept[g[0]]) for g in groups}
    whole = {lang: shares(sum((n[g] for g in groups if g[0] == lang), Counter()), kept[lang]) for lang in kept}
    for lang, source in groups:
        own, terms = p[lang, source], kept[lang]
        parts = {"pair": [(sum(abs(own[t] - p[g][t]) for t in terms), g[1]) for g in groups if g[0] == lang and g[1] != source], "term": [(own[t] - whole[lang][t], t) for t in terms if n[lang, source][t] and own[t] > whole[lang][t]]}
        for part, found in parts.items():
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top}
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB éß\n-\x00日@[`{\x7f\x80", max_size=12)), max_size=6))
def test_terms(texts):
    array, row = D.terms(*T.raw(pa.array(texts, pa.string())))
    got = list(zip(row.tolist(), array.to_pylist(), strict=True))
    assert got == [(i, t) for i, text in enumerate(texts) for t in TERM.findall(lower(text))]


def table(spark, rows):
    return spark.createDataFrame([(t, lang, s, 1, "x") for t, lang, s in rows], "text string, lang string, source string, digest int, term string").repartition(3)


def rows_of(seed=1):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "Été", "日本", *(f"w{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(60))]
    rows = [(" ".join(words[int(x)] for x in rng.zipf(1.4, rng.integers(0, 30)) % len(words)), ["en", "de", None][rng.integers(3)], ["s1", "s2", "", None, "s é"][rng.integers(5)]) for _ in range(250)]
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("lonely", "es", "s1"), ("same text " * 9, "en", "hot"), ("the THE The", "en", "hot")] + [("the " * 30_000, "en", "long")] + [("same text", "en", "hot")] * 40
    return rows


@pytest.mark.parametrize("how", [{}, {"digest_bits": 3}, {"cells": 7}])
def test_same_as_plain_counts(spark, how):
    rows = rows_of()
    out = D.divergence(table(spark, rows), least_docs=4, top=6, **how)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 4, 6)


def test_joins_by_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_TERMS", 0)
    rows = rows_of(2)
    assert {tuple(r) for r in D.divergence(table(spark, rows), least_docs=4, top=6).collect()} == brute(rows, 4, 6)


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000, 9_000_000_000_000_001, 3), (0, 0, 0)], "n long, total long, kept long")
    assert [r[0] for r in df.select(D.share("n")).collect()] == [1 + 10**9 * (9_000_000_000_000_000 + 5) // (9_000_000_000_000_001 + 15), None]


def test_no_rows_and_no_kept_terms(spark):
    assert D.divergence(table(spark, [])).count() == 0
    rows = [("a", "en", "x"), ("b", "en", "y"), (None, None, None)]
    assert sorted(tuple(r) for r in D.divergence(table(spark, rows)).collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
