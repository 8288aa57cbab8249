"""Exact duplicates against grouping by whole texts, with tries small enough to give up subtrees, and the cases the docstring defines."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup as E


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=40), st.integers(0, 6))
def test_trie(keys, drops):
    trie, want = E.Trie(), defaultdict(list)
    gone = []
    for i, k in enumerate(keys):
        if i % 5 == 4 and drops:
            drops -= 1
            taken = trie.give_up()
            assert len(list(trie.items())) + len(taken) == len(want)
            gone += taken
            for x, _ in taken:
                del want[x]
        found = trie.find(k, list)
        if found is None:
            gone.append((k, [i]))
        else:
            found.append(i)
            want[k].append(i)
    assert dict(trie.items()) == want
    assert sum(len(v) for _, v in gone) + sum(map(len, want.values())) == len(keys)
    weight = E._weight(trie.root) - E.NODE_BYTES
    assert trie.size == weight


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=20), st.text("ab", max_size=20), st.integers(0, 5))
def test_common(a, b, at):
    a, b = a.encode(), b.encode()
    at = min(at, len(b))
    n = 0
    while n < min(len(a), len(b) - at) and a[n] == b[at + n]:
        n += 1
    assert E.common(a, b, at) == n


def brute(rows, largest=True):
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    best = {t: (max if largest else min)([k for k in ks if k is not None], default=None) for t, ks in groups.items()}
    return sorted((repr(k), repr(t), repr(best[t or ""]), len(groups[t or ""])) for k, t in rows), len(groups)


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(k), "abc"[: int(n)] * int(m)) for k, n, m in zip(rng.permutation(300), rng.integers(0, 4, 300), rng.integers(1, 12, 300), strict=True)]
    rows += [(1000 + k, "hot text " * 20) for k in range(400)]
    rows += [(None, "hot text " * 20), (None, None), (None, "only without keys"), (None, "only without keys"), (7, ""), (2000, None), (2001, ""), (2002, "x " * 200_000), (2003, "x " * 200_000), (2004, "x " * 199_999), (2005, "é"), (2006, "é"), (2007, " é")]
    return rows + [rows[3], rows[3], (2007, " é")]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("how", [{}, {"hash_bits": 2}, {"hash_bits": 0, "budget": 3000, "local_rows": 50}, {"hash_bits": 3, "budget": 100_000, "local_bytes": 4000}])
def test_groups(spark, how, keep):
    rows = rows_of()
    docs = spark.createDataFrame([(k, t, 5, [1], True) for k, t in rows], "doc_id long, text string, group_size int, members array<int>, kept boolean").repartition(5)
    out = E.owners(docs, keep=keep, **how)
    assert out.columns == ["doc_id", "text", "members", "keep_id", "group_size", "kept", "text_sha256"]
    got = out.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    want, groups = brute(rows, keep == "largest")
    assert sorted((repr(r.doc_id), repr(r.text), repr(r.keep_id), r.group_size) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text or "" for r in kept}) == groups
    assert all(r.doc_id == r.keep_id for r in kept) and all(r.sha == r.text_sha256 and r.members == [1] for r in got)


def test_normal_form_text_keys_and_survivors(spark):
    rows = [("a", " One "), ("b", "one"), ("é", "ONE"), ("z", "two"), (None, "TWO")]
    docs = spark.createDataFrame([(t, k) for k, t in rows], "text string, id string")
    normal = lambda c: F.lower(F.trim(c))
    got = {(r.id, r.text): (r.keep_id, r.group_size, r.kept) for r in E.owners(docs, key="id", normal=normal).collect()}
    assert got == {("a", " One "): ("é", 3, False), ("b", "one"): ("é", 3, False), ("é", "ONE"): ("é", 3, True), ("z", "two"): ("z", 2, True), (None, "TWO"): ("z", 2, False)}
    assert sorted(E.deduplicate(docs, key="id", keep="smallest", normal=normal).collect()) == [(" One ", "a"), ("two", "z")]


def test_empty_table(spark):
    assert E.owners(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        E.owners(spark.createDataFrame([], "doc_id long, text string"), keep="first")
