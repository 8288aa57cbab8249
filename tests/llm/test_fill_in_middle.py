"""Fill-in-the-middle against a plain cut of unit lists, and on the cases its docstring defines."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import fill_in_middle as fim
from tidewater.llm import queries
from tidewater.llm import text as T

UNITS = {
    "lines": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t),
    "words": lambda t: re.findall(r"\A[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|\A[\x20\x09-\x0D]+\Z", t),
    "characters": list,
}


def plain(key, text, units, rate=100, suffix_first=50, seed=7):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = UNITS[units](text)
    assert "".join(u) == text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aé日\n \t.<P>\U0001f30a", max_size=40), min_size=1, max_size=6), st.data())
def test_cuts_of_a_batch(texts, data):
    raw, offsets = T.raw(pa.array(texts, pa.string()))
    for name, unit in fim.UNITS.items():
        found = fim.Boundaries(raw, offsets, unit)
        units = [UNITS[name](t) for t in texts]
        assert found.n.tolist() == [len(u) for u in units]
        k = np.array([data.draw(st.integers(0, len(u))) for u in units])
        place = found.cut(k)
        assert [raw[a:b].tobytes().decode() for a, b in zip(offsets[:-1], place, strict=True)] == ["".join(u[:c]) for u, c in zip(units, k, strict=True)]
        assert found.characters(offsets[:-1], place).tolist() == [len("".join(u[:c])) for u, c in zip(units, k, strict=True)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300))
def test_ranks(symbols):
    x = np.array(symbols, np.uint8)
    matrix = fim.WaveletMatrix(x)
    at = np.arange(len(x) + 1)
    for s in range(8):
        assert matrix.rank(s, at).tolist() == np.r_[0, np.cumsum(x == s)].tolist()


TEXTS = ["", None, "one", "one\n", "\n\n\n", "a\nb\nc", "x <P> y\nz", "<S>", "é\n日本\n" * 50, "  lead\n and trail  ", "w " * 40_000, "l\n" * 20_000, "<P\n>", "a<\nP>b"]


@pytest.mark.parametrize("units", list(UNITS))
def test_same_as_plain_cuts(spark, units):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(k + 100, "a b\nc d\ne f\n") for k in range(60)] + [(None, "n\nm"), (5, "a\nb\nc"), (5, "other\ntext\n")]
    docs = spark.createDataFrame([(k, t, 9, "c", 3) for k, t in rows], "doc_id long, text string, n_units int, form string, __draw0 int")
    out = fim.fill_in_middle(docs, units=units, rate=80, suffix_first=30)
    assert out.columns == ["doc_id", "text", "__draw0", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restored()).collect()
    key = repr
    assert sorted(((r.doc_id, r.text, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((k, t, *plain(k, t, units, 80, 30)) for k, t in rows), key=key)
    assert all(r.back == (r.text or "") and r["__draw0"] == 3 for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_bad_marks(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(docs).count() == 0
    for bad in ({"prefix": "", "suffix": "b", "middle": "c"}, {"prefix": "aa", "suffix": "b", "middle": "c"}, {"prefix": "ab", "suffix": "bc", "middle": "d"}, {"prefix": "x", "suffix": "x", "middle": "d"}, {"prefix": "xyz", "suffix": "y", "middle": "d"}):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, marks=bad)


def test_query_by_brute_force(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op13_fill_in_middle(spark, data).collect()
    assert {r.doc_id for r in rows} == set(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        n, form, a, b, output = plain(r.doc_id, texts[r.doc_id], "lines")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, sha(output), sha(texts[r.doc_id] or ""))
