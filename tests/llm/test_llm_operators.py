"""The corpus operators against brute force, and on the cases that their docstrings define."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import chat_format, components, embedding_dedup, language_id, minhash_dedup, mixing, packing, quality_classifier, quality_rules, queries, substring_dedup, url_filters
from tidewater.llm import text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows (id, text) as a documents table with columns that clash with new ones."""
    return spark.createDataFrame([(i, t, "en", None, 0, 7, "x") for i, t in rows], DOCS + ", n_words long, kept string")


def words(t):
    return WORD.findall(t or "")


def prose(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


# text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x1c日", max_size=12)), max_size=6))
def test_words(texts):
    data, offsets = T.raw(pa.array(texts, pa.string()))
    w = T.words(data, offsets)
    got = [[bytes(data[a:b]).decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)] for i in range(len(texts))]
    assert got == [words(t) for t in texts]
    flat = [x for t in got for x in t]
    hashes = w.hashes(fold=True).tolist()
    fold = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in flat]
    assert len(set(zip(fold, hashes, strict=True))) == len(set(fold)) == len(set(hashes))


# 9 and components


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(k, k + 1) for k in range(100, 140)] + [(5, None), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    for _ in label:
        for a, b in pairs:
            if b is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(t, n):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies():
    rng = np.random.default_rng(4)
    rows = []
    base = prose(180, 1).split()
    for k in range(60):  # a family with edits of every strength
        own = list(base)
        for at in rng.integers(0, len(own), rng.integers(0, 14)):
            own[at] = f"x{k}_{at}"
        rows.append((1000 + k, " ".join(own)))
    rows += [(k, prose(int(rng.integers(1, 60)), 100 + k)) for k in range(20)]
    rows += [(200 + k, prose(40, 7).upper() if k % 2 else prose(40, 7)) for k in range(8)]  # copies but for case
    rows += [(300, ""), (301, None), (302, " \n"), (303, "one"), (304, "ONE"), (305, "one two"), (306, prose(5000, 3)), (307, prose(5000, 3) + " tail")]
    return rows


@pytest.mark.parametrize(("shingle", "percent", "block"), [(3, 85, 256), (5, 80, 16)])
def test_near_duplicates_lose_no_link(spark, shingle, percent, block):
    rows = near_copies()
    got = minhash_dedup.near_duplicates(docs(spark, rows), shingle=shingle, percent=percent, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, shingle, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_near_duplicates_of_odd_rows(spark):
    got = minhash_dedup.near_duplicates(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_needed_is_a_safe_bound():
    assert 25 <= minhash_dedup.needed(0.85, 64) <= 40 and minhash_dedup.needed(0.8, 64) < minhash_dedup.needed(0.9, 64)


# 3


def brute_removal(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if k in seen:
                gone[a : a + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("chunk", [50, 2_000_000])
def test_repeated_passages(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", chunk)
    passage = prose(40, 9)
    rows = [(k, f"{prose(30, k)}\n\t{passage}  {prose(k, 50 + k)}") for k in range(12)]
    rows += [(50, passage), (51, passage + " " + passage), (52, "a " * 100), (53, ""), (54, None), (55, prose(19, 2)), (56, prose(3000, 2, 5))]
    got = substring_dedup.deduplicate(docs(spark, rows), window=20, buckets=5).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_words) for r in got} == brute_removal(rows, 20)
    for r in got:
        assert words(r.text) == words(r.kept_words) and (r.text is None) == (r.doc_id == 54)
    unchanged = {i: t for i, t in rows}
    assert all(r.text == unchanged[r.doc_id] for r in got if not r.n_removed)


def test_repeated_passages_of_odd_rows(spark):
    p = prose(25, 1)
    got = substring_dedup.deduplicate(docs(spark, [(1, p), (1, p), (None, p), (2, p)]), window=20, buckets=2).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 25)]
    assert substring_dedup.deduplicate(docs(spark, []), window=20).count() == 0


# 6


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    return path, tokenizers.Tokenizer.from_file(path)


def test_word_ids_are_those_of_whole_texts(tokenizer):
    path, whole = tokenizer
    texts = ["Don't stop, DON'T! don't", "a<|endoftext|>b", "x…. y", "ß ÿ Ÿ İ", "1234 a1b2", "é e\u0301 x \u0301a", "日本語 text", "×÷ a×b", "'s it's", "", None, "\x1cab\x85c", prose(2000, 5)]
    own = packing.WordTokenizer(open(path).read())
    data, offsets = T.raw(pa.array(texts, pa.string()))
    ids, first = own.encode(data, T.words(data, offsets))
    for k, e in enumerate(whole.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[first[k] : first[k + 1]].tolist() == e.ids


def test_packing_is_whole_and_gapless(spark, tokenizer):
    path, whole = tokenizer
    rows = [(k, prose(int(n), k)) for k, n in enumerate(np.random.default_rng(2).integers(0, 60, 80))] + [(900, None), (901, ""), (902, prose(400, 1)), (None, "x"), (5, "again")]
    got = packing.pack(docs(spark, rows), path, size=64).collect()
    want = []
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    by = lambda x: str(x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=by) == sorted(want, key=by)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 3
    assert packing.pack(docs(spark, []), path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan_places_every_piece_once(histogram):
    used = defaultdict(list)
    for length, rank, first, n, per, offset in packing.plan(histogram, 32).tolist():
        for s in range(n):
            many = min(per, histogram[length] - rank - s * per)
            used[first + s] += [(offset + k * length, length) for k in range(many)]
    assert sum(len(x) for x in used.values()) == sum(histogram.values())
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 32


# 8


LANGUAGES = {"en": "the of and to in that is was he for it with as his on be at by", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein", "fr": "de la le et les des en un du une que est pour qui dans à par plus"}


def spoken(n, seed):
    rng = np.random.default_rng(seed)
    return [(" ".join(rng.choice(LANGUAGES[k].split(), rng.integers(5, 60))), k) for k in LANGUAGES for _ in range(n)]


def test_language_of_held_out_texts(spark):
    model = language_id.fit(spark.createDataFrame([*spoken(60, 1), (None, "en"), ("x", None), ("", "de")], "text string, lang string"))
    rows = [(k, t, y) for k, (t, y) in enumerate(spoken(20, 2))]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = language_id.predict(docs(spark, [(1, None), (2, ""), (3, "12 34 !"), (4, "the of and " * 5000)]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd] == ["und", "und", "und", "en"]
    assert language_id.predict(docs(spark, []), model).count() == 0


def test_no_language_is_known_without_labels(spark):
    model = language_id.fit(spark.createDataFrame([(None, None)], "text string, lang string"))
    assert language_id.predict(docs(spark, [(1, "the")]), model).first().lang_pred == "und"


def test_windows_cover_every_byte():
    data, offsets = T.raw(pa.array(["Ab" * 300, "", "é"]))
    codes, row, length = language_id.windows(data, offsets, 256)
    assert [int(length[row == k].sum()) for k in range(3)] == [600, 0, 2] and bytes(codes[0][:4]) == b"abab"


# 4


def test_rates_meet_targets(spark):
    rows = [(k, " ".join(np.random.default_rng(k).choice(["good", "fine", "nice"] if k % 3 else ["bad", "ugly"], 40)), "g" if k % 3 else "b") for k in range(90)]
    labelled = spark.createDataFrame([(t, y) for _, t, y in rows] + [("x", None), (None, "g")], "text string, domain string")
    own = docs(spark, [(i, t) for i, t, _ in rows] + [(500, None), (501, "")])
    out = mixing.mix(own, labelled, {"g": 0.9, "b": 0.1}).collect()
    total = sum(r.n_tokens for r in out)
    held = np.array([np.array(r.posteriors) * r.n_tokens * r.rate for r in out]).sum(0) / total
    assert np.allclose(held, [0.1, 0.9], atol=0.01) and all(r.rate >= 0 for r in out) and len(out) == 92
    kept = mixing.mix(own, labelled, {"g": 0.5, "b": 0.5}, whole="g")
    assert all(r.rate >= 1 for r in kept.collect() if r.n_tokens and r.posteriors[1] > 0.95)
    assert {r.doc_id for r in mixing.copies(kept.withColumn("rate", F.lit(2.0)), "doc_id").collect()} == {r.doc_id for r in out}
    assert mixing.copies(kept.withColumn("rate", F.lit(2.0)), "doc_id").count() == 2 * 92
    assert mixing.mix(docs(spark, []), labelled, {"g": 1.0}).count() == 0
    assert {r.rate for r in mixing.mix(own, labelled.limit(0), {"g": 1.0}).collect()} == {1.0}


# 5


def brute_links(ids, vectors, labels, s):
    n = len(ids)
    links = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = vectors[i], vectors[j]
            if i != j and labels[i] is not None and labels[i] == labels[j] and a and b and len(a) == len(b) and all(x is not None and np.isfinite(x) for x in a + b) and any(a) and any(b):
                a, b = np.array(a, float), np.array(b, float)
                links[i][j] = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= s
    return links


@pytest.mark.parametrize("block", [7, 512])
def test_vectors_lose_no_link(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 10))
    vectors = [list(map(float, np.float32(centres[k % 12] + rng.normal(size=10) * 0.25))) for k in range(150)]
    vectors += [vectors[3], vectors[3], [0.0] * 10, None, [], [float("nan")] * 10, [None] + [1.0] * 9, [float("inf")] + [1.0] * 9, vectors[4][:5], [-0.0, 1.0], [0.0, 1.0]]
    ids = [int(x) for x in rng.permutation(len(vectors))]
    labels = [int(k % 2) if k % 13 else None for k in range(len(vectors))]
    table = spark.createDataFrame([(i, v, y, "extra") for i, v, y in zip(ids, vectors, labels, strict=True)], "vec_id long, embedding array<float>, label int, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table, similarity=0.93, block=block).collect()}
    links = brute_links(ids, vectors, labels, 0.93)
    root = dict(zip(ids, ids, strict=True))
    for _ in ids:
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if links[i][j]:
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {a: (sum(links[i]), root[a], root[a] == a) for i, a in enumerate(ids)}


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), similarity=0.93).count() == 0


# 1 and 7


def base(t):
    w = words(t)
    n = defaultdict(int)
    for k in range(len(w) - 2):
        n[tuple(w[k : k + 3])] += 1
    hit = [False] * len(w)
    for k in range(len(w) - 2):
        if n[tuple(w[k : k + 3])] > 1:
            hit[k : k + 3] = [True] * 3
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit)


def test_statistics(spark):
    rows = [(1, None), (2, ""), (3, "a b c a b c"), (4, "x\n \nx\ny|<\n"), (5, "a a a a"), (6, prose(6000, 1, 12)), (7, "日本 é\n日本 é"), (8, "a b\x1cb c\x0bd"), (9, prose(500, 2))]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(docs(spark, rows)).collect()}
    assert got == {i: base(t) for i, t in rows}


def judged(n=240):
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        t = prose(60 + k % 50, k, 4000)
        rows.append((k, " ".join(w + "***" for w in t.split()) if bad and k % 8 else t.upper() + "!" * 90 if bad else t))
        labels.append((k, 0 if bad else 1))
    return rows, labels


def test_rules_separate_and_are_expressions(spark):
    rows, labels = judged()
    stats = quality_rules.statistics(docs(spark, [*rows, (900, None), (901, "few words"), (902, "a b c " * 60)]))
    y = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    rules = quality_rules.learn(stats, y)
    out = {r.doc_id: r for r in quality_rules.apply(stats, rules).collect()}
    assert rules.rules and all(out[i].kept == (q == 1) for i, q in labels)
    assert all(out[i].base_failed and not out[i].kept for i in (900, 901, 902))
    assert quality_rules.learn(stats, y.limit(0)).rules == ()
    assert quality_rules.apply(quality_rules.statistics(docs(spark, [])), rules).count() == 0


def test_quality_scores_of_held_out_rows(spark):
    rows, labels = judged()
    y = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(docs(spark, [*rows, (900, None), (None, "x")]), y, teach=F.col("doc_id") % 3 != 0).collect()}
    held = [(i, q) for i, q in labels if i % 3 == 0]
    assert np.mean([got[i].predicted == q for i, q in held]) >= 0.95 and all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows) + 2
    assert {r.score for r in quality_classifier.classify(docs(spark, rows[:3]), y.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(docs(spark, []), y).count() == 0


def test_pooling_rises():
    x, v = quality_classifier.isotonic(np.arange(5.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9]), np.ones(5))
    assert list(v) == sorted(v) and np.allclose(np.interp(2.0, x, v), 1.1 / 3)


# 2


def test_urls(spark):
    rows = [(1, "https://WWW.Example.com/en/x?y#z"), (2, "http://a.example.com/en/1"), (3, "x://net/es/"), (4, "no scheme"), (5, None), (6, "https://h.org?q=/net/es/"), (7, "https://notexample.com/en/1"), (8, "a://b://c/d"), (9, "https://x.net/fr/2"), (9, "https://x.net/fr/2"), (10, "https://com"), (11, "https://cheap-pills.org/en/1")]
    labelled = spark.createDataFrame([(f"https://cheap-pills.net/en/{k}", True) for k in range(20)] + [(f"https://fine{k}.org/en/{k}", False) for k in range(60)] + [(None, True), ("https://z.org/", None)], "url string, unwanted boolean")
    learned = url_filters.learn(labelled)
    pages = spark.createDataFrame([(i, u, "old") for i, u in rows], "page_id long, url string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, learned, queries.URL_RULES).collect() if r.rule) + sorted((r.page_id, r.host, r.path, r.verdict) for r in url_filters.judge(pages, learned, queries.URL_RULES).collect() if not r.rule)
    assert got == [
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "a.example.com", "/en/1", "example.com/en/", "block"),
        (3, "net", "/es/", "net/es/", "block"),
        (7, "notexample.com", "/en/1", "com/", "allow"),
        (9, "x.net", "/fr/2", "net/fr/", "block"),
        (9, "x.net", "/fr/2", "net/fr/", "block"),
        (4, "", "", "allow"),
        (5, "", "", "allow"),
        (6, "h.org", "", "allow"),
        (8, "b:", "//c/d", "allow"),
        (10, "com", "", "allow"),
        (11, "cheap-pills.org", "/en/1", "block"),
    ]
    none = url_filters.learn(labelled.where("not unwanted"))
    assert none.rules.count() == 0
    assert url_filters.judge(pages.limit(0), none, queries.URL_RULES).count() == 0


def test_rare_but_sure_url_rules_are_found(spark):
    common = [(f"https://a{f}-b{f}-c{f}.d{f}.e{f}.com/p{'wxyz'[f]}/q{'wxyz'[f]}/r{'wxyz'[f]}/{k}?s{f}=1&t{f}=2", k % 2 == 0) for f in range(4) for k in range(120)]
    pairs = [(f"https://{h}.{d}.org/{k}", h + d == "eastnorth") for h in ("east", "west") for d in ("north", "south") for k in range(8)]
    rare = [(f"https://rare-pills.net/{k}", True) for k in range(20)] + [(f"https://tiny-casino.net/{k}", True) for k in range(3)]
    labels = dict(common + pairs + rare)
    labelled = spark.createDataFrame(list(labels.items()), "url string, unwanted boolean")
    learned = url_filters.learn(labelled)
    rules = {tuple(r["items"]): r.confidence for r in learned.rules.collect()}
    assert {("word:pills",), ("word:casino",), ("host:east", "host:north")} <= set(rules) and learned.n == len(rules)
    bad, every = defaultdict(set), defaultdict(set)
    for u, t in labelled.select("url", url_filters.tokens(F.col("url"))).collect():
        for n in (1, 2, 3):
            for c in itertools.combinations(sorted(t), n):
                every[c].add(u)
                if labels[u]:
                    bad[c].add(u)
    sure = {c for c in bad if len(bad[c]) >= 3 and len(bad[c]) >= 0.9 * len(every[c])}
    assert set(rules) == {c for c in sure if not any(p in sure for n in range(1, len(c)) for p in itertools.combinations(c, n))}


def test_url_rules_see_all_of_a_url(spark):
    bad = ["https://casino.a.b{}.example.com/", "https://a-b-c-d-pills{}-cheap.org/", "https://h.org/a/b/c/{}/warez", "https://h.org/?a=1&b={}&adult=1"]
    fine = ["https://shop.a.b{}.example.com/", "https://a-b-c-d-{}-books.org/", "https://h.org/a/b/c/{}/news", "https://h.org/?a=1&b={}&page=1"]
    rows = [(u.format(k), t) for urls, t in ((bad, True), (fine, False)) for u in urls for k in range(5)]
    labelled = spark.createDataFrame(rows, "url string, unwanted boolean")
    got = {r.url: r.mined for r in url_filters.judge(labelled.select("url"), url_filters.learn(labelled), {}).collect()}
    assert {u for u, rule in got.items() if rule} == {u for u, t in rows if t}
    assert set(got.values()) == {None, "host:casino", "word:cheap", "path:warez", "key:adult"}


def test_url_rules_are_the_same_by_shuffle(spark, monkeypatch):
    labelled = spark.createDataFrame([(f"https://{h}.{d}.org/{k}", h + d == "eastnorth") for h in ("east", "west") for d in ("north", "south") for k in range(8)], "url string, unwanted boolean")
    pages = labelled.selectExpr("url", "unwanted")
    one = {(r.url, r.verdict) for r in url_filters.judge(pages, url_filters.learn(labelled), {}).collect()}
    monkeypatch.setattr(url_filters, "BROADCAST_SETS", -1)
    assert {(r.url, r.verdict) for r in url_filters.judge(pages, url_filters.learn(labelled), {}).collect()} == one == {(r.url, "block" if r.unwanted else "allow") for r in pages.collect()}


# 10


piece = st.sampled_from([*chat_format.CONTROL, "\\", " ", "\n", "a", "user", "é", "\ue000", ""])
said = st.lists(piece, max_size=7).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), said), said), max_size=5))
def test_template_is_reversible(turns):
    r = chat_format.render(turns)
    assert not r.rewrites and chat_format.read_back(r.text) == turns
    assert [chat_format.unescape(r.text[a:b]) for a, b in r.loss] == [x for role, x in turns if role == "assistant"]
    assert [a for a, _ in r.spans[1:]] == [b for _, b in r.spans[:-1]]


def test_rewriting_templates_are_found():
    def counts(turns):
        return f"{len(turns)}:" + "".join(t for _, t in turns)

    assert chat_format.render([("user", "a"), ("assistant", "b")], counts).rewrites


def test_conversations(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 0, "user", None), (2, None, None, "x"), (2, 0, "user", "</s>"), (2, 0, "user", "</s>"), (None, 0, "user", "n")], "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(rows)).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == digest([("user", ""), ("assistant", "hi")]) and got[1].loss_chars == 2
    assert got[2].n_turns == 3 and got[2].turns_sha256 == digest([("", "x"), ("user", "</s>"), ("user", "</s>")])
    assert set(got) == {1, 2, None}
    assert chat_format.format_conversations(rows.limit(0)).count() == 0


def mined(rows, least, sure, longest):
    """Every minimal set of tokens by enumeration: {tokens: (n, unwanted)}."""
    from itertools import combinations

    counts = defaultdict(lambda: [0, 0])
    for own, bad in rows:
        for k in range(1, longest + 1):
            for c in combinations(sorted(own), k):
                counts[c][0] += 1
                counts[c][1] += bad
    kept = {c: tuple(v) for c, v in counts.items() if v[1] >= least and v[1] >= sure * v[0]}
    return {c: v for c, v in kept.items() if not any(p in kept for k in range(1, len(c)) for p in combinations(c, k))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_url_rules_are_those_of_enumeration(spark, seed):
    rng = np.random.default_rng(seed)
    hosts, parts, keys = ["a-b.x.com", "b.y.net", "c-a.x.net", "d.com", "a.q.y.com"], ["en", "de", "win", "free"], ["id", "ref", "p"]
    urls = {f"https://{rng.choice(hosts)}/{rng.choice(parts)}/{rng.choice(parts)}?{rng.choice(keys)}={k}" for k in range(160)}
    rows = [(u, bool(("win" in u and "free" in u) or ("a-b" in u and rng.random() < 0.9) or rng.random() < 0.05)) for u in sorted(urls)]
    table = spark.createDataFrame(rows, "url string, unwanted boolean")
    tokens = {r.url: r.t for r in table.select("url", url_filters.tokens(F.col("url")).alias("t")).collect()}
    want = mined([(tokens[u], bad) for u, bad in rows], 3, 0.9, 3)
    learned = url_filters.learn(table, min_count=3, min_confidence=0.9, longest=3)
    n_bad = sum(bad for _, bad in rows)
    got = {tuple(r["items"]): (round(r.support * n_bad / r.confidence), round(r.support * n_bad)) for r in learned.rules.collect()}
    assert got == want and want
    blocked = {r.url for r in url_filters.judge(table, learned, {}).where("verdict = 'block'").collect()}
    assert blocked == {u for u, _ in rows if any(set(c) <= set(tokens[u]) for c in want)}


def test_fourier_ridge_is_a_dense_solution(spark):
    rng = np.random.default_rng(5)
    names = list(quality_classifier.inputs())
    x = rng.normal(size=(300, len(names)))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    held = np.arange(300) % 4 == 0
    rows = spark.createDataFrame([(*map(float, a), float(b), bool(h)) for a, b, h in zip(x, y, held, strict=True)], ", ".join(f"{c} double" for c in names) + ", label double, held boolean")
    model = quality_classifier.fit(rows, calibrate=F.col("held"), size=24, ridge=0.01)
    z = model.features(x[~held])
    penalty = 0.01 * (~held).sum() / 24 * np.eye(25)
    penalty[-1, -1] = 1e-9
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y[~held]), atol=1e-6)
    raw = model.raw(x[held])
    step = np.floor(np.clip(raw, -1, 2) * quality_classifier.STEPS)
    at = np.unique(step)
    mean = np.array([[raw[step == a].mean(), y[held][step == a].mean(), (step == a).sum()] for a in at])
    # The rising fit in closed form: the largest, over beginnings, of the smallest mean to any end.
    total, weight = np.cumsum(np.r_[0, mean[:, 1] * mean[:, 2]]), np.cumsum(np.r_[0, mean[:, 2]])
    fit = [max(min((total[b] - total[a]) / (weight[b] - weight[a]) for b in range(k + 1, len(at) + 1)) for a in range(k + 1)) for k in range(len(at))]
    assert np.allclose(np.interp(mean[:, 0], model.steps, model.values), fit, atol=1e-9)


def test_rates_are_a_least_squares_solution(spark):
    rows = [(k, " ".join(np.random.default_rng(k).choice(["good", "fine", "nice"] if k % 4 else ["bad", "ugly"], 10 + k)), "g" if k % 4 else "b") for k in range(60)]
    labelled = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, domain string")
    out = mixing.mix(docs(spark, [(i, t) for i, t, _ in rows]), labelled, {"g": 0.3, "b": 0.7}).collect()
    n, p, r = (np.array([x[c] for x in out], float) for c in ("n_tokens", "posteriors", "rate"))
    goal = np.array([0.7, 0.3])
    miss = (p * (n * r)[:, None]).sum(0) / n.sum() - goal
    # By brute force: many small projected steps.
    q = np.ones(len(n))
    a = p * n[:, None] / n.sum()
    for _ in range(20_000):
        q = np.maximum(0, q - 5 * (a @ (a.T @ q - goal)))
    assert np.abs(miss).max() <= np.abs(a.T @ q - goal).max() + 2e-3 and (r >= 0).all()


def test_other_tokenizers_are_refused():
    from tidewater.llm import packing

    with pytest.raises(ValueError):
        packing.checked('{"normalizer": null, "pre_tokenizer": null, "model": {}}')


def test_repeated_texts_leave_no_label_out(spark, monkeypatch):
    other = [f"the quick text number {i} of the language" for i in range(30)]
    rows = [("one and the same text in english", "en")] * 60_000 + [(t, "en") for t in other] + [(f"der schnelle Text Nummer {i} der Sprache", "de") for i in range(200)]
    labelled = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    model = language_id.fit(labelled, most_documents=100, epochs=1, least_steps=20)
    assert model.labels == ["de", "en"]
    assert language_id.fit(labelled, most_documents=100, most_bytes=1, epochs=1, least_steps=5).labels == ["de", "en"]
    monkeypatch.setattr(language_id, "train", lambda texts, labels, **_: (texts, labels))
    for most in (1, 3, 29, 100):  # the threshold leaves enough, or not
        texts, labels = language_id.fit(labelled, most_documents=most)
        assert labels.count("en") == min(most, 31) and labels.count("de") == min(most, 200) and len(set(texts)) == len(texts)
    few = spark.createDataFrame([("one clean text", "clean")] * 20_000 + [(f"junk {i}", "junk") for i in range(50)], "text string, domain string").repartition(4)
    texts, domains = mixing.sample(few, text="text", domain="domain", most=4000, seed=1)
    assert sorted(set(domains)) == ["clean", "junk"] and len(texts) == len(set(texts)) == 51
    assert len(mixing.sample(few, text="text", domain="domain", most=7, seed=1)[0]) == 7
    keys = spark.createDataFrame([(k % 40, "ab"[k % 3 == 0]) for k in range(4000)], "doc_id long, domain string")
    assert mixing.sample_keys(keys, key="doc_id", domain="domain", most=25).count() == 25
    assert mixing.sample_keys(keys, key="doc_id", domain="domain", most=100).count() == 40


def test_byte_network_equals_a_plain_convolution():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["der", "die", "und", "nicht"], 30)) for _ in range(20)] + [" ".join(rng.choice(["the", "and", "not", "of"], 30)) for _ in range(20)]
    model = language_id.train(texts, ["de"] * 20 + ["en"] * 20, window=64, widths=(2, 4), filters=3, embed=5, epochs=1, least_steps=30)
    codes, _, _ = language_id.windows(*T.raw(pa.array(texts[:3] + ["ab"])), 64)
    got = model.probabilities(codes)
    widths = [2] * 3 + [4] * 3
    for row, probabilities in zip(codes, got, strict=True):
        hidden = []
        for f, width in enumerate(widths):
            weights = model.filters[:, f].reshape(model.most, 5)
            assert not weights[width:].any()  # shorter filters have nothing beyond their width
            best = max(sum(float(model.embed[row[t + j]] @ weights[j]) for j in range(width)) for t in range(64 - model.most + 1))
            hidden.append(max(best + model.bias[f], 0.0))
        z = np.array(hidden) @ model.out + model.out_bias
        z = np.exp(z - z.max())
        assert np.allclose(z / z.sum(), probabilities, atol=1e-5)


def test_packing_needs_no_more_sequences_than_best_fit_one_by_one(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["of"] * int(n))) for i, n in enumerate(rng.integers(0, 60, 300))]
    size = 64
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), queries.tokenizer_path(), size=size, end_id=1).collect()
    lengths = sorted((r.length for r in out), reverse=True)
    room: list[int] = []
    for n in lengths:  # each piece goes where it leaves the least room
        fits = [(r - n, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(size - n)
    assert len({r.sequence_id for r in out}) <= len(room)


def test_first_condition_is_the_best_of_all(spark):
    rng = np.random.default_rng(2)
    n = 600
    rows = [(i, int(w), int(4 * w), int(s), 0, 0, 0, 0, 0) for i, (w, s) in enumerate(zip(rng.integers(50, 400, n), rng.integers(0, 80, n), strict=True))]
    bad = [int(s > 0.2 * w) for _, w, _, s, *_ in rows]
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_digits long, n_marks long")
    labels = spark.createDataFrame([(i, 1 - b) for i, b in enumerate(bad)], "doc_id long, quality int")
    rules = quality_rules.learn(stats, labels).rules
    first = rules[0][0]
    values = {r.doc_id: {k: r[k] for k in quality_rules.features()} for r in stats.select("doc_id", *[v.alias(k) for k, v in quality_rules.features().items()]).collect()}
    held = {r.doc_id for r in stats.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).select("doc_id").collect()}
    grown = [i for i in range(n) if i not in held]

    def gain(feature, above, threshold):
        fits = [i for i in grown if (values[i][feature] >= threshold) == above]
        p, p0 = sum(bad[i] for i in fits), sum(bad[i] for i in grown)
        return quality_rules._gain(p, len(fits) - p, p0, len(grown) - p0)

    # No other threshold at all, on any feature and side, gains notably more than the one chosen among quantiles.
    best = max(gain(k, above, v) for k in quality_rules.features() for above in (True, False) for v in {values[i][k] for i in grown})
    assert gain(first.feature, first.above, first.threshold) >= 0.9 * best
    assert first.feature == "symbols" and first.above
