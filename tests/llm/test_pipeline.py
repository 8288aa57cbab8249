"""The pipeline's stages: columns, effects, and what each must leave alone."""

import re

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(now) <= ids and len(set(now)) == len(now)
        if name == "minhash_dedup":
            texts = [r.text for r in docs.select("text").collect()]
            assert len({" ".join(re.findall(r"[^\x20\x09-\x0D]+", t.lower())) for t in texts}) == len(texts)
        ids = set(now)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_near_copies_lose_no_other_document(spark):
    text = [" ".join(f"w{k}_{i}" for i in range(40)) for k in range(6)]
    near = text[1] + " tail"
    rows = [(None, text[0]), (None, text[0]), (1, text[0]), (5, text[1]), (5, text[2]), (3, near), (5, text[2]), (5, text[2].upper()), (7, text[3]), (7, text[4]), (8, text[4]), (9, ""), (9, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, DATA).collect()]
    want = [(None, text[0]), (None, text[0]), (1, text[0]), (5, text[2].upper()), (3, near), (7, text[3]), (7, text[4]), (9, ""), (9, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_passages_of_texts_that_share_an_id(spark):
    passage, one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "pab")
    rows = [(1, passage), (5, f"{passage} {one}"), (5, two), (None, passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text.strip()) for r in corpus_pipeline.remove_repeated_passages(spark, docs, DATA).collect()}
    assert got == {(1, passage), (5, one), (5, two), (None, passage)}


ODD = [(1, None), (2, ""), (3, "  \n"), (None, "the of and to in that is was he for it with"), (4, "a " * 30_000), (5, "one two three"), (5, "one two three"), (6, "12 34"), (7, "one two three")]


def odd(spark, rows):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, __lang int, __score int, __cut int, __doc int, __key int"
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, 3, 4, 5) for i, t in rows], kinds)


def test_stages_take_odd_rows_and_clashing_names(spark):
    docs = odd(spark, ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert stage(spark, odd(spark, []), DATA).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.where("start = 0").count() == len(ODD)
    assert corpus_pipeline.STAGES[-1][1](spark, odd(spark, []), DATA).count() == 0


def test_shares_after_mixing(spark):
    from tidewater.llm import mixing, queries

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mix(docs, queries.labelled_domains(docs, spark.read.parquet(f"{sf}/labels.parquet")), corpus_pipeline.TARGETS, whole="clean")
    kept = mixing.thin(mixed, "doc_id", keep=mixing.posterior_of(mixed, "clean") >= 0.5).collect()
    total = sum(r.n_tokens for r in kept)
    for k, name in enumerate(sorted(corpus_pipeline.TARGETS)):
        share = sum(r.n_tokens * r.posteriors[k] for r in kept) / total
        assert abs(share - corpus_pipeline.TARGETS[name]) < 0.02, (name, share)


HELPERS = ["__n", "__k1", "__k2", "__again", "__key", "__text", "__row", "__lang", "__score", "__cut", "__doc", "n_words", "n_removed", "kept_words", "posteriors", "rate", "n_tokens"]


def test_values_of_columns_named_like_helpers(spark):
    passage, one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "pab")
    rows = [(1, passage), (5, f"{passage} {one}"), (5, two), (None, passage), (6, ""), (6, "")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in HELPERS)
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *range(len(HELPERS))) for i, t in rows], kinds)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns
        got = out.collect()
        assert got or name == "language_id", name
        assert all([r[c] for c in HELPERS] == list(range(len(HELPERS))) for r in got), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).where("start = 0").count() == len(rows)
