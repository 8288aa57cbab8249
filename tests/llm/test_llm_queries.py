"""Registered queries against their SQL, and their columns."""

import pytest
from oracle import connect, differences

from tidewater.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op2_url_filters": {"page_id", "host", "path", "rule", "verdict"},
    "op4_source_mixing": {"doc_id", "rate"},
    "op6_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op7_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op8_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op10_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, DATA), connect(DATA), queries.ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_whole_result(spark, name):
    table = {"op2_url_filters": "pages", "op10_chat_format": None}.get(name, "documents")
    out = queries.QUERIES[name](spark, DATA)
    assert set(out.columns) >= COLUMNS[name]
    rows = out.count()
    if table and name != "op6_best_fit_packing":
        assert rows == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert rows


def test_scores_of_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    lang = queries.op8_language_id(spark, data).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").selectExpr("avg(double(lang = lang_pred))").first()[0]
    quality = queries.op7_quality_classifier(spark, data).where("held_out").join(labels, "doc_id").selectExpr("avg(double(quality = predicted))").first()[0]
    assert lang > 0.98 and quality > 0.95
