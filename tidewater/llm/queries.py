"""The registered query of each operator of this subpackage, over its whole table.

A query reads its table, calls its operator and derives what is compared.
ORACLE_SQL holds DuckDB SQL where SQL can express the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import chat_format, embedding_dedup, exact_dedup, fill_in_middle, language_id, mixing, oracles, quality_classifier, quality_rules, source_divergence, url_filters
from tidewater.llm.minhash_dedup import near_duplicates
from tidewater.llm.packing import pack
from tidewater.llm.storage import materialize
from tidewater.llm.substring_dedup import deduplicate
from tidewater.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base statistics, base_failed, and kept by the learned decision list."""
    stats = materialize(quality_rules.statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = quality_rules.learn(stats.where(~quality_rules.base_failed()), table(spark, sf_dir, "labels"))
    return quality_rules.apply(stats, rules).drop("n_upper", "n_digits", "n_marks")


#: Listed rules of the URL query.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Words of host names that label a URL as unwanted for mining, where no better labels are at hand.
UNWANTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "xxx")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: the longest listed rule decides its URL, else rules mined from URLs labelled by UNWANTED_WORDS."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    unwanted = F.arrays_overlap(F.split(url_filters.host(F.col("url")), "[.-]"), F.array(*map(F.lit, UNWANTED_WORDS)))
    learned = url_filters.learn(pages.select("url", unwanted.alias("unwanted")))
    return url_filters.judge(pages, learned, URL_RULES).drop("url")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: words, removed words, and the digest of those kept; windows of 20 words."""
    out = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


#: Target shares of tokens, by domain of the labelled table.
DOMAIN_TARGETS = {"clean": 0.92, "junk": 0.05, "toxic": 0.03}


def labelled_domains(docs: DataFrame, labels: DataFrame, most: int = 10_000) -> DataFrame:
    """(text, domain) of at most ``most`` labelled documents: toxic, else junk if the quality is 0, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    keys = mixing.sample_keys(labels.select("doc_id", domain.alias("domain")), key="doc_id", domain="domain", most=most)
    return docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id").select("text", "domain")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: words, domain posteriors, its rate, and the copies that the rate makes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mixing.mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), DOMAIN_TARGETS)
    return out.select("doc_id", "n_tokens", "posteriors", "rate", F.floor(F.col("rate") + mixing.draw("doc_id")).alias("copies"))


def tokenizer_path() -> str:
    """The default of a parameter: where the public word-level tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: links of cosine 0.93 or more among equal labels, and components."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), similarity=0.93)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of every document, packed into sequences of at most 4096 ids."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=4096, end_id=1)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: calibrated quality score; documents of held-out keys teach nothing."""
    held_out = language_id.held_out("doc_id", 5, 0)
    out = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), teach=~held_out, threshold=0.3)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the predicted language; documents of held-out keys teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.held_out("doc_id", 4, 2)
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: three-word shingles, similarity 0.85, components confirmed on full sets."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85, fold=True)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, and one for conversation -7, whose texts hold control strings; digests are read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat_format.digests(chat_format.format_conversations(rows.union(extra)))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each (lang, source): its distances from the language's other sources, and the 50 terms that it overuses most."""
    return source_divergence.divergence(table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the largest id among equal texts, their number, and the text's digest."""
    out = exact_dedup.owners(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, cut between lines and put in another order; digests of the output and of what is restored from it."""
    out = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), units="lines", seed=7, rate=100, suffix_first=50)
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1_quality_rules states of each text before any rule is learned."""
    stats = quality_rules.statistics(table(spark, sf_dir, "documents"))
    return stats.withColumn("base_failed", quality_rules.base_failed()).drop("n_upper", "n_digits", "n_marks")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and listed rule of each page, as op2_url_filters judges them; pages without a listed rule have none."""
    pages = table(spark, sf_dir, "pages").select("page_id", url_filters.host(F.col("url")).alias("host"), url_filters.path(F.col("url")).alias("path"))
    rule, verdict = url_filters.listed(F.col("host"), F.col("path"), URL_RULES)
    return pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_chat_format reads back, without the length of its template's output."""
    return op10_chat_format(spark, sf_dir).drop("formatted_chars")


def packing_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents packed, sequences over 4096 ids, places that aren't where the one before ends, and documents whose pieces don't follow each other or that were cut too early."""
    packed = materialize(op6_best_fit_packing(spark, sf_dir), "packed")
    ends = F.sum("length")
    sequences = packed.groupBy("sequence_id").agg(ends.alias("n"), F.max(F.col("offset") + F.col("length")).alias("last"), F.count_distinct("offset").alias("starts"), F.count("*").alias("pieces"))
    sequences = sequences.agg(F.count_if(F.col("n") > 4096).alias("overfull"), F.count_if((F.col("last") != F.col("n")) | (F.col("starts") != F.col("pieces"))).alias("gaps"))
    cut = (F.col("start") != 4096 * F.col("piece").cast("long")) | ((F.col("length") < 4096) & (F.col("piece") < F.col("last")))
    last = packed.groupBy("doc_id").agg(F.max("piece").alias("last"))
    documents = packed.join(last, "doc_id").agg(F.count_distinct("doc_id").alias("documents"), F.count_if(cut).alias("cut_wrong"))
    return documents.join(F.broadcast(sequences)).select("documents", "overfull", "gaps", "cut_wrong")  # one row each


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filters": op2_url_filters,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_language_id": op8_language_id,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_source_divergence": op11_source_divergence,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
    "text_statistics": text_statistics,
    "url_parts": url_parts,
    "chat_digests": chat_digests,
    "packing_holds": packing_holds,
}

#: The others are learned, or ids of a tokenizer, or a template's output: tests/llm compare those with brute force; what SQL can state of them has queries of its own.
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op5_embedding_dedup": oracles.EMBEDDING_DEDUP,
    "op9_minhash_dedup": oracles.MINHASH_DEDUP,
    "op11_source_divergence": oracles.SOURCE_DIVERGENCE,
    "op12_exact_dedup": oracles.EXACT_DEDUP,
    "op13_fill_in_middle": oracles.FILL_IN_MIDDLE,
    "text_statistics": oracles.TEXT_STATISTICS,
    "url_parts": oracles.url_parts(URL_RULES),
    "chat_digests": oracles.CHAT_DIGESTS,
    "packing_holds": oracles.PACKING_HOLDS,
}
