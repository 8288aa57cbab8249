"""A corpus pipeline of the operators of tidewater.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the
columns of documents; the last returns pieces packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import language_id, mixing, queries
from tidewater.llm.minhash_dedup import near_sets, with_sets
from tidewater.llm.packing import pack
from tidewater.llm.storage import materialize
from tidewater.llm.substring_dedup import deduplicate
from tidewater.session import ship

#: A document goes if its language score is below this multiple of a guess among the learned languages (0.25 of four).
LEAST_OVER_GUESS = 1.2
#: Shares of expected tokens after mixing.
TARGETS = {"clean": 0.95, "junk": 0.03, "toxic": 0.02}


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, with ``lang`` as it came; null and letterless texts go.

    Each row is judged by its own text: rows with a null or a repeated doc_id too.
    An empty table gives no rows.
    """
    model = language_id.fit(docs)
    lang, score = free("__lang", docs), free("__score", docs)
    judged = language_id.predict(docs, model, prediction=lang, score=score)
    least = LEAST_OVER_GUESS / max(2, len(model.labels))
    return judged.where((F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= least)).select(docs.columns)


def free(name: str, docs: DataFrame) -> str:
    """``name``, or the first longer one that no column has."""
    while name in docs.columns:
        name += "_"
    return name


def aside(docs: DataFrame, *taken: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of the names ``taken`` under free ones, and these with what they were."""
    names = {c: free(f"__own_{c}", docs) for c in taken if c in docs.columns}
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}


def repeated_ids(docs: DataFrame) -> DataFrame:
    return materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id.

    Rows that repeat an id with other texts are documents of their own; of those
    that also have one set of shingles, or one wordless text, the smallest row
    stays. Rows with a null id are compared with nothing and all stay.
    """
    judged = materialize(near_sets(docs).where("kept and doc is not null"), "kept-sets")
    repeated = repeated_ids(docs)
    rows = docs.where("doc_id is null").unionByName(docs.join(judged.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").select(docs.columns))
    if repeated.isEmpty():  # as a rule: then no text is shuffled for it
        return rows
    names = n, k1, k2 = tuple(free(c, docs) for c in ("__n", "__k1", "__k2"))
    own = with_sets(docs.join(repeated, "doc_id", "left_semi").select(docs.columns), names)
    sets = judged.select(F.col("doc").alias("doc_id"), F.col("n").alias(n), F.col("k1").alias(k1), F.col("k2").alias(k2))
    own = own.join(sets, ["doc_id", *names], "left_semi")
    wordless, row = free("__text", docs), free("__row", docs)
    text = F.when(F.col(n) == 0, F.col("text")).alias(wordless)
    own = own.groupBy("doc_id", *names, text).agg(F.min(F.struct("text", *[c for c in docs.columns if c != "text"])).alias(row))
    return rows.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(own.select(f"{row}.*").select(docs.columns))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 30 words or more that stand earlier; documents that lose all words go.

    Texts that share an id are documents of their own, by hash, after all others.
    """
    columns = docs.columns
    docs, back = aside(docs, "n_words", "n_removed", "kept_words")
    repeated = repeated_ids(docs)
    if repeated.isEmpty():
        out = deduplicate(docs, window=30)
    else:
        again, key = free("__again", docs), free("__key", docs)
        own = F.when(F.col(again), F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 62)).otherwise(F.col("doc_id"))
        keyed = docs.join(repeated.withColumn(again, F.lit(True)), "doc_id", "left").withColumn(key, own).drop(again)
        out = deduplicate(keyed, key=key, window=30)
    return out.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns).withColumnsRenamed(back).select(columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents kept with their mixing rate as probability; those that are more likely clean than not stay.

    A document is never repeated, and a clean one never goes: so clean ones have
    rates over 1 (``whole``), and only the others are thinned. A document without
    text or words weighs nothing in the sums and has the prior as posterior.
    """
    columns = docs.columns
    docs, back = aside(docs, "n_tokens", "posteriors", "rate")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = mixing.mix(docs, queries.labelled_domains(docs, labels), TARGETS, whole="clean")
    return mixing.thin(mixed, "doc_id", keep=mixing.posterior_of(mixed, "clean") >= 0.5).select(docs.columns).withColumnsRenamed(back).select(columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids.

    Every row is packed, also one with a null or a repeated doc_id; a null text is
    empty and is one piece with the end alone. An empty table gives no rows.
    """
    return pack(docs, queries.tokenizer_path(), size=4096, end_id=1)


def _ready(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    return run


STAGES = [
    ("language_id", _ready(keep_known_languages)),
    ("minhash_dedup", _ready(keep_one_of_near_copies)),
    ("substring_dedup", _ready(remove_repeated_passages)),
    ("source_mixing", _ready(mix_to_targets)),
    ("best_fit_packing", _ready(pack_sequences)),
]

#: Learned stages and ids of a tokenizer are not SQL; tests/llm compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
