"""URL filters: listed host and path rules, then association rules mined from labelled URLs.

FP-growth finds token combinations that are frequent among unwanted URLs: tokens
in order of frequency, equal URLs merged, and conditional pattern bases grown up
to the longest rule. Each base carries all labelled URLs, so a combination's
confidence is counted with it, for every frequent one. A combination is dropped
if it is too rare, not sure enough, or contains a shorter one that is kept. A
rule stands in the inverted index under its rarest token; a URL looks up its
tokens and a rule found holds if the URL has all of its tokens. DataFrame
operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.storage import materialize

#: Up to so many rules or token sets are broadcast, after a count; above that Spark shuffles.
BROADCAST_SETS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, else nulls.

    A rule ``host/path`` fits its host and all subdomains, if the path begins with
    ``/path``. Of rules of one length the first in order counts.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in sorted(rules, key=lambda x: (len(x), x)):  # the longest is asked first
        own, _, rest = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(rules[name])).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: all host labels, words of hyphenated labels, path parts without digits, and query keys."""
    labels = F.filter(F.split(host(url), "[.]"), lambda x: x != "")
    words = F.filter(F.flatten(F.transform(labels, lambda x: F.when(F.contains(x, F.lit("-")), F.split(x, "-")).otherwise(F.array().cast("array<string>")))), lambda x: x != "")
    parts = F.filter(F.split(path(url), "/"), lambda x: (x != "") & ~x.rlike("[0-9]"))
    keys = F.filter(F.transform(F.split(F.regexp_extract(url, r"[?]([^#]*)", 1), "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")

    def some(kind: str, array: Column) -> Column:
        return F.transform(array, lambda x: F.concat(F.lit(kind), x))

    return F.coalesce(F.array_distinct(F.concat(some("host:", labels), some("word:", words), some("path:", parts), some("key:", keys))), F.array().cast("array<string>"))


@dataclass
class UrlRules:
    """rules: (rule_id, items, rare, support, confidence); n: their number."""

    rules: DataFrame
    n: int


def _hinted(sets: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sets) if n <= BROADCAST_SETS else sets


def match(urls: DataFrame, learned: UrlRules) -> DataFrame:
    """(url, rule_id, items) for each rule whose tokens ``urls`` (url, tokens) has all."""
    entries = urls.select("url", "tokens", F.explode("tokens").alias("rare"))
    rules = learned.rules.select("rare", "rule_id", "items")
    return entries.join(_hinted(rules, learned.n), "rare").where(F.size(F.array_except("items", "tokens")) == 0).select("url", "rule_id", "items")


def _grown(rows: DataFrame, counts: DataFrame, sure: Column, min_count: int, longest: int) -> list[DataFrame]:
    """(items, n, bad) of the frequent sets of each length from 2 to ``longest``, none of which holds a sure token or grows from a sure set."""
    words = materialize(counts.where((F.col("bad") >= min_count) & ~sure).select("item", "bad"), "url-words")
    own = rows.select("url", "unwanted", F.explode("tokens").alias("item")).join(_hinted(words, words.count()), "item")
    # The most frequent token first; URLs that are equal in these tokens are one row.
    line = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("bad")).alias("order"), "item"))), lambda x: x["item"])
    lines = own.groupBy("url", "unwanted").agg(line.alias("prefix"))
    base = lines.groupBy("prefix").agg(F.count("*").alias("n"), F.count_if("unwanted").alias("bad")).select(F.array().cast("array<string>").alias("suffix"), "prefix", "n", "bad")
    base = materialize(base, "url-lines")
    found, grow = [], None
    for _ in range(longest - 1):
        ends = base.select("suffix", F.posexplode("prefix").alias("at", "item"), "prefix", "n", "bad").select(F.array_append("suffix", F.col("item")).alias("suffix"), F.expr("slice(prefix, 1, at)").alias("prefix"), "n", "bad")
        if grow is not None:
            ends = ends.join(_hinted(grow, grow.count()), "suffix", "left_semi")
        base = ends.where(F.size("prefix") > 0).groupBy("suffix", "prefix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        base = materialize(base, "url-bases")
        sets = base.select("suffix", F.explode("prefix").alias("item"), "n", "bad").groupBy("suffix", "item").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("bad") >= min_count)
        sets = materialize(sets.select(F.array_append("suffix", F.col("item")).alias("items"), "n", "bad"), "url-sets")
        found.append(sets)
        grow = sets.where(~sure).select(F.col("items").alias("suffix"))
    return found


def learn(labelled: DataFrame, *, url: str = "url", label: str = "unwanted", min_count: int = 3, min_confidence: float = 0.9, longest: int = 3) -> UrlRules:
    """Mine rules from ``labelled`` (url, unwanted: boolean).

    All combinations of at most ``longest`` tokens that ``min_count`` unwanted URLs
    have, however large the table, unwanted in ``min_confidence`` of all labelled
    URLs that have them. Equal URLs count once for each label. Null URLs and labels
    teach nothing; without unwanted URLs there are no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(url).alias("url"), F.col(label).alias("unwanted")).where("url is not null and unwanted is not null").distinct()
    rows = materialize(rows.withColumn("tokens", tokens(F.col("url"))).where(F.size("tokens") > 0), "url-tokens")
    n_bad = rows.where("unwanted").count()
    kind = "rule_id long, items array<string>, rare string, support double, confidence double"
    if not n_bad:
        return UrlRules(spark.createDataFrame([], kind), 0)
    counts = rows.select("unwanted", F.explode("tokens").alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.count_if("unwanted").alias("bad"))
    counts = materialize(counts.where(F.col("bad") >= min_count), "url-counts")
    sure = F.col("bad") >= min_confidence * F.col("n")
    kept = counts.select(F.array("item").alias("items"), "n", "bad").where(sure)
    for sets in _grown(rows, counts, sure, min_count, longest):
        kept = kept.unionByName(sets.where(sure))
    kept = materialize(kept.withColumn("items", F.array_sort("items")).withColumn("rule_id", F.xxhash64("items")), "url-kept")
    # A rule goes if one of its parts is a rule; parts of at most `longest` tokens are few.
    whole = kept.select(F.array_join("items", "\n").alias("name"))
    drop = [F.transform("items", lambda x: F.array(x))]
    if longest > 2:
        drop.append(F.transform("items", lambda x: F.array_remove(F.col("items"), x)))
    parts = kept.where(F.size("items") > 1).select("rule_id", F.explode(F.concat(*drop)).alias("part")).where(F.size("part") > 0).select("rule_id", F.array_join("part", "\n").alias("name"))
    minimal = kept.join(parts.join(whole, "name").select("rule_id").distinct(), "rule_id", "left_anti")
    rare = minimal.select("rule_id", F.explode("items").alias("item")).join(counts.select("item", F.col("n").alias("many")), "item").groupBy("rule_id").agg(F.min_by("item", F.struct("many", "item")).alias("rare"))
    minimal = minimal.join(rare, "rule_id").select("rule_id", "items", "rare", (F.col("bad") / n_bad).alias("support"), (F.col("bad") / F.col("n")).alias("confidence"))
    minimal = materialize(minimal, "url-rules")
    return UrlRules(minimal, minimal.count())


def judge(pages: DataFrame, learned: UrlRules, rules: dict[str, str], *, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and mined (the mined rule that blocks, else null).

    A listed rule decides where one fits; else a URL is blocked if a mined rule
    holds, and allowed otherwise, null and empty URLs too. Each row is returned
    once, repeated ones as well; columns of the new names are replaced. URLs of any
    length are read whole. An empty table gives no rows.
    """
    new = ("host", "path", "rule", "verdict", "mined")
    kept = [c for c in pages.columns if c not in new]
    urls = pages.select(F.col(url).alias("url")).where("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    own = "__url"
    while own in kept:
        own += "_"
    hits = match(urls, learned).groupBy(F.col("url").alias(own)).agg(F.min(F.array_join("items", " ")).alias("mined"))
    rows = pages.select(*kept).join(hits, F.col(url) == F.col(own), "left").drop(own)
    rows = rows.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")))
    return rows.withColumn("mined", F.when(F.col("rule").isNull(), F.col("mined"))).select(*kept, *new)
