"""Data quality rules, compiled to one aggregate a table however many rules there are."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import order

#: From worst to best; of severities and of what a failed rule makes of the whole.
OVERALL = {"CRITICAL": "BLOCKED", "ERROR": "FAILED", "WARNING": "WARNING"}
#: Loose groups that a declared type may be in, by parts of Spark's type names. Fixed values.
TYPE_GROUPS = {"numeric": ("int", "double", "float", "decimal", "short", "byte", "long"), "string": ("string", "char"), "datetime": ("date", "timestamp"), "boolean": ("boolean",)}


@dataclass(frozen=True)
class Rule:
    """A named count that must be at most 0: ``failing`` is an aggregate of failing rows (a number)."""

    name: str
    severity: str
    failing: Column
    detail: str = ""


def not_empty() -> Rule:
    return Rule("not_empty", "CRITICAL", F.when(F.count("*") == 0, 1).otherwise(0))


def required_columns(df: DataFrame, columns: list[str]) -> Rule:
    missing = [c for c in columns if c not in df.columns]
    return Rule("required_columns", "CRITICAL", F.lit(len(missing)), ", ".join(missing))


def column_types(df: DataFrame, expected: dict[str, str]) -> Rule:
    kinds = dict(df.dtypes)
    wrong = [c for c, g in expected.items() if c in kinds and not any(x in kinds[c] for x in TYPE_GROUPS[g])]
    return Rule("column_types", "ERROR", F.lit(len(wrong)), ", ".join(wrong))


def no_empty_columns(df: DataFrame) -> Rule:
    return Rule("no_empty_columns", "WARNING", reduce(lambda a, b: a + b, [F.when(F.count(c) == 0, 1).otherwise(0) for c in df.columns]))


def no_nulls(column: str) -> Rule:
    return Rule(f"no_nulls:{column}", "ERROR", F.count_if(F.col(column).isNull()))


def unique(columns: list[str], df: DataFrame) -> Rule:
    if absent := [c for c in columns if c not in df.columns]:
        return Rule(f"unique:{','.join(columns)}", "CRITICAL", F.lit(len(absent)), "absent: " + ", ".join(absent))
    return Rule(f"unique:{','.join(columns)}", "ERROR", F.count("*") - F.count_distinct(F.struct(*columns)))


def in_range(column: str, low: float | None, high: float | None) -> Rule:
    below = F.count_if(F.col(column) < low) if low is not None else F.lit(0)
    above = F.count_if(F.col(column) > high) if high is not None else F.lit(0)
    return Rule(f"in_range:{column}", "WARNING", below + above)


def mostly_present(column: str, most_null: float = 0.5) -> Rule:
    return Rule(f"mostly_present:{column}", "WARNING", F.when(F.count_if(F.col(column).isNull()) > most_null * F.count("*"), 1).otherwise(0))


def enough_rows(least: int) -> Rule:
    return Rule(f"enough_rows:{least}", "WARNING", F.when(F.count("*") < least, 1).otherwise(0))


def fresh(column: str, now: date, most_days: int) -> Rule:
    return Rule(f"fresh:{column}", "ERROR", F.when(F.coalesce(F.datediff(F.lit(now), F.max(column)), F.lit(most_days + 1)) > most_days, 1).otherwise(0))


def covers(column: str, least_days: int) -> Rule:
    return Rule(f"covers:{column}", "WARNING", F.when(F.coalesce(F.datediff(F.max(column), F.min(column)), F.lit(0)) < least_days, 1).otherwise(0))


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, severity, status, failing, detail): one pass over the data, one row a rule."""
    wide = df.agg(*[r.failing.cast("long").alias(f"r{k}") for k, r in enumerate(rules)])
    rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.when(F.col(f"r{k}") > 0, "FAILED").otherwise("PASSED").alias("status"), F.col(f"r{k}").alias("failing"), F.lit(r.detail).alias("detail")) for k, r in enumerate(rules)]
    return wide.select(F.inline(F.array(*rows)))


def summary(results: DataFrame) -> DataFrame:
    """One row: rules, passed, failed by severity, and the overall verdict of the worst failure."""
    bad = F.col("status") == "FAILED"
    overall = F.lit("PASSED")
    for severity in reversed(OVERALL):
        overall = F.when(F.count_if(bad & (F.col("severity") == severity)) > 0, OVERALL[severity]).otherwise(overall)
    return results.agg(F.count("*").alias("rules"), F.count_if(~bad).alias("passed"), *[F.count_if(bad & (F.col("severity") == s)).alias(f"failed_{s.lower()}") for s in OVERALL], overall.alias("overall"))


def outliers_iqr(df: DataFrame, key: str, value: str, k: float = 3.0) -> DataFrame:
    """Rows outside the quartiles by more than k times their distance, within each series; the quartiles are found by range, no task holds a series."""
    q = order.quantiles(df.select(key, value), value, [0.25, 0.75], [key], "__q").select(key, F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("q3"))
    spread = F.col("q3") - F.col("q1")
    return df.join(q, key).where((F.col(value) < F.col("q1") - k * spread) | (F.col(value) > F.col("q3") + k * spread)).drop("q1", "q3")


def outliers_zscore(df: DataFrame, key: str, value: str, k: float = 3.0) -> DataFrame:
    """Rows more than k standard deviations (n - 1) from the mean of their series."""
    m = df.groupBy(key).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    return df.join(m, key).where(F.abs(F.col(value) - F.col("__m")) > k * F.col("__s")).drop("__m", "__s")


def provenance(df: DataFrame) -> DataFrame:
    """One row: whether a table may be synthetic: marked so, named so by its generator, or of the shape of test data (120 rows)."""
    marked = F.coalesce(F.bool_or(F.col("is_synthetic")), F.lit(False)) if "is_synthetic" in df.columns else F.lit(False)
    named = F.coalesce(F.bool_or(F.lower("generated_by").rlike("synthetic|fallback|test")), F.lit(False)) if "generated_by" in df.columns else F.lit(False)
    out = df.agg(marked.alias("marked"), named.alias("named"), (F.count("*") == 120).alias("test_shape"))
    return out.withColumn("suspect", F.col("marked") | F.col("named") | F.col("test_shape"))


def as_csv(results: DataFrame) -> str:
    """Results of check(), one line a rule."""
    rows = results.orderBy("rule").collect()
    return "\n".join([",".join(results.columns), *(",".join('"' + str(v).replace('"', '""') + '"' for v in r) for r in rows)])


def as_html(results: DataFrame, title: str) -> str:
    """Results of check() as a table."""
    from html import escape

    head = "".join(f"<th>{escape(c)}</th>" for c in results.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in results.orderBy("rule").collect())
    return f"<!DOCTYPE html><title>{escape(title)}</title><table><tr>{head}</tr>{body}</table>"
