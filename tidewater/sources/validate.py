"""What each public source must fulfil before it is transformed, as rules of operators.quality.

A failed rule of severity CRITICAL or ERROR rejects the table; a WARNING does not.
Rules run in one pass over the table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import quality
from tidewater.operators.quality import Rule

#: Series that must be there. Fixed values.
TOTAL_EMPLOYMENT = ("CES0000000001",)
NATIONAL_UNEMPLOYMENT = ("LNS14000000", "LNS12000000")
#: Pairs of columns that hold initial and continued claims, the first that is there counts. Fixed values.
CLAIM_COLUMNS = (("c3", "c8"), ("ic", "cc"))


def _none(name: str, severity: str, bad: Column) -> Rule:
    """No row may be ``bad``."""
    return Rule(name, severity, F.count_if(F.coalesce(bad, F.lit(False))))


def _some(name: str, severity: str, good: Column) -> Rule:
    """At least one row must be ``good``."""
    return Rule(name, severity, F.when(F.count_if(F.coalesce(good, F.lit(False))) == 0, 1).otherwise(0))


def _unparsed(column: str, kind: str) -> Column:
    return F.col(column).isNotNull() & F.col(column).cast("string").try_cast(kind).isNull()


def _stale(column: str, today: date, most_days: int) -> Rule:
    last = F.max(F.col(column).cast("string").try_cast("date"))
    return Rule(f"fresh:{column}", "WARNING", F.when(F.coalesce(F.datediff(F.lit(today), last), F.lit(most_days + 1)) > most_days, 1).otherwise(0))


def series(df: DataFrame, today: date, needed: tuple[str, ...], least_series: int) -> list[Rule]:
    """Rows of labour statistics: series_id, year, period, value."""
    must = ["series_id", "year", "period", "value"]
    rules = [quality.required_columns(df, must)]
    if set(must) - set(df.columns):
        return rules
    old = F.when(F.coalesce(F.max("year"), F.lit(0)) < today.year - 1, 1).otherwise(0)
    return [
        *rules,
        *[quality.no_nulls(c) for c in must],
        _some("needed_series", "ERROR", F.col("series_id").isin(*needed)),
        Rule("fresh:year", "WARNING", old),
        Rule("enough_series", "WARNING", F.when(F.count_distinct("series_id") < least_series, 1).otherwise(0)),
    ]


def employment(df: DataFrame, today: date) -> list[Rule]:
    return series(df, today, TOTAL_EMPLOYMENT, 10)


def local_unemployment(df: DataFrame, today: date) -> list[Rule]:
    return series(df, today, NATIONAL_UNEMPLOYMENT, 50)


def claims(df: DataFrame, today: date) -> list[Rule]:
    """Weekly claims with their raw names, trimmed and lower-cased: rptdate, st, and one of CLAIM_COLUMNS."""
    pair = next((p for p in CLAIM_COLUMNS if set(p) <= set(df.columns)), None)
    must = ["rptdate", "st", *(pair or CLAIM_COLUMNS[0])]
    rules = [quality.not_empty(), quality.required_columns(df, must)]
    if set(must) - set(df.columns):
        return rules
    nulls = Rule("no_nulls", "WARNING", F.count_if(F.greatest(*[F.col(c).isNull() for c in must])))
    numbers = [F.col(c).cast("string").try_cast("double") for c in pair]
    return [
        *rules,
        nulls,
        _none("dates", "ERROR", _unparsed("rptdate", "date")),
        *[_none(f"numbers:{c}", "ERROR", n.isNull() | F.isnan(n)) for c, n in zip(pair, numbers, strict=True)],
        *[_none(f"not_negative:{c}", "ERROR", n < 0) for c, n in zip(pair, numbers, strict=True)],
        _stale("rptdate", today, 30),
    ]


def withholdings(df: DataFrame, today: date) -> list[Rule]:
    rules = [quality.required_columns(df, ["record_date"])]
    if "record_date" not in df.columns:
        return rules
    return [*rules, quality.no_nulls("record_date"), _none("dates", "ERROR", _unparsed("record_date", "date")), _stale("record_date", today, 7), quality.enough_rows(30)]


def formations(df: DataFrame, today: date | None = None) -> list[Rule]:
    rules = [quality.not_empty(), quality.required_columns(df, ["value"])]
    return rules if "value" not in df.columns else [*rules, _none("not_negative:value", "ERROR", F.col("value").cast("string").try_cast("double") < 0)]


def strikes(df: DataFrame, today: date | None = None) -> list[Rule]:
    """No stoppages at all are fine; rows need a year or a period."""
    absent = not {"year", "period"} & set(df.columns)
    return [Rule("dated", "ERROR", F.when(F.count("*") > 0, int(absent)).otherwise(0))]


def weather(df: DataFrame, today: date | None = None) -> list[Rule]:
    """No events at all are fine; rows need a date."""
    return [Rule("dated", "ERROR", F.when(F.count("*") > 0, int("date" not in df.columns)).otherwise(0))]


#: Rules by source.
SOURCES = {"bls_ces": employment, "bls_laus": local_unemployment, "ui_claims": claims, "treasury_withholdings": withholdings, "census_bfs": formations, "strikes": strikes, "weather": weather}


def validate(df: DataFrame, source: str, today: date) -> DataFrame:
    """Results of quality.check() of the source's rules."""
    return quality.check(df, SOURCES[source](df, today))


def valid(results: DataFrame) -> bool:
    """Whether no rule that rejects has failed."""
    return results.where("status = 'FAILED' and severity <> 'WARNING'").isEmpty()
