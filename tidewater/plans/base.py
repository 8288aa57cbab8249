"""Queries over the star schema and the event table, registered with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` gives the same rows where SQL can state them."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def day(c: str | Column) -> Column:
    """A date as text: the same in every engine, so years over 9999 have no sign. By way of the date, as no timestamp reaches the last ones."""
    return F.ltrim((F.col(c) if isinstance(c, str) else c).cast("date").cast("string"), F.lit("+"))


def nearest(value: Column, digits: int) -> Column:
    """A double rounded as the SQL does it: the whole number nearest to the product, divided again. F.round goes by the decimals the value is printed with, and differs at halves."""
    scale = 10.0**digits
    out = F.round(value * scale) / scale
    return F.when(F.abs(out) < float("inf"), out).otherwise(value)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    doubles = {c for c, kind in df.dtypes if kind == "double"}
    return df.withColumns({c: nearest(F.col(c), digits) if c in doubles else F.round(F.col(c), digits) for c in columns})


def orders_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, ts, value, id): order values by priority and date."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("ts"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("id"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, ts, value): mean event value by type and day."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("ts")).agg(F.avg("value").alias("value"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, month, value): gap-free monthly order totals by priority."""
    from tidewater.operators.resample import resample

    return resample(orders_by_priority(spark, sf_dir), "MS", ("sum",)).select("series", F.col("bin").alias("month"), F.col("sum").alias("value"))


#: The same as monthly_orders(), as a common table expression.
MONTHLY = """
    raw AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2),
    spine AS (SELECT series, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM raw GROUP BY series),
    monthly AS (SELECT series, month, coalesce(s, 0) AS value FROM spine LEFT JOIN raw USING (series, month))"""

#: The same as daily_events().
DAILY = """
    daily AS (SELECT event_type AS series, ts::DATE AS ts, avg(value) AS value FROM events GROUP BY 1, 2)"""
