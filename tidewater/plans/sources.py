"""Queries on public sources: rows of their shape are made from the tables, then validated and transformed."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidewater.functions import calendar
from tidewater.operators import folds, lags, metrics, payload, quality, registry, resample, scaling, seasonal
from tidewater.plans.base import DAILY, MONTHLY, daily_events, day, monthly_orders, query, rounded, table
from tidewater.sources import readers, transforms, validate

#: A series id for each order priority.
_IDS = {"1-URGENT": "CES0000000001", "2-HIGH": "CES0500000003", "3-MEDIUM": "LNS14000000", "4-NOT SPECIFIED": "LASST060000000000003", "5-LOW": "LASST060000000000005"}
_ID = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _IDS.items()) + " END"
_SERIES = f"""raw AS (SELECT {_ID} AS series_id, year(o_orderdate) AS y, month(o_orderdate) AS m, round(sum(o_totalprice) / 1000, 1) AS v FROM orders GROUP BY 1, 2, 3),
    ch AS (SELECT series_id, make_date(y, m, 1) AS d, m, v, round(v - lag(v) OVER w, 4) AS mom_change, round(v - lag(v, 12) OVER w, 4) AS yoy_change, m > 10 AS is_preliminary FROM raw WINDOW w AS (PARTITION BY series_id ORDER BY y, m))"""


def _series(spark, sf_dir):
    """Replies of a statistics interface: monthly sums with footnotes, and yearly means that must drop out."""
    ids = F.create_map(*[F.lit(x) for kv in _IDS.items() for x in kv])
    own = table(spark, sf_dir, "orders").select(ids[F.col("o_orderpriority")].alias("series_id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("m"), "o_totalprice")
    monthly = own.groupBy("series_id", "year", "m").agg(F.sum("o_totalprice").alias("s")).select("series_id", "year", F.format_string("M%02d", "m").alias("period"), F.col("m"), "s")
    yearly = own.groupBy("series_id", "year").agg(F.sum("o_totalprice").alias("s")).select("series_id", "year", F.lit("M13").alias("period"), F.lit(0).alias("m"), F.col("s"))
    note = F.when(F.col("m") == 11, F.struct(F.lit("Preliminary").alias("code"), F.lit(None).cast("string").alias("text"))).when(F.col("m") == 12, F.struct(F.lit("P").alias("code"), F.lit("preliminary figure").alias("text")))
    return monthly.union(yearly).select("series_id", "year", "period", F.round(F.col("s") / 1000, 1).alias("value"), F.array_compact(F.array(note)).alias("footnotes"))


def _changed(df):
    return rounded(df, 4, "mom_change", "yoy_change").withColumn("date", day("date"))


@query(f"""WITH {_SERIES} SELECT series_id, strftime(d, '%Y-%m-%d') AS date, v AS value, mom_change, yoy_change, is_preliminary, CASE WHEN series_id LIKE '%003' THEN 'dollars' ELSE 'thousands' END AS unit FROM ch""")
def employment_series(spark, sf_dir):
    """Employment series after parsing: dates, changes, units, preliminary values."""
    return _changed(transforms.employment(_series(spark, sf_dir))).select("series_id", "date", "value", "mom_change", "yoy_change", "is_preliminary", "unit")


_LOCAL = f"""{_SERIES}, local AS (SELECT *, CASE WHEN series_id LIKE 'LASST%' THEN substr(series_id, 6, 2) ELSE '00' END AS state_fips, CASE WHEN series_id LIKE 'LASST06%' THEN 'California' ELSE 'National' END AS state_name,
    CASE WHEN series_id LIKE '%LNS14%' OR series_id LIKE '%003' THEN 'unemployment_rate' WHEN series_id LIKE '%LNS12%' OR series_id LIKE '%005' THEN 'employment_level' ELSE 'other' END AS measure FROM ch)"""


def _local(spark, sf_dir):
    return transforms.local_unemployment(_series(spark, sf_dir), spark.createDataFrame([("06", "California"), ("36", "New York")], "state_fips string, state_name string"))


@query(f"""WITH {_LOCAL} SELECT series_id, strftime(d, '%Y-%m-%d') AS date, v AS value, mom_change, yoy_change, is_preliminary, state_fips, state_name, measure FROM local""")
def local_series(spark, sf_dir):
    """Local unemployment series with their state and measure."""
    return _changed(_local(spark, sf_dir)).select("series_id", "date", "value", "mom_change", "yoy_change", "is_preliminary", "state_fips", "state_name", "measure")


@query(f"""WITH {_LOCAL} SELECT state_name, state_fips, strftime(max(d), '%Y-%m-%d') AS date, arg_max(v, d) AS value, arg_max(mom_change, d) AS mom_change, arg_max(yoy_change, d) AS yoy_change FROM local WHERE measure = 'unemployment_rate' AND series_id <> 'CES0500000003' AND series_id <> 'LNS14000000' GROUP BY 1, 2""")
def state_summary(spark, sf_dir):
    """The latest rate of each state."""
    own = _local(spark, sf_dir).where("state_fips <> '00'")
    return _changed(transforms.state_summary(own, "unemployment_rate"))


@query(f"""WITH {_SERIES} SELECT 'CES0000000001' AS series_id, strftime(max(d), '%Y-%m-%d') AS date, arg_max(v, d) AS value FROM ch WHERE series_id = 'CES0000000001'""")
def latest_total(spark, sf_dir):
    """The newest row of the total series."""
    own = transforms.employment(_series(spark, sf_dir)).where("series_id = 'CES0000000001'").select("series_id", "date", "value")
    return transforms.latest_row(own, "date").withColumn("date", day("date"))


@query("""WITH c AS (SELECT n_name AS st, (o_orderdate::DATE + (7 - isodow(o_orderdate))::INT)::DATE AS d, count(*)::DOUBLE AS a, round(sum(o_totalprice))::DOUBLE AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 2) GROUP BY 1, 2)
    SELECT st AS state_code, strftime(d, '%Y-%m-%d') AS report_date, a AS initial_claims, b AS continued_claims, round(avg(a) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS initial_claims_4wk_ma, round(avg(b) OVER (w ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 4) AS continued_claims_13week FROM c WINDOW w AS (PARTITION BY st ORDER BY d)""")
def weekly_claims(spark, sf_dir):
    """Weekly claims of listed states from raw column names, with means of 4 and 13 weeks."""
    n = table(spark, sf_dir, "nation")
    listed = [r[0] for r in n.where("n_regionkey in (1, 2)").select("n_name").collect()]  # the list of states, 25 at most
    out = transforms.claims(readers.trimmed(_claims(spark, sf_dir)), listed)
    return rounded(rounded(out, 6, "initial_claims_4wk_ma"), 4, "continued_claims_13week").withColumn("report_date", day("report_date")).select("state_code", "report_date", "initial_claims", "continued_claims", "initial_claims_4wk_ma", "continued_claims_13week")


def _claims(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf_dir, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "n_name")
    rows = table(spark, sf_dir, "orders").join(c, "o_custkey").groupBy("n_name", calendar.week(F.col("o_orderdate")).alias("d")).agg(F.count("*").alias("a"), F.round(F.sum("o_totalprice")).alias("b"))
    return rows.select(F.col("n_name").alias(" ST "), day("d").alias("RptDate"), F.col("a").cast("string").alias("C3"), F.col("b").cast("string").alias("C8"))


_KINDS = {"click": "Withheld Individual Income Tax", "view": "Corporate INCOME TAX", "purchase": "Excise"}
_FLOWS = """b AS (SELECT CASE event_type WHEN 'click' THEN 'Withheld Individual Income Tax' WHEN 'view' THEN 'Corporate INCOME TAX' END AS classification, ts::DATE AS d, sum(value) AS balance FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
    f AS (SELECT *, balance - lag(balance) OVER (PARTITION BY classification ORDER BY d) AS flow FROM b)"""


def _flows(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    own = table(spark, sf_dir, "events").groupBy(F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("other")).alias("classification"), F.col("ts").cast("date").alias("date")).agg(F.sum("value").alias("balance"))
    return transforms.withholdings(own)


@query(f"""WITH {_FLOWS} SELECT classification, strftime(d, '%Y-%m-%d') AS date, round(flow, 4) AS daily_withholding, round(avg(flow) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS withholding_5day_ma, round(avg(flow) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) AS withholding_20day_ma,
    isodow(d) < 6 AS is_business_day, day(d)::INT AS day_of_month, day(d) BETWEEN 14 AND 16 AS is_mid_month, day(d) >= 28 AS is_month_end FROM f WINDOW w AS (PARTITION BY classification ORDER BY d)""")
def daily_withholdings(spark, sf_dir):
    """Daily flows of lines that name the income tax in any case, with means and calendar flags."""
    out = rounded(_flows(spark, sf_dir), 4, "daily_withholding", "withholding_5day_ma", "withholding_20day_ma")
    return out.drop("balance").withColumn("date", day("date"))


@query(f"""WITH {_FLOWS} SELECT classification, strftime(date_trunc('month', d), '%Y-%m-%d') AS month, round(sum(flow), 4) AS total, round(avg(flow), 4) AS mean, round(stddev_samp(flow), 4) AS std, round(arg_max(balance, d), 4) AS month_end_balance, strftime(max(d), '%Y-%m-%d') AS last_date, count(*) FILTER (isodow(d) < 6) AS business_days FROM f GROUP BY 1, 2""")
def monthly_withholdings(spark, sf_dir):
    """Those flows by month."""
    out = transforms.withholdings_monthly(_flows(spark, sf_dir))
    return rounded(out, 4, "total", "mean", "std", "month_end_balance").withColumns({"month": day("month"), "last_date": day("last_date")})


@query("""WITH k AS (SELECT date_trunc('month', o_orderdate)::DATE AS d, sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS total_applications, sum(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS high_propensity_applications, sum(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') AS business_formations FROM orders GROUP BY 1)
    SELECT strftime(d, '%Y-%m-%d') AS date, """ + ", ".join(f"round({c}, 2) AS {c}, round({c} - lag({c}) OVER w, 2) AS {c}_mom_change, round({c} - lag({c}, 12) OVER w, 2) AS {c}_yoy_change" for c in ("total_applications", "high_propensity_applications", "business_formations")) + """, round(business_formations / high_propensity_applications, 6) AS formation_rate FROM k WINDOW w AS (ORDER BY d)""")
def formations_by_month(spark, sf_dir):
    """Business formations by kind, with the rate of formations to high-propensity applications."""
    names = {"1-URGENT": "Business Applications", "2-HIGH": "Business Applications with Planned Wages", "3-MEDIUM": "Projected Formations", "4-NOT SPECIFIED": "Survey", "5-LOW": "High"}
    own = table(spark, sf_dir, "orders").select(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("o_orderpriority")].alias("category"), F.trunc("o_orderdate", "MM").alias("date"), F.col("o_totalprice").alias("value"))
    out = transforms.formations(own)
    return rounded(rounded(out, 6, "formation_rate"), 2, *[c for c in out.columns if c not in ("date", "formation_rate")]).withColumn("date", day("date"))


@query("""WITH s AS (SELECT last_day(l_shipdate::DATE) AS d, sum(l_quantity * 20) AS w, count(*) AS n, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS industry FROM lineitem GROUP BY 1)
    SELECT strftime(d, '%Y-%m-%d') AS date, w AS workers_involved, n AS num_stoppages, industry, w * n AS strike_impact_score, w > 50000 AS is_significant_month FROM s""")
def strike_months(spark, sf_dir):
    """Stoppages by month: workers, number, industries, score, and whether over 50,000 workers took part."""
    return transforms.strikes_monthly(_stoppages(spark, sf_dir)).withColumn("date", day("date"))


def _stoppages(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), (F.col("l_quantity") * 20).alias("workers_involved"), F.col("l_returnflag").alias("industry"))


@query("""SELECT strftime(last_day(l_shipdate::DATE), '%Y-%m-%d') AS date, sum(l_quantity * 20) AS workers_involved FROM lineitem WHERE last_day(l_shipdate::DATE) >= DATE '1999-03-01' GROUP BY 1 HAVING sum(l_quantity * 20) > 50000""")
def active_strikes(spark, sf_dir):
    """Significant months from the current one on."""
    return transforms.active_strikes(transforms.strikes_monthly(_stoppages(spark, sf_dir)), F.lit("1999-03-17").cast("date")).select(day("date").alias("date"), "workers_involved")


@query("""WITH s AS (SELECT last_day(o_orderdate::DATE) AS d, """ + ", ".join(f"sum(o_totalprice / 1000) FILTER (o_orderpriority LIKE '{k}%') AS {c}" for k, c in zip("12345", transforms.STOPPAGES.values(), strict=True)) + """ FROM orders GROUP BY 1)
    SELECT strftime(d, '%Y-%m-%d') AS date, """ + ", ".join(f"round({c}, 5) AS {c}" for c in transforms.STOPPAGES.values()) + """, 'All Industries (National)' AS industry, round(num_stoppages_beginning, 5) AS num_stoppages, round(workers_involved_thousands * 1000, 2) AS workers_involved, round(workers_involved_thousands * 1000 * num_stoppages_beginning, 0) AS strike_impact_score, coalesce(workers_involved_thousands > 50, false) AS is_significant_month FROM s""")
def stoppage_series(spark, sf_dir):
    """Five stoppage series as columns of a month, with their score."""
    ids = list(transforms.STOPPAGES)
    own = table(spark, sf_dir, "orders").select(F.element_at(F.array(*map(F.lit, ids)), F.substring("o_orderpriority", 1, 1).cast("int")).alias("series_id"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_totalprice") / 1000).alias("value"))
    out = transforms.stoppage_series(own)
    return rounded(rounded(rounded(out, 5, *transforms.STOPPAGES.values(), "num_stoppages"), 2, "workers_involved"), 0, "strike_impact_score").withColumn("date", day("date"))


#: Types of weather, one a size of part; the last has no severity of its own.
_TYPES = [*seasonal.SEVERITY, "Fog"]
_STORMS = f"""w AS (SELECT ([{", ".join(f"'{t}'" for t in _TYPES)}])[1 + p_size % {len(_TYPES)}] AS event_type, p_brand AS state, DATE '1970-01-01' + (p_partkey * 17)::INT AS d, CASE WHEN p_size <= 40 THEN p_size // 10 END AS deaths, CASE WHEN p_size >= 5 THEN p_size END AS injuries, p_retailprice AS damage FROM part)"""


def _storms(spark, sf_dir):
    size = F.col("p_size")
    kind = size % len(_TYPES) + 1  # 0 has none, below it they count from the end
    return table(spark, sf_dir, "part").select(
        F.when(kind != 0, F.element_at(F.array(*map(F.lit, _TYPES)), kind)).alias("event_type"),
        F.col("p_brand").alias("state"),
        F.date_add(F.lit("1970-01-01").cast("date"), (F.col("p_partkey") * 17).cast("int")).alias("date"),
        F.when(size <= 40, F.expr("p_size div 10").cast("int")).alias("deaths"),  # towards 0, below it too
        F.when(size >= 5, size).alias("injuries"),
        F.col("p_retailprice").alias("damage_millions"),
    )


_WEATHER = f"""{_STORMS}, m AS (SELECT date_trunc('month', d)::DATE AS month, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS event_type, string_agg(DISTINCT state, ', ' ORDER BY state) AS state, sum(deaths) AS deaths, sum(injuries) AS injuries, sum(damage) AS damage_millions, sum(coalesce(deaths, 0) * 100 + coalesce(injuries, 0) * 10 + damage / 10) AS score, min(d) AS date, count(*) AS num_major_events FROM w GROUP BY 1),
    q AS (SELECT quantile_cont(score, 0.75) AS q FROM m)"""


@query(f"""WITH {_WEATHER} SELECT strftime(month, '%Y-%m-%d') AS year_month, event_type, state, coalesce(deaths, 0)::BIGINT AS deaths, coalesce(injuries, 0)::BIGINT AS injuries, round(damage_millions, 2) AS damage_millions, round(score, 4) AS employment_impact_score, strftime(date, '%Y-%m-%d') AS date, num_major_events, score > q AS is_high_impact_month FROM m, q""")
def weather_months(spark, sf_dir):
    """Events by month with their score; missing casualties count 0."""
    out = transforms.weather_monthly(_storms(spark, sf_dir)).na.fill(0, ["deaths", "injuries"]).withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("event_type", "state")})
    return rounded(rounded(out, 2, "damage_millions"), 4, "employment_impact_score").withColumns({"year_month": day("year_month"), "date": day("date")})


@query(f"""WITH {_WEATHER} SELECT strftime(month, '%Y-%m-%d') AS year_month, round(score, 4) AS employment_impact_score FROM m WHERE date >= DATE '1978-06-30' - 180""")
def recent_disruptions(spark, sf_dir):
    """Months with events since half a year before a day."""
    out = transforms.recent_disruptions(transforms.weather_monthly(_storms(spark, sf_dir)), F.lit("1978-06-30").cast("date"))
    return rounded(out, 4, "employment_impact_score").select(day("year_month").alias("year_month"), "employment_impact_score")


_SEVERE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in seasonal.SEVERITY.items()) + " ELSE 1.0 END"
_EFFECTS = " UNION ALL ".join(
    f"""SELECT '{name}' AS kind, strftime(month, '%Y-%m-%d') AS month, round(raw / max(raw) OVER (), 6) AS impact FROM (SELECT date_trunc('month', d)::DATE AS month, least(20, sum(least(10, {_SEVERE} * least(5, 1 + 0.5 * coalesce(deaths, 0) + 0.1 * coalesce(injuries, 0))))) AS raw FROM w WHERE {where} GROUP BY 1)"""
    for name, where in (("all", "true"), ("hurricane", "event_type = 'Hurricane'"), ("winter", "event_type IN ('Blizzard', 'Ice Storm', 'Winter Storm')"))
)


@query(f"WITH {_STORMS} {_EFFECTS}")
def weather_effects(spark, sf_dir):
    """Monthly effects of all weather, of hurricanes, and of winter storms."""
    own = _storms(spark, sf_dir).withColumnRenamed("date", "begin_date")
    parts = [seasonal.weather_impact(own, kinds).withColumn("kind", F.lit(name)) for name, kinds in (("all", None), ("hurricane", seasonal.HURRICANES), ("winter", seasonal.WINTER_STORMS))]
    return rounded(parts[0].union(parts[1]).union(parts[2]), 6, "impact").withColumn("month", day("month"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice <= 0 THEN NULL WHEN p_retailprice <= 100 THEN 'Minor' WHEN p_retailprice <= 1000 THEN 'Moderate' WHEN p_retailprice <= 10000 THEN 'Major' ELSE 'Catastrophic' END AS class FROM part""")
def damage_classes(spark, sf_dir):
    """Classes of damage in millions."""
    return table(spark, sf_dir, "part").select("p_partkey", transforms.damage_class(F.col("p_retailprice")).alias("class"))


@query("""WITH e AS (SELECT date_trunc('month', o_orderdate)::DATE AS month FROM orders GROUP BY 1)
    SELECT strftime(month, '%Y-%m-%d') AS month, (month IN (DATE '1996-03-01', DATE '1997-07-01'))::INT::DOUBLE AS impulse, (month >= DATE '1996-03-12')::INT::DOUBLE AS step, round(CASE WHEN month < DATE '1996-03-12' THEN 0 WHEN month > DATE '1997-07-04' THEN 1 ELSE (count(*) FILTER (month >= DATE '1996-03-12') OVER (ORDER BY month) - 1) / ((SELECT count(*) FROM e WHERE month BETWEEN DATE '1996-03-12' AND DATE '1997-07-04') - 1) END, 8)::DOUBLE AS ramp FROM e""")
def event_regressors(spark, sf_dir):
    """Impulse, step and ramp effects of two dated events."""
    months = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "MM").alias("month")).distinct()
    events = spark.createDataFrame([(datetime.date(1996, 3, 12),), (datetime.date(1997, 7, 4),)], "date date")
    out = months
    for kind in ("impulse", "step", "ramp"):
        out = seasonal.month_regressors(out, events, kind=kind).withColumnRenamed("effect", kind)
    return rounded(out, 8, "ramp").withColumn("month", day("month"))


@query(f"""WITH {_SERIES}, c AS (SELECT count(*) AS n, count(DISTINCT series_id) AS k, max(y) AS last FROM raw)
    SELECT r.rule, r.severity, CASE WHEN r.failing > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, r.failing FROM (SELECT unnest([{{'rule': 'required_columns', 'severity': 'CRITICAL', 'failing': 0::BIGINT}}, {{'rule': 'no_nulls:series_id', 'severity': 'ERROR', 'failing': 0::BIGINT}}, {{'rule': 'no_nulls:year', 'severity': 'ERROR', 'failing': 0::BIGINT}}, {{'rule': 'no_nulls:period', 'severity': 'ERROR', 'failing': 0::BIGINT}}, {{'rule': 'no_nulls:value', 'severity': 'ERROR', 'failing': 0::BIGINT}},
        {{'rule': 'needed_series', 'severity': 'ERROR', 'failing': 0::BIGINT}}, {{'rule': 'fresh:year', 'severity': 'WARNING', 'failing': (last < 2023)::BIGINT}}, {{'rule': 'enough_series', 'severity': 'WARNING', 'failing': (k < 10)::BIGINT}}]) AS r FROM c)""")
def employment_rules(spark, sf_dir):
    """Rules of employment series."""
    return validate.validate(_series(spark, sf_dir), "bls_ces", datetime.date(2024, 6, 1)).select("rule", "severity", "status", "failing")


@query("""SELECT 'claims' AS source, true AS valid, 1::BIGINT AS warnings UNION ALL SELECT 'withholdings', false, 1 UNION ALL SELECT 'formations', (SELECT count(*) FILTER (c_acctbal < 0) = 0 FROM customer), 0 UNION ALL SELECT 'strikes', false, 0 UNION ALL SELECT 'weather', true, 0""")
def source_verdicts(spark, sf_dir):
    """Whether five sources may be transformed, and their warnings."""
    today = datetime.date(2024, 6, 1)
    own = {
        "claims": ("ui_claims", readers.trimmed(_claims(spark, sf_dir))),
        "withholdings": ("treasury_withholdings", table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", day("ts")).otherwise("none").alias("record_date"))),
        "formations": ("census_bfs", table(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("string").alias("value"))),
        "strikes": ("strikes", _stoppages(spark, sf_dir)),
        "weather": ("weather", _storms(spark, sf_dir)),
    }
    parts = None
    for name, (source, df) in own.items():
        results = validate.validate(df, source, today)
        failed = F.col("status") == "FAILED"
        one = results.agg(F.lit(name).alias("source"), (F.count_if(failed & (F.col("severity") != "WARNING")) == 0).alias("valid"), F.count_if(failed & (F.col("severity") == "WARNING")).alias("warnings"))
        parts = one if parts is None else parts.union(one)
    return parts


@query("""SELECT 'mostly_present:value' AS rule, CASE WHEN count(*) FILTER (event_type <> 'purchase') > 0.5 * count(*) THEN 'FAILED' ELSE 'PASSED' END AS status FROM events UNION ALL SELECT 'mostly_present:ts', 'PASSED'""")
def null_rules(spark, sf_dir):
    """Columns that are mostly null."""
    own = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return quality.check(own, [quality.mostly_present("value"), quality.mostly_present("ts")]).select("rule", "status")


@query("""SELECT false AS marked, false AS named, count(*) = 120 AS test_shape, count(*) = 120 AS suspect FROM orders""")
def table_provenance(spark, sf_dir):
    """Whether orders look like made-up data."""
    return quality.provenance(table(spark, sf_dir, "orders"))


@query(f"""WITH {MONTHLY} SELECT series, strftime(month, '%Y-%m-%d') AS month, round(value * 30.437 / day(last_day(month)), 2) AS adjusted FROM monthly""")
def adjusted_flows(spark, sf_dir):
    """Monthly totals as of a month of mean length."""
    m = F.col("month")
    return monthly_orders(spark, sf_dir).select("series", day("month").alias("month"), F.round(calendar.apply_factor(F.col("value"), calendar.adjustment_factor(m)), 2).alias("adjusted"))


@query("""WITH m AS (SELECT avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS b, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS scaled, round(o_totalprice, 2) AS o_totalprice FROM orders, m""")
def scaled_and_back(spark, sf_dir):
    """Two scalers one after the other, and their inverse."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    steps = scaling.ScalerPipeline([("standard", scaling.StandardScaler(["o_totalprice"])), ("minmax", scaling.MinMaxScaler(["o_totalprice"]))]).fit(own)
    forth = steps.transform(own)
    back = steps.inverse_transform(forth.withColumn("scaled", F.col("o_totalprice")))
    return rounded(rounded(back, 6, "scaled"), 2, "o_totalprice")


@query("""WITH d AS (SELECT event_type AS series, ts::DATE AS ts, avg(value) AS value FROM events GROUP BY 1, 2), b AS (SELECT series, (ts + (7 - isodow(ts))::INT)::DATE AS bin, avg(value) AS value FROM d GROUP BY 1, 2),
    s AS (SELECT series, unnest(generate_series(min(bin)::TIMESTAMP, max(bin)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS bin FROM b GROUP BY 1) SELECT series, strftime(bin, '%Y-%m-%d') AS week, round(value, 6) AS value FROM s LEFT JOIN b USING (series, bin)""")
def converted_weeks(spark, sf_dir):
    """Daily series as weekly means."""
    return rounded(resample.convert(daily_events(spark, sf_dir), "W", "mean", source="D"), 6, "value").select("series", day("bin").alias("week"), "value")


def _features(spark, sf_dir):
    """A registry made of parts: a feature a name, its source and version, and the brand that it depends on."""
    own = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("source"), F.max("p_size").alias("version"), F.array_sort(F.collect_set("p_brand")).alias("depends_on"))
    return own.withColumn("status", F.when(F.col("version") > 25, "active").otherwise("old"))


_FEATURES = """f AS (SELECT p_name AS name, min(p_type) AS source, max(p_size) AS version FROM part GROUP BY 1)"""


@query(f"""WITH {_FEATURES} SELECT name, source, version FROM f WHERE version > 25 ORDER BY name, version LIMIT 20 OFFSET 10""")
def searched_features(spark, sf_dir):
    """A page of the active features (a search result)."""
    return registry.search(_features(spark, sf_dir), limit=20, offset=10, status="active").select("name", "source", "version")


@query(f"""WITH {_FEATURES} SELECT name, version FROM f WHERE version > 25""")
def active_features(spark, sf_dir):
    """Active features."""
    return registry.active(_features(spark, sf_dir)).select("name", "version")


@query("""SELECT p_name AS child, p_brand AS parent FROM part GROUP BY 1, 2""")
def feature_edges(spark, sf_dir):
    """What each feature depends on."""
    return registry.edges_of(_features(spark, sf_dir))


@query("""SELECT DISTINCT p_name AS child FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)""")
def direct_descendants(spark, sf_dir):
    """Features that depend on the first brand."""
    own = _features(spark, sf_dir)
    first = own.agg(F.min(F.element_at("depends_on", 1))).first()[0]
    return registry.descendants(registry.edges_of(own), first)


@query(f"""WITH {_FEATURES} SELECT name, version, p_brand AS parent, NULL::INT AS parent_version FROM f JOIN (SELECT DISTINCT p_name AS name, p_brand FROM part) USING (name) WHERE version > 25""")
def lineage_view(spark, sf_dir):
    """Active features with what they depend on; brands are not registered."""
    own = _features(spark, sf_dir)
    return registry.lineage_view(own, registry.edges_of(own))


@query("""SELECT DISTINCT p_brand AS parent FROM part""")
def unregistered_parents(spark, sf_dir):
    """Names that features depend on and nobody registered."""
    own = _features(spark, sf_dir)
    return registry.unregistered(registry.edges_of(own), own)


_WINDOWS = """w AS (SELECT c_mktsegment AS subnet_id, o_orderdate::DATE AS event_date FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _windows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("subnet_id"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey").select("o_orderkey", "subnet_id", F.col("o_orderdate").cast("date").alias("event_date"), F.lit("T-5d").alias("opens"), F.lit("T+2d").alias("closes"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate::DATE - 5 <= DATE '1997-05-20' AND DATE '1997-05-20' < o_orderdate::DATE + 2""")
def open_windows(spark, sf_dir):
    """Submission windows that are open on a day."""
    return payload.open_windows(_windows(spark, sf_dir), F.lit("1997-05-20")).select("o_orderkey")


@query(f"""WITH {_WINDOWS} SELECT subnet_id, strftime(arg_min(event_date, (greatest(event_date - 5, DATE '1997-05-20'), event_date)), '%Y-%m-%d') AS event_date FROM w WHERE event_date + 2 > DATE '1997-05-20' GROUP BY 1""")
def next_windows(spark, sf_dir):
    """The window of each segment that is open or opens next."""
    own = _windows(spark, sf_dir).select("subnet_id", "event_date", "opens", "closes")
    return payload.next_windows(own, F.lit("1997-05-20")).select("subnet_id", day("event_date").alias("event_date"))


@query("""WITH o AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders), l AS (SELECT min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem)
    SELECT strftime(unnest(generate_series(date_trunc('month', greatest(o.a, l.a))::TIMESTAMP, date_trunc('month', least(o.b, l.b))::TIMESTAMP, INTERVAL 1 MONTH)), '%Y-%m-%d') AS target FROM o, l""")
def inferred_targets(spark, sf_dir):
    """Months that two sources cover."""
    own = {"orders": table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("ts")), "lines": table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("ts"))}
    return lags.infer_targets(own).select(day("target").alias("target"))


@query(f"""WITH {MONTHLY}, n AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM monthly),
    k AS (SELECT series, value, pos, unnest(range(0, greatest(0, (n - 1 - 3 - 24) // 6 + 1))) AS fold FROM n), m AS (SELECT series, fold, avg(value) AS f FROM k WHERE pos < 24 + 6 * fold GROUP BY 1, 2)
    SELECT fold::INT AS fold, series, round(sqrt(avg((value - f) * (value - f))), 2) AS rmse, round(avg(abs(value - f)), 2) AS mae FROM k JOIN m USING (series, fold) WHERE pos >= 25 + 6 * fold AND pos < 28 + 6 * fold GROUP BY 1, 2""")
def cross_validation(spark, sf_dir):
    """Scores of each fold of a model that forecasts the mean of its training rows."""
    out = folds.cross_validate_linear(monthly_orders(spark, sf_dir), "series", "month", [], "value", {"rmse": metrics.rmse("value", "f"), "mae": metrics.mae("value", "f")}, initial=24, step=6, horizon=3, gap=1)
    return rounded(out, 2, "rmse", "mae")


@query(f"""WITH {DAILY}, w AS (SELECT series, ts, value, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS pos FROM daily),
    p AS (SELECT series, pos, value, coalesce(value > lag(value) OVER (PARTITION BY series ORDER BY pos DESC), false) AS up FROM w WHERE pos <= 10)
    SELECT series, count(*) AS runs, bool_or(value > 1) FILTER (pos = 1) AS breached, count(*) FILTER (pos <= 3 AND up) = 3 AS rising, round(regr_slope(value, -pos::DOUBLE), 6) AS slope, count(*) FILTER (pos <= 3 AND up) = 3 OR regr_slope(value, -pos::DOUBLE) > 0.05 AS degrading FROM p GROUP BY 1""")
def degrading_series(spark, sf_dir):
    """Series whose last ten means rise as a quality measure must not."""
    own = daily_events(spark, sf_dir).select("series", F.col("ts").alias("run"), F.col("value").alias("q"))
    out = seasonal.degradation(own)
    return rounded(out.select("series", "runs", (F.size("breached") > 0).alias("breached"), (F.size("rising") > 0).alias("rising"), "slope", "degrading"), 6, "slope")
