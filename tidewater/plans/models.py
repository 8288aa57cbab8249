"""Queries on models: decomposition, diagnostics, reconciliation, calibration, fits, registry, scenarios, payloads."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewater.operators import calibrate, models, payload, reconcile, registry, scenario, seasonal
from tidewater.plans.base import DAILY, MONTHLY, daily_events, day, monthly_orders, query, rounded, table
from tidewater.sources import transforms

_PARTS = f"""{MONTHLY}, w1 AS (SELECT series, month, value AS o, count(value) OVER a AS k, sum(value) OVER a AS outer_sum, avg(value) OVER a AS outer_mean, sum(value) OVER b AS inner_sum FROM monthly WINDOW a AS (PARTITION BY series ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), b AS (PARTITION BY series ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
    w2 AS (SELECT series, month, o, k = 13 AS whole, CASE WHEN k = 13 THEN (outer_sum + inner_sum) / 24 ELSE outer_mean END AS t FROM w1),
    w3 AS (SELECT series, month(month) AS m, coalesce(avg(o - t) FILTER (whole), avg(o - t)) AS raw FROM w2 GROUP BY 1, 2),
    w4 AS (SELECT series, m, raw - avg(raw) OVER (PARTITION BY series) AS s FROM w3),
    parts AS (SELECT w2.series, month, o, t, s, o - t - s AS i, o - s AS adj FROM w2 JOIN w4 ON w2.series = w4.series AND month(month) = m)"""


@query(f"""WITH {_PARTS} SELECT series, strftime(month, '%Y-%m-%d') AS month, round(o, 4) AS original, round(t, 4) AS trend, round(s, 4) AS seasonal, round(i, 4) AS irregular, round(adj, 4) AS adjusted FROM parts""")
def decomposition(spark, sf_dir):
    """Classical decomposition of monthly totals."""
    out = seasonal.decompose(monthly_orders(spark, sf_dir))
    return rounded(out, 4, "original", "trend", "seasonal", "irregular", "adjusted").withColumn("month", day("month"))


_MEASURES = f"""{_PARTS}, a0 AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series) AS n, lag(i) OVER w AS li, o - lag(o) OVER w AS d_o, i - lag(i) OVER w AS d_i, t - lag(t) OVER w AS d_t, i > avg(i) OVER (PARTITION BY series) AS above,
        CASE WHEN count(i) OVER c = 3 THEN avg(i) OVER c END AS i3, CASE WHEN count(t) OVER c = 3 THEN avg(t) OVER c END AS t3 FROM parts WINDOW w AS (PARTITION BY series ORDER BY month), c AS (PARTITION BY series ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
    a AS (SELECT *, (lag(above) OVER w IS DISTINCT FROM above)::INT AS run, abs(i3 - lag(i3) OVER w) AS di3, abs(t3 - lag(t3) OVER w) AS dt3 FROM a0 WINDOW w AS (PARTITION BY series ORDER BY month)),
    u AS (SELECT series, max(n) AS n, avg(di3) AS di3, avg(dt3) AS dt3, stddev_samp(i) AS si, stddev_samp(d_o) AS sdo, stddev_samp(d_i) AS sdi, stddev_samp(d_t) AS sdt, corr(i, li) AS r, var_samp(i) FILTER (pos < n // 2) AS v1, var_samp(i) FILTER (pos >= n // 2) AS v2, sum(run) AS runs, stddev_samp(s) AS ss, var_samp(s) AS vs,
        stddev_samp(s) FILTER (pos < floor(n * 0.75)) AS early, stddev_samp(s) FILTER (pos >= floor(n * 0.75)) AS late, regr_slope(s, pos::DOUBLE) AS slope FROM a GROUP BY 1),
    y AS (SELECT series, 10 * avg(abs(so - sa) / (abs(so) + 1e-10)) AS m8 FROM (SELECT series, year(month) AS y, sum(o) AS so, sum(adj) AS sa FROM parts GROUP BY 1, 2) GROUP BY 1),
    v AS (SELECT series, avg(v) AS v_month FROM (SELECT series, month(month) AS m, var_samp(s) AS v FROM parts GROUP BY 1, 2) GROUP BY 1),
    measures AS (SELECT series, n, CASE WHEN dt3 < 1e-10 THEN 3 ELSE di3 / dt3 END AS m1, CASE WHEN sdo < 1e-10 THEN 3 ELSE si / sdo * sqrt(2 / pi()) END AS m2, CASE WHEN sdt < 1e-6 THEN CASE WHEN si < 1e-10 THEN 0.5 ELSE sdi / si END ELSE sdi / sdt END AS m3, abs(r) * sqrt(n::DOUBLE) / 3 AS m4,
        CASE WHEN v1 + v2 < 1e-10 THEN 0 ELSE 2 * abs(v1 - v2) / (v1 + v2) END AS m5, abs(runs - n / 2) / (n / 2) AS m6, CASE WHEN ss < 1e-10 THEN 3 ELSE si / ss END AS m7, m8, CASE WHEN vs < 1e-10 THEN 0.5 ELSE v_month / vs END AS m9, CASE WHEN early < 1e-10 THEN 0.5 ELSE least(3, 2 * abs(late - early) / early) END AS m10, CASE WHEN ss < 1e-10 THEN 0.5 ELSE abs(12 * slope) / ss END AS m11
        FROM u JOIN y USING (series) JOIN v USING (series) WHERE n >= 24),
    verdict AS (SELECT *, (m1 + m2 + m3 + m4 + m5 + m6 + m7 + m8 + m9 + m10 + m11) / 11 AS q FROM measures)"""
_NAMES = [*(f"m{k}" for k in range(1, 12)), "q"]
_ROUNDED = ", ".join(f"round({c}, 5) AS {c}" for c in _NAMES)
_PENALTIES = " + ".join(f"{seasonal.WEIGHTS.get(c, 1.0)} * least(1.5, {c})" for c in _NAMES)


@query(f"WITH {_MEASURES} SELECT series, n, {_ROUNDED} FROM verdict")
def seasonal_measures(spark, sf_dir):
    """Quality measures of the decomposition."""
    out = seasonal.m_statistics(seasonal.decompose(monthly_orders(spark, sf_dir)))
    return rounded(out, 5, *_NAMES).select("series", "n", *_NAMES)


@query(f"""WITH {_MEASURES}, g AS (SELECT *, greatest(0, 100 - 100 * ({_PENALTIES}) / {sum(seasonal.WEIGHTS.get(c, 1.0) for c in _NAMES)}) AS score, greatest({", ".join(_NAMES)}) AS worst FROM verdict)
    SELECT series, q < 2 AS acceptable, round(score, 4) AS score, CASE WHEN worst < 0.5 AND score >= 50 THEN 'good' WHEN worst < 1 AND score >= 20 THEN 'acceptable' ELSE 'poor' END AS grade FROM g""")
def seasonal_verdict(spark, sf_dir):
    """The verdict on the mean of all eleven measures, their score and grade."""
    return rounded(seasonal.quality_score(seasonal.m_statistics(seasonal.decompose(monthly_orders(spark, sf_dir)))), 4, "score").select("series", "acceptable", "score", "grade")


@query(f"""WITH {_PARTS}, c AS (SELECT series, month, i - avg(i) OVER (PARTITION BY series) AS x, count(i) OVER (PARTITION BY series) AS n FROM parts),
    l AS (SELECT series, n, x, {", ".join(f"lag(x, {k}) OVER (PARTITION BY series ORDER BY month) AS x{k}" for k in range(1, 11))} FROM c WHERE n >= 20),
    b AS (SELECT series, max(n) AS n, max(n) * (max(n) + 2) * ({" + ".join(f"pow(sum(x * x{k}) / sum(x * x), 2) / (max(n) - {k})" for k in range(1, 11))}) AS q FROM l GROUP BY 1 HAVING max(n) >= 50),
    p AS (SELECT *, exp(-q / 2) * ({" + ".join(f"pow(q / 2, {k}) / {math.factorial(k)}" for k in range(5))}) AS p FROM b)
    SELECT series, n, 10::INT AS lags, round(q, 4) AS q, round(p, 6) AS p_value, p > 0.05 AS random FROM p""")
def ljung_box(spark, sf_dir):
    """Autocorrelation of the irregular component."""
    out = seasonal.ljung_box(seasonal.decompose(monthly_orders(spark, sf_dir)))
    return rounded(rounded(out, 4, "q"), 6, "p_value").where("n >= 50")


@query("""WITH e AS (SELECT l_shipdate::DATE AS a, CASE WHEN l_tax > 0 THEN l_shipdate::DATE + l_quantity::INT * 2 END AS b, l_partkey * 20 AS w, l_suppkey AS n FROM lineitem),
    m AS (SELECT unnest(generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', coalesce(b, a))::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month, w FROM e WHERE w >= 10000 AND n >= 7)
    SELECT strftime(month, '%Y-%m-%d') AS month, round(sum(w / 10000), 6) AS impact FROM m GROUP BY 1""")
def event_overlap(spark, sf_dir):
    """Effects of long events on every month that they cover."""
    start = F.col("l_shipdate").cast("date")
    end = F.when(F.col("l_tax") > 0, F.date_add(start, F.col("l_quantity").cast("int") * 2))
    events = table(spark, sf_dir, "lineitem").select(start.alias("start_date"), end.alias("end_date"), (F.col("l_partkey") * 20).alias("workers_involved"), F.col("l_suppkey").alias("days_duration"))
    return rounded(seasonal.strike_impact(events, most=None), 6, "impact").withColumn("month", day("month"))


@query("""WITH e AS (SELECT l_shipdate::DATE AS a, CASE WHEN l_tax > 0 THEN l_shipdate::DATE + l_quantity::INT * 2 END AS b, l_partkey * 20 AS w, l_suppkey AS n FROM lineitem),
    m AS (SELECT unnest(generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', coalesce(b, a))::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month, w FROM e WHERE w >= 10000 AND n >= 7)
    SELECT strftime(month, '%Y-%m-%d') AS month, round(least(10, sum(w / 10000)), 6) AS impact FROM m GROUP BY 1""")
def event_overlap_capped(spark, sf_dir):
    """The same with the cap of ten a month that effects have."""
    start = F.col("l_shipdate").cast("date")
    end = F.when(F.col("l_tax") > 0, F.date_add(start, F.col("l_quantity").cast("int") * 2))
    events = table(spark, sf_dir, "lineitem").select(start.alias("start_date"), end.alias("end_date"), (F.col("l_partkey") * 20).alias("workers_involved"), F.col("l_suppkey").alias("days_duration"))
    return rounded(seasonal.strike_impact(events), 6, "impact").withColumn("month", day("month"))


@query(f"""WITH {DAILY}, c AS (SELECT series, ts, value - avg(value) OVER (PARTITION BY series) AS x, count(value) OVER (PARTITION BY series) AS n FROM daily),
    l AS (SELECT series, n, x, {", ".join(f"lag(x, {k}) OVER (PARTITION BY series ORDER BY ts) AS x{k}" for k in range(1, 11))} FROM c WHERE n >= 20),
    b AS (SELECT series, max(n) AS n, least(10, max(n) // 5) AS lags, max(n) * (max(n) + 2) * ({" + ".join(f"CASE WHEN max(n) // 5 >= {k} THEN pow(sum(x * x{k}) / sum(x * x), 2) / (max(n) - {k}) ELSE 0 END" for k in range(1, 11))}) AS q FROM l GROUP BY 1),
    p AS (SELECT *, exp(-q / 2) * ({" + ".join(f"CASE WHEN lags > {2 * k} THEN pow(q / 2, {k}) / {math.factorial(k)} ELSE 0 END" for k in range(5))}) AS p FROM b)
    SELECT series, n, lags::INT AS lags, round(q, 4) AS q, round(p, 6) AS p_value, p > 0.05 AS random FROM p""")
def ljung_box_short(spark, sf_dir):
    """Autocorrelation of daily event means: a month of days has fewer than ten lags."""
    out = seasonal.ljung_box(daily_events(spark, sf_dir), ts="ts", value="value")
    return rounded(rounded(out, 4, "q"), 6, "p_value")


@query(f"""WITH {_MEASURES}, um AS (SELECT series, unnest(['{"', '".join(_NAMES[:-1])}']) AS measure, unnest([{", ".join(_NAMES[:-1])}]) AS value FROM verdict)
    SELECT series, measure, round(value, 5) AS value, CASE WHEN value < 1 THEN 'good' WHEN value < 2 THEN 'acceptable' WHEN value < 3 THEN 'warning' ELSE 'fail' END AS grade, round(greatest(0, least(100, 100 * (1 - value / 3))), 3) AS score, measure IN ('m1', 'm2', 'm3', 'm7', 'm8', 'm9') AND value > 2 AS problem FROM um""")
def measure_grades(spark, sf_dir):
    """Each measure of the decomposition with its grade and score."""
    out = seasonal.measure_grades(seasonal.m_statistics(seasonal.decompose(monthly_orders(spark, sf_dir))))
    return rounded(rounded(out, 5, "value"), 3, "score")


@query(f"""WITH {DAILY}, w AS (SELECT series, ts, value, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS pos FROM daily)
    SELECT series, count(*) AS observations, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(regr_slope(value, -pos::DOUBLE), 6) AS slope, round(max(value) FILTER (pos = 1), 6) AS current, stddev_samp(value) < 0.2 AS stable, regr_slope(value, -pos::DOUBLE) > 0.05 AS degrading, CASE WHEN max(value) FILTER (pos = 1) < 1 THEN 'good' WHEN max(value) FILTER (pos = 1) < 2 THEN 'acceptable' ELSE 'poor' END AS grade FROM w WHERE pos <= 12 GROUP BY 1""")
def quality_stability(spark, sf_dir):
    """How steady each type's daily means were over the last twelve days, and the grade of the last."""
    out = seasonal.stability(daily_events(spark, sf_dir), value="value").withColumn("grade", seasonal.q_grade(F.col("current")))
    return rounded(out, 6, "mean", "std", "slope", "current")


@query("""SELECT l_orderkey, l_linenumber, l_quantity AS m1, l_tax AS m11, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_discount END AS q, CASE WHEN l_returnflag = 'N' THEN 24.0::DOUBLE END AS ljung_box_lag, CASE WHEN l_returnflag = 'N' THEN l_extendedprice END AS ljung_box_q, CASE WHEN l_returnflag = 'N' THEN l_tax END AS ljung_box_pvalue,
        l_quantity AS seasonality_f, l_discount AS seasonality_pvalue, l_discount < 0.05 AS seasonality_significant, CASE WHEN l_linestatus = 'F' THEN l_tax END AS trading_day_f, CASE WHEN l_linestatus = 'F' THEN l_discount END AS trading_day_pvalue, CASE WHEN l_linestatus = 'F' THEN l_discount < 0.05 END AS trading_day_significant FROM lineitem""")
def diagnostic_reports(spark, sf_dir):
    """Numbers of text reports, one a line item, read back by pattern; some reports lack some."""
    number = lambda c: F.format_string("%.2f", F.col(c))
    lines = [
        F.concat(F.lit(" M1 = "), number("l_quantity")),
        F.concat(F.lit(" M11 : "), number("l_tax")),
        F.when(F.col("l_returnflag") != "A", F.concat(F.lit(" Q = "), number("l_discount"))),
        F.when(F.col("l_returnflag") == "N", F.concat(F.lit("Ljung-Box Q(24) = "), number("l_extendedprice"), F.lit(", p-value = "), number("l_tax"))),
        F.concat(F.lit("Combined seasonality test: F = "), number("l_quantity"), F.lit(" p-value: "), number("l_discount")),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("Trading day F = "), number("l_tax"), F.lit(" p-value = "), number("l_discount"))),
    ]
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("\n", *lines).alias("report"))
    return seasonal.parse_reports(own, "report").select("l_orderkey", "l_linenumber", "m1", "m11", "q", "ljung_box_lag", "ljung_box_q", "ljung_box_pvalue", "seasonality_f", "seasonality_pvalue", "seasonality_significant", "trading_day_f", "trading_day_pvalue", "trading_day_significant")


def _hierarchy(spark, sf_dir):
    """A row a month: the regions' order totals and their sum."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, sf_dir, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "n_regionkey")
    wide = table(spark, sf_dir, "orders").join(c, "o_custkey").groupBy(F.trunc("o_orderdate", "MM").alias("month")).pivot("n_regionkey", [0, 1, 2, 3, 4]).agg(F.sum("o_totalprice"))
    parts = [F.coalesce(F.col(str(k)), F.lit(0.0)).alias(f"r{k}") for k in range(5)]
    return wide.select("month", *parts).withColumn("total", sum((F.col(f"r{k}") for k in range(1, 5)), F.col("r0")))


@query("""WITH h AS (SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total, """ + ", ".join(f"coalesce(sum(o_totalprice) FILTER (n_regionkey = {k}), 0) AS r{k}" for k in range(5)) + """ FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT count(*) AS months, bool_and(abs(total - r0 - r1 - r2 - r3 - r4) < 0.01) AS coherent FROM h""")
def hierarchy_coherence(spark, sf_dir):
    """Whether regions add up to the total in every month."""
    h = _hierarchy(spark, sf_dir)
    out = h.agg(F.count("*").alias("months"), F.bool_and(F.abs(reconcile.incoherence(h, "total", [f"r{k}" for k in range(5)])) < 0.01).alias("coherent"))
    return out


_NODES = ["total", *(f"r{k}" for k in range(5))]
_BASE = """h AS (SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total, """ + ", ".join(f"coalesce(sum(o_totalprice) FILTER (n_regionkey = {k}), 0) AS r{k}" for k in range(5)) + """ FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    f AS (SELECT month, """ + ", ".join(f"{c} * {1 + 0.02 * k!r} AS {c}" for k, c in enumerate(_NODES)) + """ FROM h),
    v AS (SELECT """ + ", ".join(f"greatest(var_samp({c} * {0.01 * (k + 1)!r} * sin(month(month) * {k + 2})), 1e-8) AS v{k}" for k, c in enumerate(_NODES)) + """ FROM h),
    g AS (SELECT *, total - r0 - r1 - r2 - r3 - r4 AS gap, v0 + v1 + v2 + v3 + v4 + v5 AS all_v FROM f, v)"""


def _reconciled(spark, sf_dir, method):
    h, parts, at = _hierarchy(spark, sf_dir), _NODES[1:], F.month("month")
    errors = h.select(*[(F.col(c) * (F.lit(0.01) * (k + 1)) * F.sin(at * (k + 2))).alias(c) for k, c in enumerate(_NODES)])
    base = h.select("month", *[(F.col(c) * (1 + 0.02 * k)).alias(c) for k, c in enumerate(_NODES)])
    return rounded(reconcile.reconcile(base, errors, "total", parts, method), 1, *_NODES).withColumn("month", day("month"))


#: The covariance of errors shrunk to their mean variance, and what a coherent projection needs of it: its product with the gap's coefficients.
_SHRUNK = f"""{_BASE}, x AS (SELECT """ + ", ".join(f"e{k} - avg(e{k}) OVER () AS x{k}" for k in range(6)) + " FROM (SELECT " + ", ".join(f"{c} * {0.01 * (k + 1)!r} * sin(month(month) * {k + 2}) AS e{k}" for k, c in enumerate(_NODES)) + """ FROM h)),
    m AS (SELECT count(*) AS n, avg(pow(""" + " + ".join(f"x{k} * x{k}" for k in range(6)) + ", 2)) AS fourth, " + ", ".join(f"avg(x{i} * x{j}) AS s{i}{j}" for i in range(6) for j in range(i, 6)) + """ FROM x),
    d AS (SELECT *, (""" + " + ".join(f"s{k}{k}" for k in range(6)) + ") / 6 AS mu, " + " + ".join(f"{1 if i == j else 2} * s{i}{j} * s{i}{j}" for i in range(6) for j in range(i, 6)) + """ AS squares FROM m),
    w AS (SELECT *, least(greatest((fourth - squares) / n, 0), squares - 6 * mu * mu) / (squares - 6 * mu * mu) AS weight FROM d),
    c AS (SELECT """ + ", ".join(f"(1 - weight) * s{i}{j}" + (" + weight * mu" if i == j else "") + f" AS c{i}{j}" for i in range(6) for j in range(i, 6)) + ", weight FROM w)"


def _pull(i: int) -> str:
    """Row i of the shrunk covariance times (1, -1, ..., -1)."""
    return "(" + f"c0{i}" + "".join(f" - c{min(i, j)}{max(i, j)}" for j in range(1, 6)) + ")"


_SPREAD = "(" + _pull(0) + "".join(f" - {_pull(j)}" for j in range(1, 6)) + ")"


@query(f"""WITH {_SHRUNK} SELECT strftime(month, '%Y-%m-%d') AS month, """ + ", ".join(f"round({c} - gap * {_pull(k)} / {_SPREAD}, 1) AS {c}" for k, c in enumerate(_NODES)) + " FROM g, c")
def reconciled(spark, sf_dir):
    """Forecasts that don't add up, made coherent by the shrunk covariance of their errors."""
    return _reconciled(spark, sf_dir, "mint_shrink")


@query(f"""WITH {_SHRUNK} """ + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(c{min(i, j)}{max(i, j)}, 2) AS value, round(weight, 8) AS weight FROM c" for i, a in enumerate(_NODES) for j, b in enumerate(_NODES)))
def shrunk_covariance(spark, sf_dir):
    """The covariance of forecast errors shrunk to their mean variance, and the weight of that."""
    h, at = _hierarchy(spark, sf_dir), F.month("month")
    errors = h.select(*[(F.col(c) * (F.lit(0.01) * (k + 1)) * F.sin(at * (k + 2))).alias(c) for k, c in enumerate(_NODES)])
    w, weight = reconcile.shrunk(errors, _NODES)
    return spark.createDataFrame([(a, b, round(float(w[i, j]), 2), round(weight, 8)) for i, a in enumerate(_NODES) for j, b in enumerate(_NODES)], "a string, b string, value double, weight double")


@query(f"""WITH {_BASE} SELECT strftime(month, '%Y-%m-%d') AS month, """ + ", ".join(f"round({c} {'-' if k == 0 else '+'} gap / 6, 1) AS {c}" for k, c in enumerate(_NODES)) + " FROM g")
def reconciled_ols(spark, sf_dir):
    """Forecasts made coherent with all errors alike."""
    return _reconciled(spark, sf_dir, "ols")


@query(f"""WITH {_BASE} SELECT strftime(month, '%Y-%m-%d') AS month, """ + ", ".join(f"round({c} {'-' if k == 0 else '+'} gap * v{k} / all_v, 1) AS {c}" for k, c in enumerate(_NODES)) + " FROM g")
def reconciled_wls(spark, sf_dir):
    """Forecasts made coherent by the variances of their errors."""
    return _reconciled(spark, sf_dir, "wls")


@query("""WITH r AS (SELECT l_returnflag AS series, abs(l_extendedprice - 1400 * l_quantity) AS r FROM lineitem), n AS (SELECT series, count(*) AS n FROM r GROUP BY 1)
    SELECT series, round(CASE series """ + " ".join(f"WHEN '{f}' THEN (SELECT (list_sort(list(r)))[1 + floor((count(*) - 1) * least(1, 0.9 + 1.0 / (count(*) + 1)))::INT] + ((list_sort(list(r)))[least(count(*), 2 + floor((count(*) - 1) * least(1, 0.9 + 1.0 / (count(*) + 1)))::INT)] - (list_sort(list(r)))[1 + floor((count(*) - 1) * least(1, 0.9 + 1.0 / (count(*) + 1)))::INT]) * ((count(*) - 1) * least(1, 0.9 + 1.0 / (count(*) + 1)) - floor((count(*) - 1) * least(1, 0.9 + 1.0 / (count(*) + 1)))) FROM r WHERE series = '{f}')" for f in "ANR") + """ END, 4) AS width FROM n""")
def conformal_widths(spark, sf_dir):
    """Half-widths of 90 % intervals by series."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series"), F.col("l_extendedprice").alias("y"), (1400 * F.col("l_quantity")).alias("f"))
    return rounded(calibrate.conformal_width(own, "y", "f", 0.9, ["series"]), 4, "width")


@query("""WITH g AS (SELECT (l_quantity - 1) / 50.0 AS p, count(*) AS n, count(*) FILTER (l_extendedprice > 45000) AS s FROM lineitem GROUP BY 1),
    w AS (SELECT a.p AS lo, b.p AS hi, sum(c.s) / sum(c.n) AS m FROM g a JOIN g b ON a.p <= b.p JOIN g c ON c.p BETWEEN a.p AND b.p GROUP BY 1, 2),
    k AS (SELECT g.p, lo, min(m) AS m FROM g JOIN w ON lo <= g.p AND hi >= g.p GROUP BY 1, 2)
    SELECT g.p, round(max(m), 6) AS calibrated, round(any_value(s / n), 6) AS share, any_value(n) AS n FROM g JOIN k ON k.p = g.p GROUP BY 1""")
def isotonic_calibration(spark, sf_dir):
    """Probabilities calibrated by a rising function: mean by step."""
    own = table(spark, sf_dir, "lineitem").select(((F.col("l_quantity") - 1) / 50.0).alias("p"), (F.col("l_extendedprice") > 45000).cast("double").alias("y"))
    out = calibrate.isotonic(own, own, "p", "y")
    return rounded(out.groupBy("p").agg(F.avg("calibrated").alias("calibrated"), F.avg("y").alias("share"), F.count("*").alias("n")), 6, "calibrated", "share")


_CALIBRATION = """x AS (SELECT s_suppkey, s_acctbal AS y, 180.0 * s_nationkey AS f FROM supplier), c AS (SELECT abs(y - f) AS r, f AS p, row_number() OVER (ORDER BY abs(y - f), f) AS pos FROM x), n AS (SELECT count(*) AS n, stddev_pop(p) * 0.1 AS h FROM c),
    pl AS (SELECT l[1 + floor(q)::INT] + (l[least(k, 2 + floor(q)::INT)] - l[1 + floor(q)::INT]) * (q - floor(q)) AS plain FROM (SELECT list_sort(list(r)) AS l, count(*) AS k, (count(*) - 1) * least(1, 0.9 + 1.0 / (count(*) + 1)) AS q FROM c))"""


@query(f"""WITH {_CALIBRATION}, k AS (SELECT s_suppkey, pos, r, exp(-abs(p - f) / h) AS w FROM x, c, n), t AS (SELECT s_suppkey, pos, r, sum(w / (tw + 1e-10)) OVER (PARTITION BY s_suppkey ORDER BY pos) AS share FROM (SELECT *, sum(w) OVER (PARTITION BY s_suppkey) AS tw FROM k)),
    b AS (SELECT s_suppkey, count(*) FILTER (share < 0.9) AS before FROM t GROUP BY 1)
    SELECT s_suppkey, round(0.7 * c.r + 0.3 * plain, 4) AS width FROM b JOIN n ON true JOIN pl ON true JOIN c ON c.pos = least(before + 1, n.n)""")
def adaptive_widths(spark, sf_dir):
    """Half-widths by how far residuals reach near each forecast."""
    own = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("y"), (F.col("s_nationkey") * 180.0).alias("f"))
    return rounded(calibrate.adaptive_width(own, own, "y", "f"), 4, "width").select("s_suppkey", "width")


@query("""WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS f FROM lineitem), p AS (SELECT *, rank() OVER (ORDER BY f) - 1 AS pos, count(*) OVER () AS n FROM x), s AS (SELECT *, least(4, pos // (n // 5))::INT AS stratum FROM p)
    SELECT stratum, count(*) AS n, round(avg((y BETWEEN f - 12000 AND f + 12000)::INT), 6) AS coverage, round(avg(24000), 6)::DOUBLE AS width FROM s GROUP BY 1""")
def coverage_strata(spark, sf_dir):
    """Coverage by fifths of the forecasts."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("f"))
    own = own.withColumn("low", F.col("f") - 12000).withColumn("high", F.col("f") + 12000)
    return rounded(calibrate.coverage_by_stratum(own, "y", "f", "low", "high"), 6, "coverage", "width")


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, 1400 * l_quantity AS b, l_quantity * 1500 - 2000 AS c FROM lineitem),
    m AS (SELECT *, least(a, (a + b) / 2, (a + b + c) / 3) AS x, greatest(least(a, (a + b) / 2, (a + b + c) / 3), least(b, (b + c) / 2)) AS y0, least((a + b) / 2, (a + b + c) / 3) AS y1, greatest((a + b + c) / 3, (b + c) / 2, c) AS z FROM q)
    SELECT l_orderkey, l_linenumber, round(x, 4) AS q10, round(greatest(y1, least(b, (b + c) / 2)), 4) AS q50, round(z, 4) AS q90 FROM m""")
def rising_quantiles(spark, sf_dir):
    """Quantiles without crossing."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("q10"), (1400 * F.col("l_quantity")).alias("q50"), (F.col("l_quantity") * 1500 - 2000).alias("q90"))
    return rounded(own.select("l_orderkey", "l_linenumber", *calibrate.rising(["q10", "q50", "q90"])), 4, "q10", "q50", "q90")


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS weight, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem""")
def least_squares(spark, sf_dir):
    """A fit by normal equations from aggregates."""
    m = models.ridge(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", penalty=0.0)
    return spark.createDataFrame([(round(m.weights[0], 4), round(m.intercept, 2))], "weight double, intercept double")


@query()
def midas_fit(spark, sf_dir):
    """A lag model of monthly totals: fitted values by month."""
    from tidewater.operators import windows

    w = windows.over("series", "month")
    rows = monthly_orders(spark, sf_dir).select("series", "month", "value", *[F.lag("value", k).over(w).alias(f"lag_{k}") for k in range(1, 5)])
    m = models.midas(rows, {"own": [f"lag_{k}" for k in range(1, 5)]}, "value")
    return rows.select("series", day("month").alias("month"), m.predict().alias("fitted"))


@query()
def factor_model(spark, sf_dir):
    """Two factors of daily event means, and a ridge head on them."""
    wide = daily_events(spark, sf_dir).groupBy("ts").pivot("series", ["click", "error", "purchase", "signup", "view"]).agg(F.first("value"))
    m = models.factors(wide, ["click", "error", "purchase", "signup"], 2, "view")
    return m.transform(wide).select(day("ts").alias("day"), "factor_1", "factor_2", m.head.predict().alias("fitted"))


@query(f"""WITH RECURSIVE {DAILY}, n AS (SELECT series, ts, value, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM daily),
    k(series, i, level, variance) AS (SELECT series, i, value, 1e6 + 0.1 FROM n WHERE i = 1 UNION ALL SELECT n.series, n.i, level + (variance + 0.1) / (variance + 1.1) * (value - level), (variance + 0.1) / (variance + 1.1) FROM k JOIN n ON n.series = k.series AND n.i = k.i + 1)
    SELECT series, strftime(ts, '%Y-%m-%d') AS ts, round(value, 6) AS value, round(level, 6) AS level FROM k JOIN n USING (series, i)""")
def filtered_levels(spark, sf_dir):
    """Filtered level of each type's daily means."""
    return rounded(models.filtered_levels(daily_events(spark, sf_dir)), 6, "value", "level").withColumn("ts", day("ts"))


@query()
def ensemble_weights(spark, sf_dir):
    """Weights on the simplex for three forecasts."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (1400 * F.col("l_quantity")).alias("a"), (F.lit(36_000.0)).alias("b"), (F.col("l_quantity") * 1600).alias("c"))
    w = calibrate.simplex_weights(own, "y", ["a", "b", "c"])
    return spark.createDataFrame(sorted(w.items()), "forecast string, weight double")


#: Features by part type: each depends on the types of smaller parts of its brand. Edges are derived from the data.
_EDGES = """edges AS (SELECT DISTINCT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region UNION SELECT DISTINCT 'segment ' || c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _edges(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    one = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    two = region.select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent"))
    three = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("segment "), "c_mktsegment").alias("child"), F.col("n_name").alias("parent"))
    return one.union(two).union(three).distinct()


@query(f"""WITH RECURSIVE {_EDGES}, up(node, ancestor, depth) AS (SELECT n, n, 0 FROM (SELECT child AS n FROM edges UNION SELECT parent FROM edges) UNION ALL SELECT up.node, e.parent, up.depth + 1 FROM up JOIN edges e ON up.ancestor = e.child WHERE up.depth < 20)
    SELECT node, ancestor, min(depth) AS depth FROM up GROUP BY 1, 2""")
def lineage(spark, sf_dir):
    """Every node's ancestors with their distance."""
    return registry.ancestors(spark, _edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, up(node, ancestor, depth) AS (SELECT n, n, 0 FROM (SELECT child AS n FROM edges UNION SELECT parent FROM edges) UNION ALL SELECT up.node, e.parent, up.depth + 1 FROM up JOIN edges e ON up.ancestor = e.child WHERE up.depth < 20)
    SELECT ancestor, count(DISTINCT node) AS dependents FROM up WHERE depth > 0 GROUP BY 1""")
def rollback_impact(spark, sf_dir):
    """How many nodes depend on each."""
    return registry.impact(registry.ancestors(spark, _edges(spark, sf_dir)))


@query("""SELECT c_mktsegment AS name, 'customer' AS source, 'active' AS status, 2 AS version FROM (SELECT DISTINCT c_mktsegment FROM customer) UNION ALL SELECT c_mktsegment, 'customer', 'old', 1 FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def registered_features(spark, sf_dir):
    """A registry after a second release of its features: versions go up, the first vintage stays."""
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    first = names.select("name", F.lit("customer").alias("source"), F.lit("old").alias("status"), F.lit("2024-01-01").alias("vintage_date"), F.lit(1).alias("version"))
    second = names.select("name", F.lit("customer").alias("source"), F.lit("active").alias("status"), F.lit("2024-02-01").alias("vintage_date"), F.lit(0).alias("version"))
    return registry.register(first, second).select("name", "source", "status", "version")


@query("""WITH b AS (SELECT event_type AS feature, avg(value) AS v FROM events GROUP BY 1), x AS (SELECT feature, v, (v + 5) * 1.1 AS up, 10 AS fixed FROM b)
    SELECT 'boost' AS scenario, round(sum((up - v) * 2), 6) AS delta, round(sum((up - v) * 2) + 100, 6) AS forecast, 'up' AS direction, abs(sum((up - v) * 2)) > 5 AS material, 0::BIGINT AS unknown FROM x
    UNION ALL SELECT 'fixed', round(sum((fixed - v) * 2), 6), round(sum((fixed - v) * 2) + 100, 6), CASE WHEN sum(fixed - v) > 0 THEN 'up' WHEN sum(fixed - v) < 0 THEN 'down' ELSE 'flat' END, abs(sum((fixed - v) * 2)) > 5, 0 FROM x""")
def scenarios(spark, sf_dir):
    """Two scenarios on event means: add, then multiply; and set."""
    base = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("feature")).agg(F.avg("value").alias("value"))
    steps = F.array(F.struct(F.lit("boost").alias("scenario"), F.lit(1).alias("seq"), F.lit("add").alias("op"), F.lit(5.0).alias("amount")), F.struct(F.lit("boost").alias("scenario"), F.lit(2).alias("seq"), F.lit("multiply").alias("op"), F.lit(1.1).alias("amount")), F.struct(F.lit("fixed").alias("scenario"), F.lit(1).alias("seq"), F.lit("set").alias("op"), F.lit(10.0).alias("amount")))
    shocks = base.select("feature", F.inline(steps))
    out = scenario.evaluate(scenario.shocked(shocks, base), base.select("feature", F.lit(2.0).alias("sensitivity")), 100.0)
    return rounded(out, 6, "delta", "forecast")


_LEVELS = [payload.Bin("low", None, 50_000), payload.Bin("mid", 50_000, 200_000), payload.Bin("high", 200_000, None)]


@query("""SELECT o_orderpriority AS series, round(count(*) FILTER (o_totalprice < 50000) / count(*), 8) AS low, round(count(*) FILTER (o_totalprice >= 50000 AND o_totalprice < 200000) / count(*), 8) AS mid, round(count(*) FILTER (o_totalprice >= 200000) / count(*), 8) AS high, 0 AS problems, round(ln(count(*) FILTER (o_totalprice >= 50000 AND o_totalprice < 200000) / count(*)), 6) AS log_score FROM orders GROUP BY 1""")
def probability_vectors(spark, sf_dir):
    """Shares of value bins by priority, checked, and their log score for one outcome."""
    out = payload.from_sample(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", _LEVELS)
    p = F.col("probabilities")
    return out.select(F.col("o_orderpriority").alias("series"), *[F.round(p[b.label], 8).alias(b.label) for b in _LEVELS], F.size(payload.problems(p, _LEVELS)).alias("problems"), F.round(payload.log_score(payload.normalised(p, _LEVELS), F.lit("mid"), _LEVELS), 6).alias("log_score"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 1000 WHEN o_orderkey % 4 = 1 THEN o_totalprice WHEN o_orderkey % 4 = 2 THEN o_totalprice * 1000 ELSE 0 END AS damage, CASE WHEN o_custkey <= 0 THEN NULL WHEN o_custkey <= 100 THEN 'small' WHEN o_custkey <= 1000 THEN 'medium' WHEN o_custkey <= 10000 THEN 'large' ELSE 'major' END AS size FROM orders""")
def parsed_damage(spark, sf_dir):
    """Amounts written with K, M or B, in millions; and size classes."""
    own = table(spark, sf_dir, "orders")
    text = F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.element_at(F.array(*map(F.lit, ("K", "M", "B", "x"))), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return own.select("o_orderkey", F.round(transforms.damage_millions(text), 6).alias("damage"), transforms.size_class(F.col("o_custkey")).alias("size"))
