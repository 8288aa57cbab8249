"""Queries on tables: roll-ups, scaling, quality, vintages, metrics."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidewater.operators import aggregate, metrics, quality, scaling, vintage
from tidewater.plans.base import MONTHLY, day, monthly_orders, query, rounded, table


def _revenue(spark, sf_dir):
    """(n_nationkey, month, value): order totals by the customer's nation and month."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey").groupBy("nation", F.trunc("o_orderdate", "MM").alias("month")).agg(F.sum("o_totalprice").alias("value"))


_REVENUE = """rev AS (SELECT c_nationkey AS nation, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    wt AS (SELECT c_nationkey AS nation, sum(c_acctbal) AS w FROM customer GROUP BY 1)"""


def _weights(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum("c_acctbal").alias("w"))


@query(f"""WITH {_REVENUE} SELECT strftime(month, '%Y-%m-%d') AS month, round(sum(value), 2) AS total FROM rev GROUP BY month""")
def national_total(spark, sf_dir):
    """Sum over nations by month."""
    return rounded(aggregate.total(_revenue(spark, sf_dir), ["month"], "value"), 2, "total").withColumn("month", day("month"))


@query(f"""WITH {_REVENUE} SELECT strftime(month, '%Y-%m-%d') AS month, round(sum(value * w) / sum(w), 2) AS weighted_mean FROM rev LEFT JOIN wt USING (nation) GROUP BY month""")
def weighted_mean(spark, sf_dir):
    """Weighted mean over nations by month; nations without a weight drop out."""
    return rounded(aggregate.weighted_mean(_revenue(spark, sf_dir), _weights(spark, sf_dir), ["month"], "nation", "value", "w"), 2, "weighted_mean").withColumn("month", day("month"))


@query(f"""WITH {_REVENUE} SELECT strftime(month, '%Y-%m-%d') AS month, round(sum(value * coalesce(w, 0)), 0) AS weighted_sum FROM rev LEFT JOIN wt USING (nation) GROUP BY month""")
def weighted_sum(spark, sf_dir):
    """Weighted sum; a missing weight counts 0."""
    return rounded(aggregate.weighted_sum(_revenue(spark, sf_dir), _weights(spark, sf_dir), ["month"], "nation", "value", "w"), 0, "weighted_sum").withColumn("month", day("month"))


@query("""SELECT c_custkey, round(greatest(c_acctbal, 0) / sum(greatest(c_acctbal, 0)) OVER (PARTITION BY c_nationkey), 8) AS weight FROM customer""")
def shares_within(spark, sf_dir):
    """Each customer's share of its nation's balances."""
    own = table(spark, sf_dir, "customer").withColumn("v", F.greatest("c_acctbal", F.lit(0.0)))
    return aggregate.shares(own, "v", ["c_nationkey"]).select("c_custkey", F.round("weight", 8).alias("weight"))


@query("""SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS month, round(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 2) AS A, round(sum(l_extendedprice) FILTER (l_returnflag = 'N'), 2) AS N, round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS R FROM lineitem GROUP BY 1""")
def pivoted(spark, sf_dir):
    """Prices by month and return flag, a column a flag."""
    own = table(spark, sf_dir, "lineitem").select(day(F.trunc("l_shipdate", "MM")).alias("month"), "l_returnflag", "l_extendedprice")
    return rounded(aggregate.pivot_sum(own, "month", "l_returnflag", ["A", "N", "R"], "l_extendedprice"), 2, "A", "N", "R")


@query("""SELECT event_type, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, round(sum(value), 3) AS total, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS days, arg_max(user_id, (ts, event_id)) AS month_end_balance, strftime(max(ts), '%Y-%m-%d') AS last_date FROM events GROUP BY 1, 2""")
def monthly_flows(spark, sf_dir):
    """Monthly sum, mean, deviation, count, and last state of event flows."""
    out = aggregate.monthly_flow(table(spark, sf_dir, "events"), key=["event_type"], ts="ts", value="value", balance="user_id", tie="event_id")
    return rounded(rounded(out, 3, "total"), 6, "mean", "std").withColumns({"month": day("month"), "last_date": day("last_date")})


@query(f"""WITH {MONTHLY}, b AS (SELECT quantile_cont(value, 0.75) AS q FROM monthly) SELECT series, strftime(month, '%Y-%m-%d') AS month, value > q AS high FROM monthly, b""")
def high_months(spark, sf_dir):
    """Months over the upper quartile of all months."""
    return aggregate.flag_above_percentile(monthly_orders(spark, sf_dir), "value", 0.75, "high").select("series", day("month").alias("month"), "high")


@query("""SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments, count(*) AS n FROM customer GROUP BY 1""")
def joined_segments(spark, sf_dir):
    """Distinct segments of a nation as one string."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(aggregate.distinct_joined("c_mktsegment").alias("segments"), F.count("*").alias("n"))


@query("""SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 25""")
def top_customers(spark, sf_dir):
    """The 25 customers with the largest totals (a top-k report)."""
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return aggregate.top_by(own, 25, F.desc("total"), F.asc("o_custkey"))


@query("""WITH m AS (SELECT l_returnflag AS f, avg(l_extendedprice) AS a, stddev_samp(l_extendedprice) AS b, quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, round((l_extendedprice - a) / b, 6) AS z, round((l_extendedprice - med) / iqr, 6) AS robust FROM lineitem JOIN m ON l_returnflag = f""")
def scaled_by_series(spark, sf_dir):
    """Standard and robust scores of line prices within their return flag."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    two = scaling.scores_by_series(own, "l_returnflag", "l_extendedprice")
    return rounded(two, 6, "z", "robust").select("l_orderkey", "l_linenumber", "z", "robust")


@query("""WITH m AS (SELECT avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS b, min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, 0.5) AS med, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr, quantile_cont(o_totalprice, 0.05) AS p5, quantile_cont(o_totalprice, 0.95) AS p95 FROM orders)
    SELECT o_orderkey, round((o_totalprice - a) / b, 6) AS standard, round((o_totalprice - lo) / (hi - lo), 6) AS minmax, round((o_totalprice - med) / iqr, 6) AS robust, round(greatest(p5, least(p95, o_totalprice)), 4) AS winsorized FROM orders, m""")
def scaled(spark, sf_dir):
    """Order values by four scalers."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", *[F.col("o_totalprice").alias(c) for c in ("standard", "minmax", "robust", "winsorized")])
    for scaler in scaling.fit_together([scaling.StandardScaler(["standard"]), scaling.MinMaxScaler(["minmax"]), scaling.RobustScaler(["robust"]), scaling.Winsorizer(["winsorized"])], own):
        own = scaler.transform(own)
    return rounded(rounded(own, 6, "standard", "minmax", "robust"), 4, "winsorized")


def _rules(df):
    return [
        quality.not_empty(),
        quality.required_columns(df, ["o_orderkey", "o_custkey", "o_region"]),
        quality.column_types(df, {"o_orderkey": "numeric", "o_orderdate": "string"}),
        quality.no_empty_columns(df),
        quality.no_nulls("o_totalprice"),
        quality.unique(["o_custkey", "o_orderdate"], df),
        quality.in_range("o_totalprice", 1_000, 400_000),
        quality.enough_rows(10),
        quality.fresh("o_orderdate", datetime.date(2001, 8, 15), 30),
        quality.covers("o_orderdate", 365),
    ]


_CHECKED = """c AS (SELECT count(*) AS n, count(*) - count(DISTINCT (o_custkey, o_orderdate)) AS dup, count(*) FILTER (o_totalprice IS NULL) AS nulls, count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 400000) AS odd, max(o_orderdate)::DATE AS hi, min(o_orderdate)::DATE AS lo FROM orders),
    r AS (SELECT unnest([{'rule': 'not_empty', 'severity': 'CRITICAL', 'failing': (n = 0)::BIGINT}, {'rule': 'required_columns', 'severity': 'CRITICAL', 'failing': 1::BIGINT}, {'rule': 'column_types', 'severity': 'ERROR', 'failing': 1::BIGINT}, {'rule': 'no_empty_columns', 'severity': 'WARNING', 'failing': 0::BIGINT}, {'rule': 'no_nulls:o_totalprice', 'severity': 'ERROR', 'failing': nulls}, {'rule': 'unique:o_custkey,o_orderdate', 'severity': 'ERROR', 'failing': dup}, {'rule': 'in_range:o_totalprice', 'severity': 'WARNING', 'failing': odd}, {'rule': 'enough_rows:10', 'severity': 'WARNING', 'failing': (n < 10)::BIGINT}, {'rule': 'fresh:o_orderdate', 'severity': 'ERROR', 'failing': (date_diff('day', hi, DATE '2001-08-15') > 30)::BIGINT}, {'rule': 'covers:o_orderdate', 'severity': 'WARNING', 'failing': (date_diff('day', lo, hi) < 365)::BIGINT}]) AS x FROM c)"""


@query(f"""WITH {_CHECKED} SELECT x.rule AS rule, x.severity AS severity, CASE WHEN x.failing > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, x.failing AS failing FROM r""")
def quality_report(spark, sf_dir):
    """Ten rules over orders, in one pass."""
    own = table(spark, sf_dir, "orders")
    return quality.check(own, _rules(own)).select("rule", "severity", "status", "failing")


@query(f"""WITH {_CHECKED} SELECT count(*) AS rules, count(*) FILTER (x.failing = 0) AS passed, count(*) FILTER (x.failing > 0 AND x.severity = 'CRITICAL') AS failed_critical, count(*) FILTER (x.failing > 0 AND x.severity = 'ERROR') AS failed_error, count(*) FILTER (x.failing > 0 AND x.severity = 'WARNING') AS failed_warning, 'BLOCKED' AS overall FROM r""")
def quality_summary(spark, sf_dir):
    """The verdict of those rules."""
    own = table(spark, sf_dir, "orders")
    return quality.summary(quality.check(own, _rules(own)))


@query("""WITH q AS (SELECT event_type AS t, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id FROM events JOIN q ON event_type = t WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def outliers_by_quartiles(spark, sf_dir):
    """Events more than 1.5 quartile distances outside their type's quartiles."""
    return quality.outliers_iqr(table(spark, sf_dir, "events"), "event_type", "value", 1.5).select("event_id")


@query("""WITH q AS (SELECT event_type AS t, avg(value) AS a, stddev_samp(value) AS b FROM events GROUP BY 1) SELECT event_id FROM events JOIN q ON event_type = t WHERE abs(value - a) > 3 * b""")
def outliers_by_score(spark, sf_dir):
    """Events more than three standard deviations from their type's mean."""
    return quality.outliers_zscore(table(spark, sf_dir, "events"), "event_type", "value", 3.0).select("event_id")


@query("""SELECT l_orderkey, strftime(max(l_shipdate), '%Y-%m-%d') AS vintage, arg_max(l_linenumber, (l_shipdate, l_linenumber, l_quantity)) AS l_linenumber FROM lineitem WHERE l_shipdate <= DATE '1998-06-30' GROUP BY 1""")
def known_as_of(spark, sf_dir):
    """Of each order's dated lines, the last that was known on a day."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("vintage"), "l_linenumber", "l_quantity")
    return vintage.as_of_rows(own, ["l_orderkey"], "vintage", datetime.date(1998, 6, 30)).select("l_orderkey", day("vintage").alias("vintage"), "l_linenumber")


@query("""SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS last_observed, count(*) FILTER (o_orderdate::DATE > DATE '1999-12-31') AS after_as_of, true AS vintage_known, max(o_orderdate)::DATE <= DATE '1999-12-15' AS observations_known, max(o_orderdate)::DATE <= DATE '1999-12-15' AND count(*) FILTER (o_orderdate::DATE > DATE '1999-12-31') = 0 AS honest FROM orders""")
def vintage_honesty(spark, sf_dir):
    """Whether a vintage observes only what its date allows."""
    return vintage.honesty(table(spark, sf_dir, "orders"), "o_orderdate", datetime.date(1999, 12, 15), datetime.date(1999, 12, 31)).withColumn("last_observed", day("last_observed"))


@query("""WITH h AS (SELECT sha256(concat_ws(chr(10), c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_mktsegment)) AS h FROM customer) SELECT count(*) AS rows, bit_xor(('0x' || substr(h, 1, 10))::BIGINT) AS xor, sum(('0x' || substr(h, 11, 10))::BIGINT)::BIGINT AS sum FROM h""")
def table_fingerprint(spark, sf_dir):
    """A hash of customers that does not depend on the order of rows."""
    return vintage.fingerprint(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


#: A forecast to judge: each line's price by the mean of its flag and quantity class, with an interval.
_FORECAST = """g AS (SELECT l_returnflag AS f, floor(l_quantity / 10) AS q, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2),
    x AS (SELECT l_orderkey, l_linenumber, l_returnflag AS series, l_extendedprice AS y, m AS f, m - 1.5 * s AS lo, m + 1.5 * s AS hi FROM lineitem JOIN g ON l_returnflag = g.f AND floor(l_quantity / 10) = g.q)"""


def _forecast(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").withColumn("q", F.floor(F.col("l_quantity") / 10))
    means = own.groupBy("l_returnflag", "q").agg(F.avg("l_extendedprice").alias("f"), F.stddev_samp("l_extendedprice").alias("s"))
    return own.join(means, ["l_returnflag", "q"]).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("series"), F.col("l_extendedprice").alias("y"), "f", (F.col("f") - 1.5 * F.col("s")).alias("lo"), (F.col("f") + 1.5 * F.col("s")).alias("hi"), "s")


@query(f"""WITH {_FORECAST} SELECT series, round(sqrt(avg((y - f) * (y - f))), 3) AS rmse, round(avg(abs(y - f)), 3) AS mae, round(100 * avg(abs(y - f) / greatest(abs(y), 1e-10)), 4) AS mape, round(100 * avg(abs(y - f) / ((abs(y) + abs(f)) / 2)), 4) AS smape, round(100 * avg((y BETWEEN lo AND hi)::INT), 4) AS coverage, round(avg(hi - lo + 20 * (greatest(lo - y, 0) + greatest(y - hi, 0))), 3) AS interval_score FROM x GROUP BY 1""")
def forecast_metrics(spark, sf_dir):
    """Point and interval metrics by series."""
    x = _forecast(spark, sf_dir)
    out = x.groupBy("series").agg(metrics.rmse("y", "f").alias("rmse"), metrics.mae("y", "f").alias("mae"), metrics.mape("y", "f").alias("mape"), metrics.smape("y", "f").alias("smape"), metrics.coverage("y", "lo", "hi").alias("coverage"), metrics.interval_score("y", "lo", "hi", 0.1).alias("interval_score"))
    return rounded(rounded(out, 3, "rmse", "mae", "interval_score"), 4, "mape", "smape", "coverage")


@query(f"""WITH {_FORECAST}, v AS (SELECT series, (hi - lo) / 3 AS s, (y - f) / ((hi - lo) / 3) AS z FROM x),
    e AS (SELECT *, sign(z) * CASE WHEN abs(z) > 8 THEN 1 WHEN z = 0 THEN 0 ELSE 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 150), lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln(abs(z) / sqrt(2)) - lgamma(2 * n + 2) + lgamma(n + 1)))) END AS erf FROM v)
    SELECT series, round(avg(s * (z * erf + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 5) AS crps FROM e GROUP BY 1""")
def crps(spark, sf_dir):
    """Continuous ranked probability score of normal forecasts, by series."""
    return rounded(_forecast(spark, sf_dir).groupBy("series").agg(F.avg(metrics.crps_normal("y", "f", "s")).alias("crps")), 5, "crps")


_PROBABLE = """p AS (SELECT l_orderkey, l_linenumber, (l_quantity - 1) / 50.0 AS p, (l_extendedprice > 45000)::INT AS y FROM lineitem)"""


def _probable(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(((F.col("l_quantity") - 1) / 50.0).alias("p"), (F.col("l_extendedprice") > 45000).cast("int").alias("y"))


_BINS = " + ".join(f"(p >= {k / 10!r})::INT" for k in range(1, 10))


@query(f"""WITH {_PROBABLE}, b AS (SELECT ({_BINS})::INT AS bin, count(*) AS n, avg(p) AS m, avg(y) AS s, 1.959963984540054 AS z FROM p GROUP BY 1), w AS (SELECT *, (s + z * z / (2 * n)) / (1 + z * z / n) AS c, z * sqrt(s * (1 - s) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS e FROM b)
    SELECT bin, n, round(m, 8) AS mean_p, round(s, 8) AS share, round(c - e, 7) AS low, round(c + e, 7) AS high FROM w""")
def reliability(spark, sf_dir):
    """A reliability table of ten bins."""
    return rounded(rounded(metrics.reliability(_probable(spark, sf_dir), "y", "p"), 8, "mean_p", "share"), 7, "low", "high")


@query(f"""WITH {_PROBABLE}, r AS (SELECT ({_BINS}) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM p GROUP BY 1) SELECT round(sum(gap * n) / sum(n), 8) AS ece, round(max(gap), 8) AS mce FROM r""")
def calibration_error(spark, sf_dir):
    """Expected and maximal calibration error."""
    return rounded(metrics.calibration_error(_probable(spark, sf_dir), "y", "p"), 8, "ece", "mce")


@query(f"""WITH {_PROBABLE} SELECT round(avg((p - y) * (p - y)), 8) AS brier, round(-avg(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p)))), 8) AS log_loss, round(stddev_pop(p), 8) AS sharpness FROM p""")
def probability_scores(spark, sf_dir):
    """Brier score, log loss, and sharpness of the probabilities: their deviation."""
    out = _probable(spark, sf_dir).agg(metrics.brier("y", "p").alias("brier"), metrics.log_loss("y", "p").alias("log_loss"), metrics.sharpness("p").alias("sharpness"))
    return rounded(out, 8, "brier", "log_loss", "sharpness")


@query("""WITH w AS (SELECT l_returnflag, 0.2 * l_extendedprice + 100 * l_linenumber AS w FROM lineitem)
    SELECT l_returnflag, count(*) AS n, round(avg(w), 4) AS mean_width, round(quantile_cont(w, 0.5), 4) AS median_width, round(stddev_pop(w), 4) AS std_width, round(min(w), 4) AS min_width, round(max(w), 4) AS max_width, round(stddev_pop(w) / (avg(w) + 1e-10), 6) AS cv_width FROM w GROUP BY 1""")
def sharpness_of_intervals(spark, sf_dir):
    """Widths of intervals by flag: mean, exact median, spread, ends and variation."""
    own = table(spark, sf_dir, "lineitem").select("l_returnflag", (0.9 * F.col("l_extendedprice")).alias("low"), (1.1 * F.col("l_extendedprice") + 100 * F.col("l_linenumber")).alias("high"))
    out = metrics.interval_sharpness(own, "low", "high", ["l_returnflag"])
    return rounded(rounded(out, 4, "mean_width", "median_width", "std_width", "min_width", "max_width"), 6, "cv_width")



_NAIVE = f"""{MONTHLY}, nv AS (SELECT series, month, value AS y, lag(value, 12) OVER (PARTITION BY series ORDER BY month) AS f FROM monthly), z AS (SELECT * FROM nv WHERE f IS NOT NULL)"""


_TURNS = """t AS (SELECT series, month, coalesce((y > lag(y) OVER w AND y > lead(y) OVER w) OR (y < lag(y) OVER w AND y < lead(y) OVER w), false) AS ty, coalesce((f > lag(f) OVER w AND f > lead(f) OVER w) OR (f < lag(f) OVER w AND f < lead(f) OVER w), false) AS tf FROM z WINDOW w AS (PARTITION BY series ORDER BY month)),
    h AS (SELECT series, CASE WHEN ty THEN (tf OR coalesce(lag(tf) OVER w, false) OR coalesce(lead(tf) OVER w, false))::INT END AS hit FROM t WINDOW w AS (PARTITION BY series ORDER BY month))"""
_REVISIONS = """d AS (SELECT series, y - lag(y) OVER w AS ry, f - lag(f) OVER w AS rf FROM z WINDOW w AS (PARTITION BY series ORDER BY month))"""


def _revisions(spark, sf_dir):
    from tidewater.operators import windows

    w = windows.over("series", "month")
    return _naive(spark, sf_dir).select("series", windows.change("y", w).alias("ry"), windows.change("f", w).alias("rf"))


def _naive(spark, sf_dir):
    from tidewater.operators import windows

    w = windows.over("series", "month")
    return monthly_orders(spark, sf_dir).withColumn("f", F.lag("value", 12).over(w)).where("f is not null").withColumnRenamed("value", "y")


@query(f"""WITH {_NAIVE}, {_TURNS} SELECT series, round(coalesce(100 * avg(hit), 100), 6) AS accuracy FROM h GROUP BY 1""")
def turning_accuracy(spark, sf_dir):
    """Turning points that a seasonal naive forecast meets."""
    return rounded(metrics.turning_point_accuracy(_naive(spark, sf_dir), "series", "month", "y", "f"), 6, "accuracy")


@query(f"""WITH {_NAIVE}, {_REVISIONS} SELECT series, round(100 * avg((sign(ry) = sign(rf))::INT), 6) AS accuracy FROM d GROUP BY 1""")
def direction_accuracy(spark, sf_dir):
    """Revisions whose sign the forecast has."""
    return rounded(_revisions(spark, sf_dir).groupBy("series").agg(metrics.direction_accuracy("ry", "rf").alias("accuracy")), 6, "accuracy")


@query(f"""WITH {MONTHLY}, n AS (SELECT series, month, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM monthly),
    k AS (SELECT series, month, pos, n, unnest(range(0, greatest(0, (n - 1 - 3 - 24) // 6 + 1))) AS fold FROM n)
    SELECT series, strftime(month, '%Y-%m-%d') AS month, fold::INT AS fold, CASE WHEN pos < 24 + 6 * fold THEN 'train' ELSE 'test' END AS part FROM k WHERE pos < 24 + 6 * fold OR (pos >= 24 + 6 * fold + 1 AND pos < 24 + 6 * fold + 4)""")
def expanding_folds(spark, sf_dir):
    """Rows of each expanding fold: training, a gap of one month, three months of test."""
    out = metrics.assign_folds(monthly_orders(spark, sf_dir), "series", "month", initial=24, step=6, horizon=3, gap=1)
    return out.select("series", day("month").alias("month"), "fold", "part")


@query(f"""WITH {_NAIVE}, {_TURNS}, {_REVISIONS},
    s AS (SELECT series AS model, sqrt(avg((y - f) * (y - f))) AS rmse, 100 * avg(abs(y - f) / CASE WHEN y = 0 AND f = 0 THEN 1e-10 ELSE (abs(y) + abs(f)) / 2 END) AS smape, max(abs(f)) AS largest, 100 * avg((y BETWEEN 0.6 * f AND 1.4 * f)::INT) AS covered FROM z GROUP BY 1),
    r AS (SELECT series AS model, avg(abs(ry - rf)) AS revision, 100 * avg((sign(ry) = sign(rf))::INT) AS direction FROM d GROUP BY 1),
    u AS (SELECT series AS model, coalesce(100 * avg(hit), 100) AS turning FROM h GROUP BY 1),
    q AS (SELECT model, count(*) FILTER (e <= 12000) AS passing FROM (SELECT series AS model, quarter(month) AS q, round(avg(abs(y - f)), 6) AS e FROM z GROUP BY 1, 2) GROUP BY 1),
    g AS (SELECT model, concat_ws(',', CASE WHEN smape > 20 THEN 'smape' END, CASE WHEN rmse > 50000 THEN 'rmse' END, CASE WHEN largest > 2000000 THEN 'forecast_stability' END, CASE WHEN covered < 85 OR covered > 95 THEN 'coverage_90' END, CASE WHEN revision > 30000 THEN 'revision_mae' END, CASE WHEN direction < 50 THEN 'revision_direction_accuracy' END, CASE WHEN turning < 55 THEN 'turning_point_precision' END, CASE WHEN passing < 3 THEN 'state_level_accuracy' END) AS failed,
        smape + rmse / 1000 + abs(covered - 90) + revision / 1000 AS sc FROM s JOIN r USING (model) JOIN u USING (model) JOIN q USING (model))
    SELECT model, failed, round(sc, 4) AS score, failed = '' AS eligible, (row_number() OVER (ORDER BY (failed <> '')::INT, sc, model))::INT AS rank FROM g""")
def model_selection(spark, sf_dir):
    """Candidates ranked behind their gates: the seasonal naive forecast of each series, with quarters in the place of states."""
    z = _naive(spark, sf_dir)
    scores = z.groupBy("series").agg(metrics.rmse("y", "f").alias("rmse"), metrics.smape("y", "f").alias("smape"), F.max(F.abs("f")).alias("max_abs_forecast"), metrics.coverage("y", 0.6 * F.col("f"), 1.4 * F.col("f")).alias("coverage_90"))
    revisions = _revisions(spark, sf_dir).groupBy("series").agg(metrics.mae("ry", "rf").alias("revision_mae"), metrics.direction_accuracy("ry", "rf").alias("revision_direction_accuracy"))
    turns = metrics.turning_point_accuracy(z, "series", "month", "y", "f").withColumnRenamed("accuracy", "turning_point_precision")
    states = metrics.state_mae(z.withColumn("q", F.quarter("month")), ["series"], "q", "y", "f")
    for part in (revisions, turns, states):
        scores = scores.join(part, "series")
    out = metrics.select_models(scores.withColumnRenamed("series", "model"))
    return rounded(out, 4, "score").select("model", F.array_join("failed", ",").alias("failed"), "score", "eligible", "rank")


@query(f"""WITH {_FORECAST}, m AS (SELECT CASE series WHEN 'N' THEN 'dfm' ELSE series END AS model, 100 * avg(abs(y - f) / ((abs(y) + abs(f)) / 2)) AS smape, 100 * avg((y BETWEEN lo AND hi)::INT) AS covered, max(abs(f)) AS largest FROM x GROUP BY 1)
    SELECT model, 'smape_gate' AS issue, 'WARNING' AS severity, round(smape, 4) AS observed FROM m WHERE smape > 20 UNION ALL SELECT model, 'coverage_low', 'WARNING', round(covered, 4) FROM m WHERE covered < 85 UNION ALL SELECT model, 'coverage_high', 'WARNING', round(covered, 4) FROM m WHERE covered > 95
    UNION ALL SELECT model, 'forecast_magnitude_hard_gate', 'CRITICAL', round(largest, 4) FROM m WHERE largest > 2000000""")
def model_health(spark, sf_dir):
    """What is wrong with forecasts of three models, one of which passes for a factor model."""
    x = _forecast(spark, sf_dir).withColumn("model", F.when(F.col("series") == "N", "dfm").otherwise(F.col("series")))
    return rounded(metrics.model_health(x, low="lo", high="hi"), 4, "observed")


@query("""SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000""")
def set_difference(spark, sf_dir):
    """Customers with a balance and without a large order."""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return a.subtract(table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")))


@query("""SELECT c_custkey, c_nationkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def named_customers(spark, sf_dir):
    """Customers with two lookups by code."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return table(spark, sf_dir, "customer").join(n, "c_nationkey", "left").join(r, "r_regionkey", "left").select("c_custkey", "c_nationkey", "n_name", "r_name")


@query("""SELECT count(*) AS n, avg(k)::DOUBLE AS mean_k FROM (SELECT try_cast(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) AS k FROM events) WHERE k IS NOT NULL""")
def nested_values(spark, sf_dir):
    """A number inside JSON text."""
    own = table(spark, sf_dir, "events").select(F.from_json("props", "k long")["k"].alias("k")).where("k is not null")
    return own.agg(F.count("*").alias("n"), F.avg("k").alias("mean_k"))
