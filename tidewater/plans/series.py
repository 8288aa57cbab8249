"""Queries on series: resampling, windows, lags, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import calendar
from tidewater.operators import lags, resample, windows
from tidewater.plans.base import DAILY, MONTHLY, daily_events, day, monthly_orders, orders_by_priority, query, rounded, table


@query(f"""WITH {MONTHLY}
    SELECT series, strftime(month, '%Y-%m-%d') AS month, round(value, 2) AS total, round(value - lag(value) OVER w, 2) AS mom_change, round(value - lag(value, 12) OVER w, 2) AS yoy_change
    FROM monthly WINDOW w AS (PARTITION BY series ORDER BY month)""")
def monthly_orders_changes(spark, sf_dir):
    """Monthly order totals by priority on a gap-free calendar, with changes on the month and the year."""
    w = windows.over("series", "month")
    out = monthly_orders(spark, sf_dir).select("series", "month", F.col("value").alias("total"), windows.change("value", w).alias("mom_change"), windows.change("value", w, 12).alias("yoy_change"))
    return rounded(out, 2, "total", "mom_change", "yoy_change").withColumn("month", day("month"))


@query("""WITH e AS (SELECT event_type AS series, ts, event_id, value, (ts::DATE + (7 - isodow(ts))::INT)::DATE AS bin FROM events),
    b AS (SELECT series, bin, avg(value) AS mean, sum(value) AS sum, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS last, arg_min(value, (ts, event_id)) FILTER (value IS NOT NULL) AS first FROM e GROUP BY 1, 2),
    s AS (SELECT series, unnest(generate_series(min(bin)::TIMESTAMP, max(bin)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS bin FROM b GROUP BY 1)
    SELECT series, strftime(bin, '%Y-%m-%d') AS week, round(mean, 6) AS mean, round(coalesce(sum, 0), 4) AS sum, last, first FROM s LEFT JOIN b USING (series, bin)""")
def weekly_events(spark, sf_dir):
    """Event values by type and week (labelled by the Sunday that closes it): mean, sum, last, first."""
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "ts", "value", "event_id")
    out = resample.resample(own, "W", ("mean", "sum", "last", "first"), tie="event_id")
    return rounded(rounded(out, 6, "mean"), 4, "sum").select("series", day("bin").alias("week"), "mean", "sum", "last", "first")


@query("""WITH b AS (SELECT o_custkey AS series, date_trunc('month', o_orderdate)::DATE AS bin, avg(o_totalprice) AS mean, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1, 2),
    s AS (SELECT series, unnest(generate_series(min(bin)::TIMESTAMP, max(bin)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS bin FROM b GROUP BY 1)
    SELECT series, strftime(bin, '%Y-%m-%d') AS month, round(mean, 7) AS mean, last FROM s LEFT JOIN b USING (series, bin)""")
def customer_months(spark, sf_dir):
    """Monthly mean and last order of every customer; months without orders are null."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return rounded(resample.resample(own, "MS", ("mean", "last"), tie="o_orderkey"), 7, "mean").select("series", day("bin").alias("month"), "mean", "last")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS series, o_orderdate::DATE AS d FROM orders), g AS (SELECT series, date_diff('day', lag(d) OVER (PARTITION BY series ORDER BY d), d) AS gap FROM d),
    m AS (SELECT series, quantile_cont(gap::DOUBLE, 0.5) AS gap FROM g GROUP BY 1)
    SELECT series, gap, CASE WHEN gap <= 1.5 THEN 'D' WHEN gap <= 8 THEN 'W' WHEN gap <= 32 THEN 'M' END AS freq FROM m""")
def inferred_frequency(spark, sf_dir):
    """Frequency of each customer's order dates by their median gap."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("ts"))
    return resample.infer_frequency(own)


@query("""SELECT o_orderkey, o_custkey, round(avg(o_totalprice) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 7) AS ma4, round(avg(o_totalprice) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 7) AS ma20
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def rolling_means(spark, sf_dir):
    """Means of each customer's last 4 and 20 orders."""
    w = windows.over("o_custkey", "o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(windows.rolling_mean("o_totalprice", w, 4), 7).alias("ma4"), F.round(windows.rolling_mean("o_totalprice", w, 20), 7).alias("ma20"))


@query(f"""WITH {MONTHLY} SELECT series, strftime(month, '%Y-%m-%d') AS month, round(CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END, 2) AS centred
    FROM monthly WINDOW w AS (PARTITION BY series ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def centred_means(spark, sf_dir):
    """Centred means of three months."""
    return monthly_orders(spark, sf_dir).select("series", day("month").alias("month"), F.round(windows.centred_mean("value", windows.over("series", "month")), 2).alias("centred"))


_SPARSE = """b AS (SELECT o_custkey AS series, date_trunc('month', o_orderdate)::DATE AS bin, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1, 2),
    s AS (SELECT series, unnest(generate_series(min(bin)::TIMESTAMP, max(bin)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS bin FROM b GROUP BY 1),
    x AS (SELECT series, bin, last FROM s LEFT JOIN b USING (series, bin))"""


def _sparse(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return resample.resample(own, "MS", ("last",), tie="o_orderkey")


@query(f"""WITH {_SPARSE} SELECT series, strftime(bin, '%Y-%m-%d') AS month, last_value(last IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled, first_value(last IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_next
    FROM x WINDOW w AS (PARTITION BY series ORDER BY bin)""")
def filled_months(spark, sf_dir):
    """Customers' months filled from the last known, and from the next known value."""
    w = windows.over("series", "bin")
    return _sparse(spark, sf_dir).select("series", day("bin").alias("month"), windows.forward_fill("last", w).alias("filled"), windows.backward_fill("last", w).alias("from_next"))


@query(f"""WITH {_SPARSE}, m AS (SELECT series, quantile_cont(last, 0.5) AS med FROM x GROUP BY 1)
    SELECT series, strftime(bin, '%Y-%m-%d') AS month, coalesce(last_value(last IGNORE NULLS) OVER (PARTITION BY series ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), med, 0) AS last FROM x JOIN m USING (series)""")
def gap_filled(spark, sf_dir):
    """Gaps filled forward, then with the series' median, then 0."""
    return lags.fill_gaps(_sparse(spark, sf_dir), ["last"], "series", "bin").select("series", day("bin").alias("month"), "last")


@query(f"""WITH {MONTHLY}, u AS (SELECT *, coalesce(value > lag(value) OVER (PARTITION BY series ORDER BY month), false) AS up FROM monthly),
    g AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY month) AS island FROM u)
    SELECT series, strftime(month, '%Y-%m-%d') AS month, (sum(up::INT) OVER (PARTITION BY series, island ORDER BY month))::BIGINT AS streak FROM g""")
def increases_in_a_row(spark, sf_dir):
    """How many months in a row the total has risen."""
    return windows.increases_in_a_row(monthly_orders(spark, sf_dir), "value", "series", "month").select("series", day("month").alias("month"), "streak")


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 10""")
def recent_history(spark, sf_dir):
    """The last ten orders of each customer."""
    return windows.last_rows(table(spark, sf_dir, "orders"), 10, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "o_custkey")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1""")
def latest_order(spark, sf_dir):
    """Each customer's latest order."""
    return windows.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"""WITH {MONTHLY}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month DESC) AS pos FROM monthly)
    SELECT series, round(regr_slope(value, -pos::DOUBLE), 3) AS slope FROM r WHERE pos <= 12 GROUP BY 1""")
def recent_slope(spark, sf_dir):
    """Slope of the last twelve months."""
    return rounded(windows.slope_of_last(monthly_orders(spark, sf_dir), "value", 12, "series", "month"), 3, "slope")


@query(f"""WITH {MONTHLY} SELECT series, strftime(month, '%Y-%m-%d') AS month, CASE WHEN value > lag(value) OVER w AND value > lead(value) OVER w THEN 1 WHEN value < lag(value) OVER w AND value < lead(value) OVER w THEN -1 ELSE 0 END AS turn
    FROM monthly WINDOW w AS (PARTITION BY series ORDER BY month)""")
def turning_points(spark, sf_dir):
    """Local maxima and minima of monthly totals."""
    return windows.turning_points(monthly_orders(spark, sf_dir), "value", "series", "month").select("series", day("month").alias("month"), "turn")


@query(f"""WITH {MONTHLY}, d AS (SELECT series, abs(value - lag(value) OVER (PARTITION BY series ORDER BY month)) AS d FROM monthly) SELECT series, round(avg(d), 2) AS mean_step FROM d GROUP BY 1""")
def mean_steps(spark, sf_dir):
    """Mean absolute change from month to month."""
    return rounded(windows.mean_absolute_step(monthly_orders(spark, sf_dir), "value", "series", "month"), 2, "mean_step")


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def last_event_of_day(spark, sf_dir):
    """One event a user and day: the last."""
    own = table(spark, sf_dir, "events").select("user_id", day("ts").alias("day"), "ts", "event_id")
    return windows.keep_last(own, ["user_id", "day"], "ts", "event_id").select("user_id", "day", "event_id")


def _targets(spark, sf_dir):
    ts = F.col("ts").cast("date")
    return table(spark, sf_dir, "events").agg(F.min(ts).alias("a"), F.max(ts).alias("b")).select(F.explode(F.sequence(F.date_add("a", 2), F.col("b"), F.expr("interval 7 days"))).alias("target"))


_TARGETS = f"""{DAILY}, span AS (SELECT min(ts::DATE) + 2 AS a, max(ts::DATE) AS b FROM events),
    targets AS (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 7 DAY))::DATE AS target FROM span),
    seen AS (SELECT s.series, t.target, d.ts, d.value, row_number() OVER (PARTITION BY s.series, t.target ORDER BY d.ts DESC) AS pos
             FROM (SELECT DISTINCT series FROM daily) s CROSS JOIN targets t LEFT JOIN daily d ON d.series = s.series AND d.ts <= t.target)"""


def _lag_columns(n, weights=None):
    return ", ".join(f"round(max(CASE WHEN pos = {k + 1} THEN value END) * {weights[k] if weights else 1.0!r}, 6) AS lag_{k}" for k in range(n))


@query(f"""WITH {_TARGETS} SELECT series, strftime(target, '%Y-%m-%d') AS target, {_lag_columns(5)}, least(count(ts), 5)::INT AS available, date_diff('day', max(ts), target) AS recency_days FROM seen GROUP BY series, target""")
def midas_lags(spark, sf_dir):
    """For weekly target dates, each type's last five daily means known then, with availability and recency."""
    out = lags.lags(daily_events(spark, sf_dir), _targets(spark, sf_dir), 5)
    return out.select("series", day("target").alias("target"), *[F.round(F.col("lags")[k], 6).alias(f"lag_{k}") for k in range(5)], "available", F.col("recency_days").cast("long").alias("recency_days"))


@query(f"""WITH {_TARGETS} SELECT series, strftime(target, '%Y-%m-%d') AS target, {_lag_columns(4, lags.almon_weights(4, 2.0))} FROM seen GROUP BY series, target""")
def almon_lags(spark, sf_dir):
    """Lags times Almon weights of degree 2."""
    out = lags.lags(daily_events(spark, sf_dir), _targets(spark, sf_dir), 4, degree=2.0)
    return out.select("series", day("target").alias("target"), *[F.round(F.col("lags")[k], 6).alias(f"lag_{k}") for k in range(4)])


@query(f"""WITH {_TARGETS} SELECT series, strftime(target, '%Y-%m-%d') AS target, round(arg_max(value, ts), 6) AS last, round(avg(value), 6) AS mean, round(sum(value), 4) AS sum FROM seen GROUP BY series, target""")
def aligned(spark, sf_dir):
    """Last, mean and sum of all a target date has seen."""
    obs, targets = daily_events(spark, sf_dir), _targets(spark, sf_dir)
    parts = [lags.align(obs, targets, m).withColumnRenamed("value", m) for m in ("last", "mean", "sum")]
    out = parts[0].join(parts[1], ["series", "target"]).join(parts[2], ["series", "target"])
    return rounded(rounded(out, 6, "last", "mean"), 4, "sum").withColumn("target", day("target"))


def _bridged(source: str, series: str, n: int) -> str:
    """Lag columns of one source in SQL: the newest known values on or before each target, weighted, gaps filled forward, then with the median, then 0."""
    known = f"(SELECT list(value ORDER BY ts DESC) FROM daily WHERE series = '{series}' AND ts <= target AND ts <= DATE '2024-01-25')"
    return ", ".join(f"{known}[{k + 1}] * {w!r} AS {source}_lag_{k}" for k, w in enumerate(lags.almon_weights(n, 2.0)))


_LAGS = [*(f"clicks_lag_{k}" for k in range(4)), *(f"views_lag_{k}" for k in range(3))]


@query(f"""WITH {_TARGETS}, b AS (SELECT target, {_bridged("clicks", "click", 4)}, {_bridged("views", "view", 3)} FROM targets)
    SELECT strftime(target, '%Y-%m-%d') AS target, {", ".join(f"round(coalesce({c}, last_value({c} IGNORE NULLS) OVER (ORDER BY target), median({c}) OVER (), 0), 6) AS {c}" for c in _LAGS)} FROM b""")
def bridge_features(spark, sf_dir):
    """A feature row a target date from two sources, known at a vintage date, with weighted lags and gaps filled."""
    daily = daily_events(spark, sf_dir)
    sources = {"clicks": (daily.where("series = 'click'").select("ts", "value"), 4), "views": (daily.where("series = 'view'").select("ts", "value"), 3)}
    return rounded(lags.bridge(sources, _targets(spark, sf_dir), "2024-01-25"), 6, *_LAGS).withColumn("target", day("target"))


_EASTER = """y AS (SELECT unnest(range(1995, 2031)) AS y), p AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
    q AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM p), r AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM q),
    s AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM r), easter AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM s)"""


@query(f"""WITH {_EASTER}, m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders), o AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1),
    d AS (SELECT month, unnest(generate_series(month::TIMESTAMP, last_day(month)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM m)
    SELECT strftime(month, '%Y-%m-%d') AS month, count(*)::INT AS days, count(*) FILTER (isodow(d) < 6)::INT AS business_days, count(*) FILTER (isodow(d) = 5) = 5 AS five_fridays,
        round(30.437 / count(*), 8) AS day_factor, round(21.7 / count(*) FILTER (isodow(d) < 6), 8) AS business_factor,
        CASE WHEN month(month) = 11 THEN CASE WHEN min(day(d)) FILTER (isodow(d) = 4) + 21 >= 25 THEN 1 ELSE -1 END ELSE 0 END AS thanksgiving,
        CASE WHEN month(month) = 9 THEN CASE WHEN min(day(d)) FILTER (isodow(d) = 1) <= 3 THEN -1 WHEN min(day(d)) FILTER (isodow(d) = 1) >= 6 THEN 1 ELSE 0 END ELSE 0 END AS labor_day,
        CASE WHEN bool_or(d = easter) THEN CASE WHEN day(max(easter)) <= 10 THEN -1 WHEN day(max(easter)) >= 20 THEN 1 ELSE 0 END ELSE 0 END AS easter,
        round(any_value(total) * 21.7 / count(*) FILTER (isodow(d) < 6), 2) AS adjusted
    FROM d JOIN easter ON year(d) = y JOIN o USING (month) GROUP BY month""")
def month_calendar(spark, sf_dir):
    """Days, business days, five-Friday months, adjustment factors and holiday timing of the months with orders, and their totals for months of mean length."""
    own = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    adjusted = calendar.apply_factor(F.col("total"), calendar.adjustment_factor(F.col("month"), True)).alias("adjusted")
    out = own.select("month", *calendar.measures(F.col("month")), adjusted)
    return rounded(rounded(out, 8, "day_factor", "business_factor"), 2, "adjusted").withColumn("month", day("month"))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), c AS (SELECT o_orderdate::DATE AS d, count(*) AS orders FROM orders GROUP BY 1), d AS (SELECT y, unnest(generate_series(make_date(y, 1, 1)::TIMESTAMP, make_date(y, 12, 31)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM y),
    n AS (SELECT y, d, month(d) AS m, isodow(d) AS w, row_number() OVER (PARTITION BY y, month(d), isodow(d) ORDER BY d) AS up, row_number() OVER (PARTITION BY y, month(d), isodow(d) ORDER BY d DESC) AS down FROM d)
    SELECT strftime(n.d, '%Y-%m-%d') AS day, coalesce(orders, 0) AS orders, CASE WHEN m = 1 AND day(n.d) = 1 THEN 'New Year''s Day' WHEN m = 1 AND w = 1 AND up = 3 THEN 'Martin Luther King Jr. Day' WHEN m = 2 AND w = 1 AND up = 3 THEN 'Presidents'' Day' WHEN m = 5 AND w = 1 AND down = 1 THEN 'Memorial Day' WHEN m = 6 AND day(n.d) = 19 THEN 'Juneteenth' WHEN m = 7 AND day(n.d) = 4 THEN 'Independence Day' WHEN m = 9 AND w = 1 AND up = 1 THEN 'Labor Day' WHEN m = 10 AND w = 1 AND up = 2 THEN 'Columbus Day' WHEN m = 11 AND day(n.d) = 11 THEN 'Veterans Day' WHEN m = 11 AND w = 4 AND up = 4 THEN 'Thanksgiving' WHEN m = 12 AND day(n.d) = 25 THEN 'Christmas' END AS holiday
    FROM n LEFT JOIN c ON c.d = n.d WHERE holiday IS NOT NULL""")
def federal_holidays(spark, sf_dir):
    """Eleven holidays of each year with orders, on their nominal dates, and the orders of that day."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    counts = own.groupBy("day").agg(F.count("*").alias("orders"))
    out = calendar.holidays_of(own.select(F.year("day").alias("year")), "year").join(counts, "day", "left").na.fill(0, ["orders"])
    return out.select(day("day").alias("day"), "holiday", "orders")


@query(f"""WITH {_EASTER}, l AS (SELECT year(l_shipdate) AS y, l_shipdate::DATE AS d FROM lineitem) SELECT y::INT AS year, strftime(any_value(easter), '%Y-%m-%d') AS easter, count(*) FILTER (d < easter AND d >= easter - 7) AS week_before, count(*) AS lines FROM l JOIN easter USING (y) GROUP BY y""")
def easter_sundays(spark, sf_dir):
    """Easter Sunday of each year with shipped lines, and how many were shipped in the week before."""
    own = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_shipdate").cast("date").alias("d"))
    sunday = calendar.easter(F.col("year"))
    out = own.groupBy("year").agg(F.count_if((F.col("d") < sunday) & (F.col("d") >= F.date_sub(sunday, 7))).alias("week_before"), F.count("*").alias("lines"))
    return out.select("year", day(sunday).alias("easter"), "week_before", "lines")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS c, o_orderdate::DATE AS d FROM orders), g AS (SELECT c, date_diff('day', lag(d) OVER (PARTITION BY c ORDER BY d), d) AS gap FROM d)
    SELECT c AS o_custkey, CASE WHEN count(*) < 4 THEN 'unknown' WHEN avg((gap BETWEEN 12 AND 16)::INT) > 0.7 THEN 'biweekly' WHEN avg((gap BETWEEN 13 AND 18)::INT) > 0.6 THEN 'semimonthly' ELSE 'unknown' END AS pay_period FROM g GROUP BY c""")
def pay_periods(spark, sf_dir):
    """Pay rhythm of each customer's order dates."""
    return calendar.pay_period_type(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderpriority = '5-LOW'""")
def common_dates(spark, sf_dir):
    """Dates that two series share."""
    own = orders_by_priority(spark, sf_dir).select("series", day("ts").alias("day"))
    return own.where("series = '1-URGENT'").select("day").intersect(own.where("series = '5-LOW'").select("day"))
