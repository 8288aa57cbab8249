"""Queries of the forecasting models, with SQL where a case has a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import boosting, dynamic_factors, lag_fit, mixed, ridge_head, windows
from tidewater.plans.base import MONTHLY, day, monthly_orders, query, rounded, table
from tidewater.plans.mixed import mixed_rows


@query(f"""WITH {MONTHLY}, z AS (SELECT series, month, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM monthly),
    e AS (SELECT quantile_cont(z, 0.01) AS low, quantile_cont(z, 0.99) AS high FROM z),
    c AS (SELECT series, month, greatest(low, least(high, z)) AS x FROM z, e), l AS (SELECT *, lag(x) OVER (PARTITION BY series ORDER BY month) AS b FROM c),
    p AS (SELECT sum(x * b) / sum(b * b) AS phi FROM l), s AS (SELECT sqrt(avg((x - phi * b) * (x - phi * b))) AS s, any_value(phi) AS phi FROM l, p WHERE b IS NOT NULL)
    SELECT series, strftime(month, '%Y-%m-%d') AS month, round(x / s, 4) AS factor, round(phi, 5) AS transition, round(s, 5) AS loading FROM l, s""")
def planted_factor(spark, sf_dir):
    """One factor behind three columns without noise: the fit by likelihood has a closed form."""
    own = monthly_orders(spark, sf_dir).select("series", "month", (3 * F.col("value") + 10).alias("a"), (0.5 * F.col("value") - 7).alias("b"), F.col("value").alias("c"))
    m = dynamic_factors.fit(own, ["a", "b", "c"], 1, "month", "series", rounds=60, tolerance=1e-10)
    out = m.transform(own, "month", "series")
    out = out.select("series", "month", F.col("factor_1").alias("factor"), F.lit(float(m.transition[0, 0])).alias("transition"), F.lit(float(m.loadings[0, 0])).alias("loading"))
    return rounded(rounded(out, 4, "factor"), 5, "transition", "loading").withColumn("month", day("month"))


@query()
def order_factors(spark, sf_dir):
    """Two factors behind four monthly measures of each priority's orders, from values up to each month."""
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.trunc("o_orderdate", "MM").alias("month"))
    own = own.agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("orders"), F.avg("o_totalprice").alias("mean"), F.count_distinct("o_custkey").alias("customers"))
    m = dynamic_factors.fit(own, ["total", "orders", "mean", "customers"], 2, "month", "series", rounds=30)
    return m.transform(own, "month", "series").withColumn("month", day("month"))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS x, sum(o_totalprice) AS y FROM orders GROUP BY 1),
    z AS (SELECT month, row_number() OVER (ORDER BY month) AS pos, greatest(5, floor(count(*) OVER () * 0.8)) AS border, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS zx, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS zy, avg(y) OVER () AS my, stddev_pop(y) OVER () AS sy FROM m),
    f AS (SELECT p, avg(zx) AS mx, avg(zy) AS my, (sum(zx * zy) - count(*) * avg(zx) * avg(zy)) / (sum(zx * zx) - count(*) * avg(zx) * avg(zx) + p) AS w FROM z, (VALUES (0.1), (1.0), (10.0), (100.0)) v(p) WHERE pos <= border GROUP BY 1),
    e AS (SELECT p, avg((zy - f.my - w * (zx - mx)) ** 2) AS e FROM z, f WHERE pos > border GROUP BY 1), c AS (SELECT arg_min(p, e) AS p, min(e) AS e FROM e),
    a AS (SELECT sum(zx * zy) / (sum(zx * zx) + any_value(p)) AS w, any_value(p) AS p, any_value(e) AS e FROM z, c)
    SELECT strftime(month, '%Y-%m-%d') AS month, round(my + sy * w * zx, 2) AS fitted, p::DOUBLE AS penalty, round(e, 6) AS error FROM z, a""")
def ridge_by_validation(spark, sf_dir):
    """A ridge of monthly totals on the number of orders, its penalty chosen on the last fifth."""
    own = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("x"), F.sum("o_totalprice").alias("y"))
    m = ridge_head.chosen(own, ["x"], "y", "month")
    return own.select(day("month").alias("month"), F.round(m.predict(), 2).alias("fitted"), F.lit(m.penalty).alias("penalty"), F.lit(round(m.errors[m.penalty], 6)).alias("error"))


@query(f"""WITH {MONTHLY}, r AS (SELECT series, month, value AS y, lag(value) OVER w AS a, lag(value, 2) OVER w AS b FROM monthly WINDOW w AS (PARTITION BY series ORDER BY month)),
    g AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bye FROM r WHERE b IS NOT NULL),
    w AS (SELECT *, (ay * bb - bye * ab) / (aa * bb - ab * ab) AS wa, (bye * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM g)
    SELECT series, strftime(month, '%Y-%m-%d') AS month, round(my + wa * (a - ma) + wb * (b - mb), 1) AS fitted FROM r, w""")
def nonlinear_lags(spark, sf_dir):
    """Two lags with a slope each beside softmax weights: fitted values are those of least squares."""
    w = windows.over("series", "month")
    rows = monthly_orders(spark, sf_dir).select("series", "month", "value", *[F.lag("value", k).over(w).alias(f"lag_{k}") for k in (1, 2)])
    m = lag_fit.nonlinear_midas(rows, {"own": ["lag_1", "lag_2"]}, "value", slopes="lag")
    return rows.select("series", day("month").alias("month"), F.round(m.predict(), 1).alias("fitted"))


@query()
def weighted_lags(spark, sf_dir):
    """Six lags of monthly totals under one slope and weights on a softmax of a quadratic: the weights."""
    w = windows.over("series", "month")
    names = [f"lag_{k}" for k in range(1, 7)]
    rows = monthly_orders(spark, sf_dir).select("series", "month", "value", *[F.lag("value", k).over(w).alias(f"lag_{k}") for k in range(1, 7)])
    m = lag_fit.nonlinear_midas(rows, {"own": names}, "value")
    return spark.createDataFrame([(c, float(x), float(m.slopes["own"][0])) for c, x in zip(names, m.lag_weights["own"], strict=True)], "lag string, weight double, slope double")


def _priced(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series"), F.month("o_orderdate").cast("double").alias("m"), (F.col("o_custkey") % 7).cast("double").alias("c"), F.col("o_totalprice").alias("y"))


@query("""WITH d AS (SELECT o_orderkey, month(o_orderdate)::DOUBLE AS m, (o_custkey % 7)::DOUBLE AS c, o_totalprice AS y FROM orders),
    s AS (SELECT q, quantile_cont(y, q) AS f FROM d, (VALUES (0.1), (0.5), (0.9)) v(q) GROUP BY q),
    x AS (SELECT q, o_orderkey, m, c, y - f AS r, f, CASE WHEN y > f THEN q ELSE q - 1 END AS g FROM d, s),
    h AS (SELECT q, 0 AS col, m AS pt, count(*) AS n, sum(g) AS g FROM x GROUP BY 1, 3 UNION ALL SELECT q, 1, c, count(*), sum(g) FROM x GROUP BY 1, 3),
    k AS (SELECT q, col, pt, sum(n) OVER w AS ln, sum(g) OVER w AS lg, sum(n) OVER (PARTITION BY q, col) AS n, sum(g) OVER (PARTITION BY q, col) AS g FROM h WINDOW w AS (PARTITION BY q, col ORDER BY pt)),
    b AS (SELECT q, arg_max({'col': col, 'pt': pt}, lg * lg / ln + (g - lg) * (g - lg) / (n - ln)) AS cut FROM k WHERE ln >= 20 AND n - ln >= 20 GROUP BY 1),
    y AS (SELECT x.q, o_orderkey, f, r, CASE WHEN cut.col = 0 THEN m ELSE c END <= cut.pt AS goes FROM x JOIN b ON b.q = x.q),
    l AS (SELECT q, goes, quantile_cont(r, q) AS v FROM y WHERE q = 0.1 GROUP BY ALL UNION ALL SELECT q, goes, quantile_cont(r, 0.5) FROM y WHERE q = 0.5 GROUP BY ALL UNION ALL SELECT q, goes, quantile_cont(r, 0.9) FROM y WHERE q = 0.9 GROUP BY ALL),
    o AS (SELECT y.q, o_orderkey, f + 0.5 * v AS f FROM y JOIN l ON l.q = y.q AND l.goes = y.goes)
    SELECT o_orderkey, round(max(f) FILTER (q = 0.1), 4) AS q_10, round(max(f) FILTER (q = 0.5), 4) AS q_50, round(max(f) FILTER (q = 0.9), 4) AS q_90 FROM o GROUP BY 1""".replace("quantile_cont(y, q) AS f FROM d, (VALUES (0.1), (0.5), (0.9)) v(q) GROUP BY q", "f FROM (SELECT unnest([0.1, 0.5, 0.9]) AS q, unnest(quantile_cont(y, [0.1, 0.5, 0.9])) AS f FROM d)").replace("quantile_cont(r, q) AS v FROM y WHERE q = 0.1", "quantile_cont(r, 0.1) AS v FROM y WHERE q = 0.1"))
def pinball_stumps(spark, sf_dir):
    """One round of one split for three quantiles of order values."""
    own = _priced(spark, sf_dir)
    m = boosting.fit(own, ["m", "c"], "y", (0.1, 0.5, 0.9), trees=1, depth=1, rate=0.5)
    return rounded(m.predict(own).select("o_orderkey", "q_10", "q_50", "q_90"), 4, "q_10", "q_50", "q_90")


@query()
def quantile_forecast(spark, sf_dir):
    """Seven quantiles of order values by 100 boosted trees of depth 5 each, kept in order: mean by series."""
    own = _priced(spark, sf_dir)
    out = boosting.fit(own, ["m", "c"], "y").predict(own.select("series", "m", "c"))
    return out.groupBy("series").agg(*[F.avg(c).alias(c) for c in ("q_5", "q_10", "q_25", "q_50", "q_75", "q_90", "q_95")])


@query()
def mixed_forecast(spark, sf_dir):
    """Monthly order totals from the last days of two priorities: three models, their weighted mean, and an interval."""
    rows, groups, recency = mixed_rows(spark, sf_dir)
    fitted = mixed.fit(rows, groups, "y", optimise=True, ts="target")
    return fitted.predict(rows, recency).select(day("target").alias("target"), "y", "dfm", "midas", "xgboost", "forecast", "low", "high")


@query()
def factor_nowcast(spark, sf_dir):
    """Monthly order totals by priority from two factors of four measures of the month before, and from the measures themselves."""
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.trunc("o_orderdate", "MM").alias("month"))
    own = own.agg(F.sum("o_totalprice").alias("y"), F.count("*").alias("orders"), F.avg("o_totalprice").alias("mean"), F.count_distinct("o_custkey").alias("customers"))
    before = [F.lag(c).over(windows.over("series", "month")).alias(f"{c}_before") for c in ("y", "orders", "mean", "customers")]
    rows = own.select("series", "month", "y", *before)
    names = ["y_before", "orders_before", "mean_before", "customers_before"]
    m = dynamic_factors.nowcast(rows, names, "y", 2, "month", "series", rounds=20)
    return m.transform(rows).select("series", day("month").alias("month"), "y", m.head.predict().alias("nowcast"), F.lit(m.head.penalty).alias("penalty"))
