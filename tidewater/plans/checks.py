"""Queries on folds, calibration, keyed tables and the lineage of artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.folders import fresh
from tidewater.operators import artifact_lineage, calibrate, folds, metrics
from tidewater.plans.base import MONTHLY, day, monthly_orders, query, rounded, table
from tidewater.sources import metadata
from tidewater.sources.keyed_table import KeyedTable


@query(f"""WITH {MONTHLY}, r AS (SELECT series, value AS y, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n, lag(value) OVER (PARTITION BY series ORDER BY month) AS x FROM monthly),
    k AS (SELECT series, y, x, pos, unnest(range(0, greatest(0, (n - 6 - 30) // 3 + 1))) AS fold FROM r), m AS (SELECT series, fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k WHERE pos < 30 + 3 * fold GROUP BY 1, 2),
    s AS (SELECT series, fold, sqrt(avg(pow(y - a - b * x, 2))) AS rmse, 100 * avg(abs(y - a - b * x) / greatest(abs(y), 1e-10)) AS mape FROM k JOIN m USING (series, fold) WHERE pos >= 30 + 3 * fold AND pos < 36 + 3 * fold GROUP BY 1, 2)
    SELECT 'rmse' AS score, round(avg(rmse), 2) AS mean, round(stddev_pop(rmse), 2) AS std, round(min(rmse), 2) AS min, round(max(rmse), 2) AS max FROM s UNION ALL SELECT 'mape', round(avg(mape), 2), round(stddev_pop(mape), 2), round(min(mape), 2), round(max(mape), 2) FROM s""")
def fold_summaries(spark, sf_dir):
    """Monthly totals forecast from the month before, by a line fitted anew for each fold: scores over all folds and series."""
    from pyspark.sql import Window

    rows = monthly_orders(spark, sf_dir).withColumn("x", F.lag("value").over(Window.partitionBy("series").orderBy("month")))
    scores = folds.cross_validate_linear(rows, "series", "month", ["x"], "value", {"rmse": metrics.rmse("value", "f"), "mape": metrics.mape("value", "f")}, initial=30, step=3, horizon=6)
    parts = [metrics.fold_summary(scores, c).withColumn("score", F.lit(c)) for c in ("rmse", "mape")]
    return rounded(parts[0].unionByName(parts[1]), 2, "mean", "std", "min", "max")


@query("""WITH g AS (SELECT (l_quantity - 1) / 50.0 AS p, count(*) AS n, count(*) FILTER (l_extendedprice > 45000) AS s FROM lineitem GROUP BY 1),
    w AS (SELECT a.p AS lo, b.p AS hi, sum(c.s) / sum(c.n) AS m FROM g a JOIN g b ON a.p <= b.p JOIN g c ON c.p BETWEEN a.p AND b.p GROUP BY 1, 2),
    k AS (SELECT g.p, lo, min(m) AS m FROM g JOIN w ON lo <= g.p AND hi >= g.p GROUP BY 1, 2), c AS (SELECT g.p, max(m) AS q, any_value(n) AS n, any_value(s) AS s FROM g JOIN k ON k.p = g.p GROUP BY 1),
    a AS (SELECT sum(n * p) AS x, sum(s) AS s, sum(n) AS n FROM c GROUP BY least(9, floor(p * 10 + 1e-9))), b AS (SELECT sum(n * q) AS x, sum(s) AS s, sum(n) AS n FROM c GROUP BY least(9, floor(q * 10 + 1e-9)))
    SELECT 'before' AS fit, round(sum(abs(x - s)) / sum(n), 8) AS ece FROM a UNION ALL SELECT 'after', round(sum(abs(x - s)) / sum(n), 8) FROM b""")
def calibration_gain(spark, sf_dir):
    """The expected calibration error before and after a rising fit."""
    own = table(spark, sf_dir, "lineitem").select(((F.col("l_quantity") - 1) / 50.0).alias("p"), (F.col("l_extendedprice") > 45000).cast("double").alias("y"))
    fitted = calibrate.isotonic(own, own, "p", "y")
    parts = [metrics.calibration_error(df, "y", c).select(F.lit(name).alias("fit"), "ece") for name, df, c in (("before", own, "p"), ("after", fitted, "calibrated"))]
    return rounded(parts[0].union(parts[1]), 8, "ece")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 2 * o_totalprice ELSE o_totalprice END AS value, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS round FROM orders
    UNION ALL SELECT -o_orderkey, o_totalprice, 2 FROM orders WHERE o_orderpriority = '1-URGENT'""")
def keyed_upserts(spark, sf_dir):
    """A keyed table after two rounds of upserts, read back: all orders, then changed and new ones."""
    own = table(spark, sf_dir, "orders")
    kept = KeyedTable(spark, fresh(spark, "keyed"), ["id", "new"], buckets=16)  # the new row of order 0 has its number, but is another row

    def rows(orders, number, value, new: bool, round_: int):
        return orders.select(number.alias("id"), value.alias("value"), F.lit(round_).alias("round"), F.lit(new).alias("new"))

    number, price = F.col("o_orderkey"), F.col("o_totalprice")
    kept.upsert(rows(own, number, price, False, 1))
    kept.upsert(rows(own.where("o_orderstatus = 'F'"), number, 2 * price, False, 2).union(rows(own.where("o_orderpriority = '1-URGENT'"), -number, price, True, 2)))
    return kept.read().drop("new")


_USED = """c AS (SELECT 'c' || c_custkey AS model, c_custkey AS k, n_name AS nation, r_name AS region, n_regionkey + 1 AS version, c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN '2024-02-01' ELSE '2024-01-01' END AS vintage FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    u AS (SELECT * FROM c WHERE k % 10 <> 0), b AS (SELECT n_name AS nation, 0.1 * avg(c_acctbal) AS worse FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"""


@query(f"""WITH {_USED} SELECT 'artifact_features_present' AS "check", 'critical' AS severity, model, NULL AS feature, 'no features' AS detail FROM c WHERE k % 10 = 0
    UNION ALL SELECT 'feature_registered', 'critical', model, segment, 'not registered' FROM u WHERE segment = 'FURNITURE'
    UNION ALL SELECT 'feature_version_match', 'critical', model, nation, 'asked 9, found ' || version FROM u WHERE k % 3 = 0
    UNION ALL SELECT 'feature_vintage_match', 'warning', model, nation, 'artifact ' || vintage || ', feature 2024-01-01' FROM u WHERE vintage <> '2024-01-01'
    UNION ALL SELECT 'feature_vintage_match', 'warning', model, segment, 'artifact ' || vintage || ', feature 2024-02-01' FROM u WHERE vintage <> '2024-02-01' AND segment <> 'FURNITURE'
    UNION ALL SELECT 'lineage_registered', 'critical', model, nation, 'not registered: ASIA' FROM u WHERE region = 'ASIA'
    UNION ALL SELECT 'lineage_registered', 'critical', model, segment, 'not registered: SEGMENTS' FROM u WHERE segment <> 'FURNITURE'
    UNION ALL SELECT 'lineage_cycle', 'critical', model, nation, 'descends from a cycle' FROM u WHERE region IN ('AFRICA', 'EUROPE')
    UNION ALL SELECT 'artifact_lineage_coverage', CASE WHEN segment = 'FURNITURE' THEN 'critical' ELSE 'info' END, model, NULL, CASE WHEN segment = 'FURNITURE' THEN '1 of 2' ELSE '2 of 2' END FROM u
    UNION ALL SELECT 'rollback_impact', CASE WHEN worse <= 450 THEN 'info' ELSE 'warning' END, NULL, nation, 'worse by ' || format('{{:,.4f}}', worse) FROM b""")
def lineage_findings(spark, sf_dir):
    """What artifacts (one a customer, on its nation and segment) say of their features, against a registry: every kind of finding."""
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    of = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    asked = F.create_map("n_name", F.when(key % 3 == 0, "9").otherwise((F.col("n_regionkey") + 1).cast("string")))
    names = F.when(key % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("n_name", "c_mktsegment", "n_name"))
    models = of.select(F.concat(F.lit("c"), key).alias("model"), names.alias("features"), asked.alias("versions"), F.when(F.col("c_acctbal") < 0, "2024-02-01").otherwise("2024-01-01").alias("vintage"))
    segments = customer.select(F.col("c_mktsegment").alias("name")).distinct()
    features = nation.select(F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).cast("int").alias("version"), F.lit("2024-01-01").alias("vintage"))
    features = features.union(segments.where("name <> 'FURNITURE'").select("name", F.lit(1), F.lit("2024-02-01"))).union(region.where("r_name <> 'ASIA'").select("r_name", F.lit(1), F.lit("2024-01-01")))
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    ring = region.where("r_name IN ('AFRICA', 'EUROPE')").select("r_name", F.when(F.col("r_name") == "AFRICA", "EUROPE").otherwise("AFRICA"))
    edges = up.union(segments.select("name", F.lit("SEGMENTS"))).union(ring)
    rollbacks = of.groupBy(F.col("n_name").alias("feature")).agg(F.avg("c_acctbal").alias("baseline"), (1.1 * F.avg("c_acctbal")).alias("rollback")).withColumn("allowed", F.lit(450.0))
    return artifact_lineage.findings(spark, models, features, edges, rollbacks)


@query("""SELECT 'orders' AS source_name, strftime(o_orderdate, '%Y-%m-%d') AS vintage_date, count(*) AS row_count, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'failed' ELSE 'success' END AS status FROM orders GROUP BY 2""")
def ingestion_log(spark, sf_dir):
    """A log of loads, one a day of orders, recorded as running and again with its end, read back."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("vintage_date")).agg(F.count("*").alias("row_count"), F.when(F.count_if(F.col("o_orderstatus") == "F") > 0, "failed").otherwise("success").alias("status"))
    days = days.select(F.lit("orders").alias("source_name"), F.col("vintage_date").cast("timestamp").alias("ingestion_timestamp"), "vintage_date", "row_count", "status")
    base = fresh(spark, "metadata")
    metadata.record(spark, base, "ingestion_log", days.drop("row_count").withColumn("status", F.lit("running")))
    own = metadata.record(spark, base, "ingestion_log", days)
    return own.read().select("source_name", day("vintage_date").alias("vintage_date"), "row_count", "status")
