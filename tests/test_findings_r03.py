"""What the third review found: each case gave an error or another result before."""

import numpy as np
from oracle import connect, differences
from pyspark import RDD
from pyspark.sql import functions as F

from tidewater.operators import boosting, calibrate, nearby, scaling
from tidewater.plans import catalog

DATA = "/root/testdata/sf0.001"


def changed(path, **tables):
    """A folder with tables made by SQL from those of DATA."""
    con = connect(DATA)
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{path}/{name}.parquet' (FORMAT parquet)")
    return str(path)


def same(spark, folder, name):
    return differences(catalog.queries()[name](spark, folder), connect(folder), catalog.oracle_sql()[name])


#: Parts whose dates reach the year 11278, as larger tables have them.
LATE = "SELECT * REPLACE (p_partkey + i * 200000 AS p_partkey) FROM part, range(2) x(i)"


def test_weather_effects_beyond_the_year_9999(spark, tmp_path):
    assert same(spark, changed(tmp_path, part=LATE), "weather_effects") == []


def test_weather_months_beyond_the_year_9999(spark, tmp_path):
    assert same(spark, changed(tmp_path, part=LATE), "weather_months") == []


def test_recent_disruptions_beyond_the_year_9999(spark, tmp_path):
    assert same(spark, changed(tmp_path, part=LATE), "recent_disruptions") == []


#: Parts whose prices have four decimals, so that scores and sums end in halves of what is rounded.
HALVES = "SELECT * REPLACE (round(p_retailprice + p_partkey * 0.0005, 4) AS p_retailprice) FROM part"


def test_weather_months_round_halves_as_the_sql_does(spark, tmp_path):
    assert same(spark, changed(tmp_path, part=HALVES), "weather_months") == []


def test_recent_disruptions_round_halves_as_the_sql_does(spark, tmp_path):
    later = HALVES.replace("REPLACE (", "REPLACE (p_partkey + 200 AS p_partkey, ")
    assert same(spark, changed(tmp_path, part=later), "recent_disruptions") == []


#: Parts with sizes from -25 to 25, and later keys, so that recent months have them too.
BELOW = "SELECT * REPLACE (p_partkey + 200 AS p_partkey, (p_size - 25)::INT AS p_size) FROM part"


def test_recent_disruptions_with_sizes_below_0(spark, tmp_path):
    assert same(spark, changed(tmp_path, part=BELOW), "recent_disruptions") == []


def test_weather_months_and_effects_with_sizes_below_0(spark, tmp_path):
    folder = changed(tmp_path, part=BELOW)
    assert [same(spark, folder, name) for name in ("weather_months", "weather_effects")] == [[], []]


def test_event_overlap_has_no_cap(spark, tmp_path):
    folder = changed(tmp_path, lineitem="SELECT * REPLACE (l_partkey + 10000000000 AS l_partkey) FROM lineitem")
    rows = catalog.queries()["event_overlap"](spark, folder).collect()
    assert max(r.impact for r in rows) > 1e9
    assert same(spark, folder, "event_overlap") == []


def test_keyed_upserts_of_an_urgent_order_0(spark, tmp_path):
    folder = changed(tmp_path, orders="SELECT * REPLACE (CASE WHEN o_orderkey = 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority) FROM orders")
    assert same(spark, folder, "keyed_upserts") == []
    assert catalog.queries()["keyed_upserts"](spark, folder).where("id = 0").count() == 2


def test_probability_scores_have_their_spread(spark):
    got = catalog.queries()["probability_scores"](spark, DATA)
    assert got.first().sharpness > 0
    assert same(spark, DATA, "probability_scores") == []


def plain_widths(y, p, level=0.9, gamma=0.1, mix=0.7, quantile=0.9):
    """Each forecast held against each row."""
    r = np.abs(y - p)
    at = np.lexsort((p, r))
    plain = np.quantile(r, min(1, level + 1 / (len(r) + 1)))
    w = np.exp(-np.abs(p[at] - p[:, None]) / (gamma * p.std()))
    before = (np.cumsum(w / (w.sum(1) + 1e-10)[:, None], 1) < quantile).sum(1)
    return mix * r[at][np.minimum(before, len(r) - 1)] + (1 - mix) * plain


def test_adaptive_widths_of_more_than_20000_rows(spark, tmp_path):
    con = connect(DATA)
    n = con.execute("SELECT count(*) FROM supplier").fetchone()[0]
    copies = 20_500 // n + 1
    folder = changed(tmp_path, supplier=f"SELECT * REPLACE (s_suppkey + i * {n} AS s_suppkey, s_acctbal + i AS s_acctbal) FROM supplier, range({copies}) x(i)")
    x = spark.read.parquet(f"{folder}/supplier.parquet").toPandas().sort_values("s_suppkey")
    got = {r.s_suppkey: r.width for r in catalog.queries()["adaptive_widths"](spark, folder).collect()}
    assert len(got) == len(x) > 20_000
    pick = np.arange(0, len(x), 401)
    y, p = x.s_acctbal.to_numpy(), 180.0 * x.s_nationkey.to_numpy()
    r = np.abs(y - p)
    at = np.lexsort((p, r))
    w = np.exp(-np.abs(p[at] - p[pick, None]) / (0.1 * p.std()))
    before = (np.cumsum(w / (w.sum(1) + 1e-10)[:, None], 1) < 0.9).sum(1)
    want = 0.7 * r[at][before] + 0.3 * np.quantile(r, 0.9 + 1 / (len(r) + 1))
    np.testing.assert_allclose([got[k] for k in x.s_suppkey.to_numpy()[pick]], want, atol=1e-4)


def test_widths_by_blocks_and_chunks_are_the_plain_ones(spark, monkeypatch):
    draw = np.random.default_rng(3)
    p = np.r_[draw.normal(0, 1, 700), draw.normal(40, 5, 300), [500.0, -300.0], np.repeat(2.5, 50)]
    y = p + draw.normal(0, 1, len(p)) * (1 + np.abs(p) / 10)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "k int, y double, f double")
    blocked = nearby.quantiles
    monkeypatch.setattr(nearby, "quantiles", lambda *a: blocked(*a, chunks=7, block=90))
    odd = df.union(spark.createDataFrame([(-1, 0.0, None), (-2, 0.0, float("nan")), (-3, 0.0, 1e9)], df.schema))
    got = {r.k: r.width for r in calibrate.adaptive_width(odd, df, "y", "f").collect()}
    np.testing.assert_allclose([got[i] for i in range(len(p))], plain_widths(y, p), rtol=1e-12)
    most = 0.7 * np.abs(y - p).max() + 0.3 * np.quantile(np.abs(y - p), 0.9 + 1 / (len(p) + 1))
    assert [round(got[i] - most, 9) for i in (-1, -2, -3)] == [0, 0, 0]
    alike = df.withColumn("f", F.lit(1.0))
    r = np.sort(np.abs(y - 1))
    flat = 0.7 * r[int(np.ceil(0.9 * len(r))) - 1] + 0.3 * np.quantile(r, 0.9 + 1 / (len(r) + 1))
    assert {round(x.width - flat, 9) for x in calibrate.adaptive_width(alike, alike, "y", "f").collect()} == {0}
    assert calibrate.adaptive_width(df, df.limit(0), "y", "f").where("width is not null").count() == 0


def test_quantiles_of_scalers_are_in_no_single_task(spark):
    df = spark.range(30_000).select((F.col("id") * 7919 % 30_011).cast("double").alias("v"), F.lit(None).cast("double").alias("none"))
    x = np.arange(30_000) * 7919 % 30_011
    fitted = scaling.fit_together([scaling.RobustScaler(["v", "none"]), scaling.Winsorizer(["v"]), scaling.MinMaxScaler(["v"])], df)
    q = np.quantile(x, [0.05, 0.25, 0.5, 0.75, 0.95])
    assert np.allclose(fitted[0].learned["v"], (q[2], q[3] - q[1])) and np.allclose(fitted[1].learned["v"], (q[0], q[4]))
    assert fitted[0].learned["none"] == (0.0, 1.0) and fitted[2].learned["v"] == (x.min(), x.max() - x.min())


def test_scaled_asks_for_no_percentile_of_all_rows(spark, monkeypatch):
    def held(*a, **k):
        raise AssertionError("one task would hold all different values")

    monkeypatch.setattr(F, "percentile", held)
    assert catalog.queries()["scaled"](spark, DATA).count() > 0


def test_scores_by_series_sort_no_series(spark):
    df = spark.range(1_000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    plan = scaling.scores_by_series(df, "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_boosted_trees_send_no_parts_of_tasks(spark, monkeypatch):
    draw = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(draw.integers(0, 9, 4_000), draw.normal(0, 1, 4_000), strict=True)], "x double, y double")

    def sent(*a, **k):
        raise AssertionError("every task's residuals and counts would reach the driver")

    monkeypatch.setattr(RDD, "reduce", sent)
    monkeypatch.setattr(RDD, "treeReduce", sent)
    fits = [boosting.fit(df.repartition(n), ["x"], "y", (0.1, 0.5), trees=2, depth=2, partitions=n, sent=50, parts=16, most_cells=cells) for n, cells in ((1, 100), (3, 100), (40, 0))]
    assert fits[0].trees == fits[1].trees == fits[2].trees
