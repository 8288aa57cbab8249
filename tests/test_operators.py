"""Edge cases and properties of the operators."""

import datetime
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import calendar
from tidewater.operators import aggregate, calibrate, lags, metrics, models, payload, quality, reconcile, registry, resample, scaling, scenario, seasonal, vintage, windows
from tidewater.sources import readers, transforms


def d(text):
    return datetime.date.fromisoformat(text)


def series(spark, rows):
    return spark.createDataFrame([(s, d(t), v) for s, t, v in rows], "series string, ts date, value double")


def test_weeks_end_on_sunday(spark):
    days = spark.createDataFrame([(d("2024-01-01"),), (d("2024-01-07"),), (d("2024-01-08"),), (d("2020-12-31"),)], "t date")
    assert [r[0] for r in days.select(calendar.week(F.col("t"))).collect()] == [d("2024-01-07"), d("2024-01-07"), d("2024-01-14"), d("2021-01-03")]


def test_resample_fills_gaps(spark):
    got = resample.resample(series(spark, [("a", "2024-01-05", 1.0), ("a", "2024-01-20", None), ("a", "2024-04-02", 3.0)]), "MS", ("mean", "sum", "last")).orderBy("bin").collect()
    assert [(r.bin.month, r["mean"], r["sum"], r["last"]) for r in got] == [(1, 1.0, 1.0, 1.0), (2, None, 0.0, None), (3, None, 0.0, None), (4, 3.0, 3.0, 3.0)]


def test_resample_of_nothing(spark):
    assert resample.resample(series(spark, []), "W", ("mean", "sum")).count() == 0


def test_monthly_source_is_not_converted(spark):
    with pytest.raises(ValueError):
        resample.convert(series(spark, []), "MS", source="M")


def test_ratio():
    assert [resample.frequency_ratio(*x) for x in (("D", "W"), ("D", "M"), ("W", "M"), ("M", "M"))] == [7, 30, 4, 1]
    with pytest.raises(ValueError):
        resample.frequency_ratio("M", "D")


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 60), st.floats(0, 5))
def test_almon_weights_sum_to_one(n, degree):
    w = lags.almon_weights(n, degree)
    assert math.isclose(sum(w), 1) and all(x > 0 for x in w) and w == sorted(w, reverse=True)


def test_lags_never_see_the_future(spark):
    obs = series(spark, [("a", f"2024-01-{k:02d}", float(k)) for k in (1, 3, 5, 7)])
    targets = spark.createDataFrame([(d("2023-12-31"),), (d("2024-01-05"),), (d("2024-01-06"),), (d("2024-02-01"),)], "target date")
    got = {r.target: (r.lags, r.available, r.recency_days) for r in lags.lags(obs, targets, 3).collect()}
    assert got[d("2023-12-31")] == ([None, None, None], 0, None)
    assert got[d("2024-01-05")] == ([5.0, 3.0, 1.0], 3, 0)
    assert got[d("2024-01-06")] == ([5.0, 3.0, 1.0], 3, 1)
    assert got[d("2024-02-01")] == ([7.0, 5.0, 3.0], 3, 25)


def test_fill_order(spark):
    rows = series(spark, [("a", "2024-01-01", None), ("a", "2024-01-02", 4.0), ("a", "2024-01-03", None), ("b", "2024-01-01", None)])
    honest = {(r.series, r.ts.day): r.value for r in lags.fill_gaps(rows, ["value"], "series", "ts").collect()}
    assert honest == {("a", 1): 4.0, ("a", 2): 4.0, ("a", 3): 4.0, ("b", 1): 0.0}


def test_bridge_cuts_off_at_the_vintage(spark):
    obs = series(spark, [("x", f"2024-01-{k:02d}", float(k)) for k in range(1, 29)]).select("ts", "value")
    targets = spark.createDataFrame([(d("2024-01-20"),)], "target date")
    got = lags.bridge({"x": (obs, 2)}, targets, "2024-01-10", degree=None).first()
    assert (got.x_lag_0, got.x_lag_1) == (10.0, 9.0)


def test_streak_and_latest(spark):
    rows = series(spark, [("a", f"2024-01-0{k + 1}", v) for k, v in enumerate([1.0, 2.0, 3.0, 3.0, 4.0])])
    assert [r.streak for r in windows.increases_in_a_row(rows, "value", "series", "ts").orderBy("ts").collect()] == [0, 1, 2, 0, 1]
    assert windows.latest(rows, "series", "ts").first().value == 4.0


def test_weighted_mean_counts_weights_of_nulls(spark):
    rows = spark.createDataFrame([("d", "x", 10.0), ("d", "y", None)], "day string, state string, v double")
    w = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "state string, w double")
    assert aggregate.weighted_mean(rows, w, ["day"], "state", "v", "w").first().weighted_mean == 2.5
    with pytest.raises(Exception, match="no weight"):
        aggregate.weighted_mean(rows, w.where("state = 'x'"), ["day"], "state", "v", "w", missing="error").collect()


@pytest.mark.parametrize(("values", "want"), [([1.0, 3.0], [0.25, 0.75]), ([0.0, 0.0], [0.5, 0.5])])
def test_shares(spark, values, want):
    assert sorted(r.weight for r in aggregate.shares(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()) == want


def test_negative_share_is_an_error(spark):
    with pytest.raises(Exception, match="negative"):
        aggregate.shares(spark.createDataFrame([(-1.0,), (2.0,)], "v double"), "v").collect()


def test_scalers_round_trip(spark):
    rows = spark.createDataFrame([(float(v), 5.0) for v in (1, 2, 4, 9)], "a double, b double")
    for make in (scaling.StandardScaler, scaling.MinMaxScaler, scaling.RobustScaler):
        s = make(["a", "b"]).fit(rows)
        assert [round(r.a, 9) for r in s.inverse_transform(s.transform(rows)).collect()] == [1, 2, 4, 9]
        assert {r.b for r in s.transform(rows).collect()} == {0.0}
    both = scaling.ScalerPipeline([("w", scaling.Winsorizer(["a"], lower=0.0, upper=0.5)), ("s", scaling.StandardScaler(["a"]))]).fit(rows)
    assert max(r.a for r in both.transform(rows).collect()) < 1


def test_quality_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "k long, t date, v double")
    rules = [quality.not_empty(), quality.unique(["k"], rows), quality.fresh("t", d("2024-01-01"), 30), quality.in_range("v", 0, 1)]
    got = {r.rule: r.status for r in quality.check(rows, rules).collect()}
    assert got == {"not_empty": "FAILED", "unique:k": "PASSED", "fresh:t": "FAILED", "in_range:v": "PASSED"}
    assert quality.summary(quality.check(rows, rules)).first().overall == "BLOCKED"


def test_vintages_are_immutable_and_honest(spark, tmp_path):
    store = vintage.VintageStore(spark, str(tmp_path))
    one = series(spark, [("a", "2024-01-01", 1.0)])
    assert store.dates("s") == [] and store.latest("s") is None
    store.write(one, "s", d("2024-02-01"), provenance={"generated_by": "test"})
    store.write(one.withColumn("value", F.lit(2.0)), "s", d("2024-03-01"))
    with pytest.raises(Exception):
        store.write(one, "s", d("2024-02-01"))
    store.write(one.withColumn("value", F.lit(9.0)), "s", d("2024-02-01"), if_exists="ignore")
    assert store.as_of("s", d("2024-02-15")) == d("2024-02-01") and store.as_of("s", d("2024-01-15")) is None
    assert store.load_as_of("s", d("2024-02-15")).first().value == 1.0
    with pytest.raises(ValueError):
        store.write(one.limit(0), "s", d("2024-04-01"))
    state, used = store.state(["s", "none"], d("2024-12-01"))
    assert used == {"s": d("2024-03-01")} and state["s"].first().value == 2.0
    assert vintage.honesty(one, "ts", d("2024-02-01"), d("2024-01-15")).first().honest is False


def test_fingerprint_ignores_order(spark):
    rows = spark.range(100).withColumn("v", F.col("id") * 2)
    assert vintage.fingerprint(rows).first() == vintage.fingerprint(rows.orderBy(F.desc("id"))).first()
    assert vintage.fingerprint(rows).first() != vintage.fingerprint(rows.limit(99)).first()


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0), (4.0, 2.0)], "y double, f double")
    got = rows.agg(metrics.rmse("y", "f").alias("a"), metrics.mae("y", "f").alias("b"), metrics.smape("y", "f").alias("c")).first()
    assert math.isclose(got.a, math.sqrt(5 / 3)) and got.b == 1.0 and math.isclose(got.c, 100 * (2 / 3 + 0 + 2 / 3) / 3)


def test_crps_of_a_sure_forecast(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 1.0)], "y double, m double, s double")
    assert math.isclose(rows.select(metrics.crps_normal("y", "m", "s")).first()[0], 2 / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi), rel_tol=1e-9)


def test_folds_never_train_on_their_test():
    for end, a, b in metrics.expanding_folds(40, 24, 3, 4, gap=2):
        assert end <= a - 2 and b <= 40


def test_turns_without_turns_score_full(spark):
    rows = spark.createDataFrame([("a", k, float(k), 0.0) for k in range(5)], "s string, k int, y double, f double")
    assert metrics.turning_point_accuracy(rows, "s", "k", "y", "f").first().accuracy == 100.0


def test_decomposition_adds_up(spark):
    rows = [("a", datetime.date(2015 + k // 12, k % 12 + 1, 1), 100 + k + 10 * math.sin(k * math.pi / 6)) for k in range(72)]
    parts = seasonal.decompose(spark.createDataFrame(rows, "series string, month date, value double"))
    assert all(math.isclose(r.original, r.trend + r.seasonal + r.irregular, abs_tol=1e-9) for r in parts.collect())
    stats = seasonal.m_statistics(parts).first()
    assert stats.n == 72 and stats.m8 is not None
    assert seasonal.ljung_box(parts).first().lags == 10


@pytest.mark.parametrize(("x", "df", "want"), [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (12.591587243743977, 6, 0.05), (11.070497693516351, 5, 0.05)])
def test_chi_square_tail(spark, x, df, want):
    got = spark.range(1).select(seasonal.chi2_upper(F.lit(x), F.lit(df))).first()[0]
    assert math.isclose(got, want, abs_tol=1e-6)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.floats(-1, 1), min_size=4, max_size=4), min_size=8, max_size=30))
def test_minimum_trace_is_coherent_and_idempotent(rows):
    w = np.cov(np.array(rows).T) + 0.1 * np.eye(4)
    p = reconcile.projection(w)
    out = p @ np.array([10.0, 1.0, 2.0, 3.0])
    assert math.isclose(out[0], out[1:].sum(), abs_tol=1e-8) and np.allclose(p @ p, p, atol=1e-8)


def test_reconcile_keeps_what_is_coherent(spark):
    rows = spark.createDataFrame([(3.0, 1.0, 2.0), (7.0, 3.0, 4.0)], "t double, a double, b double")
    errors = spark.createDataFrame([(0.1, 0.2, -0.1), (0.3, -0.2, 0.4), (-0.1, 0.1, 0.2)], "t double, a double, b double")
    for method in ("ols", "wls", "mint_sample", "mint_shrink"):
        assert [tuple(round(x, 8) for x in r) for r in reconcile.reconcile(rows, errors, "t", ["a", "b"], method).collect()] == [(3, 1, 2), (7, 3, 4)]


def test_conformal_covers(spark):
    rows = spark.createDataFrame([(float(k % 10), 0.0) for k in range(100)], "y double, f double")
    inside = calibrate.conformal_intervals(rows, rows, "y", "f", 0.9).agg(metrics.coverage("y", "low", "high")).first()[0]
    assert inside >= 90


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=4, max_size=4))
def test_rising_quantiles(spark, values):
    names = ["a", "b", "c", "e"]
    got = list(spark.createDataFrame([tuple(values)], ", ".join(f"{n} double" for n in names)).select(*calibrate.rising(names)).first())
    assert all(x <= y + 1e-9 for x, y in zip(got, got[1:], strict=False)) and math.isclose(sum(got), sum(values), abs_tol=1e-6)


def test_simplex_weights_find_the_best(spark):
    rows = spark.createDataFrame([(float(k), float(k), float(-k)) for k in range(1, 20)], "y double, good double, bad double")
    w = calibrate.simplex_weights(rows, "y", ["good", "bad"])
    assert w["good"] > 0.99 and math.isclose(sum(w.values()), 1, abs_tol=1e-9)


def test_ridge_finds_a_line(spark):
    rows = spark.createDataFrame([(float(k), 3.0 * k + 1) for k in range(20)], "x double, y double")
    m = models.ridge(rows, ["x"], "y", penalty=0.0)
    assert math.isclose(m.weights[0], 3, abs_tol=1e-6) and math.isclose(m.intercept, 1, abs_tol=1e-5)


def test_registry_versions_and_search(spark):
    none = spark.createDataFrame([], "name string, vintage_date string, version int, status string")
    one = registry.register(none, spark.createDataFrame([("f", "2024-01-01", 0, "active")], none.schema))
    two = registry.register(one, spark.createDataFrame([("f", "2024-02-01", 0, "active")], none.schema))
    assert sorted(r.version for r in two.collect()) == [1, 2]
    assert registry.search(two, name="f", limit=1).count() == 1
    with pytest.raises(ValueError):
        registry.search(two, owner="x")


def test_lineage_stops_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert {(r.node, r.ancestor) for r in registry.ancestors(spark, edges).collect()} == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")}


def test_shocks_apply_in_order(spark):
    base = spark.createDataFrame([("f", 10.0)], "feature string, value double")
    shocks = spark.createDataFrame([("s", "f", 2, "multiply", 2.0), ("s", "f", 1, "add", 1.0)], "scenario string, feature string, seq int, op string, amount double")
    assert scenario.shocked(shocks, base).first().shocked == 22.0


def test_probability_problems(spark):
    bins = [payload.Bin("a", None, 0.0), payload.Bin("b", 0.0, None)]
    rows = spark.createDataFrame([({"a": 0.5, "b": 0.5},), ({"a": 0.5},), ({"a": 2.0, "b": -1.0},)], "p map<string,double>")
    assert [r[0] for r in rows.select(payload.problems(F.col("p"), bins)).collect()] == [[], ["missing", "sum"], ["range"]]
    assert rows.select(payload.bin_label(F.lit(0.0), bins)).first()[0] == "b"


def test_damage_and_sizes(spark):
    rows = spark.createDataFrame([("10.5K", 0.0), ("2M", 100.0), ("1B", 101.0), ("x", None), (None, 10_001.0)], "t string, w double")
    assert [tuple(r) for r in rows.select(transforms.damage_millions(F.col("t")), transforms.size_class(F.col("w"))).collect()] == [(0.0105, None), (2.0, "small"), (1000.0, "medium"), (0.0, None), (0.0, "major")]


def test_series_replies(spark, tmp_path):
    (tmp_path / "reply.json").write_text('{"Results": {"series": [{"seriesID": "CES0000000003", "data": [{"year": "2024", "period": "M01", "periodName": "January", "value": "5.5", "footnotes": [{"code": "P", "text": "Preliminary"}]}, {"year": "2024", "period": "M13", "periodName": "Annual", "value": "-", "footnotes": [{}]}]}]}}')
    got = transforms.employment(readers.read_series_replies(spark, str(tmp_path))).collect()
    assert [(r.series_id, r.date, r.value, r.unit, r.is_preliminary) for r in got] == [("CES0000000003", d("2024-01-01"), 5.5, "dollars", True)]


def test_row_arrays(spark, tmp_path):
    (tmp_path / "x.json").write_text('[["time", "n"], ["2024-01", "5"], ["2024-02", null]]')
    assert [tuple(r) for r in readers.read_row_arrays(spark, str(tmp_path), ["n", "time"]).collect()] == [("5", "2024-01"), (None, "2024-02")]


def pages(k):
    if k == 2:
        raise OSError("gone")
    return [(k, f"row {k}")]


def test_paged_source_ends_at_a_late_failure(spark):
    spark.sparkContext.addPyFile(__file__)
    spark.dataSource.register(readers.PagedSource)
    got = spark.read.format("paged").options(fetch="test_operators:pages", pages="3", columns="k long, v string").load()
    assert sorted(r.k for r in got.collect()) == [0, 1]


def test_stream_writes_batches(spark, tmp_path):
    from tidewater.streaming.observations import read_folder, write_vintages

    rows = series(spark, [("a", "2024-01-01", 1.0)])
    rows.write.parquet(str(tmp_path / "in"))
    q = write_vintages(read_folder(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), "s", d("2024-03-01"), str(tmp_path / "cp"))
    q.awaitTermination()
    from tidewater.operators.vintage import VintageStore

    store = VintageStore(spark, str(tmp_path / "out"))
    assert store.dates("s") == [d("2024-03-01")] and store.load("s", d("2024-03-01")).count() == 1


def test_degradation_names_each_measure_once(spark):
    rows = [("a", k, 0.5, 0.5, 0.5, 0.5 + 0.2 * k) for k in range(6)] + [("b", k, 0.5, 0.5, 0.5, 0.5) for k in range(6)]
    got = {r.series: r for r in seasonal.degradation(spark.createDataFrame(rows, "series string, run int, m7 double, m8 double, m9 double, q double")).collect()}
    assert (got["a"].breached, got["a"].rising, got["a"].degrading) == (["q"], ["q"], True)
    assert (got["b"].breached, got["b"].rising, got["b"].degrading) == ([], [], False)


def test_not_found_is_not_tried_again(tmp_path):
    import urllib.error

    from tidewater.sources import landing

    calls = []

    def opener(request):
        calls.append(request.full_url)
        raise urllib.error.HTTPError(request.full_url, 404, "gone", None, None)

    with pytest.raises(urllib.error.HTTPError):
        landing.fetch("http://x/y", str(tmp_path / "f"), params={"a": "b"}, delay=0, opener=opener)
    assert calls == ["http://x/y?a=b"]
    assert [len(b) for b in landing.batches([str(k) for k in range(60)], None)] == [25, 25, 10]


def test_schemas_conform_and_tell_drift(spark):
    from tidewater.sources import schemas

    rows = spark.createDataFrame([("2024-01-06", "CA", "x", 5)], "report_date string, state_code string, initial_claims string, odd int")
    got = schemas.conform(rows, "claims").first()
    assert (got.report_date, got.initial_claims, got.continued_claims) == (d("2024-01-06"), None, None)
    assert schemas.drift(rows, "claims")["new"] == ["odd"] and "initial_claims" in schemas.drift(rows, "claims")["changed"]


def test_provenance_and_reports(spark):
    rows = readers.synthetic(spark.range(3), "fallback")
    assert quality.provenance(rows).first().suspect and not quality.provenance(spark.range(3)).first().suspect
    results = quality.check(spark.range(3), [quality.not_empty()])
    assert "not_empty" in quality.as_csv(results) and "<table>" in quality.as_html(results, "x")


def test_stability():
    assert models.stable(models.companion([np.eye(2) * 0.5, np.eye(2) * 0.1])) and not models.stable(np.eye(2))


def test_quantile_forest_refits_each_quantile(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor

    fits = []
    small = GBTRegressor.fit

    def fit(self, rows):
        fits.append((self.getMaxIter(), self.getMaxDepth()))
        return small(self.setMaxIter(1).setMaxDepth(1), rows.limit(20))

    monkeypatch.setattr(GBTRegressor, "fit", fit)
    rows = spark.createDataFrame([(float(i % 7), float(i)) for i in range(60)], "x double, y double")
    out = models.predict_quantiles(rows, models.quantile_forest(rows, ["x"], "y"))
    assert fits == [(100, 5)] * 15 and out.columns == ["x", "y", "q_5", "q_10", "q_25", "q_50", "q_75", "q_90", "q_95"] and out.count() == 60


def test_quantile_forecast_is_the_whole_model(spark, monkeypatch):
    from tidewater.operators import boosting
    from tidewater.plans import forecasts

    asked = []
    whole, usual, named = boosting.fit, boosting.fit.__defaults__, boosting.fit.__kwdefaults__

    def fit(df, columns, y, quantiles=usual[0], **how):
        asked.append((len(quantiles), (named | how)["trees"], (named | how)["depth"], df.count()))
        return whole(df, columns, y, quantiles, **{**how, "trees": 2})

    monkeypatch.setattr(forecasts.boosting, "fit", fit)
    out = forecasts.quantile_forecast(spark, "/root/testdata/sf0.001")
    assert out.columns == ["series", "q_5", "q_10", "q_25", "q_50", "q_75", "q_90", "q_95"] and out.count() == 5
    assert asked == [(7, 100, 5, spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count())]
