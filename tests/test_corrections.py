"""Regressors of dated events, interval widths, probability vectors, scenarios and covariances against plain definitions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import metrics, payload, reconcile, scenario, seasonal

MONTHS = [datetime.date(2024, m, 1) for m in range(1, 9)]


def effects(spark, events, **how):
    months = spark.createDataFrame([(m,) for m in MONTHS for _ in range(2)], "month date")  # a panel repeats its months
    found = seasonal.month_regressors(months, spark.createDataFrame(events, "date date, until date"), **how).collect()
    assert len(found) == 16
    return [e for _, e in sorted({(r.month, r.effect) for r in found})]


def test_regressors_follow_dates(spark):
    d = lambda m, day: datetime.date(2024, m, day)
    assert effects(spark, [(d(3, 12), None), (d(6, 1), None)]) == [0, 0, 1, 0, 0, 1, 0, 0]
    assert effects(spark, [(d(3, 12), None), (None, None)], duration=3) == [0, 0, 1, 1, 1, 0, 0, 0]
    assert effects(spark, [(d(3, 12), None)], kind="step") == [0, 0, 0, 1, 1, 1, 1, 1]
    assert effects(spark, [(d(3, 1), None)], kind="step", before=2.0, after=5.0) == [2, 2, 5, 5, 5, 5, 5, 5]
    assert effects(spark, [(d(2, 20), d(6, 10))], kind="ramp", end="until") == [0, 0, 0, pytest.approx(1 / 3), pytest.approx(2 / 3), 1, 1, 1]
    assert effects(spark, [(d(3, 20), d(4, 10))], kind="ramp", end="until", before=1.0, after=9.0) == [1, 1, 1, 9, 9, 9, 9, 9]
    assert effects(spark, [(d(3, 2), d(3, 20))], kind="ramp", end="until") == [0, 0, 0, 1, 1, 1, 1, 1]
    assert effects(spark, [(None, None)], kind="step") == [0] * 8


def test_interval_sharpness(spark):
    rows = [("a", 0.0, 4.0), ("a", 1.0, 2.0), ("a", 0.0, 3.0), ("a", None, 9.0), (None, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, low double, high double")
    got = {r.k: tuple(r)[1:] for r in metrics.interval_sharpness(df, "low", "high", ["k"]).collect()}
    w = np.array([4.0, 1.0, 3.0])
    assert got["a"] == pytest.approx((3, w.mean(), 3.0, w.std(), 1.0, 4.0, w.std() / w.mean()))
    assert got[None] == pytest.approx((1, 0, 0, 0, 0, 0, 0))
    assert metrics.interval_sharpness(df, "low", "high").first().median_width == 2.0
    with pytest.raises(Exception, match="ends before it begins"):
        metrics.interval_sharpness(spark.createDataFrame([("a", 2.0, 1.0)], df.schema), "low", "high", ["k"]).collect()


BINS = [payload.Bin("a", None, 0.0), payload.Bin("b", 0.0, None)]


def test_vectors_are_normalised_or_refused(spark):
    def of(p):
        df = spark.createDataFrame([(p,)], "p map<string,double>")
        return df.select(payload.normalised(F.col("p"), BINS)).first()[0]

    assert of({"a": 1.0, "b": 3.0}) == {"a": 0.25, "b": 0.75} and of(None) is None
    for bad in ({"a": -0.5, "b": 1.5}, {"a": 1.0}, {"a": 1.0, "b": 0.0, "c": 0.0}, {"a": 0.0, "b": 0.0}, {"a": None, "b": 1.0}, {"a": float("nan"), "b": 1.0}, {"a": float("inf"), "b": 1.0}, {}):
        with pytest.raises(Exception, match="not a probability vector"):
            of(bad)
    score = lambda p, o: spark.createDataFrame([(p, o)], "p map<string,double>, o string").select(payload.log_score(F.col("p"), F.col("o"), BINS)).first()[0]
    assert score({"a": 0.25, "b": 0.75}, "a") == pytest.approx(np.log(0.25)) and score({"a": 0.0, "b": 1.0}, "a") == pytest.approx(np.log(1e-12))
    for p, o in (({"a": 0.5, "b": 0.6}, "a"), ({"a": 1.0, "b": 0.0}, "c"), (None, "a"), ({"a": 1.0, "b": 0.0}, None)):
        with pytest.raises(Exception, match="cannot be scored"):
            score(p, o)


def test_scenarios_ignore_what_does_not_change(spark):
    base = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "feature string, value double")
    shocks = spark.createDataFrame([("s", "x", 1, "add", 0.0), ("s", "y", 1, "add", 3.0), ("t", "x", 1, "set", 5.0)], "scenario string, feature string, seq int, op string, amount double")
    none = spark.createDataFrame([("y", 2.0)], "feature string, sensitivity double")
    got = {r.scenario: (r.delta, r.unknown) for r in scenario.evaluate(scenario.shocked(shocks, base), none, 10.0).collect()}
    assert got == {"s": (6.0, 0), "t": (0.0, 1)}
    for op in ("divide", None):
        with pytest.raises(Exception, match="unknown operation"):
            scenario.shocked(spark.createDataFrame([("s", "x", 1, op, 1.0)], shocks.schema), base).collect()


@pytest.mark.parametrize("n", [4, 60])
def test_covariance_is_shrunk_as_published(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + 100
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double").repartition(3)
    z = x - x.mean(0)
    e = z.T @ z / n
    m = np.trace(e) / 4
    apart = ((e - m * np.eye(4)) ** 2).sum()
    noise = sum(((np.outer(r, r) - e) ** 2).sum() for r in z) / n**2
    weight = min(noise, apart) / apart
    got, w = reconcile.shrunk(df, list("abcd"))
    assert np.isclose(w, weight) and np.allclose(got, (1 - weight) * e + weight * m * np.eye(4))


def test_weights_precision_and_fallback(spark):
    assert reconcile.check_weights(np.diag([1.0, 2.0]))[0] and reconcile.check_weights(np.array([[2.0, 1.0], [1.0, 2.0]]))[0]
    for bad in (np.ones((2, 3)), np.diag([1.0, 0.0]), np.array([[1.0, 0.5], [0.2, 1.0]]), np.array([[1.0, 2.0], [2.0, 1.0]])):
        assert not reconcile.check_weights(bad)[0]
    w = np.array([[2.0, 1.0], [1.0, 2.0]])
    assert np.allclose(reconcile.precision(w) @ w, np.eye(2))
    with pytest.raises(ValueError):
        reconcile.precision(np.zeros((2, 2)))
    assert np.allclose(reconcile.precision(np.zeros((2, 2)), 0.5), 2 * np.eye(2))
    p = reconcile.projection(np.zeros((3, 3)))
    assert np.allclose(p @ np.array([10.0, 2.0, 4.0]), [10.0, 4.0, 6.0])
    rows = spark.createDataFrame([(10.0, 2.0, 4.0)], "t double, a double, b double")
    assert [round(x, 6) for x in reconcile.reconcile(rows, None, "t", ["a", "b"], weights=np.diag([1e-9 + 1, 1, 2])).first()] == [9.0, 3.0, 6.0]
    with pytest.raises(ValueError):
        reconcile.reconcile(rows, None, "t", ["a", "b"], weights=np.diag([1.0, 2.0]))


def test_reports_and_stability(spark):
    text = "M 1: 0.5\nM11=1.25\nQ = 0.7\nLjung-Box Q (12): 3.5 p-value = 0.04\nStable seasonality test F = 9. p-value=0.001\nTrading day test F: 2 p-value: 0.5"
    df = spark.createDataFrame([(text,), ("nothing",), (None,)], "report string")
    got = seasonal.parse_reports(df, "report").collect()
    assert (got[0].m1, got[0].m11, got[0].m2, got[0].q, got[0].ljung_box_lag, got[0].ljung_box_q, got[0].ljung_box_pvalue) == (0.5, 1.25, None, 0.7, 12, 3.5, 0.04)
    assert (got[0].stable_seasonality_f, got[0].stable_seasonality_pvalue, got[0].seasonality_f, got[0].trading_day_f, got[0].trading_day_significant) == (9.0, 0.001, None, 2.0, False)
    assert all(r[c] is None for r in got[1:] for c in seasonal.REPORT)
    rows = [("a", d, v) for d, v in enumerate([5.0, 1.0, None, 1.1, 1.3])] + [("one", 1, 1.0), ("two", 1, None), ("two", 2, 3.0)]
    history = spark.createDataFrame(rows, "series string, ts int, q double")
    found = {r.series: r for r in seasonal.stability(history, window=4).collect()}
    assert set(found) == {"a", "two"}
    a = found["a"]
    assert (a.observations, a.current, a.stable, a.degrading) == (4, 1.3, True, True) and a.slope == pytest.approx(np.polyfit(range(3), [1.0, 1.1, 1.3], 1)[0])
    assert (found["two"].slope, found["two"].current, found["two"].stable, found["two"].std) == (0.0, 3.0, False, None)
    grades = {(r.series, r.measure): (r.grade, round(r.score, 3), r.problem) for r in seasonal.measure_grades(spark.createDataFrame([("s", 0.6, 2.5, None, 4.0)], "series string, m1 double, m2 double, m3 double, m4 double")).collect()}
    assert grades == {("s", "m1"): ("good", 80.0, False), ("s", "m2"): ("warning", 16.667, True), ("s", "m4"): ("fail", 0.0, False)}
