"""Pooling, folds, keyed tables and lineage findings against plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import artifact_lineage, folds, isotonic, metrics, scaling
from tidewater.sources.keyed_table import KeyedTable


def plain_isotonic(x, y, w):
    order = np.argsort(x, kind="stable")
    values = {}
    for i in order:
        a = values.setdefault(x[i], [0.0, 0.0])
        a[0] += w[i]
        a[1] += w[i] * y[i]
    at = sorted(values)
    n, t = np.array([values[v][0] for v in at]), np.array([values[v][1] for v in at])
    mean = lambda a, b: t[a : b + 1].sum() / n[a : b + 1].sum()
    k = len(at)
    return at, [max(min(mean(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)]


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "ties"])
def test_pools_equal_the_plain_fit(spark, shape):
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(size=150), 3)
    y = {"noise": rng.integers(0, 2, 150).astype(float), "rising": x**2, "falling": -x, "ties": np.floor(x * 3)}[shape]
    w = rng.integers(1, 4, 150).astype(float)
    rows = [*zip(x.tolist(), y.tolist(), w.tolist(), strict=True), (None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (0.5, None, 1.0), (0.5, 100.0, 0.0)]
    df = spark.createDataFrame(rows, "p double, y double, w double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges even of so few rows
    try:
        found = isotonic.pools(df, "p", "y", "w")
        got = found.orderBy("low").collect()
        at, want = plain_isotonic(x, y, w)
        assert all(a.value < b.value and a.high < b.low for a, b in zip(got, got[1:], strict=False))
        assert np.allclose([next(r.value for r in got if r.low <= v <= r.high) for v in at], want)
        bounds, values = [v for r in got for v in (r.low, r.high)], [r.value for r in got for _ in range(2)]
        asked = [*np.linspace(-0.2, 1.2, 57).tolist(), *map(float, at[:5]), None, float("nan")]
        out = isotonic.apply(spark.createDataFrame([(i, v, "kept") for i, v in enumerate(asked)], "i int, p double, x string"), found, "p", "q").collect()
        assert len(out) == len(asked) and all(r.x == "kept" for r in out)
        for r in out:
            v = asked[r.i]
            assert r.q is None if v is None or v != v else np.isclose(r.q, np.interp(v, bounds, values))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_rows_to_pool(spark):
    none = spark.createDataFrame([], "p double, y double")
    assert isotonic.pools(none, "p", "y").count() == 0
    some = spark.createDataFrame([(0.5, 1.0)], "p double, y double")
    assert [r.q for r in isotonic.apply(some, isotonic.pools(none, "p", "y"), "p", "q").collect()] == [None]
    assert isotonic.apply(none, isotonic.pools(some, "p", "y"), "p", "q").count() == 0


@pytest.mark.parametrize("how", [{"initial": 10, "step": 4, "horizon": 3, "gap": 1}, {"initial": 8, "step": 2, "horizon": 5}])
def test_folds_equal_fits_one_by_one(spark, how):
    rng = np.random.default_rng(6)
    data, rows = {}, []
    for s, n in (("a", 40), ("b", 23), ("short", 9)):
        x = rng.normal(size=(n, 2)) + 50
        y = x @ np.array([1.0, -2.0]) + rng.normal(size=n)
        x[::7, 0] = np.nan
        data[s] = (x, y)
        rows += [(s, i, None if x[i, 0] != x[i, 0] else float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, t int, u double, v double, y double").repartition(3)
    got = {(r.k, r.fold): r.rmse for r in folds.cross_validate_linear(df, "k", "t", ["u", "v"], "y", {"rmse": metrics.rmse("y", "f")}, penalty=0.5, **how).collect()}
    want = {}
    for s, (x, y) in data.items():
        for fold, (end, a, b) in enumerate(metrics.expanding_folds(len(y), how["initial"], how["step"], how["horizon"], how.get("gap", 0))):
            train = np.flatnonzero(~np.isnan(x[:end, 0]))
            test = [i for i in range(a, b) if not np.isnan(x[i, 0])]
            z, m = x[train] - x[train].mean(0), y[train].mean()
            w = np.linalg.solve(z.T @ z + 0.5 * np.eye(2), z.T @ (y[train] - m))
            if test:
                f = m + (x[test] - x[train].mean(0)) @ w
                want[s, fold] = np.sqrt(((y[test] - f) ** 2).mean())
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-6) for k in want)


def test_scores_of_series(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 9.0), ("a", None), ("one", 5.0), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r.k, r.v): (r.z, r.robust) for r in scaling.scores_by_series(df, "k", "v").collect()}
    a = np.array([1.0, 2.0, 9.0])
    spread = np.quantile(a, 0.75) - np.quantile(a, 0.25)
    for v in a:
        assert got["a", v] == pytest.approx(((v - a.mean()) / a.std(ddof=1), (v - 2) / spread))
    assert got["a", None] == (None, None) and got["one", 5.0] == (0.0, 0.0) and got[None, 1.0] == pytest.approx((-1 / np.sqrt(2), -1.0))


def test_keyed_table(spark, tmp_path):
    kept = KeyedTable(spark, f"file://{tmp_path}/t", ["a", "b"], buckets=8)
    rows = lambda *r: spark.createDataFrame(list(r), "a int, b string, v double")
    assert not kept.exists()
    kept.upsert(rows())
    kept.upsert(rows(*[(i, "x", float(i)) for i in range(40)], (None, "x", 1.0), (None, None, 2.0)))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    change = rows((3, "x", 30.0), (3, "x", 31.0), (None, None, 5.0), (99, None, 9.0))
    for _ in range(2):  # a run that is repeated changes nothing
        kept.upsert(change)
        got = {(r.a, r.b): r.v for r in kept.read().collect()}
        assert len(got) == kept.read().count() == 43
        assert (got[3, "x"], got[None, None], got[99, None], got[None, "x"], got[4, "x"]) == (31.0, 5.0, 9.0, 1.0, 4.0)
    after = {p for p in tmp_path.rglob("*.parquet")}
    assert 0 < len([p for p in before if p in after]) < len(before)  # only the partitions of the keys were written
    broken = change.withColumn("v", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        kept.upsert(broken)
    assert {(r.a, r.b): r.v for r in kept.read().collect()} == got


def test_findings_of_odd_artifacts(spark):
    models = spark.createDataFrame([("m", ["x", "x", None], None, None), ("n", None, {"x": "1"}, "v1"), ("o", ["x", "gone"], {"x": "1"}, "v2"), ("p", ["x"], {"x": "7"}, "v2")], "model string, features array<string>, versions map<string,string>, vintage string")
    features = spark.createDataFrame([("x", 1, "v1"), ("x", 2, "v2"), ("base", 1, None)], "name string, version int, vintage string")
    edges = spark.createDataFrame([("x", "base"), ("base", "lost")], "child string, parent string")
    found = artifact_lineage.findings(spark, models, features, edges)
    got = {tuple(r) for r in found.collect()}
    lost = "not registered: lost"
    assert got == {
        *((("lineage_registered", "critical", m, "x", lost)) for m in "mop"),
        ("artifact_features_present", "critical", "n", None, "no features"),
        ("feature_registered", "critical", "o", "gone", "not registered"),
        ("feature_vintage_match", "warning", "o", "x", "artifact v2, feature v1"),
        ("feature_version_match", "critical", "p", "x", "asked 7, found 2"),
        ("artifact_lineage_coverage", "info", "m", None, "1 of 1"),
        ("artifact_lineage_coverage", "critical", "o", None, "1 of 2"),
        ("artifact_lineage_coverage", "info", "p", None, "1 of 1"),
        ("rollback_impact", "warning", None, None, "no rollback was measured"),
    }
    ring = artifact_lineage.findings(spark, models, features.union(spark.createDataFrame([("lost", 1, "v1")], features.schema)), edges.union(spark.createDataFrame([("lost", "base")], edges.schema)))
    assert {r.model for r in ring.where("check = 'lineage_cycle'").collect()} == {"m", "o", "p"}
    assert {r.model: r.passed for r in artifact_lineage.passed(found).collect()} == {"m": False, "n": False, "o": False, "p": False}


def test_metadata_tables_raw_files_and_updates(spark, tmp_path):
    import datetime

    from tidewater.operators import registry
    from tidewater.sources import metadata

    base = f"file://{tmp_path}"
    rows = spark.createDataFrame([("m", "1", True), ("m", "2", False)], "model_name string, model_version string, is_active boolean")
    own = metadata.record(spark, base, "model_registry", rows)
    own = metadata.record(spark, base, "model_registry", rows.where("model_version = '2'").withColumn("is_active", F.lit(True)).withColumn("accuracy_metrics", F.create_map(F.lit("rmse"), F.lit(1.5))))
    got = {r.model_version: (r.is_active, r.accuracy_metrics, r.trained_at) for r in own.read().collect()}
    assert got == {"1": (True, None, None), "2": (True, {"rmse": 1.5}, None)}
    with pytest.raises(ValueError, match="no columns"):
        metadata.record(spark, base, "model_registry", rows.withColumn("odd", F.lit(1)))
    with pytest.raises(Exception, match="needs model_version"):
        metadata.record(spark, base, "model_registry", rows.withColumn("model_version", F.lit(None).cast("string")))
    assert all(set(keys) <= {f.name for f in spark.createDataFrame([], schema).schema} for schema, keys in metadata.TABLES.values()) and len(metadata.TABLES) == 9
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    path = metadata.save_raw(rows, base, "claims", at)
    assert path.endswith("claims_20240102_030405") and metadata.save_raw(rows.limit(1), base, "claims", at) == path and spark.read.parquet(path).count() == 2
    change = spark.createDataFrame([("m", "1", None)], rows.schema)
    assert {r.model_version: r.is_active for r in registry.update(rows, change, ["model_name", "model_version"]).collect()} == {"1": True, "2": False}
    change = spark.createDataFrame([("m", "2", True)], rows.schema)
    assert {r.model_version: r.is_active for r in registry.update(rows, change, ["model_name", "model_version"]).collect()} == {"1": True, "2": True}
    with pytest.raises(KeyError):
        registry.update(rows, spark.createDataFrame([("m", "3", True)], rows.schema), ["model_name", "model_version"])
    with pytest.raises(ValueError):
        registry.update(rows, change.union(change), ["model_name", "model_version"])
    with pytest.raises(ValueError):
        registry.update(rows, change.withColumn("odd", F.lit(1)), ["model_name", "model_version"])
