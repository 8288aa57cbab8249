"""The registry of models and the mixed-frequency forecast."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import mixed, model_registry
from tidewater.plans.mixed import mixed_rows

DATA = "/root/testdata/sf0.001"
MODEL = "name string, version int, uri string, stage string, features array<string>, tags map<string, string>"


def test_promotion_errors_and_links(spark):
    table = spark.createDataFrame([("m", 1, "a", "Production", ["x", "x"], {}), ("m", 2, "b", "None", None, {})], MODEL)
    change = lambda *row: spark.createDataFrame([row], "name string, version int, stage string")
    with pytest.raises(ValueError, match="no such stage"):
        model_registry.promote(table, change("m", 1, "Live"))
    with pytest.raises(ValueError, match="no such version"):
        model_registry.promote(table, change("m", 9, "Staging"))
    kept = model_registry.promote(table, change("m", 2, "Production"))
    assert {r["version"]: r["stage"] for r in kept.collect()} == {1: "Production", 2: "Production"}
    assert model_registry.in_stage(kept, "Production").first()["version"] == 2
    linked = model_registry.link_features(table, spark.createDataFrame([("m", 2, ["y"])], "name string, version int, features array<string>"))
    assert sorted((r["feature"], r["version"]) for r in model_registry.uses(linked).collect()) == [("x", 1), ("y", 2)]


def test_versions_of_one_call_follow_each_other(spark):
    none = spark.createDataFrame([], MODEL)
    rows = spark.createDataFrame([("m", "b", None, {}), ("m", "a", ["x"], {}), ("n", "c", ["x"], {})], "name string, uri string, features array<string>, tags map<string, string>")
    got = {(r["name"], r["uri"]): (r["version"], r["features"]) for r in model_registry.register(none, rows).collect()}
    assert got == {("m", "a"): (1, ["x"]), ("m", "b"): (2, []), ("n", "c"): (1, ["x"])}


def test_half_width(spark):
    rows = spark.createDataFrame([(0, 0, 1.0, 2.0), (31, None, 0.0, 2.0), (62, 62, 0.0, 50.0), (None, None, 0.0, 0.0), (-5, None, None, 9.0)], "a int, b int, low double, high double")
    assert [r[0] for r in rows.select(mixed.half_width(3.0, ["a", "b"], "low", "high")).collect()] == [3.0, 6.0, 25.0, 3.0, 3.0]
    assert rows.select(mixed.half_width(0.1, [])).first()[0] == 0.5


def test_mixed_forecast(spark):
    rows, groups, recency = mixed_rows(spark, DATA)
    rows = rows.cache()
    fitted = mixed.fit(rows, groups, "y", optimise=True, trees=3, depth=2)
    assert sum(fitted.weights.values()) == pytest.approx(1) and min(fitted.weights.values()) >= 0
    out = fitted.predict(rows, recency).cache()
    row = out.agg(F.count("*").alias("n"), F.count("forecast").alias("there"), F.min(F.col("high") - F.col("low")).alias("least"), F.stddev_pop(F.col("y") - F.col("forecast")).alias("off"), F.stddev_pop("y").alias("own")).first()
    assert row["n"] == row["there"] == rows.count()
    assert row["off"] == pytest.approx(fitted.scale)
    assert row["least"] >= 2 * fitted.scale * (1 - 1e-9)
    assert row["off"] < row["own"]
    with pytest.raises(ValueError, match="gaps"):
        mixed.fit(rows.withColumn("y", F.lit(None).cast("double")), groups, "y")
