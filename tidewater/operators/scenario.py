"""Scenarios: shocks on features, weighed by sensitivities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shocked(shocks: DataFrame, baseline: DataFrame) -> DataFrame:
    """(scenario, feature, base, shocked): shocks (scenario, feature, seq, op, amount) on one feature apply in order of ``seq``.

    ``op``: add, multiply, or set. A shock on a feature without a baseline is an
    error when its row is computed, and so is an unknown ``op``.
    """
    steps = shocks.groupBy("scenario", "feature").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "amount"))).alias("steps"))
    after = F.aggregate("steps", F.col("base"), lambda v, s: F.when(s["op"] == "add", v + s["amount"]).when(s["op"] == "multiply", v * s["amount"]).when(s["op"] == "set", s["amount"]).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(s["op"], F.lit("null")))).cast("double")))
    known = F.coalesce(F.col("base"), F.raise_error(F.concat(F.lit("no baseline for "), F.col("feature"))).cast("double"))
    return steps.join(baseline.select("feature", F.col("value").cast("double").alias("base")), "feature", "left").withColumn("base", known).select("scenario", "feature", "base", after.alias("shocked"))


def evaluate(changes: DataFrame, sensitivities: DataFrame, baseline_forecast: float, material: float = 0.05) -> DataFrame:
    """(scenario, delta, forecast, direction, material, unknown): delta is the sum of changes times sensitivities; ``unknown`` counts changed features without a sensitivity, which add nothing."""
    effect = F.coalesce((F.col("shocked") - F.col("base")) * F.col("sensitivity"), F.lit(0.0))
    delta = changes.join(sensitivities, "feature", "left").groupBy("scenario").agg(F.sum(effect).alias("delta"), F.count_if(F.col("sensitivity").isNull() & (F.col("shocked") != F.col("base"))).alias("unknown"))
    d = F.col("delta")
    return delta.select("scenario", "unknown", "delta", (d + baseline_forecast).alias("forecast"), F.when(d > 0, "up").when(d < 0, "down").otherwise("flat").alias("direction"), (F.abs(d) > material * abs(baseline_forecast)).alias("material"))
