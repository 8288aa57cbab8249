"""Probability vectors over labelled bins: build, check, score, pack."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bin:
    """[low, high): an open end is None."""

    label: str
    low: float | None = None
    high: float | None = None


def bin_label(value: Column, bins: list[Bin]) -> Column:
    out = F.lit(None).cast("string")
    for b in bins:
        inside = F.lit(True)
        if b.low is not None:
            inside = inside & (value >= b.low)
        if b.high is not None:
            inside = inside & (value < b.high)
        out = F.when(out.isNull() & inside, b.label).otherwise(out)
    return out


def problems(probabilities: Column, bins: list[Bin], tolerance: float = 1e-6) -> Column:
    """Names of what is wrong: labels missing or unknown, values out of [0, 1], a sum off 1."""
    labels = F.array(*[F.lit(b.label) for b in bins])
    keys, values = F.map_keys(probabilities), F.map_values(probabilities)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    found = [F.when(F.size(F.array_except(labels, keys)) > 0, "missing"), F.when(F.size(F.array_except(keys, labels)) > 0, "unknown"), F.when(F.exists(values, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1)), "range"), F.when(F.abs(total - 1) > tolerance, "sum")]
    return F.array_compact(F.array(*found))


def normalised(probabilities: Column, bins: list[Bin]) -> Column:
    """A map of labels to probabilities divided by their sum.

    A label that is missing or unknown, a value that is missing or negative, and a sum
    that is not positive and finite are errors when their row is computed: nothing is
    repaired. A null map stays null.
    """
    total = F.aggregate(F.map_values(probabilities), F.lit(0.0), lambda a, v: a + v)
    wrong = F.array_intersect(problems(probabilities, bins), F.array(F.lit("missing"), F.lit("unknown")))
    negative = F.exists(F.map_values(probabilities), lambda v: v.isNull() | F.isnan(v) | (v < 0))
    bad = (F.size(wrong) > 0) | negative | ~((total > 0) & (total < float("inf")))
    message = F.concat(F.lit("not a probability vector to normalise: "), F.to_json(probabilities))
    values = F.transform_values(probabilities, lambda _, v: (v / total).cast("double"))
    return F.when(probabilities.isNotNull() & F.coalesce(bad, F.lit(True)), F.raise_error(message).cast("map<string,double>")).otherwise(values)


def log_score(probabilities: Column, outcome: Column, bins: list[Bin], tolerance: float = 1e-6) -> Column:
    """Log of the probability given to the outcome, floored at 1e-12; a vector with problems, or an outcome that is no label, is an error when its row is computed."""
    known = F.coalesce(outcome.isin(*[b.label for b in bins]), F.lit(False))
    valid = known & probabilities.isNotNull() & (F.size(problems(probabilities, bins, tolerance)) == 0)
    score = F.log(F.greatest(F.try_element_at(probabilities, outcome), F.lit(1e-12)))
    return F.when(valid, score).otherwise(F.raise_error(F.concat(F.lit("cannot be scored: "), F.coalesce(F.to_json(probabilities), F.lit("null")))).cast("double"))


def from_sample(df: DataFrame, by: str, value: str, bins: list[Bin]) -> DataFrame:
    """(by, probabilities): shares of the bins among a series' values."""
    label = bin_label(F.col(value), bins)
    counts = df.groupBy(by).agg(F.count(label).alias("n"), *[F.count_if(label == b.label).alias(f"b{k}") for k, b in enumerate(bins)])
    return counts.select(by, F.create_map(*[x for k, b in enumerate(bins) for x in (F.lit(b.label), F.try_divide(F.col(f"b{k}").cast("double"), F.col("n")))]).alias("probabilities"))


def payload(event: Column, probabilities: Column) -> Column:
    """JSON with keys in order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(probabilities)))
    return F.to_json(F.struct(event.alias("event_id"), ordered.alias("probabilities")))


def sign(message: str, secret: bytes) -> str:
    return hmac.new(secret, message.encode(), hashlib.sha256).hexdigest()


def offset_days(text: Column) -> Column:
    """Days of an offset like T-5d or T+2d."""
    return F.regexp_extract(text, r"^T([+-]\d+)d$", 1).try_cast("int")


def next_windows(windows: DataFrame, at: Column, event: str = "event_date", by: str = "subnet_id") -> DataFrame:
    """The window of each ``by`` that is open or opens next at a day: not yet closed, the one that opens first (or is open), then the first event."""
    d = at.cast("date")
    dated = windows.withColumn("opens_on", F.date_add(event, offset_days(F.col("opens")))).withColumn("closes_on", F.date_add(event, offset_days(F.col("closes")))).where(F.col("closes_on") > d)
    rest = [c for c in dated.columns if c != by]
    first = F.min(F.struct(F.greatest("opens_on", d).alias("from"), *rest))
    return dated.groupBy(by).agg(first.alias("row")).select(by, *[F.col(f"row.{c}") for c in rest])


def open_windows(windows: DataFrame, at: Column, event: str = "event_date") -> DataFrame:
    """Windows (event_date, opens, closes as offsets) that are open at a day: from opening on, before closing."""
    d = at.cast("date")
    return windows.withColumn("opens_on", F.date_add(event, offset_days(F.col("opens")))).withColumn("closes_on", F.date_add(event, offset_days(F.col("closes")))).where((F.col("opens_on") <= d) & (d < F.col("closes_on")))
