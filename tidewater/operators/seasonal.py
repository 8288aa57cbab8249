"""Seasonal decomposition and its diagnostics, for any number of monthly series at once.

The decomposition is the classical additive one by centred moving averages. The
diagnostics need components only, wherever they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def decompose(df: DataFrame, *, key: str = "series", ts: str = "month", value: str = "value") -> DataFrame:
    """(key, ts, original, trend, seasonal, irregular, adjusted) of gap-free monthly series.

    The trend is a 2x12 centred mean; at the ends, the mean of what its window has.
    Seasonal factors are means of the detrended months, centred to sum to 0.
    """
    w = Window.partitionBy(key).orderBy(ts)
    outer, inner = w.rowsBetween(-6, 6), w.rowsBetween(-5, 5)
    v = F.col(value).cast("double")
    rows = df.select(key, ts, v.alias("original"))
    o = F.col("original")
    full = F.count(o).over(outer) == 13
    trend = F.when(full, (F.sum(o).over(outer) + F.sum(o).over(inner)) / 24).otherwise(F.avg(o).over(outer))
    rows = rows.withColumn("trend", trend).withColumn("full", full)
    monthly = rows.groupBy(key, F.month(ts).alias("m")).agg(F.coalesce(F.avg(F.when(F.col("full"), o - F.col("trend"))), F.avg(o - F.col("trend"))).alias("raw"))
    factors = monthly.withColumn("seasonal", F.col("raw") - F.avg("raw").over(Window.partitionBy(key))).drop("raw")
    out = rows.withColumn("m", F.month(ts)).join(factors, [key, "m"])
    return out.select(key, ts, "original", "trend", "seasonal", (o - F.col("trend") - F.col("seasonal")).alias("irregular"), (o - F.col("seasonal")).alias("adjusted"))


def m_statistics(parts: DataFrame, *, key: str = "series", ts: str = "month", least: int = 24) -> DataFrame:
    """(key, n, m1 to m11, q, acceptable) from components original, trend, seasonal, irregular, adjusted.

    Where a denominator vanishes a measure has a stated value (m1, m2, m7: 3; m3,
    m9, m10, m11: 0.5; m5: 0). Series of fewer than ``least`` rows, or with nulls, are left out.
    ``acceptable``: q below 2.
    """
    w = Window.partitionBy(key).orderBy(ts)
    every = Window.partitionBy(key)
    near = w.rowsBetween(-1, 1)
    centred = lambda c: F.when(F.count(c).over(near) == 3, F.avg(c).over(near))
    step = lambda c: F.col(c) - F.lag(c).over(w)
    rows = parts.withColumns({"at": F.row_number().over(w) - 1, "n": F.count("*").over(every), "i3": centred("irregular"), "t3": centred("trend"), "lag_i": F.lag("irregular").over(w)})
    rows = rows.where(F.col("n") >= least)
    i, n, at = F.col("irregular"), F.col("n"), F.col("at")
    above = i > F.avg(i).over(every)
    rows = rows.withColumns({"di3": F.abs(step("i3")), "dt3": F.abs(step("t3")), "d_o": step("original"), "d_i": step("irregular"), "d_t": step("trend"), "above": above})
    rows = rows.withColumn("run", F.when(F.lag("above").over(w).eqNullSafe(F.col("above")), 0).otherwise(1))
    half, early = at < F.floor(n / 2), at < F.floor(n * 0.75)
    sd = F.stddev_samp
    agg = rows.groupBy(key).agg(
        F.max("n").alias("n"),
        F.avg("di3").alias("di3"),
        F.avg("dt3").alias("dt3"),
        sd("irregular").alias("si"),
        sd("d_o").alias("sdo"),
        sd("d_i").alias("sdi"),
        sd("d_t").alias("sdt"),
        F.corr("irregular", "lag_i").alias("r"),
        F.var_samp(F.when(half, i)).alias("v1"),
        F.var_samp(F.when(~half, i)).alias("v2"),
        F.sum("run").alias("runs"),
        sd("seasonal").alias("ss"),
        F.var_samp("seasonal").alias("vs"),
        sd(F.when(early, F.col("seasonal"))).alias("s_early"),
        sd(F.when(~early, F.col("seasonal"))).alias("s_late"),
        F.regr_slope(F.col("seasonal"), at.cast("double")).alias("slope"),
    )
    yearly = rows.groupBy(key, F.year(ts).alias("y")).agg(F.sum("original").alias("o"), F.sum("adjusted").alias("a")).groupBy(key).agg((10 * F.avg(F.abs(F.col("o") - F.col("a")) / (F.abs("o") + 1e-10))).alias("m8"))
    monthly = rows.groupBy(key, F.month(ts).alias("m")).agg(F.var_samp("seasonal").alias("v")).groupBy(key).agg(F.avg("v").alias("v_month"))
    d = F.try_divide

    def over(top: Column, bottom: Column, least: float, instead: float | Column) -> Column:
        return F.when(bottom < least, instead).otherwise(d(top, bottom))

    out = agg.join(yearly, key).join(monthly, key).select(
        key,
        "n",
        over(F.col("di3"), F.col("dt3"), 1e-10, 3.0).alias("m1"),
        over(F.col("si") * F.sqrt(2 / F.pi()), F.col("sdo"), 1e-10, 3.0).alias("m2"),
        over(F.col("sdi"), F.col("sdt"), 1e-6, over(F.col("sdi"), F.col("si"), 1e-10, 0.5)).alias("m3"),
        (F.abs("r") * F.sqrt(F.col("n").cast("double")) / 3).alias("m4"),
        over(2 * F.abs(F.col("v1") - F.col("v2")), F.col("v1") + F.col("v2"), 1e-10, 0.0).alias("m5"),
        (F.abs(F.col("runs") - F.col("n") / 2) / (F.col("n") / 2)).alias("m6"),
        over(F.col("si"), F.col("ss"), 1e-10, 3.0).alias("m7"),
        "m8",
        over(F.col("v_month"), F.col("vs"), 1e-10, 0.5).alias("m9"),
        F.least(F.lit(3.0), over(2 * F.abs(F.col("s_late") - F.col("s_early")), F.col("s_early"), 1e-10, 0.5)).alias("m10"),
        over(F.abs(12 * F.col("slope")), F.col("ss"), 1e-10, 0.5).alias("m11"),
    )
    total: Column = F.col("m1")
    for k in range(2, 12):
        total = total + F.col(f"m{k}")
    return out.withColumn("q", total / 11).withColumn("acceptable", F.col("q") < 2.0)


def ljung_box(df: DataFrame, *, key: str = "series", ts: str = "month", value: str = "irregular", lags: int = 10) -> DataFrame:
    """(key, n, lags, q, p_value, random): autocorrelation about the series' mean up to min(lags, n / 5); series of under 20 rows are left out."""
    w = Window.partitionBy(key).orderBy(ts)
    every = Window.partitionBy(key)
    x = F.col(value) - F.avg(value).over(every)
    rows = df.select(key, ts, x.alias("x"), F.count(value).over(every).alias("n")).where("n >= 20")
    sums = rows.select(key, "n", (F.col("x") * F.col("x")).alias("p0"), *[(F.col("x") * F.lag("x", k).over(w)).alias(f"p{k}") for k in range(1, lags + 1)]).groupBy(key).agg(F.max("n").alias("n"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"p{k}") for k in range(lags + 1)])
    used = F.least(F.lit(lags), F.floor(F.col("n") / 5)).cast("int")
    terms = [F.when(F.col("used") >= k, F.pow(F.try_divide(F.col(f"p{k}"), F.col("p0")), 2) / (F.col("n") - k)).otherwise(0.0) for k in range(1, lags + 1)]
    total: Column = terms[0]
    for t in terms[1:]:
        total = total + t
    out = sums.withColumn("used", used).withColumn("q", F.col("n") * (F.col("n") + 2) * total)
    out = out.withColumn("p_value", chi2_upper(F.col("q"), F.col("used")))
    return out.select(key, "n", F.col("used").alias("lags"), "q", "p_value", (F.col("p_value") > 0.05).alias("random"))


def chi2_upper(x: Column, df: Column) -> Column:
    """Upper tail of chi square for whole degrees of freedom, by the finite series in closed form.

    Even: exp(-x/2) * sum of (x/2)^i / i!. Odd degrees begin at the error
    function, which Spark lacks; its rational approximation holds to 1.2e-7.
    """
    h = x / 2
    count = F.floor(df / 2).cast("int")
    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    even = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), lambda a, i: F.struct((a["term"] * h / i).alias("term"), (a["sum"] + a["term"]).alias("sum")))["sum"] * F.exp(-h)
    z = F.sqrt(h)
    t = 1 / (1 + 0.5 * z)
    # Coefficients of the approximation of erfc. Fixed values.
    poly = F.lit(0.0)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    first = t * F.exp(-z * z + poly)
    odd = F.aggregate(steps, F.struct((F.sqrt(h) * 2 / F.sqrt(F.pi())).cast(DoubleType()).alias("term"), F.lit(0.0).alias("sum")), lambda a, i: F.struct((a["term"] * h / (i + 0.5)).alias("term"), (a["sum"] + a["term"]).alias("sum")))["sum"] * F.exp(-h) + first
    return F.when(df % 2 == 0, even).otherwise(odd)


def month_regressors(months: DataFrame, events: DataFrame, *, month: str = "month", at: str = "date", kind: str = "impulse", end: str | None = None, duration: int = 1, before: float = 0.0, after: float = 1.0) -> DataFrame:
    """``months`` with ``effect``, of dated events.

    impulse: 1 in an event's month and the ``duration`` - 1 months after it, else 0.
    step: ``before`` in months that begin before the first event's date, then
    ``after``. ramp: ``before`` up to the first event's date, ``after`` past the last
    event's ``end`` (or date); the different months that begin between the two go
    from one to the other in equal steps, a single one has ``after``. Events without
    a date count nowhere; without any event all months have 0, or ``before``.
    """
    if kind not in ("impulse", "step", "ramp"):
        raise ValueError(kind)
    events = events.where(F.col(at).isNotNull())
    if kind == "impulse":
        own = F.explode(F.transform(F.sequence(F.lit(0), F.lit(duration - 1)), lambda k: F.add_months(F.trunc(at, "MM"), k)))
        hit = events.select(own.alias("__m")).distinct().withColumn("effect", F.lit(1.0))
        return months.join(hit, F.trunc(month, "MM") == F.col("__m"), "left").drop("__m").na.fill(0.0, ["effect"])
    bounds = events.agg(F.min(F.col(at).cast("date")).alias("__a"), F.max(F.coalesce(F.col(end or at), F.col(at)).cast("date")).alias("__b"))
    joined = months.join(F.broadcast(bounds))  # one row
    m = F.col(month).cast("date")
    if kind == "step":
        return joined.withColumn("effect", F.when(m >= F.col("__a"), after).otherwise(before)).drop("__a", "__b")
    inside = months.join(F.broadcast(bounds)).where(m.between(F.col("__a"), F.col("__b"))).select(F.col(month).alias("__m")).distinct()
    steps = inside.select("__m", (F.row_number().over(Window.orderBy("__m")) - 1).alias("__i"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("__n"))  # a calendar of months
    share = F.when(F.col("__n") > 1, F.col("__i") / (F.col("__n") - 1)).otherwise(1.0)
    effect = F.when(F.col("__m").isNotNull(), before + (after - before) * share).when(m > F.col("__b"), after).otherwise(before)
    return joined.join(steps, F.col(month) == F.col("__m"), "left").withColumn("effect", effect).drop("__a", "__b", "__m", "__i", "__n")


def strike_impact(events: DataFrame, *, least_workers: int = 10_000, least_days: int = 7, most: float | None = 10.0) -> DataFrame:
    """(month, impact): sum over months covered of workers / 10000, at most ``most`` (None: no cap). Events: start_date, end_date, workers_involved, days_duration.

    An event without an end, or with one before its start, covers the month it starts in.
    Workers are added up before they are divided: whole numbers give exact sums.
    """
    own = events.where((F.col("workers_involved") >= least_workers) & (F.col("days_duration") >= least_days) & F.col("start_date").isNotNull())
    last = F.greatest(F.coalesce("end_date", "start_date"), F.col("start_date"))
    months = own.withColumn("month", F.explode(F.sequence(F.trunc("start_date", "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))))
    impact = F.sum("workers_involved") / 10_000
    return months.groupBy("month").agg((impact if most is None else F.least(F.lit(most), impact)).alias("impact"))


#: Severity of weather by type; others have 1. Fixed values.
SEVERITY = {"Hurricane": 10.0, "Tropical Storm": 5.0, "Blizzard": 8.0, "Ice Storm": 7.0, "Winter Storm": 5.0, "Heavy Snow": 3.0, "Wildfire": 6.0, "Extreme Heat": 2.0, "Tornado": 4.0, "Flood": 4.0, "Flash Flood": 3.0}
#: Types of weather that effects of their own are made of. Fixed values.
HURRICANES, WINTER_STORMS = ("Hurricane",), ("Blizzard", "Ice Storm", "Winter Storm")


def weather_impact(events: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(month, impact): severity of the type times 1 + deaths / 2 + injuries / 10 (at most 5), at most 10 an event and 20 a month, over the largest month.

    Events: event_type, begin_date, deaths, injuries; ``kinds`` keeps some types
    only. Missing casualties count 0; events without a date count nowhere.
    """
    events = events.where(F.col("begin_date").isNotNull())
    events = events.where(F.col("event_type").isin(*kinds)) if kinds else events
    severity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("event_type")), F.lit(1.0))
    casualties = F.coalesce("deaths", F.lit(0)) * 0.5 + F.coalesce("injuries", F.lit(0)) * 0.1
    one = F.least(F.lit(10.0), severity * F.least(F.lit(5.0), 1 + casualties))
    months = events.groupBy(F.trunc("begin_date", "MM").alias("month")).agg(F.least(F.lit(20.0), F.sum(one)).alias("raw"))
    top = months.agg(F.max("raw").alias("__top"))
    return months.join(F.broadcast(top)).select("month", F.try_divide("raw", "__top").alias("impact"))  # one row


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose variance is not 0."""
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


_NUMBER = r"([-+]?\d+\.?\d*)"
#: What a text report of a seasonal adjustment holds, by pattern of its first match; tests have theirs on one line. Fixed values.
REPORT = {
    **{f"m{k}": rf"(?i)\bM\s*{k}\s*[:=]?\s*{_NUMBER}" for k in range(1, 12)},
    "q": rf"(?i)\bQ\s*[:=]\s*{_NUMBER}",
    "ljung_box_lag": r"(?i)Ljung-Box\s+Q\s*\((\d+)\)",
    "ljung_box_q": rf"(?i)Ljung-Box\s+Q\s*\(\d+\)\s*[:=]\s*{_NUMBER}",
    "ljung_box_pvalue": rf"(?i)Ljung-Box\s+Q[^\n]*?p-value\s*[:=]\s*{_NUMBER}",
    **{f"{name}_f": rf"(?i){title}[^\n]*?\bF\s*[:=]\s*{_NUMBER}" for name, title in (("seasonality", r"Combined\s+seasonality\s+test"), ("stable_seasonality", r"Stable\s+seasonality\s+test"), ("trading_day", r"Trading\s+day"))},
    **{f"{name}_pvalue": rf"(?i){title}[^\n]*?p-value\s*[:=]\s*{_NUMBER}" for name, title in (("seasonality", r"Combined\s+seasonality\s+test"), ("stable_seasonality", r"Stable\s+seasonality\s+test"), ("trading_day", r"Trading\s+day"))},
}
#: A test is significant below this p-value. Fixed value.
SIGNIFICANT = 0.05


def parse_reports(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a number for each entry of REPORT, null where the report has none, and whether seasonality and trading days are significant."""
    out = df.withColumns({k: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("double") for k, p in REPORT.items()})
    return out.withColumns({f"{k}_significant": F.col(f"{k}_pvalue") < SIGNIFICANT for k in ("seasonality", "trading_day")})


#: Ends of grades of a single measure, and of Q; the value that scores 0; measures of which a value over 2 is named as a problem. Fixed values.
MEASURE_GRADES = (("good", 1.0), ("acceptable", 2.0), ("warning", 3.0))
Q_GRADES = (("good", 1.0), ("acceptable", 2.0))
SCORED_0, PROBLEMS, PROBLEM_OVER = 3.0, ("m1", "m2", "m3", "m7", "m8", "m9"), 2.0


def _graded(value: Column, grades: tuple, worst: str) -> Column:
    out = F.lit(worst)
    for name, below in reversed(grades):
        out = F.when(value < below, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def measure_grades(stats: DataFrame, key: str = "series") -> DataFrame:
    """(key, measure, value, grade, score, problem) of each measure that is there: the score falls from 100 at 0 to 0 at 3."""
    own = [k for k in stats.columns if k in LIMITS and k != "q"]
    rows = stats.select(key, F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).cast("double").alias("value")) for k in own]))).where("value is not null")
    v = F.col("value")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - v / SCORED_0)))
    return rows.select(key, "measure", "value", _graded(v, MEASURE_GRADES, "fail").alias("grade"), score.alias("score"), (F.col("measure").isin(*PROBLEMS) & (v > PROBLEM_OVER)).alias("problem"))


def q_grade(q: Column) -> Column:
    """good, acceptable or poor; null without a value."""
    return _graded(q, Q_GRADES, "poor")


#: Spread below which a history is stable, and slope over which it degrades. Fixed values.
STABLE_SPREAD, DEGRADING_SLOPE = 0.2, 0.05


def stability(history: DataFrame, *, key: str = "series", ts: str = "ts", value: str = "q", window: int = 12) -> DataFrame:
    """(key, observations, mean, std, slope, current, stable, degrading) of each series' last ``window`` observations.

    Nulls among these are left out of all but ``observations``. A slope needs three
    values, else it is 0; a spread needs two, else it is null and nothing is stable.
    Series with under two observations are left out.
    """
    own = Window.partitionBy(key)
    last = history.withColumn("__n", F.count("*").over(own)).withColumn("__at", F.row_number().over(own.orderBy(F.desc(ts), F.desc(value)))).where((F.col("__n") >= 2) & (F.col("__at") <= window))
    known = F.when(F.col(value).isNotNull(), F.row_number().over(own.orderBy(F.col(value).isNull(), F.desc("__at"))))
    rows = last.withColumn("__x", known.cast("double"))
    v = F.col(value).cast("double")
    out = rows.groupBy(key).agg(F.count("*").alias("observations"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.when(F.count(v) >= 3, F.regr_slope(v, F.col("__x"))).otherwise(0.0).alias("slope"), F.min_by(v, F.when(v.isNotNull(), F.col("__at"))).alias("current"))
    return out.withColumn("stable", F.coalesce(F.col("std") < STABLE_SPREAD, F.lit(False))).withColumn("degrading", F.coalesce(F.col("slope") > DEGRADING_SLOPE, F.lit(False)))


#: Values from which a measure counts as breached; weights in the score of those that don't have 1. Fixed values.
LIMITS = {**{f"m{k}": 1.0 for k in range(1, 12)}, "q": 1.0}
WEIGHTS = {"m7": 2.0, "m8": 2.0, "m9": 1.5, "q": 2.0}
#: Grades in order: (name, every measure below, score at least). Fixed values.
GRADES = (("good", 0.5, 50.0), ("acceptable", 1.0, 20.0))


def quality_score(stats: DataFrame) -> DataFrame:
    """``stats`` with score and grade.

    The score is 100 less the weighted mean of 100 * value / limit, each at most
    150, and at least 0. Measures that are missing or null don't count; without
    any the score is 0 and the grade unknown.
    """
    there = [k for k in LIMITS if k in stats.columns]
    penalty, weight, worst = F.lit(0.0), F.lit(0.0), F.lit(None).cast("double")
    for k in there:
        w = WEIGHTS.get(k, 1.0)
        penalty = penalty + F.coalesce(w * F.least(F.col(k) / LIMITS[k], F.lit(1.5)), F.lit(0.0))
        weight = weight + F.when(F.col(k).isNotNull(), w).otherwise(0.0)
        worst = F.greatest(worst, F.col(k))  # skips nulls
    out = stats.withColumn("score", F.coalesce(F.greatest(F.lit(0.0), 100 - 100 * F.try_divide(penalty, weight)), F.lit(0.0)))
    grade = F.lit("poor")
    for name, below, least in reversed(GRADES):
        grade = F.when((F.greatest(worst, F.lit(0.0)) < below) & (F.col("score") >= least), name).otherwise(grade)
    return out.withColumn("grade", F.when(worst.isNull(), "unknown").otherwise(grade))


def degradation(history: DataFrame, *, key: str = "series", ts: str = "run", keep: int = 10, rises: int = 3) -> DataFrame:
    """(key, runs, breached, rising, slope, degrading) over the last ``keep`` runs of each series.

    ``breached``: measures over their limit in the last run, each named once;
    ``rising``: those that rose ``rises`` times in a row up to it; ``slope``: of q.
    """
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc())
    tail = history.withColumn("at", F.row_number().over(newest)).where(F.col("at") <= keep)
    limits = {k: v for k, v in LIMITS.items() if k in history.columns}
    tail = tail.withColumns({f"up_{k}": F.coalesce(F.col(k) > F.lead(k).over(newest), F.lit(False)) for k in limits})
    last = F.col("at") == 1
    breached = F.array_compact(F.array(*[F.max(F.when(last & (F.col(k) > limit), k)) for k, limit in limits.items()]))
    rising = F.array_compact(F.array(*[F.when(F.count_if((F.col("at") <= rises) & F.col(f"up_{k}")) == rises, k) for k in limits]))
    out = tail.groupBy(key).agg(F.count("*").alias("runs"), breached.alias("breached"), rising.alias("rising"), F.regr_slope(F.col("q"), -F.col("at").cast("double")).alias("slope"))
    return out.withColumn("degrading", (F.size("rising") > 0) | (F.coalesce(F.col("slope"), F.lit(0.0)) > 0.05))
