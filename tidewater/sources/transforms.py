"""What each public source becomes after parsing: projections and windows over one series or state at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.calendar import month
from tidewater.functions.nulls import ratio
from tidewater.operators import windows
from tidewater.operators.aggregate import distinct_joined, flag_above_percentile

#: Endings of employment series whose unit is not thousands of persons. Fixed values.
UNITS = {"003": "dollars", "002": "hours"}
#: Measures of unemployment series: (part of a national id, ending of a local one, name), the first that fits counts. Fixed values.
MEASURES = (("LNS14", "003", "unemployment_rate"), ("LNS13", "004", "unemployment_level"), ("LNS12", "005", "employment_level"), ("LNS11", "006", "labor_force"))


def monthly_period(period: Column) -> Column:
    """1 to 12 of M01 to M12; null for annual means (M13) and all else."""
    m = F.regexp_extract(period, r"^M(\d+)$", 1).try_cast("int")
    return F.when(m.between(1, 12), m)


def changes(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``df`` with changes to the row before and to the twelfth before, of each series."""
    w = windows.over(key, order)
    return df.withColumn("mom_change", windows.change(value, w)).withColumn("yoy_change", windows.change(value, w, 12))


def preliminary(footnotes: str) -> Column:
    """Whether the code or the text of any footnote says preliminary; false without footnotes."""

    def says(part: Column) -> Column:
        return F.contains(F.lower(F.coalesce(part, F.lit(""))), F.lit("preliminary"))

    return F.coalesce(F.exists(footnotes, lambda f: says(f["code"]) | says(f["text"])), F.lit(False))


def employment(df: DataFrame) -> DataFrame:
    """Rows of read_series_replies with date, changes, unit, and whether a footnote says preliminary."""
    m = monthly_period(F.col("period"))
    rows = df.withColumn("month", m).where("month is not null").withColumn("date", F.make_date("year", "month", F.lit(1)))
    unit = reduce(lambda other, e: F.when(F.col("series_id").endswith(e), UNITS[e]).otherwise(other), UNITS, F.lit("thousands"))
    return changes(rows, "series_id", "date", "value").withColumn("unit", unit).withColumn("is_preliminary", preliminary("footnotes"))


def local_unemployment(df: DataFrame, states: DataFrame) -> DataFrame:
    """Local series with state (from ``states``: state_fips, state_name; else National), measure, changes, and whether a footnote says preliminary."""
    m = monthly_period(F.col("period"))
    rows = df.withColumn("month", m).where("month is not null").withColumn("date", F.make_date("year", "month", F.lit(1)))
    state = F.when(F.col("series_id").startswith("LASST"), F.substring("series_id", 6, 2)).otherwise("00")
    own = F.col("series_id")
    measure = reduce(lambda other, m: F.when(F.contains(own, F.lit(m[0])) | own.endswith(m[1]), m[2]).otherwise(other), reversed(MEASURES), F.lit("other"))
    named = rows.withColumn("state_fips", state).withColumn("measure", measure).join(states.select("state_fips", "state_name"), "state_fips", "left")
    named = named.withColumn("state_name", F.coalesce("state_name", F.lit("National"))).withColumn("is_preliminary", preliminary("footnotes"))
    return changes(named, "series_id", "date", "value")


def claims(df: DataFrame, states: list[str]) -> DataFrame:
    """Weekly claims of known states with 4-week and 13-week means; either of two raw namings is read."""
    names = {"st": "state_code", "rptdate": "report_date", "c3": "initial_claims", "c8": "continued_claims", "ic": "initial_claims", "cc": "continued_claims"}
    rows = df.withColumnsRenamed({c: names[c.lower()] for c in df.columns if c.lower() in names})
    kept = rows.where(F.col("state_code").isin([*states, "US"])).withColumns({c: F.col(c).try_cast("double") for c in ("initial_claims", "continued_claims")}).withColumn("report_date", F.col("report_date").try_cast("date"))
    w = windows.over("state_code", "report_date")
    return kept.withColumn("initial_claims_4wk_ma", windows.rolling_mean("initial_claims", w, 4)).withColumn("continued_claims_13week", windows.rolling_mean("continued_claims", w, 13))


def withholdings(df: DataFrame, key: str = "classification") -> DataFrame:
    """Daily statement lines of income tax with daily change, means of 5 and 20, and calendar flags, by classification."""
    rows = df.where(F.col(key).ilike("%income tax%"))
    w = windows.over(key, "date")
    d = F.col("date")
    flow = rows.withColumn("daily_withholding", windows.change("balance", w))
    return flow.withColumns({"withholding_5day_ma": windows.rolling_mean("daily_withholding", w, 5), "withholding_20day_ma": windows.rolling_mean("daily_withholding", w, 20), "is_business_day": F.weekday(d) < 5, "day_of_month": F.dayofmonth(d), "is_mid_month": F.dayofmonth(d).between(14, 16), "is_month_end": F.dayofmonth(d).between(28, 31)})


#: Kinds of business formation series, by a part of their name; the first that fits counts. Fixed values.
FORMATIONS = (("with planned wages", "high_propensity_applications"), ("business applications", "total_applications"), ("formations", "business_formations"))


def formations(df: DataFrame) -> DataFrame:
    """Monthly business formation by kind, with changes and the rate of formations to high-propensity applications.

    The kinds become one national row a month, so the changes look back over a single short series.
    """
    kind = reduce(lambda other, x: F.when(F.contains(F.lower("category"), F.lit(x[0])), x[1]).otherwise(other), reversed(FORMATIONS), F.lit(None).cast("string"))
    names = [k for _, k in FORMATIONS]
    wide = df.withColumn("kind", kind).groupBy("date").pivot("kind", names).agg(F.sum("value"))
    w = windows.over([], "date")
    out = wide.withColumns({f"{c}_mom_change": windows.change(c, w) for c in names} | {f"{c}_yoy_change": windows.change(c, w, 12) for c in names})
    return out.withColumn("formation_rate", ratio(F.col("business_formations"), F.col("high_propensity_applications")))


#: Stoppage series by id; counts of workers and days are in thousands. Fixed values.
STOPPAGES = {"WSU001": "days_idleness_thousands", "WSU010": "workers_involved_thousands", "WSU020": "workers_in_effect_thousands", "WSU100": "num_stoppages_beginning", "WSU200": "num_stoppages_in_effect"}


def scored(months: DataFrame, significant: float = 50_000) -> DataFrame:
    """Months with their score, workers times stoppages, and whether more than ``significant`` workers took part."""
    return months.withColumn("strike_impact_score", F.col("workers_involved") * F.col("num_stoppages")).withColumn("is_significant_month", F.coalesce(F.col("workers_involved") > significant, F.lit(False)))


def stoppage_series(df: DataFrame) -> DataFrame:
    """By month end: a column for each series of STOPPAGES (rows: series_id, date, value), workers and stoppages begun, score."""
    names = F.create_map(*[F.lit(x) for kv in STOPPAGES.items() for x in kv])
    wide = df.withColumn("__name", F.try_element_at(names, F.col("series_id"))).groupBy(F.last_day("date").alias("date")).pivot("__name", list(STOPPAGES.values())).agg(F.sum("value"))
    months = wide.withColumn("industry", F.lit("All Industries (National)")).withColumn("num_stoppages", F.col("num_stoppages_beginning"))
    return scored(months.withColumn("workers_involved", F.col("workers_involved_thousands") * 1000))


def strikes_monthly(df: DataFrame, significant: float = 50_000) -> DataFrame:
    """By month end: workers, stoppages, industries, score."""
    out = df.groupBy(F.last_day("date").alias("date")).agg(F.sum("workers_involved").alias("workers_involved"), F.count("*").alias("num_stoppages"), distinct_joined("industry").alias("industry"))
    return scored(out.withColumn("industry", F.when(F.col("industry") == "", "All Industries").otherwise(F.col("industry"))), significant)


def damage_millions(text: Column) -> Column:
    """10.5K, 2M or 1B in millions; what doesn't parse is 0."""
    number = F.regexp_replace(F.upper(text), "[KMB]", "").try_cast("double")
    scale = F.when(F.contains(F.upper(text), F.lit("K")), 1e-3).when(F.contains(F.upper(text), F.lit("M")), 1.0).when(F.contains(F.upper(text), F.lit("B")), 1e3).otherwise(1e-6)
    return F.coalesce(number * scale, F.lit(0.0))


def size_class(workers: Column) -> Column:
    """small (0, 100], medium (100, 1000], large (1000, 10000], major above; 0 and less have none."""
    return F.when(workers <= 0, None).when(workers <= 100, "small").when(workers <= 1_000, "medium").when(workers <= 10_000, "large").when(workers.isNotNull(), "major")


def damage_class(millions: Column) -> Column:
    """Minor (0, 100], Moderate (100, 1000], Major (1000, 10000], Catastrophic above, in millions; 0 and less have none."""
    return F.when(millions <= 0, None).when(millions <= 100, "Minor").when(millions <= 1_000, "Moderate").when(millions <= 10_000, "Major").when(millions.isNotNull(), "Catastrophic")


def storm_events(years: list[DataFrame]) -> DataFrame:
    """Rows of yearly files under one set of columns, with deaths and injuries summed over direct and indirect ones; what a year lacks is null."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), years)
    for kind in ("deaths", "injuries"):
        parts = [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in (f"{kind}_direct", f"{kind}_indirect") if c in rows.columns]
        if parts:
            rows = rows.withColumn(kind, reduce(lambda a, b: a + b, parts))
    return rows


def weather_monthly(df: DataFrame, q: float = 0.75) -> DataFrame:
    """By month: types, states, sums, score of events, and whether the month is over the q-quantile of scores."""
    score = F.coalesce(F.col("deaths").cast("double"), F.lit(0.0)) * 100 + F.coalesce(F.col("injuries").cast("double"), F.lit(0.0)) * 10 + F.col("damage_millions") / 10
    rows = df.withColumn("employment_impact_score", score).groupBy(month(F.col("date")).alias("year_month")).agg(
        distinct_joined("event_type").alias("event_type"), distinct_joined("state").alias("state"), *[F.sum(c).alias(c) for c in ("deaths", "injuries", "damage_millions", "employment_impact_score")], F.min("date").alias("date"), F.count("*").alias("num_major_events")
    )
    return flag_above_percentile(rows, "employment_impact_score", q, "is_high_impact_month")


def active_strikes(df: DataFrame, today: Column) -> DataFrame:
    """Months that count as significant, from the current month on."""
    return df.where(F.col("is_significant_month") & (F.col("date") >= F.trunc(today, "MM")))


def recent_disruptions(df: DataFrame, today: Column, months: int = 6) -> DataFrame:
    return df.where(F.col("date") >= F.date_sub(today, months * 30)).orderBy(F.desc("employment_impact_score"), "date")


def withholdings_monthly(df: DataFrame, key: str = "classification") -> DataFrame:
    """Withholdings by month: sum, mean, deviation, business days, last balance, last date."""
    from tidewater.operators.aggregate import monthly_flow

    out = monthly_flow(df, key=[key], ts="date", value="daily_withholding", balance="balance", tie=key)
    days = df.groupBy(key, month(F.col("date")).alias("month")).agg(F.count_if("is_business_day").alias("business_days"))
    return out.drop("days").join(days, [key, "month"])


def latest_row(df: DataFrame, order: str) -> DataFrame:
    """The row of the latest date, by date rather than place."""
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(order, *[c for c in df.columns if not dict(df.dtypes)[c].startswith("map")])).alias("row")).select("row.*")


def state_summary(df: DataFrame, measure: str) -> DataFrame:
    """The latest row of a measure by state (state_name, state_fips, date, value, mom_change, yoy_change), largest first; the nation is one of them."""
    rows = df.where(F.col("measure") == measure).select("state_fips", "state_name", "date", "value", "mom_change", "yoy_change")
    return windows.latest(rows, "state_fips", "date").select("state_name", "state_fips", "date", "value", "mom_change", "yoy_change").orderBy(F.desc("value"), "state_fips")


def trimmed_joins(rows: DataFrame, industries: DataFrame, areas: DataFrame) -> DataFrame:
    """Stoppage lines with the names of their industry and area codes; codes without a name stay."""
    return rows.join(industries, "industry_code", "left").join(areas, "area_code", "left")
