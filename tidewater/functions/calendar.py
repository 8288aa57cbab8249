"""Calendar expressions: months, business days, holidays, pay periods, and timing codes of moving holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Mean days and mean business days of a month. Fixed values.
MEAN_DAYS, MEAN_BUSINESS_DAYS = 30.437, 21.7


def month(day: Column) -> Column:
    return F.trunc(day, "MM").cast("date")


def week(day: Column) -> Column:
    """The Sunday that closes the week."""
    return F.next_day(F.date_sub(day.cast("date"), 1), "SUN")


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def weekday_count(day: Column, isodow: int) -> Column:
    """How often a weekday (1 Monday to 7 Sunday) comes in the month: four times, and once more if it falls on day 29 to the last."""
    first = F.weekday(month(day)) + 1
    offset = F.pmod(F.lit(isodow) - first, F.lit(7))
    return (F.lit(4) + (offset < days_in_month(day) - 28).cast("int")).cast("int")


def five_friday_month(day: Column) -> Column:
    return weekday_count(day, 5) == 5


def business_days(day: Column) -> Column:
    """Mondays to Fridays of the month; holidays are not left out."""
    total = weekday_count(day, 1)
    for d in range(2, 6):
        total = total + weekday_count(day, d)
    return total


def adjustment_factor(day: Column, business: bool = False) -> Column:
    """What a monthly flow is multiplied by to compare with a month of mean length."""
    return MEAN_BUSINESS_DAYS / business_days(day) if business else MEAN_DAYS / days_in_month(day)


def apply_factor(value: Column, factor: Column) -> Column:
    return value * factor


def nth_weekday(year: Column, month_number: int, name: str, n: int) -> Column:
    """The n-th weekday of a month, or the last one for n = -1."""
    first = F.make_date(year, F.lit(month_number), F.lit(1))
    if n < 0:
        return F.next_day(F.date_sub(F.last_day(first), 7), name)
    return F.date_add(F.next_day(F.date_sub(first, 1), name), 7 * (n - 1))


def federal_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(holiday, day): eleven a year, on their nominal dates."""
    return holidays_of(spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year")), "year")


def holidays_of(years: DataFrame, year: str) -> DataFrame:
    """(holiday, day) of the federal holidays of every different year of a column."""
    years = years.where(F.col(year).isNotNull()).select(F.col(year).cast("int").alias("y")).distinct()
    y = F.col("y")

    def on(m: int, d: int) -> Column:
        return F.make_date(y, F.lit(m), F.lit(d))

    days = {
        "New Year's Day": on(1, 1),
        "Martin Luther King Jr. Day": nth_weekday(y, 1, "MON", 3),
        "Presidents' Day": nth_weekday(y, 2, "MON", 3),
        "Memorial Day": nth_weekday(y, 5, "MON", -1),
        "Juneteenth": on(6, 19),
        "Independence Day": on(7, 4),
        "Labor Day": nth_weekday(y, 9, "MON", 1),
        "Columbus Day": nth_weekday(y, 10, "MON", 2),
        "Veterans Day": on(11, 11),
        "Thanksgiving": nth_weekday(y, 11, "THU", 4),
        "Christmas": on(12, 25),
    }
    return years.select(F.inline(F.array(*[F.struct(F.lit(k).alias("holiday"), v.alias("day")) for k, v in days.items()])))


def easter(year: Column) -> Column:
    """Easter Sunday by the anonymous Gregorian computus."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    rest = (32 + 2 * e + 2 * i - h - k) % 7
    m = div(a + 11 * h + 22 * rest, 451)
    months = h + rest - 7 * m + 114
    return F.make_date(year, div(months, 31), months % 31 + 1)


def timing_code(day: Column, holiday: Column, early_to: int, late_from: int) -> Column:
    """In the holiday's month: -1 if it falls on day ``early_to`` or before, 1 if on ``late_from`` or later, else 0; 0 in all other months."""
    n = F.dayofmonth(holiday)
    return F.when(month(day) == month(holiday), F.when(n <= early_to, -1).when(n >= late_from, 1).otherwise(0)).otherwise(0)


def calendar_months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """A row per month with its calendar measures."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))
    return days.select("month", *measures(F.col("month")))


def measures(m: Column) -> list[Column]:
    """Of a day's month: days, business days, five Fridays, factors, and how early or late its moving holidays fall."""
    y = F.year(m)
    moving = [("easter", easter(y), (10, 20)), ("thanksgiving", nth_weekday(y, 11, "THU", 4), (24, 25)), ("labor_day", nth_weekday(y, 9, "MON", 1), (3, 6))]
    return [days_in_month(m).alias("days"), business_days(m).alias("business_days"), five_friday_month(m).alias("five_fridays"), adjustment_factor(m).alias("day_factor"), adjustment_factor(m, True).alias("business_factor"), *[timing_code(m, holiday, *bounds).alias(name) for name, holiday, bounds in moving]]


def pay_period_type(df: DataFrame, key: str, day: str) -> DataFrame:
    """(key, pay_period): biweekly if over 0.7 of gaps are 12 to 16 days, semimonthly if over 0.6 are 13 to 18, else unknown; unknown too under 4 dates."""
    gaps = df.select(key, F.col(day).cast("date").alias("d")).distinct().withColumn("gap", F.datediff("d", F.lag("d").over(Window.partitionBy(key).orderBy("d"))))
    share = lambda a, b: F.avg(F.when(F.col("gap").isNotNull(), F.col("gap").between(a, b).cast("double")))
    return gaps.groupBy(key).agg(F.when(F.count("*") < 4, "unknown").when(share(12, 16) > 0.7, "biweekly").when(share(13, 18) > 0.6, "semimonthly").otherwise("unknown").alias("pay_period"))
