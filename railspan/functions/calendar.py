"""Dates, holidays and service days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# School holidays, both ends included.
SCHOOL_HOLIDAYS = [
    ("2024-07-01", "2024-08-31", "Summer 2024"), ("2024-10-28", "2024-11-03", "Autumn 2024"), ("2024-12-23", "2025-01-05", "Christmas 2024"),
    ("2025-02-24", "2025-03-09", "Carnival 2025"), ("2025-04-07", "2025-04-20", "Easter 2025"), ("2025-07-01", "2025-08-31", "Summer 2025"),
    ("2025-10-20", "2025-11-02", "Autumn 2025"), ("2025-12-22", "2026-01-04", "Christmas 2025"), ("2026-02-16", "2026-03-01", "Carnival 2026"),
    ("2026-04-06", "2026-05-10", "Spring 2026"), ("2026-07-01", "2026-08-31", "Summer 2026"), ("2026-10-19", "2026-11-08", "Autumn 2026"),
    ("2026-12-21", "2027-01-03", "Christmas 2026"),
]
# Public holidays by month and day; days after Easter of the movable ones.
FIXED_HOLIDAYS, AFTER_EASTER = [(1, 1), (5, 1), (7, 21), (8, 15), (11, 1), (11, 11), (12, 25)], [1, 39, 50]


def easter(year: Column) -> Column:
    """Easter Sunday of a year, by the Gregorian computus."""
    golden, century = year % 19, F.floor(year / 100)
    moon = (19 * golden + century - F.floor(century / 4) - F.floor((century - F.floor((century + 8) / 25) + 1) / 3) + 15) % 30
    week = (32 + 2 * (century % 4) + 2 * F.floor((year % 100) / 4) - moon - (year % 100) % 4) % 7
    shift = F.floor((golden + 11 * moon + 22 * week) / 451)
    day = moon + week - 7 * shift + 114
    return F.make_date(year.cast("int"), F.floor(day / 31).cast("int"), (day % 31 + 1).cast("int"))


def public_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    years = spark.range(first_year, last_year + 1).select(F.col("id").alias("y"))
    fixed = [F.make_date(F.col("y").cast("int"), F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    return years.select(F.explode(F.array(*fixed, *[F.date_add(easter(F.col("y")), n) for n in AFTER_EASTER])).alias("holiday"))


def school_holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(dt.date.fromisoformat(a), dt.date.fromisoformat(b), n) for a, b, n in SCHOOL_HOLIDAYS], "start date, end date, name string")


def date_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day_date"))


def filter_dates(df: DataFrame, day: str = "day_date", weekdays=None, public: DataFrame | None = None, school: DataFrame | None = None) -> DataFrame:
    """Rows on the wanted weekdays (Monday is 0), not on a public holiday nor inside a school holiday."""
    if weekdays is not None:
        df = df.filter(F.weekday(day).isin(list(weekdays)))
    if public is not None:
        df = df.join(public, F.col(day) == F.col("holiday"), "left_anti")
    if school is not None:
        closed = school.select(F.explode(F.sequence("start", "end")).alias("_closed")).distinct()  # days, so that they meet by equality
        df = df.join(closed, F.col(day) == F.col("_closed"), "left_anti")
    return df


def clipped_periods(periods: DataFrame, lo: str, hi: str) -> DataFrame:
    """Periods that overlap a range, cut to it."""
    a, b = F.lit(lo).cast("date"), F.lit(hi).cast("date")
    return periods.filter((F.col("end") >= a) & (F.col("start") <= b)).select(F.greatest("start", a).alias("start"), F.least("end", b).alias("end"), "name")


def month_snapshots(dates: DataFrame, day: str = "day_date") -> DataFrame:
    """One row for each month that has a date: first and last day."""
    return dates.select(F.trunc(day, "MM").alias("month_start")).distinct().select("month_start", F.last_day("month_start").alias("month_end"))


def service_dates(calendar: DataFrame, exceptions: DataFrame, dates: DataFrame) -> DataFrame:
    """(service_id, day_date) that run: by weekday flags, plus additions (type 1), minus removals (type 2), on the wanted dates."""
    flags = F.array(*[F.col(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")])
    first, last = F.trunc("start_date", "MM"), F.trunc("end_date", "MM")
    months = calendar.filter("start_date <= end_date").withColumn("month", F.explode(F.sequence(first, last, F.expr("interval 1 month"))))
    regular = (months.join(dates.select("day_date", F.trunc("day_date", "MM").alias("month")), "month").filter(F.col("day_date").between(F.col("start_date"), F.col("end_date")))
               .filter(F.element_at(flags, F.weekday("day_date") + 1) == 1).select("service_id", "day_date"))
    extra = exceptions.filter("exception_type = 1").join(dates, F.col("date") == F.col("day_date")).select("service_id", "day_date")
    gone = exceptions.filter("exception_type = 2").select("service_id", F.col("date").alias("day_date"))
    return regular.union(extra).distinct().join(gone, ["service_id", "day_date"], "left_anti")


def service_day_counts(calendar: DataFrame, exceptions: DataFrame, dates: DataFrame) -> DataFrame:
    return service_dates(calendar, exceptions, dates).groupBy("service_id").agg(F.count("*").alias("n_days"))
