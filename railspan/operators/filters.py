"""Row filters, name lookups, pages and merges of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspan.operators.asof import asof

# The longest range of days that each report takes.
LONGEST_RANGE = {"propagation": 30, "problematic": 30, "missed": 30, "deleted": 31, "weather": 365}


def hour_of(seconds: Column) -> Column:
    return F.floor(seconds / 3600)


def either_hour(rec: DataFrame, first: int, last: int) -> DataFrame:
    """Records that arrive or depart from hour first up to, not including, last. A missing clock fits no hour."""
    fits = lambda c: F.coalesce((hour_of(F.col(c)) >= first) & (hour_of(F.col(c)) < last), F.lit(False))
    return rec.filter(fits("arr_sec") | fits("dep_sec"))


def drop_unless(df: DataFrame, condition: Column) -> DataFrame:
    """What stays when rows are deleted where the condition is false: rows whose condition is null stay too."""
    return df.filter(F.coalesce(condition, F.lit(True)))


def numeric_only(df: DataFrame, name: str) -> DataFrame:
    """Rows whose text in the column is a number, as that number; others are dropped, not taken as 0."""
    return df.withColumn(name, F.col(name).try_cast("double")).filter(F.col(name).isNotNull() & ~F.isnan(name))


def edges_in_hours(edge: DataFrame, first: int, last: int) -> DataFrame:
    """Edges that depart from hour first up to, not including, last."""
    return edge.filter(F.col("dep_min").between(first * 60, last * 60 - 1))


def of_operators(rec: DataFrame, operators: list[str] | None = None, relations: list[str] | None = None) -> DataFrame:
    """Records of the operators and relations named; None takes all. A missing name is in no list."""
    for name, wanted in (("operator", operators), ("relation", relations)):
        rec = rec if wanted is None else rec.filter(F.col(name).isin(*wanted))
    return rec


def check_range(report: str, days: int) -> int:
    if days > LONGEST_RANGE[report]:
        raise ValueError(f"{report}: {days} days, at most {LONGEST_RANGE[report]}")
    return days


def look_up(names: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id, name): of the names (id, name) equal to or holding what is asked, in any case, an equal one, else that of the least id.

    asked (asked string) holds a user's few words: it is broadcast after its rows are counted, 1000 at most.
    """
    if asked.limit(1001).count() > 1000:
        raise ValueError("more than 1000 names asked at once")
    low, part = F.lower("name"), F.lower("asked")
    met = names.join(F.broadcast(asked), F.contains(low, part))
    best = met.groupBy("asked").agg(F.min(F.struct((low != part).alias("inexact"), "id", "name")).alias("b"))
    return best.select("asked", "b.id", "b.name")


def page(df: DataFrame, offset: int, size: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def feed_top(df: DataFrame, ranked: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """Rows of df whose key is among the first n of ranked."""
    return df.join(ranked.orderBy(*order).limit(n).select(key), key, "left_semi")


def merge_snapshots(df: DataFrame, key: str, snapshot: str, last: bool = True) -> DataFrame:
    """One row for each key: that of the last snapshot, or of the first; the columns' order settles ties."""
    row = F.struct(snapshot, *[c for c in df.columns if c not in (key, snapshot)])
    return df.groupBy(key).agg((F.max if last else F.min)(row).alias("r")).select(key, "r.*")


def with_places(df: DataFrame, places: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """lat and lon by name: rows without a known place are dropped (inner) or kept without one (left). The last of equal names counts."""
    known = merge_snapshots(places.filter("lat is not null and lon is not null and lat <> 0 and lon <> 0").select("name", "ordinal", "lat", "lon"), "name", "ordinal")
    return df.join(known.select(F.col("name").alias(on), "lat", "lon"), on, how)


def with_both_places(segments: DataFrame, places: DataFrame) -> DataFrame:
    """Segments (src, dst) whose two ends are known, with their places."""
    one = with_places(segments, places, "src").withColumnsRenamed({"lat": "src_lat", "lon": "src_lon"})
    return with_places(one, places, "dst").withColumnsRenamed({"lat": "dst_lat", "lon": "dst_lon"})


def enrich(stations: DataFrame, regions: DataFrame) -> DataFrame:
    """Stations (id, name, area) with the province and region of their area (area, province, region), Unknown where there is none."""
    met = stations.join(regions, "area", "left")
    return met.select("id", "name", *[F.coalesce(c, F.lit("Unknown")).alias(c) for c in ("province", "region")])


def first_names(rows: DataFrame) -> DataFrame:
    """(id, name): the name that each id has first (ordinal)."""
    return rows.groupBy("id").agg(F.min_by("name", F.struct("ordinal", "name")).alias("name"))


def holiday_name(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """(day, name): of the holidays (start, end, name) that hold the day the first by start and name, null where none does.

    What an earlier holiday covers is cut off a later one, so days meet the last holiday that starts before them.
    """
    seen = F.max("end").over(Window.orderBy("start", "name", "end").rowsBetween(Window.unboundedPreceding, -1))  # a calendar's few rows
    own = holidays.withColumn("seen", seen).filter("seen is null or end > seen").select(F.greatest("start", F.date_add("seen", 1)).alias("day"), "end", "name")
    return asof(days.select("day").distinct(), own, [], "day").select("day", F.when(F.col("match.end") >= F.col("day"), F.col("match.name")).alias("name"))
