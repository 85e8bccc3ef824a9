"""The tail of the reports: tables that are counted from records, connections, cancelled trains and frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspan.operators.pairs import ends, pair_sums

# Days a year that the loss is stretched to; smallest plan of an hour that can be among the worst.
WORKING_DAYS, LEAST_PLANNED = 220, 3


def train_days(conn: DataFrame, rec: DataFrame) -> DataFrame:
    """Delay of each day of the trains that made others miss a connection: minutes on average and at most, stops, a relation.

    Missing delays count as none; a negative one as it is.
    """
    late = conn.filter("missed = 1").select(F.col("arr_train").alias("train_no")).distinct()
    d = F.coalesce("delay_arr", F.lit(0)) / 60
    return rec.join(late, "train_no", "left_semi").groupBy("train_no", "day_date").agg(F.avg(d).alias("avg_min"), F.max(d).alias("max_min"), F.count("*").alias("n_stops"), F.min("relation").alias("relation"))


def pair_weekdays(rec: DataFrame, least_missed: int = 0) -> DataFrame:
    """Connections of records by pair of trains and weekday; of pairs that missed so many on all days."""
    x = pair_sums(ends(rec, "arr"), ends(rec, "dep"), ["planned", "missed", "rel_arr", "hour", "gap"], by_dow=True, least_missed=least_missed)
    return x.select("station", "arr_train", "dep_train", "dow", F.col("planned").alias("n_occ"), F.col("missed").alias("n_missed"), F.col("rel_arr").alias("relation"), "hour", (F.col("gap") / F.col("planned")).alias("avg_gap"))


def worst_hours(by_hour: DataFrame, *group: str, k: int = 3, least: int = LEAST_PLANNED) -> DataFrame:
    """The k hours of each group that miss the largest share, among those with enough connections planned."""
    pct = F.col("missed") * 100.0 / F.col("planned")
    w = Window.partitionBy(*group).orderBy(F.desc("pct"), "dep_hour")
    return by_hour.filter(F.col("planned") >= least).withColumn("pct", pct).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def yearly_loss(missed: Column, days: Column, wait_min: Column) -> Column:
    """Hours a year: misses a day times the wait, over the working days."""
    return missed / F.greatest(days, F.lit(1)) * wait_min * WORKING_DAYS / 60


def weekday_share(pairs: DataFrame) -> DataFrame:
    """How far the misses of a pair fall on one weekday: the day with most, and its share of all."""
    pair = ["station", "arr_train", "dep_train"]
    best = pairs.groupBy(*pair).agg(F.sum("n_missed").alias("missed"), F.max(F.struct("n_missed", (-F.col("dow")).alias("d"))).alias("top"))
    return best.filter("missed > 0").select(*pair, "missed", (-F.col("top.d")).alias("dow"), (F.col("top.n_missed") / F.col("missed")).alias("share"))


def rain_on_page(days: DataFrame, weather: DataFrame, least_days: int = 5, least_avg: float = 1.0, k: int = 30) -> DataFrame:
    """Trains (train_no, day_date, delay) by delay on rainy against dry days: enough days, some of each kind, an average of at least least_avg."""
    rainy = F.col("rain") > 1
    x = days.join(weather.select("day_date", "rain"), "day_date").groupBy("train_no").agg(
        F.count("*").alias("n_days"), F.avg("delay").alias("avg"), F.avg(F.when(rainy, F.col("delay"))).alias("rainy"), F.avg(F.when(~rainy, F.col("delay"))).alias("dry"))
    x = x.filter((F.col("n_days") >= least_days) & F.col("rainy").isNotNull() & F.col("dry").isNotNull() & (F.col("avg") >= least_avg))
    return x.withColumn("more", F.col("rainy") - F.col("dry")).orderBy(F.desc("more"), "train_no").limit(k)


def cancelled_stations(gone: DataFrame) -> DataFrame:
    """Cancelled calls of each station; gone has stops, an array."""
    return gone.select(F.explode("stops").alias("station")).groupBy("station").agg(F.count("*").alias("deleted"))


def cancelled_days(scheduled: DataFrame, gone: DataFrame, suspicious: float = 30.0) -> DataFrame:
    """By day: trains planned and cancelled, their share, stops and minutes lost; a day beyond `suspicious` percent is marked."""
    all_ = scheduled.groupBy("day_date").agg(F.count("*").alias("scheduled"))
    lost = gone.groupBy("day_date").agg(F.count("*").alias("deleted"), F.sum(F.size("stops")).cast("long").alias("stops"), F.sum("duration_min").alias("minutes"))
    x = all_.join(lost, "day_date", "left").select("day_date", "scheduled", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("deleted", "stops", "minutes")])
    pct = F.col("deleted") * 100.0 / F.col("scheduled")
    return x.withColumn("pct", pct).withColumn("suspicious", pct > suspicious)


def operator_breakdown(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy("operator").agg(F.count("*").alias("n"), F.countDistinct("station").alias("stations"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def class_of(value: Column, high: float, low: float) -> Column:
    """Tab of a ranking: high above, medium from low on, else low."""
    return F.when(value > high, "high").when(value >= low, "medium").otherwise("low")


def weather_days(weather: DataFrame) -> DataFrame:
    return weather.agg(F.count_if(F.col("rain") > 1).alias("rainy"), F.count_if(F.col("snow") > 0).alias("snowy"), F.count("*").alias("days"))


def by_relation(offenders: DataFrame) -> DataFrame:
    """Offenders of each relation, in order of their trains; a missing relation is a group of its own."""
    return offenders.groupBy("relation").agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_list("train_no"))).alias("trains"))


def station_averages(conn: DataFrame) -> DataFrame:
    """Days with a planned connection, and connections planned and missed on such a day."""
    days = F.countDistinct("day_date")
    return conn.groupBy("station").agg(days.alias("days"), (F.count("*") / days).alias("planned_a_day"), (F.sum("missed") / days).alias("missed_a_day"))


def area_means(values: DataFrame, areas: DataFrame) -> DataFrame:
    """Mean value and number of stations of each area; values (id, value), areas (id, area)."""
    return values.join(areas, "id").groupBy("area").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def all_stations(stations: DataFrame, reached: DataFrame, target: str) -> DataFrame:
    """Every station with its minutes: 0 for the target itself, null where it cannot be reached."""
    met = stations.select(F.col("id").cast("string").alias("id")).join(reached.select(F.col("id").cast("string").alias("id"), "minutes"), "id", "left")
    return met.select("id", F.when(F.col("id") == target, F.lit(0.0)).otherwise(F.col("minutes")).alias("minutes"))


def group_stats(values: DataFrame, group: str, value: str) -> DataFrame:
    return values.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("most"))


def combine_destinations(times: DataFrame, destinations: DataFrame, once: bool = False) -> DataFrame:
    """For each origin of times (origin, station, minutes, transfers) how far the destinations (station) are that it reaches. once: times has a pair once, so no pairs are shuffled."""
    met = times.join(destinations.select("station").distinct(), "station", "left_semi")
    return met.groupBy("origin").agg((F.count("station") if once else F.countDistinct("station")).alias("n"), F.avg("minutes").alias("mean"), F.min("minutes").alias("least"), F.max("minutes").alias("most"), F.avg("transfers").alias("transfers"))


def first_then_top(df: DataFrame, first: int, came: list[Column], top: int, by: list[Column]) -> DataFrame:
    """The `top` rows by `by` of the `first` rows by `came`: a list that was cut in one order and is shown in another."""
    return df.orderBy(*came).limit(first).orderBy(*by).limit(top)


def cancelled_trains(gone: DataFrame, first: int = 500, top: int = 200) -> DataFrame:
    """Of the first cancelled trains (day_date, train_no, stops, duration_min) by day and number those that took longest, with the ends of their way."""
    cut = first_then_top(gone, first, [F.col("day_date"), F.col("train_no")], top, [F.desc("duration_min"), F.col("day_date"), F.col("train_no")])
    return cut.select("day_date", "train_no", "duration_min", F.size("stops").alias("n_stops"), F.try_element_at("stops", F.lit(1)).alias("first_station"), F.try_element_at("stops", F.lit(-1)).alias("last_station"))


def ordered_calls(stop_times: DataFrame) -> DataFrame:
    """For each trip (trip_id, seq, stop, arr_min, dep_min) its stops in order, and the first and last clock of its ends; a trip's stops bound the array."""
    call = F.struct("seq", "stop", "arr_min", "dep_min")
    x = stop_times.groupBy("trip_id").agg(F.sort_array(F.collect_list(call)).alias("c"))
    return x.select("trip_id", F.transform("c", lambda v: v["stop"]).alias("stops"), F.element_at("c", 1)["arr_min"].alias("first_arr"), F.element_at("c", 1)["dep_min"].alias("first_dep"),
                    F.element_at("c", -1)["arr_min"].alias("last_arr"), F.element_at("c", -1)["dep_min"].alias("last_dep"))


def travel_by_area(swept: DataFrame, areas: DataFrame) -> DataFrame:
    """For each origin of swept (origin, station, minutes) and area (id, area): stations reached there, and minutes to them on average, least and most."""
    met = swept.join(areas.select(F.col("id").cast("string").alias("station"), "area"), "station").filter("area is not null")
    return met.groupBy("origin", "area").agg(F.count("*").alias("n"), F.avg("minutes").alias("mean"), F.min("minutes").alias("least"), F.max("minutes").alias("most"))


def reach_means(counts: DataFrame, areas: DataFrame) -> DataFrame:
    """For each area of the origins of counts (origin, reachable, avg_minutes): their number, and stations reached and minutes to them on average."""
    met = counts.join(areas.select(F.col("id").cast("string").alias("origin"), "area"), "origin")
    return met.groupBy("area").agg(F.count("*").alias("n"), F.avg("reachable").alias("reachable"), F.avg("avg_minutes").alias("minutes"))
