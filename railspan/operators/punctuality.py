"""Punctuality, delay propagation, repeat offenders, weather and cancelled trains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspan.functions.scalars import clamp_delay, safe_corr


def minutes(delay: str, floor: float, cap: float, drop: bool = False):
    """A transform to column d: minutes of delay, missing ones 0, clamped, or dropped where out of range."""

    def run(df: DataFrame) -> DataFrame:
        d = F.coalesce(F.col(delay), F.lit(0)) / 60
        df = df.withColumn("d", d)
        return df.filter(F.col("d").between(floor, cap)) if drop else df.withColumn("d", clamp_delay(F.col("d"), floor, cap).cast("double"))

    return run


def in_hours(col: str, lo: int, hi: int) -> Column:
    h = F.floor(F.col(col) / 3600)
    return (h >= lo) & (h < hi)


def by_station(rec: DataFrame, least: int = 5, late: float = 1.0) -> DataFrame:
    return (rec.groupBy("station").agg(F.round(F.avg("d"), 1).alias("avg_delay"), F.count("*").alias("n_trains"), F.avg((F.col("d") > late).cast("int") * 100.0).alias("pct_late"),
                                       F.percentile("d", F.lit(0.5)).alias("median_delay"), F.max("d").alias("max_delay")).filter(F.col("n_trains") >= least))


def summary(stations: DataFrame) -> DataFrame:
    """Over the stations' rounded averages."""
    return stations.agg(F.count("*").alias("n_stations"), F.avg("avg_delay").alias("mean_of_avg"), F.percentile("avg_delay", F.lit(0.5)).alias("median_of_avg"), F.avg("pct_late").alias("mean_pct_late"))


def hourly(rec: DataFrame, lo: int, hi: int, col: str = "dep_sec") -> DataFrame:
    """Every hour of [lo, hi), empty ones with zeros."""
    hours = rec.sparkSession.range(lo, hi).select(F.col("id").alias("hour"))
    agg = rec.groupBy(F.floor(F.col(col) / 3600).alias("hour")).agg(F.avg("d").alias("avg_delay"), F.count("*").alias("n_trains"))
    return hours.join(agg, "hour", "left").select("hour", F.coalesce("avg_delay", F.lit(0.0)).alias("avg_delay"), F.coalesce("n_trains", F.lit(0)).alias("n_trains"))


def moving(rec: DataFrame, step: int = 900, width: int = 3600, least: int = 1, col: str = "dep_sec") -> DataFrame:
    """Centred windows of `width` seconds every `step`: each row goes to the few steps whose window holds it."""
    first = F.floor((F.col(col) - width // 2) / step) + 1
    last = F.floor((F.col(col) + width // 2) / step)
    return (rec.withColumn("t", F.explode(F.sequence(first, last))).withColumn("t", F.col("t") * step).filter("t >= 0").groupBy("station", "t").agg(F.avg("d").alias("avg_delay"), F.count("*").alias("n")).filter(F.col("n") >= least))


def increases(rec: DataFrame, delay: str = "delay_dep", by: str = "dep_sec") -> DataFrame:
    """Consecutive stops of a train on a day, with the growth of its delay."""
    w = Window.partitionBy("day_date", "train_no").orderBy(by, "station", delay)
    return (rec.filter(F.col(delay).isNotNull()).withColumn("from_station", F.lag("station").over(w)).withColumn("increase", F.col(delay) - F.lag(delay).over(w)).filter("from_station is not null"))


def propagation_stations(rec: DataFrame, min_increase: int = 60, least: int = 3) -> DataFrame:
    trips = rec.groupBy("station").agg(F.count("*").alias("n_trips"))
    hit = increases(rec).filter(F.col("increase") > min_increase).groupBy("station").agg(
        F.count("*").alias("incidents"), F.sum("increase").cast("long").alias("total_delay"), F.countDistinct("train_no").alias("n_trains"), F.countDistinct("day_date").alias("n_days"))
    return hit.filter(F.col("incidents") >= least).join(trips, "station").withColumns({"incidents_per_1k": F.col("incidents") * 1000.0 / F.col("n_trips"), "delay_per_trip": F.col("total_delay") / F.col("n_trips")})


def propagation_segments(rec: DataFrame, min_increase: int = 60, least: int = 3) -> DataFrame:
    up = F.col("increase") > min_increase
    return (increases(rec).groupBy("from_station", "station").agg(F.count("*").alias("n_trips"), F.count_if(up).alias("incidents"), F.coalesce(F.sum(F.when(up, F.col("increase"))), F.lit(0)).cast("long").alias("total_delay"))
            .filter(F.col("incidents") >= least))


def most_common(df: DataFrame, key: str, col: str) -> DataFrame:
    """The commonest value for each key, the least among equals."""
    return df.filter(F.col(col).isNotNull()).groupBy(key, col).agg(F.count("*").alias("c")).groupBy(key).agg(F.min(F.struct((-F.col("c")).alias("c"), F.col(col).alias("v")))["v"].alias(col))


def offenders(rec: DataFrame, late: float = 5.0, cap: float = 30.0, least_days: int = 3) -> DataFrame:
    """Two levels: each train, station and day, then the mean of the days."""
    d = F.least(F.greatest(F.col("delay_arr") / 60, F.lit(0.0)), F.lit(cap))
    day = rec.filter("delay_arr is not null").withColumn("d", d).groupBy("train_no", "station", "day_date").agg(
        F.sum("d").alias("s"), F.max("d").alias("mx"), F.count("*").alias("n"), F.count_if(F.col("d") > late).alias("n_late"))
    return day.groupBy("train_no", "station").agg(
        F.count("*").alias("days_seen"), F.avg(F.col("n_late") * 100.0 / F.col("n")).alias("pct_late"), F.avg(F.col("s") / F.col("n")).alias("avg_delay"), F.avg("mx").alias("max_delay"),
        F.max("mx").alias("worst"), F.sum("n").cast("long").alias("total_stops")).filter(F.col("days_seen") >= least_days)


def offender_days(rec: DataFrame, late: float = 5.0, cap: float = 30.0, least_days: int = 3) -> DataFrame:
    """Each train at each station with its days in order, as structs: day, mean and greatest delay, stops, late ones. A train's days at a station bound the array."""
    d = F.least(F.greatest(F.col("delay_arr") / 60, F.lit(0.0)), F.lit(cap))
    day = rec.filter("delay_arr is not null and day_date is not null").withColumn("d", d).groupBy("train_no", "station", "day_date").agg(
        F.avg("d").alias("avg_delay"), F.max("d").alias("max_delay"), F.count("*").alias("n"), F.count_if(F.col("d") > late).alias("n_late"))
    days = F.sort_array(F.collect_list(F.struct("day_date", "avg_delay", "max_delay", "n", "n_late")))
    return day.groupBy("train_no", "station").agg(days.alias("days")).filter(F.size("days") >= least_days)


def with_relation(trains: DataFrame, rec: DataFrame) -> DataFrame:
    """trains with their commonest relation, the least of equals; null where none is known."""
    return trains.join(most_common(rec.join(trains.select("train_no"), "train_no", "left_semi"), "train_no", "relation"), "train_no", "left")


def daily_delay(rec: DataFrame) -> DataFrame:
    return rec.groupBy("day_date").agg(F.count("*").alias("n"), F.avg("d").alias("avg_delay"), F.percentile("d", F.lit(0.5)).alias("median_delay"), F.avg((F.col("d") > 1).cast("int") * 100.0).alias("pct_late"))


def correlations(daily: DataFrame, weather: DataFrame, factors: list[str], measures: list[str], least: int = 3, constant: float | None = 0.0) -> DataFrame:
    """Every factor with every measure over the days, in one pass. constant: what stands where a side does not vary; None leaves such rows out."""
    both = daily.join(weather, "day_date")
    stats = both.agg(*[safe_corr(F.col(f), F.col(m)).alias(f"{f}|{m}") for f in factors for m in measures], *[F.count(F.when(F.col(f).isNotNull() & F.col(m).isNotNull(), 1)).alias(f"n|{f}|{m}") for f in factors for m in measures])
    rows = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(m).alias("measure"), F.col(f"`n|{f}|{m}`").alias("n"), F.round(F.col(f"`{f}|{m}`"), 3).alias("r")) for f in factors for m in measures])
    out = stats.select(F.inline(rows)).filter(F.col("n") >= least)
    if constant == 0.0:
        return out
    spread = lambda x, y: F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x).cast("double")))
    varies = both.agg(*[(F.coalesce(spread(f, m) * spread(m, f), F.lit(0.0)) > 0).alias(f"{f}|{m}") for f in factors for m in measures])
    flags = varies.select(F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(m).alias("measure"), F.col(f"`{f}|{m}`").alias("varies")) for f in factors for m in measures])))
    met = out.join(F.broadcast(flags), ["factor", "measure"])  # a row for each factor and measure
    return met.filter("varies").drop("varies") if constant is None else met.withColumn("r", F.when(F.col("varies"), F.col("r")).otherwise(constant)).drop("varies")


def compare_weather(daily: DataFrame, weather: DataFrame, least: int = 5) -> DataFrame:
    """Mean delay on days that are and are not so; only where both have enough days."""
    both = daily.join(weather, "day_date")
    tests = {"rain": F.col("rain") >= 1, "wind": F.col("wind") >= 40, "cold": F.col("temp") < 5}
    parts = [F.struct(F.lit(k).alias("factor"), F.col(f"{k}_y").alias("avg_yes"), F.col(f"{k}_n").alias("avg_no"), F.col(f"{k}_ny").alias("n_yes"), F.col(f"{k}_nn").alias("n_no")) for k in tests]
    agg = both.agg(*[x for k, t in tests.items() for x in (F.avg(F.when(t, F.col("avg_delay"))).alias(f"{k}_y"), F.avg(F.when(~t, F.col("avg_delay"))).alias(f"{k}_n"), F.count_if(t).alias(f"{k}_ny"), F.count_if(~t).alias(f"{k}_nn"))])
    return agg.select(F.inline(F.array(*parts))).filter((F.col("n_yes") >= least) & (F.col("n_no") >= least))


def rain_sensitive(rec: DataFrame, weather: DataFrame, rain: float = 2.0, least_days: int = 5, least_rainy: int = 3, least_dry: int = 3, k: int = 30) -> DataFrame:
    """Trains by their mean daily delay on rainy over dry days."""
    day = rec.groupBy("train_no", "day_date").agg(F.avg("d").alias("m")).join(weather, "day_date")
    wet = F.col("rain") >= rain
    agg = day.groupBy("train_no").agg(F.count("*").alias("n_days"), F.count_if(wet).alias("n_rainy"), F.count_if(~wet).alias("n_dry"), F.avg(F.when(wet, F.col("m"))).alias("rainy"), F.avg(F.when(~wet, F.col("m"))).alias("dry"))
    return (agg.filter((F.col("n_days") >= least_days) & (F.col("n_rainy") >= least_rainy) & (F.col("n_dry") >= least_dry)).withColumn("ratio", F.round(F.col("rainy") / F.greatest("dry", F.lit(0.1)), 6))
            .orderBy(F.desc("ratio"), "train_no").limit(k))


def wind_sensitive(rec: DataFrame, weather: DataFrame, wind: float = 40.0, least_days: int = 5, k: int = 30) -> DataFrame:
    """Trains by their mean daily delay on windy over calm days; only where the calm mean is above 0.1 minutes."""
    day = rec.groupBy("train_no", "day_date").agg(F.avg("d").alias("m")).join(weather, "day_date")
    blows = F.col("wind") >= wind
    agg = day.groupBy("train_no").agg(F.count("*").alias("n_days"), F.avg(F.when(blows, F.col("m"))).alias("windy"), F.avg(F.when(~blows, F.col("m"))).alias("calm"))
    return (agg.filter((F.col("n_days") >= least_days) & (F.col("calm") > 0.1) & F.col("windy").isNotNull()).withColumn("ratio", F.round(F.col("windy") / F.col("calm"), 6))
            .orderBy(F.desc("ratio"), "train_no").limit(k))


def hourly_weather(rec: DataFrame, weather: DataFrame, factor: str, col: str = "dep_sec", least: int = 5) -> DataFrame:
    """For each hour the mean of the days' mean delays, the mean of a factor of weather (day_date, hour, ...), the share
    of late records over all days, and the correlation over the days if there are enough of them."""
    hour = F.floor(F.col(col) / 3600).cast("int")
    day = rec.groupBy("day_date", hour.alias("hour")).agg(F.avg("d").alias("m"), F.count("*").alias("n"), F.count_if(F.col("d") > 1).alias("late"))
    return (day.join(weather.select("day_date", "hour", F.col(factor).alias("f")), ["day_date", "hour"]).groupBy("hour")
            .agg(F.count("*").alias("n_days"), F.avg("m").alias("avg_delay"), F.avg("f").alias("avg_factor"), (F.sum("late") * 100.0 / F.sum("n")).alias("pct_late"), F.when(F.count("*") >= least, safe_corr(F.col("f"), F.col("m"))).alias("r")))


def cancelled(scheduled: DataFrame, observed: DataFrame, least_stops: int = 2) -> DataFrame:
    """Scheduled trains (day_date, train_no, stops) of enough stops that were not observed that day."""
    return scheduled.filter(F.size("stops") >= least_stops).join(observed.select("day_date", "train_no").distinct(), ["day_date", "train_no"], "left_anti")


def cancelled_daily(scheduled: DataFrame, observed: DataFrame, least_stops: int = 2, suspicious: float = 30.0) -> DataFrame:
    gone = cancelled(scheduled, observed, least_stops).groupBy("day_date").agg(F.count("*").alias("deleted"), F.sum(F.size("stops")).cast("long").alias("stops"))
    all_ = scheduled.filter(F.size("stops") >= least_stops).groupBy("day_date").agg(F.count("*").alias("scheduled"))
    out = all_.join(gone, "day_date", "left").withColumns({"deleted": F.coalesce("deleted", F.lit(0)), "stops": F.coalesce("stops", F.lit(0))})
    return out.withColumn("pct", F.col("deleted") * 100.0 / F.col("scheduled")).withColumn("suspicious", F.col("pct") > suspicious)


def cancelled_hourly(gone: DataFrame) -> DataFrame:
    """Cancelled trains (with an hour) in each of the 24 hours; 0 where there are none."""
    n = gone.groupBy("hour").agg(F.count("*").alias("n"))
    return gone.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(n, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("deleted"))


def cancelled_segments(gone: DataFrame) -> DataFrame:
    """Undirected consecutive stops of the cancelled trains."""
    pairs = gone.select(F.explode(F.arrays_zip(F.slice("stops", 1, F.size("stops") - 1).alias("x"), F.slice("stops", 2, F.size("stops") - 1).alias("y"))).alias("p"))
    return pairs.groupBy(F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b")).agg(F.count("*").alias("n"))
