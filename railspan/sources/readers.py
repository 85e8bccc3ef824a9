"""Readers with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railspan.functions.scalars import station_key, whole_number
from railspan.operators.asof import asof

PUNCTUALITY = "train_no string, train_serv string, relation string, ptcar_lg_nm_nl string, planned_time_arr string, planned_time_dep string, delay_arr string, delay_dep string"
GTFS = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, location_type int, parent_station string",
    "trips": "trip_id string, service_id string, trip_short_name string",
    "stop_times": "trip_id string, stop_id string, stop_sequence int, arrival_time long, departure_time long, pickup_type int, drop_off_type int",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date date, end_date date",
    "calendar_dates": "service_id string, date date, exception_type int",
}
POINTS = ("features array<struct<properties:struct<ptcarid:string,longnamedutch:string,geo_point_2d:struct<lat:double,lon:double>>,"
          "geometry:struct<type:string,coordinates:array<double>>>>")
SEGMENTS = ("features array<struct<properties:struct<stationfrom_id:string,stationto_id:string,stationfrom_name:string,stationto_name:string>,"
            "geometry:struct<type:string,coordinates:array<string>>>>")
POLYGONS = "features array<struct<properties:struct<name:string>,geometry:struct<type:string,coordinates:array<string>>>>"
DAILY = ("temperature_2m_mean", "precipitation_sum", "rain_sum", "snowfall_sum", "wind_speed_10m_max", "wind_gusts_10m_max")
HOURLY = ("precipitation", "rain", "snowfall", "wind_speed_10m", "wind_gusts_10m", "temperature_2m")


def read_gtfs(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of a feed."""
    return spark.read.schema(GTFS[name]).parquet(f"{path}/{name}")


def read_operators(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of all operators' feeds, below operator=.../snapshot_date=... folders, which become columns and prune."""
    return spark.read.schema(GTFS[name] + ", operator string, snapshot_date date").parquet(f"{path}/{name}")


def latest_snapshot(active: DataFrame, wanted: DataFrame, days_back: int = 9) -> DataFrame:
    """For each wanted day the latest snapshot_date, up to days_back before it, with a service that runs."""
    live = active.filter("n_services > 0").select(F.col("snapshot_date").alias("on")).distinct()
    met = asof(wanted.select("day_date", F.col("day_date").alias("on")).distinct(), live, [], "on")
    return met.select("day_date", F.when(F.col("match.on") >= F.date_sub("day_date", days_back), F.col("match.on")).alias("snapshot_date"))


def read_punctuality(spark: SparkSession, path: str) -> DataFrame:
    """Typed records of files below day_date=... folders; delays to whole seconds, missing ones 0."""
    raw = spark.read.schema(PUNCTUALITY + ", day_date date").json(path)
    return raw.select(
        "day_date", F.weekday("day_date").alias("dow"), station_key(F.col("ptcar_lg_nm_nl")).alias("station"), F.trim("train_no").alias("train_no"), "train_serv", "relation",
        "planned_time_arr", "planned_time_dep", F.coalesce(whole_number(F.col("delay_arr")), F.lit(0)).alias("delay_arr"), F.coalesce(whole_number(F.col("delay_dep")), F.lit(0)).alias("delay_dep"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Operational points: id, name, lat, lon."""
    f = spark.read.schema(POINTS).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at, c = F.col("f.properties.geo_point_2d"), F.col("f.geometry.coordinates")
    return f.select(F.col("f.properties.ptcarid").alias("id"), F.col("f.properties.longnamedutch").alias("name"), F.coalesce(at["lat"], c[1]).alias("lat"), F.coalesce(at["lon"], c[0]).alias("lon"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Track segments: from_id, to_id, names and coords as lat, lon; of several lines the longest."""
    f = spark.read.schema(SEGMENTS).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    line, lines = "array<array<double>>", "array<array<array<double>>>"
    text = F.concat(F.lit("["), F.concat_ws(",", "f.geometry.coordinates"), F.lit("]"))
    parts = F.when(F.col("f.geometry.type") == "MultiLineString", F.from_json(text, lines)).otherwise(F.array(F.from_json(text, line)))
    longest = F.element_at(F.sort_array(F.transform(parts, lambda p: F.struct(F.size(p).alias("n"), p.alias("p"))), asc=False), 1)["p"]
    p = F.col("f.properties")
    return f.select(p["stationfrom_id"].alias("from_id"), p["stationto_id"].alias("to_id"), p["stationfrom_name"].alias("from_name"), p["stationto_name"].alias("to_name"),
                    F.transform(longest, lambda c: F.struct(c[1].alias("lat"), c[0].alias("lon"))).alias("coords"))


def read_provinces(spark: SparkSession, path: str) -> DataFrame:
    """Polygons: name and rings, each an array of [lon, lat]."""
    f = spark.read.schema(POLYGONS).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    text = F.concat(F.lit("["), F.concat_ws(",", "f.geometry.coordinates"), F.lit("]"))
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))).otherwise(F.from_json(text, "array<array<array<double>>>"))
    return f.select(F.col("f.properties.name").alias("name"), rings.alias("rings"))


def read_weather(spark: SparkSession, path: str, hourly: bool = False) -> DataFrame:
    """A series of arrays as rows: (date, ...) or (date, hour, ...); hourly nulls are 0, temperatures 10."""
    part, names = ("hourly", HOURLY) if hourly else ("daily", DAILY)
    raw = spark.read.schema(f"{part} struct<time:array<string>,{','.join(f'{n}:array<double>' for n in names)}>").option("multiLine", True).json(path)
    rows = raw.select(F.explode(F.arrays_zip(*[F.col(f"{part}.{n}").alias(n) for n in ("time", *names)])).alias("w")).select("w.*")
    day = F.substring("time", 1, 10).cast("date").alias("date")
    if not hourly:
        return rows.select(day, *names)
    return rows.select(day, F.substring("time", 12, 2).cast("int").alias("hour"), *[F.coalesce(n, F.lit(10.0 if n == "temperature_2m" else 0.0)).alias(n) for n in names])


def service_day(asked: Column) -> Column:
    """The day whose records a fetch at a time returns: two days before it."""
    return F.date_sub(asked, 2)


def write_json(df: DataFrame, path: str) -> None:
    """Lines of JSON; nulls are written, so each line has all fields."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_partitioned(df: DataFrame, path: str, by: str = "day_date") -> None:
    """Parquet by day; each day's rows meet first, so a day is few files."""
    df.repartition(by).write.partitionBy(by).mode("overwrite").parquet(path)
