"""Registered queries over files in the sources' own formats, which are written from the given tables and read by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspan.functions import scalars as sc
from railspan.operators import geometry as ge
from railspan.plans import bridge as b
from railspan.plans.details import _SHAPES_SQL, _shapes
from railspan.plans.registry import query, r
from railspan.plans.reports import ROUGH, rough
from railspan.sources import readers
from railspan.sources.scratch import shared_dir


def _folder(s):
    return f"{shared_dir(s)}/files-{uuid.uuid4().hex}"


def _documents(features: DataFrame, by: str, at: str, before: str = '{"features":[', after: str = "]}") -> str:
    """features (by, feature: JSON) as one document a file, for each value of by."""
    docs = features.groupBy(by).agg(F.concat(F.lit(before), F.array_join(F.sort_array(F.collect_list("feature")), ","), F.lit(after)).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(at)
    return at


def _feature(properties, kind, coordinates):
    return F.to_json(F.struct(properties.alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"))).alias("feature")


def _calls(s, d):
    li = b.table(s, d, "lineitem")
    minute = ((F.col("l_orderkey") * 37) % 1200 + F.col("l_linenumber") * 11).cast("long")
    return li.select(F.col("l_orderkey").cast("string").alias("trip_id"), F.col("l_suppkey").cast("string").alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"), (minute * 60).alias("arrival_time"),
                     (minute * 60).alias("departure_time"), (F.col("l_linenumber") % 2).cast("int").alias("pickup_type"), F.lit(0).alias("drop_off_type"), F.concat(F.lit("OP"), (F.col("l_partkey") % 3).cast("string")).alias("operator"),
                     F.make_date(F.lit(2025), (1 + F.col("l_partkey") % 2).cast("int"), F.lit(1)).alias("snapshot_date"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS stop_id, count(*) AS n, CAST(min((l_orderkey * 37) % 1200 + l_linenumber * 11) * 60 AS BIGINT) AS first, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS boards FROM lineitem GROUP BY 1")
def feed_calls(s, d):
    """Calls by stop from a feed's table."""
    at = _folder(s)
    _calls(s, d).drop("operator", "snapshot_date").write.parquet(f"{at}/stop_times")
    x = readers.read_gtfs(s, at, "stop_times")
    return x.groupBy("stop_id").agg(F.count("*").alias("n"), F.min("departure_time").alias("first"), F.count_if(F.col("pickup_type") == 0).alias("boards"))


@query("SELECT 'OP' || CAST(l_partkey % 3 AS VARCHAR) AS operator, count(*) AS n, count(DISTINCT l_suppkey) AS stops FROM lineitem WHERE l_partkey % 2 = 1 AND l_partkey % 3 <> 0 GROUP BY 1")
def feeds_of_operators(s, d):
    """One snapshot of two operators: folders of others are not read."""
    at = _folder(s)
    _calls(s, d).write.partitionBy("operator", "snapshot_date").parquet(f"{at}/stop_times")
    x = readers.read_operators(s, at, "stop_times").filter("operator in ('OP1', 'OP2') and snapshot_date = date'2025-02-01'")
    return x.groupBy("operator").agg(F.count("*").alias("n"), F.countDistinct("stop_id").alias("stops"))


@query(f"WITH {ROUGH} SELECT upper(station) AS station, dow, count(*) AS n, CAST(sum(coalesce(CASE WHEN rec_id % 7 <> 0 THEN delay_arr END, 0)) AS BIGINT) AS arr, CAST(sum(coalesce(delay_dep, 0)) AS BIGINT) AS dep, count(*) FILTER (WHERE arr_sec IS NULL) AS unclocked FROM rough WHERE day_date = DATE '2024-01-10' OR day_date > DATE '2024-01-25' GROUP BY 1, 2")
def punctuality_files(s, d):
    """Records from files by day with all values as text, some unreadable; one of the days is what a fetch two days later returns."""
    at = _folder(s)
    clock = lambda c: F.format_string("%02d:%02d:%02d", F.floor(F.col(c) / 3600), F.floor(F.col(c) / 60) % 60, F.col(c) % 60)
    raw = rough(s, d).select(
        F.concat(F.lit(" "), "train_no").alias("train_no"), F.lit("T").alias("train_serv"), "relation", F.concat(F.lit(" "), "station", F.lit("  ")).alias("ptcar_lg_nm_nl"), F.when(F.col("arr_sec").isNotNull(), clock("arr_sec")).alias("planned_time_arr"),
        F.when(F.col("dep_sec").isNotNull(), clock("dep_sec")).alias("planned_time_dep"), F.when(F.col("rec_id") % 7 == 0, "unknown").otherwise(F.concat(F.col("delay_arr").cast("string"), F.lit(".0"))).alias("delay_arr"), F.col("delay_dep").cast("string").alias("delay_dep"), "day_date")
    raw.write.partitionBy("day_date").json(at)
    x = readers.read_punctuality(s, at).filter((F.col("day_date") == readers.service_day(F.lit("2024-01-12").cast("date"))) | (F.col("day_date") > "2024-01-25"))
    return x.groupBy("station", "dow").agg(F.count("*").alias("n"), F.sum("delay_arr").alias("arr"), F.sum("delay_dep").alias("dep"), F.count_if(sc.clock_seconds(F.col("planned_time_arr")).isNull()).alias("unclocked"))


@query(f"WITH {b.PLACES} SELECT CAST(id AS VARCHAR) AS id, 'P' || CAST(id AS VARCHAR) AS name, round(CASE WHEN id % 3 = 0 THEN lat - 1 ELSE lat END, 6) AS lat, round(CASE WHEN id % 3 = 0 THEN lon - 1 ELSE lon END, 6) AS lon FROM places")
def point_files(s, d):
    """Operational points; every third has no place of its own, only its geometry's."""
    at, p = _folder(s), b.places(s, d)
    own = F.when(F.col("id") % 3 != 0, F.struct("lat", "lon"))
    props = F.struct(F.col("id").cast("string").alias("ptcarid"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("longnamedutch"), own.alias("geo_point_2d"))
    x = readers.read_points(s, _documents(p.select("nation", _feature(props, "Point", F.array(F.col("lon") - 1, F.col("lat") - 1))), "nation", at))
    return x.select("id", "name", r("lat").alias("lat"), r("lon").alias("lon"))


@query(f"""WITH {b.PLACES}, l AS (SELECT p.id, q.id AS other, sqrt(pow(p.lat - q.lat, 2) + pow(p.lon - q.lon, 2)) AS len, p.id % 4 = 0 AS multi FROM places p JOIN places q ON q.id = p.id + 1)
SELECT CAST(id AS VARCHAR) AS from_id, CAST(other AS VARCHAR) AS to_id, CASE WHEN multi THEN 3 ELSE 2 END AS n, round(len / ((1 / 111.0::DOUBLE + 1 / 71.0::DOUBLE) / 2), 5) AS km FROM l""")
def segment_files(s, d):
    """Track segments; some are several lines, of which the longest counts."""
    at, p = _folder(s), b.places(s, d)
    q = p.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    met = p.join(q, "id")
    names = F.struct(F.col("id").cast("string").alias("stationfrom_id"), F.col("other").cast("string").alias("stationto_id"), F.lit("a").alias("stationfrom_name"), F.lit("b").alias("stationto_name"))
    one, two = F.array("lon", "lat"), F.array("ob", "lb")
    middle = F.array((F.col("lon") + F.col("ob")) / 2, (F.col("lat") + F.col("lb")) / 2)
    lines = met.filter("id % 4 <> 0").select("nation", _feature(names, "LineString", F.array(one, two)))
    many = met.filter("id % 4 = 0").select("nation", _feature(names, "MultiLineString", F.array(F.array(two, one), F.array(one, middle, two))))
    x = readers.read_segments(s, _documents(lines.union(many), "nation", at))
    return x.select("from_id", "to_id", F.size("coords").alias("n"), F.round(ge.length_km(F.col("coords")), 5).alias("km"))


@query(f"WITH {_SHAPES_SQL} SELECT name, CASE WHEN ascii(name) % 2 = 0 THEN 2 ELSE 1 END AS rings, CAST(count(*) * CASE WHEN ascii(name) % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS corners, round(min(ax), 6) AS west, round(max(ay), 6) AS north FROM side GROUP BY 1")
def province_files(s, d):
    """Polygons, some of two parts."""
    at, x = _folder(s), _shapes(s, d)
    props, even = F.struct("name"), F.ascii("name") % 2 == 0
    plain = x.filter(~even).select("name", _feature(props, "Polygon", F.col("rings")))
    parts = x.filter(even).select("name", _feature(props, "MultiPolygon", F.array("rings", "rings")))
    y = readers.read_provinces(s, _documents(plain.union(parts), "name", at))
    corners = F.flatten("rings")
    return y.select("name", F.size("rings").alias("rings"), F.size(corners).cast("long").alias("corners"), r(F.array_min(F.transform(corners, lambda p: p[0]))).alias("west"), r(F.array_max(F.transform(corners, lambda p: p[1]))).alias("north"))


def _series(df, part, names, by, at):
    """One document for each value of by: arrays by name, in order of time."""
    rows = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("time", *names))).alias("x"))
    field = lambda n: F.transform("x", lambda v: v[n]).alias(n)
    doc = F.to_json(F.struct(F.struct(*map(field, ("time", *names))).alias(part)), {"ignoreNullFields": "false"})
    rows.select(doc.alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    return at


@query(f"WITH {b.WEATHER} SELECT day_date AS date, round(temp, 3) AS temp, CASE WHEN rain > 0 THEN rain END AS rain, wind FROM weather")
def weather_files(s, d):
    """Daily weather from arrays, a file a week; days without rain are missing in it."""
    w = b.weather(s, d).select(F.weekofyear("day_date").alias("week"), F.col("day_date").cast("string").alias("time"), F.col("temp").alias("temperature_2m_mean"), F.when(F.col("rain") > 0, F.col("rain")).alias("precipitation_sum"), F.col("wind").alias("wind_speed_10m_max"))
    w = w.withColumns({n: F.lit(None).cast("double") for n in readers.DAILY if n not in w.columns})
    x = readers.read_weather(s, _series(w, "daily", readers.DAILY, "week", _folder(s)))
    return x.select("date", F.col("temperature_2m_mean").alias("temp"), F.col("precipitation_sum").alias("rain"), F.col("wind_speed_10m_max").alias("wind"))


@query("SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, CAST(CASE WHEN sum(event_id) % 3 = 0 THEN 0 ELSE sum(event_id) % 7 END AS DOUBLE) AS rain, CAST(CASE WHEN sum(event_id) % 5 = 0 THEN 10 ELSE count(*) END AS DOUBLE) AS temp FROM events GROUP BY 1, 2")
def hourly_weather_files(s, d):
    """Hourly weather; what is missing is no rain, and ten degrees."""
    n = F.sum("event_id")
    e = b.table(s, d, "events").groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("h")).agg(F.when(n % 3 != 0, (n % 7).cast("double")).alias("rain"), F.when(n % 5 != 0, F.count("*").cast("double")).alias("temperature_2m"))
    w = e.select("day", F.concat(F.col("day").cast("string"), F.lit("T"), F.lpad(F.col("h").cast("string"), 2, "0"), F.lit(":00")).alias("time"), "rain", "temperature_2m")
    w = w.withColumns({c: F.lit(None).cast("double") for c in readers.HOURLY if c not in w.columns})
    x = readers.read_weather(s, _series(w, "hourly", readers.HOURLY, "day", _folder(s)), hourly=True)
    return x.select("date", "hour", "rain", F.col("temperature_2m").alias("temp"))


@query(f"WITH {ROUGH} SELECT rec_id, relation, delay_arr FROM rough")
def json_lines(s, d):
    """Rows as lines of JSON and back: each line names all fields, missing ones too."""
    at = _folder(s)
    readers.write_json(rough(s, d).select("rec_id", "relation", "delay_arr"), at)
    lines = s.read.text(at).filter(F.col("value").contains('"relation":') & F.col("value").contains('"delay_arr":'))
    return lines.select(F.from_json("value", "rec_id long, relation string, delay_arr long").alias("v")).select("v.*")
