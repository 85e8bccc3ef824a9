"""Registered queries of filters, lookups and report tails, over records with missing clocks, early trains and unknown names."""

from __future__ import annotations

from pyspark.sql import functions as F

from railspan.functions import calendar as cal
from railspan.operators import connections as co
from railspan.operators import filters as fi
from railspan.operators import network as nw
from railspan.operators import punctuality as pu
from railspan.operators import reports as re
from railspan.operators import search as se
from railspan.plans import bridge as b
from railspan.plans.registry import _conn, _reached, query, r


def rough(s, d):
    """Records as a source may have them: clocks, delays and relations can be missing, trains early; departures follow arrivals."""
    e, i = b.table(s, d, "events"), F.col("event_id")
    arr = (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("long")
    return e.select(
        i.alias("rec_id"), F.to_date("ts").alias("day_date"), F.weekday("ts").alias("dow"), F.col("event_type").alias("station"), F.col("user_id").cast("string").alias("train_no"),
        F.concat(F.lit("OP"), (F.col("user_id") % 3).cast("string")).alias("operator"), F.when(F.col("user_id") % 20 != 7, F.concat(F.lit("L"), (F.col("user_id") % 20).cast("string"))).alias("relation"),
        F.when(i % 11 != 0, arr).alias("arr_sec"), F.when(i % 13 != 0, arr + 60 * (i % 4)).alias("dep_sec"),
        F.when(i % 17 != 0, (i * 37) % 600 - 120).alias("delay_arr"), F.when(i % 19 != 0, (i * 53) % 240 - 30).alias("delay_dep"))


ROUGH = """rough AS (SELECT event_id AS rec_id, CAST(ts AS DATE) AS day_date, CAST(isodow(ts) - 1 AS INTEGER) AS dow, event_type AS station, CAST(user_id AS VARCHAR) AS train_no, 'OP' || CAST(user_id % 3 AS VARCHAR) AS operator,
  CASE WHEN user_id % 20 <> 7 THEN 'L' || CAST(user_id % 20 AS VARCHAR) END AS relation, CASE WHEN event_id % 11 <> 0 THEN hour(ts) * 3600 + minute(ts) * 60 END AS arr_sec,
  CASE WHEN event_id % 13 <> 0 THEN hour(ts) * 3600 + minute(ts) * 60 + 60 * (event_id % 4) END AS dep_sec, CASE WHEN event_id % 17 <> 0 THEN (event_id * 37) % 600 - 120 END AS delay_arr,
  CASE WHEN event_id % 19 <> 0 THEN (event_id * 53) % 240 - 30 END AS delay_dep FROM events)"""


@query(f"WITH {ROUGH} SELECT station, count(*) AS n, count(arr_sec) AS with_arr FROM rough WHERE (arr_sec // 3600 >= 7 AND arr_sec // 3600 < 9) OR (dep_sec // 3600 >= 7 AND dep_sec // 3600 < 9) GROUP BY 1")
def either_hour(s, d):
    return fi.either_hour(rough(s, d), 7, 9).groupBy("station").agg(F.count("*").alias("n"), F.count("arr_sec").alias("with_arr"))


@query(f"WITH {ROUGH} SELECT station, count(*) AS n, count(*) FILTER (WHERE arr_sec IS NULL) AS unknown FROM rough WHERE arr_sec BETWEEN 25200 AND 32400 OR arr_sec IS NULL GROUP BY 1")
def drop_unless(s, d):
    kept = fi.drop_unless(rough(s, d), F.col("arr_sec").between(25200, 32400))
    return kept.groupBy("station").agg(F.count("*").alias("n"), F.count_if(F.col("arr_sec").isNull()).alias("unknown"))


@query(f"WITH {ROUGH} SELECT operator, count(*) AS n, count(DISTINCT station) AS stations, round(avg(coalesce(delay_arr, 0)), 6) AS mean, CAST(median(coalesce(delay_arr, 0)) AS DOUBLE) AS median FROM rough WHERE operator IN ('OP0', 'OP2') AND relation IN ('L0', 'L1', 'L2', 'L3', 'L6') GROUP BY 1")
def operator_breakdown(s, d):
    some = fi.of_operators(rough(s, d), ["OP0", "OP2"], ["L0", "L1", "L2", "L3", "L6"])
    return re.operator_breakdown(some, F.coalesce("delay_arr", F.lit(0))).withColumns({"mean": r("mean"), "median": F.col("median").cast("double")})


def _on_time(s, d):
    """Missing delays are none; missing clocks fall out of the join."""
    return rough(s, d).withColumns({"delay_arr": F.coalesce("delay_arr", F.lit(0)), "delay_dep": F.coalesce("delay_dep", F.lit(0))})


def _rough_conn(s, d):
    return co.connections(_on_time(s, d))


def _rough_counted(s, d):
    rec = _on_time(s, d)
    return co.counted(rec, rec)


ROUGH_CONN = ROUGH + """, rc0 AS (SELECT a.day_date, a.dow, a.station, a.train_no AS arr_train, d.train_no AS dep_train, a.relation AS rel_arr, d.dep_sec - a.arr_sec AS gap, d.dep_sec // 3600 AS dep_hour,
  a.arr_sec + coalesce(a.delay_arr, 0) AS arr_actual, d.dep_sec + coalesce(d.delay_dep, 0) AS dep_actual FROM rough a JOIN rough d ON a.day_date = d.day_date AND a.station = d.station AND a.train_no <> d.train_no WHERE d.dep_sec - a.arr_sec BETWEEN 120 AND 900),
rc AS (SELECT *, CAST(dep_actual < arr_actual AS INTEGER) AS missed, CAST(dep_actual >= arr_actual AND dep_actual - arr_actual < 120 AS INTEGER) AS close_call FROM rc0)"""


@query(f"WITH {ROUGH_CONN} SELECT station, dow, count(*) AS planned, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(close_call) AS BIGINT) AS close_call FROM rc GROUP BY 1, 2")
def rough_connections(s, d):
    return co.rollup(_rough_counted(s, d), "station", "dow")


@query(f"""WITH {ROUGH_CONN}, late AS (SELECT DISTINCT arr_train FROM rc WHERE missed = 1)
SELECT train_no, day_date, round(avg(coalesce(delay_arr, 0) / 60.0), 6) AS avg_min, round(max(coalesce(delay_arr, 0) / 60.0), 6) AS max_min, count(*) AS n_stops, min(relation) AS relation FROM rough WHERE train_no IN (SELECT arr_train FROM late) GROUP BY 1, 2""")
def train_days(s, d):
    return re.train_days(_rough_conn(s, d), rough(s, d)).withColumns({"avg_min": r("avg_min"), "max_min": r("max_min")})


@query(f"WITH {ROUGH_CONN} SELECT station, arr_train, dep_train, dow, count(*) AS n_occ, CAST(sum(missed) AS BIGINT) AS n_missed, min(rel_arr) AS relation, min(dep_hour) AS hour, round(avg(gap), 6) AS avg_gap FROM rc GROUP BY 1, 2, 3, 4")
def pair_weekdays(s, d):
    return re.pair_weekdays(_on_time(s, d)).withColumnRenamed("hour", "h").select("*", F.col("h").cast("long").alias("hour")).drop("h").withColumn("avg_gap", r("avg_gap"))


@query(f"""WITH {ROUGH_CONN}, p AS (SELECT station, arr_train, dep_train, dow, sum(missed) AS m FROM rc GROUP BY 1, 2, 3, 4), k AS (SELECT *, sum(m) OVER (PARTITION BY station, arr_train, dep_train) AS t, row_number() OVER (PARTITION BY station, arr_train, dep_train ORDER BY m DESC, dow) AS n FROM p)
SELECT station, arr_train, dep_train, CAST(t AS BIGINT) AS missed, dow, round(CAST(m AS DOUBLE) / t, 6) AS share FROM k WHERE n = 1 AND t > 0""")
def weekday_share(s, d):
    return re.weekday_share(re.pair_weekdays(_on_time(s, d), least_missed=1)).withColumn("share", r("share"))


@query(f"""WITH {ROUGH_CONN}, x AS (SELECT station, dep_hour, count(*) AS planned, sum(missed) AS missed FROM rc GROUP BY 1, 2), k AS (SELECT *, missed * 100.0 / planned AS pct, row_number() OVER (PARTITION BY station ORDER BY missed * 100.0 / planned DESC, dep_hour) AS place FROM x WHERE planned >= 3)
SELECT station, dep_hour, planned, CAST(missed AS BIGINT) AS missed, round(pct, 6) AS pct, CAST(place AS INTEGER) AS place FROM k WHERE place <= 3""")
def worst_hours(s, d):
    return re.worst_hours(co.rollup(_rough_counted(s, d), "station", "dep_hour").drop("close_call"), "station").withColumn("pct", r("pct"))


@query(f"WITH {ROUGH_CONN} SELECT station, round(sum(missed) * 1.0 / greatest(count(DISTINCT day_date), 1) * (avg(gap) / 60.0) * 220 / 60, 4) AS hours FROM rc GROUP BY 1")
def yearly_loss(s, d):
    x = _rough_conn(s, d).groupBy("station").agg(F.sum("missed").alias("m"), F.countDistinct("day_date").alias("days"), (F.avg("gap") / 60).alias("w"))
    return x.select("station", r(re.yearly_loss(F.col("m"), F.col("days"), F.col("w")), 4).alias("hours"))


@query(f"WITH {ROUGH_CONN} SELECT station, count(DISTINCT day_date) AS days, round(count(*) * 1.0 / count(DISTINCT day_date), 6) AS planned_a_day, round(sum(missed) * 1.0 / count(DISTINCT day_date), 6) AS missed_a_day FROM rc GROUP BY 1")
def station_averages(s, d):
    return re.station_averages(_rough_conn(s, d)).withColumns({c: r(c) for c in ("planned_a_day", "missed_a_day")})


@query(f"""WITH {ROUGH_CONN}, x AS (SELECT arr_train, count(*) AS planned FROM rc GROUP BY 1 ORDER BY planned DESC, arr_train LIMIT 5)
SELECT arr_train, dep_hour, count(*) AS planned, CAST(sum(missed) AS BIGINT) AS missed FROM rc WHERE arr_train IN (SELECT arr_train FROM x) GROUP BY 1, 2""")
def top_trains_by_hour(s, d):
    c = co.rollup(_rough_counted(s, d), "arr_train", "dep_hour")
    return fi.feed_top(c, co.rollup(c, "arr_train"), "arr_train", 5, F.desc("planned"), F.col("arr_train")).drop("close_call")


@query(f"""WITH {b.DREC}, {b.WEATHER}, t AS (SELECT train_no, day_date, avg(d) AS m FROM drec GROUP BY 1, 2), a AS (SELECT train_no, count(*) AS n_days, avg(m) AS avg, avg(m) FILTER (WHERE rain > 1) AS rainy, avg(m) FILTER (WHERE rain <= 1) AS dry FROM t JOIN weather USING (day_date) GROUP BY 1)
SELECT train_no, n_days, round(avg, 6) AS avg, round(rainy, 6) AS rainy, round(dry, 6) AS dry FROM a WHERE n_days >= 5 AND rainy IS NOT NULL AND dry IS NOT NULL AND avg >= 1 ORDER BY rainy - dry DESC, train_no LIMIT 30""")
def rain_on_page(s, d):
    days = b.rec(s, d).transform(pu.minutes("delay_dep", 0.0, 30.0)).groupBy("train_no", "day_date").agg(F.avg("d").alias("delay"))
    return re.rain_on_page(days, b.weather(s, d)).select("train_no", "n_days", *[r(c).alias(c) for c in ("avg", "rainy", "dry")])


def _gone(s, d):
    return pu.cancelled(b.scheduled(s, d), b.observed(s, d))


@query(f"WITH {b.SCHED} SELECT s AS station, count(*) AS deleted FROM stops JOIN gone ON k = train_no GROUP BY 1")
def cancelled_stations(s, d):
    return re.cancelled_stations(_gone(s, d))


@query(f"""WITH {b.SCHED}, a AS (SELECT day_date, count(*) AS scheduled FROM sched GROUP BY 1), g AS (SELECT day_date, count(*) AS deleted, CAST(sum(c) AS BIGINT) AS stops, CAST(sum((c - 1) * 11) AS BIGINT) AS minutes FROM gone GROUP BY 1)
SELECT day_date, scheduled, coalesce(deleted, 0) AS deleted, coalesce(stops, 0) AS stops, coalesce(minutes, 0) AS minutes, round(coalesce(deleted, 0) * 100.0 / scheduled, 6) AS pct, coalesce(deleted, 0) * 100.0 / scheduled > 30 AS suspicious FROM a LEFT JOIN g USING (day_date)""")
def cancelled_days(s, d):
    minutes = (F.size("stops") - 1) * 11
    return re.cancelled_days(b.scheduled(s, d).filter(F.size("stops") >= 2), _gone(s, d).withColumn("duration_min", minutes)).withColumn("pct", r("pct"))


NAMES = ["Supplier#000000001", "supplier#00000000", "000005", "nothing"]


@query("WITH a(asked) AS (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ") SELECT asked, arg_min(s_suppkey, (lower(s_name) <> lower(asked), s_suppkey)) AS id, arg_min(s_name, (lower(s_name) <> lower(asked), s_suppkey)) AS name FROM a JOIN supplier ON contains(lower(s_name), lower(asked)) GROUP BY 1")
def look_up(s, d):
    names = b.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return fi.look_up(names, s.createDataFrame([(n,) for n in NAMES], "asked string"))


def _named_places(s, d):
    """Names that repeat (the last counts), some without a place."""
    k = F.col("s_suppkey")
    return b.places(s, d).join(b.table(s, d, "supplier").select(k.alias("id")), "id").select(
        (F.col("id") % 70).alias("name"), F.col("id").alias("ordinal"), F.when(F.col("id") % 7 != 0, F.col("lat")).alias("lat"), F.when(F.col("id") % 5 != 0, F.col("lon")).otherwise(0.0).alias("lon"))


NAMED = b.PLACES + ", np AS (SELECT id % 70 AS name, arg_max(lat, id) AS lat, arg_max(lon, id) AS lon FROM places WHERE id % 7 <> 0 AND id % 5 <> 0 GROUP BY 1)"


@query(f"WITH {NAMED} SELECT p_size AS name, count(*) AS n, round(max(lat), 6) AS lat, round(max(lon), 6) AS lon FROM part LEFT JOIN np ON name = p_size GROUP BY 1")
def places_by_name(s, d):
    x = b.table(s, d, "part").select(F.col("p_size").cast("long").alias("name"))
    return fi.with_places(x, _named_places(s, d), "name", "left").groupBy("name").agg(F.count("*").alias("n"), r(F.max("lat")).alias("lat"), r(F.max("lon")).alias("lon")).withColumn("name", F.col("name").cast("int"))


@query(f"WITH {b.EDGES}, {NAMED} SELECT s.name AS src, e.name AS dst, count(*) AS n, round(max(s.lat - e.lat), 6) AS lat, round(max(s.lon - e.lon), 6) AS lon FROM edges JOIN np s ON s.name = src % 90 JOIN np e ON e.name = dst % 90 GROUP BY 1, 2")
def places_of_both_ends(s, d):
    seg = nw.edges(b.stop_times(s, d)).select((F.col("src") % 90).alias("src"), (F.col("dst") % 90).alias("dst"))
    return fi.with_both_places(seg, _named_places(s, d)).groupBy("src", "dst").agg(F.count("*").alias("n"), r(F.max(F.col("src_lat") - F.col("dst_lat"))).alias("lat"), r(F.max(F.col("src_lon") - F.col("dst_lon"))).alias("lon"))


@query("SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_nationkey % 4 <> 1 THEN n_name ELSE 'Unknown' END AS province, CASE WHEN s_nationkey % 4 <> 1 THEN r_name ELSE 'Unknown' END AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def station_enrichment(s, d):
    n = b.table(s, d, "nation").join(b.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("n_nationkey % 4 <> 1")
    stations = b.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("area"))
    return fi.enrich(stations, n.select(F.col("n_nationkey").alias("area"), F.col("n_name").alias("province"), F.col("r_name").alias("region")))


@query("SELECT l_suppkey AS key, CAST(max(l_shipdate) AS DATE) AS day, arg_max(l_quantity, (l_shipdate, l_quantity)) AS last, arg_min(l_quantity, (l_shipdate, l_quantity)) AS first FROM lineitem GROUP BY 1")
def merge_snapshots(s, d):
    x = b.table(s, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_shipdate").alias("day"), F.col("l_quantity").alias("q"))
    last = fi.merge_snapshots(x, "key", "day").select("key", F.to_date("day").alias("day"), F.col("q").alias("last"))
    return last.join(fi.merge_snapshots(x, "key", "day", last=False).select("key", F.col("q").alias("first")), "key")


@query("SELECT s_nationkey AS id, arg_min(s_name, s_suppkey) AS name FROM supplier GROUP BY 1")
def first_names(s, d):
    return fi.first_names(b.table(s, d, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ordinal")))


@query("WITH h(a, z, name) AS (VALUES " + ", ".join(f"(DATE '{a}', DATE '{z}', '{n.replace(chr(39), chr(39) * 2)}')" for a, z, n in cal.SCHOOL_HOLIDAYS)
       + "), x AS (SELECT CAST(DATE '2024-06-01' + CAST(i AS INTEGER) AS DATE) AS day FROM range(500) t(i)) SELECT day, arg_min(name, (a, name)) AS name FROM x LEFT JOIN h ON day BETWEEN a AND z GROUP BY 1")
def holiday_names(s, d):
    days = s.range(500).select(F.date_add(F.lit("2024-06-01").cast("date"), F.col("id").cast("int")).alias("day"))
    return fi.holiday_name(days, cal.school_holidays(s))


@query(f"WITH {b.WEATHER}, w AS (SELECT *, temp - 9 AS snow FROM weather) SELECT count(*) FILTER (WHERE rain > 1) AS rainy, count(*) FILTER (WHERE snow > 0) AS snowy, count(*) AS days FROM w")
def weather_days(s, d):
    return re.weather_days(b.weather(s, d).withColumn("snow", F.col("temp") - 9))


@query(f"WITH {b.EDGES} SELECT from_id, to_id, round(freq, 6) AS freq FROM seg WHERE freq > 0.2 ORDER BY seg.freq DESC, from_id, to_id LIMIT 50")
def busiest_segments(s, d):
    f = nw.segment_frequency(nw.edges(b.stop_times(s, d)), 7).filter("freq > 0.2")
    return fi.page(f, 0, 50, F.desc("freq"), F.col("from_id"), F.col("to_id")).withColumn("freq", r("freq"))


@query(f"""WITH {b.EDGES}, sf AS (SELECT id, sum(freq) AS freq FROM (SELECT from_id AS id, freq FROM seg UNION ALL SELECT to_id, freq FROM seg) GROUP BY 1)
SELECT id, round(freq, 6) AS freq, CASE WHEN freq > 130 THEN 'high' WHEN freq >= 120 THEN 'medium' ELSE 'low' END AS class FROM sf""")
def class_tabs(s, d):
    """Traversals are added up whole and divided once, so that a station at a class's edge has its class."""
    f = nw.station_frequency(nw.segment_frequency(nw.edges(b.stop_times(s, d)))).withColumn("freq", F.col("freq") / 7)
    return f.select("id", r("freq").alias("freq"), re.class_of(F.col("freq"), 130, 120).alias("class"))


@query("""SELECT id, name, score FROM (SELECT s_suppkey AS id, s_name AS name, count(*) FILTER (WHERE l_quantity > 40) + 0.5::DOUBLE * count(*) FILTER (WHERE l_quantity BETWEEN 20 AND 40) AS score, count(*) AS n
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE contains(lower(s_name), '0') GROUP BY 1, 2) ORDER BY score DESC, n DESC, id LIMIT 20 OFFSET 5""")
def ranking_page(s, d):
    q = F.col("l_quantity")
    x = b.table(s, d, "lineitem").join(b.table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).filter(F.contains(F.lower("s_name"), F.lit("0")))
    x = x.groupBy(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).agg((F.count_if(q > 40) + 0.5 * F.count_if(q.between(20, 40))).cast("double").alias("score"), F.count("*").alias("n"))
    return fi.page(x, 5, 20, F.desc("score"), F.desc("n"), F.col("id")).drop("n")


@query(f"WITH {ROUGH}, o AS (SELECT train_no, min(relation) AS relation FROM rough WHERE delay_arr > 300 GROUP BY 1 HAVING count(*) >= 2) SELECT relation, count(*) AS n, string_agg(train_no, ',' ORDER BY train_no) AS trains FROM o GROUP BY 1")
def offenders_by_relation(s, d):
    o = rough(s, d).filter("delay_arr > 300").groupBy("train_no").agg(F.min("relation").alias("relation"), F.count("*").alias("n")).filter("n >= 2")
    return re.by_relation(o)


@query()
def connectivity(s, d):
    """Reach, direct frequency and cardinal reach of each station, with its size class."""
    e = nw.edges(b.stop_times(s, d))
    parts = [se.reach_measures(_reached(s, d), b.places(s, d)).withColumnRenamed("origin", "id"), nw.direct_frequency(e).withColumn("id", F.col("id").cast("string"))]
    all_ = b.places(s, d).select(F.col("id").cast("string").alias("id"))
    for p in parts:
        all_ = all_.join(p, "id", "left")
    return all_.select("id", "reachable", "avg_minutes", "per_hour", "reach_km").fillna(0).withColumn("class", re.class_of(F.col("reachable"), 200, 50))


@query()
def reach_by_area(s, d):
    """Mean number of stations reached from the stations of each area; reach_means adds the travel time."""
    counts = se.reach_counts(_reached(s, d))
    areas = b.places(s, d).select(F.col("id").cast("string").alias("id"), F.col("nation").alias("area"))
    return re.area_means(counts.select(F.col("origin").alias("id"), F.col("reachable").alias("value")), areas)


@query()
def durations_from(s, d):
    """Minutes from the least station to every station: 0 for itself, null where it is not reached."""
    p = b.places(s, d)
    first = p.orderBy("id").limit(1).select("id")
    swept = se.search(se.window_jobs(first, 7, 8), nw.edges(b.stop_times(s, d)), budget=60, paths=False, best=True)
    return re.all_stations(p, swept.select(F.col("station").alias("id"), "minutes"), str(first.first()[0]))


@query("""WITH c AS (SELECT n_nationkey AS service_id, n_nationkey % 5 AS off, DATE '2025-01-01' + n_nationkey * 9 AS a, DATE '2025-03-01' + n_nationkey * 9 AS z FROM nation),
days AS (SELECT CAST(DATE '2025-01-15' + CAST(i AS INTEGER) AS DATE) AS day FROM range(200) t(i)), x AS (SELECT n_nationkey AS service_id, CAST(DATE '2025-02-01' + n_nationkey * 7 AS DATE) AS day, 1 + n_nationkey % 2 AS kind FROM nation),
runs AS (SELECT service_id, day FROM c JOIN days ON day BETWEEN a AND z WHERE isodow(day) <> off + 1 UNION SELECT service_id, day FROM x WHERE kind = 1 AND day IN (SELECT day FROM days))
SELECT CAST(service_id AS VARCHAR) AS service_id, count(*) AS n_days FROM runs WHERE (service_id, day) NOT IN (SELECT (service_id, day) FROM x WHERE kind = 2) GROUP BY 1""")
def service_days(s, d):
    k, day = F.col("n_nationkey"), lambda start, step: F.date_add(F.lit(start).cast("date"), (F.col("n_nationkey") * step).cast("int"))
    n = b.table(s, d, "nation")
    weekdays = "monday tuesday wednesday thursday friday saturday sunday".split()
    calendar = n.select(k.cast("string").alias("service_id"), day("2025-01-01", 9).alias("start_date"), day("2025-03-01", 9).alias("end_date"), *[(k % 5 != i).cast("int").alias(x) for i, x in enumerate(weekdays)])
    exceptions = n.select(k.cast("string").alias("service_id"), day("2025-02-01", 7).alias("date"), (1 + k % 2).alias("exception_type"))
    return cal.service_day_counts(calendar, exceptions, cal.date_range(s, "2025-01-15", "2025-08-02"))
