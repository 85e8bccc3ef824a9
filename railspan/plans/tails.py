"""Registered queries of cut and ordered lists, daily breakdowns, areas of lines and rounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from railspan.functions import scalars as sc
from railspan.operators import covers as cv
from railspan.operators import network as nw
from railspan.operators import punctuality as pu
from railspan.operators import reports as re
from railspan.operators import search as se
from railspan.plans import bridge as b
from railspan.plans.details import _SHAPES_SQL, _shapes
from railspan.plans.registry import _DAILY, _d, _reached, query, r
from railspan.plans.reports import ROUGH, _gone, rough


@query(f"""WITH {b.SCHED}, x AS (SELECT day_date, train_no, (c - 1) * 11 AS minutes, c FROM gone ORDER BY day_date, train_no LIMIT 500), t AS (SELECT * FROM x ORDER BY minutes DESC, day_date, train_no LIMIT 200)
SELECT day_date, train_no, minutes AS duration_min, CAST(c AS INTEGER) AS n_stops, (SELECT s FROM stops WHERE k = train_no ORDER BY n, s LIMIT 1) AS first_station, (SELECT s FROM stops WHERE k = train_no ORDER BY n DESC, s DESC LIMIT 1) AS last_station FROM t""")
def cancelled_trains(s, d):
    """The first 500 cancelled trains by day and number, of these the 200 that took longest."""
    return re.cancelled_trains(_gone(s, d).withColumn("duration_min", ((F.size("stops") - 1) * 11).cast("long")))


@query(f"WITH {b.SCHED} SELECT s AS station, count(*) AS deleted FROM stops JOIN gone ON k = train_no GROUP BY 1 ORDER BY deleted DESC, station LIMIT 100")
def cancelled_stations_top(s, d):
    return re.cancelled_stations(_gone(s, d)).orderBy(F.desc("deleted"), "station").limit(100)


@query(f"WITH {b.SCHED}, p AS (SELECT k, s, lead(s) OVER (PARTITION BY k ORDER BY n, s) AS t FROM stops) SELECT least(s, t) AS a, greatest(s, t) AS b, count(*) AS n FROM p JOIN gone ON train_no = k WHERE t IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 100")
def cancelled_segments_top(s, d):
    return pu.cancelled_segments(_gone(s, d)).orderBy(F.desc("n"), "a", "b").limit(100)


@query(f"""WITH {ROUGH}, x AS (SELECT train_no, station, day_date, least(greatest(CAST(delay_arr AS DOUBLE) / 60, 0), 30) AS d FROM rough WHERE delay_arr IS NOT NULL), y AS (SELECT train_no, station, day_date, avg(d) AS a, max(d) AS mx, count(*) AS n, count(*) FILTER (WHERE d > 5) AS late FROM x GROUP BY 1, 2, 3),
z AS (SELECT *, row_number() OVER (PARTITION BY train_no, station ORDER BY day_date) AS place, count(*) OVER (PARTITION BY train_no, station) AS days FROM y) SELECT train_no, station, place, day_date, round(a, 6) AS avg_delay, round(mx, 6) AS max_delay, n, late AS n_late FROM z WHERE days >= 3""")
def offender_days(s, d):
    """The days of each repeat offender in order, from the array that the report has."""
    x = pu.offender_days(rough(s, d)).select("train_no", "station", F.posexplode("days").alias("place", "v"))
    return x.select("train_no", "station", (F.col("place") + 1).cast("long").alias("place"), "v.day_date", r(F.col("v.avg_delay")).alias("avg_delay"), r(F.col("v.max_delay")).alias("max_delay"), "v.n", "v.n_late")


@query(f"""WITH {b.DREC}, {b.WEATHER}, {ROUGH}, x AS (SELECT train_no, day_date, avg(d) AS m FROM drec GROUP BY 1, 2), a AS (SELECT train_no, count(*) AS n_days, count(*) FILTER (WHERE rain >= 2) AS n_rainy, count(*) FILTER (WHERE rain < 2) AS n_dry, avg(m) FILTER (WHERE rain >= 2) AS ra, avg(m) FILTER (WHERE rain < 2) AS dr FROM x JOIN weather USING (day_date) GROUP BY 1),
t AS (SELECT train_no, round(ra / greatest(dr, 0.1), 6) AS ratio FROM a WHERE n_days >= 5 AND n_rainy >= 3 AND n_dry >= 3 ORDER BY ratio DESC, train_no LIMIT 30), m AS (SELECT train_no, relation, row_number() OVER (PARTITION BY train_no ORDER BY count(*) DESC, relation) AS k FROM rough WHERE relation IS NOT NULL GROUP BY 1, 2)
SELECT t.train_no, ratio, relation FROM t LEFT JOIN m ON m.train_no = t.train_no AND k = 1""")
def rain_relations(s, d):
    """Trains that rain delays most, with their commonest relation, which some never name."""
    return pu.with_relation(pu.rain_sensitive(_d(s, d), b.weather(s, d)), rough(s, d)).select("train_no", "ratio", "relation")


@query(f"""WITH {b.DREC}, {b.WEATHER}, {_DAILY}, j AS (SELECT *, 1.0::DOUBLE AS flat, CASE WHEN temp > 4 THEN rain END AS cold_rain FROM daily JOIN weather USING (day_date)), u AS ("""
       + " UNION ALL ".join(f"SELECT '{f}' AS factor, '{m}' AS measure, count({f}) AS n, round(CASE WHEN stddev_pop({f}) > 0 AND stddev_pop(CASE WHEN {f} IS NOT NULL THEN {m} END) > 0 THEN corr({f}, {m}) END, 3) AS r FROM j" for f in ("rain", "flat", "cold_rain") for m in ("avg_delay", "pct_late"))
       + ") SELECT * FROM u WHERE n >= 5 AND r IS NOT NULL")
def weather_report_corr(s, d):
    """Correlations of the report: five days at least, none for what does not vary, days without the factor left out."""
    w = b.weather(s, d).withColumns({"flat": F.lit(1.0), "cold_rain": F.when(F.col("temp") > 4, F.col("rain"))})
    return pu.correlations(pu.daily_delay(_d(s, d)), w, ["rain", "flat", "cold_rain"], ["avg_delay", "pct_late"], 5, None)


@query(f"""WITH {b.PLACES}, {b.EDGES}, {_SHAPES_SQL}, o AS (SELECT trip_id, lat, lon, row_number() OVER (PARTITION BY trip_id ORDER BY seq, stop) - 1 AS i, count(*) OVER (PARTITION BY trip_id) AS n FROM st JOIN places ON id = stop), m AS (SELECT * FROM o WHERE i = n // 2 AND n > 1),
x AS (SELECT trip_id, name FROM m JOIN side ON (ay > lat) <> (by_ > lat) WHERE lon < (bx - ax) * (lat - ay) / (by_ - ay) + ax GROUP BY 1, 2 HAVING count(*) % 2 = 1) SELECT area, count(*) AS n FROM (SELECT trip_id, min(name) AS area FROM x GROUP BY 1) GROUP BY 1""")
def lines_by_area(s, d):
    """Lines through the stops of each trip, counted by the area of their middle stop."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("seq", "stop", "lat", "lon"))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    st = b.stop_times(s, d).join(b.places(s, d).select(F.col("id").alias("stop"), "lat", "lon"), "stop")
    return cv.areas_of_lines(st.groupBy(F.col("trip_id").alias("id")).agg(line.alias("coords")), _shapes(s, d)).groupBy("area").agg(F.count("*").alias("n"))


@query(f"""WITH {b.EDGES}, o AS (SELECT trip_id, stop, t, seq FROM st) SELECT trip_id, string_agg(CAST(stop AS VARCHAR), '>' ORDER BY seq, stop) AS stops, arg_min(t, (seq, stop)) AS first_arr, arg_min(t, (seq, stop)) AS first_dep, arg_max(t, (seq, stop)) AS last_arr, arg_max(t, (seq, stop)) AS last_dep FROM o GROUP BY 1""")
def ordered_calls(s, d):
    return re.ordered_calls(b.stop_times(s, d)).withColumn("stops", F.array_join(F.col("stops").cast("array<string>"), ">"))


@query(f"WITH {b.EDGES} SELECT DISTINCT CAST(stop AS VARCHAR) AS id FROM st")
def served_stops(s, d):
    return b.stop_times(s, d).select(F.col("stop").cast("string").alias("id")).distinct()


@query("SELECT CAST(strftime(ts, '%a') AS VARCHAR) AS label, count(*) AS n FROM events GROUP BY 1")
def weekday_labels(s, d):
    return b.table(s, d, "events").groupBy(sc.weekday_label("ts").alias("label")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) / 8 AS v FROM lineitem), y AS (SELECT *, CAST(floor(v * 100) AS BIGINT) AS low, v * 100 - floor(v * 100) AS odd FROM x WHERE abs(v * 100 - floor(v * 100) - 0.5) > 1e-6)
SELECT count(*) AS n, CAST(sum(low + CASE WHEN odd > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS cents FROM y""")
def rounded_prices(s, d):
    """Prices to two decimals; those that are near a half, which only exact arithmetic settles, are left to the tests."""
    v = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 8
    x = b.table(s, d, "lineitem").select(v.alias("v")).filter(F.abs(F.col("v") * 100 - F.floor(F.col("v") * 100) - 0.5) > 1e-6)
    return x.agg(F.count("*").alias("n"), F.sum(F.rint(sc.round_exact(F.col("v"), 2) * 100).cast("long")).alias("cents"))


@query()
def travel_by_area(s, d):
    """Minutes from each station to the stations of each area."""
    return re.travel_by_area(_reached(s, d), b.places(s, d).select("id", F.col("nation").alias("area")))


@query()
def reach_means(s, d):
    """Stations reached, and minutes to them, on average over the stations of each area."""
    return re.reach_means(se.reach_counts(_reached(s, d)), b.places(s, d).select("id", F.col("nation").alias("area")))


@query()
def feeder_times(s, d):
    """From the least stop at seven by trips of even number, and on from wherever they lead by the others."""
    st = b.stop_times(s, d)
    rail, feeder = nw.edges(st.filter("trip_id % 2 = 0")), nw.edges(st.filter("trip_id % 2 = 1"))
    first = b.places(s, d).orderBy("id").limit(1).select(F.col("id").cast("string").alias("origin"), F.lit(420).alias("start"), F.lit(None).cast("map<string,double>").alias("seeds"))
    found = se.search(first, rail, budget=120, paths=False)
    own = first.select("origin", "start", F.col("origin").alias("station"), F.lit(0).alias("minutes"))
    return se.feeder_times(found.select("origin", "start", "station", "minutes").union(own), feeder, budget=240)


@query()
def size_summary(s, d):
    """Stations of each size class by departures an hour, with the mean of their three measures."""
    from railspan.plans.reports import connectivity

    x = connectivity(s, d).withColumn("size", sc.size_class(F.col("per_hour")))
    return x.groupBy("size").agg(F.count("*").alias("n"), F.avg("reachable").alias("reachable"), F.avg("per_hour").alias("per_hour"), F.avg("reach_km").alias("reach_km"))


@query()
def some_destinations(s, d):
    """How far every fourth station is, together, from each origin that reaches one."""
    every = b.places(s, d).filter("id % 4 = 0").select(F.col("id").cast("string").alias("station"))
    return re.combine_destinations(_reached(s, d), every, once=True)


@query(f"""WITH {b.EDGES}, f AS (SELECT src AS id, count(*) FILTER (WHERE dep_min >= 360 AND dep_min < 1320) / 16.0::DOUBLE AS v FROM edges GROUP BY 1), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM f WHERE v >= 4)
SELECT min(v) FILTER (WHERE i = floor(n * 0.33)) AS t1, min(v) FILTER (WHERE i = floor(n * 0.66)) AS t2 FROM o""")
def terciles_of_sizes(s, d):
    """Terciles of departures an hour over the stations that are not small."""
    x = nw.direct_frequency(nw.edges(b.stop_times(s, d))).filter(sc.size_class(F.col("per_hour")) != "Small")
    return nw.terciles(x, "per_hour")
