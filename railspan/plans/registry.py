"""Registered queries and the SQL that each must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from railspan.functions import calendar as cal
from railspan.functions import scalars as sc
from railspan.operators import connections as co
from railspan.operators import nearest as ne
from railspan.operators import network as nw
from railspan.operators import punctuality as pu
from railspan.operators import rasters as ra
from railspan.operators import search as se
from railspan.plans import bridge as b
from railspan.sources.scratch import shared_dir, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def _conn(s, d):
    return co.connections(b.rec(s, d))


def _counted(s, d, **options):
    rec = b.rec(s, d)
    return co.counted(rec, rec, **options)


def _d(s, d):
    return b.rec(s, d).transform(pu.minutes("delay_dep", 0.0, 30.0))


def r(col, n=6):
    return F.round(col, n)


_ROLL = "count(*) AS planned, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(close_call) AS BIGINT) AS close_call"


@query(f"WITH {b.CONN} SELECT station, {_ROLL} FROM conn GROUP BY 1")
def missed_by_station(s, d):
    return co.rollup(_counted(s, d), "station")


@query(f"WITH {b.CONN} SELECT dep_hour, {_ROLL} FROM conn GROUP BY 1")
def missed_by_hour(s, d):
    return co.rollup(_counted(s, d), "dep_hour")


@query(f"WITH {b.CONN}, x AS (SELECT dow, {_ROLL} FROM conn GROUP BY 1) SELECT CAST(g.i AS INTEGER) AS dow, coalesce(planned, 0) AS planned, coalesce(missed, 0) AS missed FROM range(7) g(i) LEFT JOIN x ON x.dow = g.i")
def missed_by_weekday(s, d):
    days = s.range(7).select(F.col("id").cast("int").alias("dow"))
    return days.join(co.rollup(_counted(s, d), "dow"), "dow", "left").select("dow", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("missed", F.lit(0)).alias("missed"))


@query(f"WITH {b.CONN}, x AS (SELECT day_date, {_ROLL} FROM conn GROUP BY 1), g AS (SELECT CAST(unnest(generate_series((SELECT min(day_date) FROM rec), (SELECT max(day_date) FROM rec), INTERVAL 1 DAY)) AS DATE) AS day_date) SELECT CAST(g.day_date AS VARCHAR) AS day, coalesce(planned, 0) AS planned, coalesce(missed, 0) AS missed FROM g LEFT JOIN x USING (day_date)")
def missed_by_day(s, d):
    ends = b.rec(s, d).agg(F.min("day_date"), F.max("day_date")).first()
    days = cal.date_range(s, str(ends[0]), str(ends[1])) if ends[0] else s.createDataFrame([], "day_date date")
    return days.join(co.rollup(_counted(s, d), "day_date"), "day_date", "left").select(
        F.col("day_date").cast("string").alias("day"), F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("missed", F.lit(0)).alias("missed"))


@query(f"WITH {b.CONN} SELECT station, CAST(dep_hour AS BIGINT) AS dep_hour, dow, CAST(day_date AS VARCHAR) AS day, count(*) AS planned, CAST(sum(missed) AS BIGINT) AS missed FROM conn GROUP BY GROUPING SETS ((station), (dep_hour), (dow), (day_date), (station, dep_hour))")
def connections_grouping_sets(s, d):
    return co.rollups(_counted(s, d)).select("station", "dep_hour", "dow", F.col("day_date").cast("string").alias("day"), "planned", "missed")


@query(f"WITH {b.CONN} SELECT CAST(round_even(gap / 60, 0) AS INTEGER) AS minutes, {_ROLL} FROM conn GROUP BY 1 HAVING minutes BETWEEN 2 AND 15")
def gap_histogram(s, d):
    return co.gap_histogram(_conn(s, d))


@query(f"WITH {b.CONN} SELECT CAST(round_even(gap / 60, 0) AS INTEGER) AS minutes, {_ROLL} FROM conn GROUP BY 1 HAVING minutes BETWEEN 1 AND 20 ORDER BY 1")
def buffer_curve(s, d):
    return co.gap_histogram(_conn(s, d), 1, 20).orderBy("minutes")


@query(f"WITH {b.CONN} SELECT count(*) FILTER (WHERE missed = 1 AND arr_actual - dep_actual <= 180) AS barely, CAST(sum(missed) AS BIGINT) AS missed, round(sum(close_call) / count(*), 6) AS close_share, round(sum(close_call) / greatest(sum(close_call) + sum(missed), 1), 6) AS lucky_share FROM conn")
def barely_missed(s, d):
    c = F.col
    return _conn(s, d).agg(F.count_if((c("missed") == 1) & (c("arr_actual") - c("dep_actual") <= 180)).alias("barely"), F.sum("missed").cast("long").alias("missed"),
                           r(F.sum("close_call") / F.count("*")).alias("close_share"), r(F.sum("close_call") / F.greatest(F.sum("close_call") + F.sum("missed"), F.lit(1))).alias("lucky_share"))


_PAIRS = "SELECT station, arr_train, dep_train, min(rel_arr) AS rel_arr, count(*) AS n, CAST(sum(missed) AS BIGINT) AS missed, round(avg(gap), 6) AS avg_gap, round(avg(CASE WHEN missed = 1 THEN arr_actual - dep_actual END), 6) AS avg_over FROM conn GROUP BY 1, 2, 3 HAVING sum(missed) >= 1"


@query(f"WITH {b.CONN} {_PAIRS}")
def worst_pairs(s, d):
    return co.worst_pairs(b.rec(s, d)).withColumns({"avg_gap": r("avg_gap"), "avg_over": r("avg_over")})


@query(f"WITH {b.CONN}, p AS ({_PAIRS}) SELECT station, arr_train, dep_train, missed, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY missed DESC, n DESC, arr_train, dep_train) AS rank FROM p) WHERE rank <= 5")
def topk_per_group(s, d):
    return co.top_per_group(co.worst_pairs(b.rec(s, d)), "station", 5, F.desc("missed"), F.desc("n"), F.col("arr_train"), F.col("dep_train")).select("station", "arr_train", "dep_train", "missed", "rank")


@query(f"""WITH {b.CONN}, p AS (SELECT station, arr_train, rel_arr, count(*) AS c, sum(delay_arr) AS dl FROM conn WHERE missed = 1 GROUP BY 1, 2, 3), t AS (SELECT station, arr_train, CAST(sum(c) AS BIGINT) AS missed, round(sum(dl) / sum(c), 6) AS avg_delay FROM p GROUP BY 1, 2),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, arr_train ORDER BY c DESC, rel_arr) AS k FROM p) WHERE k = 1), dd AS (SELECT station, arr_train, count(DISTINCT day_date) AS days FROM conn WHERE missed = 1 GROUP BY 1, 2)
SELECT station, arr_train, missed, avg_delay, rel_arr AS relation, days FROM t JOIN w USING (station, arr_train) JOIN dd USING (station, arr_train) WHERE missed >= 2""")
def toxic_arrivals(s, d):
    return co.toxic_arrivals(_counted(s, d)).select("station", "arr_train", "missed", r("avg_delay").alias("avg_delay"), "relation", "days")


@query(f"""WITH {b.CONN}, m AS (SELECT * FROM conn WHERE missed = 1), p AS (SELECT arr_train, rel_arr, row_number() OVER (PARTITION BY arr_train ORDER BY count(*) DESC, rel_arr) AS k FROM m GROUP BY 1, 2),
st AS (SELECT arr_train, string_agg(station, ',' ORDER BY station) AS stations FROM (SELECT arr_train, station, row_number() OVER (PARTITION BY arr_train ORDER BY station) AS k FROM (SELECT DISTINCT arr_train, station FROM m)) WHERE k <= 5 GROUP BY 1)
SELECT arr_train, count(*) AS missed, count(DISTINCT station) AS n_stations, count(DISTINCT day_date) AS days, min(stations) AS stations, round(avg(delay_arr), 6) AS avg_delay, min(p.rel_arr) AS relation FROM m JOIN st USING (arr_train) JOIN p USING (arr_train) WHERE k = 1 GROUP BY 1 HAVING count(*) >= 3 ORDER BY missed DESC, arr_train LIMIT 50""")
def domino_trains(s, d):
    return co.domino_trains(_counted(s, d)).withColumn("avg_delay", r("avg_delay"))


_WAITS = """late AS (SELECT DISTINCT day_date, station, arr_train, arr_actual FROM conn WHERE missed = 1),
waits AS (SELECT l.day_date, l.station, l.arr_train, l.arr_actual, min(r.dep_sec + r.delay_dep - l.arr_actual) AS wait FROM late l JOIN rec r ON l.day_date = r.day_date AND l.station = r.station AND r.train_no <> l.arr_train WHERE r.dep_sec + r.delay_dep > l.arr_actual AND r.dep_sec + r.delay_dep <= l.arr_actual + 7200 GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {b.CONN}, {_WAITS} SELECT CAST(day_date AS VARCHAR) AS day, station, arr_train, arr_actual, wait FROM waits")
def next_departure_wait(s, d):
    rec = b.rec(s, d)
    return co.next_departures(co.connections(rec), rec).select(F.col("day_date").cast("string").alias("day"), "station", "arr_train", "arr_actual", "wait")


@query(f"WITH {b.CONN}, {_WAITS} SELECT CASE WHEN wait < 300 THEN '0-5' WHEN wait < 600 THEN '5-10' WHEN wait < 900 THEN '10-15' WHEN wait < 1200 THEN '15-20' WHEN wait < 1800 THEN '20-30' WHEN wait < 3600 THEN '30-60' ELSE '60-120' END AS bucket, count(*) AS n FROM waits WHERE wait < 7200 GROUP BY 1")
def wait_histogram(s, d):
    rec = b.rec(s, d)
    return co.wait_histogram(co.next_departures(co.connections(rec), rec))


@query(f"WITH {b.CONN}, {_WAITS}, o AS (SELECT wait, row_number() OVER (ORDER BY wait) - 1 AS i, count(*) OVER () AS n FROM waits) SELECT min(wait) FILTER (WHERE i = n // 2) AS upper_median FROM o")
def wait_upper_median(s, d):
    rec = b.rec(s, d)
    return co.upper_median(co.next_departures(co.connections(rec), rec), "wait")


@query(f"""WITH {b.CONN}, dm AS (SELECT station, round(count(*) / (SELECT count(DISTINCT day_date) FROM rec)) AS demand FROM rec GROUP BY 1), x AS (SELECT station, count(*) AS planned, CAST(sum(missed) AS BIGINT) AS missed FROM conn GROUP BY 1)
SELECT station, planned, missed, demand, round(missed * demand / greatest((SELECT max(demand) FROM dm), 1), 6) AS impact FROM x JOIN dm USING (station)""")
def station_impact(s, d):
    rec = b.rec(s, d)
    return co.impact(co.counted(rec, rec), rec).withColumn("impact", r("impact"))


_CORR = [("click", "view"), ("view", "purchase"), ("error", "click")]


@query(f"""WITH {b.CONN}, pr(origin, dest) AS (VALUES ('click', 'view'), ('view', 'purchase'), ('error', 'click'))
SELECT origin, dest, dep_hour, count(*) AS planned, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(close_call) AS BIGINT) AS close_call FROM conn, pr, (SELECT DISTINCT station AS s1, train_no AS t1, day_date AS d1 FROM rec), (SELECT DISTINCT station AS s2, train_no AS t2, day_date AS d2 FROM rec) WHERE s1 = origin AND t1 = arr_train AND d1 = day_date AND s2 = dest AND t2 = dep_train AND d2 = day_date GROUP BY 1, 2, 3""")
def corridor(s, d):
    rec = b.rec(s, d)
    return co.corridors(rec, s.createDataFrame(_CORR, "origin string, dest string"))


@query(f"WITH {b.CONN}, t AS (SELECT train_no FROM rec WHERE station = 'click' INTERSECT SELECT train_no FROM rec WHERE station = 'view') SELECT station, {_ROLL} FROM conn WHERE arr_train IN (SELECT train_no FROM t) OR dep_train IN (SELECT train_no FROM t) GROUP BY 1")
def key_route(s, d):
    return co.rollup(co.route_touching(b.rec(s, d), "click", "view"), "station")


_SAVES = "saves AS (SELECT station, arr_train, dep_train, dow, CAST(hold AS INTEGER) AS hold, count(*) AS saves, round(avg(arr_actual - dep_actual), 6) AS avg_over FROM conn, (VALUES (120), (180), (300)) h(hold) WHERE missed = 1 AND arr_actual - dep_actual <= hold GROUP BY ALL)"


@query(f"WITH {b.CONN}, {_SAVES} SELECT * FROM saves")
def hold_saves(s, d):
    return co.hold_saves(b.rec(s, d)).withColumn("avg_over", r("avg_over"))


_DOWN = """ro AS (SELECT *, row_number() OVER (PARTITION BY day_date, train_no ORDER BY dep_sec, station) AS so FROM rec),
held AS (SELECT DISTINCT c.day_date, c.dow, c.station, c.dep_train AS train, ro.so FROM conn c JOIN ro ON ro.day_date = c.day_date AND ro.train_no = c.dep_train AND ro.station = c.station WHERE missed = 1),
rt AS (SELECT DISTINCT h.day_date, h.dow, h.station, h.train, ro.station AS later, CAST(x.hold AS INTEGER) AS hold FROM held h JOIN ro ON ro.day_date = h.day_date AND ro.train_no = h.train AND ro.so > h.so, (VALUES (120), (180), (300)) x(hold)),
nm AS (SELECT rt.station, train, rt.dow, hold, count(*) FILTER (WHERE missed = 0 AND dep_actual - arr_actual > 0 AND dep_actual - arr_actual <= hold) AS n FROM rt JOIN conn c ON c.day_date = rt.day_date AND c.station = later AND c.arr_train = train GROUP BY ALL),
sv AS (SELECT rt.station, train, rt.dow, hold, count(*) FILTER (WHERE missed = 1 AND arr_actual - dep_actual > 0 AND arr_actual - dep_actual <= hold) AS n FROM rt JOIN conn c ON c.day_date = rt.day_date AND c.station = later AND c.dep_train = train GROUP BY ALL),
down AS (SELECT k.station, k.train, k.dow, k.hold, coalesce(nm.n, 0) AS new_misses, coalesce(sv.n, 0) AS saved_later FROM (SELECT DISTINCT station, train, dow, hold FROM rt) k LEFT JOIN nm USING (station, train, dow, hold) LEFT JOIN sv USING (station, train, dow, hold))"""


@query(f"WITH {b.CONN}, {_DOWN} SELECT * FROM down")
def hold_downstream(s, d):
    return co.hold_effects(b.rec(s, d))


@query(f"""WITH {b.CONN}, {_SAVES}, {_DOWN}, nets AS (SELECT s.station, s.arr_train, s.dep_train, s.dow, s.hold, s.saves + coalesce(saved_later, 0) - coalesce(new_misses, 0) AS net FROM saves s LEFT JOIN down d ON d.station = s.station AND d.train = s.dep_train AND d.dow = s.dow AND d.hold = s.hold),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, arr_train, dep_train ORDER BY net DESC, hold) AS k FROM (SELECT station, arr_train, dep_train, hold, sum(net) AS net FROM nets GROUP BY ALL)) WHERE k = 1),
oc AS (SELECT station, arr_train, dep_train, dow, count(*) AS n, sum(missed) AS m FROM conn GROUP BY ALL), ms AS (SELECT station, arr_train, dep_train, CAST(sum(m) AS BIGINT) AS missed FROM oc GROUP BY ALL HAVING sum(m) >= 2),
w AS (SELECT * FROM (SELECT nets.*, row_number() OVER (PARTITION BY station, arr_train, dep_train ORDER BY net DESC, dow, hold) AS k FROM nets JOIN oc USING (station, arr_train, dep_train, dow) WHERE oc.n >= 2) WHERE k = 1),
j AS (SELECT u.station, u.arr_train, u.dep_train, missed, u.net AS un, u.hold AS uh, w.net AS wn, w.hold AS wh, w.dow AS wd, coalesce((w.net > 1.5 * u.net OR u.net < 2) AND w.net > u.net, false) AS by_day FROM u JOIN ms USING (station, arr_train, dep_train) LEFT JOIN w USING (station, arr_train, dep_train))
SELECT station, arr_train, dep_train, missed, CASE WHEN by_day THEN wd END AS dow, CASE WHEN by_day THEN wh ELSE uh END AS hold, CAST(CASE WHEN by_day THEN wn ELSE un END AS BIGINT) AS net FROM j WHERE net >= 2""")
def hold_recommendation(s, d):
    rec = b.rec(s, d)
    return co.hold_advice(co.ends(rec, "arr"), co.ends(rec, "dep"), rec)


@query(f"WITH {b.CONN} SELECT station, arr_train, dep_train, count(*) AS n, round(avg(arr_actual - dep_actual), 6) AS avg_over FROM conn WHERE missed = 1 AND arr_actual - dep_actual <= 120 GROUP BY 1, 2, 3 ORDER BY n DESC, station, arr_train, dep_train LIMIT 10")
def quick_wins(s, d):
    return co.quick_wins(b.rec(s, d)).withColumn("avg_over", r("avg_over"))


@query(f"""WITH {b.REC} SELECT train_no, first(station ORDER BY dep_sec, day_date, station) AS first_station, first(station ORDER BY arr_sec DESC, day_date DESC, station DESC) AS last_station FROM rec GROUP BY 1""")
def train_route_ends(s, d):
    return b.rec(s, d).groupBy("train_no").agg(F.min_by("station", F.struct("dep_sec", "day_date", "station")).alias("first_station"), F.max_by("station", F.struct("arr_sec", "day_date", "station")).alias("last_station"))


_BYST = "bs AS (SELECT station, round(avg(d), 1) AS avg_delay, count(*) AS n_trains, round(avg(CASE WHEN d > 1 THEN 100.0 ELSE 0 END), 6) AS pct_late, round(median(d), 6) AS median_delay, max(d) AS max_delay FROM drec GROUP BY 1 HAVING count(*) >= 5)"


@query(f"WITH {b.DREC}, {_BYST} SELECT * FROM bs")
def punctuality_station(s, d):
    return pu.by_station(_d(s, d)).withColumns({"pct_late": r("pct_late"), "median_delay": r("median_delay")})


@query(f"WITH {b.DREC}, {_BYST} SELECT count(*) AS n_stations, round(avg(avg_delay), 6) AS mean_of_avg, round(median(avg_delay), 6) AS median_of_avg, round(avg(pct_late), 4) AS mean_pct_late FROM bs")
def punctuality_summary(s, d):
    x = pu.summary(pu.by_station(_d(s, d)))
    return x.select("n_stations", r("mean_of_avg").alias("mean_of_avg"), r("median_of_avg").alias("median_of_avg"), r("mean_pct_late", 4).alias("mean_pct_late"))


@query(f"WITH {b.DREC}, h AS (SELECT dep_sec // 3600 AS hour, avg(d) AS a, count(*) AS n FROM drec GROUP BY 1) SELECT CAST(i AS BIGINT) AS hour, round(coalesce(a, 0), 6) AS avg_delay, coalesce(n, 0) AS n_trains FROM range(5, 26) g(i) LEFT JOIN h ON h.hour = i")
def punctuality_hourly_dense(s, d):
    return pu.hourly(_d(s, d), 5, 26).withColumn("avg_delay", r("avg_delay"))


@query(f"WITH {b.DREC} SELECT station, CAST(t AS BIGINT) AS t, round(avg(d), 6) AS avg_delay, count(*) AS n FROM drec JOIN range(0, 90001, 900) g(t) ON dep_sec >= t - 1800 AND dep_sec < t + 1800 GROUP BY 1, 2 HAVING count(*) >= 2")
def moving_window(s, d):
    return pu.moving(_d(s, d), least=2).withColumn("avg_delay", r("avg_delay"))


_INC = "inc AS (SELECT * FROM (SELECT *, lag(station) OVER w AS from_station, delay_dep - lag(delay_dep) OVER w AS increase FROM rec WINDOW w AS (PARTITION BY day_date, train_no ORDER BY dep_sec, station, delay_dep)) WHERE from_station IS NOT NULL)"


@query(f"""WITH {b.REC}, {_INC}, h AS (SELECT station, count(*) AS incidents, CAST(sum(increase) AS BIGINT) AS total_delay, count(DISTINCT train_no) AS n_trains, count(DISTINCT day_date) AS n_days FROM inc WHERE increase > 60 GROUP BY 1 HAVING count(*) >= 3), t AS (SELECT station, count(*) AS n_trips FROM rec GROUP BY 1)
SELECT *, round(incidents * 1000.0 / n_trips, 6) AS incidents_per_1k, round(total_delay / n_trips, 6) AS delay_per_trip FROM h JOIN t USING (station)""")
def propagation_station(s, d):
    return pu.propagation_stations(b.rec(s, d)).withColumns({"incidents_per_1k": r("incidents_per_1k"), "delay_per_trip": r("delay_per_trip")})


@query(f"WITH {b.REC}, {_INC} SELECT from_station, station, count(*) AS n_trips, count(*) FILTER (WHERE increase > 60) AS incidents, CAST(coalesce(sum(increase) FILTER (WHERE increase > 60), 0) AS BIGINT) AS total_delay FROM inc GROUP BY 1, 2 HAVING incidents >= 3")
def propagation_segment(s, d):
    return pu.propagation_segments(b.rec(s, d))


@query(f"WITH {b.REC}, {_INC} SELECT station, relation FROM (SELECT station, relation, row_number() OVER (PARTITION BY station ORDER BY count(*) DESC, relation) AS k FROM inc WHERE increase > 60 GROUP BY 1, 2) WHERE k = 1")
def propagation_relations(s, d):
    return pu.most_common(pu.increases(b.rec(s, d)).filter("increase > 60"), "station", "relation")


@query(f"""WITH {b.REC}, x AS (SELECT train_no, station, day_date, least(greatest(CAST(delay_arr AS DOUBLE) / 60, 0), 30) AS d FROM rec), dy AS (SELECT train_no, station, day_date, sum(d) AS s, max(d) AS mx, count(*) AS n, count(*) FILTER (WHERE d > 5) AS nl FROM x GROUP BY 1, 2, 3)
SELECT train_no, station, count(*) AS days_seen, round(avg(nl * 100.0::DOUBLE / n), 6) AS pct_late, round(avg(s / n), 6) AS avg_delay, round(avg(mx), 6) AS max_delay, round(max(mx), 6) AS worst, CAST(sum(n) AS BIGINT) AS total_stops FROM dy GROUP BY 1, 2 HAVING count(*) >= 3""")
def offenders(s, d):
    x = pu.offenders(b.rec(s, d))
    return x.withColumns({c: r(c) for c in ("pct_late", "avg_delay", "max_delay", "worst")})


_DAILY = "daily AS (SELECT day_date, count(*) AS n, avg(d) AS avg_delay, median(d) AS median_delay, avg(CASE WHEN d > 1 THEN 100.0 ELSE 0 END) AS pct_late FROM drec GROUP BY 1)"


@query(f"WITH {b.DREC}, {_DAILY} SELECT CAST(day_date AS VARCHAR) AS day, n, round(avg_delay, 6) AS avg_delay, round(median_delay, 6) AS median_delay, round(pct_late, 6) AS pct_late FROM daily")
def daily_delay(s, d):
    return pu.daily_delay(_d(s, d)).select(F.col("day_date").cast("string").alias("day"), "n", *[r(c).alias(c) for c in ("avg_delay", "median_delay", "pct_late")])


@query("WITH " + b.DREC + ", " + _DAILY + ", " + b.WEATHER + " " + " UNION ALL ".join(f"SELECT '{f}' AS factor, '{m}' AS measure, count(*) AS n, round(corr({f}, {m}), 3) AS r FROM daily JOIN weather USING (day_date)" for f in ("rain", "wind", "temp") for m in ("avg_delay", "pct_late")))
def weather_corr(s, d):
    return pu.correlations(pu.daily_delay(_d(s, d)), b.weather(s, d), ["rain", "wind", "temp"], ["avg_delay", "pct_late"])


@query("WITH " + b.DREC + ", " + _DAILY + ", " + b.WEATHER + ", j AS (SELECT * FROM daily JOIN weather USING (day_date)), u AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS factor, round(avg(avg_delay) FILTER (WHERE {t}), 6) AS avg_yes, round(avg(avg_delay) FILTER (WHERE NOT {t}), 6) AS avg_no, count(*) FILTER (WHERE {t}) AS n_yes, count(*) FILTER (WHERE NOT {t}) AS n_no FROM j" for k, t in (("rain", "(rain >= 1)"), ("wind", "(wind >= 40)"), ("cold", "(temp < 5)"))) + ") SELECT * FROM u WHERE n_yes >= 5 AND n_no >= 5")
def weather_compare(s, d):
    return pu.compare_weather(pu.daily_delay(_d(s, d)), b.weather(s, d)).withColumns({"avg_yes": r("avg_yes"), "avg_no": r("avg_no")})


@query(f"""WITH {b.DREC}, {b.WEATHER}, x AS (SELECT train_no, day_date, avg(d) AS m FROM drec GROUP BY 1, 2), a AS (SELECT train_no, count(*) AS n_days, count(*) FILTER (WHERE rain >= 2) AS n_rainy, count(*) FILTER (WHERE rain < 2) AS n_dry, avg(m) FILTER (WHERE rain >= 2) AS ra, avg(m) FILTER (WHERE rain < 2) AS dr FROM x JOIN weather USING (day_date) GROUP BY 1)
SELECT train_no, n_days, n_rainy, n_dry, round(ra, 6) AS rainy, round(dr, 6) AS dry, round(ra / greatest(dr, 0.1), 6) AS ratio FROM a WHERE n_days >= 5 AND n_rainy >= 3 AND n_dry >= 3 ORDER BY ratio DESC, train_no LIMIT 30""")
def rain_sensitivity(s, d):
    return pu.rain_sensitive(_d(s, d), b.weather(s, d)).withColumns({"rainy": r("rainy"), "dry": r("dry")})


@query(f"WITH {b.DREC}, {_DAILY} SELECT CAST(i AS INTEGER) AS dow, round(coalesce(avg(avg_delay), 0), 6) AS avg_delay, count(n) AS days FROM range(7) g(i) LEFT JOIN daily ON isodow(day_date) - 1 = i GROUP BY 1")
def weekday_profile(s, d):
    x = pu.daily_delay(_d(s, d)).groupBy(F.weekday("day_date").alias("dow")).agg(F.avg("avg_delay").alias("a"), F.count("*").alias("c"))
    return s.range(7).select(F.col("id").cast("int").alias("dow")).join(x, "dow", "left").select("dow", r(F.coalesce("a", F.lit(0.0))).alias("avg_delay"), F.coalesce("c", F.lit(0)).alias("days"))


@query(f"""WITH {b.SCHED}, a AS (SELECT day_date, count(*) AS scheduled FROM sched GROUP BY 1), g AS (SELECT day_date, count(*) AS deleted, CAST(sum(c) AS BIGINT) AS stops FROM gone GROUP BY 1)
SELECT CAST(day_date AS VARCHAR) AS day, scheduled, coalesce(deleted, 0) AS deleted, coalesce(stops, 0) AS stops, round(coalesce(deleted, 0) * 100.0 / scheduled, 6) AS pct, coalesce(deleted, 0) * 100.0 / scheduled > 30 AS suspicious FROM a LEFT JOIN g USING (day_date)""")
def cancelled_daily(s, d):
    return pu.cancelled_daily(b.scheduled(s, d), b.observed(s, d)).select(F.col("day_date").cast("string").alias("day"), "scheduled", "deleted", "stops", r("pct").alias("pct"), "suspicious")


@query(f"""WITH {b.SCHED}, p AS (SELECT k, s, lead(s) OVER (PARTITION BY k ORDER BY n, s) AS t FROM stops) SELECT least(s, t) AS a, greatest(s, t) AS b, count(*) AS n FROM p JOIN gone ON train_no = k WHERE t IS NOT NULL GROUP BY 1, 2""")
def cancelled_segments(s, d):
    return pu.cancelled_segments(pu.cancelled(b.scheduled(s, d), b.observed(s, d)))


@query(f"WITH {b.EDGES} SELECT from_id, to_id, round(freq, 6) AS freq FROM seg")
def segment_frequency(s, d):
    return nw.segment_frequency(nw.edges(b.stop_times(s, d)), 7).withColumn("freq", r("freq"))


_TW = "tw AS (SELECT o_orderkey AS trip_id, 1 + o_orderkey % 5 AS n_days FROM orders)"


@query(f"WITH {b.EDGES}, {_TW} SELECT src AS from_id, dst AS to_id, round(CAST(sum(n_days) AS DOUBLE) / 7, 6) AS freq FROM edges JOIN tw USING (trip_id) GROUP BY 1, 2")
def segment_frequency_weighted(s, d):
    w = b.table(s, d, "orders").select(F.col("o_orderkey").alias("trip_id"), (1 + F.col("o_orderkey") % 5).alias("n_days"))
    return nw.segment_frequency(nw.edges(b.stop_times(s, d)), 7, w).withColumn("freq", r("freq"))


@query(f"WITH {b.EDGES} SELECT id, round(sum(freq), 6) AS freq FROM (SELECT from_id AS id, freq FROM seg UNION ALL SELECT to_id, freq FROM seg) GROUP BY 1")
def station_frequency(s, d):
    return nw.station_frequency(nw.segment_frequency(nw.edges(b.stop_times(s, d)), 7)).withColumn("freq", r("freq"))


@query(f"WITH {b.EDGES} SELECT id, round(greatest(sum(o), sum(i)), 6) AS trains_per_day FROM (SELECT from_id AS id, freq AS o, 0 AS i FROM seg UNION ALL SELECT to_id, 0, freq FROM seg) GROUP BY 1")
def trains_per_day(s, d):
    return nw.trains_per_day(nw.segment_frequency(nw.edges(b.stop_times(s, d)), 7)).withColumn("trains_per_day", r("trains_per_day"))


@query(f"WITH {b.EDGES}, x AS (SELECT src AS id, max(dep_min) AS m FROM edges GROUP BY 1) SELECT id, m AS last_min, printf('%02d:%02d', (m // 60) % 24, m % 60) || CASE WHEN m >= 1440 THEN '+1' ELSE '' END AS label FROM x")
def last_train(s, d):
    return nw.last_train(nw.edges(b.stop_times(s, d))).withColumn("label", sc.clock_label(F.col("last_min")))


@query(f"WITH {b.EDGES}, x AS (SELECT src AS id, count(*) FILTER (WHERE dep_min >= 360 AND dep_min < 1320) / 16.0 / 7 AS f FROM edges GROUP BY 1) SELECT id, round(f, 6) AS per_hour, CASE WHEN f < 4 THEN 'Small' WHEN f < 10 THEN 'Medium' ELSE 'Big' END AS size FROM x")
def direct_frequency(s, d):
    x = nw.direct_frequency(nw.edges(b.stop_times(s, d)), 7)
    return x.select("id", r("per_hour").alias("per_hour"), sc.size_class(F.col("per_hour")).alias("size"))


@query(f"WITH {b.EDGES}, x AS (SELECT src AS id, count(*) FILTER (WHERE dep_min >= 360 AND dep_min < 1320) / 16.0 / 7 AS f FROM edges GROUP BY 1) SELECT CASE WHEN f < 4 THEN 'Small' WHEN f < 10 THEN 'Medium' ELSE 'Big' END AS size, count(*) AS n, round(avg(f), 6) AS mean FROM x GROUP BY 1")
def size_class_summary(s, d):
    x = nw.direct_frequency(nw.edges(b.stop_times(s, d)), 7)
    return x.groupBy(sc.size_class(F.col("per_hour")).alias("size")).agg(F.count("*").alias("n"), r(F.avg("per_hour")).alias("mean"))


@query("SELECT o_orderpriority AS service_id, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1")
def service_day_counts(s, d):
    runs = b.table(s, d, "orders").select(F.col("o_orderpriority").alias("service_id"), F.to_date("o_orderdate").alias("day_date")).distinct()
    return cal.filter_dates(runs, weekdays=range(5)).groupBy("service_id").agg(F.count("*").alias("n_days"))


@query("SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS day FROM (SELECT unnest(generate_series(DATE '2025-01-01', DATE '2025-12-31', INTERVAL 1 DAY)) AS x) WHERE isodow(x) <= 5 AND CAST(x AS DATE) NOT IN ('2025-01-01', '2025-04-21', '2025-05-01', '2025-05-29', '2025-06-09', '2025-07-21', '2025-08-15', '2025-11-01', '2025-11-11', '2025-12-25') AND NOT EXISTS (SELECT 1 FROM (VALUES "
       + ", ".join(f"(DATE '{a}', DATE '{z}')" for a, z, _ in cal.SCHOOL_HOLIDAYS) + ") h(a, z) WHERE CAST(x AS DATE) BETWEEN a AND z)")
def holiday_filter(s, d):
    days = cal.filter_dates(cal.date_range(s, "2025-01-01", "2025-12-31"), "day_date", range(5), cal.public_holidays(s, 2025, 2025), cal.school_holidays(s))
    return days.select(F.col("day_date").cast("string").alias("day"))


@query("SELECT DISTINCT s_name AS station, CAST(o_orderkey AS VARCHAR) AS train_no FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE (l_linenumber % 3 = 0 OR l_returnflag = 'R') AND o_orderstatus = 'F'")
def commercial_semi(s, d):
    st = b.table(s, d, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id"), (F.col("l_linenumber") % 3).alias("pickup_type"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("drop_off_type"))
    trips = b.table(s, d, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_orderstatus").alias("service_id"), F.col("o_orderkey").cast("string").alias("trip_short_name"))
    lookup = b.table(s, d, "supplier").select(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("name"))
    raw = nw.commercial_stops(st, trips, lookup.withColumn("name", F.col("name")), s.createDataFrame([("F",)], "service_id string"))
    return raw.join(lookup.select(F.upper(F.trim("name")).alias("station"), "name").distinct(), "station").select(F.col("name").alias("station"), "train_no")


@query("SELECT c.s_suppkey AS stop_id, coalesce(p.s_suppkey, c.s_suppkey) AS station_id, coalesce(p.s_name, c.s_name) AS name FROM supplier c LEFT JOIN supplier p ON p.s_suppkey = CASE WHEN c.s_suppkey % 3 = 0 THEN c.s_suppkey // 3 END")
def parent_coalesce(s, d):
    k = F.col("s_suppkey")
    stops = b.table(s, d, "supplier").select(k.alias("stop_id"), F.col("s_name").alias("stop_name"), F.lit(50.0).alias("stop_lat"), F.lit(4.0).alias("stop_lon"), F.when(k % 3 == 0, F.floor(k / 3)).alias("parent_station"))
    return nw.stop_lookup(stops).select("stop_id", "station_id", "name")


_NEAR = f"""nr AS (SELECT p.id, q.id AS nearest, {b.km_sql('p', 'q')} AS km, row_number() OVER (PARTITION BY p.id ORDER BY pow(p.lat - q.lat, 2) + pow(p.lon - q.lon, 2), q.id) AS k FROM places p, points q)"""


@query(f"WITH {b.PLACES}, {_NEAR} SELECT id, nearest, round(km, 6) AS km FROM nr WHERE k = 1 AND km <= 5")
def nearest_point(s, d):
    return nw.nearest_point(b.places(s, d), b.points(s, d), 5.0).withColumn("km", r("km"))


@query(f"WITH {b.PLACES}, seg AS (SELECT id FROM places WHERE id % 3 = 0), nr AS (SELECT p.id, q.id AS nearest, {b.km_sql('p', 'q')} AS km, row_number() OVER (PARTITION BY p.id ORDER BY pow(p.lat - q.lat, 2) + pow(p.lon - q.lon, 2), q.id) AS k FROM places p, places q WHERE p.id % 3 <> 0 AND q.id % 3 = 0) SELECT id, coalesce(nearest, id) AS cluster FROM places LEFT JOIN (SELECT * FROM nr WHERE k = 1 AND km <= 20) USING (id)")
def cluster_isolated(s, d):
    p = b.places(s, d)
    return nw.cluster_isolated(p, p.filter("id % 3 = 0").select("id"), 20.0)


@query(f"WITH {b.PLACES}, x AS (SELECT p.id AS stop_a, q.id AS stop_b, {b.km_sql('p', 'q')} AS km FROM places p, places q WHERE p.id <> q.id) SELECT stop_a, stop_b, round(km, 6) AS km, round(km / 4.5 * 60, 6) AS walk_min FROM x WHERE km <= 40")
def transfer_band(s, d):
    return nw.transfer_band(b.places(s, d), 40.0).withColumns({"km": r("km"), "walk_min": r("walk_min")})


@query(f"WITH {b.PLACES}, o AS (SELECT 50.85::DOUBLE AS lat, 4.35::DOUBLE AS lon), x AS (SELECT p.id, {b.km_sql('o', 'p')} AS km FROM places p, o) SELECT id, round(km, 6) AS km, round(km / 4.5 * 60, 6) AS walk_min FROM x WHERE km <= 40")
def radius_search(s, d):
    return nw.within_radius(b.places(s, d), 50.85, 4.35, 40.0).select("id", r("km").alias("km"), r("walk_min").alias("walk_min"))


@query(f"""WITH {b.PLACES}, g AS (SELECT i, j, 49.4 + i * ((51.6 - 49.4) / 39)::DOUBLE AS lat, 2.5 + j * ((6.5 - 2.5) / 39)::DOUBLE AS lon FROM range(40) a(i), range(40) c(j)), t AS (SELECT i, j, min((abs(g.lat - p.lat) * 111 + abs(g.lon - p.lon) * 71) / 5.0 * 60) AS time FROM g, places p GROUP BY 1, 2)
SELECT round(median(time), 3) AS median, round(avg(time), 3) AS mean, round(quantile_cont(time, 0.95), 3) AS p95, round(avg(CASE WHEN time <= 30 THEN 100.0 ELSE 0 END), 3) AS pct_30min FROM t""")
def grid_minplus(s, d):
    x = nw.coverage(ra.reach_time(nw.raster(s, 40), b.places(s, d).withColumn("base", F.lit(0.0))))
    return x.select(*[r(c, 3).alias(c) for c in ("median", "mean", "p95", "pct_30min")])


@query("SELECT r_name AS region, n_name AS province, count(*) AS n, round(sum(s_acctbal), 4) AS total, round(avg(s_acctbal), 4) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def province_rollup(s, d):
    n, g = b.table(s, d, "nation"), b.table(s, d, "region")
    x = b.table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("province")).agg(F.count("*").alias("n"), r(F.sum("s_acctbal"), 4).alias("total"), r(F.avg("s_acctbal"), 4).alias("mean"))


@query("WITH o AS (SELECT s_acctbal AS v, row_number() OVER (ORDER BY s_acctbal) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT min(v) FILTER (WHERE i = floor(n * 0.33)) AS t1, min(v) FILTER (WHERE i = floor(n * 0.66)) AS t2 FROM o")
def terciles(s, d):
    return nw.terciles(b.table(s, d, "supplier"), "s_acctbal")


@query("SELECT " + ", ".join(f"round(quantile_cont(s_acctbal, {i / 4}), 6) AS q{i}" for i in range(5)) + " FROM supplier")
def quantile_bins(s, d):
    x = nw.quantile_edges(b.table(s, d, "supplier"), "s_acctbal", 4)
    return x.select(*[r(c).alias(c) for c in x.columns])


@query(f"WITH {b.CONN}, x AS (SELECT station, dep_hour, sum(missed) * 100.0 / count(*) AS p FROM conn GROUP BY 1, 2), w AS (SELECT greatest(ceil(max(p) / 15), 1) AS w FROM x) SELECT CAST(floor(p / w) AS BIGINT) AS bin, count(*) AS n FROM x, w GROUP BY 1")
def miss_rate_hist(s, d):
    x = co.rollup(_counted(s, d), "station", "dep_hour").select((F.col("missed") * 100.0 / F.col("planned")).alias("p"))
    w = x.agg(F.greatest(F.ceil(F.max("p") / 15), F.lit(1)).alias("w"))
    return x.join(F.broadcast(w)).groupBy(F.floor(F.col("p") / F.col("w")).alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {b.CONN} SELECT dow, " + ", ".join(f"CAST(coalesce(sum(missed) FILTER (WHERE dep_hour = {h}), 0) AS BIGINT) AS h{h}" for h in range(24)) + " FROM conn GROUP BY 1")
def heatmap_pivot(s, d):
    x = _counted(s, d).groupBy("dow").pivot("dep_hour", list(range(24))).agg(F.sum("missed").cast("long"))
    return x.select("dow", *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h}") for h in range(24)])


@query(f"WITH {b.CONN} SELECT CASE WHEN dep_hour BETWEEN 7 AND 9 OR dep_hour BETWEEN 17 AND 19 THEN 'rush' ELSE 'other' END AS period, count(*) AS planned, round(sum(missed) * 100.0 / count(*), 6) AS pct FROM conn GROUP BY 1")
def rush_hours(s, d):
    h = F.col("dep_hour")
    return co.rollup(_counted(s, d).withColumn("period", F.when(h.between(7, 9) | h.between(17, 19), "rush").otherwise("other")), "period").select("period", "planned", r(F.col("missed") * 100.0 / F.col("planned")).alias("pct"))


@query("SELECT s_nationkey AS nation, s_name AS name, s_acctbal AS value FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) WHERE k = 1")
def dedup_best(s, d):
    x = nw.best_by(b.table(s, d, "supplier"), "s_nationkey", F.desc("s_acctbal"), F.col("s_suppkey"))
    return x.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"))


@query("SELECT id, least(min(o_orderkey * 2) OVER w, c) AS component FROM (SELECT o_orderkey * 2 AS id, o_orderkey, o_custkey * 2 + 1 AS c FROM orders UNION SELECT o_custkey * 2 + 1, o_orderkey, o_custkey * 2 + 1 FROM orders) WINDOW w AS (PARTITION BY c) QUALIFY row_number() OVER (PARTITION BY id) = 1")
def components(s, d):
    e = b.table(s, d, "orders").select((F.col("o_orderkey") * 2).alias("a"), (F.col("o_custkey") * 2 + 1).alias("b"))
    return nw.components(e, f"{shared_dir(s)}/components-{uuid.uuid4().hex}")


def _reached(s, d):
    return se.search(se.window_jobs(b.places(s, d), 7, 8), nw.edges(b.stop_times(s, d)), budget=90, paths=False, best=True)


@query()
def reach(s, d):
    return se.reach_counts(_reached(s, d))


@query()
def duration_to(s, d):
    e = se.reverse(nw.edges(b.stop_times(s, d)))
    jobs = b.places(s, d).select(F.col("id").cast("string").alias("origin"), F.explode(F.sequence(F.lit(-535), F.lit(-480), F.lit(5))).alias("start"), F.lit(None).cast("map<string,double>").alias("seeds"))
    return se.search(jobs, e, budget=180, paths=False, best=True).groupBy("station").agg(F.min("minutes").alias("minutes"), F.round(F.avg("minutes"), 4).alias("mean"), F.max("minutes").alias("most"))


@query()
def cardinal_reach(s, d):
    return se.cardinal_reach(_reached(s, d), b.places(s, d))


def _rails(s, d):
    p = b.places(s, d).select("id", "lat", "lon")
    e = nw.edges(b.stop_times(s, d)).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    e = e.join(p.toDF("a", "la", "oa"), "a").join(p.toDF("b", "lb", "ob"), "b").select("a", "b", sc.haversine_km(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")).alias("km"))
    return se.rail_distances(p, e)


@query(f"""WITH {b.PLACES}, {b.EDGES}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS z FROM edges WHERE src <> dst), k AS (SELECT a, z, {b.km_sql('p', 'q')} AS km FROM u JOIN places p ON p.id = a JOIN places q ON q.id = z),
d1 AS (SELECT a AS x, z AS y, km FROM k UNION ALL SELECT z, a, km FROM k UNION ALL SELECT id, id, 0 FROM places),
d2 AS MATERIALIZED (SELECT l.x, m.y, min(l.km + m.km) AS km FROM d1 l JOIN d1 m ON l.y = m.x GROUP BY 1, 2), d4 AS MATERIALIZED (SELECT l.x, m.y, min(l.km + m.km) AS km FROM d2 l JOIN d2 m ON l.y = m.x GROUP BY 1, 2),
d8 AS (SELECT l.x, m.y, min(l.km + m.km) AS km FROM d4 l JOIN d4 m ON l.y = m.x GROUP BY 1, 2) SELECT CAST(x AS VARCHAR) AS origin, CAST(y AS VARCHAR) AS station, round(km, 6) AS km FROM d8 WHERE x <> y""")
def rail_distance(s, d):
    return _rails(s, d).withColumn("km", r("km"))


@query()
def speed_matrix(s, d):
    e = nw.edges(b.stop_times(s, d))
    found = se.search(se.departure_jobs(b.places(s, d), e, 8, 20), e, budget=240, paths=False, best=True, every=60)
    x = se.speed_matrix(found, _rails(s, d), 12)
    return x.withColumn("class", sc.speed_class(F.col("kmh")))


@query()
def door_to_door(s, d):
    p = b.places(s, d)
    seeds = nw.within_radius(p, 50.85, 4.35, 60.0).agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "walk_min"))).alias("seeds"))
    jobs = seeds.select(F.lit("door").alias("origin"), F.explode(F.sequence(F.lit(300), F.lit(540), F.lit(15))).alias("start"), "seeds").filter("size(seeds) > 0")
    return se.search(jobs, nw.edges(b.stop_times(s, d)), budget=900, penalty=3, walks=nw.transfer_band(p, 4.0), best=True).select("origin", "station", "minutes", "start", "transfers", "path")


@query(f"WITH {b.CONN} SELECT {_ROLL}, round(CAST(sum(close_call) AS DOUBLE) / greatest(count(*), 1), 6) AS of_planned, round(CAST(sum(close_call) AS DOUBLE) / greatest(sum(close_call) + sum(missed), 1), 6) AS of_doubtful FROM conn")
def close_call_ratios(s, d):
    return co.close_call_ratios(_counted(s, d)).withColumns({"of_planned": r("of_planned"), "of_doubtful": r("of_doubtful")})


@query(f"WITH {b.CONN} SELECT CAST(i AS INTEGER) AS dow, count(dow) AS planned, CAST(coalesce(sum(missed), 0) AS BIGINT) AS missed, CAST(coalesce(sum(close_call), 0) AS BIGINT) AS close_call FROM range(7) g(i) LEFT JOIN conn ON dow = i GROUP BY 1")
def weekday_dense(s, d):
    return co.by_weekday(_counted(s, d))


@query(f"""WITH {b.DREC}, {b.WEATHER}, x AS (SELECT train_no, day_date, avg(d) AS m FROM drec GROUP BY 1, 2), a AS (SELECT train_no, count(*) AS n_days, avg(m) FILTER (WHERE wind >= 40) AS w, avg(m) FILTER (WHERE wind < 40) AS c FROM x JOIN weather USING (day_date) GROUP BY 1)
SELECT train_no, n_days, round(w, 6) AS windy, round(c, 6) AS calm, round(w / c, 6) AS ratio FROM a WHERE n_days >= 5 AND c > 0.1 AND w IS NOT NULL ORDER BY ratio DESC, train_no LIMIT 30""")
def wind_sensitivity(s, d):
    return pu.wind_sensitive(_d(s, d), b.weather(s, d)).withColumns({"windy": r("windy"), "calm": r("calm")})


@query(f"""WITH {b.DREC}, h AS (SELECT CAST(ts AS DATE) AS day_date, CAST(hour(ts) AS INTEGER) AS hour, CAST(sum(event_id) % 7 AS DOUBLE) AS rain FROM events GROUP BY 1, 2),
x AS (SELECT day_date, CAST(dep_sec // 3600 AS INTEGER) AS hour, avg(d) AS m, count(*) AS n, count(*) FILTER (WHERE d > 1) AS late FROM drec GROUP BY 1, 2)
SELECT hour, count(*) AS n_days, round(avg(m), 6) AS avg_delay, round(avg(rain), 6) AS avg_rain, round(sum(late) * 100.0 / sum(n), 6) AS pct_late, CASE WHEN count(*) >= 5 THEN round(corr(rain, m), 3) END AS r FROM x JOIN h USING (day_date, hour) GROUP BY 1""")
def weather_hourly(s, d):
    w = b.table(s, d, "events").groupBy(F.to_date("ts").alias("day_date"), F.hour("ts").alias("hour")).agg((F.sum("event_id") % 7).cast("double").alias("rain"))
    return pu.hourly_weather(_d(s, d), w, "rain").select("hour", "n_days", r("avg_delay").alias("avg_delay"), r("avg_factor").alias("avg_rain"), r("pct_late").alias("pct_late"), r("r", 3).alias("r"))


@query(f"WITH {b.SCHED} SELECT CAST(i AS INTEGER) AS hour, count(train_no) AS deleted FROM range(24) g(i) LEFT JOIN gone ON (train_no * 37) % 1200 // 60 = i GROUP BY 1")
def cancelled_hourly(s, d):
    gone = pu.cancelled(b.scheduled(s, d), b.observed(s, d))
    return pu.cancelled_hourly(gone.withColumn("hour", F.floor((F.col("train_no") * 37) % 1200 / 60).cast("int")))


#: Two made-up areas: name, south, north, west, east.
AREAS = [("north", 50.6005, 51.4005, 3.0005, 5.5005), ("south", 49.6005, 50.4005, 4.0005, 6.0005)]


@query(f"""WITH {b.PLACES}, areas(name, s, n, w, e) AS (VALUES {", ".join(f"('{a[0]}', {a[1]}::DOUBLE, {a[2]}::DOUBLE, {a[3]}::DOUBLE, {a[4]}::DOUBLE)" for a in AREAS)}), c AS (SELECT name, (s + n) / 2 AS lat, (w + e) / 2 AS lon FROM areas),
x AS (SELECT places.id, min(name) AS area FROM places, areas WHERE lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY 1),
y AS (SELECT places.id, arg_min(c.name, {b.km_sql('places', 'c')}) AS near, min({b.km_sql('places', 'c')}) AS km FROM places, c GROUP BY 1)
SELECT id, coalesce(area, CASE WHEN km < 60 THEN near END) AS area FROM y LEFT JOIN x USING (id)""")
def area_of_stops(s, d):
    box = lambda a: [[[a[3], a[1]], [a[4], a[1]], [a[4], a[2]], [a[3], a[2]]]]
    areas = s.createDataFrame([(a[0], box(a)) for a in AREAS], "name string, rings array<array<array<double>>>")
    centres = s.createDataFrame([(a[0], (a[1] + a[2]) / 2, (a[3] + a[4]) / 2) for a in AREAS], "name string, lat double, lon double")
    return nw.assign_area(b.places(s, d), areas, centres, 60.0)


@query(f"""WITH {b.PLACES}, g AS (SELECT i, j, 49.4 + i * ((51.6 - 49.4) / 39)::DOUBLE AS lat, 2.5 + j * ((6.5 - 2.5) / 39)::DOUBLE AS lon FROM range(40) a(i), range(40) c(j)), k AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, id, row_number() OVER (PARTITION BY i, j ORDER BY pow(g.lat - p.lat, 2) + pow(g.lon - p.lon, 2), id) AS k FROM g, places p) SELECT i, j, id FROM k WHERE k = 1""")
def nearest_cells(s, d):
    return ne.nearest_cells(nw.raster(s, 40), b.places(s, d))


@query("SELECT CAST(greatest(a, DATE '2025-01-03') AS VARCHAR) AS start, CAST(least(z, DATE '2025-11-01') AS VARCHAR) AS finish, name FROM (VALUES "
       + ", ".join(f"(DATE '{a}', DATE '{z}', '{n.replace(chr(39), chr(39) * 2)}')" for a, z, n in cal.SCHOOL_HOLIDAYS) + ") h(a, z, name) WHERE z >= DATE '2025-01-03' AND a <= DATE '2025-11-01'")
def holiday_periods(s, d):
    return cal.clipped_periods(cal.school_holidays(s), "2025-01-03", "2025-11-01").select(F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("finish"), "name")


@query("""WITH st AS (SELECT CAST(s_nationkey % 3 AS VARCHAR) AS operator, s_suppkey AS stop_id, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey // 4 END AS parent FROM supplier), v AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45),
served AS (SELECT operator, stop_id FROM st JOIN v ON id = stop_id), k AS (SELECT *, operator || ':' || CAST(coalesce(parent, stop_id) AS VARCHAR) AS station FROM st WHERE (operator, stop_id) IN (SELECT (operator, stop_id) FROM served) OR (operator, parent) IN (SELECT (operator, stop_id) FROM served))
SELECT station, stop_id FROM k QUALIFY row_number() OVER (PARTITION BY station ORDER BY stop_id) = 1""")
def active_stops(s, d):
    k = F.col("s_suppkey")
    stops = b.table(s, d, "supplier").select((F.col("s_nationkey") % 3).cast("string").alias("operator"), k.alias("stop_id"), F.when(k % 4 == 0, F.floor(k / 4)).alias("parent_station"), k.alias("ordinal"))
    served = b.table(s, d, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_suppkey").alias("stop_id")).distinct().join(stops.select("operator", "stop_id"), "stop_id")
    return nw.active_stops(stops, served).select("station", "stop_id")


def _track(s, d):
    """Made-up track: stops within 60 km of one another."""
    return nw.transfer_band(b.places(s, d), 60.0).filter("stop_a < stop_b").select(F.col("stop_a").cast("string").alias("a"), F.col("stop_b").cast("string").alias("b"))


def _flow(s, d):
    f = nw.segment_frequency(nw.edges(b.stop_times(s, d)), 7)
    return f.select(F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"), "freq").filter("from_id <> to_id")


@query()
def track_frequency(s, d):
    f, t = written(_flow(s, d), "flow"), written(_track(s, d), "track")
    return nw.map_to_track(f, t, se.block_paths(f, t)).withColumn("freq", r("freq"))


@query()
def track_geometry(s, d):
    p, t = b.places(s, d), written(_track(s, d), "track")
    spot = lambda n: p.select(F.col("id").cast("string").alias(n), F.struct("lat", "lon").alias(f"at_{n}"))
    track = t.join(spot("a"), "a").join(spot("b"), "b").select("a", "b", F.array("at_a", "at_b").alias("coords"))
    f = written(_flow(s, d).select("from_id", "to_id"), "flow")
    return nw.path_geometry(f.withColumn("hops", F.array("from_id", "to_id")), track, se.block_paths(f, t, 10), p)
