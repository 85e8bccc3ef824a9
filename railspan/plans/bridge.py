"""Transit tables as projections of the driver's tables, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def rec(spark: SparkSession, at: str) -> DataFrame:
    e = table(spark, at, "events")
    sec = (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("long")
    return e.select(F.to_date("ts").alias("day_date"), F.weekday("ts").alias("dow"), F.col("event_type").alias("station"), F.col("user_id").cast("string").alias("train_no"),
                    F.concat(F.lit("L"), (F.col("user_id") % 20).cast("string")).alias("relation"), sec.alias("arr_sec"), sec.alias("dep_sec"),
                    ((F.col("event_id") * 37) % 600).alias("delay_arr"), ((F.col("event_id") * 53) % 240).alias("delay_dep"))


REC = """rec AS (SELECT CAST(ts AS DATE) AS day_date, CAST(isodow(ts) - 1 AS INTEGER) AS dow, event_type AS station, CAST(user_id AS VARCHAR) AS train_no,
  'L' || CAST(user_id % 20 AS VARCHAR) AS relation, CAST(hour(ts) * 3600 + minute(ts) * 60 AS BIGINT) AS arr_sec, CAST(hour(ts) * 3600 + minute(ts) * 60 AS BIGINT) AS dep_sec,
  (event_id * 37) % 600 AS delay_arr, (event_id * 53) % 240 AS delay_dep FROM events)"""

CONN = REC + """, conn0 AS (SELECT a.day_date, a.dow, a.station, a.train_no AS arr_train, d.train_no AS dep_train, a.relation AS rel_arr, d.relation AS rel_dep, a.delay_arr,
  d.dep_sec - a.arr_sec AS gap, d.dep_sec // 3600 AS dep_hour, a.arr_sec + a.delay_arr AS arr_actual, d.dep_sec + d.delay_dep AS dep_actual
  FROM rec a JOIN rec d ON a.day_date = d.day_date AND a.station = d.station AND a.train_no <> d.train_no WHERE d.dep_sec - a.arr_sec BETWEEN 120 AND 900),
conn AS (SELECT *, CAST(dep_actual < arr_actual AS INTEGER) AS missed, CAST(dep_actual >= arr_actual AND dep_actual - arr_actual < 120 AS INTEGER) AS close_call FROM conn0)"""

DREC = REC + """, drec AS (SELECT *, CASE WHEN delay_dep / 60.0 < 0 THEN 0 ELSE least(CAST(delay_dep AS DOUBLE) / 60, 30) END AS d FROM rec)"""


def stop_times(spark: SparkSession, at: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    dep = (k * 37) % 1200 + n * 11
    return table(spark, at, "lineitem").select(k.alias("trip_id"), n.alias("seq"), F.col("l_suppkey").alias("stop"), dep.alias("arr_min"), dep.alias("dep_min"))


EDGES = """st AS (SELECT l_orderkey AS trip_id, l_linenumber AS seq, l_suppkey AS stop, (l_orderkey * 37) % 1200 + l_linenumber * 11 AS t FROM lineitem),
edges0 AS (SELECT trip_id, stop AS src, t AS dep_min, lead(stop) OVER (PARTITION BY trip_id ORDER BY seq, stop) AS dst, lead(t) OVER (PARTITION BY trip_id ORDER BY seq, stop) AS arr_min FROM st),
edges AS (SELECT * FROM edges0 WHERE dst IS NOT NULL), seg AS (SELECT src AS from_id, dst AS to_id, CAST(count(*) AS DOUBLE) / 7 AS freq FROM edges GROUP BY 1, 2)"""


def places(spark: SparkSession, at: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, at, "supplier").select(k.alias("id"), (49.4 + ((k * 7919) % 2200) / F.lit(1000.0)).alias("lat"), (2.5 + ((k * 104729) % 4000) / F.lit(1000.0)).alias("lon"), F.col("s_nationkey").alias("nation"))


def points(spark: SparkSession, at: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, at, "part").select(k.alias("id"), (49.4 + ((k * 6007) % 2200) / F.lit(1000.0)).alias("lat"), (2.5 + ((k * 15485863) % 4000) / F.lit(1000.0)).alias("lon"))


PLACES = """places AS (SELECT s_suppkey AS id, 49.4 + ((s_suppkey * 7919) % 2200) / 1000.0::DOUBLE AS lat, 2.5 + ((s_suppkey * 104729) % 4000) / 1000.0::DOUBLE AS lon, s_nationkey AS nation FROM supplier),
points AS (SELECT p_partkey AS id, 49.4 + ((p_partkey * 6007) % 2200) / 1000.0::DOUBLE AS lat, 2.5 + ((p_partkey * 15485863) % 4000) / 1000.0::DOUBLE AS lon FROM part)"""


def km_sql(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def weather(spark: SparkSession, at: str) -> DataFrame:
    """A made-up series: one row for each day of the events."""
    day = table(spark, at, "events").groupBy(F.to_date("ts").alias("day_date")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value"))).cast("long").alias("v"))
    return day.select("day_date", (F.col("v") % 5).cast("double").alias("rain"), (F.col("v") % 61).cast("double").alias("wind"), (F.col("n") % 13).cast("double").alias("temp"))


WEATHER = """weather AS (SELECT day_date, CAST(v % 5 AS DOUBLE) AS rain, CAST(v % 61 AS DOUBLE) AS wind, CAST(n % 13 AS DOUBLE) AS temp FROM
  (SELECT CAST(ts AS DATE) AS day_date, count(*) AS n, CAST(sum(floor("value")) AS BIGINT) AS v FROM events GROUP BY 1))"""


def scheduled(spark: SparkSession, at: str) -> DataFrame:
    li = table(spark, at, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("stops"))
    return table(spark, at, "orders").join(li, F.col("o_orderkey") == F.col("k")).select(F.to_date("o_orderdate").alias("day_date"), F.col("o_orderkey").alias("train_no"), "stops")


def observed(spark: SparkSession, at: str) -> DataFrame:
    seen = table(spark, at, "lineitem").filter("l_linestatus = 'F' and l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    return table(spark, at, "orders").join(seen, F.col("o_orderkey") == F.col("k"), "left_semi").select(F.to_date("o_orderdate").alias("day_date"), F.col("o_orderkey").alias("train_no"))


SCHED = """stops AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem),
sched AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day_date, o_orderkey AS train_no, c FROM orders JOIN stops ON k = o_orderkey WHERE c >= 2),
gone AS (SELECT * FROM sched WHERE train_no NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1))"""
