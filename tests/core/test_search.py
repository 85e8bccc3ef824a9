from railspan.operators import search as se
from railspan.plans import registry


def tables(spark, at, trips, n):
    """lineitem and supplier for trips (number, stops): trip k leaves its first stop at k * 37 % 1200 + 11."""
    rows = [(k, i, stop) for k, stops in trips for i, stop in enumerate(stops, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(i, 0) for i in range(1, n + 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    return str(at)


def leaving(minute):
    return next(k for k in range(1, 1201) if k * 37 % 1200 + 11 == minute)


def test_departures_within_the_window(spark):
    edge = spark.createDataFrame([(1, 479), (1, 480), (1, 480), (1, 1199), (1, 1200), (3, 500)], "src long, dep_min long")
    got = {(r.origin, r.start) for r in se.departure_jobs(spark.createDataFrame([(1,), (2,)], "id long"), edge, 8, 20).collect()}
    assert got == {("1", 480), ("1", 1199)} | {("2", h * 60) for h in range(8, 20)}


def test_speed_takes_no_waiting_time(spark, tmp_path):
    at = tables(spark, tmp_path, [(leaving(60 * h + 29), [1, 2]) for h in range(8, 15)], 2)
    assert [(r.origin, r.station, r.minutes) for r in registry.QUERIES["speed_matrix"](spark, at).collect()] == [("1", "2", 11)]


def test_reach_tries_every_five_minutes(spark, tmp_path):
    at = tables(spark, tmp_path, [(leaving(435), [1, 2, 3, 4, 5, 6, 7, 8]), (leaving(525), [8, 9])], 9)
    swept = registry._reached(spark, at).filter("origin = '1' and station = '8'").first()
    assert (swept.minutes, swept.start) == (77, 435)
    at = tables(spark, tmp_path / "later", [(leaving(431), [1, 2, 3, 4, 5, 6, 7, 8])], 8)
    assert registry._reached(spark, at).filter("origin = '1' and station = '8'").first().minutes == 78


def test_duration_to_tries_the_arrival_window(spark, tmp_path):
    at = tables(spark, tmp_path, [(leaving(519), [1, 2])], 2)
    assert [(r.station, r.minutes) for r in registry.QUERIES["duration_to"](spark, at).collect()] == [("1", 11)]
