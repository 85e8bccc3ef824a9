import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from railspan.operators import geometry
from railspan.sources import readers
from railspan.streaming.incremental import sliding_delay


def saved(folder, value, name="x.json"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(folder)


def features(*rows):
    return {"type": "FeatureCollection", "features": [{"properties": p, "geometry": {"type": t, "coordinates": c}} for p, t, c in rows]}


def test_points_fall_back_to_the_geometry(spark, tmp_path):
    at = saved(tmp_path, features(({"ptcarid": "1", "longnamedutch": "A", "geo_point_2d": {"lat": 50.0, "lon": 4.0}}, "Point", [9.0, 9.0]), ({"ptcarid": "2", "longnamedutch": "B"}, "Point", [4.5, 51.0])))
    assert sorted(map(tuple, readers.read_points(spark, at).collect())) == [("1", "A", 50.0, 4.0), ("2", "B", 51.0, 4.5)]


def test_segments_take_the_longest_line(spark, tmp_path):
    ends = {"stationfrom_id": "a", "stationto_id": "b", "stationfrom_name": "A", "stationto_name": "B"}
    at = saved(tmp_path, features((ends, "LineString", [[4, 50], [5, 51]]), (ends, "MultiLineString", [[[1, 2], [3, 4]], [[5, 6], [7, 8], [9, 10]]])))
    got = sorted([(c.lat, c.lon) for c in r.coords] for r in readers.read_segments(spark, at).collect())
    assert got == [[(6.0, 5.0), (8.0, 7.0), (10.0, 9.0)], [(50.0, 4.0), (51.0, 5.0)]]


def test_provinces_have_rings(spark, tmp_path):
    ring = [[0, 0], [0, 1], [1, 1], [0, 0]]
    at = saved(tmp_path, features(({"name": "p"}, "Polygon", [ring]), ({"name": "q"}, "MultiPolygon", [[ring], [ring, ring]])))
    assert {r.name: len(r.rings) for r in readers.read_provinces(spark, at).collect()} == {"p": 1, "q": 3}


def test_weather_rows(spark, tmp_path):
    daily = {"time": ["2025-01-01", "2025-01-02"]} | {n: [1.0, None] for n in readers.DAILY}
    hourly = {"time": ["2025-01-01T07:00"]} | {n: [None] for n in readers.HOURLY}
    d = readers.read_weather(spark, saved(tmp_path / "d", {"daily": daily})).orderBy("date").collect()
    h = readers.read_weather(spark, saved(tmp_path / "h", {"hourly": hourly}), hourly=True).collect()
    assert [r.rain_sum for r in d] == [1.0, None] and d[0].date == datetime.date(2025, 1, 1)
    assert h[0].hour == 7 and h[0].rain == 0.0 and h[0].temperature_2m == 10.0


def test_punctuality_is_typed(spark, tmp_path):
    row = {"train_no": " 12 ", "ptcar_lg_nm_nl": " Gent ", "delay_arr": "61", "delay_dep": None}
    saved(tmp_path / "day_date=2025-01-06", json.dumps(row) + "\n" + json.dumps({"train_no": None}))
    got = {r.train_no: r for r in readers.read_punctuality(spark, str(tmp_path)).collect()}
    assert (got["12"].station, got["12"].delay_arr, got["12"].delay_dep, got["12"].dow) == ("GENT", 61, 0, 0)
    assert got[None].delay_arr == 0


def test_written_days_are_pruned(spark, tmp_path):
    df = spark.range(100).select("id", F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("day_date"))
    readers.write_partitioned(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("day_date = date'2025-01-02'").count() == 33


def test_latest_snapshot(spark):
    d = lambda n: datetime.date(2025, 1, n)
    active = spark.createDataFrame([(d(1), 5), (d(8), 0), (d(3), 2)], "snapshot_date date, n_services int")
    wanted = spark.createDataFrame([(d(9),), (d(2),), (d(20),)], "day_date date")
    assert {r.day_date: r.snapshot_date for r in readers.latest_snapshot(active, wanted).collect()} == {d(9): d(3), d(2): d(1), d(20): None}


def test_sliding_delay_over_a_stream(spark, tmp_path):
    rows = [(datetime.datetime(2025, 1, 1, 8, m), "a", float(m)) for m in (0, 10, 20, 40)]
    batch = spark.createDataFrame(rows, "ts timestamp, station string, delay double")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = sliding_delay(stream).writeStream.format("memory").queryName("sliding").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("sliding")) == key(sliding_delay(batch)) and spark.table("sliding").count() == 4  # from 7:45, 8:00, 8:15 and 8:30


def line(lon0, lon1, lat=50.0, n=40):
    return np.column_stack([np.full(n, lat), np.linspace(lon0, lon1, n)])


def test_alike_lines_become_one_and_far_ones_stay():
    merged = geometry.resolve([(2.0, line(4, 5)), (3.0, line(5, 4, 50.001)), (7.0, line(4, 5, 50.2))], 0.5, 0.7, 0.5)
    assert sorted(f for f, _ in merged) == [5.0, 7.0]


def test_a_short_line_cuts_the_long_one():
    parts = geometry.resolve([(2.0, line(4, 5)), (3.0, line(4.4, 4.6))], 0.5, 0.7, 0.5)
    assert sorted(f for f, _ in parts) == [2.0, 2.0, 5.0]
    assert sum(geometry._length(x) for _, x in parts) == pytest.approx(1.0, abs=0.02)


def test_merge_by_pair_of_ends(spark):
    coords = lambda x: [{"lat": float(a), "lon": float(b)} for a, b in x]
    rows = [("a", "b", 1.0, coords(line(4, 5))), ("b", "a", 2.0, coords(line(5, 4))), ("a", "c", 4.0, coords(line(4, 5))), ("a", "d", 8.0, [])]
    got = geometry.merge_parallel(spark.createDataFrame(rows, "id_a string, id_b string, frequency double, coords array<struct<lat:double,lon:double>>")).collect()
    assert sorted((r.a, r.b, r.frequency) for r in got) == [("a", "b", 3.0), ("a", "c", 4.0), ("a", "d", 8.0)]
