import datetime
import json
import random

import numpy as np
from pyspark.sql import functions as F

from railspan.operators import filters as fi
from railspan.operators import geometry as ge
from railspan.operators import nearest as ne
from railspan.operators import network as nw
from railspan.operators import search as se
from railspan.sources import readers
from tests.core.test_search_brute import brute, network


def test_time_to_a_point_is_the_search_of_the_turned_timetable(spark):
    r = random.Random(3)
    edges = network(r, 12, 80)
    walks = [("s1", "s2", 3.0), ("s4", "s5", 1.5)]
    e = spark.createDataFrame(edges, "src string, dep_min long, dst string, arr_min long, trip_id string")
    codes = {x.trip_id: x.c for x in e.select("trip_id", F.xxhash64("trip_id").alias("c")).distinct().collect()}
    seeds = {"s1": 2.5, "s3": 0.0}
    jobs = spark.createDataFrame([("door", 180, seeds)], "origin string, start int, seeds map<string,double>")
    got = se.to_point(jobs, e, spark.createDataFrame(walks, "stop_a string, stop_b string, walk_min double"), budget=90, max_transfers=2, penalty=4).collect()
    turned = [(y, -a, x, -d, codes[t]) for x, d, y, a, t in edges]
    want = brute(turned, [(y, x, m) for x, y, m in walks], seeds, -180, 90, 2, 4)
    assert {x.station: x.minutes for x in got} == {s: v[0] for s, v in want.items()}
    assert got and all(x.start == 180 and x.path[0] == x.station and x.path[-1] in seeds for x in got)


def test_overlapping_pairs_equal_all_pairs(spark):
    r = random.Random(5)
    lines = []
    for i in range(40):
        x, y, dx, dy = 50 + r.random() * 0.05, 4 + r.random() * 0.05, r.uniform(-0.3, 0.3), r.uniform(-0.3, 0.3)
        lines.append((i, [(x + dx * t, y + dy * t) for t in np.linspace(0, 1, r.randrange(2, 6)).tolist()]))
        if i % 4 == 0:
            lines.append((100 + i, [(a + 0.001, b) for a, b in lines[-1][1][::-1]]))
    df = spark.createDataFrame([*lines, (900, [(50.0, 4.0)]), (901, None)], "id long, coords array<struct<lat:double,lon:double>>")
    want = set()
    for i, a in lines:
        for j, b in lines:
            if i < j and min(ge.overlap(np.array(a), np.array(b))[0], ge.overlap(np.array(b), np.array(a))[0]) >= 0.7:
                want.add((i, j))
    assert len(want) >= 10
    got = [(x.a, x.b) for x in ge.overlapping(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_holes_and_regions(spark):
    square = lambda a, z: [[a, a], [z, a], [z, z], [a, z]]
    areas = spark.createDataFrame([("p", [square(0.0, 4.0), square(1.0, 2.0)]), ("q", [square(5.0, 6.0)])], "name string, rings array<array<array<double>>>")
    points = spark.createDataFrame([(1, 3.0, 3.1), (2, 1.5, 1.6), (3, 5.5, 5.4), (4, 9.0, 9.0), (5, None, 1.0)], "id int, lat double, lon double")
    assert sorted(x.id for x in nw.within_any(points, areas).collect()) == [1, 3]
    groups = spark.createDataFrame([("p", "r"), ("q", "r")], "name string, group string")
    assert sorted((x.id, x.area) for x in nw.areas_of(points, nw.dissolve(areas, groups)).collect()) == [(1, "r"), (3, "r")]


def test_nearest_cell_of_equals_is_the_least_id(spark):
    cells = spark.createDataFrame([(0, 0, 50.0, 4.0), (0, 1, 50.0, 5.0)], "i int, j int, lat double, lon double")
    stops = spark.createDataFrame([(7, 50.0, 4.5), (3, 50.0, 3.5), (9, 50.0, 5.0)], "id long, lat double, lon double")
    assert {(x.i, x.j): x.id for x in ne.nearest_cells(cells, stops).collect()} == {(0, 0): 3, (0, 1): 9}
    assert ne.nearest_cells(cells, stops.limit(0)).count() == 0


def test_clusters_that_would_swallow_a_segment_are_not_used(spark):
    point = (50.0, 4.0)
    seg = spark.createDataFrame([("a", "b", [point]), ("b", "c", [point]), ("c", "a", [point, point])], "from_id string, to_id string, coords array<struct<lat:double,lon:double>>")
    index = nw.segment_index(seg, spark.createDataFrame([("a", "x"), ("b", "x")], "id string, cluster string"))
    assert sorted((x.a, x.b, len(x.coords)) for x in index.collect()) == [("a", "b", 1), ("c", "x", 2)]
    assert sorted((x.id, x.next) for x in nw.neighbours(index).collect()) == [("a", "b"), ("b", "a"), ("c", "x"), ("x", "c")]


def test_feeds_of_all_operators(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "s", "1", "A", datetime.date(2024, 1, 1)), ("t2", "s", None, "B", datetime.date(2024, 1, 2))], readers.GTFS["trips"] + ", operator string, snapshot_date date")
    rows.write.partitionBy("operator", "snapshot_date").parquet(str(tmp_path / "trips"))
    got = readers.read_operators(spark, str(tmp_path), "trips").filter("operator = 'B'").collect()
    assert [(x.trip_id, x.snapshot_date) for x in got] == [("t2", datetime.date(2024, 1, 2))]


def test_json_lines_keep_nulls(spark, tmp_path):
    readers.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == [{"a": 1, "b": None}]
    assert spark.sql("select date'2024-03-01' as d").select(readers.service_day(F.col("d")).alias("d")).first().d == datetime.date(2024, 2, 28)


def test_words_are_not_numbers(spark):
    df = spark.createDataFrame([("1",), ("NaN",), ("",), (None,), ("x",), (" 2.5 ",)], "v string")
    assert sorted(x.v for x in fi.numeric_only(df, "v").collect()) == [1.0, 2.5]
