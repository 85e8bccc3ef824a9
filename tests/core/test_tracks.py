import datetime

import pytest

from railspan.operators import connections as co
from railspan.operators import network as nw
from railspan.operators import search as se
from railspan.streaming.incremental import write_connections


def brute_hops(edges, origin, most):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    depth, ring = {origin: 0}, {origin}
    for n in range(1, most + 1):
        ring = {y for x in ring for y in near.get(x, ())} - set(depth)
        depth |= dict.fromkeys(ring, n)
    return depth, near


def test_hop_paths_are_shortest_and_on_the_track(spark):
    edges = [(str(i * 7 % 30), str(i * i % 31)) for i in range(40)]
    nodes = sorted({x for e in edges for x in e})
    pairs = [(a, b) for a in nodes for b in nodes]
    got = {(r.from_id, r.to_id): r.hops for r in se.hop_paths(spark.createDataFrame(pairs, "from_id string, to_id string"), spark.createDataFrame(edges, "a string, b string"), 4).collect()}
    want = {}
    for a in nodes:
        depth, near = brute_hops(edges, a, 4)
        want |= {(a, b): n for b, n in depth.items() if b != a}
    assert {k: len(v) - 1 for k, v in got.items()} == want
    assert all(y in near[x] for hops in got.values() for x, y in zip(hops, hops[1:], strict=False))


def test_path_geometry_takes_track_detour_or_line(spark):
    at = lambda *x: [{"lat": float(v), "lon": 0.0} for v in x]
    track = spark.createDataFrame([("a", "b", at(0, 1)), ("b", "a", at(1, 0.5, 0)), ("b", "c", at(1, 2))], "a string, b string, coords array<struct<lat:double,lon:double>>")
    paths = spark.createDataFrame([("b", "d", ["b", "a", "c", "d"]), ("a", "a", ["a"])], "from_id string, to_id string, hops array<string>")
    detours = spark.createDataFrame([("a", "c", ["a", "b", "c"])], "from_id string, to_id string, hops array<string>")
    points = spark.createDataFrame([(x, float(i), 0.0) for i, x in enumerate("abcd")], "id string, lat double, lon double")
    rows = sorted(nw.path_geometry(paths, track, detours, points).collect(), key=lambda r: (r.pos, r.part))
    assert [(r.pos, r.part, r.x, r.y, r.how, [c.lat for c in r.coords]) for r in rows] == [
        (0, 0, "b", "a", "track", [1, 0.5, 0]), (1, 0, "a", "b", "detour", [0, 0.5, 1]), (1, 1, "b", "c", "detour", [1, 2]), (2, 0, "c", "d", "line", [2, 3])]


def test_components_of_a_chain_and_a_pair(spark, tmp_path):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.id: r.component for r in nw.components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/c").collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def test_components_of_a_long_descending_chain(spark, tmp_path):
    edges = spark.createDataFrame([(0, 200), *((i, i - 1) for i in range(200, 1, -1)), (500, 500)], "a long, b long")
    got = {r.id: r.component for r in nw.components(edges, f"file://{tmp_path}/c").collect()}
    assert got == dict.fromkeys(range(201), 0) | {500: 500}
    with pytest.raises(RuntimeError):
        nw.components(edges, f"file://{tmp_path}/d", max_rounds=2)


def test_connections_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    day = datetime.date(2025, 1, 1)
    rows = [(day + datetime.timedelta(i % 2), i % 2, "s", str(i), "L", 28800 + 60 * i, 28800 + 60 * i, (i * 97) % 400, (i * 31) % 200) for i in range(40)]
    rec = spark.createDataFrame(rows, "day_date date, dow int, station string, train_no string, relation string, arr_sec long, dep_sec long, delay_arr long, delay_dep long")
    rec.write.parquet(str(tmp_path / "in"))
    q = write_connections(spark.readStream.schema(rec.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    want = co.connections(rec)
    got = spark.read.parquet(str(tmp_path / "out")).select(want.columns)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(got) == key(want) and got.count() > 0
