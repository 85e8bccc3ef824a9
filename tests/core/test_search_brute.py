import heapq
import random

import pytest
from pyspark.sql import functions as F

from railspan.operators import search as se


def brute(edges, walks, seeds, start, budget, most, penalty, early_stop=False):
    """Stations in order of their labels (arrival, changes, trip): each is settled once, and only then travelled on from."""
    heap = [(start + m, 0, None, s) for s, m in seeds.items()]
    done, end = {}, start + budget
    key = lambda x: (x[0], x[1], x[2] is not None, x[2] or 0, x[3])
    heap = [(key(x), x) for x in heap]
    heapq.heapify(heap)
    while heap:
        now, changes, trip, here = heapq.heappop(heap)[1]
        if here in done:
            continue
        done[here] = (now, changes)
        push, first = [], set()
        for dep, arr, t, to in sorted((d, a, t, y) for x, d, y, a, t in edges if x == here and d >= now):
            if arr > end and early_stop:
                break
            if arr > end or to in done:
                continue
            if trip is not None and t == trip:
                push.append((arr, changes, t, to))
            elif to not in first and (trip is None or (dep >= now + penalty and changes < most)):
                first.add(to)
                push.append((arr, changes + (trip is not None), t, to))
        push += [(now + m, changes, None, y) for x, y, m in walks if x == here and now + m <= end]
        for x in push:
            heapq.heappush(heap, (key(x), x))
    return {s: (round(t - start), c) for s, (t, c) in done.items() if seeds.get(s) != 0}


def network(r, stations, trips):
    out = []
    for k in range(trips):
        at, t = r.randrange(stations), r.randrange(60, 200)
        for _ in range(r.randrange(1, 7)):
            to, run = r.randrange(stations), r.choice((1, 2, 3, 5, 8, 20))
            if to != at:
                out.append((f"s{at}", t, f"s{to}", t + run, f"t{k}"))
            at, t = to, t + run + r.choice((0, 0, 1, 4))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_search_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(se, "JOBS", 7)
    monkeypatch.setattr(se, "SLOT", 20)
    r = random.Random(seed)
    edges = network(r, 14, 90)
    walks = [(f"s{r.randrange(14)}", f"s{r.randrange(14)}", r.choice((0.5, 3.25, 10.0))) for _ in range(12 if seed % 2 else 0)]
    jobs = [(f"s{r.randrange(14)}", start, None) for start in range(55, 150, 5) for _ in range(2)]
    jobs = list({j[:2]: j for j in jobs}.values()) + [("door", 80, {"s1": 2.5, "s2": 0.0, "s3": 9.0})]
    e = spark.createDataFrame([*edges, (None, 1, "s1", 2, "t")], "src string, dep_min long, dst string, arr_min long, trip_id string")
    codes = {x.trip_id: x.c for x in e.select("trip_id", F.xxhash64("trip_id").alias("c")).distinct().collect()}
    coded = [(a, d, b, x, codes[t]) for a, d, b, x, t in edges]
    feet = spark.createDataFrame(walks, "stop_a string, stop_b string, walk_min double")
    got = {}
    for x in se.search(spark.createDataFrame(jobs, "origin string, start int, seeds map<string,double>"), e, budget=60, max_transfers=2, penalty=4, walks=feet).collect():
        assert got.setdefault((x.origin, x.start, x.station), (x.minutes, x.transfers)) == (x.minutes, x.transfers)
        assert x.path[-1] == x.station and len(set(x.path)) == len(x.path)
    want = {}
    for origin, start, seeds in jobs:
        found = brute(coded, walks, {origin: 0.0} if seeds is None else seeds, start, 60, 2, 4)
        want |= {(origin, start, s): v for s, v in found.items()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_early_stop_equals_brute_force(spark, seed):
    r = random.Random(20 + seed)
    edges = network(r, 12, 90)
    e = spark.createDataFrame(edges, "src string, dep_min long, dst string, arr_min long, trip_id string")
    codes = {x.trip_id: x.c for x in e.select("trip_id", F.xxhash64("trip_id").alias("c")).distinct().collect()}
    turned = [(y, -a, x, -d, codes[t]) for x, d, y, a, t in edges]
    jobs = [(f"s{k}", -t, None) for k in range(12) for t in range(150, 200, 10)]
    found = {}
    for stop in (False, True):
        got = se.search(spark.createDataFrame(jobs, "origin string, start int, seeds map<string,double>"), se.reverse(e), budget=40, max_transfers=2, penalty=4, early_stop=stop).collect()
        found[stop] = {(x.origin, x.start, x.station): (x.minutes, x.transfers) for x in got}
        assert found[stop] == {(o, s, at): v for o, s, _ in jobs for at, v in brute(turned, [], {o: 0.0}, s, 40, 2, 4, stop).items()}
    assert found[True] != found[False]


def test_search_of_nothing(spark):
    jobs = spark.createDataFrame([], "origin string, start int, seeds map<string,double>")
    edges = spark.createDataFrame([], "src string, dep_min long, dst string, arr_min long, trip_id string")
    assert se.search(jobs, edges).count() == 0
    assert se.search(spark.createDataFrame([("a", 10, None), (None, 1, None)], jobs.schema), edges).count() == 0


def test_sweep_without_paths_keeps_the_same_rows(spark):
    rows = [("a", -30, "b", 12, 1, None), ("a", -35, "b", 12, 0, None), ("a", 5, "c", 3, 2, None), ("a", 10, "c", 3, 0, None)]
    found = spark.createDataFrame(rows, se.RESULT)
    cols = ["origin", "station", "minutes", "start", "transfers"]
    assert sorted(se.sweep(found, False).select(cols).collect()) == sorted(se.sweep(found).select(cols).collect())


def test_rail_distances_equal_brute_force(spark):
    r = random.Random(3)
    rails = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}", r.choice((1.0, 2.5, 4.0, 9.0))) for _ in range(45)] + [("n1", "n1", 1.0), (None, "n2", 1.0)]
    nodes = [f"n{i}" for i in range(30)]
    far = {(a, b): 0.0 if a == b else float("inf") for a in nodes for b in nodes}
    for a, b, km in rails:
        if a and a != b:
            far[a, b] = far[b, a] = min(far[a, b], km)
    for k in nodes:
        for a in nodes:
            for b in nodes:
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    got = {(x.origin, x.station): x.km for x in se.rail_distances(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(rails, "a string, b string, km double")).collect()}
    assert got == {k: v for k, v in far.items() if k[0] != k[1] and v < float("inf")}


@pytest.mark.parametrize("seed", range(3))
def test_walks_of_no_time_lead_no_path_in_circles(spark, seed):
    """Stations at one place: a walk to the next one and back is no way to a station, nor does it undo a label's trip."""
    r = random.Random(40 + seed)
    edges = network(r, 12, 120)
    pairs = [(0, 1), (2, 3), (3, 4), (2, 4), (5, 6)]
    walks = [(f"s{x}", f"s{y}", 0.0) for a, b in pairs for x, y in ((a, b), (b, a))] + [("s4", "s7", 2.5), ("s7", "s4", 2.5)]
    jobs = [(f"s{k}", start, None) for k in range(12) for start in range(60, 140, 20)] + [("door", 80, {"s1": 2.5, "s2": 0.0, "s7": 9.0})]
    e = spark.createDataFrame(edges, "src string, dep_min long, dst string, arr_min long, trip_id string")
    codes = {x.trip_id: x.c for x in e.select("trip_id", F.xxhash64("trip_id").alias("c")).distinct().collect()}
    coded = [(a, d, b, x, codes[t]) for a, d, b, x, t in edges]
    found = se.search(spark.createDataFrame(jobs, "origin string, start int, seeds map<string,double>"), e, budget=60, max_transfers=2, penalty=4, walks=spark.createDataFrame(walks, "stop_a string, stop_b string, walk_min double"))
    got = {}
    for x in found.collect():
        assert len(set(x.path)) == len(x.path)
        got[x.origin, x.start, x.station] = (x.minutes, x.transfers)
    assert got == {(o, t, at): v for o, t, seeds in jobs for at, v in brute(coded, walks, {o: 0.0} if seeds is None else seeds, t, 60, 2, 4).items()}


def test_rail_distances_by_blocks_make_no_row_for_a_way(spark, monkeypatch):
    """Separate full networks in several blocks: equal to brute force, and each round's table holds a row for a pair, not for a way."""
    monkeypatch.setattr(se, "ORIGINS", 4)
    r = random.Random(8)
    rails = [(f"{net}{a}", f"{net}{b}", float(r.randrange(1, 50))) for net in "uvw" for a in range(9) for b in range(a)]
    nodes = [f"{net}{i}" for net in "uvw" for i in range(9)]
    far = {(a, b): 0.0 if a == b else float("inf") for a in nodes for b in nodes}
    for a, b, km in rails:
        far[a, b] = far[b, a] = km
    for k in nodes:
        for a in nodes:
            for b in nodes:
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    held, write = [], se.written
    monkeypatch.setattr(se, "written", lambda df, name: held.append(df) or write(df, name))
    got = se.rail_distances(spark.createDataFrame([(n,) for n in [*nodes, "nowhere", None]], "id string"), spark.createDataFrame(rails, "a string, b string, km double"))
    assert {(x.origin, x.station): x.km for x in got.collect()} == {k: v for k, v in far.items() if k[0] != k[1] and v < float("inf")}
    assert all(df.count() <= 3 * 9 * 9 for df in held) and any("new" in df.columns for df in held)
