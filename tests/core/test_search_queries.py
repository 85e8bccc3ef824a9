"""The registered queries over timetables, each against plain Python over the same tables."""

import collections
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from railspan.plans import details, registry, reports, tails  # noqa: F401
from tests.core.test_nearest import km
from tests.core.test_search import tables
from tests.core.test_search_brute import brute

N = 9


def place(k):
    return 49.4 + k * 7919 % 2200 / 1000, 2.5 + k * 104729 % 4000 / 1000


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Tables of 90 trips between 9 stops, and their edges as (src, dep, dst, arr, code of the trip)."""
    r = random.Random(11)
    trips = []
    for trip in r.sample(range(1, 1200), 260):
        if 240 <= trip * 37 % 1200 <= 960:
            stops = [r.randrange(1, N + 1)]
            while len(stops) < r.randrange(2, 7):
                stops.append(r.choice([s for s in range(1, N + 1) if s != stops[-1]]))
            trips.append((trip, stops))
    at = tables(spark, tmp_path_factory.mktemp("timetable"), trips, N)
    codes = {x.t: x.c for x in spark.createDataFrame([(str(k),) for k, _ in trips], "t string").select("t", F.xxhash64("t").alias("c")).collect()}
    edges = [(str(a), k * 37 % 1200 + 11 * i, str(b), k * 37 % 1200 + 11 * (i + 1), codes[str(k)]) for k, stops in trips for i, (a, b) in enumerate(zip(stops, stops[1:], strict=False), 1)]
    return at, edges


def swept(edges, jobs, budget, penalty=5, walks=(), turned=False):
    """{(origin, station): (minutes, start, changes)} over jobs (origin, start, seeds)."""
    best = {}
    for origin, start, seeds in jobs:
        for at, (minutes, changes) in brute(edges, list(walks), seeds or {origin: 0.0}, start, budget, 3, penalty).items():
            best[origin, at] = min(best.get((origin, at), (math.inf,)), (minutes, start, changes))
    return best


@pytest.fixture(scope="module")
def morning(world):
    return swept(world[1], [(str(k), t, None) for k in range(1, N + 1) for t in range(420, 481, 5)], 90)


def rows(spark, world, name):
    return registry.QUERIES[name](spark, world[0]).collect()


def reached(morning):
    out = collections.defaultdict(list)
    for (o, _), (minutes, *_) in morning.items():
        out[o].append(minutes)
    return out


def cardinal(morning):
    far = collections.defaultdict(dict)
    for o, s in morning:
        (la, lo), (lb, lp) = place(int(o)), place(int(s))
        dlat, dlon = lb - la, lp - lo
        q = ("N" if dlat >= 0 else "S") if abs(dlat) >= abs(dlon) else ("E" if dlon >= 0 else "W")
        far[o][q] = max(far[o].get(q, 0), km(la, lo, lb, lp))
    return {o: sum(v.values()) for o, v in far.items()}


def test_reach(spark, world, morning):
    want = {o: (len(v), pytest.approx(statistics.mean(v))) for o, v in reached(morning).items()}
    assert {x.origin: (x.reachable, x.avg_minutes) for x in rows(spark, world, "reach")} == want and len(want) >= 7


def test_cardinal_reach_and_connectivity(spark, world, morning):
    want = cardinal(morning)
    assert {x.origin: x.reach_km for x in rows(spark, world, "cardinal_reach")} == {o: pytest.approx(v) for o, v in want.items()}
    per_hour = collections.Counter(a for a, dep, *_ in world[1] if 360 <= dep < 1320)
    got = {x.id: (x.reachable, x.per_hour, x.reach_km) for x in rows(spark, world, "connectivity")}
    assert got == {str(k): (len(reached(morning).get(str(k), [])), pytest.approx(per_hour[str(k)] / 16), pytest.approx(want.get(str(k), 0.0))) for k in range(1, N + 1)}


def test_reach_by_area(spark, world, morning):
    counts = [len(v) for v in reached(morning).values()]
    (got,) = rows(spark, world, "reach_by_area")
    assert (got.n, got["mean"]) == (len(counts), pytest.approx(statistics.mean(counts)))


def test_means_by_area(spark, world, morning):
    """All stops are of one area here."""
    got = {x.origin: (x.area, x.n, x["mean"], x.least, x.most) for x in rows(spark, world, "travel_by_area")}
    assert got == {o: (0, len(v), pytest.approx(statistics.mean(v)), min(v), max(v)) for o, v in reached(morning).items()}
    (x,) = rows(spark, world, "reach_means")
    every = reached(morning).values()
    assert (x.n, x.reachable, x.minutes) == (len(every), pytest.approx(statistics.mean(map(len, every))), pytest.approx(statistics.mean(map(statistics.mean, every))))


def test_feeders_carry_on(spark, world):
    table = spark.read.parquet(f"{world[0]}/lineitem.parquet").select("l_orderkey", F.xxhash64(F.col("l_orderkey").cast("string")).alias("c")).distinct().collect()
    even = {x.c for x in table if x.l_orderkey % 2 == 0}
    rail, feeder = [e for e in world[1] if e[4] in even], [e for e in world[1] if e[4] not in even]
    base = {"1": 0.0} | {at: float(m) for at, (m, _) in brute(rail, [], {"1": 0.0}, 420, 120, 3, 5).items()}
    want = {at: int(m) for at, m in base.items()}
    for at, (m, _) in brute(feeder, [], base, 420, 240, 3, 5).items():
        want[at] = min(want.get(at, 10**6), m)
    assert {x.station: x.minutes for x in rows(spark, world, "feeder_times")} == want and len(want) > len(base)


def test_size_summary(spark, world, morning):
    per_hour = collections.Counter(a for a, dep, *_ in world[1] if 360 <= dep < 1320)
    far, groups = cardinal(morning), collections.defaultdict(list)
    for k in map(str, range(1, N + 1)):
        v = per_hour[k] / 16
        groups["Small" if v < 4 else "Medium" if v < 10 else "Big"].append((len(reached(morning).get(k, [])), v, far.get(k, 0.0)))
    got = {x["size"]: (x.n, x.reachable, x.per_hour, x.reach_km) for x in rows(spark, world, "size_summary")}
    assert got == {c: (len(v), *[pytest.approx(statistics.mean(col)) for col in zip(*v, strict=True)]) for c, v in groups.items()}


def test_durations(spark, world, morning):
    first = swept(world[1], [("1", t, None) for t in range(420, 481, 5)], 60)
    want = {str(k): 0.0 if k == 1 else first.get(("1", str(k)), (None,))[0] for k in range(1, N + 1)}
    assert {x.id: x.minutes for x in rows(spark, world, "durations_from")} == want
    turned = [(b, -arr, a, -dep, t) for a, dep, b, arr, t in world[1]]
    found = collections.defaultdict(list)
    for (_, at), (minutes, *_) in swept(turned, [(str(k), t, None) for k in range(1, N + 1) for t in range(-535, -479, 5)], 180).items():
        found[at].append(minutes)
    assert {x.station: (x.minutes, x["mean"], x.most) for x in rows(spark, world, "duration_to")} == {s: (min(v), pytest.approx(statistics.mean(v), abs=1e-4), max(v)) for s, v in found.items()}


def walking():
    at = {str(k): place(k) for k in range(1, N + 1)}
    walks = [(a, b, km(*at[a], *at[b]) / 4.5 * 60) for a in at for b in at if a != b and km(*at[a], *at[b]) <= 4]
    seeds = {a: km(50.85, 4.35, *at[a]) / 4.5 * 60 for a in at if km(50.85, 4.35, *at[a]) <= 60}
    return walks, seeds


def test_door_to_door(spark, world):
    walks, seeds = walking()
    assert len(seeds) >= 2
    want = swept(world[1], [("door", t, seeds) for t in range(300, 541, 15)], 900, 3, walks)
    assert {(x.origin, x.station): (x.minutes, x.start, x.transfers) for x in rows(spark, world, "door_to_door")} == want
    turned = [(b, -arr, a, -dep, t) for a, dep, b, arr, t in world[1]]
    back = swept(turned, [("door", -t, seeds) for t in range(960, 1021, 15)], 900, 3, [(b, a, m) for a, b, m in walks])
    got = {x.station: x.minutes for x in rows(spark, world, "door_to_door_to")}
    assert got == {s: v[0] for (_, s), v in back.items()} and len(got) > 3


def test_gradient_raster(spark, world):
    walks, seeds = walking()
    base = dict(seeds)
    for (_, at), (minutes, *_) in swept(world[1], [("door", 420, seeds)], 400, 3, walks).items():
        base[at] = min(base.get(at, math.inf), float(minutes))
    got = rows(spark, world, "gradient_raster")
    for x in got[::7]:
        lat, lon = 49.4 + x.i * (51.6 - 49.4) / 39, 2.5 + x.j * (6.5 - 2.5) / 39
        assert x.time == pytest.approx(min(m + (abs(lat - place(int(k))[0]) * 111 + abs(lon - place(int(k))[1]) * 71) / 15 * 60 for k, m in base.items()), abs=1e-6)
    assert len(got) > 300


def test_speed_matrix(spark, world):
    edges = world[1]
    starts = {str(k): sorted({dep for a, dep, *_ in edges if a == str(k) and 480 <= dep < 1200}) or list(range(480, 1200, 60)) for k in range(1, N + 1)}
    best, hours = {}, collections.defaultdict(set)
    for o, times in starts.items():
        for t in times:
            for at, (minutes, _) in brute(edges, [], {o: 0.0}, t, 240, 3, 5).items():
                best[o, at] = min(best.get((o, at), math.inf), minutes)
                hours[o, at].add(t // 60)
    way = {(str(a), str(b)): math.inf for a in range(1, N + 1) for b in range(1, N + 1)}
    for a, _, b, *_ in edges:
        way[a, b] = way[b, a] = km(*place(int(a)), *place(int(b)))
    for m in map(str, range(1, N + 1)):
        for a, b in way:
            way[a, b] = min(way[a, b], way[a, m] + way[m, b])
    want = {k: (minutes, pytest.approx(way[k], rel=1e-6)) for k, minutes in best.items() if len(hours[k]) >= 6}
    assert {(x.origin, x.station): (x.minutes, x.km) for x in rows(spark, world, "speed_matrix")} == want and want


def test_track_frequency(spark, world):
    at = {str(k): place(k) for k in range(1, N + 1)}
    beside = {a: {b for b in at if a != b and km(*at[a], *at[b]) <= 60} for a in at}
    freq, out = collections.Counter((a, b) for a, _, b, *_ in world[1]), {}
    for (a, b), n in freq.items():
        level, seen = [[a]], {a}
        while level and level[0][-1] != b:  # by hops, then by names
            new = {}
            for way in level:
                for x in beside[way[-1]] - seen:
                    new[x] = min(new.get(x, [*way, x]), [*way, x])
            seen |= set(new)
            level = sorted(new.values(), key=lambda w: w[-1] != b)
        way = next((w for w in level if w[-1] == b), None)
        how = "direct" if b in beside[a] else "path" if way else "line"
        for x, y in zip(way or [a, b], (way or [a, b])[1:], strict=False):
            f, old = out.get((min(x, y), max(x, y)), (0.0, how))
            out[min(x, y), max(x, y)] = (f + n / 7, min(old, how))
    assert {(x.a, x.b): (x.freq, x.how) for x in rows(spark, world, "track_frequency")} == {k: (pytest.approx(f, abs=1e-5), how) for k, (f, how) in out.items()}
