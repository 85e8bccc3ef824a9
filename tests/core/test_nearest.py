import math
import random

import pytest
from pyspark.sql import functions as F

from railspan.operators import nearest as ne
from railspan.operators import network as nw


def km(a, o, b, p):
    a, o, b, p = map(math.radians, (a, o, b, p))
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((p - o) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def somewhere(r, n, polar=False):
    lat = lambda: r.choice((r.uniform(-90, 90), r.uniform(84, 90), 89.999, 0.0)) if polar else r.uniform(50, 52)
    lon = lambda: r.choice((r.uniform(-180, 180), r.uniform(179, 180), r.uniform(-180, -179), 180.0, -180.0)) if polar else r.uniform(2, 6)
    return [(i, lat(), lon()) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_nearest_on_the_sphere_equals_all_pairs(spark, seed):
    """Poles, the line of 180 degrees, places in the void, one place for all."""
    r = random.Random(seed)
    left, right = somewhere(r, 60, True), somewhere(r, (40, 3, 1)[seed], True)
    f = lambda rows: spark.createDataFrame([*rows, (99, None, 1.0), (98, 1.0, None), (97, float("nan"), 1.0)], "id int, lat double, lon double")
    got = {x.id: x for x in ne.nearest(f(left), f(right)).collect()}
    assert set(got) == {i for i, *_ in left}
    for i, a, o in left:
        least = min(km(a, o, b, p) for _, b, p in right)
        _, b, p = right[got[i].nearest]
        assert km(a, o, b, p) == pytest.approx(least, abs=1e-3)


def test_nearest_takes_the_least_id_of_equals_and_far_crowds(spark):
    crowd = [(i, 50.0 + i % 7 * 1e-4, 4.0) for i in range(200)]
    left = spark.createDataFrame([(1, 50.0, 4.0), (2, 51.9, 6.3), (3, -40.0, 100.0)], "id int, lat double, lon double")
    got = {x.id: x.nearest for x in ne.nearest(left, spark.createDataFrame(crowd, "id int, lat double, lon double"), ne.planar_km).collect()}
    assert got == {1: 0, 2: 6, 3: 0}
    assert ne.nearest(left, left.limit(0)).count() == 0 and ne.nearest(left.limit(0), left).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_band_and_radius_at_every_latitude(spark, seed):
    r = random.Random(seed)
    rows = somewhere(r, 120, True)
    rows += [(200 + i, a + r.uniform(-0.4, 0.4), o if seed else -o) for i, a, o in rows[:60] if abs(a) < 89]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    pairs = {(i, j) for i, a, o in rows for j, b, p in rows if i != j and km(a, o, b, p) <= 60}
    assert {(x.stop_a, x.stop_b) for x in nw.transfer_band(df, 60.0).collect()} == pairs and len(pairs) > 40
    a, b = [x for x in rows if x[0] % 2], [x for x in rows if x[0] % 2 == 0]
    got = {x.id: x.metres for x in nw.nearest_in_metres(df.filter("id % 2 = 1"), df.filter("id % 2 = 0"), 60_000.0).collect()}
    want = {i: min(km(la, lo, lb, lp) for _, lb, lp in b) * 1000 for i, la, lo in a}
    assert got == {i: pytest.approx(m, abs=1e-3) for i, m in want.items() if m < 60_000}


def test_many_points_at_one_place_meet_as_one(spark, monkeypatch):
    """20000 points at 40 places around each of 3 stops: a stop meets places near it, each once, not all that the radius reaches."""
    right = spark.range(20000).select("id", (50 + (F.col("id") % 40) * 0.001).alias("lat"), (4 + (F.col("id") % 8) * 0.001).alias("lon"))
    left = spark.createDataFrame([(1, 50.0, 4.0), (2, 50.0114, 4.0031), (3, 60.0, 4.0)], "id long, lat double, lon double")
    sizes, keep = {}, ne.written
    monkeypatch.setattr(ne, "written", lambda df, name: sizes.setdefault(name, []).append(keep(df, name)) or sizes[name][-1])
    brute = left.withColumnsRenamed({"lat": "la", "lon": "lo"}).join(right.filter("id < 40").select(F.col("id").alias("r"), "lat", "lon"))
    want = {x.id: x.b[1] for x in brute.groupBy("id").agg(F.min(F.struct(F.pow(F.col("la") - F.col("lat"), 2) + F.pow(F.col("lo") - F.col("lon"), 2), "r")).alias("b")).collect() if x.id < 3}
    assert {x.id: x.nearest for x in nw.nearest_point(left, right, 5.0).collect()} == want
    assert {x.id for x in nw.nearest_in_metres(left, right, 5000.0).collect()} == {1, 2}
    assert [x.count() for x in sizes["right"]] == [40, 40]
