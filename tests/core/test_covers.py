import random

import pytest
from pyspark.sql import functions as F

from railspan.operators import covers as cv
from railspan.operators import network as nw

AREAS = "name string, rings array<array<array<double>>>"


def holds(lat, lon, rings):
    odd = False
    for ring in rings or []:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            odd ^= (ay > lat) != (by > lat) and lon < (bx - ax) * (lat - ay) / (by - ay) + ax
    return odd


def blob(r, lon, lat, size):
    return [[lon + r.uniform(-size, size), lat + r.uniform(-size, size)] for _ in range(r.randrange(3, 9))]


@pytest.mark.parametrize("seed", range(3))
def test_cover_equals_the_test_of_every_point(spark, seed):
    """Borders that cross themselves, holes, areas of many coarse cells and of less than one, points on corners and cell borders."""
    r = random.Random(seed)
    rows = [(f"a{i}", [blob(r, r.uniform(2, 7), r.uniform(49, 52), r.choice((0.05, 0.5, 8.0))) for _ in range(r.choice((1, 1, 2)))]) for i in range(7)]
    rows += [("hole", [[[2.0, 49.0], [6.0, 49.0], [6.0, 52.0], [2.0, 52.0]], [[3.0, 50.0], [4.0, 50.0], [4.0, 51.0], [3.0, 51.0]]]), ("none", []), ("null", None)]
    points = [(i, r.uniform(45, 56), r.uniform(-2, 11)) for i in range(400)] + [(500 + i, 49.0 + i * 0.5, 2.0 + i % 3) for i in range(9)] + [(600, 50.625, 2.8125), (601, None, 4.0), (602, 50.0, 4.0 + 1e-12)]
    areas, df = spark.createDataFrame(rows, AREAS), spark.createDataFrame(points, "id int, lat double, lon double")
    cover = cv.cell_cover(areas, 6, 10)
    got = sorted(map(tuple, cv.covered(df, cover, areas, 6, 10).collect()))
    assert got == sorted((i, name) for i, lat, lon in points if lat is not None for name, rings in rows if holds(lat, lon, rings))
    assert cover.filter("not edge").count() > 0


def test_touching_areas_become_one_ring(spark):
    square = lambda x, y: [[[float(p), float(q)] for p, q in ((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))]]
    around = [(f"t{x}{y}", square(x, y)) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    back = [("back", [square(5, 5)[0][::-1]]), ("next", square(6, 5)), ("far", square(9, 9))]
    areas = spark.createDataFrame([*around, *back], AREAS)
    groups = areas.select("name", F.when(F.col("name").startswith("t"), "frame").otherwise("pair").alias("group"))
    got = {x.name: x.rings for x in cv.dissolve(areas, groups).collect()}
    assert sorted(map(len, got["frame"])) == [4, 12] and sorted(map(len, got["pair"])) == [4, 6]
    r = random.Random(1)
    points = spark.createDataFrame([(i, r.uniform(-1, 11), r.uniform(-1, 11)) for i in range(600)], "id int, lat double, lon double")
    union = nw.areas_of(points, spark.createDataFrame(list(got.items()), AREAS))
    parts = nw.areas_of(points, areas).join(groups, F.col("area") == F.col("name")).select("id", F.col("group").alias("area")).distinct()
    assert sorted(map(tuple, union.collect())) == sorted(map(tuple, parts.collect()))
