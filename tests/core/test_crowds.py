"""Steps of crowds: what is alike is done once, and no task has it all to itself."""

import numpy as np
from pyspark.sql import functions as F

from railspan.operators import geometry as ge
from railspan.operators import network as nw
from railspan.plans import details


def test_equal_lines_are_measured_once_and_dealt(spark):
    line = lambda k: [(50.0 + 0.001 * k, 4.0), (50.02 + 0.001 * k, 4.02)]
    shapes = {i: line((i % 4) * 3) for i in range(40)} | {99: [(50.0, 4.0)], 100: [(50.0, 4.0), (50.0, 4.0)]}
    rows = [(i, [{"lat": x, "lon": y} for x, y in c]) for i, c in shapes.items()]
    found = ge.overlapping(spark.createDataFrame(rows, "id long, coords array<struct<lat:double,lon:double>>"))
    lines = {i: np.array(c) for i, c in shapes.items() if len(c) > 1}
    want = {(a, b, min(ge.overlap(lines[a], lines[b])[0], ge.overlap(lines[b], lines[a])[0])) for a in lines for b in lines if a < b}
    assert set(map(tuple, found.collect())) == {x for x in want if x[2] >= 0.7} != set()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition " in plan and "ids" in plan


def test_longest_segment_moves_its_coords_once(spark, data):
    plan = details.segment_index(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "max_by" not in plan and "partial_max(" in plan


def test_longest_segment_of_a_pair(spark):
    at = lambda *x: [{"lat": float(i), "lon": 0.0} for i in x]
    seg = spark.createDataFrame([(1, 7, at(1, 2)), (7, 2, at(1, 2, 3)), (2, 7, at(1, 2, 4)), (1, 2, at(5, 6))], "from_id long, to_id long, coords array<struct<lat:double,lon:double>>")
    got = nw.segment_index(seg, spark.createDataFrame([(1, 1), (2, 1)], "id long, cluster long")).select("a", "b", F.transform("coords", lambda c: c["lat"]).alias("c"))
    assert sorted(map(tuple, got.collect())) == [(1, 2, [5.0, 6.0]), (1, 7, [1.0, 2.0, 4.0])]
