import random

import pytest

from railspan.operators import labels as la

INF = float("inf")


def all_pairs(nodes, rails):
    far = {(a, b): 0.0 if a == b else INF for a in nodes for b in nodes}
    for a, b, km in rails:
        if a and b and a != b and km is not None:
            far[a, b] = far[b, a] = min(far[a, b], km)
    for k in nodes:
        for a in nodes:
            for b in nodes:
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    return {k: v for k, v in far.items() if k[0] != k[1] and v < INF}


@pytest.mark.parametrize("seed", range(4))
def test_distances_equal_all_pairs(spark, seed):
    """Ties, edges of no length, doubled and missing edges, parts that are not linked; at last a line, which has the most hops."""
    r = random.Random(seed)
    nodes = [f"n{i}" for i in range(36)]
    rails = [(r.choice(nodes), r.choice(nodes), r.choice((0.0, 1.0, 2.5, 4.0, 9.0))) for _ in range(40 + 25 * seed)]
    if seed == 3:
        rails = [(a, b, r.choice((1.0, 2.0))) for a, b in zip(nodes, nodes[1:], strict=False)]
    odd = [("n1", "n1", 1.0), (None, "n2", 1.0), ("n1", "n3", None)]
    labels = la.hub_labels(spark.createDataFrame([*rails, *odd], "a string, b string, km double"))
    asked = spark.createDataFrame([(a, b) for a in nodes for b in nodes] + [("n1", None), ("n1", "nowhere")], "origin string, station string")
    got = {(x.origin, x.station): x.km for x in la.distances(asked, labels).collect()}
    assert got == all_pairs(nodes, rails)
    assert labels.count() < len(nodes) * (len(nodes) - 1) / 2


def test_no_track(spark):
    rails = spark.createDataFrame([], "a string, b string, km double")
    pairs = spark.createDataFrame([("a", "b")], "origin string, station string")
    assert la.distances(pairs, la.hub_labels(rails)).count() == 0
