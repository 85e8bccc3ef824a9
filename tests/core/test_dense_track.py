"""Distances of nearly all pairs on dense track are not found by hub labels, which are no smaller there."""

import random

import pytest

from railspan.operators import labels
from railspan.operators import search as se
from railspan.plans import details, registry  # noqa: F401


def test_track_distance_builds_no_labels(spark, data, monkeypatch):
    monkeypatch.setattr(labels, "hub_labels", None)
    assert registry.QUERIES["track_distance"](spark, data).count() > 0


@pytest.mark.parametrize(("held", "rounds"), [(4_000_000, {1}), (7, set(range(2, 30)))])
def test_track_that_a_block_holds_takes_one_round(spark, monkeypatch, held, rounds):
    """A line with shortcuts, against plain relaxation; more track than a block holds streams by in rounds and gives the same."""
    r = random.Random(5)
    rails = [(f"{i}", f"{i + 1}", 1.0 + i % 3) for i in range(24)] + [(f"{a}", f"{b}", 0.5 + 2.0 * abs(a - b)) for a, b in (r.sample(range(25), 2) for _ in range(30))]
    want = {str(o): {str(o): 0.0} for o in range(25)}
    for far in want.values():
        for _ in range(25):
            for x, y, km in [*rails, *((y, x, km) for x, y, km in rails)]:
                if x in far:
                    far[y] = min(far.get(y, float("inf")), far[x] + km)
    monkeypatch.setattr(se, "HELD", held)
    seen, written = [], se.written
    monkeypatch.setattr(se, "written", lambda df, name: seen.append(name) or written(df, name))
    monkeypatch.setattr(se, "_relax", se._relax if held > 7 else _holding(held))
    got = se.rail_distances(spark.createDataFrame([(str(o),) for o in range(25)], "id string"), spark.createDataFrame(rails, "a string, b string, km double"))
    assert {(x.origin, x.station): x.km for x in got.collect()} == {(o, s): pytest.approx(km) for o, far in want.items() for s, km in far.items() if s != o}
    assert seen.count("distances") in rounds


def _holding(held):
    """The step with another bound, in the workers too."""

    def run(batches):
        se.HELD = held
        try:
            yield from relax(batches)
        finally:
            se.HELD = 4_000_000

    relax = se._relax
    return run
