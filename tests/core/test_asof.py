import datetime
import random

import pytest

from railspan.operators import connections as co
from railspan.operators import filters as fi
from railspan.operators.asof import asof


@pytest.mark.parametrize("forward", [False, True])
def test_asof_equals_all_pairs(spark, forward):
    """A key with most rows, ties, missing keys and times, keys of one side only."""
    r = random.Random(7)
    keys = ["hot"] * 6 + ["b", "c", None]
    left = [(i, r.choice([*keys, "only"]), r.choice((None, *range(60)))) for i in range(500)]
    right = [(r.choice(keys), r.choice((None, *range(0, 60, 3))), r.randrange(9)) for _ in range(300)]
    got = asof(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int").repartition(7), ["k"], "t", forward)
    want = {}
    for i, k, t in left:
        fits = [x for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and (x[1] > t if forward else x[1] <= t)]
        want[i] = (min if forward else max)(fits, key=lambda x: (x[1], x[2]), default=None)
    assert {x.id: x.match and tuple(x.match) for x in got.collect()} == want


def test_asof_of_nothing_and_without_a_key(spark):
    left, right = spark.createDataFrame([(1, 5), (2, 1)], "id int, t int"), spark.createDataFrame([(2, "a"), (4, "b")], "t int, v string")
    assert {x.id: x.match and x.match.v for x in asof(left, right, [], "t").collect()} == {1: "b", 2: None}
    assert [x.match for x in asof(left, right.limit(0), [], "t").collect()] == [None, None]
    assert asof(left.limit(0), right, [], "t").count() == 0


def test_the_next_departure_of_another_train(spark):
    """The own train leaves first, twice, once at the same second as another."""
    rec = spark.createDataFrame([("s", t, sec, 0) for t, sec in (("1", 100), ("1", 200), ("1", 300), ("2", 300), ("3", 9000))] + [("s", "4", None, 0), ("s", "5", 150, None)], "station string, train_no string, dep_sec long, delay_dep long").selectExpr("date'2025-01-01' as day_date", "*")
    conn = spark.createDataFrame([("1", 50), ("2", 50), ("2", 300), ("3", 8000), ("1", 300)], "arr_train string, arr_actual long").selectExpr("date'2025-01-01' as day_date", "'s' as station", "*", "1 as missed")
    got = {(x.arr_train, x.arr_actual): x.wait for x in co.next_departures(conn, rec).collect()}
    assert got == {("1", 50): 250, ("2", 50): 50}


def test_holidays_that_overlap(spark):
    d = lambda n: datetime.date(2025, 1, n)
    rows = [(d(2), d(10), "b"), (d(1), d(3), "a"), (d(5), d(6), "c"), (d(9), d(12), "e"), (d(9), d(12), "d"), (d(20), d(19), "none")]
    days = spark.createDataFrame([(d(n),) for n in range(1, 25)], "day date")
    want = {d(n): min(((a, name) for a, z, name in rows if a <= d(n) <= z), default=(None, None))[1] for n in range(1, 25)}
    assert {x.day: x.name for x in fi.holiday_name(days, spark.createDataFrame(rows, "start date, end date, name string")).collect()} == want
