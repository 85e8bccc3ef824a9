"""Counts of connections without their rows: those of the pairs, whatever the records are."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from railspan.operators import connections as co
from railspan.operators import tallies
from railspan.plans import registry, reports  # noqa: F401

RECORD = "day_date string, dow int, station string, train_no string, relation string, arr_sec long, dep_sec long, delay_arr long, delay_dep long"


@pytest.fixture(scope="module")
def records(spark):
    """Odd ones: clocks to the second, early and unknown ones, trains that meet themselves, several days and stations, missing names."""
    dice = random.Random(5)
    some = lambda x, p=0.06: None if dice.random() < p else x
    rows = []
    for _ in range(900):
        at = dice.choice((-50, 0, 895, 900, 3595, 7200)) + dice.randrange(400)
        rows.append((some(dice.choice(("d1", "d2")), 0.02), dice.choice((0, 0, 1)), some(dice.choice("AB"), 0.02), some(str(dice.randrange(12)), 0.02), some(dice.choice("LM")), some(at), some(at + dice.randrange(400)),
                     some(dice.randrange(-200, 700)), some(dice.randrange(-60, 500))))
    return spark.createDataFrame(rows, RECORD).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("by", [(), ("station", "dep_hour"), ("arr_train", "rel_arr", "day_date", "dow", "delay_arr")])
def test_counts_of_arrivals_are_those_of_the_pairs(records, by):
    assert rows(co.rollup(co.counted(records, records), *by)) == rows(co.rollup(co.connections(records), *by))


def test_counts_of_departures_and_holds(records):
    pairs = co.connections(records)
    slack = F.col("dep_actual") - F.col("arr_actual")
    of = ["day_date", "station", "dep_train", "dep_hour"]
    want = pairs.groupBy(*of).agg(F.count("*"), F.sum("missed"), F.count_if((slack < 0) & (slack >= -120)), F.count_if((slack > 0) & (slack <= 120)))
    sums = [F.sum(c) for c in ("planned", "missed", "saved_120", "new_120")]
    assert rows(co.counted(records, records, of="dep", holds=(120,)).groupBy(*of).agg(*sums)) == rows(want)


def test_downstream_of_pairs_and_of_counts(records):
    records = records.withColumn("dow", F.when(F.col("day_date") == "d1", 1).otherwise(2))
    assert rows(co.hold_effects(records)) == rows(co.hold_downstream(co.connections(records), records)) != []


def test_a_crowd_of_one_minute(spark):
    """Nine hundred million pairs."""
    n = 30_000
    crowd = spark.range(n).select(F.lit("d").alias("day_date"), F.lit(1).alias("dow"), F.lit("S").alias("station"), F.col("id").cast("string").alias("train_no"), F.lit("L").alias("relation"),
                                  F.lit(600).cast("long").alias("arr_sec"), F.lit(900).cast("long").alias("dep_sec"), (F.col("id") % 600).alias("delay_arr"), F.lit(0).cast("long").alias("delay_dep"))
    assert rows(co.rollup(co.counted(crowd, crowd))) == [(n * (n - 1), n // 600 * 299 * (n - 1), n // 600 * 120 * (n - 1))]


@pytest.mark.parametrize("name", ["connections_grouping_sets", "domino_trains", "top_trains_by_hour", "hold_downstream", "key_route", "corridor", "missed_by_station", "heatmap_pivot"])
def test_no_query_of_counts_makes_pairs(spark, data, name):
    plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "slot#" in x]


def test_groups_stay_whole_in_chunks(monkeypatch):
    monkeypatch.setattr(tallies, "CHUNK", 4)
    keys = [1] * 3 + [2] * 11 + [3] + [4] * 2
    batches = [pa.RecordBatch.from_pydict({"k": keys[i:i + 2]}) for i in range(0, len(keys), 2)]
    got = [t["k"].to_pylist() for t in tallies._whole_groups(iter(batches), ["k"])]
    assert sum(got, []) == keys and len(got) > 1
    assert all(not set(a) & set(b) for i, a in enumerate(got) for b in got[i + 1:])


def test_steps_give_one_result(monkeypatch):
    dice = random.Random(2)
    n = 300
    table = pa.table({"k": sorted(dice.choices("ab", k=n)), "train": dice.choices("xyz", k=n), "sec": [dice.randrange(60) for _ in range(n)], "actual": [dice.randrange(90) for _ in range(n)], "_side": dice.choices((0, 1), k=n)})
    run = lambda: [r for b in tallies._merged(table, ["k"], ["k", "train", "sec", "actual"], 5, 30, [0, 7], True) for r in b.to_pylist()]
    whole = run()
    monkeypatch.setattr(tallies, "STEP", 20)
    assert run() == whole != []
