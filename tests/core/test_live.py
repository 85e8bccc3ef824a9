"""Streams give the rows of the batch transforms, however records are dealt to batches and whatever batch is run again."""

import datetime
import random
from pathlib import Path

import pytest

from railspan.operators import connections as co
from railspan.operators import punctuality as pu
from railspan.plans import registry, streams  # noqa: F401
from railspan.streaming import live

REC = "day_date date, dow int, station string, train_no string, relation string, arr_sec long, dep_sec long, delay_arr long, delay_dep long"
DAY = datetime.date(2025, 1, 1)


def records(r, n):
    out = []
    for _ in range(n):
        day, at = r.randrange(2), 28800 + 60 * r.randrange(300)
        out.append((DAY + datetime.timedelta(day), day, r.choice("xyz"), str(r.randrange(25)), "L", at if r.random() > 0.1 else -1, at, r.choice((0, 60, 400, 900, -30, None)), r.choice((0, 0, 60, 200))))
    return out


def key(df, cols):
    return sorted(map(repr, df.select(*cols).collect()))


def feed(spark, rows, at, n):
    spark.createDataFrame(rows, REC).coalesce(1).write.mode("append").parquet(f"{at}/part={n}")


def ends(start, spark, checkpoint, again):
    """Runs a stream to its end; again: forgets that its last batch was done, so that a new start runs it once more."""
    with live.rocksdb(spark):
        start().trigger(availableNow=True).start().awaitTermination(120)
        if again:
            last = max(Path(checkpoint, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
            last.unlink()
            Path(last.parent, f".{last.name}.crc").unlink(missing_ok=True)
            start().trigger(availableNow=True).start().awaitTermination(120)


@pytest.mark.parametrize("split", [1, 3])
def test_connections_and_next_departures(spark, tmp_path, split):
    rows = records(random.Random(split), 260)
    batch = spark.createDataFrame(rows, REC)
    want = co.connections(batch)
    src, out = str(tmp_path / "in"), str(tmp_path / "conn")
    close = [(DAY + datetime.timedelta(30), 0, "end", t, "L", 0, 300 * int(t), 0, 0) for t in ("1", "2")]
    stream = lambda: spark.readStream.schema(REC + ", part int").option("maxFilesPerTrigger", 1).parquet(src).drop("part")
    for n in range(split):
        feed(spark, rows[n::split], src, n)
        start = lambda: live.append_once(live.stream_connections(stream(), stream(), late="3 days"), out, str(tmp_path / "c1"), "day_date")
        ends(start, spark, tmp_path / "c1", n == split - 1)
    got = spark.read.schema(want.schema).parquet(out)
    assert key(got, want.columns) == key(want, want.columns) and want.count() > 100

    (tmp_path / "rest").mkdir()
    conn = spark.readStream.schema(want.schema).option("maxFilesPerTrigger", 2).parquet(out)
    conn = conn.unionByName(spark.readStream.schema(want.schema).parquet(str(tmp_path / "rest")))
    start = lambda: live.append_once(live.stream_next_departures(conn, stream(), late="3 days"), str(tmp_path / "next"), str(tmp_path / "c2"))
    ends(start, spark, tmp_path / "c2", True)
    feed(spark, close, src, 99)  # a later day: a missed connection and departures, past which the watermarks move
    more = co.connections(spark.createDataFrame([(*close[0][:7], 700, 0), *close[1:]], REC))
    more.select(want.columns).write.mode("append").parquet(str(tmp_path / "rest"))
    ends(start, spark, tmp_path / "c2", True)
    waits = co.next_departures(want, batch)
    assert key(spark.read.parquet(str(tmp_path / "next")), waits.columns) == key(waits, waits.columns) and waits.count() > 20


@pytest.mark.parametrize("split", [1, 3])
def test_counts_and_missed_arrivals_without_connections(spark, tmp_path, split):
    rows = records(random.Random(split), 260)
    conn, src = co.connections(spark.createDataFrame(rows, REC)), str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(REC + ", part int").option("maxFilesPerTrigger", 1).parquet(src).drop("part")
    for n in range(split):
        feed(spark, rows[n::split], src, n)
        again = n == split - 1
        ends(lambda: live.overwrite_batches(live.stream_counts(stream(), stream(), late="3 days"), str(tmp_path / "counts"), str(tmp_path / "c1")), spark, tmp_path / "c1", again)
        ends(lambda: live.append_once(live.stream_missed_arrivals(stream(), stream(), late="3 days"), str(tmp_path / "missed"), str(tmp_path / "c2")), spark, tmp_path / "c2", again)
    got, want = co.rollup(live.latest_rows(spark.read.parquet(str(tmp_path / "counts")), "day_date", "station", "slot"), "station"), co.rollup(conn, "station")
    assert key(got, want.columns) == key(want, want.columns) != []
    cols = ["day_date", "station", "arr_train", "arr_actual"]
    missed = spark.read.parquet(str(tmp_path / "missed"))
    assert key(missed.select(cols).distinct(), cols) == key(conn.filter("missed = 1").select(cols).distinct(), cols) != []


@pytest.mark.parametrize("name", ["stream_missed_by_station", "stream_next_departure_wait"])
def test_no_stream_query_joins_records(spark, data, name, monkeypatch):
    monkeypatch.setattr(live, "stream_connections", None)
    assert registry.QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("split", [1, 4])
def test_running_offenders(spark, tmp_path, split):
    rows = records(random.Random(split), 300)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(split):
        feed(spark, rows[n::split], src, n)
        stream = spark.readStream.schema(REC + ", part int").parquet(src).drop("part")
        start = lambda s=stream: live.overwrite_batches(live.stream_offenders(s), out, str(tmp_path / "c"))
        ends(start, spark, tmp_path / "c", True)
    got, want = live.latest_rows(spark.read.parquet(out), "train_no", "station"), pu.offenders(spark.createDataFrame(rows, REC), least_days=1)
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(want.columns).collect())
    assert rounded(got) == rounded(want) and want.count() > 30


def test_an_offender_asks_its_state_once_a_batch():
    """Calls of the state are messages: their number must not grow with the days of a key."""
    calls = []

    class State:
        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("exists", "containsKey"):
                    return False
                return [] if name in ("values", "get") else None
            return call

    class Handle:
        getValueState = getMapState = getListState = lambda self, *args: State()

    class Rec:
        def __init__(self, day):
            self.day_date, self.delay_arr = DAY + datetime.timedelta(day), 400

    of = live.Offender(300, 1800)
    of.init(Handle())
    row, = of.handleInputRows(("1", "x"), [Rec(k) for k in range(50)], None)
    assert row.days_seen == 50 and row.worst == 400 / 60 and len(calls) <= 3
