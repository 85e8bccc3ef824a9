"""Connections, next departures and repeat offenders over a stream of records.

The results are those of the batch transforms over all records, however the records are dealt to micro-batches, as long as none
comes later than `late` behind the greatest event time seen. Tables written by `append_once` and `overwrite_batches` hold each row once, also
if Spark runs a batch again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from railspan.operators.connections import LONGEST_WAIT, judged, sides
from railspan.operators.tallies import _merged

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAIT = "day_date date, station string, arr_train string, arr_actual long, wait long"
COUNTS = "day_date date, station string, slot long, planned long, missed long, close_call long"
MISSED = "day_date date, station string, arr_train string, arr_actual long, missed int"
OFFENDER = "train_no string, station string, days_seen long, pct_late double, avg_delay double, max_delay double, worst double, total_stops long"


def moment(day: Column | str, seconds: Column | str) -> Column:
    """Event time: seconds after the service day's midnight."""
    return F.timestamp_add("SECOND", F.col(seconds) if isinstance(seconds, str) else seconds, F.to_timestamp(day))


def stream_connections(arrivals: DataFrame, departures: DataFrame, min_gap: int = 120, max_gap: int = 900, close_call: int = 120, late: str = "2 hours") -> DataFrame:
    """Rows of `connections` from two streams of records, which may be the same: an interval join whose state ends with the watermarks.

    A departure waits for arrivals until the arrivals' watermark is past it, an arrival until the departures' is max_gap past it.
    """
    arr, dep = sides(arrivals, departures, max_gap)
    arr = arr.withColumn("arr_ts", moment("day_date", "arr_sec")).withWatermark("arr_ts", late)
    dep = dep.select("dep_train", "rel_dep", "dep_sec", "delay_dep", moment("day_date", "dep_sec").alias("dep_ts"), *[F.col(c).alias(f"_{c}") for c in ("day_date", "station", "slot")]).withWatermark("dep_ts", late)
    same = (F.col("day_date") == F.col("_day_date")) & (F.col("station") == F.col("_station")) & (F.col("slot") == F.col("_slot"))
    span = F.expr(f"dep_ts >= arr_ts + interval {min_gap} seconds and dep_ts <= arr_ts + interval {max_gap} seconds")
    return judged(arr.join(dep, same & span), min_gap, max_gap, close_call).drop("arr_ts", "dep_ts", "_day_date", "_station", "_slot")


class SlotRecords(StatefulProcessor):
    """The arrivals and departures of a station's slot of time, as one value; each batch that touches it counts its connections anew, without a row for one.

    arrivals: gives the arrivals that missed a connection, each once a slot; else the slot's running counts.
    """

    def __init__(self, min_gap: int, max_gap: int, close_call: int, arrivals: bool):
        self.gaps, self.close_call, self.arrivals = (min_gap, max_gap), close_call, arrivals

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, ends = [], 0
        for x in rows:
            ends = int(x["ends"].iloc[0]) if len(x) else ends
            actual = pa.array(x["actual"].to_numpy(), pa.int64(), mask=~x["known"].to_numpy(bool))
            new.append(pa.table({"train": pa.array(x["train"], pa.string()), "sec": pa.array(x["sec"].to_numpy(), pa.int64()), "actual": actual, "_side": pa.array(x["side"].to_numpy(), pa.int32()), "told": np.zeros(len(x), bool)}))
        if self.rows.exists():
            new.append(pa.ipc.open_stream(self.rows.get()[0]).read_all())
        else:
            self.handle.registerTimer(ends)
        table = pa.concat_tables(new).combine_chunks()
        marked = table.append_column("i", pa.array(np.arange(table.num_rows))).append_column("k", pa.repeat(0, table.num_rows))
        found = list(_merged(marked, ["k"], ["i", "train", "actual", "told"], *self.gaps, [0, self.close_call], False))
        met = pa.Table.from_batches(found) if found else None
        yield from (self._missed if self.arrivals else self._counts)(key, table, met)

    def _keep(self, table: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.rows.update((sink.getvalue().to_pybytes(),))

    def _counts(self, key, table: pa.Table, met: pa.Table | None) -> Iterator[pd.DataFrame]:
        self._keep(table)
        if met is not None:
            some = met["judged"].to_numpy() > 0
            below = met["below"].combine_chunks().flatten().to_numpy().reshape(-1, 2)[some].sum(axis=0)
            sums = [int(met["planned"].to_numpy().sum()), *([int(below[0]), int(below[1] - below[0])] if some.any() else [None, None])]
            yield pd.DataFrame({"day_date": [key[0]], "station": [key[1]], "slot": [key[2]], **{n: pd.array([v], "Int64") for n, v in zip(("planned", "missed", "close_call"), sums, strict=True)}})

    def _missed(self, key, table: pa.Table, met: pa.Table | None) -> Iterator[pd.DataFrame]:
        if met is not None:
            below = met["below"].combine_chunks().flatten().to_numpy().reshape(-1, 2)[:, 0]
            late = met.filter(pa.array((below > 0) & (met["judged"].to_numpy() > 0) & ~met["told"].to_numpy()))
            told = table["told"].to_numpy().copy()
            told[late["i"].to_numpy()] = True
            table = table.set_column(table.column_names.index("told"), "told", pa.array(told))
            if late.num_rows:
                yield pd.DataFrame({"day_date": key[0], "station": key[1], "arr_train": late["train"].to_pandas(), "arr_actual": late["actual"].to_numpy(), "missed": np.int32(1)})
        self._keep(table)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass


def _by_slot(arrivals: DataFrame, departures: DataFrame, gaps: tuple[int, int], close_call: int, late: str, missed: bool) -> DataFrame:
    arr, dep = sides(arrivals, departures, gaps[1])
    ends = F.unix_millis(moment("day_date", (F.col("slot") + 1) * gaps[1])).alias("ends")

    def rows(x: DataFrame, of: str, side: int) -> DataFrame:
        actual = F.col(f"{of}_sec") + F.col(f"delay_{of}")
        return x.dropna(subset=["day_date", "station", f"{of}_train"]).select(
            "day_date", "station", F.col("slot").cast("long").alias("slot"), F.col(f"{of}_train").alias("train"), F.col(f"{of}_sec").cast("long").alias("sec"), F.coalesce(actual, F.lit(0)).cast("long").alias("actual"),
            actual.isNotNull().alias("known"), F.lit(side).alias("side"), ends, moment("day_date", f"{of}_sec").alias("at")).withWatermark("at", late)

    both = rows(arr, "arr", 0).union(rows(dep, "dep", 1)).groupBy("day_date", "station", "slot")
    return both.transformWithStateInPandas(SlotRecords(*gaps, close_call, missed), MISSED if missed else COUNTS, "Append" if missed else "Update", "EventTime")


def stream_counts(arrivals: DataFrame, departures: DataFrame, min_gap: int = 120, max_gap: int = 900, close_call: int = 120, late: str = "2 hours") -> DataFrame:
    """Running counts of `connections` (day_date, station, slot, planned, missed, close_call) of two streams of records, which may be the same: a row for each slot that a batch touches.

    State is the records of a slot, until the watermark is past it; no connection becomes a row.
    """
    return _by_slot(arrivals, departures, (min_gap, max_gap), close_call, late, False)


def stream_missed_arrivals(arrivals: DataFrame, departures: DataFrame, min_gap: int = 120, max_gap: int = 900, late: str = "2 hours") -> DataFrame:
    """(day_date, station, arr_train, arr_actual, missed = 1) of arrivals that missed a connection, when they first do; once for each of an arrival's two slots."""
    return _by_slot(arrivals, departures, (min_gap, max_gap), 120, late, True)


class NextDeparture(StatefulProcessor):
    """For the arrivals and departures of a station's slot of time: kept until no departure can come any more, then merged once."""

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrivals = handle.getListState("arrivals", "arr_train string, arr_actual long")
        self.departures = handle.getListState("departures", "train string, leaves long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came, left, ends = [], [], None
        for r in rows:
            (left if r.departs else came).append((r.train, r.second))
            ends = r.ends
        if came:
            self.arrivals.appendList(came)
        if left:
            self.departures.appendList(left)
        if ends is not None and ends not in set(self.handle.listTimers()):
            self.handle.registerTimer(ends)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        came = sorted({(r[1], r[0]) for r in self.arrivals.get()}) if self.arrivals.exists() else []
        left = sorted({(r[1], r[0]) for r in self.departures.get()}) if self.departures.exists() else []
        at = 0
        for actual, train in came:
            while at < len(left) and left[at][0] <= actual:
                at += 1
            for i in range(at, len(left)):  # the first of another train: the next one, as a rule
                leaves, other = left[i]
                if leaves > actual + self.horizon:
                    break
                if other != train:
                    yield Row(day_date=key[0], station=key[1], arr_train=train, arr_actual=actual, wait=leaves - actual)
                    break
        self.arrivals.clear()
        self.departures.clear()

    def close(self) -> None:
        pass


def stream_next_departures(conn: DataFrame, departures: DataFrame, horizon: int = LONGEST_WAIT, late: str = "2 hours") -> DataFrame:
    """Rows of `next_departures` from a stream of connections and one of records: (day_date, station, arr_train, arr_actual, wait).

    State is kept by day, station and slot of `horizon` seconds; a departure goes to its slot and the one before. A slot is
    answered, once, when the watermark is past the last departure that its arrivals could take.
    """
    def event(day, station, train, second, departs, slot):
        ends = F.unix_millis(moment(day, (slot + 2) * horizon))
        return [F.col(day), F.col(station), slot.cast("long").alias("slot"), F.col(train).alias("train"), second.cast("long").alias("second"), F.lit(departs).alias("departs"), ends.alias("ends"), moment(day, second).alias("at")]

    came = conn.filter("missed = 1").select(*event("day_date", "station", "arr_train", F.col("arr_actual"), False, F.floor(F.col("arr_actual") / horizon))).withWatermark("at", late)
    leaves = F.col("dep_sec") + F.col("delay_dep")
    left = departures.filter("dep_sec >= 0 and delay_dep is not null").withColumn("_slot", F.explode(F.array(F.floor(leaves / horizon) - 1, F.floor(leaves / horizon))))
    left = left.select(*event("day_date", "station", "train_no", leaves, True, F.col("_slot"))).withWatermark("at", late)
    return came.union(left).groupBy("day_date", "station", "slot").transformWithState(NextDeparture(horizon), WAIT, "Append", "EventTime")


class Offender(StatefulProcessor):
    """A train's delays at a station by day; each batch that touches it gives its row anew. Its days are one value, read and written once a batch, as each call of the state is a message."""

    def __init__(self, late: int, cap: int):
        self.late, self.cap = late, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getValueState("days", "days array<struct<day date, sum long, worst long, n long, n_late long>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict = {}
        for r in rows:
            d = min(max(r.delay_arr, 0), self.cap)
            s, worst, n, n_late = new.get(r.day_date, (0, 0, 0, 0))
            new[r.day_date] = (s + d, max(worst, d), n + 1, n_late + (d > self.late))
        for day, *old in self.days.get()[0] if self.days.exists() else ():
            s, worst, n, n_late = new.get(day, (0, 0, 0, 0))
            new[day] = (s + old[0], max(worst, old[1]), n + old[2], n_late + old[3])
        self.days.update(([(day, *v) for day, v in new.items()],))
        every = sorted(new.values())
        k = len(every)
        yield Row(train_no=key[0], station=key[1], days_seen=k, pct_late=sum(v[3] * 100.0 / v[2] for v in every) / k, avg_delay=sum(v[0] / 60 / v[2] for v in every) / k,
                  max_delay=sum(v[1] / 60 for v in every) / k, worst=max(v[1] for v in every) / 60, total_stops=sum(v[2] for v in every))

    def close(self) -> None:
        pass


def stream_offenders(rec: DataFrame, late: float = 5.0, cap: float = 30.0) -> DataFrame:
    """Running rows of `offenders`, for all trains and stations whose days a batch changes; state grows with trains x stations x days, not with records."""
    keyed = rec.filter("delay_arr is not null").select("train_no", "station", "day_date", F.col("delay_arr").cast("long").alias("delay_arr"))
    return keyed.groupBy("train_no", "station").transformWithState(Offender(round(late * 60), round(cap * 60)), OFFENDER, "Update", "None")


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which stateful processors need; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def append_once(stream: DataFrame, path: str, checkpoint: str, *by: str):
    """A writer of final rows as files that are listed by batch: a batch run again replaces its list. Read it by spark.read.parquet(path)."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return w.partitionBy(*by) if by else w


def overwrite_batches(stream: DataFrame, path: str, checkpoint: str):
    """A writer of running rows: each batch has a folder, which it overwrites if it is run again."""
    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)


def latest_rows(df: DataFrame, *keys: str) -> DataFrame:
    """The row of the last batch for each key of a table by overwrite_batches."""
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
