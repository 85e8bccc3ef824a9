"""Counts of pairs within a span of time by merges of sorted numbers: no pair becomes a row.

A row meets the seconds at which others are, not the others: each second's others are counted by their sorted actual times. So the work grows with rows
times the distinct seconds of a span, however many rows share a second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are merged together, and row-seconds of one step.
CHUNK, STEP = 100_000, 1_000_000


def tallies(each: DataFrame, other: DataFrame, by: list[str], min_gap: int, max_gap: int, offsets: list[int], hourly: bool = True) -> DataFrame:
    """For each row of each the rows of other with the same `by`, another train and sec min_gap to max_gap later: rows of each with
    hour (of other's sec; null unless hourly, else a row for each), planned (how many), judged (with both actuals known) and below (an array: for each
    offset how many of the judged have actual < own actual + offset). Rows that meet none are left out.

    Both have `by`, train, sec, actual (long); rows that lack one of by, train and sec meet none. A task holds the rows of one `by`.
    """
    need = [*by, "train", "sec"]
    cols = list(dict.fromkeys([*need, "actual", *each.columns]))
    both = each.select(cols).withColumn("_side", F.lit(0)).unionByName(other.select(*need, "actual").withColumn("_side", F.lit(1)), allowMissingColumns=True).dropna(subset=need)
    dealt = both.repartition(*by).sortWithinPartitions(*by)
    more = "hour long, planned long, judged long, below array<long>"
    out = each.select(cols).limit(0).select("*", *[F.lit(None).cast(t).alias(n) for n, t in (x.split(" ") for x in more.split(", "))]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, by):
            yield from _merged(table, by, cols, min_gap, max_gap, offsets, hourly)

    return dealt.mapInArrow(run, out)


def _starts(table: pa.Table, by: list[str]) -> np.ndarray:
    """Whether a row begins a new `by`."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in by:
        col = table[c].combine_chunks()
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
    return new


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of CHUNK rows or so that end where a `by` ends."""
    held, rows, most = [], 0, CHUNK
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        end = int(np.flatnonzero(_starts(table, by))[-1])
        if end:
            yield table.slice(0, end)
        held = table.slice(end).to_batches()
        rows = table.num_rows - end
        most = max(CHUNK, 2 * rows)  # a group of many chunks is looked at seldom
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _merged(table: pa.Table, by: list[str], cols: list[str], min_gap: int, max_gap: int, offsets: list[int], hourly: bool) -> Iterator[pa.RecordBatch]:
    group = np.cumsum(_starts(table, by)) - 1
    side, sec = table["_side"].to_numpy(), table["sec"].to_numpy()
    train = table["train"].combine_chunks().dictionary_encode().indices.to_numpy()
    known, actual = table["actual"].is_valid().to_numpy(), table["actual"].fill_null(0).to_numpy()
    mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(mine) or not len(theirs):
        return
    first, trains = sec.min(), int(train.max()) + 1
    span = int(sec.max() - first) + max_gap + 1
    low = actual[known].min() if known.any() else 0
    wide = int(actual[known].max() - low if known.any() else 0) + 2
    cells, cell = np.unique(group[theirs] * span + (sec[theirs] - first), return_inverse=True)  # a cell: a second of a group
    hours = (cells % span + first) // 3600
    size = np.bincount(cell, minlength=len(cells))
    owners, owner = np.unique(cell * trains + train[theirs], return_inverse=True)  # of one cell and train
    own_size, sure = np.bincount(owner, minlength=len(owners)), known[theirs]
    late = actual[theirs][sure] - low
    by_cell, by_owner = np.sort(cell[sure] * wide + late), np.sort(owner[sure] * wide + late)

    def below(keys, places, than):
        return np.searchsorted(keys, places * wide + np.clip(than - low, 0, wide - 1)) - np.searchsorted(keys, places * wide)

    at = group[mine] * span + (sec[mine] - first)
    begin, end = np.searchsorted(cells, at + min_gap), np.searchsorted(cells, at + max_gap, side="right")
    upto, done = np.cumsum(end - begin), 0
    while done < len(mine):
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + STEP, side="right")))
        n = (end - begin)[done:stop]
        e = np.repeat(np.arange(done, stop), n)
        done = stop
        if not len(e):
            continue
        c = begin[e] + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
        row = mine[e]
        want = c * trains + train[row]
        o = np.minimum(np.searchsorted(owners, want), len(owners) - 1)
        met = np.flatnonzero(owners[o] == want)  # where the own train is there too
        o, ok = o[met], known[row]
        count = size[c]
        count[met] -= own_size[o]
        than = actual[row]
        sums = [count]
        for x in [None, *offsets]:
            limit = np.full(len(e), low + wide) if x is None else than + x
            b = below(by_cell, c, limit)
            b[met] -= below(by_owner, o, limit[met])
            sums.append(np.where(ok, b, 0))
        h = hours[c] if hourly else np.zeros(len(e), np.int64)
        runs = np.flatnonzero(np.concatenate(([True], (e[1:] != e[:-1]) | (h[1:] != h[:-1]))))
        planned, judged, *lower = [np.add.reduceat(s, runs) for s in sums]
        some = np.flatnonzero(planned > 0)
        if not len(some):
            continue
        rows = table.select(cols).take(pa.array(row[runs][some]))
        hour = pa.array(h[runs][some]) if hourly else pa.nulls(len(some), pa.int64())
        flat = np.stack(lower, axis=1)[some].reshape(-1) if lower else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(offsets)), pa.array(flat))
        full = rows.append_column("hour", hour).append_column("planned", pa.array(planned[some])).append_column("judged", pa.array(judged[some])).append_column("below", lists)
        yield from full.to_batches()
