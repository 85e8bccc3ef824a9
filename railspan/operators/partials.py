"""Stored partial aggregates by day, which later days join without the old records being read again.

A table holds, for each day and key, measures that merge: sums, extremes, and the distinct values both as an exact set and as a sketch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """name and what it takes of each row: "sum", "min", "max" or "distinct" of a column."""

    name: str
    kind: str
    column: str = "*"

    def partial(self) -> list[Column]:
        if self.kind == "distinct":
            value = F.col(self.column)
            return [F.collect_set(value).alias(f"{self.name}_set"), F.hll_sketch_agg(value.cast("string"), F.lit(SKETCH_BITS)).alias(f"{self.name}_hll")]
        if self.kind == "sum":
            return [(F.count("*") if self.column == "*" else F.sum(self.column)).alias(self.name)]
        return [{"min": F.min, "max": F.max}[self.kind](self.column).alias(self.name)]


#: Bits of a sketch's size: 2^12 cells count with a standard error of about 1.6 %.
SKETCH_BITS = 12


def partials(rows: DataFrame, keys: list[str], measures: list[Measure], day: str = "day_date") -> DataFrame:
    """One row for each day and key. Sets are of one day and key, so as large as what a key sees in a day."""
    return rows.groupBy(day, *keys).agg(*[c for m in measures for c in m.partial()])


def stored_days(path: str, like: DataFrame, day: str = "day_date") -> DataFrame:
    """Days of the table at path, by its folders alone; none where it does not exist yet."""
    spark = like.sparkSession
    try:
        return spark.read.parquet(path).select(F.col(day).cast(like.schema[day].dataType).alias(day)).distinct()
    except Exception as missing:  # noqa: BLE001  Spark says by its error class that there is no such path yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], like.select(day).schema)


def refresh(rows: DataFrame, path: str, keys: list[str], measures: list[Measure], day: str = "day_date", again: DataFrame | None = None) -> None:
    """Writes the partials of the days of rows that path does not have yet, and of the days in again: what is there of those is replaced.

    A day must come whole. Writing a day a second time replaces its folder, so a job that is run again changes nothing. A null day is not stored.
    """
    new = rows.filter(F.col(day).isNotNull()).join(stored_days(path, rows, day).join(again.select(day), day, "left_anti") if again is not None else stored_days(path, rows, day), day, "left_anti")
    partials(new, keys, measures, day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def merged(stored: DataFrame, keys: list[str], measures: list[Measure], day: str = "day_date", sketches: bool = False) -> DataFrame:
    """The aggregate over all days of stored: keys, n_days, and each measure; distinct counts from the exact sets, or from the sketches.

    Exact sets meet as rows, which are counted apart by key and value, never as one array of all days.
    """
    own = {"sum": F.sum, "min": F.min, "max": F.max}
    cols = [own[m.kind](m.name).alias(m.name) for m in measures if m.kind != "distinct"]
    if sketches:
        cols += [F.hll_sketch_estimate(F.hll_union_agg(f"{m.name}_hll")).alias(m.name) for m in measures if m.kind == "distinct"]
    out = stored.groupBy(*keys).agg(F.countDistinct(day).alias("n_days"), *cols)
    for m in measures if not sketches else []:
        if m.kind == "distinct":
            values = stored.select(*keys, F.explode(f"{m.name}_set").alias("v")).distinct().groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias(m.name))
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            out = out.join(values, same, "left").drop(*[f"_{k}" for k in keys]).fillna(0, [m.name])
    return out.select(*keys, "n_days", *[m.name for m in measures])
