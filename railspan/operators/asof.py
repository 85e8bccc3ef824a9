"""As-of joins by a merge of sorted rows: no slots, no exploded days, no task that sees a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspan.sources.scratch import written


def asof(left: DataFrame, right: DataFrame, by: list[str], at: Column | str, forward: bool = False) -> DataFrame:
    """Columns of left and `match`: the row of right (a struct) of the same `by` that is last at or before `at`, or, forward, first after it.

    Both sides are put together and dealt by ranges of (by, at), so a busy key spreads over many tasks. In a range the last row of
    right is carried down to the rows of left; what the ranges before leave at their end comes from a table with one row for each range and
    key. match is null where there is none. Of rows of right that are equal in `at` the greatest (forward: the least) row counts.
    Rows of left with a null in by or at match nothing; such rows of right are left out.
    """
    at, key = F.col(at) if isinstance(at, str) else at, F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_"))
    empty = lambda df: F.lit(None).cast(df.select(F.struct("*").alias("s")).schema["s"].dataType)
    valid = lambda df: df.select(key.alias("k"), at.alias("t"), F.struct("*").alias("row"))
    a = valid(left).select("k", "t", F.lit(0 if forward else 1).alias("side"), F.col("row").alias("l"), empty(right).alias("r"))
    b = valid(right.dropna(subset=by) if by else right).dropna(subset=["t"]).select("k", "t", F.lit(1 if forward else 0).alias("side"), empty(left).alias("l"), F.col("row").alias("r"))
    down = (lambda c: F.desc(c)) if forward else (lambda c: F.asc(c))
    order = [down("t"), F.asc("side"), down("r")]
    rows = written(a.union(b).repartitionByRange(F.col("k"), *order).withColumn("part", F.spark_partition_id()), "asof")
    carried = F.last("r", ignorenulls=True)
    inner = Window.partitionBy("part", "k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.groupBy("part", "k").agg((F.min_by if forward else F.max_by)("r", F.when(F.col("r").isNotNull(), F.struct("t", "r"))).alias("end"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ends = ends.select("part", "k", F.last("end", ignorenulls=True).over(before).alias("carry")).filter("carry is not null")
    met = rows.withColumn("own", carried.over(inner)).filter("l is not null").join(ends, ["part", "k"], "left")
    return met.select("l.*", F.when(F.col("t").isNotNull() & ~F.exists(F.array(*[F.col(f"l.`{c}`").isNull() for c in by] or [F.lit(False)]), lambda x: x), F.coalesce("own", "carry")).alias("match"))
