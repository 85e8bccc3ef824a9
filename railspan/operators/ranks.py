"""Exact places in a sorted column without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railspan.sources.scratch import written


def running_counts(df: DataFrame, col: str) -> DataFrame:
    """(col, c, upto, n) for each distinct value that is not null: its rows, the rows up to it, and all rows.

    Values are counted, dealt by range and added up within their range; only one sum of each range meets the others.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("c")).repartitionByRange(col)
    counts = written(counts.withColumn("part", F.spark_partition_id()), "counts")
    sums = counts.groupBy("part").agg(F.sum("c").alias("own"))
    every = Window.orderBy("part")  # as many rows as there are ranges
    offsets = sums.select("part", (F.sum("own").over(every) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy()).alias("n"))
    inner = F.sum("c").over(Window.partitionBy("part").orderBy(col))
    return counts.join(offsets, "part").select(col, "c", (F.col("before") + inner).alias("upto"), "n")
