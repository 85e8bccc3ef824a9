"""Punctuality over a stream of records: sliding event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_delay(stream: DataFrame, width: str = "30 minutes", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Mean delay and count by station and window of (ts, station, delay); rows later than `late` are left out."""
    return (stream.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "station")
            .agg(F.avg("delay").alias("avg_delay"), F.count("*").alias("n")).select("station", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "avg_delay", "n"))


def write_connections(stream: DataFrame, path: str, checkpoint: str, **gaps):
    """Each micro-batch of whole service days is joined to connections, in a folder of its own, which a batch that is run again overwrites.

    Days that are split over batches need `live.stream_connections`.
    """
    from railspan.operators.connections import connections

    def put(df: DataFrame, n: int) -> None:
        connections(df, **gaps).write.mode("overwrite").partitionBy("day_date").parquet(f"{path}/batch={n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).start()
