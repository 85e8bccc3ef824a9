"""Hub labels: distances on the track as a table (station, hub, km), so that the distance of a pair is a join by hub.

Stations are ranked, those with more neighbours first. A station is labelled with a hub if none of the stations on its shortest
ways to the hub ranks above it. Any two stations that are linked share such a hub, the highest on their way, so the sum of their labels is
their distance (a pruned two-hop cover).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspan.sources.scratch import written


def _undirected(rails: DataFrame) -> DataFrame:
    """(x, y, km) in both directions: the shortest edge of each pair; ends that are missing or equal and lengths that are missing or negative are left out."""
    both = rails.select(F.col("a").cast("string").alias("x"), F.col("b").cast("string").alias("y"), F.col("km").cast("double").alias("km")).dropna().filter("x <> y and km >= 0")
    return both.union(both.select("y", "x", "km")).groupBy("x", "y").agg(F.min("km").alias("km"))


def _covered(found: DataFrame, labels: DataFrame, slack: float) -> DataFrame:
    """(station, hub) of those of found (station, hub, km) that a higher hub of both explains: within its labels there is a way that is no longer."""
    p = labels.select("station", F.col("hub").alias("via"), F.col("km").alias("p"))
    q = labels.select(F.col("station").alias("hub"), F.col("hub").alias("via"), F.col("km").alias("q"))
    return found.join(p, "station").join(q, ["hub", "via"]).filter(F.col("p") + F.col("q") <= F.col("km") * (1 + slack)).select("station", "hub").distinct()


def hub_labels(rails: DataFrame, slack: float = 1e-12) -> DataFrame:
    """(station, hub, km) for the undirected track (a, b, km); a station is its own hub at 0 km, which is not written.

    Rounds of doubling: two labels meet at the hub of one and the station of the other, or at their common station, and the sum is
    a label of the lower of their other ends unless a higher hub explains it. New labels meet all; ways that double in each round need rounds
    in the logarithm of their hops. Each round is a written table; ends when no label is new or shorter. slack: ways that differ by
    this part are equal, as sums of doubles in another order are.
    """
    both = written(_undirected(rails), "track")
    rank = both.groupBy("x").agg(F.struct((-F.count("*")).alias("n"), F.col("x").alias("id")).alias("rank"))  # less is higher
    low = both.join(rank.withColumnRenamed("rank", "rx"), "x").join(rank.select(F.col("x").alias("y"), F.col("rank").alias("ry")), "y")
    front = written(low.filter("ry < rx").select(F.col("x").alias("station"), F.col("y").alias("hub"), "km", F.col("ry").alias("rank")), "labels")
    labels = front
    while not front.isEmpty():
        found = _meet(front, labels).groupBy("station", "hub", "rank").agg(F.min("km").alias("km"))
        known = labels.select("station", "hub", F.col("km").alias("old"))
        better = written(found.join(known, ["station", "hub"], "left").filter("old is null or km < old * (1 - 1e-12)").select("station", "hub", "km", "rank"), "found")
        front = written(better.join(_covered(better, labels, slack), ["station", "hub"], "left_anti").select("station", "hub", "km", "rank"), "front")
        labels = written(labels.union(front).groupBy("station", "hub", "rank").agg(F.min("km").alias("km")).select("station", "hub", "km", "rank"), "labels")
    return labels.join(_covered(labels, labels, slack), ["station", "hub"], "left_anti").select("station", "hub", "km")


def _meet(front: DataFrame, labels: DataFrame) -> DataFrame:
    """Sums of two labels of which one is new, as (station, hub, rank, km): the hub ranks above the station."""
    up = labels.select(F.col("station").alias("hub"), F.col("hub").alias("top"), F.col("km").alias("more"), F.col("rank").alias("r"))
    after = front.select("station", "hub", "km").join(up, "hub").select("station", F.col("top").alias("hub"), F.col("r").alias("rank"), (F.col("km") + F.col("more")).alias("km"))
    down = labels.select(F.col("station").alias("own"), F.col("hub").alias("station"), F.col("km").alias("more"))
    before = front.join(down, "station").select(F.col("own").alias("station"), "hub", "rank", (F.col("km") + F.col("more")).alias("km"))
    other = labels.select("station", F.col("hub").alias("h"), F.col("km").alias("more"), F.col("rank").alias("r"))
    side = front.join(other, "station").filter("hub <> h")
    above = F.col("rank") < F.col("r")
    pick = lambda x, y: F.when(above, F.col(x)).otherwise(F.col(y))
    beside = side.select(pick("h", "hub").alias("station"), pick("hub", "h").alias("hub"), pick("rank", "r").alias("rank"), (F.col("km") + F.col("more")).alias("km"))
    return after.union(before).union(beside)


def distances(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(origin, station, km) of the asked pairs (origin, station) that the track links; a pair of equal stations is left out."""
    asked = pairs.select(F.col("origin").cast("string").alias("origin"), F.col("station").cast("string").alias("station")).dropna().filter("origin <> station").distinct()
    own = lambda c: asked.select(F.col(c).alias("station"), F.col(c).alias("hub"), F.lit(0.0).alias("km"))
    ends = lambda c, km: labels.select("station", "hub", "km").union(own(c).distinct()).select(F.col("station").alias(c), "hub", F.col("km").alias(km))
    met = asked.join(ends("origin", "p"), "origin").join(ends("station", "q"), ["station", "hub"])
    return met.groupBy("origin", "station").agg(F.min(F.col("p") + F.col("q")).alias("km"))
