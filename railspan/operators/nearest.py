"""Exact nearest neighbours without a radius: rings on nested grids that grow until they prove their answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railspan.functions.scalars import EARTH_KM, KM_PER_LAT, KM_PER_LON
from railspan.sources.scratch import written


def degrees(lat: Column, lon: Column) -> Column:
    return F.array(lat, lon)


def planar_km(lat: Column, lon: Column) -> Column:
    """Kilometres on a plane that is true at the country's latitude."""
    return F.array(lat * KM_PER_LAT, lon * KM_PER_LON)


def sphere_km(lat: Column, lon: Column) -> Column:
    """A place in space: straight lines through the earth order places as ways on it do, at every latitude and across 180 degrees."""
    a, o = F.radians(lat), F.radians(lon)
    return F.array(F.cos(a) * F.cos(o) * EARTH_KM, F.cos(a) * F.sin(o) * EARTH_KM, F.sin(a) * EARTH_KM)


def nearest(left: DataFrame, right: DataFrame, place=sphere_km, bits: int = 26, order=None, within: float | None = None, spots: bool = False) -> DataFrame:
    """(id, nearest, apart): for each (id, lat, lon) of left the nearest of right (id, lat, lon), the least id among equals.

    A round looks into the cells around each place, as wide as the round's step: what is found within the step is proven, since all places
    so near lie in these cells; the others go on with cells twice as wide. The first step follows from how thickly right lies, so most places are
    settled in a round or two, and a place in the void meets few rows until its ring touches some. apart: along the metric's straight line. Rows with
    a null are left out; without right there is no row. ids of left repeat rows only if left does.
    order: a measure of (lat, lon, lat, lon) that orders places as the metric does, by which equals are told instead. within: places with none so near, along the
    metric, may be left out, so their rings need not grow on. Many rows of right at one place count as the least id. spots: with both places, as id_on and other_on.
    """
    axes = 3 if place is sphere_km else 2
    spot = F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    pts = lambda df, n: df.select(F.col("id").alias(n), place(F.col("lat").cast("double"), F.col("lon").cast("double")).alias(f"{n}_at"), spot.alias(f"{n}_on")).dropna().filter(~F.exists(f"{n}_at", lambda v: v.isNull() | F.isnan(v)))
    a, b = written(pts(left, "id").distinct(), "left"), written(pts(right, "other").groupBy("other_at", "other_on").agg(F.min("other").alias("other")), "right")
    ends = [f(F.col("other_at")[k]).alias(f"{n}{k}") for k in range(axes) for n, f in (("lo", F.min), ("hi", F.max))]
    box = b.agg(F.count("*").alias("n"), *ends).first()
    if not box["n"]:
        none = a.select("id", F.lit(None).cast(b.schema["other"].dataType).alias("nearest"), F.lit(None).cast("double").alias("apart"), "id_on", F.col("id_on").alias("other_on")).limit(0)
        return none if spots else none.drop("id_on", "other_on")
    extent = max(box[f"hi{k}"] - box[f"lo{k}"] for k in range(axes))
    step = max(extent, 1e-9) / max(1.0, (2.0 * box["n"]) ** 0.5)
    found = None
    for _ in range(bits + 64):  # doubles leave no more steps than this
        cell = lambda p, s=step: [F.floor(F.col(p)[k] / s) for k in range(axes)]
        mine = a.select("*", F.array(*cell("id_at")).alias("c"))
        for k in range(axes):
            mine = mine.withColumn(f"c{k}", F.explode(F.sequence(F.col("c")[k] - 1, F.col("c")[k] + 1)))
        theirs = b.select("*", *[c.alias(f"c{k}") for k, c in enumerate(cell("other_at"))])
        p = sum(((F.col("id_at")[k] - F.col("other_at")[k]) * (F.col("id_at")[k] - F.col("other_at")[k]) for k in range(1, axes)), (F.col("id_at")[0] - F.col("other_at")[0]) * (F.col("id_at")[0] - F.col("other_at")[0]))
        first = p if order is None else order(F.col("id_on.lat"), F.col("id_on.lon"), F.col("other_on.lat"), F.col("other_on.lon"))
        met = mine.join(theirs, [f"c{k}" for k in range(axes)]).groupBy("id", "id_at", "id_on").agg(F.min(F.struct(first.alias("first"), "other", p.alias("p"), "other_on")).alias("b"))
        met = written(met.filter(F.col("b.p") <= (step * (1 - 1e-9)) ** 2).select("id", "id_at", "id_on", F.col("b.other").alias("nearest"), F.sqrt("b.p").alias("apart"), F.col("b.other_on").alias("other_on")), "settled")
        found = met if found is None else found.union(met)
        a = written(a.join(met.select("id", "id_at", "id_on"), ["id", "id_at", "id_on"], "left_anti"), "left")
        if a.isEmpty() or (within is not None and step * (1 - 1e-9) > within):
            return found.select("id", "nearest", "apart", "id_on", "other_on") if spots else found.select("id", "nearest", "apart")
        step *= 2
    raise RuntimeError("places too far apart for doubles")


def nearest_cells(cells: DataFrame, stops: DataFrame, place=degrees) -> DataFrame:
    """(i, j, id): the stop (id, lat, lon) nearest to each cell (i, j, lat, lon), the least id among equals: a Voronoi map as a raster."""
    found = nearest(cells.select(F.struct("i", "j").alias("id"), "lat", "lon"), stops, place)
    return found.select("id.i", "id.j", F.col("nearest").alias("id"))
