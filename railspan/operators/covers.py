"""Areas as hierarchical cells, for points in polygons, and borders of dissolved areas.

Areas are (name, rings), rings arrays of [lon, lat]; a point is inside if it is inside an odd number of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railspan.operators.network import inside
from railspan.sources.scratch import written

#: Levels of cells of 360 / 2^level degrees: the coarsest that an area is cut into, and the finest.
ROOT, FINEST = 6, 12


def _segments(areas: DataFrame) -> DataFrame:
    """(name, ax, ay, bx, by) of all rings, closed."""
    ring = areas.select("name", F.explode("rings").alias("r"))
    n = F.size("r")
    ends = F.arrays_zip(F.col("r").alias("a"), F.concat(F.slice("r", 2, n), F.slice("r", 1, 1)).alias("b"))
    return ring.filter("size(r) > 0").select("name", F.explode(ends).alias("e")).select("name", *[F.col(f"e.{p}")[k].alias(f"{p}{c}") for p in "ab" for k, c in enumerate("xy")]).filter("ax <> bx or ay <> by")


def _touches(x: Column, y: Column, size: float) -> Column:
    """Whether the segment meets the closed cell, widened by a little, so that rounding cannot hide it."""
    slack = size * 1e-6
    x0, x1, y0, y1 = x * size - 180 - slack, (x + 1) * size - 180 + slack, y * size - 90 - slack, (y + 1) * size - 90 + slack
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    side = [(bx - ax) * (cy - ay) - (by - ay) * (cx - ax) for cx in (x0, x1) for cy in (y0, y1)]
    return (F.greatest(ax, bx) >= x0) & (F.least(ax, bx) <= x1) & (F.greatest(ay, by) >= y0) & (F.least(ay, by) <= y1) & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)


def cell_cover(areas: DataFrame, root: int = ROOT, finest: int = FINEST) -> DataFrame:
    """(name, level, x, y, edge): the cells that areas fill, as coarse as they can be, and the finest cells that their borders cross.

    Cells that a border crosses are quartered, with the border's segments that reach each quarter; a quarter without any is wholly in or out, as
    its centre is. So the tests follow the border's length, not the area. Each level is a written table.
    """
    segs, span = written(_segments(areas), "segments"), lambda a, b, s, o: F.explode(F.sequence(F.floor((F.least(a, b) + o) / s) - 1, F.floor((F.greatest(a, b) + o) / s) + 1))
    leaves = None
    for level in range(root, finest + 1):
        size = 360 / (1 << level)
        if level == root:
            reach = segs.withColumn("x", span(F.col("ax"), F.col("bx"), size, 180)).withColumn("y", span(F.col("ay"), F.col("by"), size, 90))
            box = segs.groupBy("name").agg(*[f(f"a{c}").alias(f"{n}{c}") for c in "xy" for n, f in (("l", F.min), ("h", F.max))])
            cells = box.withColumn("x", span(F.col("lx"), F.col("hx"), size, 180)).withColumn("y", span(F.col("ly"), F.col("hy"), size, 90)).select("name", "x", "y")
        else:
            quarter = lambda df: df.withColumn("x", F.explode(F.array(F.col("x") * 2, F.col("x") * 2 + 1))).withColumn("y", F.explode(F.array(F.col("y") * 2, F.col("y") * 2 + 1)))
            reach, cells = quarter(crossed), quarter(edge)
        crossed = written(reach.filter(_touches(F.col("x"), F.col("y"), size)), "crossed")
        edge = crossed.select("name", "x", "y").distinct()
        whole = cells.join(edge, ["name", "x", "y"], "left_anti").join(areas.select("name", "rings"), "name")
        filled = whole.filter(inside((F.col("y") + 0.5) * size - 90, (F.col("x") + 0.5) * size - 180, F.col("rings"))).select("name", F.lit(level).alias("level"), "x", "y", F.lit(False).alias("edge"))
        leaves = filled if leaves is None else leaves.union(filled)
    return written(leaves.union(edge.select("name", F.lit(finest).alias("level"), "x", "y", F.lit(True).alias("edge"))), "cover")


def covered(points: DataFrame, cover: DataFrame, areas: DataFrame, root: int = ROOT, finest: int = FINEST) -> DataFrame:
    """(id, area) for each area that holds a point (id, lat, lon): by the cells of each level that the point is in; only points in a border's cells are tested."""
    size = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level"))
    keyed = points.select("id", "lat", "lon").dropna(subset=["lat", "lon"]).withColumn("level", F.explode(F.sequence(F.lit(root), F.lit(finest)))).withColumns({"x": F.floor((F.col("lon") + 180) / size), "y": F.floor((F.col("lat") + 90) / size)})
    met = keyed.join(cover, ["level", "x", "y"]).select("id", "lat", "lon", F.col("name").alias("area"), "edge")
    tested = met.filter("edge").join(areas.select(F.col("name").alias("area"), "rings"), "area").filter(inside(F.col("lat"), F.col("lon"), F.col("rings")))
    return met.filter("not edge").select("id", "area").union(tested.select("id", "area"))


def areas_of_lines(lines: DataFrame, areas: DataFrame) -> DataFrame:
    """Lines (id, coords of lat and lon, ...) with the area, by the least name, that holds their middle corner; lines whose middle no area holds are dropped."""
    middle = F.try_element_at("coords", F.floor(F.size("coords") / 2).cast("int") + 1)
    points = lines.filter("size(coords) > 1").select("id", middle["lat"].alias("lat"), middle["lon"].alias("lon"))
    held = covered(points, cell_cover(areas), areas).groupBy("id").agg(F.min("area").alias("area"))
    return lines.join(held, "id")


def _stitch(edges: pd.DataFrame) -> pd.DataFrame:
    """Rings of one group's border: ways along its edges that come back to their start; of several next edges the first one."""
    ways: dict = {}
    for a, b in zip(map(tuple, edges["a"]), map(tuple, edges["b"]), strict=True):
        ways.setdefault(a, {})[b] = ways.setdefault(b, {})[a] = True
    rings = []
    for start in sorted(ways):
        while ways[start]:
            ring, here = [start], min(ways[start])
            del ways[start][here], ways[here][start]
            while here != start:
                ring.append(here)
                there = min(ways[here])
                del ways[here][there], ways[there][here]
                here = there
            rings.append([list(p) for p in ring])
    return pd.DataFrame({"name": [edges["name"].iloc[0]], "rings": [rings]})


def dissolve(areas: DataFrame, groups: DataFrame) -> DataFrame:
    """(name, rings) of the groups (name, group) of areas: the border of their union.

    An edge that two areas of a group share is inside, and goes; so does whatever lies on an edge an even number of times. What is left is stitched to
    rings, a group at a time, as its row holds them all anyway. Neighbours whose common border has other corners in the one than in the other
    keep it as two lines, which changes no point's membership.
    """
    one = F.array("ax", "ay")
    other = F.array("bx", "by")
    edges = _segments(areas).join(groups, "name").select(F.col("group").alias("name"), F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))
    left = edges.groupBy("name", "a", "b").agg((F.count("*") % 2).alias("odd")).filter("odd = 1").select("name", "a", "b")
    return left.groupBy("name").applyInPandas(_stitch, "name string, rings array<array<array<double>>>")


def ring_area(rings: Column) -> Column:
    """Square degrees inside an odd number of rings that do not cross: each ring's area, less that of holes; of (name, rings) with one outer ring first."""
    def of(r):
        n = F.size(r)
        pairs = F.zip_with(r, F.concat(F.slice(r, 2, n), F.slice(r, 1, 1)), lambda p, q: p[0] * q[1] - q[0] * p[1])
        return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)) / 2

    return F.aggregate(F.transform(rings, of), F.lit(0.0), lambda s, v: s + v)
