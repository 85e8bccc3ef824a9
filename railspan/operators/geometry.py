"""Polylines: lengths, overlaps, cuts and merging of parallel ones, with numpy kernels grouped by endpoint pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railspan.functions.scalars import km_to_degrees
from railspan.sources.scratch import written


def length_km(coords: Column) -> Column:
    """Planar length of an array of (lat, lon), in km."""
    steps = F.zip_with(F.slice(coords, 1, F.size(coords) - 1), F.slice(coords, 2, F.size(coords) - 1), lambda a, b: F.sqrt(F.pow(a["lat"] - b["lat"], 2) + F.pow(a["lon"] - b["lon"], 2)))
    return F.when(F.size(coords) > 1, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / km_to_degrees(1.0)).otherwise(F.lit(0.0))


def _sample(line: np.ndarray, n: int = 200) -> np.ndarray:
    step = np.hypot(*np.diff(line, axis=0).T)
    at = np.concatenate([[0], np.cumsum(step)])
    t = np.linspace(0, at[-1], n)
    return np.column_stack([np.interp(t, at, line[:, 0]), np.interp(t, at, line[:, 1])])


def overlap(a: np.ndarray, b: np.ndarray, km: float = 0.5) -> tuple[float, float, float]:
    """Share of a within km of b, and the first and last place (0 to 1) on a that is."""
    p, s, e = _sample(a), b[:-1], b[1:]
    d = e - s
    t = np.clip(((p[:, None] - s) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-18), 0, 1)
    near = np.sqrt((((s + t[..., None] * d) - p[:, None]) ** 2).sum(-1)).min(1) <= km_to_degrees(km)
    at = np.flatnonzero(near) / (len(p) - 1)
    return float(near.mean()), float(at[0]) if len(at) else 0.0, float(at[-1]) if len(at) else 0.0


def cut(line: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray | None]:
    """Before, between and after two places; a part under a hundredth of the line is None."""
    p = _sample(line)
    n = len(p) - 1
    marks = [0, round(lo * n) if lo > 0.01 else 0, round(hi * n) if hi < 0.99 else n, n]
    return tuple(p[a : b + 1] if b > a else None for a, b in zip(marks, marks[1:], strict=False))


def _length(line: np.ndarray) -> float:
    return float(np.hypot(*np.diff(line, axis=0).T).sum())


def resolve(lines: list[tuple[float, np.ndarray]], km: float, share: float, size: float, covered: float = 0.8, edge: float = 0.05, rounds: int = 20) -> list[tuple[float, np.ndarray]]:
    """Lines (frequency, points) of one pair of ends without overlaps.

    Two of like length that share much become the longer one. A short one along a longer one cuts it: the common
    part carries both frequencies, what is before and after keeps its own; if it spans all of it, they are one.
    Pieces meet all others again, for at most `rounds` cuts a line.
    """
    todo, kept, cuts = sorted(lines, key=lambda x: (-_length(x[1]), -x[0])), [], rounds * len(lines)
    while todo:
        f, line = todo.pop(0)
        for i, (g, other) in enumerate(kept):
            (nf, near), (ff, far) = sorted([(f, line), (g, other)], key=lambda x: _length(x[1]))
            if _length(near) < km_to_degrees(0.01):
                continue
            inner, (outer, lo, hi) = overlap(near, far, km)[0], overlap(far, near, km)
            alike = _length(near) >= size * _length(far)
            if alike and min(inner, outer) >= share or not alike and max(inner, outer) >= covered and lo < edge and hi > 1 - edge:
                kept[i] = (f + g, far)
                break
            if not alike and max(inner, outer) >= covered and cuts > 0:
                cuts -= 1
                del kept[i]
                parts = zip((ff, ff + nf, ff), cut(far, lo, hi), strict=True)
                todo += [(w, part) for w, part in parts if part is not None]
                break
        else:
            kept.append((f, line))
    return kept


def merge_parallel(segments: DataFrame, km: float = 0.5, share: float = 0.7, size: float = 0.5) -> DataFrame:
    """(a, b, frequency, coords): segments (id_a, id_b, frequency, coords) with the same two ends, merged or cut where they overlap.

    Pairs of ends are independent, so they are dealt to tasks; one pair has few segments by nature. Lines of
    fewer than two points stay as they are.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = [(f, np.array([(c["lat"], c["lon"]) for c in line]).reshape(-1, 2)) for f, line in zip(pdf.frequency, pdf.coords, strict=True)]
        kept = resolve([x for x in lines if len(x[1]) > 1], km, share, size) + [x for x in lines if len(x[1]) < 2]
        return pd.DataFrame([(pdf.a.iloc[0], pdf.b.iloc[0], f, [{"lat": float(x), "lon": float(y)} for x, y in line]) for f, line in kept], columns=["a", "b", "frequency", "coords"])

    keyed = segments.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "frequency", "coords")
    return keyed.groupBy("a", "b").applyInPandas(run, "a string, b string, frequency double, coords array<struct<lat:double,lon:double>>")


def overlapping(segments: DataFrame, km: float = 0.5, share: float = 0.7, cell: float = 0.1) -> DataFrame:
    """(a, b, shared) for pairs of segments (id, coords), a < b, of which each has at least `share` within km of the other.

    Segments meet in the grid cells that their bounding boxes, widened by km, cover; a pair is taken up in the one cell where
    the common part of its boxes begins. Lines of fewer than two points overlap nothing. Lines of equal coords are measured once, under their
    least id, and the measured pairs are dealt anew, so the work follows the different lines and no task has a crowded cell to itself.
    """
    spark = segments.sparkSession
    edge = km_to_degrees(km)
    low, high = (lambda v: F.array_min(v) - edge), (lambda v: F.array_max(v) + edge)
    known = segments.filter("size(coords) > 1")
    alike = known.groupBy("coords").agg(F.min("id").alias("id"), F.collect_list("id").alias("ids"))
    lines = written(alike.select("id", "coords", "ids"), "lines")
    rows = lines.select("id", (F.size("ids") > 1).alias("many"), F.transform("coords", lambda c: c["lat"]).alias("x"), F.transform("coords", lambda c: c["lon"]).alias("y"))
    rows = rows.select("*", low(F.col("x")).alias("x0"), high(F.col("x")).alias("x1"), low(F.col("y")).alias("y0"), high(F.col("y")).alias("y1"))
    span = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(z) / cell)))
    rows = rows.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    a, b = (rows.withColumnsRenamed({c: f"{c}_{n}" for c in ("id", "many", "x", "y", "x0", "x1", "y0", "y1")}) for n in "ab")
    begin = lambda c: F.greatest(f"{c}0_a", f"{c}0_b")
    met = a.join(b, ["cx", "cy"]).filter(((F.col("id_a") < F.col("id_b")) | F.col("many_a") & (F.col("id_a") == F.col("id_b"))) & (begin("x") <= F.least("x1_a", "x1_b")) & (begin("y") <= F.least("y1_a", "y1_b")))
    met = met.filter((F.col("cx") == F.floor(begin("x") / cell)) & (F.col("cy") == F.floor(begin("y") / cell)))
    met = met.select(*[f"{c}_{n}" for n in "ab" for c in ("id", "x", "y")]).repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    @F.pandas_udf("double")
    def least_share(xa: pd.Series, ya: pd.Series, xb: pd.Series, yb: pd.Series) -> pd.Series:
        lines = [(np.column_stack([p, q]), np.column_stack([r, s])) for p, q, r, s in zip(xa, ya, xb, yb, strict=True)]
        return pd.Series([min(overlap(u, v, km)[0], overlap(v, u, km)[0]) for u, v in lines], dtype=float)

    found = met.select("id_a", "id_b", least_share("x_a", "y_a", "x_b", "y_b").alias("shared")).filter(F.col("shared") >= share)
    each = lambda n: lines.select(F.col("id").alias(f"id_{n}"), F.explode("ids").alias(n))
    pairs = found.join(each("a"), "id_a").join(each("b"), "id_b").filter((F.col("id_a") != F.col("id_b")) | (F.col("a") < F.col("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared")
