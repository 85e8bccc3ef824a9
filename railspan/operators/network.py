"""Timetable edges, frequencies and spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspan.functions.scalars import haversine_km
from railspan.operators.nearest import degrees, nearest, sphere_km
from railspan.operators.ranks import running_counts


def stop_lookup(stops: DataFrame, box: Column | None = None) -> DataFrame:
    """Stops under their parent's id, name and place."""
    p = stops.select(F.col("stop_id").alias("pid"), F.col("stop_name").alias("pn"), F.col("stop_lat").alias("plat"), F.col("stop_lon").alias("plon"))
    out = stops.join(p, F.col("parent_station") == F.col("pid"), "left").select(
        "stop_id", F.coalesce("pid", "stop_id").alias("station_id"), F.coalesce("pn", "stop_name").alias("name"), F.coalesce("plat", "stop_lat").alias("lat"), F.coalesce("plon", "stop_lon").alias("lon"))
    return out if box is None else out.filter(box)


def edges(stop_times: DataFrame) -> DataFrame:
    """(src, dep_min, dst, arr_min, trip_id): consecutive stops of each trip (trip_id, seq, stop, arr_min, dep_min)."""
    w = Window.partitionBy("trip_id").orderBy("seq", "stop")
    return (stop_times.select("trip_id", F.col("stop").alias("src"), "dep_min", F.lead("stop").over(w).alias("dst"), F.lead("arr_min").over(w).alias("arr_min")).filter("dst is not null"))


def segment_frequency(edge: DataFrame, n_days: int = 1, weights: DataFrame | None = None) -> DataFrame:
    """Traversals of each directed segment by day; with weights (trip_id, n_days), each trip counts its service days."""
    w = F.lit(1)
    if weights is not None:
        edge, w = edge.join(weights.select("trip_id", F.col("n_days").alias("_w")), "trip_id"), F.col("_w")
    return edge.groupBy(F.col("src").alias("from_id"), F.col("dst").alias("to_id")).agg((F.sum(w) / n_days).alias("freq"))


def station_frequency(freq: DataFrame) -> DataFrame:
    return freq.select(F.explode(F.array("from_id", "to_id")).alias("id"), "freq").groupBy("id").agg(F.sum("freq").alias("freq"))


def trains_per_day(freq: DataFrame) -> DataFrame:
    both = freq.select(F.col("from_id").alias("id"), F.col("freq").alias("o"), F.lit(0.0).alias("i")).union(freq.select("to_id", F.lit(0.0), "freq"))
    return both.groupBy("id").agg(F.greatest(F.sum("o"), F.sum("i")).alias("trains_per_day"))


def last_train(edge: DataFrame) -> DataFrame:
    return edge.groupBy(F.col("src").alias("id")).agg(F.max("dep_min").alias("last_min"))


def direct_frequency(edge: DataFrame, n_feeds: int = 1) -> DataFrame:
    return edge.groupBy(F.col("src").alias("id")).agg((F.count_if((F.col("dep_min") >= 360) & (F.col("dep_min") < 1320)) / F.lit(16.0) / n_feeds).alias("per_hour"))


def commercial_stops(stop_times: DataFrame, trips: DataFrame, lookup: DataFrame, active: DataFrame) -> DataFrame:
    """(station, train_no) where passengers may board or leave trains that run."""
    return (stop_times.filter("pickup_type = 0 or drop_off_type = 0").join(trips.join(active.select("service_id").distinct(), "service_id", "left_semi"), "trip_id")
            .filter("trip_short_name is not null and trip_short_name <> ''").join(lookup, "stop_id").select(F.upper(F.trim("name")).alias("station"), F.col("trip_short_name").alias("train_no")).distinct())


def keep_commercial(rec: DataFrame, commercial: DataFrame | None) -> DataFrame:
    """Records of trains that stop; all of them where nothing is known."""
    return rec if commercial is None or commercial.isEmpty() else rec.join(commercial, ["station", "train_no"], "left_semi")


def _columns(km: float) -> tuple[float, int, float]:
    """Degrees between grid rows, number of grid columns around the earth, degrees of a column: a row is wider than km."""
    size = min(km / 60, 180.0)
    n = max(1, int(360 / size))
    return size, n, 360 / n


def _cells(lat: Column, lon: Column, km: float) -> list[Column]:
    size, n, wide = _columns(km)
    return [F.floor(lat / size).alias("cx"), F.pmod(F.floor((lon + 180) / wide), F.lit(n)).alias("cy")]


def _around(df: DataFrame, lat: str, lon: str, km: float, planar: bool = False) -> DataFrame:
    """Each row in all grid cells that places within km of it can be in, at every latitude and across 180 degrees.

    A circle's longitudes widen with the latitude; near a pole it meets all columns. planar: also the places that are as near in degrees as one within km can be.
    """
    size, n, wide = _columns(km)
    polar = F.abs(F.col(lat)) + size
    reach = F.when(polar < 89.5, F.least(F.lit(180.0), size * 0.6 / F.cos(F.radians(F.least(polar, F.lit(89.5)))))).otherwise(180.0)
    up = F.greatest(F.lit(size), F.least(reach, F.lit(180.0))) if planar else F.lit(size)
    rows = F.sequence(F.floor((F.col(lat) - up) / size), F.floor((F.col(lat) + up) / size))
    cols = F.sequence(F.floor((F.col(lon) + 180 - reach) / wide), F.floor((F.col(lon) + 180 + reach) / wide))
    return df.withColumn("cx", F.explode(rows)).withColumn("cy", F.explode(F.array_distinct(F.transform(cols, lambda c: F.pmod(c, F.lit(n))))))


def nearest_point(left: DataFrame, right: DataFrame, max_km: float = 1.0) -> DataFrame:
    """For each (id, lat, lon) of left the point of right nearest in degrees, if within max_km on the sphere.

    By growing rings, so a place meets the points near it, not all of those that max_km reaches.
    """
    planar = lambda lat, lon, rlat, rlon: F.pow(lat - rlat, 2) + F.pow(lon - rlon, 2)
    best = nearest(left.select("id", "lat", "lon"), right, degrees, order=planar, spots=True)
    km = haversine_km(F.col("id_on.lat"), F.col("id_on.lon"), F.col("other_on.lat"), F.col("other_on.lon"))
    return best.select("id", "nearest", km.alias("km")).filter(F.col("km") <= max_km)


def nearest_in_metres(left: DataFrame, right: DataFrame, metres: float = 1000.0) -> DataFrame:
    """For each (id, lat, lon) of left the point of right nearest on the sphere, nearer than metres; the least id among equals."""
    m = lambda *ends: haversine_km(*ends) * 1000
    best = nearest(left.select("id", "lat", "lon"), right, sphere_km, order=m, within=metres / 1000, spots=True)
    return best.select("id", "nearest", m(F.col("id_on.lat"), F.col("id_on.lon"), F.col("other_on.lat"), F.col("other_on.lon")).alias("metres")).filter(F.col("metres") < metres)


def cluster_isolated(points: DataFrame, segment_ids: DataFrame, max_km: float = 1.0) -> DataFrame:
    """Points without a segment take the id of the nearest point that has one."""
    linked = points.join(segment_ids.select("id").distinct(), "id", "left_semi")
    alone = points.join(segment_ids.select("id").distinct(), "id", "left_anti")
    return points.join(nearest_point(alone, linked, max_km).select("id", "nearest"), "id", "left").select("id", F.coalesce("nearest", "id").alias("cluster"))


def transfer_band(stops: DataFrame, max_km: float = 0.4) -> DataFrame:
    """All pairs of stops within walking distance, in both directions, with the minutes of the walk."""
    a = stops.select(F.col("id").alias("stop_a"), F.col("lat").alias("la"), F.col("lon").alias("oa"))
    b = stops.select(F.col("id").alias("stop_b"), F.col("lat").alias("lb"), F.col("lon").alias("ob"), *_cells(F.col("lat"), F.col("lon"), max_km))
    km = haversine_km(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob"))
    return (_around(a, "la", "oa", max_km).join(b, ["cx", "cy"]).filter(F.col("stop_a") != F.col("stop_b")).withColumn("km", km).filter(F.col("km") <= max_km)
            .select("stop_a", "stop_b", "km", (F.col("km") / 4.5 * 60).alias("walk_min")))


def within_radius(stops: DataFrame, lat: float, lon: float, max_km: float) -> DataFrame:
    km = haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return stops.withColumn("km", km).filter(F.col("km") <= max_km).withColumn("walk_min", F.col("km") / 4.5 * 60)


def raster(spark, resolution: int = 200, box=(49.4, 51.6, 2.5, 6.5)) -> DataFrame:
    """Cell centres of a square grid over a box: i, j, lat, lon."""
    n = resolution - 1
    return spark.range(resolution * resolution).select((F.col("id") / resolution).cast("int").alias("i"), (F.col("id") % resolution).cast("int").alias("j")).select(
        "i", "j", (F.lit(box[0]) + F.col("i") * ((box[1] - box[0]) / n)).alias("lat"), (F.lit(box[2]) + F.col("j") * ((box[3] - box[2]) / n)).alias("lon"))


def coverage(times: DataFrame) -> DataFrame:
    t = F.col("time")
    return times.agg(F.percentile(t, F.lit(0.5)).alias("median"), F.avg(t).alias("mean"), F.percentile(t, F.lit(0.95)).alias("p95"), *[F.avg((t <= m).cast("int") * 100.0).alias(f"pct_{m}min") for m in (5, 10, 15, 20, 30)])


def inside(lat: Column, lon: Column, rings: Column) -> Column:
    """Even-odd test of a point against all rings (arrays of [lon, lat]); holes count by parity."""

    def crosses(ring):
        n = F.size(ring)
        ends = F.zip_with(ring, F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.size(F.filter(ends, lambda e: ((e["a"][1] > lat) != (e["b"][1] > lat)) & (lon < F.try_divide((e["b"][0] - e["a"][0]) * (lat - e["a"][1]), e["b"][1] - e["a"][1]) + e["a"][0])))

    return F.aggregate(rings, F.lit(0), lambda n, ring: n + crosses(ring)) % 2 == 1


#: Degrees of a grid cell in which points meet areas.
AREA_CELL = 0.25


def areas_of(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(id, area) for each area (name, rings) that holds a point. Points meet the areas whose bounding boxes touch their grid cell."""
    cell = AREA_CELL
    xs, ys = (F.flatten(F.transform("rings", lambda ring: F.transform(ring, lambda p: p[0]))), F.flatten(F.transform("rings", lambda ring: F.transform(ring, lambda p: p[1]))))
    span = lambda v: F.explode(F.sequence(F.floor(F.array_min(v) / cell), F.floor(F.array_max(v) / cell)))
    boxes = areas.select(F.col("name").alias("area"), "rings", span(ys).alias("cx"), xs.alias("xs")).select("area", "rings", "cx", span(F.col("xs")).alias("cy"))
    met = points.select("id", "lat", "lon", F.floor(F.col("lat") / cell).alias("cx"), F.floor(F.col("lon") / cell).alias("cy")).join(boxes, ["cx", "cy"])
    return met.filter(inside(F.col("lat"), F.col("lon"), F.col("rings"))).select("id", "area")


def within_any(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Points that some area holds: a border needs no union of its provinces."""
    return points.join(areas_of(points, areas).select("id"), "id", "left_semi")


def dissolve(areas: DataFrame, groups: DataFrame) -> DataFrame:
    """Areas (name, rings) joined to the groups (name, group) they are in: all rings of a group's areas, which do not overlap."""
    return areas.join(groups, "name").groupBy(F.col("group").alias("name")).agg(F.flatten(F.array_sort(F.collect_list("rings"))).alias("rings"))


def assign_area(points: DataFrame, areas: DataFrame, centroids: DataFrame, fallback_km: float = 30.0) -> DataFrame:
    """Area that holds each point (the least name among several), else the nearest centroid within fallback_km, else null.

    Points meet the areas whose bounding boxes touch their grid cell, and the centroids of the cells that fallback_km reaches.
    """
    held = areas_of(points, areas).groupBy("id").agg(F.min("area").alias("held"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    ends = centroids.select(F.col("name").alias("c"), F.col("lat").alias("clat"), F.col("lon").alias("clon"), *_cells(F.col("lat"), F.col("lon"), fallback_km))
    near = _around(points.select("id", "lat", "lon"), "lat", "lon", fallback_km).join(ends, ["cx", "cy"]).groupBy("id").agg(F.min(F.struct(km.alias("km"), "c")).alias("n"))
    return points.join(held, "id", "left").join(near, "id", "left").select("id", F.coalesce("held", F.when(F.col("n.km") < fallback_km, F.col("n.c"))).alias("area"))


def best_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def quantile_edges(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.agg(*[F.percentile(col, F.lit(i / n)).alias(f"q{i}") for i in range(n + 1)])


def terciles(df: DataFrame, col: str) -> DataFrame:
    """Elements floor(0.33 n) and floor(0.66 n) of the sorted values, by counts of distinct values."""
    run = running_counts(df, col)
    return run.agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") * 0.33), F.col(col))).alias("t1"), F.min(F.when(F.col("upto") > F.floor(F.col("n") * 0.66), F.col(col))).alias("t2"))


def map_to_track(freq: DataFrame, track: DataFrame, paths: DataFrame) -> DataFrame:
    """Frequencies on track segments (a, b): direct, else along a path's hops (from_id, to_id, hops), else the straight line."""
    t = track.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    f = freq.withColumns({"a": F.least("from_id", "to_id"), "b": F.greatest("from_id", "to_id")})
    direct = f.join(t, ["a", "b"], "left_semi").select("a", "b", "freq", F.lit("direct").alias("how"))
    rest = f.join(t, ["a", "b"], "left_anti").join(paths, ["from_id", "to_id"], "left")
    hop = F.arrays_zip(F.slice("hops", 1, F.size("hops") - 1).alias("x"), F.slice("hops", 2, F.size("hops") - 1).alias("y"))
    path = rest.filter("hops is not null").select("freq", F.explode(hop).alias("h")).select(F.least("h.x", "h.y").alias("a"), F.greatest("h.x", "h.y").alias("b"), "freq", F.lit("path").alias("how"))
    line = rest.filter("hops is null").select("a", "b", "freq", F.lit("line").alias("how"))
    return direct.unionByName(path).unionByName(line).groupBy("a", "b").agg(F.sum("freq").alias("freq"), F.min("how").alias("how"))


def mapping_counts(freq: DataFrame, track: DataFrame, paths: DataFrame, straight: bool = True) -> DataFrame:
    """How many segments lie on track, on a path of it, on neither: those become straight lines, or are dropped."""
    t = track.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("on")).distinct()
    p = paths.filter("hops is not null").select("from_id", "to_id", F.lit(True).alias("by")).distinct()
    f = freq.withColumns({"a": F.least("from_id", "to_id"), "b": F.greatest("from_id", "to_id")}).join(t, ["a", "b"], "left").join(p, ["from_id", "to_id"], "left")
    direct, path = F.col("on").isNotNull(), F.col("on").isNull() & F.col("by").isNotNull()
    neither = F.count_if(~direct & ~path)
    return f.agg(F.count("*").alias("total"), F.count_if(direct).alias("direct"), F.count_if(path).alias("path"), F.count_if(direct | path).alias("mapped"),
                 (neither if straight else F.lit(0)).alias("fallback"), (F.lit(0) if straight else neither).cast("long").alias("dropped"))


def segment_index(segments: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b, coords): segments (from_id, to_id, coords) between clusters (id, cluster), unless both ends are of one; of several the longest."""
    end = lambda n: clusters.select(F.col("id").alias(f"{n}_id"), F.col("cluster").alias(f"{n}_c"))
    met = segments.join(end("from"), "from_id", "left").join(end("to"), "to_id", "left")
    x, y = F.coalesce("from_c", "from_id"), F.coalesce("to_c", "to_id")
    x, y = F.when(x != y, x).otherwise(F.col("from_id")), F.when(x != y, y).otherwise(F.col("to_id"))
    ends = met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "coords").repartition("a", "b")  # sorted once, after the shuffle
    return ends.groupBy("a", "b").agg(F.max(F.struct(F.size("coords").alias("n"), "coords"))["coords"].alias("coords"))  # a row carries its coords once


def neighbours(index: DataFrame) -> DataFrame:
    return index.select(F.col("a").alias("id"), F.col("b").alias("next")).union(index.select("b", "a")).filter("id <> next").distinct()


def _hops(df: DataFrame, pos: str, *keep: str) -> DataFrame:
    pairs = F.arrays_zip(F.slice("hops", 1, F.size("hops") - 1).alias("x"), F.slice("hops", 2, F.size("hops") - 1).alias("y"))
    return df.filter("size(hops) > 1").select(*keep, F.posexplode(pairs).alias(pos, "h")).select(*keep, pos, F.col("h.x").alias("x"), F.col("h.y").alias("y"))


def path_geometry(paths: DataFrame, track: DataFrame, detours: DataFrame, points: DataFrame) -> DataFrame:
    """Coordinates of every hop of paths (from_id, to_id, hops): its track (a, b, coords), else the tracks of a detour
    (from_id, to_id, hops), else the straight line between its points (id, lat, lon); coords run along the hop."""
    key = ["from_id", "to_id"]
    lines = track.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), F.when(F.col("a") <= F.col("b"), F.col("coords")).otherwise(F.reverse("coords")).alias("c"))
    lines = lines.groupBy("p", "q").agg(F.max_by("c", F.struct(F.size("c"), "c")).alias("c"))  # the longest of several

    def along(hops):
        met = hops.join(lines, (F.least("x", "y") == F.col("p")) & (F.greatest("x", "y") == F.col("q")), "left")
        return met.withColumn("coords", F.when(F.col("x") <= F.col("y"), F.col("c")).otherwise(F.reverse("c"))).drop("p", "q", "c")

    met = along(_hops(paths, "pos", *key))
    direct = met.filter("coords is not null").withColumns({"part": F.lit(0), "how": F.lit("track")})
    rest = met.filter("coords is null").drop("coords").join(detours.select(F.col("from_id").alias("x"), F.col("to_id").alias("y"), "hops"), ["x", "y"], "left")
    around = along(_hops(rest.drop("x", "y"), "part", *key, "pos")).withColumn("how", F.lit("detour"))
    end = lambda n: points.select(F.col("id").cast("string").alias(n), F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).alias(f"at_{n}"))
    line = (rest.filter("hops is null").join(end("x"), "x").join(end("y"), "y")
            .withColumns({"coords": F.array("at_x", "at_y"), "part": F.lit(0), "how": F.lit("line")}))
    cols = [*key, "pos", "part", "x", "y", "how", "coords"]
    return direct.select(cols).union(around.select(cols)).union(line.select(cols))


def active_stops(stops: DataFrame, served: DataFrame) -> DataFrame:
    """Stops (operator, stop_id, parent_station, ordinal) that, or whose parent, is in served (operator, stop_id): the first one for each operator and station."""
    seen = served.select("operator", "stop_id").distinct()
    own = seen.withColumn("own", F.lit(True))
    up = seen.select("operator", F.col("stop_id").alias("parent_station"), F.lit(True).alias("up"))
    kept = stops.join(own, ["operator", "stop_id"], "left").join(up, ["operator", "parent_station"], "left").filter("own or up").drop("own", "up")
    station = F.concat_ws(":", "operator", F.coalesce("parent_station", "stop_id"))
    return best_by(kept.withColumn("station", station), "station", F.col("ordinal"), F.col("stop_id"))


def _star_round(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v): larger, then smaller neighbours are handed the least of a neighbourhood."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    down = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    passed = down.join(least, "u").filter("v <> m").select(F.col("v").alias("x"), "m")
    return passed.select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).union(least).distinct()


def components(edge: DataFrame, folder: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) by large-star and small-star steps; each round is written below folder, so lineage stays short.

    Raises if max_rounds do not reach the fixed point.
    """
    spark = edge.sparkSession
    ids = edge.select(F.col("a").alias("id")).union(edge.select("b")).dropna().distinct()
    now, state = edge.select(F.col("a").alias("u"), F.col("b").alias("v")).dropna().filter("u <> v").distinct(), None
    for turn in range(max_rounds):
        path = f"{folder}/stars-{turn}"
        now = _star_round(now)
        now.write.mode("overwrite").parquet(path)
        now = spark.read.schema(now.schema).parquet(path)
        seen = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return ids.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
