"""Building footprints cut into vector records for tiles of every zoom.

Records keep metres from the north-west corner of their source tile, y negative going south. A building's walls belong to
the one tile that holds its centroid; its roof is cut among all tiles that its box meets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tilelake.functions import geometry, ragged
from tilelake.functions import tilemath as tm

SOURCE_ZOOM = 14
EXTENT, BUFFER = tm.EXTENT, 64
FLOOR_M, DEFAULT_M = 3.5, 12.0


def building_height(height: Column, num_floors: Column) -> Column:
    return F.coalesce(height, F.when(num_floors != 0, num_floors * FLOOR_M), F.lit(DEFAULT_M))


@arrow_udf(T.BooleanType())
def polygon_meets_box(rings: pa.Array, w: pa.Array, s: pa.Array, e: pa.Array, n: pa.Array) -> pa.Array:
    """Whether polygons with holes meet boxes, touching included."""
    levels, x, y = ragged.read(rings)
    return pa.array(ragged.polygons_meet_boxes(*levels, x, y, *_numbers(w, s, e, n)))


def _numbers(*columns: pa.Array) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in columns]


def tiles_x_buildings(features: DataFrame, zoom: int = SOURCE_ZOOM) -> DataFrame:
    """Features once for each tile that they meet: z, x, y. A building meets few tiles, so its box is spread over them and
    the polygon decides; there is no join."""
    box = [F.col(f"bbox.{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    spread = features.withColumn("_t", F.explode(tm.tile_cover_bbox(*box, F.lit(zoom), 1e-9))).select("*", "_t.*").drop("_t")
    w, s, e, n = tm.tile_bounds_lonlat(F.col("z"), F.col("x"), F.col("y"))
    return spread.where(polygon_meets_box("rings", w, s, e, n))


#: Fixed schema of quantised rings: whole units, y growing south.
UNITS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])))


@arrow_udf(UNITS)
def quantized(rings: pa.Array, w: pa.Array, s: pa.Array, e: pa.Array, n: pa.Array) -> pa.Array:
    """Rings in degrees, clipped to a tile's box with its buffer, in whole units of the tile; y is linear in latitude."""
    (features, points), x, y = ragged.read(rings)
    of = ragged.owner(features)
    west, south, east, north = (v[of] for v in _numbers(w, s, e, n))
    bx, by = (east - west) * BUFFER / EXTENT, (north - south) * BUFFER / EXTENT
    points, x, y = ragged.clip(points, x, y, west - bx, south - by, east + bx, north + by)
    ring = ragged.owner(points)
    ux = np.rint((x - west[ring]) / (east - west)[ring] * EXTENT).astype(np.int32)
    uy = np.rint((north[ring] - y) / (north - south)[ring] * EXTENT).astype(np.int32)
    before = np.empty(len(ux), np.int64)
    before[ragged.following(points)] = np.arange(len(ux))
    new = (ux != ux[before]) | (uy != uy[before])
    points, ux, uy = ragged.kept(points, new), ux[new], uy[new]
    big = np.diff(points) >= 3
    stay = np.repeat(big, np.diff(points))
    return ragged.nested([ragged.kept(features, big), np.append(0, np.cumsum(np.diff(points)[big]))], ux[stay], uy[stay])


# not to be run once for the filter on the result and again for the result
quantized = quantized.asNondeterministic()


def mvt_quantize(features: DataFrame) -> DataFrame:
    """(z, x, y, id, height, num_floors, rings) of features on tiles; those with nothing left after the clip are dropped."""
    w, s, e, n = tm.tile_bounds_lonlat(F.col("z"), F.col("x"), F.col("y"))
    q = features.select("z", "x", "y", "id", "height", "num_floors", quantized("rings", w, s, e, n).alias("rings"))
    return q.where(F.size("rings") > 0)


POLYGONS = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))


@arrow_udf(POLYGONS)
def classified(rings: pa.Array) -> pa.Array:
    """Rings of a feature as polygons of an outer ring and its holes."""
    levels, x, y = ragged.read(rings)
    return ragged.nested(*ragged.polygons(*levels, x, y))


classified = classified.asNondeterministic()


def units_to_metres(rings: Column, z: Column) -> Column:
    """Units of a tile to metres from its corner, y going south negative."""
    unit = tm.side(z) / EXTENT
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((p["x"] * unit).alias("x"), (-(p["y"] * unit)).alias("y"))))


def building_record(polygons: Column) -> tuple[Column, Column]:
    """Centroid (the mean of all outer rings' vertices) and box, as structs."""
    outer = F.flatten(F.transform(polygons, lambda p: F.element_at(p, 1)))
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    box = F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
    return F.struct(mean(xs).alias("x"), mean(ys).alias("y")), box


def records(quantised: DataFrame) -> DataFrame:
    """(z, x, y, id, height, polygons, centroid, box) in metres."""
    p = quantised.withColumn("polygons", classified(units_to_metres(F.col("rings"), F.col("z")))).where(F.size("polygons") > 0)
    centroid, box = building_record(F.col("polygons"))
    return p.select("z", "x", "y", "id", building_height(F.col("height"), F.col("num_floors")).alias("height"), "polygons", centroid.alias("centroid"), box.alias("box"))


def tile_buildings_agg(quantised: DataFrame) -> DataFrame:
    """(z, x, y, n, features) by tile, features in order of id. Partial lists are made for 16 parts dealt by a hash of the id
    first, so a dense tile's lists come together in pieces."""
    part = F.struct("id", building_height(F.col("height"), F.col("num_floors")).alias("height"), "rings")
    small = quantised.withColumn("_q", F.pmod(F.xxhash64("id"), F.lit(16)))
    pieces = small.groupBy("z", "x", "y", "_q").agg(F.collect_list(part).alias("f"))
    whole = pieces.groupBy("z", "x", "y").agg(F.flatten(F.collect_list("f")).alias("f"))
    return whole.select("z", "x", "y", F.size("f").cast("long").alias("n"), F.array_sort("f", lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("features"))


def _target(zoom: int) -> tuple[Column, Column]:
    """Side of a target tile and the source's first target tile."""
    return F.lit(tm.SIDE / 2.0**zoom), F.pow(F.lit(2.0), F.lit(zoom) - F.col("z")).cast("int")


def wall_owner(rec: DataFrame, zoom: int) -> DataFrame:
    """records with the target tile (tz, tx, ty) that owns their walls: x in [0, side), y in (-side, 0] holds the centroid.
    Arithmetic only. A centroid outside the source tile belongs to a neighbour's record, so those rows are dropped."""
    span, n = _target(zoom)
    i, j = F.floor(F.col("centroid.x") / span).cast("int"), F.floor(-F.col("centroid.y") / span).cast("int")
    at = rec.withColumns({"tz": F.lit(zoom), "tx": F.col("x") * n + i, "ty": F.col("y") * n + j, "_in": (i >= 0) & (i < n) & (j >= 0) & (j < n)})
    return at.where("_in").drop("_in")


def roof_overlap(rec: DataFrame, zoom: int) -> DataFrame:
    """records once for each target tile (tz, tx, ty) of their source tile that their box meets, edges included."""
    span, n = _target(zoom)
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), n - 1).cast("int")
    closed_lo = lambda v: F.ceil(v / span) - 1  # noqa: E731  a box that starts on an edge meets the tile before it too
    x0, x1 = closed_lo(F.col("box.xmin")), F.floor(F.col("box.xmax") / span)
    y0, y1 = closed_lo(-F.col("box.ymax")), F.floor(-F.col("box.ymin") / span)
    some = rec.where((x1 >= 0) & (x0 <= n - 1) & (y1 >= 0) & (y0 <= n - 1))
    cells = F.flatten(F.transform(F.sequence(clamp(x0), clamp(x1)), lambda i: F.transform(F.sequence(clamp(y0), clamp(y1)), lambda j: F.struct((F.col("x") * n + i).alias("tx"), (F.col("y") * n + j).alias("ty")))))
    return some.select("*", F.lit(zoom).alias("tz"), F.explode(cells).alias("_c")).select("*", "_c.tx", "_c.ty").drop("_c")


@arrow_udf(POLYGONS)
def clipped(polygons: pa.Array, w: pa.Array, s: pa.Array, e: pa.Array, n: pa.Array) -> pa.Array:
    """Polygons clipped to boxes: a polygon whose outer ring vanishes goes, and so do vanished holes."""
    (features, of_polygon, points), x, y = ragged.read(polygons)
    feature = ragged.owner(features)[ragged.owner(of_polygon)]  # of each ring
    points, x, y = ragged.clip(points, x, y, *(v[feature] for v in _numbers(w, s, e, n)))
    left = np.append(np.diff(points) > 0, False)
    whole = left[of_polygon[:-1]] & (np.diff(of_polygon) > 0)
    stay = left[:-1] & np.repeat(whole, np.diff(of_polygon))
    spots = np.repeat(stay, np.diff(points))
    rings = ragged.kept(of_polygon, stay)
    return ragged.nested([ragged.kept(features, whole), np.append(0, np.cumsum(np.diff(rings)[whole])), np.append(0, np.cumsum(np.diff(points)[stay]))], x[spots], y[spots])


clipped = clipped.asNondeterministic()


def roof_parts(rec: DataFrame, zoom: int) -> DataFrame:
    """(tz, tx, ty, id, polygons): each roof's part on every target tile that it meets, in source metres."""
    span, n = _target(zoom)
    over = roof_overlap(rec, zoom)
    w, north = (F.col("tx") - F.col("x") * n) * span, -(F.col("ty") - F.col("y") * n) * span
    cut = over.select("z", "x", "y", "tz", "tx", "ty", "id", clipped("polygons", w, north - span, w + span, north).alias("polygons"))
    return cut.where(F.size("polygons") > 0)


def wall_segments(rec: DataFrame) -> DataFrame:
    """(z, x, y, id, k, x1, y1, x2, y2, nx, ny): edges of all rings with outward normals. Edges on a line where the source
    was cut, and those shorter than 1e-4, aren't walls."""
    span = tm.side(F.col("z"))
    pad, eps = span * (BUFFER / EXTENT), span / EXTENT * 0.1
    rings = F.flatten(F.col("polygons"))
    edges = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p, i: F.struct(p.alias("a"), geometry.following(r, i).alias("b")))))
    e = rec.select("z", "x", "y", "id", F.posexplode(edges).alias("k", "e")).select("z", "x", "y", "id", "k", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    near = lambda a, b, line: (F.abs(a - line) < eps) & (F.abs(b - line) < eps)
    cut = near(F.col("x1"), F.col("x2"), -pad) | near(F.col("x1"), F.col("x2"), span + pad) | near(F.col("y1"), F.col("y2"), pad) | near(F.col("y1"), F.col("y2"), -span - pad)
    e = e.withColumn("len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).where(~cut & (F.col("len") >= 1e-4))
    return e.select("z", "x", "y", "id", "k", "x1", "y1", "x2", "y2", ((F.col("y2") - F.col("y1")) / F.col("len")).alias("nx"), ((F.col("x1") - F.col("x2")) / F.col("len")).alias("ny"))


def seat(owned: DataFrame, grids: DataFrame) -> DataFrame:
    """(tz, tx, ty, id, base, top) of owned records on ground grids (z, x, y, grid, zs: world heights): the base is the
    ground at the centroid, kept inside the tile; the top is the height in Mercator metres above. No grid: 0 ground."""
    from tilelake.functions.raster import ground_at

    span = tm.side(F.col("tz"))
    n = F.pow(F.lit(2.0), F.col("tz") - F.col("z")).cast("int")
    clamp = lambda t: F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    u = clamp(F.col("centroid.x") / span - (F.col("tx") - F.col("x") * n))
    v = clamp(-F.col("centroid.y") / span - (F.col("ty") - F.col("y") * n))
    _, lat = tm.merc_to_lonlat(F.lit(0.0), F.lit(tm.HALF) - (F.col("ty") + 0.5) * span)
    g = grids.select(F.col("z").alias("tz"), F.col("x").alias("tx"), F.col("y").alias("ty"), "grid", "zs")
    at = owned.withColumns({"u": u, "v": v, "up": F.col("height") * tm.merc_scale(lat)}).join(g, ["tz", "tx", "ty"], "left")
    base = F.coalesce(F.when(F.col("zs").isNotNull(), ground_at(F.col("zs"), F.col("grid"), F.col("u"), F.col("v"))), F.lit(0.0))
    return at.select("tz", "tx", "ty", "id", base.alias("base"), (base + F.col("up")).alias("top"))


def cost_matrix(rec: DataFrame) -> DataFrame:
    """(z, x, y, records, vertices, area_p50, area_p90, under_50, under_100, under_200) of each tile; areas are those of
    boxes, quantiles are members of the sorted list."""
    area = F.abs((F.col("box.xmax") - F.col("box.xmin")) * (F.col("box.ymax") - F.col("box.ymin")))
    vertices = F.aggregate(F.flatten("polygons"), F.lit(0).cast("long"), lambda a, r: a + F.size(r))
    g = rec.withColumns({"area": area, "n": vertices}).groupBy("z", "x", "y").agg(F.count("*").alias("records"), F.sum("n").alias("vertices"), F.sort_array(F.collect_list("area")).alias("areas"))
    at = lambda q: F.element_at("areas", F.least(F.col("records") - 1, F.floor(F.col("records") * q)).cast("int") + 1)
    under = lambda t: F.size(F.filter("areas", lambda a: a < t)).cast("long")
    return g.select("z", "x", "y", "records", "vertices", at(0.5).alias("area_p50"), at(0.9).alias("area_p90"), *[under(t).alias(f"under_{t}") for t in (50, 100, 200)])


def child_share(rec: DataFrame, zoom: int = 18) -> DataFrame:
    """(tz, tx, ty, roofs, walls, share): how much of its source's records a target tile uses."""
    per = rec.groupBy("z", "x", "y").agg(F.count("*").alias("records"))
    keys = ["z", "x", "y", "tz", "tx", "ty"]
    roofs = roof_overlap(rec, zoom).groupBy(*keys).agg(F.count("*").alias("roofs"))
    walls = wall_owner(rec, zoom).groupBy(*keys).agg(F.count("*").alias("walls"))
    both = roofs.join(walls, keys, "left").join(per, ["z", "x", "y"])
    return both.select("tz", "tx", "ty", "roofs", F.coalesce("walls", F.lit(0)).cast("long").alias("walls"), (F.col("roofs") / F.col("records")).alias("share"))


def settled(status: Column, n: Column) -> Column:
    """What is kept of an answer: records or an empty tile are recorded, a failure is asked again."""
    return F.when(status >= 500, "failed").when((status == 404) | (n == 0), "empty").otherwise("records")
