"""Queries on buildings. Clipped and quantised rings are held against closed forms in tests; SQL covers the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.functions import geometry
from tilelake.functions import tilemath as tm
from tilelake.operators import buildings as b
from tilelake.operators import imagery, raster
from tilelake.plans import sql
from tilelake.plans.q_tiles import tiles
from tilelake.sources import catalogs, fixtures, scratch


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.buildings(spark, sf_dir)


def _on_tiles(spark, sf_dir) -> DataFrame:
    return b.tiles_x_buildings(features(spark, sf_dir))


def _records(spark, sf_dir) -> DataFrame:
    """Records from unclipped rings, on the z14 tile of their centre: plain arithmetic, as the SQL has it."""
    f = fixtures.table(spark, sf_dir, "fx_buildings").withColumn("rings", fixtures.building_rings())
    x, y = tm.tile_of_point(*tm.lonlat_to_merc(F.col("cx"), F.col("cy")), F.lit(14))
    f = f.withColumns({"z": F.lit(14), "x": x, "y": y})
    side = tm.side(F.col("z"))
    merc = lambda p: tm.lonlat_to_merc(p["x"], p["y"])
    local = lambda p: F.struct((merc(p)[0] + tm.HALF - F.col("x") * side).alias("x"), (merc(p)[1] - tm.HALF + F.col("y") * side).alias("y"))
    f = f.withColumn("polygons", F.array(F.transform("rings", lambda r: F.transform(r, local))))
    centroid, box = b.building_record(F.col("polygons"))
    return f.select("z", "x", "y", "id", b.building_height(F.col("height"), F.col("num_floors")).alias("height"), "polygons", centroid.alias("centroid"), box.alias("box"))


def building_height(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "fx_buildings").select("id", b.building_height(F.col("height"), F.col("num_floors")).alias("height"))


def ring_area(spark, sf_dir):
    return features(spark, sf_dir).select("id", F.posexplode("rings").alias("k", "r")).select("id", "k", F.round(geometry.ring_area(F.col("r")) * 1e6, 6).alias("area2"))


def classify_rings(spark, sf_dir):
    p = features(spark, sf_dir).select("id", b.classified("rings").alias("p"))
    return p.select("id", F.size("p").cast("long").alias("polygons"), F.size(F.flatten("p")).cast("long").alias("rings"))


def units_to_metres(spark, sf_dir):
    q = b.mvt_quantize(_on_tiles(spark, sf_dir))
    return q.select("z", "x", "y", "id", F.round(F.array_max(F.transform(F.element_at(b.units_to_metres(F.col("rings"), F.col("z")), 1), lambda p: p["x"])), 6).alias("xmax"))


def building_record(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("id", "x", "y", "height", *[F.round(c, 2).alias(n) for c, n in ((F.col("centroid.x"), "cx"), (F.col("centroid.y"), "cy"), (F.col("box.xmin"), "xmin"), (F.col("box.ymax"), "ymax"))])


def tiles_x_buildings(spark, sf_dir):
    return _on_tiles(spark, sf_dir).select("z", "x", "y", "id")


def intersects_polygon(spark, sf_dir):
    """Buildings against one constant box; the box conditions on the nested struct come first."""
    f = features(spark, sf_dir)
    w, s, e, n = -74.19, 40.66, -74.15, 40.70
    near = f.where((F.col("bbox.xmin") <= e) & (F.col("bbox.xmax") >= w) & (F.col("bbox.ymin") <= n) & (F.col("bbox.ymax") >= s))
    return near.where(b.polygon_meets_box("rings", *[F.lit(v) for v in (w, s, e, n)])).select("id")


def mvt_quantize(spark, sf_dir):
    q = b.mvt_quantize(_on_tiles(spark, sf_dir))
    return q.select("z", "x", "y", "id", F.posexplode("rings").alias("k", "r")).select("z", "x", "y", "id", "k", F.size("r").alias("points"))


def clip_ring(spark, sf_dir):
    """Rectangles cut by their tile: areas of the parts, which add up to the whole."""
    r = _records(spark, sf_dir)
    parts = b.roof_parts(r, 16)
    area = F.aggregate(F.flatten("polygons"), F.lit(0.0), lambda a, ring: a + geometry.ring_area(ring))
    return parts.select("tz", "tx", "ty", "id", F.round(F.abs(area) / 2, 1).alias("area"))


def wall_owner_join(spark, sf_dir):
    return b.wall_owner(_records(spark, sf_dir), 18).select("id", "tz", "tx", "ty")


def roof_overlap_join(spark, sf_dir):
    return b.roof_overlap(_records(spark, sf_dir), 18).select("id", "tz", "tx", "ty")


def roof_parts(spark, sf_dir):
    return b.roof_parts(_records(spark, sf_dir), 18).select("id", "tz", "tx", "ty", F.size("polygons").cast("long").alias("polygons"))


def wall_segments(spark, sf_dir):
    w = b.wall_segments(_records(spark, sf_dir))
    return w.select("id", "k", *[F.round(c, 2).alias(c) for c in ("x1", "y1", "x2", "y2")], F.round("nx", 4).alias("nx"), F.round("ny", 4).alias("ny"))


def building_cost_matrix(spark, sf_dir):
    m = b.cost_matrix(_records(spark, sf_dir))
    return m.withColumns({c: F.round(c, 1) for c in ("area_p50", "area_p90")})


def child_share(spark, sf_dir):
    return b.child_share(_records(spark, sf_dir)).withColumn("share", F.round("share", 6))


def tile_buildings_agg(spark, sf_dir):
    agg = b.tile_buildings_agg(b.mvt_quantize(_on_tiles(spark, sf_dir)))
    return agg.select("z", "x", "y", "n", F.array_join(F.transform("features", lambda f: f["id"]), ",").alias("ids"))


def seat_building(spark, sf_dir):
    owned = b.wall_owner(_records(spark, sf_dir), 15)
    grids = raster.surface_grid(_ground(spark, sf_dir, owned), step=2).select("z", "x", "y", "grid", "zs")
    return b.seat(owned, grids).select("id", "tz", "tx", "ty", F.round("base", 4).alias("base"), F.round("top", 4).alias("top"))


def _ground(spark, sf_dir, owned: DataFrame) -> DataFrame:
    """A raster for each target tile: the one whose number its place gives, of all there are."""
    r = fixtures.rasters(spark, sf_dir).select("rank", "size", F.transform("pixels", lambda p: F.when(p != -999999.0, p)).alias("pixels"))
    n = max(1, r.count())
    t = owned.select(F.col("tz").alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y")).distinct().withColumn("rank", ((F.col("x") * 31 + F.col("y")) % n).cast("long"))
    return t.join(r, "rank")


def building_settled(spark, sf_dir):
    r = fixtures.table(spark, sf_dir, "fx_requests")
    return r.select("event_id", b.settled(F.col("http_status"), F.col("event_id") % 4).alias("state"))


def manifest_prune(spark, sf_dir):
    """Files of buildings by box; tiles that ask are those of the points."""
    return catalogs.manifest_prune(imagery.with_box(_asking(spark, sf_dir)), _manifest(spark, sf_dir), "s3://")


def tiles_x_manifest(spark, sf_dir):
    """How many tiles ask for each file."""
    t, m = imagery.with_box(_asking(spark, sf_dir)), _manifest(spark, sf_dir)
    return catalogs.tiles_x_manifest(t, m).groupBy("file").agg(F.count("*").alias("tiles"))


def _asking(spark, sf_dir) -> DataFrame:
    """z14 tiles around the buildings' own."""
    return _records(spark, sf_dir).select("z", "x", "y").distinct()


def _manifest(spark, sf_dir) -> DataFrame:
    """A file for each fiftieth of the buildings, with its box."""
    f = features(spark, sf_dir)
    return f.groupBy(F.concat(F.lit("lake/part-"), (F.col("id").cast("long") % 50).cast("string")).alias("file")).agg(
        F.min("bbox.xmin").alias("bbox_xmin"), F.max("bbox.xmax").alias("bbox_xmax"), F.min("bbox.ymin").alias("bbox_ymin"), F.max("bbox.ymax").alias("bbox_ymax")
    )


def _lake(spark, sf_dir) -> DataFrame:
    """Features written as a lake of folders; the manifest of its folders' boxes."""
    path = scratch.new_folder(spark, "lake")
    part = features(spark, sf_dir).withColumn("part", (F.col("id").cast("long") % 50).cast("int"))
    part.select("id", "height", "num_floors", "rings", "bbox", "part").write.partitionBy("part").parquet(path)
    box = [F.min("bbox.xmin").alias("bbox_xmin"), F.max("bbox.xmax").alias("bbox_xmax"), F.min("bbox.ymin").alias("bbox_ymin"), F.max("bbox.ymax").alias("bbox_ymax")]
    return part.groupBy(F.concat(F.lit(f"{path}/part="), F.col("part").cast("string")).alias("file")).agg(*box)


def read_buildings(spark, sf_dir):
    """Features of a box: files found by their manifest, read within the box."""
    box = (-74.19, 40.66, -74.15, 40.70)
    asked = spark.createDataFrame([box], "w double, s double, e double, n double")
    files = [r.file for r in catalogs.manifest_prune(asked, _lake(spark, sf_dir)).collect()]
    return catalogs.read_buildings(spark, files, box).select("id")


def job_bake_buildings(spark, sf_dir):
    """Asked tiles → manifest → files → features → tiles → clip and quantise → payload of each asked tile. The names of
    files come to the driver, as for any read."""
    asked = scratch.written(imagery.with_box(_asking(spark, sf_dir)), "asked")
    files = [r.file for r in catalogs.manifest_prune(asked, _lake(spark, sf_dir)).collect()]
    box = asked.agg(F.min("w"), F.min("s"), F.max("e"), F.max("n")).first()
    on_tiles = b.tiles_x_buildings(catalogs.read_buildings(spark, files, tuple(box))).join(asked.select("z", "x", "y"), ["z", "x", "y"], "left_semi")
    agg = b.tile_buildings_agg(b.mvt_quantize(on_tiles))
    points = F.aggregate(F.flatten(F.transform("features", lambda f: f["rings"])), F.lit(0).cast("long"), lambda a, r: a + F.size(r))
    return agg.select("z", "x", "y", "n", points.alias("points"))


def job_building_pyramid(spark, sf_dir):
    """Records of z14 → walls and roofs of z15 to z18."""
    rec = scratch.written(_records(spark, sf_dir), "records")
    out = None
    for zoom in (15, 16, 17, 18):
        walls = b.wall_owner(rec, zoom).groupBy("tz", "tx", "ty").agg(F.count("*").alias("walls"))
        roofs = b.roof_overlap(rec, zoom).groupBy("tz", "tx", "ty").agg(F.count("*").alias("roofs"))
        both = roofs.join(walls, ["tz", "tx", "ty"], "left").select("tz", "tx", "ty", "roofs", F.coalesce("walls", F.lit(0)).cast("long").alias("walls"))
        out = both if out is None else out.unionByName(both)
    return out


_H = "coalesce(height, CASE WHEN num_floors <> 0 THEN num_floors * 3.5e0 END, 12e0)"
_PTS = """SELECT id, ring, k, dx, dy FROM (VALUES
  ('rect', 0, 0, -1, -1), ('rect', 0, 1, 1, -1), ('rect', 0, 2, 1, 1), ('rect', 0, 3, -1, 1),
  ('L', 0, 0, -1, -1), ('L', 0, 1, 1, -1), ('L', 0, 2, 1, 0), ('L', 0, 3, 0, 0), ('L', 0, 4, 0, 1), ('L', 0, 5, -1, 1),
  ('donut', 0, 0, -1, -1), ('donut', 0, 1, 1, -1), ('donut', 0, 2, 1, 1), ('donut', 0, 3, -1, 1),
  ('donut', 1, 0, -0.5e0, -0.5e0), ('donut', 1, 1, -0.5e0, 0.5e0), ('donut', 1, 2, 0.5e0, 0.5e0), ('donut', 1, 3, 0.5e0, -0.5e0)) s(id, ring, k, dx, dy)"""
_S14 = sql.side("14")
_PT = f"""SELECT b.id, ring, k, tx, ty, {sql.mx('cx + hw * dx')} + {sql.HALF_} - tx * {_S14} AS px, {sql.my('cy + hh * dy')} - {sql.HALF_} + ty * {_S14} AS py,
  cx + hw * dx AS lon, cy + hh * dy AS lat FROM (SELECT *, {sql.tx(sql.mx('cx'), '14')} AS tx, {sql.ty(sql.my('cy'), '14')} AS ty FROM fx_buildings) b JOIN shapes s ON s.id = b.shape"""
_REC = "SELECT id, tx AS x, ty AS y, avg(px) AS cx, avg(py) AS cy, min(px) AS xmin, max(px) AS xmax, min(py) AS ymin, max(py) AS ymax FROM pt WHERE ring = 0 GROUP BY id, tx, ty"
_B = sql.with_("fx_buildings", shapes=_PTS, pt=_PT, rec=_REC)
_EDGE = """SELECT *, coalesce(lead(px) OVER w, first_value(px) OVER w) AS qx, coalesce(lead(py) OVER w, first_value(py) OVER w) AS qy,
  coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS lat2,
  row_number() OVER (PARTITION BY id ORDER BY ring, k) - 1 AS e FROM pt WINDOW w AS (PARTITION BY id, ring ORDER BY k)"""


def _span(zoom: int) -> str:
    return f"({sql.side(str(zoom))})"


def _wall(zoom: int) -> str:
    n, s = 2 ** (zoom - 14), _span(zoom)
    return f"SELECT id, {zoom} AS tz, CAST(x * {n} + floor(cx / {s}) AS INT) AS tx, CAST(y * {n} + floor(-cy / {s}) AS INT) AS ty FROM rec WHERE floor(cx / {s}) BETWEEN 0 AND {n - 1} AND floor(-cy / {s}) BETWEEN 0 AND {n - 1}"


def _roof(zoom: int) -> str:
    n, s = 2 ** (zoom - 14), _span(zoom)
    grid = f"(SELECT unnest(range(0, {n})) AS i) a, (SELECT unnest(range(0, {n})) AS j) c"
    return f"SELECT id, {zoom} AS tz, CAST(x * {n} + i AS INT) AS tx, CAST(y * {n} + j AS INT) AS ty FROM rec, {grid} WHERE xmax >= i * {s} AND xmin <= (i + 1) * {s} AND ymax >= -(j + 1) * {s} AND ymin <= -j * {s}"


#: Owned records with their place in the tile, and the height of the nearest of its 5 × 5 vertices, every second pixel.
_in = lambda v: f"least(greatest({v}, 0), 1)"
_UV = f"SELECT o.*, {_in(f'r.cx / {_span(15)} - (o.tx - r.x * 2)')} AS u, {_in(f'-r.cy / {_span(15)} - (o.ty - r.y * 2)')} AS v FROM own o JOIN rec r ON r.id = o.id AND r.x = o.tx // 2 AND r.y = o.ty // 2"
_up = f"(({sql.HALF_} - (ty + 0.5e0) * {_span(15)}) / {sql.R_})"
_GROUND = f"""SELECT u.id, tz, tx, ty, coalesce(nullif(pixels[CAST(least(floor(v * 4 + 0.5e0) * 2, 7) * 8 + least(floor(u * 4 + 0.5e0) * 2, 7) AS INT) + 1], -999999e0), 0) * (exp({_up}) + exp(-{_up})) / 2 AS base
  FROM uv u JOIN fx_rasters f ON f.rank = (tx * 31 + ty) % (SELECT count(*) FROM fx_rasters)"""
_pyr = " UNION ALL ".join(f"SELECT r.tz, r.tx, r.ty, count(*) AS roofs, coalesce(any_value(w.n), 0) AS walls FROM ({_roof(z)}) r LEFT JOIN (SELECT tx, ty, count(*) AS n FROM ({_wall(z)}) q GROUP BY tx, ty) w ON w.tx = r.tx AND w.ty = r.ty GROUP BY r.tz, r.tx, r.ty" for z in (15, 16, 17, 18))
_pad, _eps = f"({_S14} * 64 / 4096)", f"({_S14} / 4096 * 0.1e0)"
_on = lambda a, b_, line: f"(abs({a} - ({line})) < {_eps} AND abs({b_} - ({line})) < {_eps})"
_CUT = " OR ".join([_on("px", "qx", f"-{_pad}"), _on("px", "qx", f"{_S14} + {_pad}"), _on("py", "qy", _pad), _on("py", "qy", f"-{_S14} - {_pad}")])
_q = lambda q: f"list_sort(list(a))[CAST(least(count(*) - 1, floor(count(*) * {q})) AS INT) + 1]"
_bx = sql.box("14", "x", "y")
_MAN = "SELECT 'lake/part-' || (CAST(id AS BIGINT) % 50) AS file, min(cx - hw) AS x0, max(cx + hw) AS x1, min(cy - hh) AS y0, max(cy + hh) AS y1 FROM fx_buildings GROUP BY 1"
_ASK = f"SELECT DISTINCT x, y, {_bx[0]} AS w, {_bx[1]} AS s, {_bx[2]} AS e, {_bx[3]} AS n FROM rec"
_M = sql.with_("fx_buildings", shapes=_PTS, pt=_PT, rec=_REC, man=_MAN, ask=_ASK)
#: The shapes against a box (w, s, e, n): an L is two rectangles, a donut meets no box inside its hole.
_rect = lambda x0, y0, x1, y1: f"(cx + hw * ({x0}) <= e AND cx + hw * ({x1}) >= w AND cy + hh * ({y0}) <= n AND cy + hh * ({y1}) >= s)"
_HOLE = "(w > cx - hw * 0.5e0 AND e < cx + hw * 0.5e0 AND s > cy - hh * 0.5e0 AND n < cy + hh * 0.5e0)"
_MEETS = f"CASE shape WHEN 'L' THEN {_rect(-1, -1, 1, 0)} OR {_rect(-1, 0, 0, 1)} WHEN 'donut' THEN {_rect(-1, -1, 1, 1)} AND NOT {_HOLE} ELSE {_rect(-1, -1, 1, 1)} END"
_SPREAD = f"""SELECT *, unnest(range({sql.ty(sql.my('cy + hh'), '14')} - 1, {sql.ty(sql.my('cy - hh'), '14')} + 2))::INT AS y FROM (
  SELECT *, unnest(range({sql.tx(sql.mx('cx - hw'), '14')} - 1, {sql.tx(sql.mx('cx + hw'), '14')} + 2))::INT AS x FROM fx_buildings) a"""



def _cut(src: str, keys: str) -> dict[str, str]:
    """Named queries that clip the rings (keys, ring, k, px, py) of ``src`` to their boxes (bw, bs, be, bn), a side after the
    other, by rows; the last is c4."""
    out, own = {}, f"{keys}, ring, bw, bs, be, bn"
    for i, (p, q, line, sign) in enumerate((("px", "qx", "bw", ""), ("px", "qx", "be", "-"), ("py", "qy", "bs", ""), ("py", "qy", "bn", "-"))):
        out[f"n{i}"] = f"SELECT *, {sign}({p} - {line}) AS d, {sign}({q} - {line}) AS d2 FROM (SELECT *, coalesce(lead(px) OVER o, first_value(px) OVER o) AS qx, coalesce(lead(py) OVER o, first_value(py) OVER o) AS qy, count(*) OVER (PARTITION BY {keys}, ring) AS points FROM {src} WINDOW o AS (PARTITION BY {keys}, ring ORDER BY k)) t WHERE points >= 3"
        x, y = (f"CASE WHEN '{p}' = '{c}' THEN {line} ELSE {c} + ({c.replace('p', 'q')} - {c}) * (d / (d - d2)) END" for c in ("px", "py"))
        out[f"c{i + 1}"] = f"SELECT {own}, 2 * k AS k, px, py FROM n{i} WHERE d >= 0 UNION ALL SELECT {own}, 2 * k + 1, {x}, {y} FROM n{i} WHERE (d >= 0) <> (d2 >= 0)"
        src = f"c{i + 1}"
    return out


_LL = f"SELECT 14 AS z, b.x, b.y, b.id, ring, k, cx + hw * dx AS px, cy + hh * dy AS py, w, s, e, n, w - (e - w) * 64 / 4096 AS bw, s - (n - s) * 64 / 4096 AS bs, e + (e - w) * 64 / 4096 AS be, n + (n - s) * 64 / 4096 AS bn FROM met b JOIN shapes sh ON sh.id = b.shape"
_UNIT = "SELECT z, x, y, id, ring, k, CAST(round_even((px - w) / (e - w) * 4096, 0) AS INT) AS ux, CAST(round_even((n - py) / (n - s) * 4096, 0) AS INT) AS uy FROM c4"
_KEEP = "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY z, x, y, id, ring) AS points FROM (SELECT *, coalesce(lag(ux) OVER o, last_value(ux) OVER f) AS lx, coalesce(lag(uy) OVER o, last_value(uy) OVER f) AS ly FROM unit WINDOW o AS (PARTITION BY z, x, y, id, ring ORDER BY k), f AS (PARTITION BY z, x, y, id, ring ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) t WHERE ux <> lx OR uy <> ly) t WHERE points >= 3"
_RINGS = "SELECT z, x, y, id, CAST(row_number() OVER (PARTITION BY z, x, y, id ORDER BY ring) - 1 AS INT) AS k, CAST(count(*) AS INT) AS points, max(ux) AS ux FROM keep GROUP BY z, x, y, id, ring"
_MVT = sql.with_("fx_buildings", shapes=_PTS, spread=_SPREAD, met=f"SELECT * FROM (SELECT *, {_bx[0]} AS w, {_bx[1]} AS s, {_bx[2]} AS e, {_bx[3]} AS n FROM spread) t WHERE {_MEETS}", ll=_LL, **_cut("ll", "z, x, y, id, w, s, e, n"), unit=_UNIT, keep=_KEEP, rings=_RINGS)


def _parts(zoom: int) -> str:
    """WITH clause up to c4: the rings of records clipped to the target tiles that their boxes meet."""
    s = _span(zoom)
    at = f"SELECT p.id, r.tz, r.tx, r.ty, p.ring, p.k, p.px, p.py, (r.tx - p.tx * {2 ** (zoom - 14)}) * {s} AS bw, -(r.ty - p.ty * {2 ** (zoom - 14)}) * {s} - {s} AS bs, (r.tx - p.tx * {2 ** (zoom - 14)}) * {s} + {s} AS be, -(r.ty - p.ty * {2 ** (zoom - 14)}) * {s} AS bn FROM ({_roof(zoom)}) r JOIN pt p ON p.id = r.id AND p.tx = r.tx // {2 ** (zoom - 14)} AND p.ty = r.ty // {2 ** (zoom - 14)}"
    area = "SELECT tz, tx, ty, id, ring, sum(px * qy - qx * py) AS a FROM (SELECT *, coalesce(lead(px) OVER o, first_value(px) OVER o) AS qx, coalesce(lead(py) OVER o, first_value(py) OVER o) AS qy, count(*) OVER (PARTITION BY tz, tx, ty, id, ring) AS points FROM c4 WINDOW o AS (PARTITION BY tz, tx, ty, id, ring ORDER BY k)) t WHERE points >= 3 GROUP BY tz, tx, ty, id, ring"
    return sql.with_("fx_buildings", shapes=_PTS, pt=_PT, rec=_REC, cut=at, **_cut("cut", "tz, tx, ty, id"), area=area)


QUERIES = {
    "building_height": (building_height, sql.with_("fx_buildings") + f"SELECT id, {_H} AS height FROM fx_buildings"),
    "ring_area": (ring_area, sql.with_("fx_buildings", shapes=_PTS, pt=_PT, edge=_EDGE) + "SELECT id, CAST(ring AS INT) AS k, round(sum(lon * lat2 - lon2 * lat) * 1e6, 6) AS area2 FROM edge GROUP BY id, ring"),
    "classify_rings": (classify_rings, sql.with_("fx_buildings") + "SELECT id, 1 AS polygons, CASE WHEN shape = 'donut' THEN 2 ELSE 1 END AS rings FROM fx_buildings"),
    "units_to_metres": (units_to_metres, _MVT + f"SELECT z, x, y, id, round(ux * ({_S14} / 4096), 6) AS xmax FROM rings WHERE k = 0"),
    "building_record": (building_record, _B + f"SELECT r.id, x, y, {_H} AS height, round(r.cx, 2) AS cx, round(r.cy, 2) AS cy, round(xmin, 2) AS xmin, round(ymax, 2) AS ymax FROM rec r JOIN fx_buildings b USING (id)"),
    "tiles_x_buildings": (tiles_x_buildings, sql.with_("fx_buildings", spread=_SPREAD, boxed=f"SELECT *, {_bx[0]} AS w, {_bx[1]} AS s, {_bx[2]} AS e, {_bx[3]} AS n FROM spread") + f"SELECT 14 AS z, x, y, id FROM boxed WHERE {_MEETS}"),
    "intersects_polygon": (intersects_polygon, sql.with_("fx_buildings", boxed="SELECT *, -74.19e0 AS w, 40.66e0 AS s, -74.15e0 AS e, 40.70e0 AS n FROM fx_buildings") + f"SELECT id FROM boxed WHERE {_MEETS}"),
    "mvt_quantize": (mvt_quantize, _MVT + "SELECT z, x, y, id, k, points FROM rings"),
    "clip_ring": (clip_ring, _parts(16) + "SELECT tz, tx, ty, id, round(abs(sum(a)) / 2, 1) AS area FROM area GROUP BY tz, tx, ty, id HAVING min(ring) = 0"),
    "wall_owner_join": (wall_owner_join, _B + _wall(18)),
    "roof_overlap_join": (roof_overlap_join, _B + _roof(18)),
    "roof_parts": (roof_parts, _parts(18) + "SELECT DISTINCT tz, tx, ty, id, 1 AS polygons FROM area WHERE ring = 0"),
    "wall_segments": (
        wall_segments,
        sql.with_("fx_buildings", shapes=_PTS, pt=_PT, edge=_EDGE)
        + f"SELECT id, CAST(e AS INT) AS k, round(px, 2) AS x1, round(py, 2) AS y1, round(qx, 2) AS x2, round(qy, 2) AS y2, round((qy - py) / sqrt((qx - px) ** 2 + (qy - py) ** 2), 4) AS nx, round((px - qx) / sqrt((qx - px) ** 2 + (qy - py) ** 2), 4) AS ny FROM edge WHERE NOT ({_CUT}) AND sqrt((qx - px) ** 2 + (qy - py) ** 2) >= 1e-4",
    ),
    "building_cost_matrix": (
        building_cost_matrix,
        _B + f"SELECT 14 AS z, x, y, count(*) AS records, CAST(sum(v) AS BIGINT) AS vertices, round({_q('0.5e0')}, 1) AS area_p50, round({_q('0.9e0')}, 1) AS area_p90, count(*) FILTER (a < 50) AS under_50, count(*) FILTER (a < 100) AS under_100, count(*) FILTER (a < 200) AS under_200 FROM (SELECT r.x, r.y, abs((xmax - xmin) * (ymax - ymin)) AS a, (SELECT count(*) FROM pt WHERE pt.id = r.id) AS v FROM rec r) t GROUP BY x, y",
    ),
    "child_share": (
        child_share,
        _B + f"SELECT tz, tx, ty, roofs, walls, round(roofs / n::DOUBLE, 6) AS share FROM (SELECT r.tz, r.tx, r.ty, count(*) AS roofs, coalesce(any_value(w.n), 0) AS walls FROM ({_roof(18)}) r LEFT JOIN (SELECT tx, ty, count(*) AS n FROM ({_wall(18)}) q GROUP BY tx, ty) w ON w.tx = r.tx AND w.ty = r.ty GROUP BY r.tz, r.tx, r.ty) t JOIN (SELECT x, y, count(*) AS n FROM rec GROUP BY x, y) p ON p.x = tx // 16 AND p.y = ty // 16",
    ),
    "tile_buildings_agg": (tile_buildings_agg, _MVT + "SELECT z, x, y, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM rings WHERE k = 0 GROUP BY z, x, y"),
    "seat_building": (
        seat_building,
        sql.with_("fx_buildings", "fx_rasters", shapes=_PTS, pt=_PT, rec=_REC, own=_wall(15), uv=_UV, ground=_GROUND)
        + f"SELECT g.id, tz, tx, ty, round(base, 4) AS base, round(base + {_H} / cos(radians({sql.lat(f'{sql.HALF_} - (ty + 0.5e0) * ' + _span(15))})), 4) AS top FROM ground g JOIN fx_buildings b ON b.id = g.id",
    ),
    "building_settled": (building_settled, sql.with_("fx_requests") + "SELECT event_id, CASE WHEN http_status >= 500 THEN 'failed' WHEN http_status = 404 OR event_id % 4 = 0 THEN 'empty' ELSE 'records' END AS state FROM fx_requests"),
    "manifest_prune": (manifest_prune, _M + "SELECT DISTINCT 's3://' || file AS file FROM ask JOIN man ON NOT (x1 < w OR x0 > e OR y1 < s OR y0 > n)"),
    "tiles_x_manifest": (tiles_x_manifest, _M + "SELECT file, count(*) AS tiles FROM ask JOIN man ON NOT (x1 < w OR x0 > e OR y1 < s OR y0 > n) GROUP BY file"),
    "read_buildings": (read_buildings, sql.with_("fx_buildings") + "SELECT id FROM fx_buildings WHERE cx - hw <= -74.15e0 AND cx + hw >= -74.19e0 AND cy - hh <= 40.70e0 AND cy + hh >= 40.66e0"),
    "job_bake_buildings": (job_bake_buildings, _MVT.rstrip() + f",\npt AS ({_PT}),\nrec AS ({_REC})\nSELECT z, x, y, count(DISTINCT id) AS n, CAST(sum(points) AS BIGINT) AS points FROM rings r JOIN (SELECT DISTINCT x, y FROM rec) a USING (x, y) GROUP BY z, x, y"),
    "job_building_pyramid": (job_building_pyramid, _B + _pyr),
}
