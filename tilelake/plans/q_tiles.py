"""Queries on tile arithmetic and request validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.functions import projection
from tilelake.functions import tilemath as tm
from tilelake.operators import validate
from tilelake.plans import sql
from tilelake.sources import fixtures


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "fx_points")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tiles of the points of interest."""
    p = points(spark, sf_dir)
    x, y = tm.tile_of_point(*tm.lonlat_to_merc(F.col("lon"), F.col("lat")), F.col("z"))
    return p.select("z", x.alias("x"), y.alias("y")).distinct()


def lonlat_to_merc(spark, sf_dir):
    x, y = tm.lonlat_to_merc(F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("point_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


def merc_to_lonlat(spark, sf_dir):
    lon, lat = tm.merc_to_lonlat(F.col("x"), F.col("y"))
    return fixtures.table(spark, sf_dir, "fx_track").select("event_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def merc_scale(spark, sf_dir):
    return points(spark, sf_dir).select("point_id", F.round(tm.merc_scale(F.col("lat")), 6).alias("scale"))


def tile_of_point(spark, sf_dir):
    x, y = tm.tile_of_point(*tm.lonlat_to_merc(F.col("lon"), F.col("lat")), F.col("z"))
    return points(spark, sf_dir).select("point_id", "z", x.alias("x"), y.alias("y"))


def tile_bounds_merc(spark, sf_dir):
    return tiles(spark, sf_dir).select("z", "x", "y", *[F.round(c, 2).alias(n) for c, n in zip(tm.tile_bounds_merc(F.col("z"), F.col("x"), F.col("y")), "wsen", strict=True)])


def tile_bounds_lonlat(spark, sf_dir):
    return tiles(spark, sf_dir).select("z", "x", "y", *[F.round(c, 6).alias(n) for c, n in zip(tm.tile_bounds_lonlat(F.col("z"), F.col("x"), F.col("y")), "wsen", strict=True)])


def tile_parent(spark, sf_dir):
    return tiles(spark, sf_dir).select("z", "x", "y", tm.tile_parent(F.col("z"), F.col("x"), F.col("y")).alias("p")).select("z", "x", "y", F.col("p.z").alias("pz"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))


def tile_ancestor_at(spark, sf_dir):
    return tiles(spark, sf_dir).select("z", "x", "y", tm.tile_ancestor_at(F.col("z"), F.col("x"), F.col("y"), 9).alias("p")).select("z", "x", "y", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"))


def tile_children(spark, sf_dir):
    return tiles(spark, sf_dir).select(F.col("z").alias("pz"), F.col("x").alias("px"), F.col("y").alias("py"), F.explode(tm.tile_children(F.col("z"), F.col("x"), F.col("y"))).alias("c")).select("pz", "px", "py", "c.z", "c.x", "c.y")


def tile_ancestors(spark, sf_dir):
    return tiles(spark, sf_dir).select(F.explode(tm.tile_ancestors(F.col("z"), F.col("x"), F.col("y"))).alias("a")).select("a.*").groupBy("z", "x", "y").agg(F.count("*").alias("n"))


def tile_grid_around(spark, sf_dir):
    return points(spark, sf_dir).select("point_id", F.explode(tm.tile_grid_around(F.col("lat"), F.col("lon"), F.col("z"), 4)).alias("tile")).select("point_id", "tile.*")


def tile_cover_bbox(spark, sf_dir):
    i = fixtures.imagery(spark, sf_dir)
    return i.select("id", F.explode(tm.tile_cover_bbox(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.lit(12))).alias("tile")).select("id", "tile.*")


def maxzoom_for_gsd(spark, sf_dir):
    gsd = F.round((F.col("p_size") + 1) * 0.07, 2)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", tm.maxzoom_for_gsd(gsd, 256).alias("z256"), tm.maxzoom_for_gsd(gsd).alias("z512"))


def mvt_quantization(spark, sf_dir):
    return tiles(spark, sf_dir).select("z", "x", "y", F.round(tm.mvt_quantization(F.col("z")), 9).alias("unit_m"))


def albers_forward(spark, sf_dir):
    x, y = projection.albers_forward(F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("point_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


def albers_inverse(spark, sf_dir):
    lon, lat = projection.albers_inverse(F.col("xmin"), F.col("ymax"))
    return fixtures.table(spark, sf_dir, "fx_dem_listing").select("dataset", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def tile_envelope_albers(spark, sf_dir):
    return tiles(spark, sf_dir).select("z", "x", "y", *[F.round(c, 2).alias(n) for c, n in zip(projection.tile_envelope_albers(F.col("z"), F.col("x"), F.col("y")), ("xmin", "xmax", "ymin", "ymax"), strict=True)])


def _kinds(spark, sf_dir):
    source = F.when(F.col("event_id") % 4 == 0, "osm").otherwise("naip")
    return fixtures.table(spark, sf_dir, "fx_requests").select("event_id", (F.col("z") + F.col("event_id") % 14).cast("int").alias("z"), "x", "y", source.alias("source"))


def route_imagery(spark, sf_dir):
    return _kinds(spark, sf_dir).select("event_id", "z", tm.route_imagery(F.col("z"), F.col("source")).alias("kind"))


def tile_path(spark, sf_dir):
    kind = F.when(F.col("event_id") % 5 == 0, "terrain").when(F.col("event_id") % 5 == 1, "buildings").otherwise(tm.route_imagery(F.col("z"), F.col("source")))
    return _kinds(spark, sf_dir).select("event_id", tm.tile_path(kind, F.lit("naip"), 2010 + F.col("event_id") % 10, F.col("z"), F.col("x"), F.col("y")).alias("path"))


def _asked(spark, sf_dir):
    """Requests with some zooms and places outside the grid, and an unknown layer."""
    r = fixtures.table(spark, sf_dir, "fx_requests")
    z = (F.col("event_id") % 23 - 2).cast("int")
    n = F.pow(F.lit(2.0), F.greatest(z, F.lit(0))).cast("long")
    return r.select("event_id", F.when(F.col("event_id") % 11 == 0, "moon").otherwise("naip").alias("layer"), z.alias("z"), ((F.col("event_id") * 31) % n).cast("int").alias("x"), (F.col("event_id") * 17 % n + F.when(F.col("event_id") % 13 == 0, n).otherwise(0)).cast("int").alias("y"))


def _validated(rule):
    def query(spark, sf_dir):
        return _asked(spark, sf_dir).select("event_id", rule().alias("status"))

    return query


ASKED = """SELECT event_id, layer, z, CAST((event_id * 31) % n AS INT) AS x, CAST((event_id * 17) % n + CASE WHEN event_id % 13 = 0 THEN n ELSE 0 END AS INT) AS y
FROM (SELECT *, CAST(pow(2e0, greatest(z, 0)) AS BIGINT) AS n FROM (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'moon' ELSE 'naip' END AS layer, CAST(event_id % 23 - 2 AS INT) AS z FROM events) a) b"""
OUT = "x < 0 OR y < 0 OR x >= pow(2e0, z) OR y >= pow(2e0, z)"


def _ask(cases: str) -> str:
    return sql.with_(asked=ASKED) + f"SELECT event_id, CASE {cases} ELSE 'ok' END AS status FROM asked"


P_, T_ = sql.with_("fx_points"), sql.with_("fx_points", tiles=sql.TILES)
w, s, e, n = sql.bounds()
bw, bs, be, bn = sql.box()
_alb = [sql.albers(lo, la) for lo in (bw, be) for la in (bs, bn)]
_fx, _fy = sql.albers("lon", "lat")
_mx, _my = sql.mx("lon"), sql.my("lat")
_cover = [sql.tx(sql.mx("xmin"), "12"), sql.tx(sql.mx("xmax"), "12"), sql.ty(sql.my("ymax"), "12"), sql.ty(sql.my("ymin"), "12")]
_gsd = "round((p_size + 1) * 0.07e0, 2)"
_maxz = lambda size: f"CAST(least(greatest(ceil(log2(156543.03392804097e0 / {_gsd}) - 1e-8) - {size}, 0), 24) AS INT)"
_KIND = "SELECT event_id, CAST(z + event_id % 14 AS INT) AS z, x, y, CASE WHEN event_id % 4 = 0 THEN 'osm' ELSE 'naip' END AS source FROM fx_requests"
_ROUTE = "CASE WHEN source = 'osm' THEN 'osm' WHEN z <= 13 THEN 'basemap' ELSE 'imagery' END"

QUERIES = {
    "lonlat_to_merc": (lonlat_to_merc, P_ + f"SELECT point_id, round({_mx}, 2) AS x, round({_my}, 2) AS y FROM fx_points"),
    "merc_to_lonlat": (merc_to_lonlat, sql.with_("fx_track") + f"SELECT event_id, round({sql.lon('x')}, 6) AS lon, round({sql.lat('y')}, 6) AS lat FROM fx_track"),
    "merc_scale": (merc_scale, P_ + "SELECT point_id, round(1 / cos(radians(lat)), 6) AS scale FROM fx_points"),
    "tile_of_point": (tile_of_point, P_ + f"SELECT point_id, z, {sql.tx(_mx, 'z')} AS x, {sql.ty(_my, 'z')} AS y FROM fx_points"),
    "tile_bounds_merc": (tile_bounds_merc, T_ + f"SELECT z, x, y, round({w}, 2) AS w, round({s}, 2) AS s, round({e}, 2) AS e, round({n}, 2) AS n FROM tiles"),
    "tile_bounds_lonlat": (tile_bounds_lonlat, T_ + f"SELECT z, x, y, round({bw}, 6) AS w, round({bs}, 6) AS s, round({be}, 6) AS e, round({bn}, 6) AS n FROM tiles"),
    "tile_parent": (tile_parent, T_ + "SELECT z, x, y, z - 1 AS pz, x // 2 AS px, y // 2 AS py FROM tiles"),
    "tile_ancestor_at": (tile_ancestor_at, T_ + "SELECT z, x, y, x >> (z - 9) AS ax, y >> (z - 9) AS ay FROM tiles"),
    "tile_children": (tile_children, T_ + "SELECT z AS pz, x AS px, y AS py, z + 1 AS z, CAST(2 * x + dx AS INT) AS x, CAST(2 * y + dy AS INT) AS y FROM tiles, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)"),
    "tile_ancestors": (tile_ancestors, T_ + "SELECT CAST(k AS INT) AS z, x >> CAST(z - k AS INT) AS x, y >> CAST(z - k AS INT) AS y, count(*) AS n FROM (SELECT z, x, y, unnest(range(0, z + 1)) AS k FROM tiles) t GROUP BY 1, 2, 3"),
    "tile_grid_around": (
        tile_grid_around,
        P_ + f"SELECT point_id, z, CAST({sql.tx(_mx, 'z')} + dx AS INT) AS x, CAST({sql.ty(_my, 'z')} + dy AS INT) AS y FROM fx_points, (SELECT unnest(range(-2, 2)) AS dx) a, (SELECT unnest(range(-2, 2)) AS dy) b",
    ),
    "tile_cover_bbox": (
        tile_cover_bbox,
        sql.with_("fx_imagery") + f"SELECT id, 12 AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT id, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM (SELECT id, {_cover[0]} AS x0, {_cover[1]} AS x1, {_cover[2]} AS y0, {_cover[3]} AS y1 FROM fx_imagery) a) b, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) c",
    ),
    "maxzoom_for_gsd": (maxzoom_for_gsd, f"SELECT p_partkey, {_maxz(0)} AS z256, {_maxz(1)} AS z512 FROM part"),
    "mvt_quantization": (mvt_quantization, T_ + f"SELECT z, x, y, round({sql.side('z')} / 4096, 9) AS unit_m FROM tiles"),
    "albers_forward": (albers_forward, P_ + f"SELECT point_id, round({_fx}, 2) AS x, round({_fy}, 2) AS y FROM fx_points"),
    "albers_inverse": (albers_inverse, sql.with_("fx_dem_listing", inv=sql.albers_inverse_table("fx_dem_listing", "dataset", "xmin", "ymax")) + "SELECT dataset, round(lon, 6) AS lon, round(lat, 6) AS lat FROM inv"),
    "tile_envelope_albers": (
        tile_envelope_albers,
        T_ + "SELECT z, x, y, " + ", ".join(f"round({f}({', '.join(c[k] for c in _alb)}), 2) AS {name}" for f, k, name in (("least", 0, "xmin"), ("greatest", 0, "xmax"), ("least", 1, "ymin"), ("greatest", 1, "ymax"))) + " FROM tiles",
    ),
    "route_imagery": (route_imagery, sql.with_("fx_requests", kinds=_KIND) + f"SELECT event_id, z, {_ROUTE} AS kind FROM kinds"),
    "tile_path": (
        tile_path,
        sql.with_("fx_requests", kinds=_KIND, k2=f"SELECT *, CASE event_id % 5 WHEN 0 THEN 'terrain' WHEN 1 THEN 'buildings' ELSE {_ROUTE} END AS kind, z || '/' || x || '/' || y AS t FROM kinds")
        + "SELECT event_id, CASE kind WHEN 'imagery' THEN '/imagery/naip/' || (2010 + event_id % 10) || '/' || t || '.webp' WHEN 'terrain' THEN '/terrain/' || t || '.webp' WHEN 'buildings' THEN '/buildings/' || t || '.pbf' ELSE '/basemap/' || t || '.webp' END AS path FROM k2",
    ),
    "validate_imagery": (_validated(validate.imagery), _ask(f"WHEN layer <> 'naip' THEN 'unknown_layer' WHEN z < 0 OR z > 18 THEN 'above_max_zoom' WHEN z < 14 THEN 'below_min_zoom' WHEN {OUT} THEN 'out_of_range'")),
    "validate_basemap": (_validated(validate.basemap), _ask(f"WHEN z < 0 OR z > 16 THEN 'above_max_zoom' WHEN {OUT} THEN 'out_of_range'")),
    "validate_terrain": (_validated(validate.terrain), _ask(f"WHEN z < 0 OR z > 18 THEN 'above_max_zoom' WHEN {OUT} THEN 'out_of_range'")),
    "validate_buildings": (_validated(validate.buildings), _ask(f"WHEN z < 14 THEN 'below_min_zoom' WHEN {OUT} THEN 'out_of_range'")),
}
