"""Queries on the imagery catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.functions import geometry
from tilelake.functions import tilemath as tm
from tilelake.operators import imagery as im
from tilelake.operators import validate
from tilelake.plans import sql
from tilelake.plans.q_tiles import tiles
from tilelake.sources import catalogs, fixtures, scratch

YEAR = 2000
BUCKET = "naip-visualization"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imagery items with href, gsd and bucket."""
    i = fixtures.imagery(spark, sf_dir)
    return i.withColumn("href", im.asset_href(F.col("assets"))).withColumn("gsd", im.asset_gsd(F.col("properties")))


def _catalogue(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a catalogue written from the items."""
    path = scratch.new_folder(spark, "imagery")
    own = fixtures.imagery(spark, sf_dir).withColumn("collection", F.lit("naip"))
    catalogs.write_imagery_catalog(own.select("id", "ring", "xmin", "ymin", "xmax", "ymax", "properties", "assets", "collection", "region", "year"), path)
    return path


def read_imagery_catalog(spark, sf_dir):
    """Two regions of the catalogue; the folders of the others are not read."""
    return catalogs.read_imagery_catalog(spark, _catalogue(spark, sf_dir), "naip", ["nj", "ca"]).select("id", "region", "year", "properties")


def read_listing(spark, sf_dir):
    """Folders of a catalogue, from the listing of its files."""
    files = catalogs.read_listing(spark, _catalogue(spark, sf_dir), ".parquet")
    return files.select(F.regexp_replace("dataset", "/[^/]*$", "").alias("folder")).distinct()


def asset_href(spark, sf_dir):
    return items(spark, sf_dir).select("id", "href")


def asset_gsd(spark, sf_dir):
    return items(spark, sf_dir).select("id", "gsd")


def href_bucket(spark, sf_dir):
    return items(spark, sf_dir).select("id", im.href_bucket(F.col("href")).alias("bucket"))


def requester_pays_flag(spark, sf_dir):
    return items(spark, sf_dir).select("id", F.coalesce(im.requester_pays(im.href_bucket(F.col("href"))), F.lit(False)).alias("pays"))


def asset_bucket_filter(spark, sf_dir):
    return im.asset_bucket_filter(items(spark, sf_dir), bucket=BUCKET).select("id", "href")


def region_extents(spark, sf_dir):
    return im.region_extents(items(spark, sf_dir)).select("region", *[F.round(c, 6).alias(c) for c in ("rxmin", "rymin", "rxmax", "rymax")])


def region_prune(spark, sf_dir):
    return im.region_prune(tiles(spark, sf_dir), im.region_extents(items(spark, sf_dir)))


def _wide(spark, sf_dir) -> DataFrame:
    """The tiles and those six zooms above them."""
    t = tiles(spark, sf_dir).select("z", "x", "y")
    return t.union(t.select(tm.tile_ancestor_at(F.col("z"), F.col("x"), F.col("y"), F.col("z") - 6).alias("a")).select("a.z", "a.x", "a.y")).distinct()


def bbox_prune(spark, sf_dir):
    return im.tiles_x_imagery(_wide(spark, sf_dir), items(spark, sf_dir), exact=False).select("z", "x", "y", "id")


def tiles_x_imagery(spark, sf_dir):
    return im.tiles_x_imagery(_wide(spark, sf_dir), items(spark, sf_dir)).select("z", "x", "y", "id")


def intersects_envelope(spark, sf_dir):
    """Items against one constant box: the box conditions reach the scan as filters on plain columns."""
    i = items(spark, sf_dir)
    box = tuple(F.lit(v) for v in (-119.5, 30.2, -119.4, 30.9))
    own = tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    return i.where(geometry.bbox_meets(own, box)).select("id", geometry.convex_meets_box(F.col("ring"), *box).alias("meets"))


def newest_vintage(spark, sf_dir):
    return im.newest_vintage(items(spark, sf_dir), YEAR).select("id", "region", "year")


def assets_per_tile(spark, sf_dir):
    pairs = im.tiles_x_imagery(tiles(spark, sf_dir), items(spark, sf_dir))
    return im.assets_per_tile(pairs).select("z", "tiles", "most", F.round("average", 6).alias("average"))


def rank_assets(spark, sf_dir):
    return im.rank_assets(im.tiles_x_imagery(tiles(spark, sf_dir), items(spark, sf_dir)), cap=2).select("z", "x", "y", "rank", "id", "year", "gsd")


def resolve(tile: DataFrame, catalogue: DataFrame, year: int, layer: str = "naip", cap: int = im.CAP) -> DataFrame:
    """(z, x, y, status, rank, id, href, year, gsd, pays): the assets that build each asked tile, in order of rank; a tile
    that breaks a rule has the reason as status, one without assets no_coverage, and both have no asset. The catalogue is
    read for the regions that valid tiles meet, whose names (one for each folder) come to the driver."""
    asked = tile.select("z", "x", "y").distinct().withColumn("layer", F.lit(layer)).withColumn("status", validate.imagery()).drop("layer")
    ok = asked.where("status = 'ok'").select("z", "x", "y")
    names = [r.region for r in im.region_prune(ok, im.region_extents(catalogue)).select("region").distinct().collect()]
    own = im.asset_bucket_filter(im.newest_vintage(catalogue.where(F.col("region").isin(names)), year), bucket=BUCKET)
    ranked = im.rank_assets(im.tiles_x_imagery(ok, own), cap).select("z", "x", "y", "rank", "id", "href", "year", "gsd", im.requester_pays(im.href_bucket(F.col("href"))).alias("pays"))
    status = F.when((F.col("status") == "ok") & F.col("id").isNull(), "no_coverage").otherwise(F.col("status"))
    return asked.join(ranked, ["z", "x", "y"], "left").withColumn("status", status)


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles, some three zooms above and some beside the world."""
    t = tiles(spark, sf_dir).select("z", "x", "y")
    up = t.select(tm.tile_ancestor_at(F.col("z"), F.col("x"), F.col("y"), F.col("z") - 3).alias("a")).select("a.z", "a.x", "a.y")
    return t.union(up).union(t.where("x % 50 = 0").select("z", (F.col("x") + tm.tiles_at(F.col("z"))).alias("x"), "y")).distinct()


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written catalogue, with href and gsd."""
    read = catalogs.read_imagery_catalog(spark, _catalogue(spark, sf_dir), "naip")
    return read.withColumn("href", im.asset_href(F.col("assets"))).withColumn("gsd", im.asset_gsd(F.col("properties")))


def job_resolve_imagery(spark, sf_dir):
    """Asked tiles → rules → regions → newest vintage → footprints → rank, on the catalogue's files."""
    return resolve(requested(spark, sf_dir), catalogue(spark, sf_dir), YEAR)


_b = sql.box()
_ITEMS = """SELECT *, coalesce(json_extract_string(assets, '$.data.href'), json_extract_string(assets, '$.visual.href')) AS href,
  TRY_CAST(json_extract_string(properties, '$.gsd') AS DOUBLE) AS gsd FROM fx_imagery"""
_TB = f"SELECT z, x, y, {_b[0]} AS w, {_b[1]} AS s, {_b[2]} AS e, {_b[3]} AS n FROM tiles"
_I = sql.with_("fx_imagery", items=_ITEMS)
_EXT = "SELECT region, min(xmin) AS rxmin, min(ymin) AS rymin, max(xmax) AS rxmax, max(ymax) AS rymax FROM items GROUP BY region"
_NEW = f"SELECT i.* FROM items i JOIN (SELECT region, max(year) AS year FROM items WHERE year <= {YEAR} GROUP BY region) m USING (region, year)"
_BOX = "xmin <= e AND xmax >= w AND ymin <= n AND ymax >= s"


def _axes(w: str = "w", s: str = "s", e: str = "e", n: str = "n") -> str:
    """Separating axes of a square turned by a slope: the box's corners in the square's own frame."""
    u = [f"(({x}) - lon_c) + skew * (({y}) - lat_c)" for x in (w, e) for y in (s, n)]
    v = [f"(({y}) - lat_c) - skew * (({x}) - lon_c)" for x in (w, e) for y in (s, n)]
    half = "0.03125e0 * (1 + skew * skew)"
    return " AND ".join(f"least({', '.join(a)}) <= {half} AND greatest({', '.join(a)}) >= -{half}" for a in (u, v))


_PAIRS = f"SELECT z, x, y, i.* FROM tb JOIN {{}} i ON {_BOX} WHERE {_axes()}"


def _pairs(source: str = "items", tiles: str = sql.TILES, **more: str) -> str:
    return sql.with_("fx_points", "fx_imagery", items=_ITEMS, tiles=tiles, tb=_TB, **more, pairs=_PAIRS.format(source))


_WIDE = f"SELECT z, x, y FROM ({sql.TILES}) t UNION SELECT z - 6, x >> 6, y >> 6 FROM ({sql.TILES}) t"


_RANK = "SELECT z, x, y, row_number() OVER (PARTITION BY z, x, y ORDER BY year DESC, gsd ASC NULLS LAST, id) AS rank, id, href, year, gsd FROM pairs"
_BUCKET = "regexp_extract(href, 's3://([^/]+)', 1)"
_PAID = "('naip-analytic', 'naip-visualization', 'naip-stac-catalog')"

_REQ = "SELECT z, x, y FROM tiles UNION SELECT z - 3, x >> 3, y >> 3 FROM tiles UNION SELECT z, CAST(x + pow(2, z) AS INT), y FROM tiles WHERE x % 50 = 0"
_STATUS = "SELECT z, x, y, CASE WHEN z < 14 THEN 'below_min_zoom' WHEN x >= pow(2, z) THEN 'out_of_range' ELSE 'ok' END AS status FROM req"
_RESOLVED = f"""SELECT s.z, s.x, s.y, CASE WHEN status = 'ok' AND id IS NULL THEN 'no_coverage' ELSE status END AS status, CAST(rank AS INT) AS rank, id, href, year, gsd, {_BUCKET} IN {_PAID} AS pays
  FROM st s LEFT JOIN (SELECT * FROM ({_RANK}) r WHERE rank <= 64) r ON s.status = 'ok' AND r.z = s.z AND r.x = s.x AND r.y = s.y"""
#: WITH clause up to ``resolved``, the rows of job_resolve_imagery.
RESOLVED = _pairs("own", own=f"SELECT * FROM ({_NEW}) n WHERE href LIKE 's3://{BUCKET}/%'").rstrip() + f",\nreq AS ({_REQ}),\nst AS ({_STATUS}),\nresolved AS ({_RESOLVED})\n"

QUERIES = {
    "read_imagery_catalog": (read_imagery_catalog, _I + "SELECT id, region, year, properties FROM items WHERE region IN ('nj', 'ca')"),
    "read_listing": (read_listing, _I + "SELECT DISTINCT 'collection=naip/region=' || region || '/year=' || year AS folder FROM items"),
    "asset_href": (asset_href, _I + "SELECT id, href FROM items"),
    "asset_gsd": (asset_gsd, _I + "SELECT id, gsd FROM items"),
    "href_bucket": (href_bucket, _I + f"SELECT id, {_BUCKET} AS bucket FROM items"),
    "requester_pays_flag": (requester_pays_flag, _I + f"SELECT id, coalesce({_BUCKET} IN {_PAID}, false) AS pays FROM items"),
    "asset_bucket_filter": (asset_bucket_filter, _I + f"SELECT id, href FROM items WHERE href LIKE 's3://{BUCKET}/%'"),
    "region_extents": (region_extents, _I + f"SELECT region, round(rxmin, 6) AS rxmin, round(rymin, 6) AS rymin, round(rxmax, 6) AS rxmax, round(rymax, 6) AS rymax FROM ({_EXT}) e"),
    "region_prune": (region_prune, sql.with_("fx_points", "fx_imagery", items=_ITEMS, tiles=sql.TILES, tb=_TB, ext=_EXT) + "SELECT z, x, y, region FROM tb JOIN ext ON NOT (rxmax < w OR rxmin > e OR rymax < s OR rymin > n)"),
    "bbox_prune": (bbox_prune, sql.with_("fx_points", "fx_imagery", items=_ITEMS, tiles=_WIDE, tb=_TB) + f"SELECT z, x, y, id FROM tb JOIN items ON {_BOX}"),
    "tiles_x_imagery": (tiles_x_imagery, _pairs(tiles=_WIDE) + "SELECT z, x, y, id FROM pairs"),
    "intersects_envelope": (intersects_envelope, _I + f"SELECT id, {_axes('-119.5e0', '30.2e0', '-119.4e0', '30.9e0')} AS meets FROM items WHERE xmin <= -119.4e0 AND xmax >= -119.5e0 AND ymin <= 30.9e0 AND ymax >= 30.2e0"),
    "newest_vintage": (newest_vintage, _I + f"SELECT id, region, year FROM ({_NEW}) n"),
    "assets_per_tile": (assets_per_tile, _pairs() + "SELECT z, count(*) AS tiles, max(n) AS most, round(avg(n), 6) AS average FROM (SELECT z, x, y, count(*) AS n FROM pairs GROUP BY z, x, y) t GROUP BY z"),
    "rank_assets": (rank_assets, _pairs() + f"SELECT z, x, y, CAST(rank AS INT) AS rank, id, year, gsd FROM ({_RANK}) r WHERE rank <= 2"),
    "job_resolve_imagery": (job_resolve_imagery, RESOLVED + "SELECT * FROM resolved"),
}
