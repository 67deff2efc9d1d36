"""Queries on the elevation catalogue and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.operators import dem
from tilelake.plans import sql
from tilelake.plans.q_tiles import tiles
from tilelake.sources import catalogs, fixtures, scratch

BOX = ("xmin", "xmax", "ymin", "ymax")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "fx_dem_listing")


def _part(listing: DataFrame, skip: int) -> DataFrame:
    """A state of the listing in which every skip-th file is missing."""
    return listing.where(F.regexp_extract("dataset", r"/b(\d+)/", 1).cast("long") % skip != 0)


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The newest files now, and those that were catalogued before."""
    own = listing(spark, sf_dir)
    return dem.newest_per_location(_part(own, 5)), dem.newest_per_location(_part(own, 3))


def newest_per_location(spark, sf_dir):
    return dem.newest_per_location(listing(spark, sf_dir)).select("location", "issue", "dataset")


def unparsed_names(spark, sf_dir):
    return dem.unparsed(listing(spark, sf_dir))


def index_todo(spark, sf_dir):
    return dem.index_todo(*_states(spark, sf_dir)).select("dataset", *BOX)


def index_stale(spark, sf_dir):
    return dem.index_stale(*_states(spark, sf_dir)).select("dataset")


def index_reuse(spark, sf_dir):
    return dem.index_reuse(*_states(spark, sf_dir)).select("dataset", *BOX)


def dem_href(spark, sf_dir):
    return listing(spark, sf_dir).select("dataset", dem.dem_href(F.col("dataset")).alias("href"))


def name_to_cell(spark, sf_dir):
    """Names of the form n41w074 from customers, with the cell's corners."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.format_string("n%02d%s%03d", (F.col("c_custkey") % 60 + 1), F.when(F.col("c_custkey") % 4 == 0, "e").otherwise("w"), F.col("c_custkey") % 180)
    return c.select("c_custkey", name.alias("name")).select("c_custkey", "name", dem.name_to_cell(F.col("name")).alias("cell")).select("c_custkey", "name", "cell.*")


def check_projection(spark, sf_dir):
    """Projection parameters from parts, some of which differ."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    values = dem.PROJECTION | {"lat_1": F.when(k % 7 == 0, "30").otherwise("29.5"), "units": F.when(k % 11 == 0, "ft").otherwise("m"), "ellps": F.when(k % 17 == 0, "clrk66").otherwise("GRS80")}
    params = F.create_map(*[v for n, x in values.items() for v in (F.lit(n), x if not isinstance(x, str) else F.lit(x))])
    kept = F.map_filter(params, lambda n, _: ~((n == "x_0") & (k % 13 == 0)))
    return p.select("p_partkey", F.array_join(dem.check_projection(kept), ",").alias("differs"))


def tiles_x_dem(spark, sf_dir):
    """Tiles of the points against the newest files, whose places are moved by 10 to lie under them."""
    return dem.tiles_x_dem(tiles(spark, sf_dir), _dems(spark, sf_dir))


def _dems(spark, sf_dir) -> DataFrame:
    """Newest files with boxes ten times as large, so that they lie under the points."""
    n = dem.newest_per_location(listing(spark, sf_dir))
    return n.select("dataset", (F.col("xmin") * 1.5).alias("xmin"), (F.col("xmin") * 1.5 + 150000.0).alias("xmax"), (F.col("ymin") - 300000.0).alias("ymin"), (F.col("ymin") - 150000.0).alias("ymax"))


def coverage_features(spark, sf_dir):
    f = dem.coverage_features(listing(spark, sf_dir), "s1m")
    return f.select("dataset", "href", "type", F.posexplode("ring").alias("k", "p")).select("dataset", "href", "type", "k", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


def conus_filter(spark, sf_dir):
    moved = listing(spark, sf_dir).withColumns({"xmin": F.col("xmin") * 2.25, "xmax": F.col("xmin") * 2.25 + 10000.0})
    return dem.with_ring(moved).where(dem.in_conus(F.col("ring"))).select("dataset")


def coverage_union(spark, sf_dir):
    own = dem.newest_per_location(listing(spark, sf_dir))
    both = dem.coverage_union(dem.coverage_features(own, "s1m"), dem.coverage_features(_part(own, 2), "usgs13"))
    return both.select("ord", "dataset", "type")


def write_dem_catalog(spark, sf_dir):
    path = scratch.new_folder(spark, "dem")
    catalogs.write_dem_catalog(dem.newest_per_location(listing(spark, sf_dir)), path)
    return catalogs.read_dem_catalog(spark, path)


def read_dem_catalog(spark, sf_dir):
    """A catalogue written and read, cut by a constant box that reaches the scan."""
    path = scratch.new_folder(spark, "dem")
    catalogs.write_dem_catalog(dem.newest_per_location(listing(spark, sf_dir)), path)
    return catalogs.read_dem_catalog(spark, path).where((F.col("bbox_xmin") <= -1050000.0) & (F.col("bbox_ymax") >= 1510000.0)).select("dataset")


def _with_params(files: DataFrame) -> DataFrame:
    """files with the projection parameters that reading them would give; some are of another projection or ellipsoid."""
    k = F.regexp_extract("dataset", r"/b(\d+)/", 1).cast("long")
    values = dem.PROJECTION | {"lat_1": F.when(k % 19 == 0, "30").otherwise("29.5"), "units": F.when(k % 23 == 0, "ft").otherwise("m"), "ellps": F.when(k % 29 == 0, "clrk66").otherwise("GRS80")}
    return files.withColumn("params", F.create_map(*[v for n, x in values.items() for v in (F.lit(n), x if not isinstance(x, str) else F.lit(x))]))


def _new_files(spark, sf_dir) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Files that aren't catalogued yet, checked: good ones, rejected ones, totals."""
    return dem.split_checked(_with_params(dem.index_todo(*_states(spark, sf_dir)).select("dataset", *BOX)), scratch.new_folder(spark, "checked"))


def job_build_dem_catalog(spark, sf_dir):
    """Listing → newest → what stays, and what is new and passes the check → catalogue. New files' bounds come from the
    listing; those rejected are in a table of their own."""
    rows = dem.index_reuse(*_states(spark, sf_dir)).select("dataset", *BOX).unionByName(_new_files(spark, sf_dir)[0].select("dataset", *BOX))
    path = scratch.new_folder(spark, "dem")
    catalogs.write_dem_catalog(rows, path)
    return catalogs.read_dem_catalog(spark, path).select("fid", "dataset")


def dem_rejects(spark, sf_dir):
    """New files that the catalogue doesn't take, with their reasons."""
    return _new_files(spark, sf_dir)[1].select("dataset", "reason")


def _coverage(spark, sf_dir) -> DataFrame:
    """Features of the catalogue, written as collections and read back."""
    own = dem.newest_per_location(listing(spark, sf_dir))
    both = dem.coverage_union(dem.coverage_features(own, "s1m"), dem.coverage_features(_part(own, 2), "usgs13"))
    path = scratch.new_folder(spark, "coverage")
    catalogs.write_coverage_geojson(both.select("dataset", "href", "type", dem.feature_json(F.col("ring")).alias("feature")), path)
    return catalogs.read_coverage_geojson(spark, path)


def write_coverage_geojson(spark, sf_dir):
    """Corners of the rings that the collections hold."""
    ring = F.posexplode(F.get("feature.geometry.coordinates", F.lit(0)))
    c = _coverage(spark, sf_dir).select("type", F.col("feature.properties.dataset").alias("dataset"), ring.alias("k", "p"))
    return c.select("type", "dataset", "k", F.get("p", F.lit(0)).alias("lon"), F.get("p", F.lit(1)).alias("lat"))


def job_coverage_geojson(spark, sf_dir):
    """(type, features) of the collections."""
    return _coverage(spark, sf_dir).groupBy("type").agg(F.count("*").alias("features"))


NAME = dem.NAME


def _newest(source: str, where: str = "true") -> str:
    return f"""SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY issue DESC, dataset) AS r FROM (
  SELECT *, regexp_extract(dataset, '{NAME}', 1) AS location, regexp_extract(dataset, '{NAME}', 2) AS issue FROM {source} WHERE {where}) a WHERE location <> '') b WHERE r = 1"""


_key = r"CAST(regexp_extract(dataset, '/b(\d+)/', 1) AS BIGINT)"
_L = sql.with_("fx_dem_listing")
_S = sql.with_("fx_dem_listing", newest=_newest("fx_dem_listing"), cur=_newest("fx_dem_listing", f"{_key} % 5 <> 0"), old=_newest("fx_dem_listing", f"{_key} % 3 <> 0"))
_BAD = ", ".join(f"CASE WHEN {_key} % {m} = 0 THEN '{p}' END" for m, p in ((29, "ellps"), (19, "lat_1"), (23, "units")))
_N = _S.rstrip() + f",\ntodo AS (SELECT dataset, concat_ws(',', {_BAD}) AS differs FROM cur WHERE dataset NOT IN (SELECT dataset FROM old))\n"


def _rings(source: str, xs: tuple[str, str] = ("xmin", "xmax")) -> str:
    """Corners of boxes in degrees: dataset, k, lon, lat."""
    corners = [(xs[0], "ymin"), (xs[1], "ymin"), (xs[1], "ymax"), (xs[0], "ymax")]
    return sql.albers_inverse_table("(" + " UNION ALL ".join(f"SELECT dataset, {k} AS k, {x} AS cx, {y} AS cy FROM {source}" for k, (x, y) in enumerate(corners)) + ") c", "dataset, k", "cx", "cy")


_CENTRE = """SELECT dataset, sum((lon + lon2) * c) / (3 * sum(c)) AS x, sum((lat + lat2) * c) / (3 * sum(c)) AS y FROM (
  SELECT a.dataset, a.lon, a.lat, b.lon AS lon2, b.lat AS lat2, a.lon * b.lat - b.lon * a.lat AS c FROM rings a JOIN rings b ON a.dataset = b.dataset AND b.k = (a.k + 1) % 4) e GROUP BY dataset"""
_IN = "x BETWEEN -125 AND -66.5 AND y BETWEEN 24 AND 49.5"
_alb = [sql.albers(lo, la) for lo in (sql.box()[0], sql.box()[2]) for la in (sql.box()[1], sql.box()[3])]
_ENV = "SELECT z, x, y, " + ", ".join(f"{f}({', '.join(c[k] for c in _alb)}) AS {n}" for f, k, n in (("least", 0, "txmin"), ("greatest", 0, "txmax"), ("least", 1, "tymin"), ("greatest", 1, "tymax"))) + " FROM tiles"

QUERIES = {
    "newest_per_location": (newest_per_location, _S + "SELECT location, issue, dataset FROM newest"),
    "unparsed_names": (unparsed_names, _L + f"SELECT count(*) FILTER (regexp_extract(dataset, '{NAME}', 1) = '') AS unparsed FROM fx_dem_listing"),
    "index_todo": (index_todo, _S + "SELECT dataset, xmin, xmax, ymin, ymax FROM cur WHERE dataset NOT IN (SELECT dataset FROM old)"),
    "index_stale": (index_stale, _S + "SELECT dataset FROM old WHERE dataset NOT IN (SELECT dataset FROM cur)"),
    "index_reuse": (index_reuse, _S + "SELECT dataset, xmin, xmax, ymin, ymax FROM old WHERE dataset IN (SELECT dataset FROM cur)"),
    "dem_href": (dem_href, _L + "SELECT dataset, 's3://prd-tnm/StagedProducts/Elevation/' || dataset AS href FROM fx_dem_listing"),
    "name_to_cell": (
        name_to_cell,
        """SELECT *, CASE WHEN name LIKE '%w%' THEN -lo ELSE lo END AS xmin, la - 1 AS ymin, CASE WHEN name LIKE '%w%' THEN -lo ELSE lo END + 1 AS xmax, la AS ymax FROM (
  SELECT c_custkey, 'n' || lpad(CAST(c_custkey % 60 + 1 AS VARCHAR), 2, '0') || CASE WHEN c_custkey % 4 = 0 THEN 'e' ELSE 'w' END || lpad(CAST(c_custkey % 180 AS VARCHAR), 3, '0') AS name,
         CAST(c_custkey % 60 + 1 AS DOUBLE) AS la, CAST(c_custkey % 180 AS DOUBLE) AS lo FROM customer) t""".replace("SELECT *,", "SELECT c_custkey, name,", 1),
    ),
    "check_projection": (check_projection, "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 17 = 0 THEN 'ellps' END, CASE WHEN p_partkey % 7 = 0 THEN 'lat_1' END, CASE WHEN p_partkey % 11 = 0 THEN 'units' END, CASE WHEN p_partkey % 13 = 0 THEN 'x_0' END], lambda v: v IS NOT NULL), ',') AS differs FROM part"),
    "tiles_x_dem": (
        tiles_x_dem,
        sql.with_("fx_points", "fx_dem_listing", tiles=sql.TILES, newest=_newest("fx_dem_listing"), dems="SELECT dataset, xmin * 1.5e0 AS xmin, xmin * 1.5e0 + 150000e0 AS xmax, ymin - 300000e0 AS ymin, ymin - 150000e0 AS ymax FROM newest", env=_ENV)
        + "SELECT z, x, y, dataset FROM env JOIN dems ON txmin <= xmax AND txmax >= xmin AND tymin <= ymax AND tymax >= ymin",
    ),
    "coverage_features": (
        coverage_features,
        sql.with_("fx_dem_listing", rings=_rings("fx_dem_listing"), centre=_CENTRE)
        + f"SELECT dataset, 's3://prd-tnm/StagedProducts/Elevation/' || dataset AS href, 's1m' AS type, k, round(lon, 5) AS lon, round(lat, 5) AS lat FROM rings WHERE dataset IN (SELECT dataset FROM centre WHERE {_IN})",
    ),
    "conus_filter": (conus_filter, sql.with_("fx_dem_listing", moved="SELECT dataset, xmin * 2.25e0 AS xmin, xmin * 2.25e0 + 10000e0 AS xmax, ymin, ymax FROM fx_dem_listing", rings=_rings("moved"), centre=_CENTRE) + f"SELECT dataset FROM centre WHERE {_IN}"),
    "coverage_union": (
        coverage_union,
        sql.with_("fx_dem_listing", newest=_newest("fx_dem_listing"), rings=_rings("newest"), centre=_CENTRE)
        + f"SELECT 0 AS ord, dataset, 's1m' AS type FROM centre WHERE {_IN} UNION ALL SELECT 1, dataset, 'usgs13' FROM centre WHERE {_IN} AND {_key} % 2 <> 0",
    ),
    "write_dem_catalog": (write_dem_catalog, _S + "SELECT row_number() OVER (ORDER BY dataset) AS fid, dataset, xmin AS bbox_xmin, xmax AS bbox_xmax, ymin AS bbox_ymin, ymax AS bbox_ymax FROM newest"),
    "read_dem_catalog": (read_dem_catalog, _S + "SELECT dataset FROM newest WHERE xmin <= -1050000 AND ymax >= 1510000"),
    "job_build_dem_catalog": (job_build_dem_catalog, _N + "SELECT row_number() OVER (ORDER BY dataset) AS fid, dataset FROM cur WHERE dataset NOT IN (SELECT dataset FROM todo WHERE differs <> '')"),
    "dem_rejects": (dem_rejects, _N + "SELECT dataset, 'projection: ' || differs AS reason FROM todo WHERE differs <> ''"),
    "write_coverage_geojson": (
        write_coverage_geojson,
        sql.with_("fx_dem_listing", newest=_newest("fx_dem_listing"), rings=_rings("newest"), centre=_CENTRE)
        + f"""SELECT type, dataset, CAST(j AS INT) AS k, round(lon, 5) AS lon, round(lat, 5) AS lat FROM (SELECT *, k AS j FROM rings UNION ALL SELECT *, 4 FROM rings WHERE k = 0) r
  JOIN (SELECT dataset, 's1m' AS type FROM centre WHERE {_IN} UNION ALL SELECT dataset, 'usgs13' FROM centre WHERE {_IN} AND {_key} % 2 <> 0) t USING (dataset)""",
    ),
    "job_coverage_geojson": (
        job_coverage_geojson,
        sql.with_("fx_dem_listing", newest=_newest("fx_dem_listing"), rings=_rings("newest"), centre=_CENTRE)
        + f"SELECT 's1m' AS type, count(*) AS features FROM centre WHERE {_IN} UNION ALL SELECT 'usgs13', count(*) FROM centre WHERE {_IN} AND {_key} % 2 <> 0",
    ),
}
