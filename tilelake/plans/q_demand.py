"""Queries on demand planning, tile states and streams. Steps of the tracks are hours apart: gaps up to 6 h count, from
5 m/s on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.functions import tilemath as tm
from tilelake.operators import demand as d
from tilelake.operators import refine
from tilelake.plans import sql
from tilelake.plans.q_dem import BOX, _newest, _part, listing
from tilelake.sources import fixtures
from tilelake.streaming import jobs

GAP_S, SPEED = 6 * 3600.0, 5.0


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "fx_track").withColumn("ts", F.col("ts").cast("timestamp"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "fx_requests").withColumn("ts", F.col("ts").cast("timestamp"))


def base_zoom(spark, sf_dir):
    alt = F.col("alt") * F.pow(F.lit(2.0), F.col("event_id") % 12)
    return track(spark, sf_dir).select("event_id", d.base_zoom(alt).alias("z"))


def root_grid(spark, sf_dir):
    return d.root_grid(track(spark, sf_dir)).select("event_id", "z", F.col("tx").alias("x"), F.col("ty").alias("y"))


def _some(spark, sf_dir) -> DataFrame:
    """Positions from high up and low down."""
    return track(spark, sf_dir).withColumn("alt", F.col("alt") * (1 + F.col("event_id") % 50)).select("event_id", "x", "y", "alt")


def lod_tiles(spark, sf_dir):
    """The tiles that each position needs, as sums over each zoom."""
    t = d.lod_tiles(_some(spark, sf_dir), ["event_id"]).withColumns({"x": F.col("tx").cast("long"), "y": F.col("ty").cast("long")})
    return t.groupBy("event_id", "z").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"), F.sum(F.col("x") * F.col("y")).alias("sum_xy"))


def track_velocity(spark, sf_dir):
    v = d.track_velocity(track(spark, sf_dir), GAP_S)
    return v.select("event_id", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


def speed_knots(spark, sf_dir):
    return d.speed_knots(track(spark, sf_dir)).select("event_id", "knots")


def _prefetch(spark, sf_dir) -> DataFrame:
    v = d.track_velocity(track(spark, sf_dir), GAP_S)
    return d.prefetch_tiles(v, ["track_id", "event_id"], min_speed=SPEED)


def prefetch_tiles(spark, sf_dir):
    return _prefetch(spark, sf_dir).select("event_id", "z", F.col("tx").alias("x"), F.col("ty").alias("y"))


def flyto_tiles(spark, sf_dir):
    targets = track(spark, sf_dir).withColumn("ground", F.col("alt") * (F.col("event_id") % 20))
    return d.flyto_tiles(targets, ["event_id"]).select("event_id", "z", F.col("tx").alias("x"), F.col("ty").alias("y"))


def _roots(spark, sf_dir) -> DataFrame:
    return d.root_grid(track(spark, sf_dir)).select("z", F.col("tx").alias("x"), F.col("ty").alias("y"))


def tile_demand_union(spark, sf_dir):
    return d.tile_demand_union(_roots(spark, sf_dir), _prefetch(spark, sf_dir).select("z", F.col("tx").alias("x"), F.col("ty").alias("y")))


def _baked(spark, sf_dir) -> DataFrame:
    """Tiles that are there: those around every seventh position, and tiles above others."""
    r = d.root_grid(track(spark, sf_dir).where("event_id % 7 = 0")).select("z", F.col("tx").alias("x"), F.col("ty").alias("y"))
    up = d.root_grid(track(spark, sf_dir).where("event_id % 11 = 0")).select(tm.tile_ancestor_at(F.col("z"), F.col("tx"), F.col("ty"), F.col("z") - 2).alias("a")).select("a.*")
    return r.union(up).distinct()


def prefetch_minus_loaded(spark, sf_dir):
    ahead = _prefetch(spark, sf_dir).select("z", F.col("tx").alias("x"), F.col("ty").alias("y")).distinct()
    return d.prefetch_minus_loaded(ahead, _loaded(spark, sf_dir))


def _loaded(spark, sf_dir) -> DataFrame:
    """Tiles at prefetch zooms under the track's own positions."""
    z = F.least(d.base_zoom(F.col("alt")) + 2, F.lit(d.MAX_ZOOM)).cast("int")
    x, y = tm.tile_of_point(F.col("x"), F.col("y"), z)
    return track(spark, sf_dir).where("event_id % 3 = 0").select(z.alias("z"), x.alias("x"), y.alias("y")).distinct()


def covered_by_ancestor(spark, sf_dir):
    return d.covered_by_ancestor(_roots(spark, sf_dir), _baked(spark, sf_dir))


def coverage_gaps(spark, sf_dir):
    return d.coverage_gaps(_roots(spark, sf_dir), _baked(spark, sf_dir))


def _heights(spark, sf_dir) -> DataFrame:
    """Loaded tiles with elevations, some without, from requests."""
    r = requests(spark, sf_dir).groupBy("z", "x", "y").agg(F.min("event_id").alias("e"))
    return r.select("z", "x", "y", F.when(F.col("e") % 5 != 0, F.col("e") % 1000 * 1.5).alias("elevation"))


def finest_tile_at_point(spark, sf_dir):
    points = track(spark, sf_dir).select("event_id", F.col("x").alias("px"), F.col("y").alias("py"))
    return d.finest_tile_at_point(points, "event_id", _heights(spark, sf_dir))


def agl(spark, sf_dir):
    """Altitude above the world height of the finest tile's ground, exaggerated twice; null where there is none."""
    found = finest_tile_at_point(spark, sf_dir).select("event_id", "elevation")
    t = track(spark, sf_dir).join(found.hint("merge"), "event_id")
    _, lat = tm.merc_to_lonlat(F.col("x"), F.col("y"))
    from tilelake.functions.raster import exaggerated

    return t.select("event_id", F.round(F.col("alt") - exaggerated(F.col("elevation"), 0.0, 2.0, lat), 4).alias("agl"))


def request_dedupe(spark, sf_dir):
    return d.request_dedupe(requests(spark, sf_dir))


def nearest_first(spark, sf_dir):
    return d.nearest_first(d.request_dedupe(requests(spark, sf_dir)), 20).select("place", "z", "x", "y", "priority")


def latency_quantiles(spark, sf_dir):
    return d.latency_quantiles(requests(spark, sf_dir), accuracy=None).select("cache_state", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def _retry(spark, sf_dir) -> DataFrame:
    return d.retry_state(requests(spark, sf_dir))


def retry_state(spark, sf_dir):
    return _retry(spark, sf_dir).select("z", "x", "y", "attempts", "pending", F.unix_micros("retry_after").alias("retry_after_us"))


def imagery_health(spark, sf_dir):
    return d.imagery_health(_retry(spark, sf_dir))


def view_elevation_range(spark, sf_dir):
    h = _heights(spark, sf_dir)
    t = h.select((F.col("z") % 2 == 0).alias("visible"), F.col("elevation").isNotNull().alias("loaded"), F.lit("s1m").alias("dem_source"), F.col("elevation").alias("lo"), (F.col("elevation") + 50.0).alias("hi"))
    return d.view_elevation_range(t)


def coverage_counts(spark, sf_dir):
    r = requests(spark, sf_dir)
    return d.coverage_counts(r.select(F.when(F.col("event_id") % 3 == 0, "imagery").otherwise("terrain").alias("layer"), F.when(F.col("http_status") == 200, "ok").otherwise("no_coverage").alias("status")))


def tile_bundle_bytes(spark, sf_dir):
    r = requests(spark, sf_dir)
    size = d.bundle_bytes(F.col("event_id") % 5000 * 100, F.col("http_status") == 200)
    return r.select("z", size.alias("b")).groupBy("z").agg(F.sum("b").alias("bytes"), F.count("*").alias("tiles"))


def job_flight_demand(spark, sf_dir):
    """Positions → tiles to refine, for sets of positions at once, and tiles ahead → each once → those not baked."""
    t = track(spark, sf_dir)
    leaves = refine.demanded_tiles(t)
    ahead = _prefetch(spark, sf_dir).select("z", F.col("tx").alias("x"), F.col("ty").alias("y"))
    return d.coverage_gaps(d.tile_demand_union(leaves, ahead), d.root_grid(t.where("event_id % 700 = 0")).select("z", F.col("tx").alias("x"), F.col("ty").alias("y")).distinct())


def stream_request_dedupe(spark, sf_dir):
    r = requests(spark, sf_dir).select("event_id", "ts", "z", "x", "y")
    return jobs.drain(jobs.request_dedupe(jobs.source(spark, r)))


def stream_prefetch(spark, sf_dir):
    t = track(spark, sf_dir).select("track_id", "ts", "event_id", "x", "y", "alt").withColumn("at", F.unix_micros("ts"))
    got = jobs.drain(jobs.prefetch(jobs.source(spark, t, 3, "at"), GAP_S, SPEED))
    return got.select("event_id", "z", F.col("tx").alias("x"), F.col("ty").alias("y"))


def stream_retry_state(spark, sf_dir):
    r = requests(spark, sf_dir).select("event_id", "ts", "z", "x", "y", "http_status").withColumn("at", F.unix_micros("ts"))
    got = jobs.latest_states(jobs.drain(jobs.retry_states(jobs.source(spark, r, 3, "at"))))
    return got.select("z", "x", "y", "attempts", "pending", F.unix_micros("retry_after").alias("retry_after_us"))


def stream_catalog_ingest(spark, sf_dir):
    l = listing(spark, sf_dir).withColumn("part", F.regexp_extract("dataset", r"/b(\d+)/", 1).cast("long"))  # noqa: E741
    return jobs.catalog_ingest(jobs.source(spark, l, 3, "part")).select("dataset", *BOX)


_ZOOM = lambda a: "CASE " + " ".join(f"WHEN {a} > {s} THEN {3 + k}" for k, s in enumerate(d.STEPS)) + " ELSE 12 END"
_ROOT = f"""SELECT event_id, z, CAST(cx + i AS INT) AS x, CAST(cy + j AS INT) AS y, x AS px, y AS py, alt FROM (
  SELECT *, {sql.tx('x', 'z')} AS cx, {sql.ty('y', 'z')} AS cy FROM (SELECT *, {_ZOOM('alt')} AS z FROM pos) a) b, (SELECT unnest(range(-2, 3)) AS i) c, (SELECT unnest(range(-2, 3)) AS j) e
  WHERE cx + i BETWEEN 0 AND pow(2e0, z) - 1 AND cy + j BETWEEN 0 AND pow(2e0, z) - 1"""
_POS = "SELECT event_id, x, y, alt FROM fx_track"
_VEL = f"""SELECT track_id, event_id, x, y, alt, coalesce(last_value(vx0 IGNORE NULLS) OVER w, 0) AS vx, coalesce(last_value(vy0 IGNORE NULLS) OVER w, 0) AS vy FROM (
  SELECT *, CASE WHEN dt IS NULL OR dt >= {GAP_S} THEN 0 WHEN dt > 0 THEN (x - x0) / dt END AS vx0, CASE WHEN dt IS NULL OR dt >= {GAP_S} THEN 0 WHEN dt > 0 THEN (y - y0) / dt END AS vy0 FROM (
    SELECT *, (epoch_us(ts) / 1e6) - (epoch_us(lag(ts) OVER v) / 1e6) AS dt, lag(x) OVER v AS x0, lag(y) OVER v AS y0 FROM fx_track WINDOW v AS (PARTITION BY track_id ORDER BY ts, event_id)) a
  ) b WINDOW w AS (PARTITION BY track_id ORDER BY (SELECT 1), event_id ROWS UNBOUNDED PRECEDING)"""
_VEL = _VEL.replace("SELECT track_id, event_id, x, y, alt, coalesce", "SELECT track_id, event_id, x, y, alt, coalesce").replace("ORDER BY (SELECT 1), event_id ROWS", "ORDER BY ts, event_id ROWS")
_AHEAD = f"SELECT DISTINCT track_id, event_id, z, {sql.tx('(x + vx * s)', 'z')} AS x, {sql.ty('(y + vy * s)', 'z')} AS y FROM (SELECT *, least({_ZOOM('alt')} + 2, 18) AS z FROM vel WHERE sqrt(vx * vx + vy * vy) >= {SPEED}) a, (SELECT unnest([1e0, 2e0, 3e0, 4e0]) AS s) b"
_D = sql.with_("fx_track", pos=_POS, root=_ROOT, vel=_VEL, ahead=_AHEAD)
_LO = f"SELECT DISTINCT z, {sql.tx('x', 'z')} AS x, {sql.ty('y', 'z')} AS y FROM (SELECT *, least({_ZOOM('alt')} + 2, 18) AS z FROM fx_track WHERE event_id % 3 = 0) a"
_BAKED = "SELECT DISTINCT z, x, y FROM root WHERE event_id % 7 = 0 UNION SELECT z - 2, x >> 2, y >> 2 FROM root WHERE event_id % 11 = 0"
_UP = "SELECT DISTINCT z, x, y, CAST(k AS INT) AS az, x >> CAST(z - k AS INT) AS ax, y >> CAST(z - k AS INT) AS ay FROM (SELECT DISTINCT z, x, y, unnest(range(0, z + 1)) AS k FROM want) t"
_COVER = "SELECT DISTINCT u.z, u.x, u.y FROM up u JOIN baked b ON b.z = u.az AND b.x = u.ax AND b.y = u.ay"
_G = sql.with_("fx_track", pos=_POS, root=_ROOT, baked=_BAKED, want="SELECT DISTINCT z, x, y FROM root", up=_UP, cover=_COVER)
_s = sql.side("z")
_w, _n = f"(x * {_s} - {sql.HALF_})", f"({sql.HALF_} - y * {_s})"
_dx, _dy = f"(px - least(greatest(px, {_w}), {_w} + {_s}))", f"(py - least(greatest(py, {_n} - {_s}), {_n}))"
_REF = f"{_s} / 64 / greatest(1e0, sqrt({_dx} * {_dx} + {_dy} * {_dy} + alt * alt)) * 900 > 16 / 2.2e0"


def _lod(top: int) -> dict[str, str]:
    return {
        "tree": f"SELECT event_id, px, py, alt, z, x, y, z < {top} AND {_REF} AS refine FROM root UNION ALL SELECT event_id, px, py, alt, z, x, y, z < {top} AND {_REF} FROM (SELECT event_id, px, py, alt, z + 1 AS z, CAST(2 * x + i AS INT) AS x, CAST(2 * y + j AS INT) AS y FROM tree, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) WHERE refine) t"
    }


_HT = "SELECT z, x, y, CASE WHEN e % 5 <> 0 THEN e % 1000 * 1.5e0 END AS elevation FROM (SELECT z, x, y, min(event_id) AS e FROM fx_requests GROUP BY z, x, y) t"
_FIN = f"SELECT p.event_id, max(h.z) AS z, arg_max(h.elevation, h.z) AS elevation FROM (SELECT event_id, k AS z, {sql.tx('x', 'k')} AS x, {sql.ty('y', 'k')} AS y FROM (SELECT *, unnest(range(0, 19)) AS k FROM fx_track) a) p JOIN ht h ON h.z = p.z AND h.x = p.x AND h.y = p.y AND h.elevation IS NOT NULL GROUP BY p.event_id"
_H = sql.with_("fx_track", "fx_requests", ht=_HT, fin=_FIN)
_Q = sql.with_("fx_requests")
_RETRY = """SELECT z, x, y, CAST(owed AS INT) AS attempts, owed BETWEEN 1 AND 2 AS pending,
  CASE WHEN st = 503 THEN CASE WHEN owed < 3 THEN epoch_us(ts) + 8000000 END WHEN st >= 500 THEN epoch_us(ts) + 5000000 END AS retry_after_us FROM (
    SELECT z, x, y, count(*) FILTER (http_status = 503 AND (ts, event_id) > (coalesce(lt, TIMESTAMP '1900-01-01'), coalesce(le, -1))) AS owed, arg_max(http_status, (ts, event_id)) AS st, max(ts) AS ts FROM (
      SELECT *, max(CASE WHEN http_status < 500 THEN ts END) OVER (PARTITION BY z, x, y) AS lt,
             arg_max(CASE WHEN http_status < 500 THEN event_id END, CASE WHEN http_status < 500 THEN (ts, event_id) END) OVER (PARTITION BY z, x, y) AS le FROM fx_requests) a GROUP BY z, x, y) b"""
_R = sql.with_("fx_requests", retry=_RETRY)
_pct = ", ".join(f"round(quantile_cont(latency_ms, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99))
_flyz = "CASE WHEN g > 40000 THEN 8 WHEN g > 20000 THEN 9 WHEN g > 10000 THEN 10 WHEN g > 5000 THEN 11 ELSE 12 END"

QUERIES = {
    "base_zoom": (base_zoom, sql.with_("fx_track") + f"SELECT event_id, {_ZOOM('(alt * pow(2e0, event_id % 12))')} AS z FROM fx_track"),
    "root_grid": (root_grid, _D + "SELECT event_id, z, x, y FROM root"),
    "lod_tiles": (
        lod_tiles,
        sql.with_("fx_track", pos="SELECT event_id, x, y, alt * (1 + event_id % 50) AS alt FROM fx_track", root=_ROOT, **_lod(18))
        + "SELECT event_id, z, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(CAST(x AS BIGINT) * y) AS BIGINT) AS sum_xy FROM tree WHERE NOT refine GROUP BY event_id, z",
    ),
    "track_velocity": (track_velocity, _D + "SELECT event_id, round(vx, 6) AS vx, round(vy, 6) AS vy FROM vel"),
    "speed_knots": (speed_knots, sql.with_("fx_track") + "SELECT event_id, CASE WHEN dt > 0 THEN CAST(floor(sqrt(power(x - x0, 2) + power(y - y0, 2)) / dt * 1.94384e0 + 0.5e0) AS BIGINT) END AS knots FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER v)) / 1e6 AS dt, lag(x) OVER v AS x0, lag(y) OVER v AS y0 FROM fx_track WINDOW v AS (PARTITION BY track_id ORDER BY ts, event_id)) a"),
    "prefetch_tiles": (prefetch_tiles, _D + "SELECT event_id, z, x, y FROM ahead"),
    "flyto_tiles": (
        flyto_tiles,
        sql.with_("fx_track", c=f"SELECT event_id, z, {sql.tx('x', 'z')} AS cx, {sql.ty('y', 'z')} AS cy FROM (SELECT *, {_flyz} AS z FROM (SELECT *, alt * (event_id % 20) + 1500 AS g FROM fx_track) a) b")
        + "SELECT event_id, z, CAST(cx + i AS INT) AS x, CAST(cy + j AS INT) AS y FROM c, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) WHERE cx + i BETWEEN 0 AND pow(2e0, z) - 1 AND cy + j BETWEEN 0 AND pow(2e0, z) - 1 UNION ALL SELECT event_id, z + 1, CAST(2 * cx + i AS INT), CAST(2 * cy + j AS INT) FROM c, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)",
    ),
    "tile_demand_union": (tile_demand_union, _D + "SELECT z, x, y FROM root UNION SELECT z, x, y FROM ahead"),
    "prefetch_minus_loaded": (prefetch_minus_loaded, _D.rstrip() + f",\nlo AS ({_LO})\nSELECT z, x, y FROM ahead EXCEPT SELECT z, x, y FROM lo"),
    "covered_by_ancestor": (covered_by_ancestor, _G + "SELECT z, x, y FROM cover"),
    "coverage_gaps": (coverage_gaps, _G + "SELECT z, x, y FROM want EXCEPT SELECT z, x, y FROM cover"),
    "finest_tile_at_point": (finest_tile_at_point, _H + "SELECT t.event_id, f.z, f.elevation FROM fx_track t LEFT JOIN fin f USING (event_id)"),
    "agl": (agl, _H + f"SELECT t.event_id, round(alt - elevation * 2 / cos(radians({sql.lat('y')})), 4) AS agl FROM fx_track t LEFT JOIN fin f USING (event_id)"),
    "request_dedupe": (request_dedupe, _Q + "SELECT z, x, y, max(priority) AS priority FROM fx_requests GROUP BY z, x, y"),
    "nearest_first": (nearest_first, _Q + "SELECT CAST(row_number() OVER (ORDER BY priority DESC, z, x, y) AS INT) AS place, z, x, y, priority FROM (SELECT z, x, y, max(priority) AS priority FROM fx_requests GROUP BY z, x, y) t ORDER BY place LIMIT 20"),
    "latency_quantiles": (latency_quantiles, _Q + f"SELECT cache_state, {_pct} FROM fx_requests GROUP BY cache_state"),
    "retry_state": (retry_state, _R + "SELECT * FROM retry"),
    "imagery_health": (imagery_health, _R + "SELECT count(*) FILTER (pending) AS retrying, count(*) FILTER (NOT pending AND attempts >= 3) AS gave_up FROM retry"),
    "view_elevation_range": (view_elevation_range, sql.with_("fx_requests", ht=_HT) + "SELECT CASE WHEN lo < hi THEN lo ELSE 0 END AS lo, CASE WHEN lo < hi THEN hi ELSE 4000 END AS hi FROM (SELECT min(elevation) AS lo, max(elevation) + 50 AS hi FROM ht WHERE z % 2 = 0 AND elevation IS NOT NULL) t"),
    "coverage_counts": (coverage_counts, _Q + "SELECT CASE WHEN event_id % 3 = 0 THEN 'imagery' ELSE 'terrain' END AS layer, count(*) FILTER (http_status = 200) AS rendered, count(*) AS asked FROM fx_requests GROUP BY 1"),
    "tile_bundle_bytes": (tile_bundle_bytes, _Q + "SELECT z, CAST(sum(event_id % 5000 * 100 + CASE WHEN http_status = 200 THEN 1048576 ELSE 0 END) AS BIGINT) AS bytes, count(*) AS tiles FROM fx_requests GROUP BY z"),
    "job_flight_demand": (
        job_flight_demand,
        sql.with_("fx_track", pos=_POS, root=_ROOT, vel=_VEL, ahead=_AHEAD, **_lod(18), want="SELECT z, x, y FROM tree WHERE NOT refine UNION SELECT z, x, y FROM ahead", baked="SELECT DISTINCT z, x, y FROM root WHERE event_id % 700 = 0", up=_UP, cover=_COVER)
        + "SELECT z, x, y FROM want EXCEPT SELECT z, x, y FROM cover",
    ),
    "stream_request_dedupe": (stream_request_dedupe, _Q + "SELECT DISTINCT z, x, y FROM fx_requests"),
    "stream_prefetch": (stream_prefetch, _D + "SELECT event_id, z, x, y FROM ahead"),
    "stream_retry_state": (stream_retry_state, _R + "SELECT * FROM retry"),
    "stream_catalog_ingest": (stream_catalog_ingest, sql.with_("fx_dem_listing", newest=_newest("fx_dem_listing")) + "SELECT dataset, xmin, xmax, ymin, ymax FROM newest"),
}
