"""Which tiles a flight needs, and the state of the tiles it asked for. Arithmetic on positions, one row at a time, with
tiles made distinct before anything is joined."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilelake.functions import tilemath as tm

TILE = ["z", "x", "y"]
#: Altitudes above which the zoom is 3, 4, ... 11; 12 below.
STEPS = (1280000, 640000, 320000, 160000, 80000, 40000, 20000, 10000, 5000)
MAX_ZOOM = 18
#: Zoom up to which tiles that points are looked up in are broadcast: 4^9 / 3 of them at most.
COARSE = 8
ROOTS = 5
MAX_ATTEMPTS, IMAGERY_RETRY_S, FAILED_RETRY_S = 3, 8, 5


def base_zoom(altitude: Column) -> Column:
    return reduce(lambda when, k: when.when(altitude > STEPS[k], 3 + k), range(1, len(STEPS)), F.when(altitude > STEPS[0], 3)).otherwise(3 + len(STEPS))


def _inside(t: Column) -> Column:
    n = F.pow(F.lit(2.0), t["z"])
    return (t["x"] >= 0) & (t["y"] >= 0) & (t["x"] < n) & (t["y"] < n)


def grid(x: Column, y: Column, z: Column, n: int) -> Column:
    """Array of the n × n tiles around a point in metres, without those outside the grid."""
    cx, cy = tm.tile_of_point(x, y, z)
    o = F.sequence(F.lit(-(n // 2)), F.lit(n // 2))
    cells = F.flatten(F.transform(o, lambda i: F.transform(o, lambda j: F.struct(z.cast("int").alias("z"), (cx + i).cast("int").alias("x"), (cy + j).cast("int").alias("y")))))
    return F.filter(cells, _inside)


def root_grid(positions: DataFrame) -> DataFrame:
    """positions (..., x, y, alt) once for each of the 5 × 5 tiles around: tile columns z, tx, ty."""
    g = grid(F.col("x"), F.col("y"), base_zoom(F.col("alt")), ROOTS)
    return positions.select("*", F.explode(g).alias("_t")).select("*", F.col("_t.z").alias("z"), F.col("_t.x").alias("tx"), F.col("_t.y").alias("ty")).drop("_t")


def lod_tiles(positions: DataFrame, keys: list[str], *, max_zoom: int = MAX_ZOOM, factor: float = 900.0, lod: float = 2.2, ground: str | None = None) -> DataFrame:
    """(keys, z, tx, ty): the leaves of refinement from the roots of positions (x, y, alt). A tile is refined while its
    cell, side / 64, seen from the position is more than 16 / lod pixels, and its zoom is below max_zoom. ``ground`` names a
    column with the world height of the ground, else it is 0. The tiles of a batch of roots are refined level by level in
    arrays; it is a narrow step."""
    roots = root_grid(positions).select(*keys, F.col("x").alias("_px"), F.col("y").alias("_py"), (F.col("alt") - (F.col(ground) if ground else F.lit(0.0))).alias("_alt"), "z", "tx", "ty")
    schema = T.StructType([*[roots.schema[k] for k in keys], *[T.StructField(k, T.IntegerType()) for k in ("z", "tx", "ty")]])

    def leaves(it):
        for whole in it:
            for b in (whole.slice(k, 2048) for k in range(0, whole.num_rows, 2048)):
                px, py, alt, z, x, y = (b.column(len(keys) + k).to_numpy(zero_copy_only=False) for k in range(6))
                row, done = np.arange(b.num_rows), []
                while len(row):
                    side = tm.SIDE / np.exp2(z)
                    west, north = x * side - tm.HALF, tm.HALF - y * side
                    dx = px[row] - np.minimum(np.maximum(px[row], west), west + side)
                    dy = py[row] - np.minimum(np.maximum(py[row], north - side), north)
                    more = (z < max_zoom) & (side / 64 / np.maximum(1.0, np.sqrt(dx * dx + dy * dy + alt[row] * alt[row])) * factor > 16 / lod)
                    done.append([v[~more] for v in (row, z, x, y)])
                    row, z, x, y = (np.repeat(v[more], 4) for v in (row, z, x, y))
                    kid = np.arange(len(row)) % 4
                    z, x, y = z + 1, 2 * x + kid % 2, 2 * y + kid // 2
                row, z, x, y = (np.concatenate(v) for v in zip(*done, strict=True))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(len(keys))], *[pa.array(v.astype(np.int32)) for v in (z, x, y)]], names=[*keys, "z", "tx", "ty"])

    return roots.mapInArrow(leaves, schema)


def track_velocity(track: DataFrame, max_gap_s: float = 0.2) -> DataFrame:
    """track with vx, vy: metres a second from the position before. A gap of max_gap_s or more gives zero; a step of no
    time keeps the velocity before; the first position of a track has zero."""
    by = Window.partitionBy("track_id").orderBy("ts", "event_id")
    dt = F.unix_micros("ts") / 1e6 - F.lag(F.unix_micros("ts") / 1e6).over(by)
    step = lambda c: F.when(dt.isNull() | (dt >= max_gap_s), 0.0).when(dt > 0, (F.col(c) - F.lag(c).over(by)) / dt)
    own = track.withColumns({"_vx": step("x"), "_vy": step("y")})
    keep = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return own.withColumns({"vx": keep("_vx"), "vy": keep("_vy")}).drop("_vx", "_vy")


def speed_knots(track: DataFrame) -> DataFrame:
    """(track_id, event_id, knots) of every step that takes time; halves go up."""
    by = Window.partitionBy("track_id").orderBy("ts", "event_id")
    dt = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(by)) / 1e6
    d = F.sqrt(F.pow(F.col("x") - F.lag("x").over(by), 2) + F.pow(F.col("y") - F.lag("y").over(by), 2))
    return track.select("track_id", "event_id", F.when(dt > 0, F.floor(d / dt * 1.94384 + 0.5).cast("long")).alias("knots"))


def prefetch_tiles(moving: DataFrame, keys: list[str], *, lookahead_s: float = 4.0, samples: int = 4, min_speed: float = 50.0, max_zoom: int = MAX_ZOOM) -> DataFrame:
    """(keys, z, tx, ty): tiles ahead of positions (x, y, alt, vx, vy) that move at least at min_speed, at ``samples``
    even steps of the look-ahead, two zooms below the base zoom."""
    fast = moving.where(F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")) >= min_speed)
    z = F.least(base_zoom(F.col("alt")) + 2, F.lit(max_zoom)).cast("int")
    ahead = fast.select("*", z.alias("z"), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("s"))
    t = F.col("s") / samples * lookahead_s
    tx, ty = tm.tile_of_point(F.col("x") + F.col("vx") * t, F.col("y") + F.col("vy") * t, F.col("z"))
    return ahead.select(*keys, "z", tx.alias("tx"), ty.alias("ty")).distinct()


def arrival_zoom(altitude: Column) -> Column:
    return F.when(altitude > 40000, 8).when(altitude > 20000, 9).when(altitude > 10000, 10).when(altitude > 5000, 11).otherwise(12)


def flyto_tiles(targets: DataFrame, keys: list[str], *, above: float = 1500.0, max_zoom: int = MAX_ZOOM) -> DataFrame:
    """(keys, z, tx, ty): the 3 × 3 tiles around targets (x, y, ground) at the arrival's zoom, and the middle's children."""
    z = arrival_zoom(F.col("ground") + above)
    cx, cy = tm.tile_of_point(F.col("x"), F.col("y"), z)
    kids = F.when(z < max_zoom, tm.tile_children(z, cx, cy)).otherwise(F.expr("cast(array() as array<struct<z:int,x:int,y:int>>)"))
    return targets.select(*keys, F.explode(F.concat(grid(F.col("x"), F.col("y"), z, 3), kids)).alias("_t")).select(*keys, F.col("_t.z").alias("z"), F.col("_t.x").alias("tx"), F.col("_t.y").alias("ty"))


def tile_demand_union(*parts: DataFrame) -> DataFrame:
    """(z, x, y), each once."""
    return reduce(DataFrame.unionByName, [p.select("z", "x", "y") for p in parts]).dropDuplicates(TILE)


def prefetch_minus_loaded(tiles: DataFrame, loaded: DataFrame) -> DataFrame:
    return tiles.join(loaded.select(*TILE), TILE, "left_anti")


def _covered(tiles: DataFrame, active: DataFrame) -> DataFrame:
    """Each tile once, with ``covered``: whether it or a tile above is active."""
    a = active.select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lit(True).alias("there")).distinct()
    up = tiles.select(*TILE).distinct().select(*TILE, F.explode(tm.tile_ancestors(F.col("z"), F.col("x"), F.col("y"))).alias("_a"))
    met = up.select(*TILE, F.col("_a.z").alias("az"), F.col("_a.x").alias("ax"), F.col("_a.y").alias("ay")).join(a, ["az", "ax", "ay"], "left")
    return met.groupBy(*TILE).agg(F.coalesce(F.bool_or("there"), F.lit(False)).alias("covered"))


def covered_by_ancestor(tiles: DataFrame, active: DataFrame) -> DataFrame:
    """Tiles of which they or a tile above is active; finer tiles don't count."""
    return _covered(tiles, active).where("covered").select(*TILE)


def coverage_gaps(tiles: DataFrame, active: DataFrame) -> DataFrame:
    """Tiles of which neither they nor a tile above is active. Tiles are made distinct before ancestors are looked up."""
    return _covered(tiles, active).where("not covered").select(*TILE)


def finest_tile_at_point(points: DataFrame, key: str, loaded: DataFrame, max_zoom: int = MAX_ZOOM) -> DataFrame:
    """(key, z, elevation) of the finest loaded tile (z, x, y, elevation) that holds each point (key, px, py) in metres
    and has an elevation; null without one. Tiles up to zoom COARSE, each once, are fewer than 90,000 at any size and are
    broadcast, as all points may lie in few of them. Finer ones are merged, and so is what was found for each point: Spark
    takes a table's size for that of its rows times zooms and would broadcast these."""
    there = loaded.where("elevation is not null").select(*TILE, "elevation")

    def at(low: int, high: int) -> DataFrame:
        p = points.select(key, "px", "py", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("z"))
        x, y = tm.tile_of_point(F.col("px"), F.col("py"), F.col("z"))
        return p.select(key, "z", x.alias("x"), y.alias("y"))

    top = min(COARSE, max_zoom)
    hit = at(0, top).join(F.broadcast(there.where(F.col("z").between(0, top)).dropDuplicates(TILE)), TILE)
    if max_zoom > top:
        hit = hit.unionByName(at(top + 1, max_zoom).hint("merge").join(there.where(F.col("z") > top), TILE))
    best = hit.groupBy(key).agg(F.max("z").alias("z"), F.max_by("elevation", "z").alias("elevation"))
    return points.select(key).join(best.hint("merge"), key, "left")


def request_dedupe(requests: DataFrame) -> DataFrame:
    """(z, x, y, priority): one task for each tile, with the greatest of its priorities."""
    return requests.groupBy(*TILE).agg(F.max("priority").alias("priority"))


def nearest_first(pending: DataFrame, k: int) -> DataFrame:
    """The k tasks of highest priority with their place; equal ones in order of tile. A top-k: each partition keeps k."""
    top = pending.orderBy(F.col("priority").desc(), *TILE).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("priority").desc(), *TILE)))


def latency_quantiles(requests: DataFrame, accuracy: int | None = 10000) -> DataFrame:
    """(cache_state, p50, p95, p99): approximate in bounded memory, or with accuracy None exact, which keeps all distinct
    latencies of a state in one task."""
    q = [0.5, 0.95, 0.99]
    v = F.percentile("latency_ms", F.array(*[F.lit(x) for x in q])) if accuracy is None else F.percentile_approx("latency_ms", q, accuracy)
    return requests.groupBy("cache_state").agg(v.alias("q")).select("cache_state", *[F.col("q")[k].alias(f"p{int(x * 100)}") for k, x in enumerate(q)])


def view_elevation_range(tiles: DataFrame) -> DataFrame:
    """(lo, hi) over visible, loaded tiles that aren't flat; 0 to 4000 where there is no range."""
    seen = tiles.where("visible and loaded and dem_source != 'flat'").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ok = F.col("lo") < F.col("hi")
    return seen.select(F.when(ok, F.col("lo")).otherwise(0.0).alias("lo"), F.when(ok, F.col("hi")).otherwise(4000.0).alias("hi"))


def coverage_counts(tiles: DataFrame) -> DataFrame:
    """(layer, rendered, asked)."""
    return tiles.groupBy("layer").agg(F.count_if(F.col("status") == "ok").alias("rendered"), F.count("*").alias("asked"))


def bundle_bytes(mesh_bytes: Column, textured: Column) -> Column:
    """Bytes of a tile's mesh and, if it has one, its texture of 512 × 512 × 4."""
    return mesh_bytes + F.when(textured, 512 * 512 * 4).otherwise(0)


def imagery_health(states: DataFrame) -> DataFrame:
    """(retrying, gave_up) of tile states (attempts, pending)."""
    return states.agg(F.count_if("pending").alias("retrying"), F.count_if(~F.col("pending") & (F.col("attempts") >= MAX_ATTEMPTS)).alias("gave_up"))


RETRY = "z int, x int, y int, attempts int, pending boolean, retry_after timestamp"


def retry_step(state: tuple, status: int, ts) -> tuple:
    """The rule for one answer to a tile: (attempts, pending, retry_after). 503 is imagery still owed: one attempt more, a
    pause of 8 s, an end after three. Other failures pause for 5 s. Everything else settles the tile, 404 too."""
    import datetime

    attempts, pending, _ = state
    if status == 503:
        attempts += 1
        pending = attempts < MAX_ATTEMPTS
        return attempts, pending, ts + datetime.timedelta(seconds=IMAGERY_RETRY_S) if pending else None
    if status >= 500:
        return attempts, pending, ts + datetime.timedelta(seconds=FAILED_RETRY_S)
    return 0, False, None


def retry_state(requests: DataFrame) -> DataFrame:
    """The state of each tile after all its answers (z, x, y, ts, event_id, http_status) in order of time, in built-in
    expressions: answers after the last that settled the tile count, and the pause is that of the last answer."""
    by = Window.partitionBy(*TILE).orderBy("ts", "event_id")
    settles = F.col("http_status") < 500
    own = requests.withColumn("run", F.sum(F.when(settles, 1).otherwise(0)).over(by))
    last = F.max_by(F.struct("run", "ts", "http_status"), F.struct("ts", "event_id"))
    per = own.groupBy(*TILE, "run").agg(F.count_if(F.col("http_status") == 503).alias("owed"), last.alias("l"), F.max(F.struct("ts", "event_id")).alias("at"))
    g = per.groupBy(*TILE).agg(F.max_by(F.struct("owed", "l"), "at").alias("g")).select(*TILE, "g.owed", "g.l.ts", "g.l.http_status")
    pending = (F.col("owed") > 0) & (F.col("owed") < MAX_ATTEMPTS)
    wait = F.when(F.col("http_status") == 503, F.when(pending, F.col("ts") + F.expr(f"interval {IMAGERY_RETRY_S} seconds"))).when(F.col("http_status") >= 500, F.col("ts") + F.expr(f"interval {FAILED_RETRY_S} seconds"))
    return g.select(*TILE, F.col("owed").cast("int").alias("attempts"), pending.alias("pending"), wait.cast("timestamp").alias("retry_after"))
