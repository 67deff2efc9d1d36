"""Queries on rasters: 8 × 8 tiles from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.functions import raster as px
from tilelake.functions import tilemath as tm
from tilelake.operators import blocks, raster
from tilelake.plans import q_imagery, sql
from tilelake.sources import catalogs, fixtures, scratch


def _folded(spark, sf_dir) -> DataFrame:
    return fixtures.rasters(spark, sf_dir).withColumn("pixels", px.fold_nodata(F.col("pixels")))


def _sources(spark, sf_dir) -> DataFrame:
    """Rasters of three sources that share tiles; zooms of all bands; some reads failed."""
    r = _folded(spark, sf_dir)
    z = F.when(F.col("x") % 4 == 0, 8).when(F.col("x") % 4 == 1, 12).otherwise(15)
    return r.withColumns({"y": F.floor(F.col("y") / 3).cast("int"), "z": z, "status": F.when(F.col("rank") % 37 == 0, "failed").otherwise("ok")})


def _cells(df: DataFrame, *keys: str, name: str = "v") -> DataFrame:
    return df.select(*keys, F.posexplode("pixels").alias("k", name))


def fold_nodata(spark, sf_dir):
    return _cells(_folded(spark, sf_dir), "rank")


def mosaic_first_valid(spark, sf_dir):
    tiles = _folded(spark, sf_dir).withColumn("status", F.lit("ok"))
    return _cells(raster.mosaic_first_valid(tiles), "x", "y")


def mosaic_large(spark, sf_dir):
    """Layers that come in parts, as from blocks, give the same rows: a part has every third place, masked ones left out."""
    tiles = _folded(spark, sf_dir).select("z", "x", "y", "rank", F.posexplode("pixels").alias("k", "v")).where("v is not null")
    parts = tiles.groupBy("z", "x", "y", "rank", F.col("k") % 3).agg(F.collect_list(F.struct("k", "v")).alias("p")).select("z", "x", "y", "rank", F.col("p.k").alias("at"), F.col("p.v").alias("pixels"))
    return _cells(blocks.progressive_mosaic(parts, n_pixels=64), "x", "y")


def _mosaics(spark, sf_dir) -> tuple[DataFrame, dict[str, DataFrame]]:
    s = _sources(spark, sf_dir)
    return s.select("z", "x", "y").distinct(), {n: raster.mosaic_first_valid(s.where(F.col("source") == n)) for n in ("s1m", "usgs13", "farfield")}


def void_fill(spark, sf_dir):
    _, m = _mosaics(spark, sf_dir)
    both = m["s1m"].where(F.col("pixels").isNotNull()).join(m["usgs13"].select("z", "x", "y", F.col("pixels").alias("c")), ["z", "x", "y"])
    return _cells(both.select("z", "x", "y", px.void_fill(F.col("pixels"), F.col("c")).alias("pixels")), "z", "x", "y")


def void_fill_join(spark, sf_dir):
    _, m = _mosaics(spark, sf_dir)
    return _cells(raster.void_fill_join(m["s1m"].where(F.col("pixels").isNotNull()), m["usgs13"].where(F.col("pixels").isNotNull())), "z", "x", "y")


def _cascade(spark, sf_dir) -> DataFrame:
    tiles, m = _mosaics(spark, sf_dir)
    return raster.dem_cascade(tiles, m["s1m"], m["usgs13"], m["farfield"])


def dem_cascade(spark, sf_dir):
    total = F.aggregate(F.col("pixels"), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return _cascade(spark, sf_dir).select("z", "x", "y", "dem_source", "status", F.round(total, 3).alias("total"), F.size(F.filter(F.col("pixels"), lambda v: v.isNull())).cast("long").alias("n_void"))


def dem_source_mix(spark, sf_dir):
    return raster.dem_source_mix(_cascade(spark, sf_dir))


def encode_terrarium(spark, sf_dir):
    cells = _cells(_folded(spark, sf_dir), "rank")
    r, g, b = px.rgb(F.col("code"))
    return cells.select("rank", "k", px.encode_terrarium(F.col("v")).alias("code")).select("rank", "k", r.alias("r"), g.alias("g"), b.alias("b"))


def decode_terrarium(spark, sf_dir):
    c = encode_terrarium(spark, sf_dir)
    return c.select("rank", "k", F.round(px.decode_terrarium(F.col("r"), F.col("g"), F.col("b")), 6).alias("metres"))


def tile_elevation_stats(spark, sf_dir):
    return _folded(spark, sf_dir).select("rank", px.elevation_stats(F.col("pixels"), 8).alias("s")).select("rank", "s.*")


def _children(spark, sf_dir) -> DataFrame:
    """The first raster of each tile as elevation codes; some reads failed."""
    r = _folded(spark, sf_dir).groupBy("z", "x", "y").agg(F.min_by(F.struct("pixels", "rank"), "rank").alias("r")).select("z", "x", "y", "r.*")
    return r.select("z", "x", "y", F.when(F.col("rank") % 37 == 0, "failed").otherwise("ok").alias("status"), F.transform(F.col("pixels"), px.encode_terrarium).alias("pixels"))


def stitch_2x2(spark, sf_dir):
    s = raster.stitch_2x2(_children(spark, sf_dir), 8)
    return s.select("z", "x", "y", "status", F.posexplode_outer("codes").alias("k", "code"))


def block_mosaic(spark, sf_dir):
    r = _folded(spark, sf_dir).groupBy("z", "x", "y").agg(F.min_by("pixels", "rank").alias("pixels"))
    return raster.block_mosaic(r, 8, 2).select(F.col("bx").alias("block_x"), F.col("by").alias("block_y"), "lo", "hi", F.posexplode("pixels").alias("k", "v"))


def composite_white(spark, sf_dir):
    """Colours and alphas from embeddings: pixel i has values 4i .. 4i + 3."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("k", "v"))
    byte = F.pmod(F.floor(F.col("v").cast("double") * 4096), F.lit(256)).cast("int")
    p = e.select("vec_id", F.floor(F.col("k") / 4).cast("int").alias("i"), (F.col("k") % 4).alias("c"), F.when((F.col("k") % 4 == 3) & (F.col("label") == 2), 0).otherwise(byte).alias("v"))
    rgba = p.groupBy("vec_id", "i").agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(n) for c, n in enumerate("rgba")])
    seen = rgba.groupBy("vec_id").agg((F.max("a") > 0).alias("seen"))
    flat = rgba.join(seen, "vec_id")
    return flat.select("vec_id", "i", *[F.when(F.col("seen"), px.composite_white(F.col(n), F.col("a"))).alias(n) for n in "rgb"], F.when(F.col("seen"), "ok").otherwise("no_coverage").alias("status"))


def finest_source_wins(spark, sf_dir):
    """Which asset each pixel of a tile is from; some reads failed."""
    return raster.finest_source_wins(_sources(spark, sf_dir)).select("z", "x", "y", F.posexplode("ranks").alias("k", "rank"))


def select_bands(spark, sf_dir):
    """Bands 1, 2 and 3 of pictures of 16 bands of four pixels."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.posexplode(px.select_bands(F.col("embedding"), 16, (1, 2, 3))).alias("k", "v")).select("vec_id", "k", F.round(F.col("v").cast("double"), 6).alias("v"))


def rescale(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return e.select("vec_id", "k", px.rescale(F.col("v").cast("double"), -0.25, 0.25).alias("v"))


def hillshade(spark, sf_dir):
    """On rasters without voids; they are heights of 0 here."""
    r = _folded(spark, sf_dir).withColumn("pixels", F.transform(F.col("pixels"), lambda v: F.coalesce(v, F.lit(0.0))))
    return r.select("rank", F.posexplode(raster.hillshade(F.col("pixels"), F.col("size"))).alias("k", "shade"))


def downsample_2x2(spark, sf_dir):
    r = _folded(spark, sf_dir).withColumn("pixels", F.transform(F.col("pixels"), lambda v: F.pmod(F.floor(F.coalesce(v, F.lit(0.0))), F.lit(256)).cast("double")))
    return r.select("rank", F.posexplode(raster.downsample_2x2(F.col("pixels"), F.col("size"))).alias("k", "v"))


def _grids(spark, sf_dir) -> DataFrame:
    return raster.surface_grid(_folded(spark, sf_dir), step=2)


def surface_grid(spark, sf_dir):
    cols = ["xs", "ys", "zs", "nx", "ny", "nz"]
    g = _grids(spark, sf_dir).select("rank", F.posexplode(F.arrays_zip(*cols)).alias("k", "p"))
    return g.select("rank", "k", *[F.round(F.col(f"p.{c}") + 0.0, 6).alias(c) for c in cols])


def ground_at(spark, sf_dir):
    r = _folded(spark, sf_dir)
    u, v = F.col("rank") % 11 / 10, F.col("rank") % 7 / 6
    return r.select("rank", px.ground_at(F.col("pixels"), F.col("size"), u, v).alias("ground"))


def vertical_exaggeration(spark, sf_dir):
    cells = _folded(spark, sf_dir).select("rank", "y", F.posexplode("pixels").alias("k", "v"))
    lat = F.col("y") / 400.0
    return cells.select("rank", "k", F.round(px.exaggerated(F.col("v"), 100.0, 2.0, lat), 6).alias("world"))


def _asset_pairs(spark, sf_dir) -> DataFrame:
    """Each raster as the grid of an asset in degrees around a tile, a little shifted, and that tile."""
    r = fixtures.rasters(spark, sf_dir)
    w, s, e, n = tm.tile_bounds_lonlat(F.col("z"), F.col("x"), F.col("y"))
    shift = F.col("rank") % 5 / 10 * (e - w)
    return r.select("z", "x", "y", "rank", F.col("rank").alias("id"), (w + shift).alias("x0"), n.alias("y0"), ((e - w) / 8).alias("dx"), ((s - n) / 8).alias("dy"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(4326).alias("crs"), F.lit(px.VOID).alias("nodata"), "pixels")


def warp_to_tile(spark, sf_dir):
    """Pictures of 8 × 8 pixels in blocks of 3 × 3."""
    pairs = _asset_pairs(spark, sf_dir)
    w = blocks.warp_to_tile(pairs, blocks.cut_blocks(pairs, 3).drop("band"), 8, 3)
    return w.select("rank", "status", F.posexplode("pixels").alias("k", "v"))


#: Pixels of a side of a baked tile, of an asset's band and of a block, bands of an asset.
SIZE, ASSET, BLOCK, BANDS = 4, 4, 3, 4


def _pictures(spark, sf_dir) -> DataFrame:
    """(id, x0, y0, dx, dy, width, height, crs, nodata, pixels): the picture of each imagery item, four bands in its box."""
    i = fixtures.imagery(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: F.when(F.abs(v) < 0.01, px.VOID).otherwise(F.round(v.cast("double") * 100, 3))).alias("pixels"))
    own = i.withColumn("vec_id", F.substring_index("id", "_", -1).cast("long") % 200).join(e, "vec_id")
    dx, dy = (F.col("xmax") - F.col("xmin")) / ASSET, (F.col("ymin") - F.col("ymax")) / ASSET
    return own.select("id", F.col("xmin").alias("x0"), F.col("ymax").alias("y0"), dx.alias("dx"), dy.alias("dy"), F.lit(ASSET).alias("width"), F.lit(ASSET).alias("height"), F.lit(4326).alias("crs"), F.lit(px.VOID).alias("nodata"), "pixels")


def bake_imagery(resolved: DataFrame, grids: DataFrame, blocks_: DataFrame, size: int, block: int, picks: tuple[int, ...]) -> DataFrame:
    """(z, x, y, band, status, pixels) of resolved tiles (z, x, y, status, rank, id, ...): the picked bands of their assets,
    from the blocks that a tile touches, merged in rank order. A tile without an asset keeps its status; one whose assets
    have no pixel in it has no coverage. The band of a tile without assets is 0."""
    pairs = resolved.where("id is not null").select("z", "x", "y", F.col("rank").cast("long").alias("rank"), "id").join(grids, "id")
    pairs = pairs.withColumn("band", F.explode(F.array(*[F.lit(b) for b in picks])))
    parts = blocks.warped_parts(pairs, blocks_, size, block, ["band"])
    merged = blocks.progressive_mosaic(parts, ["z", "x", "y", "band"], size * size)
    done = merged.select("z", "x", "y", "band", F.when(F.col("pixels").isNull(), "no_coverage").otherwise("ok").alias("status"), "pixels")
    rest = resolved.where("id is null").select("z", "x", "y", F.lit(0).alias("band"), "status", F.lit(None).cast("array<double>").alias("pixels"))
    return done.unionByName(rest)


def _baked(spark, sf_dir) -> tuple[DataFrame, str, str]:
    """Asked tiles → assets → blocks of their pictures, bands 1 to 3 → warp → mosaic in rank order → tile table and manifest:
    the baked rows and the paths of both."""
    resolved = scratch.written(q_imagery.job_resolve_imagery(spark, sf_dir), "resolved")
    pictures = _pictures(spark, sf_dir)
    cut = scratch.written(blocks.cut_blocks(pictures, BLOCK, BANDS), "blocks")
    baked = scratch.written(bake_imagery(resolved, pictures.drop("pixels"), cut, SIZE, BLOCK, (1, 2, 3)), "baked").withColumns({"layer": F.lit("naip"), "year": F.lit(q_imagery.YEAR)})
    tiles, manifest = scratch.new_folder(spark, "tiles"), scratch.new_folder(spark, "manifest")
    catalogs.write_tile_table(baked, tiles)
    catalogs.bake_manifest(baked.where("status = 'ok'")).write.parquet(manifest)
    return baked, tiles, manifest


def job_bake_imagery(spark, sf_dir):
    """The tile table, read back; tiles that aren't in it keep a row with their status."""
    baked, path, _ = _baked(spark, sf_dir)
    back = spark.read.schema("layer string, year int, z int, x int, y int, band int, status string, pixels array<double>").parquet(path)
    total = F.round(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), 3)
    seen = F.size(F.filter("pixels", lambda v: v.isNotNull())).cast("long")
    cols = ["z", "x", "y", "band", "status"]
    return back.select(*cols, seen.alias("n"), total.alias("total")).unionByName(baked.where("status != 'ok'").select(*cols, F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("total")))


def bake_imagery_manifest(spark, sf_dir):
    """The manifest that the imagery job writes, read back."""
    m = spark.read.parquet(_baked(spark, sf_dir)[2])
    return m.withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})


def write_tile_table(spark, sf_dir):
    """Cascaded tiles written by zoom and read back; tiles that failed or have no coverage aren't there."""
    path = scratch.new_folder(spark, "tiles")
    catalogs.write_tile_table(_cascade(spark, sf_dir).withColumns({"layer": F.lit("terrain"), "year": F.lit(0)}), path)
    return spark.read.schema("layer string, year int, z int, x int, y int, dem_source string, status string").parquet(path).select("z", "x", "y", "dem_source", "status")


def bake_manifest(spark, sf_dir):
    m = catalogs.bake_manifest(_cascade(spark, sf_dir).where("status = 'ok'").withColumns({"layer": F.lit("terrain"), "year": F.lit(0)}))
    return m.withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})


def job_bake_terrain(spark, sf_dir):
    """Cascade → codes → statistics, written and read back."""
    c = _cascade(spark, sf_dir)
    codes = F.transform(F.col("pixels"), px.encode_terrarium)
    t = c.select("z", "x", "y", "dem_source", "status", codes.alias("codes"), px.elevation_stats(F.col("pixels"), 8).alias("s"), F.lit("terrain").alias("layer"), F.lit(0).alias("year"))
    path = scratch.new_folder(spark, "terrain")
    catalogs.write_tile_table(t, path)
    back = spark.read.schema("layer string, year int, z int, x int, y int, dem_source string, codes array<int>, s struct<lo:double,hi:double,mid:double>").parquet(path)
    return back.select("z", "x", "y", "dem_source", F.aggregate("codes", F.lit(0).cast("long"), lambda a, v: a + v).alias("code_sum"), "s.lo", "s.hi", "s.mid")


_b = sql.box()


def _centres(size: int) -> str:
    """From pr (a tile and a grid x0, y0, dx, dy in degrees): row r and column c of the grid at each of the tile's pixels k."""
    at = lambda v: f"(({v} + 0.5e0) / {size} * {sql.side('z')})"
    lon, lat = sql.lon(f"(x * {sql.side('z')} - {sql.HALF_} + {at('(k % ' + str(size) + ')')})"), sql.lat(f"({sql.HALF_} - y * {sql.side('z')} - {at('(k // ' + str(size) + ')')})")
    return f"SELECT *, floor(({lon} - x0) / dx) AS c, floor(({lat} - y0) / dy) AS r FROM (SELECT *, unnest(range(0, {size * size})) AS k FROM pr) p_"


_FOLD = "SELECT z, x, y, source, rank, list_transform(pixels, lambda v: CASE WHEN v = -999999e0 THEN NULL ELSE v END) AS pixels FROM fx_rasters"
_CELL = "SELECT z, x, y, source, rank, CAST(k AS INT) AS k, pixels[k + 1] AS v FROM (SELECT *, unnest(range(0, 64)) AS k FROM folded) t"
_F = sql.with_("fx_rasters", folded=_FOLD, cell=_CELL)
_SRC = "SELECT CASE x % 4 WHEN 0 THEN 8 WHEN 1 THEN 12 ELSE 15 END AS z, x, CAST(y // 3 AS INT) AS y, source, rank, k, v, rank % 37 = 0 AS bad FROM cell"
_MOS = "SELECT z, x, y, source, k, arg_min(v, rank) FILTER (v IS NOT NULL AND NOT bad) AS v, bool_or(bad) AS bad FROM src GROUP BY z, x, y, source, k"
_ANY = "SELECT z, x, y, source, bool_or(v IS NOT NULL) AS there, bool_or(v IS NULL) AS torn, bool_or(bad) AS bad FROM mos GROUP BY z, x, y, source"
_TIER = ", ".join(f"coalesce(bool_or({c}) FILTER (source = '{s}'), false) AS {s}_{c}" for s in ("s1m", "usgs13", "farfield") for c in ("there", "torn", "bad"))
_PLAN = f"""SELECT *, CASE WHEN fine AND coalesce(s1m_there, false) THEN 's1m' WHEN coarse AND usgs13_there THEN 'usgs13' WHEN farfield_there THEN 'farfield' END AS src,
  (fine AND s1m_bad) OR (fine AND s1m_there AND coarse AND s1m_torn AND usgs13_bad) OR (NOT (fine AND s1m_there) AND coarse AND usgs13_bad)
    OR (NOT (fine AND s1m_there) AND NOT (coarse AND usgs13_there) AND farfield_bad) AS broken
  FROM (SELECT z, x, y, z >= 15 AS fine, z >= 11 AS coarse, {_TIER} FROM anyt GROUP BY z, x, y) t"""
_CAS = """SELECT p.z, p.x, p.y, k, CASE WHEN NOT broken THEN src END AS dem_source, CASE WHEN broken THEN 'failed' WHEN src IS NULL THEN 'no_coverage' ELSE 'ok' END AS status,
  CASE WHEN broken THEN NULL WHEN src = 's1m' THEN coalesce(max(v) FILTER (m.source = 's1m'), CASE WHEN p.coarse THEN max(v) FILTER (m.source = 'usgs13') END)
       WHEN src = 'usgs13' THEN max(v) FILTER (m.source = 'usgs13') ELSE max(v) FILTER (m.source = 'farfield') END AS v
  FROM plan p JOIN mos m ON m.z = p.z AND m.x = p.x AND m.y = p.y GROUP BY p.z, p.x, p.y, k, src, broken, p.coarse"""
_C = sql.with_("fx_rasters", folded=_FOLD, cell=_CELL, src=_SRC, mos=_MOS, anyt=_ANY, plan=_PLAN, cas=_CAS)
_CODE = "CAST(round_even(least(greatest((coalesce(v, 0) + 32768e0) * 256e0, 0), 16777215), 0) AS INT)"
_FIRST = "SELECT z, x, y, k, arg_min(coalesce(v, -1e9), rank) AS v0, min(rank) AS rank FROM cell GROUP BY z, x, y, k"
_KID = f"SELECT z, x, y, k, CASE WHEN v0 = -1e9 THEN NULL ELSE v0 END AS v, rank % 37 = 0 AS bad FROM ({_FIRST}) f"
_h = lambda i, j: f"max(v) FILTER (k = ({i}) * 8 + ({j}))"
_LON = f"round({sql.lon(f'(x0 + x1 + 1) / 2e0 * {sql.side('z')} - {sql.HALF_}')}, 6) AS lon, round({sql.lat(f'{sql.HALF_} - (y0 + y1 + 1) / 2e0 * {sql.side('z')}')}, 6) AS lat"
_at = lambda k: f"coalesce(pixels[{k} + 1], 0)"
_GRAD = f"""SELECT rank, CAST(k AS INT) AS k, ({_at('k + r')} - {_at('k - l')}) / (r + l) AS dx, ({_at('k + 8 * d')} - {_at('k - 8 * u')}) / (d + u) AS dy FROM (
  SELECT rank, pixels, k, CASE WHEN k % 8 < 7 THEN 1 ELSE 0 END AS r, CASE WHEN k % 8 > 0 THEN 1 ELSE 0 END AS l, CASE WHEN k // 8 < 7 THEN 1 ELSE 0 END AS d, CASE WHEN k // 8 > 0 THEN 1 ELSE 0 END AS u
  FROM (SELECT rank, pixels, unnest(range(0, 64)) AS k FROM folded) a) b"""
_FLAT = "SELECT rank, z, y, k, coalesce(v, 0) AS v FROM cell"
_VERT = """SELECT g.rank, g.z, g.y, r.r * 5 + c.c AS k, r.r AS row, c.c AS col, (SELECT v FROM flat f WHERE f.rank = g.rank AND f.k = least(r.r * 2, 7) * 8 + least(c.c * 2, 7)) AS h
  FROM (SELECT DISTINCT rank, z, y FROM flat) g, (SELECT unnest(range(0, 5)) AS r) r, (SELECT unnest(range(0, 5)) AS c) c"""
_SLOPE = f"""SELECT a.rank, a.k, a.row, a.col, a.h, {sql.side('a.z')} AS side, cosh(({sql.HALF_} - (a.y + 0.5e0) * {sql.side('a.z')}) / {sql.R_}) AS sc,
    (e.h - w.h) / ((e.col - w.col) * {sql.side('a.z')} / (4 * cosh(({sql.HALF_} - (a.y + 0.5e0) * {sql.side('a.z')}) / {sql.R_}))) AS sx,
    (n.h - s.h) / ((s.row - n.row) * {sql.side('a.z')} / (4 * cosh(({sql.HALF_} - (a.y + 0.5e0) * {sql.side('a.z')}) / {sql.R_}))) AS sy
  FROM vert a JOIN vert e ON e.rank = a.rank AND e.row = a.row AND e.col = least(a.col + 1, 4) JOIN vert w ON w.rank = a.rank AND w.row = a.row AND w.col = greatest(a.col - 1, 0)
  JOIN vert s ON s.rank = a.rank AND s.col = a.col AND s.row = least(a.row + 1, 4) JOIN vert n ON n.rank = a.rank AND n.col = a.col AND n.row = greatest(a.row - 1, 0)"""
_RGBA = """SELECT vec_id, label, i, CAST(((CAST(floor(CAST(embedding[4 * i + c + 1] AS DOUBLE) * 4096) AS BIGINT) % 256) + 256) % 256 AS INT) AS v, c
  FROM (SELECT *, unnest(range(0, 4)) AS c FROM (SELECT *, unnest(range(0, 16)) AS i FROM embeddings) a) b"""
_over = lambda n: f"CASE WHEN seen THEN CAST(({n} * a + 255 * (255 - a)) // 255 AS INT) END AS {n}"
_BAKED = (
    q_imagery.RESOLVED.rstrip()
    + f""",
pic AS (SELECT id, xmin AS x0, ymax AS y0, (xmax - xmin) / 4 AS dx, (ymin - ymax) / 4 AS dy, list_transform(embedding, lambda v: CASE WHEN abs(v) < 0.01e0 THEN NULL ELSE round(CAST(v AS DOUBLE) * 100, 3) END) AS pixels
  FROM items JOIN embeddings ON vec_id = CAST(split_part(id, '_', 2) AS BIGINT) % 200),
pr AS (SELECT z, x, y, rank, p.* FROM resolved JOIN pic p USING (id)),
spot AS ({_centres(4)}),
cell AS (SELECT z, x, y, band, k, rank, CASE WHEN r BETWEEN 0 AND 3 AND c BETWEEN 0 AND 3 THEN pixels[CAST((band - 1) * 16 + r * 4 + c AS INT) + 1] END AS v FROM spot, (VALUES (1), (2), (3)) b(band)),
mos AS (SELECT z, x, y, band, k, arg_min(v, rank) FILTER (v IS NOT NULL) AS v FROM cell GROUP BY z, x, y, band, k)
"""
)

QUERIES = {
    "fold_nodata": (fold_nodata, _F + "SELECT rank, k, v FROM cell"),
    "mosaic_first_valid": (mosaic_first_valid, _F + "SELECT x, y, k, arg_min(v, rank) FILTER (v IS NOT NULL) AS v FROM cell GROUP BY x, y, k"),
    "mosaic_large": (mosaic_large, _F + "SELECT x, y, k, arg_min(v, rank) FILTER (v IS NOT NULL) AS v FROM cell GROUP BY x, y, k"),
    "void_fill": (void_fill, _C + "SELECT a.z, a.x, a.y, a.k, coalesce(a.v, c.v) AS v FROM mos a JOIN mos c ON c.source = 'usgs13' AND a.source = 's1m' AND a.z = c.z AND a.x = c.x AND a.y = c.y AND a.k = c.k JOIN anyt t ON t.source = 's1m' AND t.z = a.z AND t.x = a.x AND t.y = a.y AND t.there"),
    "void_fill_join": (void_fill_join, _C + "SELECT a.z, a.x, a.y, a.k, coalesce(a.v, c.v) AS v FROM mos a JOIN anyt t ON a.source = 's1m' AND t.source = 's1m' AND t.z = a.z AND t.x = a.x AND t.y = a.y AND t.there LEFT JOIN mos c ON c.source = 'usgs13' AND a.z = c.z AND a.x = c.x AND a.y = c.y AND a.k = c.k"),
    "dem_cascade": (dem_cascade, _C + "SELECT z, x, y, dem_source, status, CASE WHEN status = 'ok' THEN round(sum(coalesce(v, 0)), 3) END AS total, CASE WHEN status = 'ok' THEN count(*) FILTER (v IS NULL) END AS n_void FROM cas GROUP BY z, x, y, dem_source, status"),
    "dem_source_mix": (dem_source_mix, _C + "SELECT coalesce(dem_source, 'flat') AS dem_source, count(*) AS tiles FROM cas WHERE k = 0 GROUP BY 1"),
    "encode_terrarium": (encode_terrarium, _F + f"SELECT rank, k, c >> 16 AS r, (c >> 8) & 255 AS g, c & 255 AS b FROM (SELECT rank, k, {_CODE} AS c FROM cell) t"),
    "decode_terrarium": (decode_terrarium, _F + f"SELECT rank, k, round({_CODE} / 256e0 - 32768e0, 6) AS metres FROM cell"),
    "tile_elevation_stats": (tile_elevation_stats, _F + "SELECT rank, coalesce(min(v), 0) AS lo, coalesce(max(v), 0) AS hi, coalesce(max(v) FILTER (k = 36), 0) AS mid FROM cell GROUP BY rank"),
    "stitch_2x2": (
        stitch_2x2,
        sql.with_("fx_rasters", folded=_FOLD, cell=_CELL, kid=_KID, par="SELECT z, x >> 1 AS px, y >> 1 AS py, bool_or(bad) AS bad FROM kid GROUP BY 1, 2, 3")
        + f"""SELECT p.z - 1 AS z, px AS x, py AS y, CASE WHEN p.bad THEN 'failed' ELSE 'ok' END AS status, CAST(q AS INT) AS k, coalesce(c.code, CASE WHEN q IS NOT NULL THEN 8388608 END) AS code
  FROM par p LEFT JOIN (SELECT unnest(range(0, 256)) AS q) g ON NOT p.bad
  LEFT JOIN (SELECT x, y, k, {_CODE} AS code FROM kid) c ON c.x = 2 * px + (q % 16) // 8 AND c.y = 2 * py + q // 128 AND c.k = ((q // 16) % 8) * 8 + q % 8""",
    ),
    "block_mosaic": (
        block_mosaic,
        sql.with_("fx_rasters", folded=_FOLD, cell=_CELL, kid=_KID, par="SELECT x // 2 AS block_x, y // 2 AS block_y, coalesce(min(v) FILTER (v > 0), 0) AS lo, coalesce(max(v) FILTER (v > 0), 0) AS hi FROM kid GROUP BY 1, 2")
        + "SELECT CAST(block_x AS INT) AS block_x, CAST(block_y AS INT) AS block_y, lo, hi, CAST(q AS INT) AS k, coalesce(c.v, 0) AS v FROM par, (SELECT unnest(range(0, 256)) AS q) g LEFT JOIN kid c ON c.x = 2 * block_x + (q % 16) // 8 AND c.y = 2 * block_y + q // 128 AND c.k = ((q // 16) % 8) * 8 + q % 8",
    ),
    "composite_white": (
        composite_white,
        sql.with_(p="SELECT vec_id, i, c, CASE WHEN c = 3 AND label = 2 THEN 0 ELSE v END AS v FROM (" + _RGBA + ") r", q="SELECT vec_id, i, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b, max(v) FILTER (c = 3) AS a FROM p GROUP BY vec_id, i", s="SELECT *, max(a) OVER (PARTITION BY vec_id) > 0 AS seen FROM q")
        + f"SELECT vec_id, CAST(i AS INT) AS i, {_over('r')}, {_over('g')}, {_over('b')}, CASE WHEN seen THEN 'ok' ELSE 'no_coverage' END AS status FROM s",
    ),
    "finest_source_wins": (finest_source_wins, _F + "SELECT z, x, y, CAST(k AS INT) AS k, min(rank) FILTER (v IS NOT NULL) AS rank FROM (" + _SRC + ") s WHERE NOT bad GROUP BY z, x, y, k"),
    "select_bands": (select_bands, "SELECT vec_id, CAST(k AS INT) AS k, round(CAST(embedding[k + 1] AS DOUBLE), 6) AS v FROM (SELECT *, unnest(range(0, 12)) AS k FROM embeddings) t"),
    "rescale": (rescale, "SELECT vec_id, CAST(k AS INT) AS k, CAST(floor(least(greatest((CAST(embedding[k + 1] AS DOUBLE) + 0.25e0) / 0.5e0, 0), 1) * 255) AS INT) AS v FROM (SELECT *, unnest(range(0, 64)) AS k FROM embeddings) t"),
    "hillshade": (
        hillshade,
        sql.with_("fx_rasters", folded=_FOLD, grad=_GRAD)
        + "SELECT rank, k, CAST(floor(least(greatest((sin(radians(45e0)) + cos(radians(45e0)) * (dy * cos(radians(315e0)) - dx * sin(radians(315e0)))) / sqrt(1 + dx * dx + dy * dy), 0), 1) * 255) AS INT) AS shade FROM grad",
    ),
    "downsample_2x2": (
        downsample_2x2,
        sql.with_("fx_rasters", folded=_FOLD, cell=_CELL) + "SELECT rank, CAST((k // 16) * 4 + (k % 8) // 2 AS INT) AS k, CAST(floor(sum(b) / 4) AS INT) AS v FROM (SELECT rank, k, ((CAST(floor(coalesce(v, 0)) AS BIGINT) % 256) + 256) % 256 AS b FROM cell) t GROUP BY 1, 2",
    ),
    "surface_grid": (
        surface_grid,
        sql.with_("fx_rasters", folded=_FOLD, cell=_CELL, flat=_FLAT, vert=_VERT, slope=_SLOPE)
        + "SELECT rank, CAST(k AS INT) AS k, round(col / 4e0 * side, 6) AS xs, round(-row / 4e0 * side + 0e0, 6) AS ys, round(h * sc, 6) AS zs, round(-sx / sqrt(sx * sx + sy * sy + 1) + 0e0, 6) AS nx, round(-sy / sqrt(sx * sx + sy * sy + 1) + 0e0, 6) AS ny, round(1 / sqrt(sx * sx + sy * sy + 1), 6) AS nz FROM slope",
    ),
    "ground_at": (ground_at, _F + "SELECT rank, v AS ground FROM cell WHERE k = floor((rank % 7) / 6e0 * 7 + 0.5e0) * 8 + floor((rank % 11) / 10e0 * 7 + 0.5e0)"),
    "vertical_exaggeration": (vertical_exaggeration, _F + "SELECT rank, k, round(((v - 100e0) * 2e0 + 100e0) / cos(radians(y / 400e0)), 6) AS world FROM cell"),
    "warp_to_tile": (
        warp_to_tile,
        sql.with_("fx_rasters", box=f"SELECT *, {_b[0]} AS w, {_b[1]} AS s, {_b[2]} AS e, {_b[3]} AS n FROM fx_rasters", pr="SELECT z, x, y, rank, pixels, w + rank % 5 / 10e0 * (e - w) AS x0, n AS y0, (e - w) / 8 AS dx, (s - n) / 8 AS dy FROM box", spot=_centres(8))
        + "SELECT rank, 'ok' AS status, CAST(k AS INT) AS k, v FROM (SELECT rank, k, CASE WHEN r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7 THEN nullif(pixels[CAST(r * 8 + c AS INT) + 1], -999999e0) END AS v FROM spot) t QUALIFY count(v) OVER (PARTITION BY rank) > 0",
    ),
    "write_tile_table": (write_tile_table, _C + "SELECT z, x, y, dem_source, status FROM cas WHERE k = 0 AND status = 'ok'"),
    "bake_manifest": (
        bake_manifest,
        _C.rstrip() + ",\nm AS (SELECT z, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cas WHERE status = 'ok' GROUP BY z)\n" + f"SELECT 'terrain' AS layer, 0 AS year, z, x0, x1, y0, y1, {_LON} FROM m",
    ),
    "job_bake_imagery": (
        job_bake_imagery,
        _BAKED
        + """SELECT z, x, y, band, CASE WHEN count(v) = 0 THEN 'no_coverage' ELSE 'ok' END AS status, count(v) AS n, round(sum(v), 3) AS total FROM mos GROUP BY z, x, y, band
UNION ALL SELECT z, x, y, 0, status, 0, NULL FROM resolved WHERE id IS NULL""",
    ),
    "bake_imagery_manifest": (
        bake_imagery_manifest,
        _BAKED.rstrip() + ",\nm AS (SELECT z, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM mos WHERE v IS NOT NULL GROUP BY z)\n" + f"SELECT 'naip' AS layer, {q_imagery.YEAR} AS year, z, x0, x1, y0, y1, {_LON} FROM m",
    ),
    "job_bake_terrain": (
        job_bake_terrain,
        _C + f"SELECT z, x, y, dem_source, CAST(sum({_CODE}) AS BIGINT) AS code_sum, coalesce(min(v), 0) AS lo, coalesce(max(v), 0) AS hi, coalesce(max(v) FILTER (k = 36), 0) AS mid FROM cas WHERE status = 'ok' GROUP BY z, x, y, dem_source",
    ),
}
