"""Which imagery items build a tile: newest vintage of each region, then finest resolution.

The spatial join is an equality join on grid cells. A tile whose zoom is at least the grid's has one ancestor cell, so
only footprints are spread over cells and each pair appears once. Cells cover the footprint's box with a margin, so an
item that only touches a tile's edge is found too; the box and the exact ring decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilelake.functions import geometry
from tilelake.functions import tilemath as tm

#: Zoom of the grid: about the size of a quarter quad.
GRID = 11
#: Zooms that a tile coarser than the grid goes down to meet items: 256 cells of it.
DEPTH = 4
MARGIN = 1e-9
CAP = 64

#: Fixed names: buckets whose readers pay.
PAID = ["naip-analytic", "naip-visualization", "naip-stac-catalog"]


def asset_href(assets: Column) -> Column:
    return F.coalesce(F.get_json_object(assets, "$.data.href"), F.get_json_object(assets, "$.visual.href"))


def asset_gsd(properties: Column) -> Column:
    return F.get_json_object(properties, "$.gsd").try_cast("double")


def href_bucket(href: Column) -> Column:
    return F.regexp_extract(href, "s3://([^/]+)", 1)


def requester_pays(bucket: Column) -> Column:
    return bucket.isin(PAID)


def asset_bucket_filter(items: DataFrame, href: str = "href", bucket: str = "naip-visualization") -> DataFrame:
    """Items whose href is in the bucket; a null href drops out."""
    return items.where(F.col(href).like(f"s3://{bucket}/%"))


def region_extents(items: DataFrame) -> DataFrame:
    """(region, rxmin, rymin, rxmax, rymax)."""
    return items.groupBy("region").agg(F.min("xmin").alias("rxmin"), F.min("ymin").alias("rymin"), F.max("xmax").alias("rxmax"), F.max("ymax").alias("rymax"))


def with_box(tiles: DataFrame) -> DataFrame:
    """tiles with their bounds in degrees: w, s, e, n. inline keeps the expressions from being repeated where these are used."""
    box = tm.tile_bounds_lonlat(F.col("z"), F.col("x"), F.col("y"))
    return tiles.select("*", F.inline(F.array(F.struct(*[c.alias(k) for c, k in zip(box, "wsen", strict=True)]))))


def region_prune(tiles: DataFrame, extents: DataFrame) -> DataFrame:
    """(z, x, y, region): the regions whose extent meets the tile; touching counts."""
    t = with_box(tiles.select("z", "x", "y"))
    return geometry.join_boxes(t, extents, tuple("wsen"), ("rxmin", "rymin", "rxmax", "rymax")).select("z", "x", "y", "region")


def newest_vintage(items: DataFrame, year: int) -> DataFrame:
    """Items of each region's newest year that is at most ``year``. The newest year is the region's, whatever the tile. These
    years, a row for each region, are broadcast: items dealt by region and year would be a few tasks' work."""
    newest = items.where(F.col("year") <= year).groupBy("region").agg(F.max("year").alias("year"))
    return items.join(F.broadcast(newest), ["region", "year"], "left_semi")


def in_cells(items: DataFrame, zoom: Column) -> DataFrame:
    """items once for each tile of a zoom that their box meets: cx, cy; _ileft and _itop say whether it is in the first
    column and row of them."""
    w, s, e, n = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    x0, y0 = tm.tile_of_point(*tm.lonlat_to_merc(w - MARGIN, n + MARGIN), zoom)
    x1, y1 = tm.tile_of_point(*tm.lonlat_to_merc(e + MARGIN, s - MARGIN), zoom)
    return _spread(items, x0, x1, y0, y1, "_ileft", "_itop")


def _spread(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, left: str, top: str) -> DataFrame:
    """Rows of df once for each cell of a block: cx, cy, and whether it is in the block's first column and row."""
    corners = F.struct(x0.alias("_x0"), x1.alias("_x1"), y0.alias("_y0"), y1.alias("_y1"))
    cells = df.select("*", F.inline(F.array(corners))).withColumn("cx", F.explode(F.sequence("_x0", "_x1"))).withColumn("cy", F.explode(F.sequence("_y0", "_y1")))
    return cells.withColumns({left: F.col("cx") == F.col("_x0"), top: F.col("cy") == F.col("_y0")}).drop("_x0", "_x1", "_y0", "_y1")


def tiles_x_imagery(tiles: DataFrame, items: DataFrame, grid: int = GRID, exact: bool = True) -> DataFrame:
    """(z, x, y) of tiles joined to all columns of the items whose ring meets the tile, touching included; with
    exact=False, to those whose box does. Tiles from zoom ``grid`` on meet items in their ancestor at that zoom, coarser
    ones in their descendants DEPTH zooms down, at most at the grid's, so that a tile's items are in many cells; a pair is
    kept in the first cell that both have. Items are spread over the zooms that the tiles' cells have."""
    own = items.withColumn("_edges", geometry.edges(F.col("ring"))) if exact else items
    z, x, y = (F.col(c) for c in ("z", "x", "y"))
    level = F.least(z + DEPTH, F.lit(grid)).cast("int")
    there = tiles.select("z", "x", "y", level.alias("_level"))
    up, down = F.greatest(z - F.col("_level"), F.lit(0)), F.greatest(F.col("_level") - z, F.lit(0))
    first = lambda v: F.call_function("shiftleft", tm.shifted(v, up), down)
    last = lambda v: first(v) + F.call_function("shiftleft", F.lit(1), down) - 1
    asked = _spread(with_box(there), first(x), last(x), first(y), last(y), "_left", "_top")
    levels = there.agg(F.collect_set("_level").alias("levels")).scalar()  # at most grid + 1 numbers
    spread = in_cells(own.withColumn("_level", F.explode(levels)), F.col("_level"))
    both = asked.join(spread, ["_level", "cx", "cy"]).where((F.col("_left") | F.col("_ileft")) & (F.col("_top") | F.col("_itop")))
    box = tuple(F.col(c) for c in "wsen")
    pairs = both.where(geometry.bbox_meets(tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")), box))
    if exact:
        pairs = pairs.where(geometry.edges_meet_box(F.col("_edges"), *box))
    return pairs.drop("_level", "cx", "cy", "_left", "_top", "_ileft", "_itop", "_edges", *"wsen")


def rank_assets(pairs: DataFrame, cap: int = CAP) -> DataFrame:
    """pairs (z, x, y, year, gsd, id, ...) with rank: newest year first, then finest, then id; the first ``cap`` of a tile."""
    order = Window.partitionBy("z", "x", "y").orderBy(F.col("year").desc(), F.col("gsd").asc_nulls_last(), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def assets_per_tile(pairs: DataFrame) -> DataFrame:
    """(z, tiles, most, average): footprints of a tile by zoom."""
    return pairs.groupBy("z", "x", "y").agg(F.count("*").alias("n")).groupBy("z").agg(F.count("*").alias("tiles"), F.max("n").alias("most"), F.avg("n").alias("average"))
