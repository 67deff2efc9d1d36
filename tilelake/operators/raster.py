"""Raster operators on tile tables: one row for each (tile, asset) with an array of pixels, null = masked.

A failed read is a status of its own and is never taken for a missing one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tilelake.functions import raster as px
from tilelake.functions import tilemath as tm
from tilelake.operators import blocks

FINE_MIN, COARSE_MIN = 15, 11
TILE = ["z", "x", "y"]


def mosaic_first_valid(tiles: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """(keys, pixels, failed): the first valid value of each pixel in rank order. pixels is null where no pixel of any
    asset is valid; failed tells of assets with status failed. One fold for arrays of all sizes, see ``blocks``."""
    return blocks.progressive_mosaic(tiles, keys)


def finest_source_wins(tiles: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """(keys, ranks): for each pixel the rank of the asset that shows there, the first in rank order with a valid value;
    null where none has one. Failed assets show nowhere."""
    ok = F.when((F.col("status") != "failed") & F.col("pixels").isNotNull(), F.struct("rank", "pixels"))
    merged = tiles.groupBy(*keys).agg(F.collect_list(ok).alias("layers"))
    return merged.where(F.size("layers") > 0).select(*keys, px.first_source(F.col("layers")).alias("ranks"))


def dem_cascade(tiles: DataFrame, fine: DataFrame, coarse: DataFrame, far: DataFrame) -> DataFrame:
    """(z, x, y, pixels, dem_source, status) of tiles from mosaics (z, x, y, pixels, failed) of three sources.

    From zoom 15 the fine source serves, with its voids filled from the coarse one; if it has none, or below, the coarse
    one from zoom 11; else the far one. A source that failed fails the tile when it is asked, and only then: the coarse
    one is asked for a fine tile only if that has voids.
    """
    named = lambda df, n: df.select(*TILE, F.col("pixels").alias(n), F.col("failed").alias(f"{n}_failed"))
    t = tiles.join(named(fine, "s1m"), TILE, "left").join(named(coarse, "usgs13"), TILE, "left").join(named(far, "farfield"), TILE, "left")
    failed = lambda n: F.coalesce(f"{n}_failed", F.lit(False))
    may_fine, may_coarse = F.col("z") >= FINE_MIN, F.col("z") >= COARSE_MIN
    use_fine = may_fine & F.col("s1m").isNotNull()
    voids = use_fine & may_coarse & px.has_void(F.col("s1m"))
    use_coarse = ~use_fine & may_coarse & F.col("usgs13").isNotNull()
    broken = (may_fine & failed("s1m")) | (voids & failed("usgs13")) | (~use_fine & may_coarse & failed("usgs13")) | (~use_fine & ~use_coarse & failed("farfield"))
    pixels = F.when(use_fine, F.when(voids, px.void_fill(F.col("s1m"), F.col("usgs13"))).otherwise(F.col("s1m"))).when(use_coarse, F.col("usgs13")).otherwise(F.col("farfield"))
    source = F.when(use_fine, "s1m").when(use_coarse, "usgs13").when(F.col("farfield").isNotNull(), "farfield")
    status = F.when(broken, "failed").when(source.isNull(), "no_coverage").otherwise("ok")
    return t.select(*TILE, F.when(~broken, pixels).alias("pixels"), F.when(~broken, source).alias("dem_source"), status.alias("status"))


def dem_source_mix(cascade: DataFrame) -> DataFrame:
    return cascade.groupBy(F.coalesce("dem_source", F.lit("flat")).alias("dem_source")).count().withColumnRenamed("count", "tiles")


def void_fill_join(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(z, x, y, pixels): only fine tiles with voids meet the coarse ones."""
    whole = fine.where(~px.has_void(F.col("pixels"))).select(*TILE, "pixels")
    torn = fine.where(px.has_void(F.col("pixels"))).join(coarse.select(*TILE, F.col("pixels").alias("c")), TILE, "left")
    return whole.unionByName(torn.select(*TILE, px.void_fill(F.col("pixels"), F.col("c")).alias("pixels")))


def _blocks(size: int, fill: float):
    def place(pdf: pd.DataFrame, dx: pd.Series, dy: pd.Series, n: int) -> np.ndarray:
        out = np.full((n * size, n * size), fill)
        for p, i, j in zip(pdf["pixels"], dx, dy, strict=True):
            out[j * size : (j + 1) * size, i * size : (i + 1) * size] = np.array(p, dtype=float).reshape(size, size)
        return out

    return place


def stitch_2x2(children: DataFrame, size: int) -> DataFrame:
    """(z, x, y, codes, status) of parents from children (z, x, y, status, pixels: elevation codes): child (2x + i, 2y + j)
    is quadrant (j, i). A missing child is sea level; if any child failed the parent fails; if all are missing there is no
    coverage."""
    place = _blocks(size, float(px.SEA))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z, x, y = int(pdf["z"].iloc[0]) - 1, int(pdf["px"].iloc[0]), int(pdf["py"].iloc[0])
        there = pdf[pdf["status"] == "ok"]
        status = "failed" if (pdf["status"] == "failed").any() else "ok" if len(there) else "no_coverage"
        codes = place(there, there["x"] % 2, there["y"] % 2, 2).astype(int).ravel().tolist() if status == "ok" else None
        return pd.DataFrame([[z, x, y, codes, status]], columns=["z", "x", "y", "codes", "status"])

    keyed = children.withColumns({"px": tm.shifted(F.col("x"), F.lit(1)), "py": tm.shifted(F.col("y"), F.lit(1))})
    return keyed.groupBy("z", "px", "py").applyInPandas(one, "z int, x int, y int, codes array<int>, status string")


def block_mosaic(tiles: DataFrame, size: int, n: int) -> DataFrame:
    """(bx, by, pixels, lo, hi) of blocks of n × n tiles; missing tiles and masked pixels are 0; the range is that of
    positive pixels, else 0 to 0."""
    place = _blocks(size, 0.0)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(pdf["bx"].iloc[0]), int(pdf["by"].iloc[0])
        a = np.nan_to_num(place(pdf, pdf["x"] - bx * n, pdf["y"] - by * n, n))
        up = a[a > 0]
        return pd.DataFrame([[bx, by, a.ravel().tolist(), float(up.min()) if len(up) else 0.0, float(up.max()) if len(up) else 0.0]], columns=["bx", "by", "pixels", "lo", "hi"])

    keyed = tiles.withColumns({"bx": F.floor(F.col("x") / n).cast("int"), "by": F.floor(F.col("y") / n).cast("int")})
    return keyed.groupBy("bx", "by").applyInPandas(one, "bx int, by int, pixels array<double>, lo double, hi double")


@pandas_udf(T.ArrayType(T.IntegerType()))
def hillshade(pixels: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([px.np_hillshade(np.array(p, dtype=float).reshape(n, n)).ravel().astype(int).tolist() for p, n in zip(pixels, size, strict=True)])


@pandas_udf(T.ArrayType(T.IntegerType()))
def downsample_2x2(pixels: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([px.np_downsample(np.array(p, dtype=float).reshape(n, n)).ravel().astype(int).tolist() for p, n in zip(pixels, size, strict=True)])


GRID = "z int, x int, y int, rank long, grid int, xs array<double>, ys array<double>, zs array<double>, nx array<double>, ny array<double>, nz array<double>"


def surface_grid(tiles: DataFrame, step: int = 8) -> DataFrame:
    """Vertices every ``step`` pixels, row by row from the north-west: places in metres from that corner, heights times
    the latitude's scale, and normals by central differences over ground metres. Masked pixels count as 0."""

    def one(it):
        for pdf in it:
            rows = []
            for z, x, y, rank, size, pixels in zip(pdf["z"], pdf["x"], pdf["y"], pdf["rank"], pdf["size"], pdf["pixels"], strict=True):
                h = np.nan_to_num(np.array(pixels, dtype=float)).reshape(size, size)
                n = size // step
                at = np.minimum(np.arange(n + 1) * step, size - 1)
                h = h[np.ix_(at, at)]
                side = tm.SIDE / 2**z
                scale = np.cosh((tm.HALF - (y + 0.5) * side) / tm.R)  # sec of the latitude in the middle
                u = np.arange(n + 1) / n
                west, east = np.maximum(np.arange(n + 1) - 1, 0), np.minimum(np.arange(n + 1) + 1, n)
                run = (east - west) * side / (n * scale)
                sx, sy = (h[:, east] - h[:, west]) / run[None, :], (h[west, :] - h[east, :]) / run[:, None]
                length = np.sqrt(sx * sx + sy * sy + 1)
                g = np.meshgrid(u * side, -u * side)
                rows.append((z, x, y, rank, n + 1, *[a.ravel().tolist() for a in (g[0], g[1], h * scale, -sx / length, -sy / length, 1 / length)]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in GRID.split(", ")])

    return tiles.select("z", "x", "y", "rank", "size", "pixels").mapInPandas(one, GRID)
