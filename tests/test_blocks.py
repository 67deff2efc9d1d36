"""Pictures in blocks: warp and mosaic against plain numpy on whole pictures."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilelake.functions import tilemath as tm
from tilelake.operators import blocks, raster

GRID = "id long, x0 double, y0 double, dx double, dy double, width int, height int, crs int, nodata double, pixels array<double>"
TILES = "z int, x int, y int, rank long, id long"


def centres(z, x, y, size, crs):
    side = tm.SIDE / 2**z
    mid = (np.arange(size) + 0.5) / size * side
    mx, my = x * side - tm.HALF + mid, tm.HALF - y * side - mid
    return (mx / tm.HALF * 180, np.degrees(2 * np.arctan(np.exp(my / tm.R)) - np.pi / 2)) if crs == 4326 else (mx, my)


def plain(tile, picture, size):
    """The layer of one tile, NaN as mask."""
    z, x, y, *_ = tile
    _, x0, y0, dx, dy, width, height, crs, nodata, pixels = picture
    a = np.array([np.nan if v is None else v for v in pixels], float).reshape(height, width)
    e, n = centres(z, x, y, size, crs)
    c, r = np.floor((e - x0) / dx).astype(int), np.floor((n - y0) / dy).astype(int)
    inside = ((r >= 0) & (r < height))[:, None] & ((c >= 0) & (c < width))[None, :]
    got = np.where(inside, a[np.clip(r, 0, height - 1)][:, np.clip(c, 0, width - 1)], np.nan)
    return np.where(got == nodata, np.nan, got).ravel()


def pictures_around(rng, z, x, y):
    """Three pictures over and beside a tile, of several sizes and both systems, with masks; one is far away."""
    out = []
    for k, (crs, width, height) in enumerate([(4326, 37, 23), (3857, 64, 50), (4326, 5, 90), (3857, 8, 8)]):
        side = tm.SIDE / 2**z
        w, n = x * side - tm.HALF + side * rng.uniform(-0.4, 0.4), tm.HALF - y * side + side * rng.uniform(-0.4, 0.4)
        if k == 3:
            w += 5 * side
        across, down = side * rng.uniform(0.6, 1.4), side * rng.uniform(0.6, 1.4)
        if crs == 4326:
            lat = lambda v: math.degrees(2 * math.atan(math.exp(v / tm.R)) - math.pi / 2)
            w, e, n, s = w / tm.HALF * 180, (w + across) / tm.HALF * 180, lat(n), lat(n - down)
        else:
            e, s = w + across, n - down
        pixels = [None if v < 0.05 else -999999.0 if v < 0.1 else round(float(v), 6) for v in rng.random(width * height)]
        out.append((k, w, n, (e - w) / width, (s - n) / height, width, height, crs, -999999.0, pixels))
    return out


@pytest.mark.parametrize(("size", "block"), [(16, 7), (3, 5), (2, 4), (40, 64), (1, 3)])
def test_warp_equals_whole_pictures(spark, size, block):
    """Many blocks, one block, and tiles so coarse that their centres skip blocks."""
    rng = np.random.default_rng(size)
    tile = (13, 2400, 3100)
    pics = pictures_around(rng, *tile)
    tiles = [(*tile, k, k) for k in range(4)]
    df = spark.createDataFrame(pics, GRID)
    pairs = spark.createDataFrame(tiles, TILES).join(df.drop("pixels"), "id")
    cut = blocks.cut_blocks(df, block)
    assert max(len(r.pixels) for r in cut.collect()) <= block * block
    got = {r["rank"]: r for r in blocks.warp_to_tile(pairs, cut.drop("band"), size, block).collect()}
    for t, p in zip(tiles, pics):
        want = plain(t, p, size)
        r = got[t[3]]
        assert r.status == ("no_coverage" if np.isnan(want).all() else "ok")
        assert (r.pixels is None) == np.isnan(want).all() and (r.pixels is None or np.array_equal(np.array(r.pixels, float), want, equal_nan=True))
    assert got[3].status == "no_coverage"

    whole = blocks.progressive_mosaic(blocks.warped_parts(pairs, cut.drop("band"), size, block), n_pixels=size * size).first()
    want = plain(tiles[0], pics[0], size)
    for t, p in zip(tiles[1:], pics[1:]):
        want = np.where(np.isnan(want), plain(t, p, size), want)
    assert np.array_equal(np.array(whole.pixels, float), want, equal_nan=True)


def test_only_touched_blocks_are_met(spark):
    """A tile in the corner of a large picture meets one block; a coarse tile meets one for each centre."""
    side = tm.SIDE / 2**13
    x0, y0 = 100 * side - tm.HALF - side / 512, tm.HALF - 200 * side + side / 512  # no centre on an edge
    grid = [(1, x0, y0, side / 256, -side / 256, 4096, 4096, 3857, 0.0)]
    pairs = spark.createDataFrame([(17, 1601, 3202, 1, 1), (13, 100, 200, 2, 1), (9, 6, 12, 3, 1), (13, 50, 50, 4, 1)], TILES).join(spark.createDataFrame(grid, GRID.rsplit(",", 1)[0]), "id")
    got = {}
    for r in blocks.block_cover(pairs, 4, 32).collect():
        got.setdefault(r["rank"], set()).add((r.bx, r.by))
    assert got[1] == {(0, 1)} and got[4] == {(None, None)}
    e, n = centres(13, 100, 200, 4, 3857)
    assert got[2] == {(int((a - x0) * 256 / side // 32), int((y0 - b) * 256 / side // 32)) for a in e for b in n} and len(got[2]) == 16
    assert len(got[3]) == 6  # of the centres three columns and two rows are in the picture


def test_a_missing_block_is_masked_and_bands_stay_apart(spark):
    side = tm.SIDE / 2**5
    pixels = [float(v) for v in range(32)]
    df = spark.createDataFrame([(1, 3 * side - tm.HALF, tm.HALF - 4 * side, side / 4, -side / 4, 4, 4, 3857, -1.0, pixels)], GRID)
    cut = blocks.cut_blocks(df, 2, 2).where("not (band = 2 and bx = 1 and by = 0)")
    pairs = spark.createDataFrame([(5, 3, 4, 0, 1)], TILES).join(df.drop("pixels"), "id").withColumn("band", F.explode(F.array(F.lit(1), F.lit(2))))
    got = {r.band: r.pixels for r in blocks.warp_to_tile(pairs, cut, 4, 2, ["band"]).collect()}
    assert got[1] == pixels[:16] and got[2] == [None if k in (2, 3, 6, 7) else pixels[16 + k] for k in range(16)]


def batch(rows):
    keys, ranks, status, at, pixels = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(ranks, pa.int64()), pa.array(status, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(pixels, pa.list_(pa.float64()))], names=["k", "rank", "status", "at", "pixels"])


def test_layers_behind_a_full_grid_are_not_decoded(monkeypatch):
    seen = []
    real = blocks.layer
    monkeypatch.setattr(blocks, "layer", lambda values, a, b: seen.append(b - a) or real(values, a, b))
    rows = [(1, 0, "ok", None, [1.0, None]), (1, 1, "failed", None, [9.0, 9.0]), (1, 2, "ok", None, [3.0, 4.0]), (1, 3, "ok", None, [5.0, 6.0]), (1, 4, None, None, [7.0, 8.0]), (2, 0, None, None, None), (2, 1, "ok", None, [None, None])]
    for cuts in ([7], [1, 6], [2, 5], [3, 4], [4, 3], [1] * 7):  # a tile may go on in the next batch
        seen.clear()
        at = np.cumsum([0, *cuts])
        got = [r for b in blocks.fold_layers([batch(rows[a:b]) for a, b in zip(at, at[1:])], ["k"], None) for r in b.to_pylist()]
        assert got == [{"k": 1, "pixels": [1.0, 4.0], "failed": True}, {"k": 2, "pixels": None, "failed": False}]
        assert len(seen) == 3
    parts = [(1, 0, None, [2, 0], [1.0, 2.0]), (1, 0, None, [], []), (1, 1, None, [1, 2], [3.0, 4.0]), (1, 2, None, [0, 1, 2], [5.0, 6.0, 7.0])]
    seen.clear()
    got = [r for b in blocks.fold_layers([batch(parts)], ["k"], 3) for r in b.to_pylist()]
    assert got == [{"k": 1, "pixels": [2.0, 3.0, 1.0], "failed": False}] and len(seen) == 2
    assert list(blocks.fold_layers([], ["k"], 3)) == []


def test_mosaics_of_many_and_large_layers(spark):
    rng = np.random.default_rng(1)
    layers = {(t, k): [None if v < 0.7 else float(v) for v in rng.random(4096)] for t in range(5) for k in range(9)}
    df = spark.createDataFrame([(15, t, 0, k, "ok", p) for (t, k), p in layers.items()], "z int, x int, y int, rank long, status string, pixels array<double>").repartition(4)
    for r in raster.mosaic_first_valid(df).collect():
        assert r.pixels == [next((v for v in c if v is not None), None) for c in zip(*[layers[r.x, k] for k in range(9)])]
    assert raster.mosaic_first_valid(df.limit(0)).count() == 0
