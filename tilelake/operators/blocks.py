"""Pictures as tables of pixel blocks, and tiles made from the blocks that they touch.

A picture of any size is a row of its grid (id, x0, y0, dx, dy, width, height, crs, nodata) and rows of blocks (id, band, bx,
by, pixels) of at most ``block`` pixels a side, those at the right and lower edges smaller. A tile's pixel centres give the
blocks that it needs by arithmetic on the grid alone; only these are joined, by (id, band, bx, by), and each gives its part
of the tile before anything is shuffled by tile. So no row holds more than a block or a tile. Spark reads Parquet by
``spark.sql.parquet.columnarReaderBatchSize`` rows (4096) at once; with blocks of 256 × 256 set it to 64.

Layers and parts of layers come to a tile in rank order, and one fold for all sizes puts them together: it holds one grid
for each task, and pixels of rows that come when the grid is full aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilelake.functions import tilemath as tm

TILE = ["z", "x", "y"]
GRID = ["x0", "y0", "dx", "dy", "width", "height", "crs", "nodata"]
#: Pixels that a centre may lie beside a block's edge by the rounding of either engine.
NEAR = 1e-6
#: Bytes of finished tiles in a batch.
OUT = 8 << 20


def cut_blocks(pictures: DataFrame, block: int, n_bands: int = 1) -> DataFrame:
    """(id, band, bx, by, pixels) of pictures (id, width, height, pixels: band after band, row by row)."""
    n = lambda side: F.ceil(F.col(side) / block).cast("int") - 1
    each = pictures.select("id", "width", "height", "pixels", F.explode(F.sequence(F.lit(1), F.lit(n_bands))).alias("band"))
    each = each.withColumn("by", F.explode(F.sequence(F.lit(0), n("height")))).withColumn("bx", F.explode(F.sequence(F.lit(0), n("width"))))
    left, top = F.col("bx") * block, F.col("by") * block
    across, down = F.least(F.lit(block), F.col("width") - left), F.least(F.lit(block), F.col("height") - top)
    line = lambda r: F.slice("pixels", (F.col("band") - 1) * F.col("width") * F.col("height") + (top + r) * F.col("width") + left + 1, across)
    return each.select("id", "band", "bx", "by", F.flatten(F.transform(F.sequence(F.lit(0), down - 1), line)).alias("pixels"))


def _touched(place, size: int, block: int, side: str) -> Column:
    """The blocks along one side that the centres 0 .. size - 1 touch; place gives a centre's column or row, with fractions."""
    first, last, most = place(F.lit(0)), place(F.lit(size - 1)), F.ceil(F.col(side) / block) - 1
    cell = lambda v: F.floor(v / block)
    low, high = F.greatest(cell(F.least(first, last) - NEAR), F.lit(0)), F.least(cell(F.greatest(first, last) + NEAR), most)
    each = F.sequence(F.lit(0), F.lit(size - 1))
    some = F.array_distinct(F.concat(F.transform(each, lambda j: cell(place(j) - NEAR)), F.transform(each, lambda j: cell(place(j) + NEAR))))
    all_ = F.when(high - low < size, F.sequence(low, high)).otherwise(F.filter(some, lambda b: (b >= low) & (b <= high)))  # far out, centres skip blocks
    return F.when(low <= high, all_)


def block_cover(pairs: DataFrame, size: int, block: int) -> DataFrame:
    """pairs of a tile (z, x, y) with a grid, a row for each block (bx, by) that a pixel centre of the tile lies in; both are
    null in the one row of a pair without such a block."""
    s = tm.side(F.col("z"))
    flat = F.col("crs") == 4326
    mid = lambda j: (j + 0.5) / size * s
    east = lambda j: F.col("x") * s - tm.HALF + mid(j)
    north = lambda j: F.lit(tm.HALF) - F.col("y") * s - mid(j)
    column = lambda j: (F.when(flat, east(j) / tm.HALF * 180.0).otherwise(east(j)) - F.col("x0")) / F.col("dx")
    row = lambda j: (F.when(flat, F.degrees(F.atan(F.exp(north(j) / tm.R)) * 2 - np.pi / 2)).otherwise(north(j)) - F.col("y0")) / F.col("dy")
    bxs, bys = _touched(column, size, block, "width"), _touched(row, size, block, "height")
    both = pairs.select("*", bxs.cast("array<int>").alias("bxs"), bys.cast("array<int>").alias("bys"))
    there = F.col("bxs").isNotNull() & F.col("bys").isNotNull()
    one = both.select(*pairs.columns, "bys", F.explode_outer(F.when(there, F.col("bxs"))).alias("bx"))
    return one.select(*pairs.columns, "bx", F.explode_outer(F.when(F.col("bx").isNotNull(), F.col("bys"))).alias("by"))


def _range(cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of the values in low .. high - 1 of rising or falling rows."""
    inside = (cells >= low[:, None]) & (cells < high[:, None])
    return inside.argmax(axis=1), inside.sum(axis=1)


def _gather(b: pa.RecordBatch, tile: list[str], size: int, block: int) -> pa.RecordBatch:
    """The part of its tile that each row's block gives: places in the tile and their values, masked ones left out."""
    lists = b.column(b.schema.names.index("pixels"))
    there = np.flatnonzero(np.asarray(lists.is_valid()))
    number = lambda k: b.column(b.schema.names.index(k)).take(pa.array(there)).to_numpy(zero_copy_only=False)
    z, x, y, x0, y0, dx, dy, width, height, crs, nodata, bx, by = (number(k) for k in ["z", "x", "y", *GRID, "bx", "by"])
    s = (tm.SIDE / np.exp2(z))[:, None]
    mid = (np.arange(size) + 0.5)[None, :] / size * s
    mx, my = x[:, None] * s - tm.HALF + mid, tm.HALF - y[:, None] * s - mid
    flat = (crs == 4326)[:, None]
    mx, my = np.where(flat, mx / tm.HALF * 180, mx), np.where(flat, np.degrees(2 * np.arctan(np.exp(my / tm.R)) - np.pi / 2), my)
    col, row = np.floor((mx - x0[:, None]) / dx[:, None]).astype(np.int64), np.floor((my - y0[:, None]) / dy[:, None]).astype(np.int64)
    left, top = bx.astype(np.int64) * block, by.astype(np.int64) * block
    across, down = np.minimum(block, width - left), np.minimum(block, height - top)
    (j0, nj), (i0, ni) = _range(col, left, left + across), _range(row, top, top + down)
    count = ni * nj
    of = np.repeat(np.arange(len(there)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    i, j = i0[of] + k // np.maximum(nj, 1)[of], j0[of] + k % np.maximum(nj, 1)[of]
    offsets = np.asarray(lists.offsets)
    at = offsets[:-1][there][of] + (row[of, i] - top[of]) * across[of] + col[of, j] - left[of]
    values = lists.values.take(pa.array(at)).to_numpy(zero_copy_only=False)
    seen = ~(np.isnan(values) | (values == nodata[of]))
    of, places, values = of[seen], (i * size + j)[seen], values[seen]
    ends = np.zeros(b.num_rows + 1, np.int64)
    ends[there + 1] = np.bincount(of, minlength=len(there))
    ends = pa.array(np.cumsum(ends), pa.int32())
    parts = [pa.ListArray.from_arrays(ends, pa.array(places.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values))]
    return pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)) for c in tile], *parts], names=[*tile, "at", "pixels"])


def warped_parts(pairs: DataFrame, blocks: DataFrame, size: int, block: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(z, x, y, rank, keys, at, pixels) for each pair of a tile (z, x, y, rank, keys) with an asset's grid (id, x0, y0, dx,
    dy, width, height, crs, nodata) and each of its blocks that the tile touches: each tile pixel takes the value at its
    centre (nearest). crs is 4326 or 3857. at has places in the tile (row by row) and pixels their values, without those
    outside the grid, null, NaN or equal to nodata. blocks has (id, bx, by, pixels) and those of keys that it has too, as
    band; a block that isn't there is masked. A pair without a block has one row with empty arrays."""
    tile = ["z", "x", "y", "rank", *keys]
    cover = block_cover(pairs.select(*tile, "id", *GRID), size, block)
    met = cover.join(blocks, ["id", "bx", "by", *[k for k in keys if k in blocks.columns]], "left").select(*tile, *GRID, "bx", "by", "pixels")
    schema = T.StructType([*[met.schema[k] for k in tile], T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("pixels", T.ArrayType(T.DoubleType()))])
    rows = max(1, (32 << 20) // (8 * size * size))

    def parts(batches):
        for b in batches:
            for first in range(0, b.num_rows, rows):
                yield _gather(b.slice(first, rows), tile, size, block)

    return met.mapInArrow(parts, schema)


def layer(values: pa.Array, first: int, end: int) -> np.ndarray:
    """Decodes a stretch of pixels, null as NaN."""
    return values.slice(first, end - first).to_numpy(zero_copy_only=False)


class _Finished:
    """Finished tiles on their way out."""

    def __init__(self, keys: list[str], kinds: list[pa.DataType]):
        self.keys, self.kinds, self.rows, self.bytes = keys, kinds, [], 0

    def add(self, key: tuple, grid: np.ndarray | None, failed: bool) -> None:
        self.rows.append((key, None if grid is None or np.isnan(grid).all() else grid, failed))
        self.bytes += 0 if grid is None else grid.nbytes

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.bytes = self.rows, [], 0
        grids = [g for _, g, _ in rows if g is not None]
        values = np.concatenate(grids) if grids else np.zeros(0)
        there = np.array([g is not None for _, g, _ in rows])
        ends = np.cumsum([0, *[0 if g is None else len(g) for _, g, _ in rows]])
        pixels = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~there, False)), pa.array(values, mask=np.isnan(values)))
        columns = [pa.array([key[k] for key, _, _ in rows], kind) for k, kind in enumerate(self.kinds)]
        return pa.RecordBatch.from_arrays([*columns, pixels, pa.array([f for _, _, f in rows])], names=[*self.keys, "pixels", "failed"])


def fold_layers(batches: Iterable[pa.RecordBatch], keys: list[str], n_pixels: int | None) -> Iterator[pa.RecordBatch]:
    """Tiles from rows (keys, status, at, pixels) in order of keys and rank. A row's pixels are the whole layer where at is
    null, else those at these places of n_pixels."""
    key, grid, left, failed, out = None, None, 1, False, None
    for b in batches:
        status, at, pixels = (b.column(b.schema.names.index(c)) for c in ("status", "at", "pixels"))
        columns = [b.column(b.schema.names.index(k)) for k in keys]
        out = out or _Finished(keys, [c.type for c in columns])
        rows = zip(zip(*(c.to_pylist() for c in columns), strict=True), status.to_pylist(), pixels.is_valid().to_pylist(), at.is_valid().to_pylist(), strict=True)
        of, spots = np.asarray(pixels.offsets), np.asarray(at.offsets)
        for i, (here, word, there, in_part) in enumerate(rows):
            if here != key:
                if key is not None:
                    out.add(key, grid, failed)
                    if out.bytes > OUT or len(out.rows) > 10_000:
                        yield out.batch()
                key, grid, left, failed = here, None, 1, False
            failed |= word == "failed"
            if word == "failed" or not there or not left:
                continue
            if in_part:
                if grid is None:
                    grid, left = np.full(n_pixels, np.nan), n_pixels
                if of[i] < of[i + 1]:
                    k = at.values.slice(spots[i], spots[i + 1] - spots[i]).to_numpy()
                    void = np.isnan(grid[k])
                    values = layer(pixels.values, of[i], of[i + 1])[void]
                    grid[k[void]] = values
                    left -= int((~np.isnan(values)).sum())
            elif grid is None:
                grid = layer(pixels.values, of[i], of[i + 1]).astype(float)
                left = int(np.isnan(grid).sum())
            else:
                void = np.isnan(grid)
                grid[void] = layer(pixels.values, of[i], of[i + 1])[void]
                left = int(np.isnan(grid).sum())
    if key is not None:
        out.add(key, grid, failed)
        yield out.batch()


def progressive_mosaic(layers: DataFrame, keys: list[str] = TILE, n_pixels: int | None = None) -> DataFrame:
    """(keys, pixels, failed): the first valid value of each pixel in rank order, from layers (keys, rank, pixels) and, if
    there are such columns, status and at. pixels is null where no pixel of any layer is valid; failed tells of layers with
    status failed, which give none. With at, a row has the pixels at these places of n_pixels; several rows of a rank are
    parts of a layer."""
    for name, kind in (("status", "string"), ("at", "array<int>")):
        if name not in layers.columns:
            layers = layers.withColumn(name, F.lit(None).cast(kind))
    schema = T.StructType([*[layers.schema[k] for k in keys], T.StructField("pixels", T.ArrayType(T.DoubleType())), T.StructField("failed", T.BooleanType(), False)])
    rows = layers.select(*keys, "rank", "status", "at", F.col("pixels").cast("array<double>").alias("pixels")).repartition(*keys).sortWithinPartitions(*keys, "rank")
    return rows.mapInArrow(lambda batches: fold_layers(batches, keys, n_pixels), schema)


def warp_to_tile(pairs: DataFrame, blocks: DataFrame, size: int, block: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(z, x, y, rank, keys, status, pixels): the whole layer of each pair of ``warped_parts``; an asset without a pixel in
    the tile has status no_coverage."""
    tile = ["z", "x", "y", "rank", *keys]
    whole = progressive_mosaic(warped_parts(pairs, blocks, size, block, keys).withColumn("layer", F.col("rank")), ["z", "x", "y", "layer", *keys], size * size)
    return whole.select(*[F.col("layer").alias(c) if c == "rank" else F.col(c) for c in tile], F.when(F.col("pixels").isNull(), "no_coverage").otherwise("ok").alias("status"), "pixels")
