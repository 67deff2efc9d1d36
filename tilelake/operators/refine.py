"""Refinement for whole sets of positions: the distinct tiles that they need, without a row for each position and tile.

A block of positions is sorted along the grid, so that near ones lie together, and a set is a stretch of the sorted block.
A set meets a tile with the least and greatest distance of its members, which come from the set's box. If all of them ask
for finer tiles, the whole set goes down to the four children; if none does, the tile is a leaf; else the set is halved and
each half asks again. A set of one position has no distance but its own, so the tiles are those of ``demand.lod_tiles``:
rounding keeps the order of distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilelake.functions import tilemath as tm
from tilelake.operators import demand

#: Positions of a block, sets that are looked at together, and tiles that a task keeps before it gives them out. They bound
#: memory; the result is the same for any.
BLOCK, STEP, KEPT = 1 << 16, 1 << 13, 1 << 20
BITS = 28


class Extremes:
    """Least and greatest values of any stretch of a column, from those of stretches whose length is a power of two."""

    def __init__(self, v: np.ndarray):
        self.low, self.high = [v], [v]
        while (half := 1 << (len(self.low) - 1)) * 2 <= len(v):
            a, b = self.low[-1], self.high[-1]
            self.low.append(np.minimum(a[:-half], a[half:]))
            self.high.append(np.maximum(b[:-half], b[half:]))
        start = np.cumsum([0, *map(len, self.low)])
        self.start, self.low, self.high = start, np.concatenate(self.low), np.concatenate(self.high)

    def of(self, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.frexp((stop - first).astype(np.float64))[1] - 1
        a, b = self.start[k] + first, self.start[k] + stop - (1 << k)
        return np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])


def _spread(v: np.ndarray) -> np.ndarray:
    """Bits of non-negative numbers below 2^28, each followed by a zero."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def _pieces(it):
    """The columns x, y, alt, z, cx, cy of at most BLOCK positions at once."""
    held, n = [], 0
    for b in it:
        for k in range(0, b.num_rows, BLOCK):
            held.append([c.to_numpy(zero_copy_only=False) for c in b.slice(k, BLOCK).columns])
            n += len(held[-1][0])
            if n >= BLOCK:
                whole, held, n = [np.concatenate(c) for c in zip(*held, strict=True)], [], 0
                for s in range(0, len(whole[0]), BLOCK):
                    yield [c[s : s + BLOCK] for c in whole]
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _leaves(px, py, alt, z, cx, cy, max_zoom: int, factor: float, lod: float):
    """Arrays of keys of the leaves of a block of positions; a key may come more than once."""
    unit = tm.SIDE / (1 << 26)
    place = _spread(np.clip((px + tm.HALF) / unit, 0, (1 << 26) - 1).astype(np.int64)) * np.uint64(2) + _spread(np.clip((tm.HALF - py) / unit, 0, (1 << 26) - 1).astype(np.int64))
    order = np.lexsort((place, cy, cx, z))
    px, py, alt, z, cx, cy = (v[order] for v in (px, py, np.abs(alt), z, cx, cy))
    boxes = [Extremes(v) for v in (px, py, alt)]
    new = np.flatnonzero(np.append(True, (np.diff(z) != 0) | (np.diff(cx) != 0) | (np.diff(cy) != 0)))
    o = np.arange(demand.ROOTS) - demand.ROOTS // 2
    dx, dy = np.tile(np.repeat(o, len(o)), len(new)), np.tile(np.tile(o, len(o)), len(new))
    many = len(o) ** 2
    first, stop, z0, x0, y0 = (np.repeat(v, many) for v in (new, np.append(new[1:], len(z)), z[new], cx[new], cy[new]))
    x0, y0, n = x0 + dx, y0 + dy, 1 << z0
    inside = (x0 >= 0) & (y0 >= 0) & (x0 < n) & (y0 < n)
    todo = [tuple(v[inside] for v in (z0, x0, y0, first, stop))]
    while todo:
        got = [todo.pop()]
        while todo and sum(len(g[0]) for g in got) < STEP:
            got.append(todo.pop())
        z, x, y, first, stop = map(np.concatenate, zip(*got, strict=True))
        if len(z) > STEP:
            todo.append(tuple(v[STEP:] for v in (z, x, y, first, stop)))
            z, x, y, first, stop = (v[:STEP] for v in (z, x, y, first, stop))
        side = tm.SIDE / np.exp2(z)
        west, north = x * side - tm.HALF, tm.HALF - y * side
        (xl, xh), (yl, yh), (al, ah) = (e.of(first, stop) for e in boxes)
        near = [np.maximum(np.maximum(w - h, low - e), 0.0) for low, h, w, e in ((xl, xh, west, west + side), (yl, yh, north - side, north))]
        far = [np.maximum(np.maximum(w - low, h - e), 0.0) for low, h, w, e in ((xl, xh, west, west + side), (yl, yh, north - side, north))]
        some, every = ((z < max_zoom) & (side / 64 / np.maximum(1.0, np.sqrt(d[0] * d[0] + d[1] * d[1] + a * a)) * factor > 16 / lod) for d, a in ((near, al), (far, ah)))
        yield (z[~some] << (2 * BITS)) | (x[~some] << BITS) | y[~some]
        split = some & ~every
        if split.any():
            zs, xs, ys, a, b = (v[split] for v in (z, x, y, first, stop))
            mid = (a + b) // 2
            todo.append((np.tile(zs, 2), np.tile(xs, 2), np.tile(ys, 2), np.append(a, mid), np.append(mid, b)))
        if every.any():
            z, x, y, first, stop = (np.repeat(v[every], 4) for v in (z, x, y, first, stop))
            kid = np.arange(len(z)) % 4
            todo.append((z + 1, 2 * x + kid % 2, 2 * y + kid // 2, first, stop))


def demanded_tiles(positions: DataFrame, *, max_zoom: int = demand.MAX_ZOOM, factor: float = 900.0, lod: float = 2.2, ground: str | None = None) -> DataFrame:
    """(z, x, y), each once: the tiles that ``demand.lod_tiles`` gives for any of the positions (x, y, alt).

    Positions are dealt by range of their cell at the base zoom and their place in it, so near ones share a task and a cell
    that most of them lie in is split. What is shuffled after that are tiles that a task has made distinct, not tiles of
    positions. Positions without a number for x, y or alt ask for nothing; repeated ones ask once; an empty table gives an
    empty one. Other columns are not read. max_zoom is at most 28.
    """
    if not 0 <= max_zoom <= BITS:
        raise ValueError(f"max_zoom must be from 0 to {BITS}")
    alt = F.col("alt") - F.col(ground) if ground else F.col("alt")
    numbers = positions.select(F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), alt.cast("double").alias("alt"), demand.base_zoom(F.col("alt")).cast("long").alias("z"))
    there = numbers.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("px", "py", "alt")))
    cx, cy = tm.tile_of_point(F.col("px"), F.col("py"), F.col("z"))
    cells = there.select("px", "py", "alt", "z", cx.cast("long").alias("cx"), cy.cast("long").alias("cy"))
    dealt = cells.repartitionByRange(int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "z", "cx", "cy", "px", "py")

    def tiles(it):
        held, n = [], 0

        def out(keys):
            mask = (1 << BITS) - 1
            for k in range(0, len(keys), BLOCK):
                v = keys[k : k + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in (v >> (2 * BITS), (v >> BITS) & mask, v & mask)], names=demand.TILE)

        for columns in _pieces(it):
            for keys in _leaves(*columns, max_zoom, factor, lod):
                held.append(keys)
                n += len(keys)
                if n > 2 * KEPT:
                    held = [np.unique(np.concatenate(held))]
                    n = len(held[0])
                    if n > KEPT:
                        yield from out(held[0])
                        held, n = [], 0
        if n:
            yield from out(np.unique(np.concatenate(held)))

    return dealt.mapInArrow(tiles, "z int, x int, y int").dropDuplicates(demand.TILE)
