"""Pixels as column expressions on arrays (row-major, row 0 north, null = masked), and numpy twins for large tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = -999999.0
TOP = (1 << 24) - 1
SEA = 32768 * 256


def fold_nodata(pixels: Column, declared: Column | None = None) -> Column:
    """The void value, the declared one and NaN become null."""
    void = lambda p: (p == VOID) | F.isnan(p) | (F.coalesce(p == declared, F.lit(False)) if declared is not None else F.lit(False))
    return F.transform(pixels, lambda p: F.when(~void(p), p))


def void_fill(fine: Column, coarse: Column) -> Column:
    """Null pixels take the coarse value; a null coarse tile fills nothing."""
    return F.when(coarse.isNull(), fine).otherwise(F.zip_with(fine, coarse, lambda a, b: F.coalesce(a, b)))


def has_void(pixels: Column) -> Column:
    return F.exists(pixels, lambda p: p.isNull())


def first_source(ranked: Column) -> Column:
    """The rank of the layer that each pixel's first valid value is from, over an array of (rank, pixels) structs."""
    own = F.transform(F.array_sort(ranked), lambda r: F.transform(r["pixels"], lambda p: F.when(p.isNotNull(), r["rank"])))
    return F.aggregate(F.slice(own, 2, F.size(own)), F.get(own, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda p, q: F.coalesce(p, q)))


def select_bands(pixels: Column, n_bands: int, picks: tuple[int, ...]) -> Column:
    """The picked bands (from 1) of pixels that lie band after band, in that order. Fewer bands than asked are an error,
    so that a picture without them isn't taken for one with other colours."""
    if max(picks) > n_bands or min(picks) < 1:
        raise ValueError(f"{picks} of {n_bands} bands")
    size = F.floor(F.size(pixels) / n_bands).cast("int")
    return F.flatten(F.array(*[F.slice(pixels, size * (b - 1) + 1, size) for b in picks]))


def encode_terrarium(metres: Column) -> Column:
    """24-bit code of an elevation: null, NaN and the void value are sea level; half-way values go to the even code."""
    e = F.when(metres.isNull() | F.isnan(metres) | (metres == VOID), 0.0).otherwise(metres)
    return F.rint(F.least(F.greatest((e + 32768.0) * 256.0, F.lit(0.0)), F.lit(float(TOP)))).cast("int")


def rgb(code: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(code, 16), F.shiftright(code, 8).bitwiseAND(255), code.bitwiseAND(255)


def decode_terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256.0 + g + b / 256.0 - 32768.0


def elevation_stats(pixels: Column, size: int) -> Column:
    """Least, greatest and middle value; zeros where there is none. Nulls are left out of the extremes."""
    middle = F.element_at(pixels, (size // 2) * size + size // 2 + 1)
    some = F.exists(pixels, lambda p: p.isNotNull())
    return F.when(some, F.struct(F.array_min(pixels).alias("lo"), F.array_max(pixels).alias("hi"), F.coalesce(middle, F.lit(0.0)).alias("mid"))).otherwise(F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0.0).alias("mid")))


def composite_white(c: Column, alpha: Column) -> Column:
    """A colour over white, in whole numbers."""
    return F.floor((c * alpha + F.lit(255) * (F.lit(255) - alpha)) / 255).cast("int")


def rescale(v: Column, lo: float, hi: float) -> Column:
    """lo .. hi to 0 .. 255, cut off at both ends; fractions are dropped."""
    return F.floor(F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def ground_at(grid: Column, side: Column, u: Column, v: Column) -> Column:
    """The nearest vertex's height on a side × side grid; halves go up, places outside are clamped."""
    at = lambda t: F.least(F.greatest(F.floor(t * (side - 1) + 0.5), F.lit(0)), side - 1)
    return F.element_at(grid, (at(v) * side + at(u) + 1).cast("int"))


def exaggerated(h: Column, ref: Column | float, k: float, lat: Column) -> Column:
    """World height: vertical exaggeration around a reference, in Mercator metres."""
    ref = F.lit(ref) if isinstance(ref, float) else ref
    return ((h - ref) * k + ref) / F.cos(F.radians(lat))


# numpy twins


def np_terrarium(metres: np.ndarray) -> np.ndarray:
    e = np.where(np.isnan(metres) | (metres == VOID), 0.0, metres)
    return np.rint(np.clip((e + 32768.0) * 256.0, 0, TOP)).astype(np.int64)


def np_hillshade(elev: np.ndarray, azimuth: float = 315.0, altitude: float = 45.0) -> np.ndarray:
    """Brightness 0 .. 255, fractions dropped."""
    dy, dx = np.gradient(elev)
    az, alt = np.radians(azimuth), np.radians(altitude)
    lit = (np.sin(alt) + np.cos(alt) * (dy * np.cos(az) - dx * np.sin(az))) / np.sqrt(1 + dx * dx + dy * dy)
    return (np.clip(lit, 0, 1) * 255).astype(np.uint8)


def np_downsample(a: np.ndarray) -> np.ndarray:
    """Means of 2 × 2 blocks, fractions dropped; only for even sides."""
    h, w = a.shape
    if h % 2 or w % 2:
        return a
    return a.reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3)).astype(np.uint8)
