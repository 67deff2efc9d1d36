"""Geometry on all rings of an Arrow batch at once: flat coordinates, and offsets of points in rings, rings in polygons and
so on. No loop over features or points; a step costs some passes over the flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def read(a: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Offsets of each level of nested lists, from the outermost, and the x and y of the points; null lists are empty."""
    levels = []
    while pa.types.is_list(a.type):
        o = np.asarray(a.offsets).astype(np.int64)
        levels.append(o - o[0])
        a = a.values.slice(o[0], o[-1] - o[0])
    x, y = a.flatten()
    return levels, x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)


def nested(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> pa.Array:
    """The nested lists of structs x, y with these offsets."""
    out = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
    for o in reversed(levels):
        out = pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), out)
    return out


def owner(offsets: np.ndarray) -> np.ndarray:
    """The list of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def kept(offsets: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Offsets when only some elements stay."""
    return np.append(0, np.cumsum(keep))[offsets]


def following(offsets: np.ndarray) -> np.ndarray:
    """The next point of each point in its ring, the first one after the last."""
    n = int(offsets[-1])
    after, there = np.arange(1, n + 1), np.diff(offsets) > 0
    after[offsets[1:][there] - 1] = offsets[:-1][there]
    return after


def at_least(offsets: np.ndarray, least: int) -> np.ndarray:
    """Whether a point is in a ring of so many points."""
    return np.repeat(np.diff(offsets) >= least, np.diff(offsets))


def clip(offsets: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sutherland-Hodgman for all rings: the parts of rings in a box each, empty where fewer than three points are left."""
    p = np.stack([x, y], axis=1).astype(float)
    for axis, limit, sign in ((0, w, 1), (0, e, -1), (1, s, 1), (1, n, -1), (None, None, 0)):
        big = at_least(offsets, 3)
        if not big.all():
            p, offsets = p[big], kept(offsets, big)
        if axis is None:
            break
        edge = limit[owner(offsets)]
        d, after = (p[:, axis] - edge) * sign, following(offsets)
        inside = d >= 0
        crosses = inside != inside[after]
        if inside.all():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(crosses, d / (d - d[after]), 0.0)
        cut = p + (p[after] - p) * t[:, None]
        cut[:, axis] = np.where(crosses, edge, cut[:, axis])
        stay = np.stack([inside, crosses], axis=1).ravel()
        p, offsets = np.stack([p, cut], axis=1).reshape(-1, 2)[stay], kept(2 * offsets, stay)
    return offsets, p[:, 0], p[:, 1]


def any_of(offsets: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Whether a list has a true element."""
    return np.diff(np.append(0, np.cumsum(flags))[offsets]) > 0


def polygons_meet_boxes(features: np.ndarray, rings: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether polygons with holes meet a box each, touching included: an edge meets it, or its middle lies inside."""
    points = rings[features]
    of, after = owner(points), following(rings)
    lo, hi, out = np.zeros(len(x)), np.ones(len(x)), np.zeros(len(x), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for v, low, high in ((x, w[of], e[of]), (y, s[of], n[of])):
            d = v[after] - v
            a, b, flat = (low - v) / d, (high - v) / d, d == 0
            out |= flat & ((v < low) | (v > high))
            lo = np.where(flat, lo, np.maximum(lo, np.fmin(a, b)))
            hi = np.where(flat, hi, np.minimum(hi, np.fmax(a, b)))
        mx, my = ((w + e) / 2)[of], ((s + n) / 2)[of]
        spans = (y > my) != (y[after] > my)
        right = spans & (mx < x + (my - y) / (y[after] - y) * (x[after] - x))
    return any_of(points, ~out & (lo <= hi)) | (np.diff(np.append(0, np.cumsum(right))[points]) % 2 == 1)


def signed_areas(offsets: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Twice the signed area of each ring; positive if counter-clockwise with y growing up."""
    after = following(offsets)
    cross = x * y[after] - x[after] * y
    return np.bincount(owner(offsets), cross, minlength=len(offsets) - 1)


def polygons(features: np.ndarray, rings: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Offsets of polygons in features, rings in polygons and points in rings: a feature's first ring with an area has the
    orientation of outer rings, and a ring of the other one is a hole of the polygon before. Rings of fewer than three
    points are dropped."""
    big = np.diff(rings) >= 3
    points = np.repeat(big, np.diff(rings))
    x, y, features = x[points], y[points], kept(features, big)
    rings = np.append(0, np.cumsum(np.diff(rings)[big]))
    area, of = signed_areas(rings, x, y), owner(features)
    sized = np.flatnonzero(area != 0)
    with_, at = np.unique(of[sized], return_index=True)
    first = np.full(len(features) - 1, len(area))
    first[with_] = sized[at]
    outer = np.append(area, 0.0)[first] > 0
    starts = (np.arange(len(area)) < first[of]) | ((area > 0) == outer[of])
    starts[features[:-1][np.diff(features) > 0]] = True
    return [np.append(0, np.cumsum(starts))[features], np.append(np.flatnonzero(starts), len(area)), rings], x, y
