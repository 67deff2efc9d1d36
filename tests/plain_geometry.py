"""Rings one by one, as lists of points × 2: what the kernel for whole batches must equal."""

import numpy as np


def clip(ring: np.ndarray, w: float, s: float, e: float, n: float) -> np.ndarray:
    """Sutherland-Hodgman: the part of a ring (points × 2) in a box; fewer than three points are none."""
    for axis, limit, sign in ((0, w, 1), (0, e, -1), (1, s, 1), (1, n, -1)):
        if len(ring) < 3:
            return np.zeros((0, 2))
        d = (ring[:, axis] - limit) * sign
        after, d2 = np.roll(ring, -1, axis=0), np.roll(d, -1)
        inside, crosses = d >= 0, (d >= 0) != (d2 >= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(crosses, d / (d - d2), 0.0)
        cut = ring + (after - ring) * t[:, None]
        cut[:, axis] = np.where(crosses, limit, cut[:, axis])
        ring = np.stack([ring, cut], axis=1).reshape(-1, 2)[np.stack([inside, crosses], axis=1).ravel()]
    return ring if len(ring) >= 3 else np.zeros((0, 2))


def contains(rings: list[np.ndarray], x: float, y: float) -> bool:
    """Whether a point lies in a polygon of an outer ring and holes, by counting crossings of all rings."""
    odd = False
    for r in rings:
        a, b = r, np.roll(r, -1, axis=0)
        spans = (a[:, 1] > y) != (b[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
        odd ^= bool(np.count_nonzero(spans & (x < at)) % 2)
    return odd


def polygon_meets_box(rings: list[np.ndarray], w: float, s: float, e: float, n: float) -> bool:
    """Whether a polygon with holes meets a box, touching included: an edge meets the box, or the box lies inside."""
    for r in rings:
        a, b = r, np.roll(r, -1, axis=0)
        lo, hi = np.zeros(len(r)), np.ones(len(r))
        out = np.zeros(len(r), bool)
        for axis, low, high in ((0, w, e), (1, s, n)):
            d = b[:, axis] - a[:, axis]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.stack([(low - a[:, axis]) / d, (high - a[:, axis]) / d])
            flat = d == 0
            out |= flat & ((a[:, axis] < low) | (a[:, axis] > high))
            lo = np.where(flat, lo, np.maximum(lo, np.fmin(t[0], t[1])))
            hi = np.where(flat, hi, np.minimum(hi, np.fmax(t[0], t[1])))
        if np.any(~out & (lo <= hi)):
            return True
    return contains(rings, (w + e) / 2, (s + n) / 2)


def signed_area(ring: np.ndarray) -> float:
    b = np.roll(ring, -1, axis=0)
    return float(np.sum(ring[:, 0] * b[:, 1] - b[:, 0] * ring[:, 1]))


def polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings of one feature as polygons of an outer ring and its holes: the first ring's orientation is that of outer
    rings, and a ring of the other one is a hole of the polygon before. Rings of fewer than three points are dropped."""
    out: list[list[np.ndarray]] = []
    outer = 0.0
    for r in rings:
        if len(r) < 3:
            continue
        area = signed_area(r)
        outer = outer or area
        if not out or (area > 0) == (outer > 0):
            out.append([r])
        else:
            out[-1].append(r)
    return out
