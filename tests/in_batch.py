"""The kernel for whole batches, called for one feature."""

import numpy as np

from tilelake.functions import ragged


def flat(rings):
    offsets = np.cumsum([0, *[len(r) for r in rings]])
    p = np.concatenate([*rings, np.zeros((0, 2))]).astype(float)
    return offsets, p[:, 0], p[:, 1]


def cut(offsets, x, y):
    return [np.stack([x[a:b], y[a:b]], axis=1) for a, b in zip(offsets, offsets[1:])]


def clip(ring, *box):
    return cut(*ragged.clip(*flat([ring]), *[np.array([float(v)]) for v in box]))[0]


def polygon_meets_box(rings, *box):
    return bool(ragged.polygons_meet_boxes(np.array([0, len(rings)]), *flat(rings), *[np.array([float(v)]) for v in box])[0])


def signed_area(ring):
    return float(ragged.signed_areas(*flat([ring]))[0])


def polygons(rings):
    (features, of_polygon, points), x, y = ragged.polygons(np.array([0, len(rings)]), *flat(rings))
    made = cut(points, x, y)
    return [made[a:b] for a, b in zip(of_polygon, of_polygon[1:])]
