"""Conus Albers (EPSG:6350) as column expressions: equal-area conic on GRS80, after Snyder (1987)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilelake.functions import tilemath

A, FLAT = 6378137.0, 1 / 298.257222101
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)
LAT0, LAT1, LAT2, LON0 = (math.radians(v) for v in (23.0, 29.5, 45.5, -96.0))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E * s) / (1 + E * s)) / (2 * E))


N = (_m(LAT1) ** 2 - _m(LAT2) ** 2) / (_q(LAT2) - _q(LAT1))
C = _m(LAT1) ** 2 + N * _q(LAT1)
RHO0 = A * math.sqrt(C - N * _q(LAT0)) / N


def albers_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    s = F.sin(F.radians(lat))
    q = (s / (1 - s * s * E2) - F.log((1 - s * E) / (1 + s * E)) / (2 * E)) * (1 - E2)
    rho, theta = F.sqrt(F.lit(C) - q * N) * (A / N), (F.radians(lon) - LON0) * N
    return rho * F.sin(theta), F.lit(RHO0) - rho * F.cos(theta)


def albers_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Six iterations for the latitude, as a fold so that the expression stays small."""
    rho = F.sqrt(x * x + (F.lit(RHO0) - y) * (F.lit(RHO0) - y))
    theta = F.atan2(x, F.lit(RHO0) - y)
    q = (F.lit(C) - (rho * N / A) * (rho * N / A)) / N

    def step(phi: Column, _: Column) -> Column:
        s = F.sin(phi)
        w = 1 - s * s * E2
        return phi + w * w / (F.cos(phi) * 2) * (q / (1 - E2) - s / w + F.log((1 - s * E) / (1 + s * E)) / (2 * E))

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.asin(q / 2), step)
    return F.degrees(theta / N + LON0), F.degrees(phi)


def tile_envelope_albers(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """xmin, xmax, ymin, ymax of a tile's four projected corners."""
    w, s, e, n = tilemath.tile_bounds_lonlat(z, x, y)
    corners = [albers_forward(lon, lat) for lon in (w, e) for lat in (s, n)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)
