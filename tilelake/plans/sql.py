"""Pieces of DuckDB SQL for the oracles: derived tables and tile arithmetic spelled out."""

from __future__ import annotations

from tilelake.functions import projection as P
from tilelake.functions.tilemath import HALF, SIDE, R
from tilelake.sources import fixtures

HALF_, SIDE_, R_ = f"{HALF!r}::DOUBLE", f"{SIDE!r}::DOUBLE", "6378137e0"


def with_(*tables: str, **more: str) -> str:
    """A WITH clause of derived tables by name, then of named queries."""
    parts = [f"{n} AS ({fixtures.RASTER_SQL if n == 'fx_rasters' else fixtures.sql(n)})" for n in tables]
    return "WITH RECURSIVE " + ",\n".join([*parts, *[f"{k} AS ({v})" for k, v in more.items()]]) + "\n"


def mx(lon: str) -> str:
    return f"(({lon}) / 180e0 * {HALF_})"


def my(lat: str) -> str:
    return f"(ln(tan(0.7853981633974483e0 + radians({lat}) / 2)) * {R_})"


def side(z: str) -> str:
    return f"({SIDE_} / pow(2e0, {z}))"


def tx(x: str, z: str) -> str:
    return f"CAST(least(greatest(floor(({x} + {HALF_}) / {side(z)}), 0), pow(2e0, {z}) - 1) AS INT)"


def ty(y: str, z: str) -> str:
    return f"CAST(least(greatest(floor(({HALF_} - {y}) / {side(z)}), 0), pow(2e0, {z}) - 1) AS INT)"


def lon(x: str) -> str:
    return f"(({x}) / {HALF_} * 180e0)"


def lat(y: str) -> str:
    return f"degrees(atan(exp(({y}) / {R_})) * 2 - 1.5707963267948966e0)"


def bounds(z: str = "z", x: str = "x", y: str = "y") -> tuple[str, str, str, str]:
    s = side(z)
    return f"({x} * {s} - {HALF_})", f"({HALF_} - ({y} + 1) * {s})", f"(({x} + 1) * {s} - {HALF_})", f"({HALF_} - {y} * {s})"


def box(z: str = "z", x: str = "x", y: str = "y") -> tuple[str, str, str, str]:
    w, s, e, n = bounds(z, x, y)
    return lon(w), lat(s), lon(e), lat(n)


def albers(lo: str, la: str) -> tuple[str, str]:
    s = f"sin(radians({la}))"
    q = f"(({s} / (1 - {s} * {s} * {P.E2!r}::DOUBLE) - ln((1 - {s} * {P.E!r}::DOUBLE) / (1 + {s} * {P.E!r}::DOUBLE)) / {2 * P.E!r}::DOUBLE) * {1 - P.E2!r}::DOUBLE)"
    rho, theta = f"(sqrt({P.C!r}::DOUBLE - {q} * {P.N!r}::DOUBLE) * {P.A / P.N!r}::DOUBLE)", f"((radians({lo}) - ({P.LON0!r}::DOUBLE)) * {P.N!r}::DOUBLE)"
    return f"({rho} * sin({theta}))", f"({P.RHO0!r}::DOUBLE - {rho} * cos({theta}))"


def albers_inverse_table(source: str, keep: str, x: str, y: str) -> str:
    """A query of keep, lon and lat from a table, with six iterations one after the other."""
    rho = f"sqrt({x} * {x} + ({P.RHO0!r}::DOUBLE - {y}) * ({P.RHO0!r}::DOUBLE - {y}))"
    q = f"({P.C!r}::DOUBLE - ({rho} * {P.N!r}::DOUBLE / {P.A!r}::DOUBLE) * ({rho} * {P.N!r}::DOUBLE / {P.A!r}::DOUBLE)) / {P.N!r}::DOUBLE"
    out = f"SELECT {keep}, atan2({x}, {P.RHO0!r}::DOUBLE - {y}) AS th_, {q} AS q_, asin({q} / 2) AS p_ FROM {source}"
    for _ in range(6):
        w = f"(1 - sin(p_) * sin(p_) * {P.E2!r}::DOUBLE)"
        out = f"SELECT {keep}, th_, q_, p_ + {w} * {w} / (cos(p_) * 2) * (q_ / {1 - P.E2!r}::DOUBLE - sin(p_) / {w} + ln((1 - sin(p_) * {P.E!r}::DOUBLE) / (1 + sin(p_) * {P.E!r}::DOUBLE)) / {2 * P.E!r}::DOUBLE) AS p_ FROM ({out}) i_"
    return f"SELECT {keep}, degrees(th_ / {P.N!r}::DOUBLE + ({P.LON0!r}::DOUBLE)) AS lon, degrees(p_) AS lat FROM ({out}) j_"


#: Distinct tiles of the points of interest.
TILES = f"SELECT DISTINCT z, {tx(mx('lon'), 'z')} AS x, {ty(my('lat'), 'z')} AS y FROM fx_points"
