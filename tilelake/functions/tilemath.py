"""The Web-Mercator tile grid as column expressions: z, x, y with y growing south."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

R = 6378137.0
HALF = math.pi * R
SIDE = 2 * HALF
#: Metres a pixel at zoom 0 with 256-pixel tiles.
RESOLUTION = 156543.03392804097
EXTENT = 4096


def lonlat_to_merc(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon / 180.0 * HALF, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * R


def merc_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return x / HALF * 180.0, F.degrees(F.atan(F.exp(y / R)) * 2 - math.pi / 2)


def merc_scale(lat: Column) -> Column:
    """Mercator metres per ground metre."""
    return 1 / F.cos(F.radians(lat))


def side(z: Column) -> Column:
    return F.lit(SIDE) / F.pow(F.lit(2.0), z)


def tiles_at(z: Column) -> Column:
    return F.pow(F.lit(2.0), z).cast("int")


def tile_of_point(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """The tile of a point in metres, clamped to the grid."""
    clamp = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), F.pow(F.lit(2.0), z).cast("long") - 1).cast("int")
    return clamp((x + HALF) / side(z)), clamp((F.lit(HALF) - y) / side(z))


def tile_bounds_merc(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north in metres."""
    s = side(z)
    return x * s - HALF, F.lit(HALF) - (y + 1) * s, (x + 1) * s - HALF, F.lit(HALF) - y * s


def tile_bounds_lonlat(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north in degrees."""
    w, s, e, n = tile_bounds_merc(z, x, y)
    (lon0, lat0), (lon1, lat1) = merc_to_lonlat(w, s), merc_to_lonlat(e, n)
    return lon0, lat0, lon1, lat1


def shifted(v: Column, by: Column) -> Column:
    """v >> by for a column of bits."""
    return F.call_function("shiftright", v, by)


def tile_ancestor_at(z: Column, x: Column, y: Column, k: Column | int) -> Column:
    """The tile at zoom k <= z that holds a tile, as a struct."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.struct(k.cast("int").alias("z"), shifted(x, z - k).alias("x"), shifted(y, z - k).alias("y"))


def tile_parent(z: Column, x: Column, y: Column) -> Column:
    return tile_ancestor_at(z, x, y, z - 1)


def tile_children(z: Column, x: Column, y: Column) -> Column:
    """Array of the four tiles at the next zoom, west before east, north before south."""
    return F.array(*[F.struct((z + 1).cast("int").alias("z"), (x * 2 + dx).cast("int").alias("x"), (y * 2 + dy).cast("int").alias("y")) for dy in (0, 1) for dx in (0, 1)])


def tile_ancestors(z: Column, x: Column, y: Column) -> Column:
    """Array of a tile and all above it, from zoom 0."""
    return F.transform(F.sequence(F.lit(0), z), lambda k: tile_ancestor_at(z, x, y, k))


def tile_grid_around(lat: Column, lon: Column, z: Column, n: int) -> Column:
    """Array of the n × n tiles around a point; with an even n the block reaches one tile further north and west."""
    x, y = tile_of_point(*lonlat_to_merc(lon, lat), z)
    offsets = F.sequence(F.lit(-(n // 2)), F.lit(n - n // 2 - 1))
    return F.flatten(F.transform(offsets, lambda dy: F.transform(offsets, lambda dx: F.struct(z.cast("int").alias("z"), (x + dx).alias("x"), (y + dy).alias("y")))))


def tile_cover(w: Column, s: Column, e: Column, n: Column, z: Column) -> Column:
    """Array of the tiles at zoom z that a box in metres meets, edges included."""
    x0, y0 = tile_of_point(w, n, z)
    x1, y1 = tile_of_point(e, s, z)
    return F.flatten(F.transform(F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: F.struct(z.cast("int").alias("z"), x.alias("x"), y.alias("y")))))


def tile_cover_bbox(w: Column, s: Column, e: Column, n: Column, z: Column, pad: float = 0.0) -> Column:
    """tile_cover of a box in degrees that grows by pad degrees first."""
    x0, y0 = lonlat_to_merc(w - pad, s - pad)
    x1, y1 = lonlat_to_merc(e + pad, n + pad)
    return tile_cover(x0, y0, x1, y1, z)


def maxzoom_for_gsd(gsd: Column, tile_size: int = 512) -> Column:
    """The least zoom whose 256-pixel resolution is at most gsd, less the levels that larger tiles save; 0 to 24."""
    z = F.ceil(F.log2(F.lit(RESOLUTION) / gsd) - 1e-8) - int(math.log2(tile_size / 256))
    return F.least(F.greatest(z, F.lit(0)), F.lit(24)).cast("int")


def mvt_quantization(z: Column) -> Column:
    """Metres a unit of a vector tile."""
    return side(z) / EXTENT


def route_imagery(z: Column, source: Column, ext_max: int = 13) -> Column:
    return F.when(source == "osm", "osm").when(z <= ext_max, "basemap").otherwise("imagery")


def tile_path(kind: Column, layer: Column, year: Column, z: Column, x: Column, y: Column) -> Column:
    tile = F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string"))
    return (
        F.when(kind == "imagery", F.concat(F.lit("/imagery/"), layer, F.lit("/"), year.cast("string"), F.lit("/"), tile, F.lit(".webp")))
        .when(kind == "terrain", F.concat(F.lit("/terrain/"), tile, F.lit(".webp")))
        .when(kind == "buildings", F.concat(F.lit("/buildings/"), tile, F.lit(".pbf")))
        .otherwise(F.concat(F.lit("/basemap/"), tile, F.lit(".webp")))
    )


def quadkey(z: Column, x: Column, y: Column) -> Column:
    """A number that orders tiles of one zoom along a Z curve."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(23)), F.lit(0).cast("long"), lambda k, i: k.bitwiseOR(F.call_function("shiftleft", shifted(x, i).bitwiseAND(F.lit(1)).cast("long"), 2 * i)).bitwiseOR(F.call_function("shiftleft", shifted(y, i).bitwiseAND(F.lit(1)).cast("long"), 2 * i + 1)))
