"""Request rules as a status column: the first reason that applies, else ``ok``.

A zoom outside 0 .. max is one reason (above_max_zoom), as a negative zoom is beyond what a layer has too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGERY_MIN, BASEMAP_MAX, TERRAIN_MAX, BUILDINGS_MIN = 14, 16, 18, 14
#: Imagery layers and their greatest zoom.
LAYERS = {"naip": 18}


def outside(z: Column, x: Column, y: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return (x < 0) | (y < 0) | (x >= n) | (y >= n)


def imagery(layers: dict[str, int] = LAYERS) -> Column:
    """From columns layer, z, x, y. The order is: layer, zoom beyond the layer's, zoom below imagery, place."""
    z = F.col("z")
    top = F.create_map(*[F.lit(v) for pair in layers.items() for v in pair])[F.col("layer")]
    return (
        F.when(top.isNull(), "unknown_layer").when((z < 0) | (z > top), "above_max_zoom").when(z < IMAGERY_MIN, "below_min_zoom").when(outside(z, F.col("x"), F.col("y")), "out_of_range").otherwise("ok")
    )


def _to(top: int) -> Column:
    z = F.col("z")
    return F.when((z < 0) | (z > top), "above_max_zoom").when(outside(z, F.col("x"), F.col("y")), "out_of_range").otherwise("ok")


def basemap() -> Column:
    return _to(BASEMAP_MAX)


def terrain() -> Column:
    return _to(TERRAIN_MAX)


def buildings() -> Column:
    z = F.col("z")
    return F.when(z < BUILDINGS_MIN, "below_min_zoom").when(outside(z, F.col("x"), F.col("y")), "out_of_range").otherwise("ok")
