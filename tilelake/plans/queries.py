"""All registered queries of the map-tile library: name → (query, SQL or None)."""

from __future__ import annotations

from tilelake.plans import q_buildings, q_dem, q_demand, q_imagery, q_raster, q_tiles

ALL = q_tiles.QUERIES | q_imagery.QUERIES | q_dem.QUERIES | q_raster.QUERIES | q_buildings.QUERIES | q_demand.QUERIES
QUERIES = {k: q for k, (q, _) in ALL.items()}
ORACLES = {k: s for k, (_, s) in ALL.items() if s}
