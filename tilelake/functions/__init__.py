"""Column functions: tile grid, projections, rings, elevation codes."""
