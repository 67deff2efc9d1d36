"""tilelake: batch and streaming Spark jobs for map-tile data, and operators for training-data pipelines."""
