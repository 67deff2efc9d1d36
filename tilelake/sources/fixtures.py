"""Map tables derived from the given ones by integer arithmetic, in SQL that Spark and DuckDB both run.

The given tables hold no geography. ``table(spark, sf_dir, name)`` reads the source as Parquet; ``sql(name)`` is the same
text over registered tables, for use in a WITH clause.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed texts: the derived tables. @name stands for a given table.
SQL = {
    "fx_imagery": """
SELECT id, region, year, lon_c, lat_c,
       lon_c - 0.03125e0 - abs(s)*0.03125e0 AS xmin, lat_c - 0.03125e0 - abs(s)*0.03125e0 AS ymin,
       lon_c + 0.03125e0 + abs(s)*0.03125e0 AS xmax, lat_c + 0.03125e0 + abs(s)*0.03125e0 AS ymax,
       s AS skew, properties, assets
FROM (
  SELECT concat('m_', CAST(o_orderkey AS STRING)) AS id,
         CASE o_custkey % 8 WHEN 0 THEN 'ca' WHEN 1 THEN 'co' WHEN 2 THEN 'fl' WHEN 3 THEN 'ks'
                            WHEN 4 THEN 'nj' WHEN 5 THEN 'tx' WHEN 6 THEN 'wa' ELSE 'wy' END AS region,
         CAST(year(o_orderdate) AS INT) AS year,
         -120e0 + 6e0*(o_custkey % 8) + ((o_orderkey*7919) % 2000)/1000e0 AS lon_c,
         30e0 + 4e0*(o_custkey % 4) + ((o_orderkey*104729) % 1500)/1000e0 AS lat_c,
         ((o_orderkey % 41) - 20)/1000e0 AS s,
         CASE o_orderkey % 5 WHEN 0 THEN '{"gsd":0.3}' WHEN 1 THEN '{"gsd":0.6}' WHEN 2 THEN '{"gsd":1.0}'
                             WHEN 3 THEN '{"gsd":0.6}' ELSE '{}' END AS properties,
         CASE WHEN o_orderkey % 23 = 0 THEN '{}'
              WHEN o_orderkey % 17 = 0 THEN concat('{"data":{"href":"s3://naip-analytic/m_', CAST(o_orderkey AS STRING), '.tif"}}')
              WHEN o_orderkey % 10 = 0 THEN concat('{"visual":{"href":"s3://naip-visualization/m_', CAST(o_orderkey AS STRING), '.tif"}}')
              ELSE concat('{"data":{"href":"s3://naip-visualization/m_', CAST(o_orderkey AS STRING), '.tif"}}') END AS assets
  FROM @orders) t""",
    "fx_points": """
SELECT event_id AS point_id, CAST(14 + event_id % 3 AS INT) AS z,
       -120e0 + 6e0*(event_id % 8) + ((event_id*6151) % 2000)/1000e0 AS lon,
       30e0 + 4e0*(event_id % 4) + ((event_id*15485863) % 1500)/1000e0 AS lat
FROM @events""",
    "fx_dem_listing": """
SELECT CASE WHEN p_partkey % 97 = 0
            THEN concat('S1M/b', CAST(p_partkey AS STRING), '/S1M_n', CAST(n AS STRING), 'w', CAST(w AS STRING), '_meta.tif')
            ELSE concat('S1M/b', CAST(p_partkey AS STRING), '/S1M_n', CAST(n AS STRING), 'w', CAST(w AS STRING), '_',
                        CAST(20240101 + (p_partkey*37) % 28 + 100*(p_partkey % 12) AS STRING), '.tif') END AS dataset,
       -1000e0*w AS xmin, -1000e0*w + 10000e0 AS xmax, 1000e0*n - 10000e0 AS ymin, 1000e0*n AS ymax
FROM (SELECT p_partkey, CAST(1500 + 10*floor((p_partkey % 120)/20e0) AS INT) AS n,
             CAST(1000 + 10*(p_partkey % 20) AS INT) AS w FROM @part) t""",
    "fx_buildings": """
SELECT CAST(c_custkey AS STRING) AS id,
       CASE WHEN c_custkey % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE 3e0 + c_custkey % 60 END AS height,
       CASE c_custkey % 3 WHEN 0 THEN CAST(NULL AS INT) WHEN 1 THEN 0 ELSE CAST(1 + c_custkey % 12 AS INT) END AS num_floors,
       -74.2e0 + ((c_custkey*7919) % 900)/10000e0 AS cx, 40.65e0 + ((c_custkey*104729) % 700)/10000e0 AS cy,
       5e-5*(1 + c_custkey % 40) AS hw, 4e-5*(1 + c_custkey % 25) AS hh,
       CASE c_custkey % 5 WHEN 0 THEN 'L' WHEN 1 THEN 'donut' ELSE 'rect' END AS shape
FROM @customer""",
    "fx_track": """
SELECT user_id AS track_id, ts, event_id,
       -12200000e0 + (event_id*997) % 400000 AS x, 5300000e0 + (event_id*499) % 300000 AS y, 500e0 + value*120e0 AS alt
FROM @events""",
    "fx_requests": """
SELECT event_id, ts, z, CAST((event_id*31) % (CAST(pow(2, z) AS BIGINT)) AS INT) AS x,
       CAST((event_id*17 + user_id) % (CAST(pow(2, z) AS BIGINT)) AS INT) AS y,
       CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'purchase' THEN 404 WHEN 'signup' THEN 503 ELSE 500 END AS http_status,
       CASE event_type WHEN 'view' THEN 'hit' WHEN 'click' THEN 'miss' ELSE 'unknown' END AS cache_state,
       value AS latency_ms, -value AS priority
FROM (SELECT *, CAST(4 + event_id % 3 AS INT) AS z FROM @events) t""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(re.sub(r"@(\w+)", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", SQL[name]))


def sql(name: str) -> str:
    return SQL[name].replace("@", "")


def ring_of(lon_c, lat_c, skew, half: float = 0.03125):
    """An imagery item's footprint: a square turned by a slope."""
    at = lambda dx, dy: F.struct((lon_c + dx - skew * dy).alias("x"), (lat_c + dy + skew * dx).alias("y"))
    return F.array(at(-half, -half), at(half, -half), at(half, half), at(-half, half))


def imagery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imagery items with their rings."""
    fx = table(spark, sf_dir, "fx_imagery")
    return fx.withColumn("ring", ring_of(F.col("lon_c"), F.col("lat_c"), F.col("skew")))


def building_rings():
    """A building's rings from cx, cy, hw, hh and shape: L is a rectangle without its north-east quarter, donut has a hole
    of half its size, turned the other way."""
    cx, cy, hw, hh = (F.col(c) for c in ("cx", "cy", "hw", "hh"))
    at = lambda dx, dy: F.struct((cx + hw * dx).alias("x"), (cy + hh * dy).alias("y"))
    rect = F.array(at(-1.0, -1.0), at(1.0, -1.0), at(1.0, 1.0), at(-1.0, 1.0))
    ell = F.array(at(-1.0, -1.0), at(1.0, -1.0), at(1.0, 0.0), at(0.0, 0.0), at(0.0, 1.0), at(-1.0, 1.0))
    hole = F.array(at(-0.5, -0.5), at(-0.5, 0.5), at(0.5, 0.5), at(0.5, -0.5))
    return F.when(F.col("shape") == "L", F.array(ell)).when(F.col("shape") == "donut", F.array(rect, hole)).otherwise(F.array(rect))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building features (id, height, num_floors, rings, bbox) in degrees."""
    fx = table(spark, sf_dir, "fx_buildings")
    box = F.struct((F.col("cx") - F.col("hw")).alias("xmin"), (F.col("cx") + F.col("hw")).alias("xmax"), (F.col("cy") - F.col("hh")).alias("ymin"), (F.col("cy") + F.col("hh")).alias("ymax"))
    return fx.select("id", "height", "num_floors", building_rings().alias("rings"), box.alias("bbox"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation tiles of 8 × 8 from embeddings: z, x, y, source, rank, pixels with -999999 for voids."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    value = lambda v: F.when(F.abs(v) < 0.01, -999999.0).otherwise(F.round(v.cast("double") * 2000, 3))
    source = F.when(F.col("label") % 3 == 0, "s1m").when(F.col("label") % 3 == 1, "usgs13").otherwise("farfield")
    return e.select(
        F.lit(15).alias("z"), (6000 + F.col("vec_id") % 50).cast("int").alias("x"), (12000 + F.col("label")).cast("int").alias("y"), source.alias("source"), F.col("vec_id").alias("rank"), F.lit(8).alias("size"), F.transform("embedding", value).alias("pixels")
    )


RASTER_SQL = """
SELECT 15 AS z, CAST(6000 + vec_id % 50 AS INT) AS x, CAST(12000 + label AS INT) AS y,
       CASE label % 3 WHEN 0 THEN 's1m' WHEN 1 THEN 'usgs13' ELSE 'farfield' END AS source, vec_id AS rank,
       list_transform(embedding, lambda v: CASE WHEN abs(v) < 0.01e0 THEN -999999e0 ELSE round(CAST(v AS DOUBLE) * 2000, 3) END) AS pixels
FROM embeddings"""
