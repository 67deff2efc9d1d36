"""Queries whose SQL can't show that all rows take part."""

from pyspark.sql import functions as F
from tilelake.plans import q_buildings


def test_ground_of_every_raster(spark, tmp_path):
    e = spark.range(700).select(F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding"))
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    owned = spark.range(700).select(F.lit(15).alias("tz"), F.lit(0).alias("tx"), F.col("id").cast("int").alias("ty"))
    assert {r["rank"] for r in q_buildings._ground(spark, str(tmp_path), owned).select("rank").collect()} == set(range(700))
