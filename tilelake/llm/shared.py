"""Where intermediate tables go, and other helpers of several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it names none, a folder of our own if all
    runs on this machine, as in tests, else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs nothing."""
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in a new folder under the shared one, read back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", shares: int = 1024, least: int = 4096) -> DataFrame:
    """big joined with small, which has few rows for a key, though one key may be that of a third of big's rows.

    Keys with more than ``least`` rows and a share of 1 / shares of big's are fewer than shares, at any size, so their rows
    of small are broadcast; the others are joined in a shuffle in which no key has more rows than that. big is read
    several times and should be a written table. how: inner or left. Null keys match nothing.
    """
    counts = big.groupBy(*keys).count()
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    limit = max((total or 0) / shares, least)
    if (most or 0) <= limit:
        return big.join(small, keys, how)
    hot = F.broadcast(written(counts.where(F.col("count") > limit).select(*keys), "hot-keys"))
    of_hot = big.join(hot, keys, "left_semi").join(F.broadcast(small.join(hot, keys, "left_semi")), keys, how)
    return of_hot.unionByName(big.join(hot, keys, "left_anti").join(small, keys, how))
