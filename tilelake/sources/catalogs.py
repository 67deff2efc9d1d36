"""Readers and writers of catalogues, listings, coverage files and tile tables. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilelake.functions import geometry
from tilelake.functions import tilemath as tm
from tilelake.sources import scratch

IMAGERY = "id string, ring array<struct<x:double,y:double>>, xmin double, ymin double, xmax double, ymax double, properties string, assets string, collection string, region string, year int"
DEM = "fid bigint, dataset string, bbox_xmin double, bbox_xmax double, bbox_ymin double, bbox_ymax double"
BUILDINGS = "id string, height double, num_floors int, rings array<array<struct<x:double,y:double>>>, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>"
MANIFEST = "file string, bbox_xmin double, bbox_xmax double, bbox_ymin double, bbox_ymax double"
#: Bytes of a row group of a catalogue: about 2000 rows.
CATALOG_GROUP = 256 << 10


def read_imagery_catalog(spark: SparkSession, root: str, collection: str, regions: list[str] | None = None) -> DataFrame:
    """Items under collection=/region=/year= folders; only the asked folders are read."""
    items = spark.read.schema(IMAGERY).parquet(root).where(F.col("collection") == collection)
    return items if regions is None else items.where(F.col("region").isin(regions))


def write_imagery_catalog(items: DataFrame, root: str) -> None:
    """Hive tree by collection, region and year; within a file, items lie along a Z curve, so their box columns prune. Items
    are dealt by range along folders and curve, so a folder with many is a file for each stretch of its curve and no task
    holds a whole folder; their id parts those of one place."""
    x, y = tm.tile_of_point(*tm.lonlat_to_merc((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2), F.lit(14))
    # inline makes the tile once; the curve's fold would repeat it for each bit
    placed = items.select("*", F.inline(F.array(F.struct(x.alias("_x"), y.alias("_y"))))).withColumn("_q", tm.quadkey(F.lit(14), F.col("_x"), F.col("_y"))).drop("_x", "_y")
    ordered = placed.repartitionByRange("collection", "region", "year", "_q", "id").sortWithinPartitions("collection", "region", "year", "_q").drop("_q")
    ordered.write.partitionBy("collection", "region", "year").parquet(root)


def read_dem_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue that can't be read is an error, never an empty one."""
    return spark.read.schema(DEM).parquet(path)


def write_dem_catalog(items: DataFrame, path: str) -> None:
    """fid counts from 1 in order of dataset. Files and row groups lie in order of the box's lower left corner, so their
    box columns prune."""
    rows = numbered(items.select("dataset", *[F.col(c).alias(f"bbox_{c}") for c in ("xmin", "xmax", "ymin", "ymax")]), "dataset", "fid")
    near = rows.select("fid", "dataset", "bbox_xmin", "bbox_xmax", "bbox_ymin", "bbox_ymax").repartitionByRange("bbox_ymin", "bbox_xmin")
    near.sortWithinPartitions("bbox_ymin", "bbox_xmin").write.option("parquet.block.size", CATALOG_GROUP).parquet(path)


def numbered(rows: DataFrame, by: str, out: str) -> DataFrame:
    """rows with their number from 1 in order of ``by``. The rows are dealt by range and numbered within each range; what
    lies before a range comes from one count for each, so no task holds all rows."""
    dealt = scratch.written(rows.repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return dealt.withColumn("_place", place).join(before, "_range").withColumn(out, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def read_listing(spark: SparkSession, root: str, suffix: str = ".tif") -> DataFrame:
    """(dataset) of the objects under a folder, as paths below it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select(F.regexp_replace(F.substring_index("path", root.rstrip("/").rpartition("/")[2] + "/", -1), "^/", "").alias("dataset"))


def manifest_prune(tiles: DataFrame, manifest: DataFrame, scheme: str = "") -> DataFrame:
    """(file) once each: files whose box meets one of the tiles' boxes (w, s, e, n); a scheme goes before the name."""
    return tiles_x_manifest(tiles, manifest).select(F.concat(F.lit(scheme), "file").alias("file")).distinct()


def tiles_x_manifest(tiles: DataFrame, manifest: DataFrame) -> DataFrame:
    """tiles with boxes (w, s, e, n), joined to the files whose box meets them."""
    return geometry.join_boxes(tiles, manifest, tuple("wsen"), ("bbox_xmin", "bbox_ymin", "bbox_xmax", "bbox_ymax"))


def read_buildings(spark: SparkSession, files: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    """Features of the files that a manifest query named, cut to the job's whole box by the nested box columns, which
    reach the scan."""
    w, s, e, n = box
    features = spark.read.schema(BUILDINGS).parquet(*files)
    return features.where((F.col("bbox.xmin") <= e) & (F.col("bbox.xmax") >= w) & (F.col("bbox.ymin") <= n) & (F.col("bbox.ymax") >= s))


def write_coverage_geojson(features: DataFrame, root: str) -> None:
    """One gzip FeatureCollection for each type, features in order of dataset, one on each line. features: (dataset, href,
    type, feature) with feature as JSON text. A type is one file, as its readers expect; its rows are sorted, which can
    spill, and written one by one."""
    order = Window.partitionBy("type").orderBy("dataset", "feature")
    head = F.when(F.row_number().over(order) == 1, '{"type":"FeatureCollection","features":[').otherwise(",")
    tail = F.when(F.lead(F.lit(True)).over(order).isNull(), "]}").otherwise("")
    features.select("type", F.concat(head, "feature", tail).alias("value")).write.option("compression", "gzip").partitionBy("type").text(root)


def read_coverage_geojson(spark: SparkSession, root: str) -> DataFrame:
    """(type, feature) of the collections under a folder, feature with its properties and rings."""
    feature = "struct<type:string,properties:struct<dataset:string,href:string,type:string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>"
    whole = spark.read.schema("value string, type string").text(root, wholetext=True)
    return whole.select("type", F.explode(F.from_json("value", f"type string, features array<{feature}>")["features"]).alias("feature"))


def write_tile_table(tiles: DataFrame, root: str) -> None:
    """Tiles with status ok, by layer, year and zoom, along a Z curve within a zoom."""
    ok = tiles.where("status = 'ok'").withColumn("quadkey", tm.quadkey(F.col("z"), F.col("x"), F.col("y")))
    ok.repartitionByRange("layer", "year", "z", "quadkey").sortWithinPartitions("layer", "year", "z", "quadkey").write.partitionBy("layer", "year", "z").parquet(root)


def bake_manifest(tiles: DataFrame) -> DataFrame:
    """(layer, year, z, x0, x1, y0, y1, lon, lat) of the tiles; lon and lat are the middle of the block. NaN is an error."""
    block = tiles.groupBy("layer", "year", "z").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    s = tm.side(F.col("z"))
    lon, lat = tm.merc_to_lonlat((F.col("x0") + F.col("x1") + 1) / 2 * s - tm.HALF, F.lit(tm.HALF) - (F.col("y0") + F.col("y1") + 1) / 2 * s)
    sure = lambda c: F.when(F.isnan(c), F.raise_error(F.lit("the manifest's centre is not a number"))).otherwise(c)
    return block.withColumn("lon", sure(lon)).withColumn("lat", sure(lat))
