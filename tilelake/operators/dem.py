"""The elevation catalogue: newest file of each location, incremental rebuild, checks, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tilelake.functions import geometry, projection

#: Names of catalogued files, and where they are.
NAME = r"(n\d+[ew]\d+)_(\d{8})\.tif$"
PREFIX = "s3://prd-tnm/StagedProducts/Elevation/"
#: Side of a grid cell of the join, in metres.
CELL = 20000.0
#: The projection that catalogued files have.
PROJECTION = {"proj": "aea", "lat_0": "23", "lat_1": "29.5", "lat_2": "45.5", "lon_0": "-96", "x_0": "0", "y_0": "0", "units": "m", "ellps": "GRS80"}
CONUS = (-125.0, 24.0, -66.5, 49.5)


def parsed(listing: DataFrame) -> DataFrame:
    """listing with location and issue; both are empty for names of another form."""
    return listing.withColumn("location", F.regexp_extract("dataset", NAME, 1)).withColumn("issue", F.regexp_extract("dataset", NAME, 2))


def newest_per_location(listing: DataFrame) -> DataFrame:
    """The rows of the greatest issue of each location; of equal issues, the least dataset. Names of another form are left
    out (``unparsed`` counts them)."""
    p = parsed(listing).where("location != ''")
    row = F.struct(*[c for c in p.columns if c not in ("location", "issue")])
    # the greatest issue, then the least name: issues are compared as text, so their complement orders them downwards
    best = F.min_by(F.struct("issue", row.alias("row")), F.struct((F.lit(99999999) - F.col("issue").cast("int")).alias("k"), "dataset"))
    return p.groupBy("location").agg(best.alias("b")).select("location", "b.issue", "b.row.*")


def unparsed(listing: DataFrame) -> DataFrame:
    return parsed(listing).agg(F.count_if(F.col("location") == "").alias("unparsed"))


def index_todo(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files not in the catalogue yet."""
    return current.join(indexed.select("dataset"), "dataset", "left_anti")


def index_stale(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Catalogued files that are gone upstream."""
    return indexed.join(current.select("dataset"), "dataset", "left_anti")


def index_reuse(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Catalogued rows of files that are still there: a file never changes, so its bounds hold."""
    return indexed.join(current.select("dataset"), "dataset", "left_semi")


def check_projection(params: Column, expected: dict[str, str] = PROJECTION) -> Column:
    """Names of the expected parameters that a map lacks or has otherwise, in order."""
    names = F.array(*[F.lit(k) for k in sorted(expected)])
    want = F.create_map(*[F.lit(v) for pair in sorted(expected.items()) for v in pair])
    return F.filter(names, lambda k: ~F.coalesce(F.try_element_at(params, k) == F.element_at(want, k), F.lit(False)))


def rejection(params: Column, side: float = 10000.0) -> Column:
    """Why a file with these parameters and a box (xmin, xmax, ymin, ymax) isn't catalogued; null if it is. Unknown parameters
    are those of another projection."""
    differs = check_projection(F.coalesce(params, F.create_map().cast("map<string,string>")))
    square = (F.col("xmax") - F.col("xmin") == side) & (F.col("ymax") - F.col("ymin") == side)
    why = F.array_compact(F.array(F.when(F.size(differs) > 0, F.concat(F.lit("projection: "), F.array_join(differs, ","))), F.when(~F.coalesce(square, F.lit(False)), F.lit("box"))))
    return F.when(F.size(why) > 0, F.array_join(why, "; "))


def split_checked(files: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Good files, and rejected ones with their reason, of files (params, xmin, xmax, ymin, ymax, ...), in one pass that writes
    both under path; and how many were checked and rejected, as counted on the way."""
    seen = Observation("checked")
    rows = files.withColumn("reason", rejection(F.col("params"))).withColumn("good", F.col("reason").isNull()).observe(seen, F.count("*").alias("checked"), F.count_if(~F.col("good")).alias("rejected"))
    rows.write.partitionBy("good").parquet(path)
    back = files.sparkSession.read.schema(rows.schema).parquet(path)
    return back.where("good").drop("good", "reason"), back.where("not good").drop("good"), seen.get


def dem_href(dataset: Column) -> Column:
    return F.concat(F.lit(PREFIX), dataset)


def name_to_cell(name: Column) -> Column:
    """The 1-degree cell that a name like n41w074 gives by its north-west corner: xmin, ymin, xmax, ymax."""
    n = F.regexp_extract(name, r"n(\d+)[ew]", 1).try_cast("double")
    lon = F.regexp_extract(name, r"[ew](\d+)", 1).try_cast("double")
    west = F.when(name.rlike(r"n\d+w"), -lon).otherwise(lon)
    return F.struct(west.alias("xmin"), (n - 1).alias("ymin"), (west + 1).alias("xmax"), n.alias("ymax"))


def tiles_x_dem(tiles: DataFrame, items: DataFrame, cell: float = CELL) -> DataFrame:
    """(z, x, y, dataset) of tiles and catalogue boxes (xmin, xmax, ymin, ymax in Albers metres) that meet, touching
    included. Both are spread over cells; a pair is kept in the one cell of the greater lower corner."""
    at = lambda v: F.floor(v / cell).cast("int")
    env = projection.tile_envelope_albers(F.col("z"), F.col("x"), F.col("y"))
    # inline keeps the long expressions from being repeated where the columns are used
    t = tiles.select("z", "x", "y", F.inline(F.array(F.struct(*[c.alias(n) for c, n in zip(env, ("txmin", "txmax", "tymin", "tymax"), strict=True)]))))
    spread = lambda df, a, b, c, d: df.withColumn("cx", F.explode(F.sequence(at(F.col(a)), at(F.col(b))))).withColumn("cy", F.explode(F.sequence(at(F.col(c)), at(F.col(d)))))
    pairs = spread(t, "txmin", "txmax", "tymin", "tymax").join(spread(items, "xmin", "xmax", "ymin", "ymax"), ["cx", "cy"])
    own = (F.col("cx") == at(F.greatest("txmin", "xmin"))) & (F.col("cy") == at(F.greatest("tymin", "ymin")))
    meets = geometry.bbox_meets(tuple(F.col(c) for c in ("txmin", "tymin", "txmax", "tymax")), tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    return pairs.where(own & meets).select("z", "x", "y", "dataset")


def ring_lonlat(xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """A box's corners in degrees, counter-clockwise from the south-west."""
    corners = F.array(geometry.point(xmin, ymin), geometry.point(xmax, ymin), geometry.point(xmax, ymax), geometry.point(xmin, ymax))

    def back(p: Column) -> Column:
        return geometry.point(*projection.albers_inverse(p["x"], p["y"]))

    return F.transform(corners, back)


def in_conus(ring: Column) -> Column:
    """Whether the centroid of a ring lies in the box of the contiguous states, edges included. The ring comes up some
    hundred times in it, so it should be a column that is there (``with_ring``), not an expression."""
    x, y = geometry.ring_centroid(ring)
    return x.between(CONUS[0], CONUS[2]) & y.between(CONUS[1], CONUS[3])


def with_ring(items: DataFrame) -> DataFrame:
    """items (xmin, xmax, ymin, ymax, ...) with their ring in degrees. inline makes it once for each row; Spark would else put
    its expression, four inverse projections, in each place where the column is used. Rows are few bytes and much work, so
    they are dealt out evenly first: a file of a million makes one task."""
    made = ring_lonlat(*[F.col(c) for c in ("xmin", "xmax", "ymin", "ymax")])
    dealt = items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select("*", F.inline(F.array(F.struct(made.alias("ring")))))


def coverage_features(items: DataFrame, kind: str) -> DataFrame:
    """(dataset, href, type, ring) of catalogue rows; the ring in degrees to five places. Rows whose centroid lies outside
    the contiguous states are left out."""
    r = with_ring(items).where(in_conus(F.col("ring")))
    rounded = F.transform("ring", lambda p: F.struct(F.round(p["x"], 5).alias("x"), F.round(p["y"], 5).alias("y")))
    return r.select("dataset", dem_href(F.col("dataset")).alias("href"), F.lit(kind).alias("type"), rounded.alias("ring"))


def coverage_union(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Both sets of features with their duplicates; ``ord`` puts the fine ones first."""
    return fine.withColumn("ord", F.lit(0)).unionByName(coarse.withColumn("ord", F.lit(1)))


def feature_json(ring: Column) -> Column:
    """A GeoJSON feature of columns dataset, href, type and a ring, closed."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    geometry_ = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("dataset", "href", "type").alias("properties"), geometry_.alias("geometry")))
