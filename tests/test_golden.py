"""Published values and invariants of single operators."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilelake.functions import geometry, projection, raster
from tilelake.functions import tilemath as tm
from tilelake.operators import buildings, dem, demand, imagery, validate
import in_batch
from tilelake.operators import raster as rops
from tilelake.plans import q_buildings
from tilelake.sources import catalogs, fixtures


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_maxzoom(spark):
    gsd = {0.6: 18, 0.15: 20, 1.0: 18, 0.08: 21}
    r = one(spark, *[tm.maxzoom_for_gsd(F.lit(g), 256) for g in gsd], *[tm.maxzoom_for_gsd(F.lit(g)) for g in gsd], tm.maxzoom_for_gsd(F.lit(0.3)))
    assert list(r) == [*gsd.values(), *[z - 1 for z in gsd.values()], 18]


def test_mercator(spark):
    r = one(spark, *[tm.merc_scale(F.lit(v)) for v in (25.76, 39.74, 49.0, 0.0)], *tm.lonlat_to_merc(F.lit(0.0), F.lit(0.0)), *tm.merc_to_lonlat(*tm.lonlat_to_merc(F.lit(-74.44), F.lit(40.5))))
    assert [round(v, 2) for v in r[:4]] == [1.11, 1.30, 1.52, 1.0]
    assert r[4] == 0 and abs(r[5]) < 1e-8 and abs(r[6] + 74.44) < 1e-9 and abs(r[7] - 40.5) < 1e-9


def test_bounds(spark):
    w, s, e, n = one(spark, *tm.tile_bounds_merc(F.lit(0), F.lit(0), F.lit(0)))
    assert e - w == n - s == 2 * 20037508.342789244
    _, _, _, top = one(spark, *tm.tile_bounds_merc(F.lit(3), F.lit(2), F.lit(0)))
    assert top == tm.HALF


def test_albers_round_trip(spark):
    pts = spark.createDataFrame([(-124.0, 25.0), (-96.0, 37.5), (-67.0, 49.0)], "lon double, lat double")
    x, y = projection.albers_forward(F.col("lon"), F.col("lat"))
    lon, lat = projection.albers_inverse(x, y)
    assert all(abs(r[0] - r[2]) < 1e-9 and abs(r[1] - r[3]) < 1e-9 for r in pts.select("lon", "lat", lon, lat).collect())


def test_terrarium(spark):
    v = [0.0, float("nan"), -999999.0, -86.0, 1.5, 123.456, 4418.0, 14.505]
    codes = list(one(spark, *[raster.encode_terrarium(F.lit(x)) for x in v]))
    assert codes[:3] == [raster.SEA] * 3 and np.array_equal(raster.np_terrarium(np.array(v)), codes)
    assert all(abs(c / 256 - 32768 - x) <= 1 / 512 for c, x in zip(codes[3:], v[3:], strict=True))
    assert list(one(spark, raster.decode_terrarium(F.lit(128), F.lit(100), F.lit(64)), raster.decode_terrarium(F.lit(127), F.lit(170), F.lit(0)))) == [100.25, -86.0]


@pytest.mark.parametrize(
    ("rule", "z", "x", "status"),
    [("imagery", 19, 0, "above_max_zoom"), ("imagery", 13, 0, "below_min_zoom"), ("imagery", 14, 16384, "out_of_range"), ("imagery", 14, 0, "ok"), ("terrain", 19, 0, "above_max_zoom"), ("basemap", 17, 0, "above_max_zoom"), ("buildings", 13, 0, "below_min_zoom")],
)
def test_validation(spark, rule, z, x, status):
    df = spark.createDataFrame([("naip", z, x, 0)], "layer string, z int, x int, y int")
    assert df.select(getattr(validate, rule)()).first()[0] == status


def test_region_prune(spark):
    ext = spark.createDataFrame([("nj", -75.6, 38.9, -73.9, 41.4), ("ca", -124.4, 32.5, -114.1, 42.0)], "region string, rxmin double, rymin double, rxmax double, rymax double")
    tiles = spark.createDataFrame([(12, 1204, 1541), (4, 1, 7)], "z int, x int, y int")
    assert [tuple(r) for r in imagery.region_prune(tiles, ext).collect()] == [(12, 1204, 1541, "nj")]


def test_newest_vintage_is_the_regions(spark):
    items = spark.createDataFrame([("a", "nj", 2019), ("b", "nj", 2021), ("c", "ca", 2018)], "id string, region string, year int")
    assert sorted(r.id for r in imagery.newest_vintage(items, 2020).collect()) == ["a", "c"]


def test_rank_order(spark):
    rows = [(1, 1, 1, "a", 2020, None), (1, 1, 1, "b", 2020, 0.6), (1, 1, 1, "c", 2021, 1.0), (1, 1, 1, "d", 2020, 0.3)]
    pairs = spark.createDataFrame(rows, "z int, x int, y int, id string, year int, gsd double")
    assert [r.id for r in imagery.rank_assets(pairs).orderBy("rank").collect()] == ["c", "d", "b", "a"]


def test_touching_counts():
    square = [np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])]
    hole = np.array([[0.2, 0.2], [0.2, 0.8], [0.8, 0.8], [0.8, 0.2]])
    assert in_batch.polygon_meets_box(square, 1.0, 0.0, 2.0, 1.0)
    assert not in_batch.polygon_meets_box(square, 1.001, 0.0, 2.0, 1.0)
    assert in_batch.polygon_meets_box(square, 0.4, 0.4, 0.6, 0.6)
    assert not in_batch.polygon_meets_box([*square, hole], 0.4, 0.4, 0.6, 0.6)
    assert in_batch.polygon_meets_box([*square, hole], 0.1, 0.4, 0.6, 0.6)
    assert in_batch.polygon_meets_box(square, -1.0, -1.0, 2.0, 2.0)


def test_clip():
    square = np.array([[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]])
    assert abs(in_batch.signed_area(in_batch.clip(square, 1, 1, 5, 5)) / 2 - 1) < 1e-12
    assert len(in_batch.clip(square, 3, 3, 5, 5)) == 0
    assert len(in_batch.clip(square[:2], 0, 0, 5, 5)) == 0


def test_polygons_by_orientation():
    outer, hole = np.array([[0, 0], [4, 0], [4, 4], [0, 4]]), np.array([[1, 1], [1, 2], [2, 2], [2, 1]])
    assert [len(p) for p in in_batch.polygons([outer, hole, outer + 10, hole[:2]])] == [2, 1]


def _tile(spark, *rows):
    return spark.createDataFrame(rows, "z int, x int, y int, pixels array<double>, failed boolean")


@pytest.mark.parametrize(
    ("z", "fine", "coarse", "far", "want"),
    [
        (15, ([400.0, None], False), ([250.0, 250.0], False), ([1.0, 1.0], False), ([400.0, 250.0], "s1m", "ok")),
        (15, ([400.0, 400.0], False), (None, True), None, ([400.0, 400.0], "s1m", "ok")),
        (15, ([400.0, None], False), (None, True), None, (None, None, "failed")),
        (15, (None, True), ([250.0, 250.0], False), None, (None, None, "failed")),
        (12, ([400.0, 400.0], False), ([250.0, None], False), ([1.0, 1.0], False), ([250.0, None], "usgs13", "ok")),
        (8, ([400.0, 400.0], True), ([250.0, None], True), ([1.0, 1.0], False), ([1.0, 1.0], "farfield", "ok")),
        (12, None, None, None, (None, None, "no_coverage")),
    ],
)
def test_cascade(spark, z, fine, coarse, far, want):
    tiles = spark.createDataFrame([(z, 0, 0)], "z int, x int, y int")
    tier = lambda t: _tile(spark, *([] if t is None else [(z, 0, 0, *t)]))
    r = rops.dem_cascade(tiles, tier(fine), tier(coarse), tier(far)).first()
    assert (r.pixels, r.dem_source, r.status) == want


def test_stitch(spark):
    kids = [(1, 0, 0, "ok", [10] * 4), (1, 1, 0, "ok", [20] * 4), (1, 0, 1, "ok", [30] * 4), (1, 3, 3, "ok", [40] * 4), (1, 2, 2, "failed", None)]
    df = spark.createDataFrame(kids, "z int, x int, y int, status string, pixels array<int>")
    got = {(r.x, r.y): r for r in rops.stitch_2x2(df, 2).collect()}
    assert got[0, 0].codes == [10, 10, 20, 20, 10, 10, 20, 20, 30, 30, raster.SEA, raster.SEA, 30, 30, raster.SEA, raster.SEA]
    assert got[1, 1].status == "failed" and got[1, 1].codes is None


def test_composite_and_ground(spark):
    r = one(spark, raster.composite_white(F.lit(255), F.lit(128)), raster.composite_white(F.lit(0), F.lit(128)), raster.composite_white(F.lit(7), F.lit(255)), raster.ground_at(F.array(*[F.lit(float(v)) for v in range(9)]), F.lit(3), F.lit(0.25), F.lit(1.0)))
    assert list(r) == [255, 127, 7, 7.0]


def test_flat_surface(spark):
    t = spark.createDataFrame([(15, 9588, 12348, 0, 512, [100.0] * (512 * 512))], "z int, x int, y int, rank long, size int, pixels array<double>")
    r = rops.surface_grid(t).first()
    lat = one(spark, tm.merc_to_lonlat(F.lit(0.0), F.lit(tm.HALF) - F.lit(12348.5) * tm.side(F.lit(15)))[1])[0]
    assert r.grid == 65 and abs(r.zs[0] - 100 / math.cos(math.radians(lat))) < 1e-6 and r.nx[0] == 0 and r.nz[0] == 1


def test_dem_names(spark):
    names = [("S1M_n41w074_20240101.tif",), ("x/S1M_n41w074_20240301.tif",), ("a/S1M_n41w074_20240301.tif",), ("n41w074_meta.tif",)]
    df = spark.createDataFrame(names, "dataset string")
    assert [r.dataset for r in dem.newest_per_location(df).collect()] == ["a/S1M_n41w074_20240301.tif"]
    assert dem.unparsed(df).first()[0] == 1
    c = one(spark, dem.name_to_cell(F.lit("USGS_13_n41w074.tif")).alias("c")).c
    assert (c.xmin, c.ymin, c.xmax, c.ymax) == (-74.0, 40.0, -73.0, 41.0)


def test_base_zoom_and_roots(spark):
    assert list(one(spark, *[demand.base_zoom(F.lit(v)) for v in (1000, 5000, 5001, 1280000, 1280001)])) == [12, 12, 11, 4, 3]
    df = spark.createDataFrame([(0.0, 0.0, 1000.0)], "x double, y double, alt double")
    assert demand.root_grid(df).count() == 25


def test_view_range(spark):
    rows = [(True, True, "s1m", 100.0 + 50 * k, 200.0 + 50 * k) for k in range(25)]
    df = spark.createDataFrame(rows, "visible boolean, loaded boolean, dem_source string, lo double, hi double")
    assert tuple(demand.view_elevation_range(df).first()) == (100.0, 1400.0)
    assert tuple(demand.view_elevation_range(df.limit(0)).first()) == (0.0, 4000.0)


def test_finest_tile(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "p int, px double, py double")
    at = {z: one(spark, *tm.tile_of_point(F.lit(0.0), F.lit(0.0), F.lit(z))) for z in (3, 4)}
    loaded = spark.createDataFrame([(3, *at[3], 100.0), (4, *at[4], 250.0)], "z int, x int, y int, elevation double")
    assert demand.finest_tile_at_point(points, "p", loaded).first().elevation == 250.0
    assert demand.finest_tile_at_point(points, "p", loaded.where("z = 9")).first().elevation is None


def test_retries_end():
    ts = datetime.datetime(2024, 1, 1)
    state = (0, False, None)
    for _ in range(3):
        state = demand.retry_step(state, 503, ts)
    assert state == (3, False, None)
    assert demand.retry_step(state, 404, ts) == (0, False, None)
    assert demand.retry_step((1, True, None), 500, ts)[2] == ts + datetime.timedelta(seconds=5)


def test_one_wall_tile_and_roofs_cover(spark, data):
    rec = q_buildings._records(spark, data)
    walls = {(r.id, r.tx, r.ty) for r in buildings.wall_owner(rec, 18).collect()}
    roofs = {(r.id, r.tx, r.ty) for r in buildings.roof_overlap(rec, 18).collect()}
    assert len(walls) == rec.count() and walls <= roofs


def test_roof_parts_add_up(spark, data):
    rec = q_buildings._records(spark, data)
    area = lambda polys: sum(in_batch.signed_area(np.array([[p.x, p.y] for p in r])) for poly in polys for r in poly)
    whole = {r.id: area(r.polygons) for r in rec.collect()}
    parts: dict = {}
    side = tm.SIDE / 2**14
    for r in buildings.roof_parts(rec, 17).collect():
        parts[r.id] = parts.get(r.id, 0) + area(r.polygons)
    inside = [r.id for r in rec.collect() if r.box.xmin >= 0 and r.box.xmax <= side and r.box.ymax <= 0 and r.box.ymin >= -side]
    assert inside and all(abs(parts[k] - whole[k]) < 1e-3 for k in inside)


def test_cell_join_equals_brute_force(spark, data):
    from tilelake.plans.q_imagery import items
    from tilelake.plans.q_tiles import tiles

    t, i = tiles(spark, data), items(spark, data)
    pairs = {tuple(r) for r in imagery.tiles_x_imagery(t, i, exact=False).select("z", "x", "y", "id").collect()}
    brute = imagery.with_box(t).crossJoin(i).where("xmin <= e and xmax >= w and ymin <= n and ymax >= s")
    assert pairs == {tuple(r) for r in brute.select("z", "x", "y", "id").collect()}
    exact = {tuple(r) for r in imagery.tiles_x_imagery(t, i).select("z", "x", "y", "id").collect()}
    assert exact < pairs and len(pairs) == 348 and len(exact) == 343


def test_catalog_prunes(spark, data, tmp_path):
    i = fixtures.imagery(spark, data).select("id", "ring", "xmin", "ymin", "xmax", "ymax", "properties", "assets", F.lit("naip").alias("collection"), "region", "year")
    catalogs.write_imagery_catalog(i, str(tmp_path / "cat"))
    df = catalogs.read_imagery_catalog(spark, str(tmp_path / "cat"), "naip", ["nj"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == i.where("region = 'nj'").count() and "PartitionFilters: [isnotnull(collection" in plan


def test_listing(spark, tmp_path):
    (tmp_path / "s" / "a").mkdir(parents=True)
    for n in ("a/x.tif", "a/y.txt", "z.tif"):
        (tmp_path / "s" / n).write_bytes(b"x")
    assert sorted(r.dataset for r in catalogs.read_listing(spark, str(tmp_path / "s")).collect()) == ["a/x.tif", "z.tif"]


def test_broken_catalog_is_an_error(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"nothing")
    with pytest.raises(Exception, match="(?i)parquet"):
        catalogs.read_dem_catalog(spark, str(tmp_path / "bad.parquet")).count()


def test_boxes_meet_once(spark):
    """Boxes over many cells, points and touching edges, against brute force; null boxes meet none."""
    import random

    rng = random.Random(3)
    rows = lambda n: [(k, x := rng.randint(-12, 12) / 4, y := rng.randint(-12, 12) / 4, x + rng.randint(0, 9) / 4, y + rng.randint(0, 9) / 4) for k in range(n)]
    a, b = rows(60), rows(60)
    left = spark.createDataFrame([*a, (60, None, 0.0, 1.0, 1.0)], "i int, w double, s double, e double, n double")
    right = spark.createDataFrame(b, "j int, x0 double, y0 double, x1 double, y1 double")
    got = [(r.i, r.j) for r in geometry.join_boxes(left, right, tuple("wsen"), ("x0", "y0", "x1", "y1")).collect()]
    want = [(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]]
    assert sorted(got) == sorted(want)


def test_numbers_across_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(7)
    got = catalogs.numbered(rows, "v", "fid").orderBy("v").collect()
    assert [r.fid for r in got] == list(range(1, 5001))
    assert catalogs.numbered(rows.limit(0), "v", "fid").count() == 0


def test_resolve_reads_the_folders_of_the_regions_it_needs(spark, data):
    """Region prune becomes a partition filter; tiles of one region leave the others' files alone."""
    from tilelake.plans import q_imagery

    catalogue = q_imagery.catalogue(spark, data)
    tile = q_imagery.requested(spark, data)
    near = q_imagery.im.region_prune(tile, q_imagery.im.region_extents(catalogue)).where("region = 'wy'").select("z", "x", "y").distinct().limit(5)
    got = q_imagery.resolve(near, catalogue, q_imagery.YEAR)
    scans = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x and "region" in x]
    assert scans and any("region" in x.split("PartitionFilters: [")[1].split("]")[0] and "'ca'" not in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)
    status = {r.status for r in q_imagery.job_resolve_imagery(spark, data).select("status").distinct().collect()}
    assert {"ok", "no_coverage", "below_min_zoom", "out_of_range"} <= status


def test_catalogue_stream_restarts_from_its_folder(spark, tmp_path):
    """An empty stream leaves the catalogue as it is; a second run with the same folders goes on from the first's."""
    from tilelake.streaming import jobs

    at = lambda n, day: (f"S1M/b1/S1M_n{n}w1000_202401{day}.tif", -1e6, -1e6 + 1e4, n * 1e3 - 1e4, n * 1e3)
    rows = [[at(1500, 11)], [at(1500, 12), at(1510, 11)]]
    put = lambda k: spark.createDataFrame(rows[k], jobs.CATALOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/listing")
    spark.createDataFrame([], jobs.CATALOG).write.parquet(f"{tmp_path}/none")
    known = spark.createDataFrame(rows[0], jobs.CATALOG)
    stream = lambda name: spark.readStream.schema(jobs.CATALOG).parquet(f"{tmp_path}/{name}")
    assert jobs.catalog_ingest(stream("none"), lambda: known).collect() == known.collect()
    for k in range(2):
        put(k)
        got = jobs.catalog_ingest(stream("listing"), root=f"{tmp_path}/root", state=f"{tmp_path}/state")
    assert {r.dataset for r in got.collect()} == {rows[1][0][0], rows[1][1][0]}


def test_checked_files_are_split_in_one_pass(spark, tmp_path):
    good = dem.PROJECTION
    rows = [("a", good, 0.0, 10000.0, 0.0, 10000.0), ("b", good | {"ellps": "WGS84", "x_0": "1"}, 0.0, 10000.0, 0.0, 10000.0), ("c", good, 0.0, 10000.0, 0.0, 9000.0), ("d", None, 0.0, None, 0.0, 1.0), ("e", {k: v for k, v in good.items() if k != "ellps"}, 0.0, 10000.0, 0.0, 10000.0)]
    df = spark.createDataFrame(rows, "dataset string, params map<string,string>, xmin double, xmax double, ymin double, ymax double")
    kept, rejected, totals = dem.split_checked(df, f"{tmp_path}/checked")
    assert [r.dataset for r in kept.collect()] == ["a"] and totals == {"checked": 5, "rejected": 4}
    names = ",".join(sorted(good))
    assert {r.dataset: r.reason for r in rejected.collect()} == {"b": "projection: ellps,x_0", "c": "box", "d": f"projection: {names}; box", "e": "projection: ellps"}
    assert dem.split_checked(df.limit(0), f"{tmp_path}/none")[0].count() == 0
