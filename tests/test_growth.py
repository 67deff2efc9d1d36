"""Plans and rows that must not grow with the input."""

import datetime

from pyspark.sql import functions as F

from tilelake.functions import tilemath as tm
from tilelake.operators import demand, imagery
from tilelake.plans import q_dem, q_demand, q_imagery
from tilelake.sources import catalogs
from tilelake.streaming import jobs


def final_plan(df):
    """The plan that ran, without the initial one."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def broadcast_rows(df):
    """What the plan that ran reads below its broadcasts: the lines of each, as one text."""
    lines, found = final_plan(df).split("\n"), []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            at = line.index("BroadcastExchange")
            below = [line]
            for other in lines[k + 1 :]:
                if len(other) <= at or not other[:at].strip(" :+-") == "":
                    break
                below.append(other)
            found.append("\n".join(below))
    return found


def test_rows_of_points_are_not_broadcast(spark, data):
    """points times zooms were broadcast, as Spark took the events' file for their size; only loaded tiles may be."""
    for query in (q_demand.finest_tile_at_point, q_demand.agl):
        got = broadcast_rows(query(spark, data))
        assert got and all("Generate" not in x and "elevation" in x for x in got)


def test_finest_of_coarse_and_fine_tiles(spark):
    """Tiles of all zooms, on both sides of the broadcast ones."""
    rows = [(k, 1e6 * k - 3e6, 2e6 - 5e5 * k) for k in range(8)]
    points = spark.createDataFrame(rows, "p int, px double, py double")
    x, y = tm.tile_of_point(F.col("px"), F.col("py"), F.col("z"))
    every = points.select("p", "px", "py", F.explode(F.sequence(F.lit(0), F.lit(18))).alias("z")).select("p", "z", x.alias("x"), y.alias("y"))
    loaded = every.where("p > 0 and (z = p or z = 2 * p or z = p + 9)").groupBy("z", "x", "y").agg((F.max("z") * 10.0 + F.min("p")).alias("elevation"))
    for top in (5, 8, 18):
        got = {r.p: (r.z, r.elevation) for r in demand.finest_tile_at_point(points, "p", loaded, top).collect()}
        near = every.withColumnRenamed("p", "q").join(loaded, ["z", "x", "y"]).where(F.col("z") <= top).collect()
        want = {q: max(((r.z, r.elevation) for r in near if r.q == q), default=(None, None)) for q in range(8)}
        assert got == want and len(set(want.values())) > 3


def test_points_of_one_key_and_of_none_keep_their_rows(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 1e7, 1e7), (None, 0.0, 0.0)], "p int, px double, py double")
    x, y = spark.range(1).select(*tm.tile_of_point(F.lit(0.0), F.lit(0.0), F.lit(4))).first()
    loaded = spark.createDataFrame([(4, x, y, 250.0)], "z int, x int, y int, elevation double")
    got = [tuple(r) for r in demand.finest_tile_at_point(points, "p", loaded).collect()]
    assert sorted(got, key=repr) == sorted([(1, 4, 250.0), (1, 4, 250.0), (2, None, None), (None, None, None)], key=repr)


def test_a_ring_is_made_once_for_each_row(spark, data):
    """the inverse projection stood in the plan wherever the ring was used; rows of one small file were one task."""
    for query in (q_dem.conus_filter, q_dem.coverage_features, q_dem.coverage_union):
        df = query(spark, data)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("atan2(") == plan.count("Repartition ") == (2 if query is q_dem.coverage_union else 1)


def test_no_join_of_all_items_on_a_few_keys(spark, data):
    """items were joined on their zoom alone, eleven keys for all of them; now each join is on cells."""
    for query in (q_imagery.tiles_x_imagery, q_imagery.bbox_prune):
        plan = query(spark, data)._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.split("\n") if "Join " in x]
        assert joins and all("cx#" in x and "cy#" in x for x in joins)


def rows_read(df):
    """The rows that tasks read from shuffles while df is made: a list for each stage that read any."""
    sc = df.sparkSession.sparkContext
    sc.setJobGroup("rows_read", "")
    try:
        df.collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker, store, found = sc.statusTracker(), sc._jsc.sc().statusStore(), []
    for stage in {k for job in tracker.getJobIdsForGroup("rows_read") for k in tracker.getJobInfo(job).stageIds}:
        tasks = store.taskList(stage, 0, 10_000)
        each = [tasks.apply(k).taskMetrics().get().shuffleReadMetrics().recordsRead() for k in range(tasks.size())]
        found += [each] if any(each) else []
    return found


def test_no_task_reads_all_items(spark, data):
    """all items of a zoom were one key and so one task's, at any number of partitions."""
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "61"}
    old = {k: spark.conf.get(k, None) for k in own}
    n = q_imagery.items(spark, data).count()
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        found = rows_read(q_imagery.bbox_prune(spark, data).select("id"))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert max(map(sum, found)) > n > 4 * max(map(max, found))


def test_tiles_of_all_zooms_meet_items_once(spark):
    """Pairs of tiles of zooms 0 to 13 and items against brute force: small items, large ones and those on edges of cells."""
    at = lambda k, x, y, half: (k, x - half, y - half, x + half, y + half, [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)])
    rows = [at(0, -90.0, 40.0, 0.03), at(1, -90.1, 40.2, 5.0), at(2, 0.0, 0.0, 1e-3), at(3, -89.82421875, 41.0, 0.0), at(4, 12.0, 66.0, 0.4), at(5, -45.0, 0.02, 0.5)]
    items = spark.createDataFrame(rows, "id int, xmin double, ymin double, xmax double, ymax double, ring array<struct<x:double,y:double>>")
    x, y = tm.tile_of_point(*tm.lonlat_to_merc((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2), F.col("z"))
    middles = items.select("xmin", "xmax", "ymin", "ymax", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("z")).select("z", x.alias("x"), y.alias("y"))
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    tiles = middles.select("z", "x", "y", near.alias("i")).select("z", (F.col("x") + F.col("i")).alias("x"), "y", near.alias("j")).select("z", "x", (F.col("y") + F.col("j")).alias("y"))
    tiles = tiles.where("x between 0 and pow(2, z) - 1 and y between 0 and pow(2, z) - 1").distinct()
    want = [tuple(r) for r in imagery.with_box(tiles).crossJoin(items).where("xmin <= e and xmax >= w and ymin <= n and ymax >= s").select("z", "x", "y", "id").collect()]
    for exact in (False, True):
        got = [tuple(r) for r in imagery.tiles_x_imagery(tiles, items, exact=exact).select("z", "x", "y", "id").collect()]
        assert sorted(got) == sorted(want) and len({r[0] for r in got}) == 14


def test_a_folder_of_the_catalogue_is_written_by_several_tasks(spark, tmp_path):
    """F8: all items of a region and year were one task's, even those of one place."""
    x = F.when(F.col("id") % 2 == 0, -90.0).otherwise(F.col("id") / 100 - 100)
    box = spark.range(3000).select(F.concat(F.lit("m_"), F.col("id").cast("string")).alias("id"), x.alias("xmin"), F.lit(40.0).alias("ymin"), (x + 0.06).alias("xmax"), F.lit(40.06).alias("ymax"))
    items = box.withColumns({"properties": F.lit("{}"), "assets": F.lit("{}"), "collection": F.lit("naip"), "region": F.lit("nj"), "year": F.lit(2019)})
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        catalogs.write_imagery_catalog(items, str(tmp_path / "cat"))
    finally:
        spark.conf.unset(key)
    files = list((tmp_path / "cat").rglob("*.parquet"))
    sizes = [spark.read.parquet(str(f)).count() for f in files]
    assert sum(sizes) == 3000 and len(sizes) > 4 and max(sizes) < 1000


TRACK = "track_id long, ts timestamp, event_id long, x double, y double, alt double"


def velocities(spark, folder, triggers, gap, **more):
    """Rows of the stream over triggers of rows and of its batch twin, and the most states that it kept."""
    for rows in triggers:
        spark.createDataFrame(rows, TRACK).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = jobs.velocities(spark.readStream.schema(TRACK).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), gap, **more)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    names = jobs.MOVES.replace(" long", "").replace(" double", "").split(", ")
    got = spark.read.schema(stream.schema).parquet(f"{folder}/out").select(names).collect()
    want = demand.track_velocity(spark.read.schema(TRACK).parquet(f"{folder}/in"), gap).select(names).collect()
    return sorted(map(tuple, got), key=repr), sorted(map(tuple, want), key=repr), max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)


def test_states_of_a_stream_do_not_grow_with_tracks(spark, tmp_path):
    """each track was a group and a call of its own; now a bucket is. Tracks and events without a number, large numbers, steps of
    no time, positions and times without a value, tracks that miss a trigger."""
    start = datetime.datetime(2024, 1, 1)
    at = lambda k: start + datetime.timedelta(microseconds=k * 1_234_567)
    rows = [(k * 7919 % 61 + 2**60, at(k - k % 3), k + 2**60, k * 997.3 % 4000, k * 499.7 % 3000, 50.0 * k) for k in range(900)]
    rows += [(None, at(k), k, 3.5 * k, -k / 3, None) for k in range(0, 900, 90)]
    rows += [(5, at(k), None if k == 400 else k, None if k == 300 else 2.5 * k, k / 7, 1.0) for k in range(0, 900, 50)]
    rows += [(6, None, 1, 1.0, 2.0, 3.0), (6, at(10), 2, 4.0, 5.0, 6.0), (6, at(20), 3, 14.0, 25.0, 6.0)]
    triggers = [[r for r in rows if lo <= (r[1] or start) < hi] for lo, hi in ((start, at(300)), (at(300), at(600)), (at(600), at(900)))]
    got, want, states = velocities(spark, tmp_path, triggers, 100.0, buckets=4)
    assert got == want and len(got) == len(rows) and states <= 5 and sum(r[5] != 0 for r in got) > 500


def test_a_stream_knows_a_track_as_long_as_a_gap_counts(spark, tmp_path):
    """a track was forgotten an hour behind the watermark, also where longer gaps count; later it goes, alone in its bucket or not."""
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    hours = [(1, 0.0), (2, 1.5), (3, 1.6), (1, 2.0), (2, 20.0), (3, 21.0), (2, 21.5), (1, 22.0)]
    got, want, states = velocities(spark, tmp_path, [[(k, at(h), i, 1000.0 * h, 50.0, 9.0)] for i, (k, h) in enumerate(hours)], 6 * 3600.0, delay="10 minutes")
    assert got == want and sum(r[5] != 0 for r in got) == 2 and states == 3


def test_rows_without_an_order_are_in_a_stream(spark):
    batch = spark.createDataFrame([(k, None if k % 5 == 0 else k) for k in range(20)], "id int, at int")
    assert sorted(r.id for r in jobs.drain(jobs.source(spark, batch, 3, "at")).collect()) == list(range(20))
