"""Refinement of sets of positions against refinement of each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilelake.functions import tilemath as tm
from tilelake.operators import demand, refine
from tilelake.plans import q_demand

POSITIONS = "id long, x double, y double, alt double"


def near(rng, n, spread):
    """Positions around one place, from near the ground to high up."""
    return [(k, -9e6 + float(rng.normal(0, spread)), 4.5e6 + float(rng.normal(0, spread)), float(rng.choice([40, 800, 3000, 60000, 2e6]) * rng.uniform(0.5, 1.5))) for k in range(n)]


def each(df, **kw):
    return {tuple(r) for r in demand.lod_tiles(df, ["id"], **kw).select("z", "tx", "ty").distinct().collect()}


def together(df, **kw):
    got = [tuple(r) for r in refine.demanded_tiles(df, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("spread", [0.0, 50.0, 20000.0, 3e6])
def test_the_tiles_are_those_of_each_position(spark, spread):
    df = spark.createDataFrame(near(np.random.default_rng(5), 300, spread), POSITIONS)
    assert together(df) == each(df)
    assert together(df, max_zoom=13, lod=4.0) == each(df, max_zoom=13, lod=4.0)


def test_small_blocks_and_early_output_change_nothing(spark):
    df = spark.createDataFrame(near(np.random.default_rng(6), 200, 5000.0), POSITIONS).repartition(3)
    rows = df.withColumn("z", demand.base_zoom(F.col("alt")).cast("long"))
    cx, cy = tm.tile_of_point(F.col("x"), F.col("y"), F.col("z"))
    columns = [np.array(c) for c in zip(*rows.select("x", "y", "alt", "z", cx.cast("long"), cy.cast("long")).collect(), strict=True)]
    want = set(np.concatenate(list(refine._leaves(*columns, 18, 900.0, 2.2))).tolist())
    for size in (1, 7, 64):
        got = set()
        for k in range(0, len(columns[0]), size):
            got |= set(np.concatenate(list(refine._leaves(*[c[k : k + size] for c in columns], 18, 900.0, 2.2))).tolist())
        assert got == want


def test_ground_and_odd_rows(spark):
    rows = [(1, -9e6, 4.5e6, 900.0), (2, None, 4.5e6, 900.0), (3, -9e6, float("nan"), 900.0), (4, -9e6, 4.5e6, None), (1, -9e6, 4.5e6, 900.0), (5, tm.HALF - 1, 1 - tm.HALF, 20.0)]
    df = spark.createDataFrame(rows, POSITIONS).withColumns({"g": F.lit(850.0), "z": F.lit("own"), "_t": F.lit(1)})
    good = df.where("id in (1, 5)").drop("z", "_t")
    assert together(df) == each(good)
    assert together(df, ground="g") == each(good, ground="g") != each(good)
    assert together(df.limit(0)) == set()
    with pytest.raises(ValueError):
        refine.demanded_tiles(df, max_zoom=29)


def test_positions_in_one_place_don_t_multiply_rows(spark):
    """Before the last shuffle a task has each tile once: the rows are bounded by tiles and tasks, not by positions."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(k, -9e6 + float(rng.uniform(0, 30)), 4.5e6 + float(rng.uniform(0, 30)), 500.0 + float(rng.uniform(0, 5))) for k in range(4000)], POSITIONS)
    made = refine.demanded_tiles(df)
    assert made.count() < 5000
    of_each = demand.lod_tiles(df, ["id"]).count()
    steps = refine_steps(df)
    assert steps * 20 < of_each


def refine_steps(df):
    """Keys that the traversal makes for all positions as one block, repeats included."""
    rows = df.withColumn("z", demand.base_zoom(F.col("alt")).cast("long"))
    cx, cy = tm.tile_of_point(F.col("x"), F.col("y"), F.col("z"))
    columns = [np.array(c) for c in zip(*rows.select("x", "y", "alt", "z", cx.cast("long"), cy.cast("long")).collect(), strict=True)]
    return sum(map(len, refine._leaves(*columns, 18, 900.0, 2.2)))


def test_the_job_s_tiles_on_the_given_track(spark, data):
    t = q_demand.track(spark, data)
    want = {tuple(r) for r in demand.lod_tiles(t, ["event_id"]).select("z", "tx", "ty").distinct().collect()}
    assert together(t) == want
