"""The kernel for all rings of a batch against rings one by one."""

import in_batch
import numpy as np
import plain_geometry as plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilelake.functions import ragged
from tilelake.operators import buildings


def features(rng, n=200):
    """Features of no, one or several rings, some of few points or none, on a coarse grid so that edges touch."""
    return [[rng.integers(-6, 7, (rng.choice([0, 1, 2, 3, 4, 5, 9]), 2)) / 2 for _ in range(rng.choice([0, 1, 1, 2, 4]))] for _ in range(n)]


def boxes(rng, n):
    w, s = rng.integers(-4, 3, n) / 2.0, rng.integers(-4, 3, n) / 2.0
    return w, s, w + rng.integers(1, 5, n) / 2.0, s + rng.integers(1, 5, n) / 2.0


def arrow(many):
    return pa.array([[[{"x": float(x), "y": float(y)} for x, y in r] for r in f] for f in many], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


@pytest.mark.parametrize("seed", range(5))
def test_batches_equal_single_rings(seed):
    rng = np.random.default_rng(seed)
    many = features(rng)
    box = boxes(rng, len(many))
    for a in (arrow(many), arrow([many[0], *many])[1:]):  # a slice too
        (of, points), x, y = ragged.read(a)
        assert [[r.tolist() for r in f] for f in many] == [[r.tolist() for r in in_batch.cut(points, x, y)[i:j]] for i, j in zip(of, of[1:])]
        got = in_batch.cut(*ragged.clip(points, x, y, *[v[ragged.owner(of)] for v in box]))
        want = [plain.clip(r, *(v[k] for v in box)) for k, f in enumerate(many) for r in f]
        assert [r.tolist() for r in got] == [r.tolist() for r in want]
        meets = ragged.polygons_meet_boxes(of, points, x, y, *box)
        assert meets.tolist() == [plain.polygon_meets_box([r for r in f if len(r)], *(v[k] for v in box)) for k, f in enumerate(many)]
        levels, px, py = ragged.polygons(of, points, x, y)
        back = ragged.nested(levels, px, py).to_pylist()
        assert back == [[[[{"x": float(p), "y": float(q)} for p, q in r] for r in poly] for poly in plain.polygons(f)] for f in many]
    empty = ragged.read(arrow([]))
    assert ragged.polygons_meet_boxes(*empty[0], *empty[1:], *boxes(rng, 0)).tolist() == []


def test_columns_of_spark(spark):
    """Roofs and units as the operators give them, with a hole that vanishes and a polygon that does."""
    rng = np.random.default_rng(9)
    many = features(rng, 60)
    box = boxes(rng, 60)
    df = spark.createDataFrame([(k, [[(float(x), float(y)) for x, y in r] for r in f], *[float(v[k]) for v in box]) for k, f in enumerate(many)], "id long, rings array<array<struct<x:double,y:double>>>, w double, s double, e double, n double")
    got = {r.id: r for r in df.select("id", buildings.classified("rings").alias("p")).join(df, "id").select("id", "p", buildings.clipped("p", "w", "s", "e", "n").alias("c"), buildings.quantized("rings", "w", "s", "e", "n").alias("q")).collect()}
    pairs = lambda r: [(p.x, p.y) for p in r]
    for k, f in enumerate(many):
        polys = plain.polygons(f)
        assert [[pairs(r) for r in p] for p in got[k].p] == [[list(map(tuple, r.tolist())) for r in p] for p in polys]
        w, s, e, n = (v[k] for v in box)
        want = []
        for p in polys:
            cut = [plain.clip(r, w, s, e, n) for r in p]
            if len(cut[0]):
                want.append([list(map(tuple, r.tolist())) for r in cut if len(r)])
        assert [[pairs(r) for r in p] for p in got[k].c] == want
        units = []
        for r in f:
            pad = 64 / 4096
            c = plain.clip(r, w - (e - w) * pad, s - (n - s) * pad, e + (e - w) * pad, n + (n - s) * pad)
            if len(c):
                u = np.rint(np.stack([(c[:, 0] - w) / (e - w), (n - c[:, 1]) / (n - s)], axis=1) * 4096).astype(int)
                u = u[np.any(u != np.roll(u, 1, axis=0), axis=1)]
                if len(u) >= 3:
                    units.append(list(map(tuple, u.tolist())))
        assert [pairs(r) for r in got[k].q] == units
    assert df.limit(0).select(buildings.classified("rings")).count() == 0
    assert df.where(buildings.polygon_meets_box("rings", F.col("w"), F.col("s"), F.col("e"), F.col("n"))).count() > 0
