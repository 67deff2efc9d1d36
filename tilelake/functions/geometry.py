"""Rings (arrays of points with x and y) and boxes as column expressions; polygons with holes in numpy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bbox_meets(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two boxes (xmin, ymin, xmax, ymax) meet; touching counts."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def join_boxes(left: DataFrame, right: DataFrame, a: tuple[str, str, str, str], b: tuple[str, str, str, str], cell: float = 1.0) -> DataFrame:
    """Rows of left and right whose boxes (columns xmin, ymin, xmax, ymax of each) meet, touching included. Both are
    spread over the cells of a grid and joined on equal cells; a pair is kept in the cell of the lower left corner that
    its boxes have in common, so it comes once. Null boxes meet none."""
    at = lambda v: F.floor(v / cell)

    def spread(df: DataFrame, box: tuple[str, str, str, str]) -> DataFrame:
        w, s, e, n = (at(F.col(c)) for c in box)
        ok = df.where((F.col(box[0]) <= F.col(box[2])) & (F.col(box[1]) <= F.col(box[3])))
        return ok.withColumn("_cx", F.explode(F.sequence(w, e))).withColumn("_cy", F.explode(F.sequence(s, n)))

    own = [(F.col(x), F.col(y)) for x, y in zip(a, b, strict=True)]
    here = (F.col("_cx") == at(F.greatest(*own[0]))) & (F.col("_cy") == at(F.greatest(*own[1])))
    meets = bbox_meets(tuple(F.col(c) for c in a), tuple(F.col(c) for c in b))
    return spread(left, a).join(spread(right, b), ["_cx", "_cy"]).where(meets & here).drop("_cx", "_cy")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def following(ring: Column, i: Column) -> Column:
    """The point after point i (from 0) of an open ring."""
    return F.element_at(ring, (i + 1) % F.size(ring) + 1)


def edges(ring: Column) -> Column:
    """The edges of a convex ring (x, y, dx, dy), counter-clockwise: what ``edges_meet_box`` needs, made once for each ring."""
    turn = F.when(ring_area(ring) >= 0, 1.0).otherwise(-1.0)
    edge = lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), ((q["x"] - p["x"]) * turn).alias("dx"), ((q["y"] - p["y"]) * turn).alias("dy"))
    return F.transform(ring, lambda p, i: edge(p, following(ring, i)))


def edges_meet_box(edge: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Whether no edge has the whole box on its outer side; the box of the ring must meet it too, touching included."""
    nearest = lambda v: F.greatest(v["dx"] * (s - v["y"]), v["dx"] * (n - v["y"])) - F.least(v["dy"] * (w - v["x"]), v["dy"] * (e - v["x"]))
    return ~F.exists(edge, lambda v: nearest(v) < 0)


def convex_meets_box(ring: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Whether a convex ring meets a box, touching included: no edge of either separates them."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    boxes = (F.array_min(xs) <= e) & (F.array_max(xs) >= w) & (F.array_min(ys) <= n) & (F.array_max(ys) >= s)
    return boxes & edges_meet_box(edges(ring), w, s, e, n)


def ring_area(ring: Column) -> Column:
    """Twice the signed area; positive if counter-clockwise with y growing up."""
    return F.aggregate(F.transform(ring, lambda p, i: p["x"] * following(ring, i)["y"] - following(ring, i)["x"] * p["y"]), F.lit(0.0), lambda a, v: a + v)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """The centroid of a ring's area."""
    cross = lambda p, i: p["x"] * following(ring, i)["y"] - following(ring, i)["x"] * p["y"]
    part = lambda c: F.aggregate(F.transform(ring, lambda p, i: (p[c] + following(ring, i)[c]) * cross(p, i)), F.lit(0.0), lambda a, v: a + v)
    return part("x") / (ring_area(ring) * 3), part("y") / (ring_area(ring) * 3)
