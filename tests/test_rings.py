"""Borders by list ranking, quadtree covers, make-valid and row numbers against hand-made results and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.functions import geo
from plotwise.operators import overlay, quadtree, rings, space, valid
from plotwise.sources.shared import numbered, written


def squares(spark, boxes):
    poly = lambda x, y, w: [[[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))]]]
    return spark.createDataFrame([("k", poly(*b)) for b in boxes], "k string, mpoly array<array<array<struct<x: double, y: double>>>>")

def test_rings_across_tiles_equal_those_of_one_task(spark):
    """A comb of many corners with holes: linked in tiles of a few segments, chains are put in order by list ranking."""
    boxes = [(i, j, 1) for i in range(14) for j in range(9) if not (i % 4 == 2 and 0 < j < 7 and j % 3 != 0)]
    df = squares(spark, boxes)
    one, many = (space.dissolve(df, ["k"], tile).first() for tile in (rings.TILE, 40))
    assert one.exact and many.exact and one.mpoly == many.mpoly and len(one.mpoly[0]) > 4
    spokes = [(0.0, 0.0)] + [(math.cos(a / 50) * (3 + a % 2), math.sin(a / 50) * (3 + a % 2)) for a in range(157)]
    ring = [*spokes, spokes[0]]
    segments = spark.createDataFrame([("a", *p, *q) for p, q in zip(ring, ring[1:])] + [("b", *p, *q) for p, q in zip(ring, ring[1:])] + [("b", 9.0, 9.0, 9.5, 9.0)], "k string, ax double, ay double, bx double, by double")
    for tile in (20, 1000):
        got = rings.rings_of(segments, ["k"], tile).collect()
        assert sorted(r.k for r in got) == ["a", "b"]
        start = ring.index(min(ring[:-1]))
        assert all([tuple(p) for p in r.ring] == [*ring[start:-1], *ring[: start + 1]] and r.area > 0 for r in got)
    corners = rings.points_of(rings.rings_of(segments, ["k"]), ["k"])
    assert corners.where("k = 'a'").count() == len(ring) and corners.where("place = 0").count() == 2


def test_rings_part_where_they_touch(spark):
    assert sorted(map(len, rings.parted([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 1)]))) == [3, 3]
    assert list(rings.parted([(0, 0), (1, 0), (1, 1)])) == [[(0, 0), (1, 0), (1, 1)]]
    # A hole that touches the shell at a corner is a hole.
    boxes = [(i, j, 1) for i in range(3) for j in range(3) if (i, j) not in ((1, 1), (2, 2))]
    got = space.dissolve(squares(spark, boxes), ["k"]).withColumn("area", geo.area(F.col("mpoly"))).first()
    assert got.area == 7 and [len(p) for p in got.mpoly] == [2]


def test_one_huge_polygon_among_small_ones(spark):
    """Its edges lie in as many cells as they are long, its cover has few cells, and the union is right."""
    boxes = [(i % 30 * 2, i // 30 * 2, 1) for i in range(600)] + [(30.5, 20.5, 4000)]
    df = squares(spark, boxes)
    sides = overlay.edges(df, ["k"])
    assert overlay.dealt(sides, ["k"]).count() < 12 * sides.count()
    assert quadtree.covers(df.select("k", F.flatten("mpoly").alias("rings")), ["k"]).count() < 4 * len(boxes)
    got = space.dissolve(df, ["k"]).withColumn("area", geo.area(F.col("mpoly"))).first()
    inside = sum(max(0, min(x + 1, 4030.5) - max(x, 30.5)) * max(0, min(y + 1, 4020.5) - max(y, 20.5)) for x, y, _ in boxes[:-1])
    assert got.area == pytest.approx(4000**2 + 600 - inside)


def test_quadtree_against_ray_cast(spark):
    draw = random.Random(4)
    shapes = []
    for i in range(40):
        x, y, r, n = draw.uniform(-50, 50), draw.uniform(-50, 50), draw.choice((0.5, 3, 30)), draw.choice((3, 12, 400))
        around = [(x + r * draw.uniform(0.3, 1) * math.cos(2 * math.pi * a / n), y + r * draw.uniform(0.3, 1) * math.sin(2 * math.pi * a / n)) for a in range(n)]
        shapes.append((i, [[{"x": p, "y": q} for p, q in [*around, around[0]]]]))
    cells = written(quadtree.covers(spark.createDataFrame(shapes, "i int, rings array<array<struct<x: double, y: double>>>"), ["i"]))
    at = [(k, draw.uniform(-60, 60), draw.uniform(-60, 60)) for k in range(1500)]
    got = {(r.k, r.i) for r in quadtree.held_by(spark.createDataFrame(at, "k int, x double, y double"), cells, "x", "y").collect()}
    edges = {i: np.array([[a["x"], a["y"], b["x"], b["y"]] for a, b in zip(s[0], s[0][1:])]) for i, s in shapes}
    assert got == {(k, i) for k, x, y in at for i, e in edges.items() if quadtree.even_odd(e, x, y)} and len(got) > 500


RING = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]


@pytest.mark.parametrize("parts,area,shells,holes,repaired", [
    ([[RING((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))]], 8, 2, 0, True),
    ([[RING((0, 0), (4, 0), (4, 0), (4, 4), (0, 4), (0, 0))]], 16, 1, 0, True),
    ([[RING((0, 0), (4, 0), (9, 0), (4, 0), (4, 4), (0, 4), (0, 0))]], 16, 1, 0, True),
    ([[RING((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), RING((6, 0), (6, 1), (7, 1), (7, 0), (6, 0))]], 17, 2, 0, True),
    ([[RING((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))], [RING((2, 2), (6, 2), (6, 6), (2, 6), (2, 2))]], 24, 2, 0, True),
    ([[RING((0, 0), (9, 0), (9, 9), (0, 9), (0, 0))], [RING((2, 2), (6, 2), (6, 6), (2, 6), (2, 2))]], 65, 1, 1, True),
    ([[RING((0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2), (0, 0))]], 8, 2, 0, True),
    ([[RING((0, 0), (0, 4), (4, 4), (4, 0), (0, 0)), RING((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))]], 15, 1, 1, False),
    ([[RING((0, 0), (4, 0), (0, 0), (4, 0), (0, 0))]], 0, 0, 0, True),
    ([], 0, 0, 0, False),
])
def test_make_valid(spark, parts, area, shells, holes, repaired):
    kind = "array<array<array<struct<x: double, y: double>>>>"
    df = spark.createDataFrame([(1, "x", parts), (2, "y", None)], f"id int, name string, mpoly {kind}")
    got = {r.id: r for r in valid.make_valid(df, ["id"]).withColumn("area", geo.area(F.col("mpoly"))).collect()}
    assert got[2].mpoly is None and got[2].name == "y" and not got[2].repaired
    one = got[1]
    assert one.area == pytest.approx(area) and len(one.mpoly) == shells and sum(len(p) - 1 for p in one.mpoly) == holes and one.repaired == repaired
    if not repaired:
        assert [[[tuple(p) for p in r] for r in p] for p in one.mpoly] == [[[(p["x"], p["y"]) for p in r] for r in p] for p in parts]


def test_row_numbers_without_one_task(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("a"), F.col("id").alias("b")).repartition(7)
    got = numbered(df, [F.col("a").desc(), "b"], "n", 5)
    rows = sorted(df.collect(), key=lambda r: (-r.a, r.b))
    assert [(r.a, r.b, r.n) for r in got.orderBy("n").collect()] == [(r.a, r.b, i + 5) for i, r in enumerate(rows)]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert numbered(df.limit(0), ["a"], "n").count() == 0
