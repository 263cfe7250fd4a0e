"""Union of polygons that overlap, meet in T-junctions or cross themselves, by an overlay of their edges.

Edges meet on grid cells by an equi-join and are split where they cross, touch or run along each other. A piece belongs to the
border of the union if exactly one of the two points beside its middle is covered, by the even-odd rule of any polygon of the group.
Pieces find the polygons around them by the cells of a quadtree."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geo
from ..sources.shared import shuffled, written
from . import quadtree

#: Places after the point to which coordinates are kept, and the distance of the points beside a piece.
SNAP, BESIDE = 9, 1e-8


def edges(parcels: DataFrame, keys: list[str], snap: int = SNAP) -> DataFrame:
    """(keys, ax, ay, bx, by), the lesser end first: the different edges of all rings, none of length 0."""
    rings = parcels.where(F.col("mpoly").isNotNull()).select(*keys, F.explode(F.flatten("mpoly")).alias("ring"))
    r = rings.select(*keys, F.transform("ring", lambda p: geo.point(F.round(p["x"], snap), F.round(p["y"], snap))).alias("r"))
    e = r.select(*keys, F.explode(F.arrays_zip(F.slice("r", F.lit(1), F.size("r") - 1).alias("a"), F.slice("r", F.lit(2), F.size("r") - 1).alias("b"))).alias("e"))
    e = e.select(*keys, F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).where("a <> b").distinct()
    return e.select(*keys, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def undirected(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The segments with their lesser end first."""
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    ends = segments.select(*keys, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return ends.select(*keys, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def cell_sizes(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cell): twice the geometric mean of a group's mean and median extent, so that a few very long segments neither fill every cell
    nor lie in many of them."""
    extent = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    return segments.groupBy(*keys).agg((2 * F.sqrt(F.avg(extent) * F.percentile_approx(extent, 0.5))).alias("cell"))


def dealt(segments: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each grid cell (cx, cy) of side ``cell`` that a segment passes, so as many as it is long: not those of its whole box."""
    sized = segments.join(shuffled(cell_sizes(segments, keys)), keys)
    cell, slack = F.col("cell"), F.col("cell") * 1e-6
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = sized.withColumn("cx", F.explode(F.sequence(F.floor((low - slack) / cell), F.floor((high + slack) / cell))))
    # In a column of cells the segment has a stretch; an upright one has all of its height in each.
    slope = (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    at = lambda x: F.col("ay") + (F.least(high, F.greatest(low, x)) - F.col("ax")) * slope
    one, two = F.coalesce(at(F.col("cx") * cell), F.col("ay")), F.coalesce(at((F.col("cx") + 1) * cell), F.col("by"))
    bounded = lambda y: F.least(F.greatest("ay", "by"), F.greatest(F.least("ay", "by"), y))
    return columns.withColumn("cy", F.explode(F.sequence(F.floor((bounded(F.least(one, two)) - slack) / cell), F.floor((bounded(F.greatest(one, two)) + slack) / cell))))


def pairs(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair of segments (ends ax..by and cx_..dy_) of a group whose boxes touch, once, the lesser first."""
    on = dealt(segments, keys)
    names = {"ax": "px", "ay": "py", "bx": "qx", "by": "qy"}
    other = on.select(*keys, "cx", "cy", *[F.col(k).alias(v) for k, v in names.items()])
    both = on.join(shuffled(other), [*keys, "cx", "cy"]).where(F.struct("ax", "ay", "bx", "by") < F.struct("px", "py", "qx", "qy"))
    near = lambda a, b, c, d: (F.least(a, b) <= F.greatest(c, d)) & (F.least(c, d) <= F.greatest(a, b))
    both = both.where(near("ax", "bx", "px", "qx") & near("ay", "by", "py", "qy"))
    return both.select(*keys, "ax", "ay", "bx", "by", "px", "py", "qx", "qy").distinct()


def side(prefix: str, other: tuple[str, str]) -> Column:
    """Twice the area of the triangle of a segment (a to b, or p to q) and a point: its sign tells the side."""
    (ax, ay), (bx, by) = (("ax", "ay"), ("bx", "by")) if prefix == "a" else (("px", "py"), ("qx", "qy"))
    return (F.col(bx) - F.col(ax)) * (F.col(other[1]) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(other[0]) - F.col(ax))


def meeting(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys) of the groups in which two segments cross, one ends inside another, or two run along each other."""
    s = pairs(segments, keys).select("*", side("a", ("px", "py")).alias("p"), side("a", ("qx", "qy")).alias("q"), side("p", ("ax", "ay")).alias("u"), side("p", ("bx", "by")).alias("v"))
    shared = reduce(Column.__or__, [(F.col(f"{i}x") == F.col(f"{j}x")) & (F.col(f"{i}y") == F.col(f"{j}y")) for i in "ab" for j in "pq"])
    flat = (F.col("p") == 0) & (F.col("q") == 0)
    along = F.struct("px", "py") < F.struct("bx", "by")
    meets = F.when(flat, along).otherwise((F.col("p") * F.col("q") <= 0) & (F.col("u") * F.col("v") <= 0) & ~shared)
    return s.where(meets).select(*keys).distinct()


def meeting_points(c: dict[str, np.ndarray], snap: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs' rows, x, y) where the segments a-b and p-q of each pair meet: one point where they cross or touch, all four ends where they run
    along each other. A meeting point at an end is that end, so that both segments get the same point."""
    ax, ay, bx, by, px, py, qx, qy = (c[k] for k in ("ax", "ay", "bx", "by", "px", "py", "qx", "qy"))
    rx, ry, sx, sy = bx - ax, by - ay, qx - px, qy - py
    cross, ox, oy = rx * sy - ry * sx, px - ax, py - ay
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (ox * sy - oy * sx) / cross, (ox * ry - oy * rx) / cross
    # Ends beside the other segment's line, by twice the area of the triangles they make with it.
    thin = np.abs(rx * (py - ay) - ry * (px - ax)) + np.abs(rx * (qy - ay) - ry * (qx - ax)) <= 1e-9 * np.maximum(rx * rx + ry * ry, sx * sx + sy * sy)
    slack = 1e-9
    one = ~thin & (cross != 0) & (t >= -slack) & (t <= 1 + slack) & (u >= -slack) & (u <= 1 + slack)
    rows = np.flatnonzero(one)
    x, y = np.round(ax[rows] + t[rows] * rx[rows], snap), np.round(ay[rows] + t[rows] * ry[rows], snap)
    near, settled = 2 * 10.0**-snap, np.zeros(len(rows), bool)
    for ex, ey in ((ax, ay), (bx, by), (px, py), (qx, qy)):
        is_end = ~settled & (np.abs(x - ex[rows]) <= near) & (np.abs(y - ey[rows]) <= near)
        x, y = np.where(is_end, ex[rows], x), np.where(is_end, ey[rows], y)
        settled |= is_end
    flat = np.flatnonzero(thin)
    return [(rows, x, y), *((flat, ex[flat], ey[flat]) for ex, ey in ((ax, ay), (bx, by), (px, py), (qx, qy)))]


def split(segments: DataFrame, keys: list[str], snap: int = SNAP) -> DataFrame:
    """The segments cut at every point where another one of the group meets them; different pieces only. Pairs are cut in bulk, by arrays."""
    ends = ["ax", "ay", "bx", "by"]
    given = pairs(segments, keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in (*ends, "px", "py", "qx", "qy")}
            for rows, x, y in meeting_points(c, snap):
                for own in (ends, ["px", "py", "qx", "qy"]):
                    if len(rows):
                        took = pa.array(rows)
                        yield pa.RecordBatch.from_arrays([*(b.column(k).take(took) for k in (*keys, *own)), pa.array(x), pa.array(y)], [*keys, *ends, "x", "y"])

    own = [segments.select(*keys, *ends, F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("ax", "ay"), ("bx", "by"))]
    met = given.mapInArrow(cut, StructType([*(given.schema[k] for k in keys), *StructType.fromDDL(", ".join(f"{k} double" for k in (*ends, "x", "y")))]))
    rx, ry = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    at = ((F.col("x") - F.col("ax")) * rx + (F.col("y") - F.col("ay")) * ry) / (rx * rx + ry * ry)
    placed = own[0].unionByName(own[1]).unionByName(met).withColumn("_t", at).where(F.col("_t").between(0, 1))
    cuts = placed.groupBy(*keys, *ends).agg(F.array_sort(F.collect_set(F.struct("_t", "x", "y"))).alias("c"))
    steps = cuts.select(*keys, F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("e"))
    pieces = steps.select(*keys, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by")).where("ax <> bx or ay <> by")
    return undirected(pieces, keys).distinct()


def border(parcels: DataFrame, keys: list[str], snap: int = SNAP) -> DataFrame:
    """(keys, ax, ay, bx, by): the pieces of edges that bound the union of each group's polygons, with the union on their left. A polygon
    covers by the even-odd rule over all its rings, so holes are not covered."""
    pieces = written(split(written(edges(parcels, keys, snap)), keys, snap).withColumn("piece", F.struct("ax", "ay", "bx", "by")))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = F.sqrt(dx * dx + dy * dy)
    beside = [F.struct(F.lit(s).alias("side"), ((F.col("ax") + F.col("bx")) / 2 - s * dy / size * BESIDE).alias("x"), ((F.col("ay") + F.col("by")) / 2 + s * dx / size * BESIDE).alias("y")) for s in (1, -1)]
    points = pieces.select(*keys, "piece", F.explode(F.array(*beside)).alias("at")).select(*keys, "piece", "at.*")
    polys = parcels.where(F.col("mpoly").isNotNull()).select(*keys, F.explode("mpoly").alias("rings")).where(F.size("rings") > 0)
    hit = quadtree.held_by(points, written(quadtree.covers(polys, keys)), "x", "y", keys)
    sides = hit.groupBy(*keys, "piece").agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low = high")
    ends = [F.when(F.col("low") == 1, F.col(f"piece.{a}")).otherwise(F.col(f"piece.{b}")).alias(a) for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))]
    return sides.select(*keys, *ends)
