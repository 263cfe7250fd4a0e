"""Closed rings out of loose border segments, in many tasks.

Segments are directed: what they bound lies on their left. At each corner a segment's successor is the segment that bounds the same
wedge, the next one clockwise from the way back; a window over the corner finds it. Segments that lie together (a tile of their group's box)
are then linked into chains in one task each, and most rings close there. Chains that leave their tile are put in order by list ranking:
each chain points to its successor, every round doubles how far it points and takes over the least chain seen on the way with its distance, so a ring
of n chains knows its first chain and each chain's place after log2 n joins. No task sees a whole group (a village), nor the rings of one.

A ring that visits a corner twice is parted there, so rings are simple: polygons that touch at a corner are two, a hole that touches
its shell is a hole. Shells run counter-clockwise, holes clockwise. A segment without a successor, as rounding may leave one, ends its chain, and the
chain goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import shuffled, small, written
from . import quadtree

#: Segments that one task links at once.
TILE = 20_000
POLYGONS = "array<array<array<struct<x: double, y: double>>>>"


def successors(segments: DataFrame, keys: list[str]) -> DataFrame:
    """``segments`` (keys, ax, ay, bx, by) that have a successor, with its end (nx, ny)."""
    out = segments.select(*keys, F.col("ax").alias("vx"), F.col("ay").alias("vy"), F.col("bx").alias("ox"), F.col("by").alias("oy"), F.lit(True).alias("leaves"))
    into = segments.select(*keys, F.col("bx").alias("vx"), F.col("by").alias("vy"), F.col("ax").alias("ox"), F.col("ay").alias("oy"), F.lit(False).alias("leaves"))
    around = Window.partitionBy(*keys, "vx", "vy").orderBy(F.atan2(F.col("oy") - F.col("vy"), F.col("ox") - F.col("vx")).desc(), "leaves")
    end = F.struct("ox", "oy", "leaves")
    following = F.coalesce(F.lead(end).over(around), F.first(end).over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    found = out.unionByName(into).withColumn("_n", following).where(~F.col("leaves") & F.col("_n.leaves"))
    return found.select(*keys, F.col("ox").alias("ax"), F.col("oy").alias("ay"), F.col("vx").alias("bx"), F.col("vy").alias("by"), F.col("_n.ox").alias("nx"), F.col("_n.oy").alias("ny"))


def tiled(segments: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """``segments`` with ``bucket``, of about ``tile`` segments, in which they are linked. A group of at most ``tile`` segments goes whole into one; a
    larger one is cut by a grid over its box, and tiles that are still too full are parted by hash."""
    sizes = segments.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"))
    about = sizes.agg(F.count("*").alias("groups"), F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
    buckets = F.lit(max(1, -(-(about["all"] or 0) // tile)))
    if (about.most or 0) <= tile:
        return segments.withColumn("bucket", F.pmod(F.xxhash64(*keys), buckets))
    side = F.ceil(F.sqrt(F.col("_n") / tile * 4))
    cell = lambda c, low, high: F.when(F.col("_n") <= tile, 0).otherwise(F.floor((F.col(c) - F.col(low)) / (F.col(high) - F.col(low) + 1e-12) * side)).cast("int")
    placed = segments.join(small(sizes, about.groups, 128), keys).withColumns({"tx": cell("ax", "x0", "x1"), "ty": cell("ay", "y0", "y1")}).drop("_n", "x0", "x1", "y0", "y1")
    counts = written(placed.groupBy(*keys, "tx", "ty").agg(F.count("*").alias("_n")).where(F.col("_n") > tile))
    full = small(counts, counts.count(), 128)
    salt = F.coalesce(F.pmod(F.xxhash64("ax", "ay"), F.ceil(F.col("_n") / tile)), F.lit(0))
    return placed.join(full, [*keys, "tx", "ty"], "left").withColumn("bucket", F.pmod(F.xxhash64(*keys, "tx", "ty", salt), buckets)).drop("_n", "tx", "ty")


def linked(group: list[int], ends: dict[str, np.ndarray]) -> list[tuple[bool, list[int]]]:
    """Chains of segments by row number, each with whether it is closed. A segment follows on one of its own group."""
    ax, ay, bx, by, nx, ny = (ends[k].tolist() for k in ("ax", "ay", "bx", "by", "nx", "ny"))
    place = {s: i for i, s in enumerate(zip(group, ax, ay, bx, by, strict=True))}
    after = [place.get(s, -1) for s in zip(group, bx, by, nx, ny, strict=True)]
    before = [False] * len(after)
    for j in after:
        if j >= 0:
            before[j] = True
    seen, out = [False] * len(after), []
    for closed, starts in ((False, [i for i, b in enumerate(before) if not b]), (True, range(len(after)))):
        for i in starts:
            chain = []
            while i >= 0 and not seen[i]:
                seen[i] = True
                chain.append(i)
                i = after[i]
            if chain:
                out.append((closed, chain))
    return out


def chains(segments: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """(keys, head, next, closed, xs, ys): chains within tiles. ``head`` is the first segment, ``next`` the segment that follows the last."""
    columns = [*keys, "head", "next", "closed", "xs", "ys"]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        c = {k: pdf[k].to_numpy() for k in ("ax", "ay", "bx", "by", "nx", "ny")}
        own = [pdf[k].tolist() for k in keys]
        rows = []
        for closed, chain in linked(pdf.groupby(keys, sort=False, dropna=False).ngroup().tolist(), c):
            i, j = chain[0], chain[-1]
            first, last = [float(c[k][i]) for k in ("ax", "ay", "bx", "by")], [float(c[k][j]) for k in ("bx", "by", "nx", "ny")]
            rows.append([*(k[i] for k in own), first, last, closed, c["ax"][chain], c["ay"][chain]])
        return pd.DataFrame(rows, columns=columns)

    types = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in keys)
    followed = tiled(written(successors(segments, keys)), keys, tile)
    return followed.groupBy("bucket").applyInPandas(link, f"{types}, head array<double>, next array<double>, closed boolean, xs array<double>, ys array<double>")


def ranked(open_: DataFrame, keys: list[str]) -> DataFrame:
    """The open chains with ``ring`` (the least head of their ring) and ``ahead``, how many chains on that one is. Chains that don't come round go."""
    state = written(open_.select(*keys, "head", F.col("next").alias("to"), F.col("head").alias("ring"), F.lit(0).cast("long").alias("ahead")))
    step = 1
    while True:
        far = state.select(*keys, F.col("head").alias("to"), F.col("to").alias("_to"), F.col("ring").alias("_ring"), F.col("ahead").alias("_ahead"))
        less = F.col("_ring") < F.col("ring")
        both = state.join(shuffled(far), [*keys, "to"], "left")
        moved = both.select(*keys, "head", F.col("_to").alias("to"), F.when(less, F.col("_ring")).otherwise(F.col("ring")).alias("ring"), F.when(less, F.col("_ahead") + step).otherwise(F.col("ahead")).alias("ahead"), F.coalesce(less, F.lit(False)).alias("changed"))
        state = written(moved)
        if not state.where("changed").limit(1).count():
            break
        step *= 2
    return open_.join(shuffled(state.select(*keys, "head", "ring", "ahead")), [*keys, "head"])


def joined(open_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xs, ys): the rings of chains that cross tiles, each in its order, if its last chain leads to its first."""
    size = Window.partitionBy(*keys, "ring")
    placed = ranked(open_, keys).withColumn("_k", F.count("*").over(size))
    placed = placed.withColumn("place", (F.col("_k") - F.col("ahead")) % F.col("_k"))
    part = F.sort_array(F.collect_list(F.struct("place", "head", "next", "xs", "ys")))
    rings = placed.groupBy(*keys, "ring").agg(part.alias("p"))
    follows = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.get("p", i)["next"] == F.get("p", (i + 1) % F.size("p"))["head"])
    whole = rings.where(follows)
    return whole.select(*keys, F.flatten(F.transform("p", lambda x: x["xs"])).alias("xs"), F.flatten(F.transform("p", lambda x: x["ys"])).alias("ys"))


def parted(xy: list[tuple[float, float]]) -> Iterator[list[tuple[float, float]]]:
    """The simple rings of a ring (without its last point again) that visits corners more than once."""
    at: dict[tuple[float, float], int] = {}
    way: list[tuple[float, float]] = []
    for p in xy:
        if p in at:
            yield way[at[p] :]
            for q in way[at[p] :]:
                del at[q]
            del way[len(at) :]
        at[p] = len(way)
        way.append(p)
    if way:
        yield way


def simple(rings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xs, ys, area, mx, my): simple closed rings that begin at their least corner, the signed area, and the middle of the first side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, rows = [], []
            for i, (xs, ys) in enumerate(zip(b.column("xs"), b.column("ys"), strict=True)):
                x, y = xs.values.to_numpy(zero_copy_only=False), ys.values.to_numpy(zero_copy_only=False)
                whole = list(zip(x.tolist(), y.tolist(), strict=True))
                for one in parted(whole) if len(set(whole)) < len(whole) else (whole,):
                    if len(one) < 3:
                        continue
                    k = one.index(min(one))
                    p = np.array([*one[k:], *one[: k + 1]])
                    # Relative to the first corner, as far coordinates cost digits.
                    q = p - p[0]
                    area = float((q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]).sum() / 2)
                    if area:
                        owner.append(i)
                        rows.append((p[:, 0], p[:, 1], area, *((p[0] + p[1]) / 2).tolist()))
            if rows:
                xs, ys, area, mx, my = zip(*rows, strict=True)
                doubles = pa.list_(pa.float64())
                took = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(took) for c in keys), pa.array(xs, doubles), pa.array(ys, doubles), pa.array(area), pa.array(mx), pa.array(my)], [*keys, "xs", "ys", "area", "mx", "my"])

    given = rings.select(*keys, "xs", "ys")
    return given.mapInArrow(run, StructType([*(given.schema[c] for c in keys), *StructType.fromDDL("xs array<double>, ys array<double>, area double, mx double, my double")]))


def rings_of(segments: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """(keys, ring_id, ring, area, mx, my): the simple rings that directed ``segments`` (keys, ax, ay, bx, by) form; a table."""
    made = written(chains(segments, keys, tile))
    closed = made.where("closed").select(*keys, "xs", "ys")
    open_ = made.where("not closed")
    if open_.limit(1).count():
        closed = closed.unionByName(joined(open_, keys))
    ring = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct(p["xs"].alias("x"), p["ys"].alias("y")))
    return written(simple(closed, keys).select(*keys, F.monotonically_increasing_id().alias("ring_id"), ring.alias("ring"), "area", "mx", "my"))


def points_of(rings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring_id, place, x, y): the corners of ``rings_of`` as rows."""
    return rings.select(*keys, "ring_id", F.posexplode("ring").alias("place", "p")).select(*keys, "ring_id", "place", "p.x", "p.y")


def nested(rings: DataFrame, keys: list[str]) -> DataFrame:
    """``rings_of`` with ``within`` (shells less holes around each ring, itself left out) and ``parent`` (the id of the smallest shell around it)."""
    cells = written(quadtree.covers(rings.select(*keys, F.col("ring_id").alias("_id"), F.col("area").alias("_area"), F.array("ring").alias("rings")), [*keys, "_id", "_area"]))
    around = quadtree.held_by(rings.select(*keys, "ring_id", "mx", "my"), cells, "mx", "my", keys).where(F.col("ring_id") != F.col("_id"))
    shell = F.when(F.col("_area") > 0, F.struct("_area", "_id"))
    known = around.groupBy("ring_id").agg(F.sum(F.signum("_area")).cast("long").alias("within"), F.min(shell)["_id"].alias("parent"))
    return rings.join(shuffled(known), "ring_id", "left").withColumn("within", F.coalesce("within", F.lit(0)))


def polygons(nested_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mpoly): shells with their holes, the largest first. A hole without a shell around it is left out."""
    shells = nested_.where("area > 0").select(*keys, "ring_id", "ring", "area")
    holes = nested_.where("area < 0 and parent is not null").groupBy(*keys, F.col("parent").alias("ring_id")).agg(F.sort_array(F.collect_list(F.struct("area", "ring"))).alias("holes"))
    poly = F.concat(F.array("ring"), F.coalesce(F.transform("holes", lambda h: h["ring"]), F.array().cast("array<array<struct<x: double, y: double>>>")))
    parts = shells.join(shuffled(holes), [*keys, "ring_id"], "left").select(*keys, F.struct((-F.col("area")).alias("a"), poly.alias("poly")).alias("part"))
    return parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["poly"]).alias("mpoly"))
