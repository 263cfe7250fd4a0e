"""Polygons made valid: their own edges are noded, faces are built from half-edges, and what the even-odd rule covers stays.

A parcel is looked at alone first: repeated points, spikes, sides that cross or touch, corners visited twice, holes outside their shell. Only
parcels with such flaws (or with more sides than one look allows) go through the overlay, where each is a group of its own: edges meet
on grid cells, are split, and pieces with the polygon on one side only are closed to rings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..sources.shared import shuffled, written
from . import overlay, quadtree, rings

#: Sides over which a polygon goes to the overlay unseen, and pairs of sides that are compared at once.
SIDES, AT_ONCE = 4096, 1 << 20


def turn(ox, oy, ax, ay, bx, by):
    return np.sign((ax - ox) * (by - oy) - (bx - ox) * (ay - oy))


def touching(e: np.ndarray, after: np.ndarray) -> bool:
    """Whether two sides meet other than at the corner between neighbours (``after`` is each side's next)."""
    n = len(e)
    low_x, high_x, low_y, high_y = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2]), np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    step = max(1, AT_ONCE // n)
    for at in range(0, n, step):
        rows = np.arange(at, min(n, at + step))[:, None]
        near = (low_x[rows] <= high_x) & (low_x <= high_x[rows]) & (low_y[rows] <= high_y) & (low_y <= high_y[rows]) & (rows < np.arange(n))
        i, j = np.nonzero(near)
        i += at
        (ax, ay, bx, by), (px, py, qx, qy) = e[i].T, e[j].T
        p, q, u, v = turn(ax, ay, bx, by, px, py), turn(ax, ay, bx, by, qx, qy), turn(px, py, qx, qy, ax, ay), turn(px, py, qx, qy, bx, by)
        meet = (p * q <= 0) & (u * v <= 0)
        beside = (after[i] == j) | (after[j] == i)
        # Neighbours share a corner; they run back over each other if both lie on one line and point against one another.
        back = (p == 0) & (q == 0) & ((bx - ax) * (qx - px) + (by - ay) * (qy - py) < 0)
        if (meet & np.where(beside, back, True)).any():
            return True
    return False


def flawed(parts: list[list[np.ndarray]]) -> bool:
    """Whether the polygons, parts of rings of points (n, 2), are not plainly valid; a hole that touches its shell counts as a flaw, which
    costs a look and changes nothing."""
    edges, after, at = [], [], 0
    for part in parts:
        for xy in part:
            # All corners but the last one must differ: no repeated points, no corner visited twice.
            if len(xy) < 4 or (xy[0] != xy[-1]).any() or len(set(map(tuple, xy[:-1].tolist()))) < len(xy) - 1:
                return True
            edges.append(np.hstack([xy[:-1], xy[1:]]))
            after.append(at + (np.arange(len(xy) - 1) + 1) % (len(xy) - 1))
            at += len(xy) - 1
    if not edges:
        return False
    e = np.concatenate(edges)
    if len(e) > SIDES or touching(e, np.concatenate(after)):
        return True
    if len(edges) == 1:
        return False
    # Nothing meets: rings nest if each shell lies in no shell, and each hole in its own shell and in no other hole.
    at = 0
    for part in parts:
        own = edges[at : at + len(part)]
        for k, ring in enumerate(own):
            inside = [quadtree.even_odd(other, *ring[0, :2]) for other in edges if other is not ring]
            if sum(inside) != (1 if k else 0) or k and not quadtree.even_odd(own[0], *ring[0, :2]):
                return True
        at += len(part)
    return False


def parts_of(mpoly: pa.ListArray) -> list[list[list[np.ndarray]]]:
    """Per row its parts, of rings, of points (n, 2), as views of the flat coordinates; none for null."""
    parts = mpoly.flatten()
    rings_ = parts.flatten()
    points = rings_.flatten()
    xy = np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")], 1) if len(points) else np.zeros((0, 2))

    def dealt(sizes: pa.Array, items: list | np.ndarray) -> list:
        ends = np.cumsum([n or 0 for n in sizes.to_pylist()]).tolist()
        return [items[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    return dealt(mpoly.value_lengths(), dealt(parts.value_lengths(), dealt(rings_.value_lengths(), xy)))


def with_flaws(parcels: DataFrame, name: str = "flawed") -> DataFrame:
    """Adds whether ``mpoly`` may not be valid; null and empty geometries are."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [bool(m) and flawed(m) for m in parts_of(b.column("mpoly"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.bool_())], [*b.schema.names, name])

    return parcels.mapInArrow(look, StructType([*parcels.schema.fields, StructField(name, BooleanType())]))


def make_valid(parcels: DataFrame, keys: list[str]) -> DataFrame:
    """``parcels`` with a valid ``mpoly`` and ``repaired``; ``keys`` name a parcel. What the even-odd rule over all rings covers stays: bow ties
    become two parts, spikes and repeated points go, a hole outside its shell is a part, where parts overlap is a hole. Where
    nothing is covered mpoly is empty. A parcel without flaws stays point by point."""
    # Looking is the work, whatever the bytes: a table of few files is dealt to many tasks first.
    context = parcels.sparkSession.sparkContext
    told = written(with_flaws(parcels.repartition(8 * context.defaultParallelism, *keys)))
    rough = told.where("flawed").select(*keys, F.array(F.flatten("mpoly")).alias("mpoly"))
    if not rough.limit(1).count():
        return told.withColumnRenamed("flawed", "repaired")
    border = written(overlay.border(rough, keys))
    made = rings.polygons(rings.nested(rings.rings_of(border, keys), keys), keys).withColumnRenamed("mpoly", "_made")
    none = F.array().cast(parcels.schema["mpoly"].dataType)
    out = told.join(shuffled(made), keys, "left").withColumn("mpoly", F.when(F.col("flawed"), F.coalesce("_made", none)).otherwise(F.col("mpoly")))
    return out.withColumnRenamed("flawed", "repaired").drop("_made")
