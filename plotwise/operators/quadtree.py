"""Polygons as cells of a quadtree, so that points find the polygons that hold them by an equi-join on cells of mixed size.

A cell of level l is a square of side 2**l, its corners on multiples of it; there is no outermost square. A polygon begins with the
at most four cells of the least level that is as high as its box. A cell with more than ``EDGES`` edges is split into its quarters, so
large parts inside stay single cells and detail is looked for along the border only. Each cell keeps the edges that touch it and whether one
point of it, its anchor, is inside: another point of the cell is inside if the way to the anchor, along x and then along y, crosses its
edges an even number of times, else the opposite. So a test reads the edges nearby and never the whole polygon, and a cell without edges
needs none. A polygon makes at most ``CELLS`` cells and a few, whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import shuffled

#: Edges over which a cell is split, cells over which none is split any more, levels that a polygon's cells span at most.
EDGES, CELLS, DEPTH = 16, 512, 16
#: Where a cell's anchor lies, as shares of its side: off the middle, which borders like to pass through.
ANCHOR = (0.4871, 0.5093)
#: Rows among which a coarse level's cells are dealt out, if they are few: all points near a very large polygon ask for the same cell.
SALTS = 16
CELL = "level int, cx bigint, cy bigint, px double, py double, inside boolean, edges array<struct<ax: double, ay: double, bx: double, by: double>>"


def even_odd(edges: np.ndarray, x: float, y: float) -> bool:
    ax, ay, bx, by = edges.T
    over = (ay > y) != (by > y)
    ax, ay, bx, by = ax[over], ay[over], bx[over], by[over]
    return bool(np.count_nonzero(x < (bx - ax) * (y - ay) / (by - ay) + ax) % 2)


def cells_of(edges: np.ndarray) -> Iterator[tuple[int, int, int, float, float, bool, np.ndarray]]:
    """(level, cx, cy, anchor x and y, whether it is inside, edges nearby) of a polygon's cells; those wholly outside are left out."""
    if not len(edges):
        return
    low_x, high_x = edges[:, 0::2].min(1), edges[:, 0::2].max(1)
    low_y, high_y = edges[:, 1::2].min(1), edges[:, 1::2].max(1)
    extent = max(high_x.max() - low_x.min(), high_y.max() - low_y.min(), 1e-12)
    top = math.ceil(math.log2(extent))
    side = 2.0**top
    span = lambda a, b: range(math.floor(a / side), math.floor(b / side) + 1)
    open_ = [(top, cx, cy, np.arange(len(edges))) for cx in span(low_x.min(), high_x.max()) for cy in span(low_y.min(), high_y.max())]
    made = 0
    while open_:
        level, cx, cy, near = open_.pop(0)
        side = 2.0**level
        x, y = cx * side, cy * side
        near = near[(low_x[near] <= x + side) & (high_x[near] >= x) & (low_y[near] <= y + side) & (high_y[near] >= y)]
        if len(near) > EDGES and level > top - DEPTH and made + len(open_) < CELLS:
            open_ += [(level - 1, 2 * cx + i, 2 * cy + j, near) for i in (0, 1) for j in (0, 1)]
            continue
        px, py = x + ANCHOR[0] * side, y + ANCHOR[1] * side
        inside = even_odd(edges, px, py)
        if inside or len(near):
            made += 1
            yield level, cx, cy, px, py, inside, edges[near]


def plain_cells(many: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(which, level, cx, cy, anchor x and y, inside, number of edges) as arrays, and all edges, of the cells of polygons that need no split: the
    four cells of each are looked at together."""
    sizes = np.array([len(e) for e in many])
    e, starts = np.concatenate(many), np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(many)), sizes)
    ends = [np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2]), np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])]
    low_x, high_x, low_y, high_y = (f.reduceat(v, starts) for f, v in zip((np.minimum, np.maximum) * 2, ends, strict=True))
    level = np.ceil(np.log2(np.maximum(np.maximum(high_x - low_x, high_y - low_y), 1e-12)))
    side = 2.0**level
    cx, cy = np.floor(low_x / side) + np.array([[0], [0], [1], [1]]), np.floor(low_y / side) + np.array([[0], [1], [0], [1]])
    x, y = cx * side, cy * side
    px, py = x + ANCHOR[0] * side, y + ANCHOR[1] * side
    at = lambda v: v[..., owner]
    near = (ends[0] <= at(x + side)) & (ends[1] >= at(x)) & (ends[2] <= at(y + side)) & (ends[3] >= at(y))
    ax, ay, bx, by = e.T
    over = (ay > at(py)) != (by > at(py))
    with np.errstate(divide="ignore", invalid="ignore"):
        over &= at(px) < (bx - ax) * (at(py) - ay) / (by - ay) + ax
    inside = np.add.reduceat(over, starts, axis=1, dtype=np.int64) % 2 == 1
    touched = np.add.reduceat(near, starts, axis=1, dtype=np.int64)
    keep = (cx <= np.floor(high_x / side)) & (cy <= np.floor(high_y / side)) & (inside | (touched > 0))
    which = np.broadcast_to(np.arange(len(many)), keep.shape)
    levels = np.broadcast_to(level, keep.shape)
    _, rows = np.nonzero(near & at(keep))
    return which[keep], levels[keep].astype(np.int32), cx[keep].astype(np.int64), cy[keep].astype(np.int64), px[keep], py[keep], inside[keep], touched[keep], e[rows]


def edges_of(rings: pa.ListArray) -> list[np.ndarray]:
    """Per row of rings (lists of lists of points) its edges (n, 4), read from the flat coordinates; rings are closed if they are not."""
    inner = rings.flatten()
    points = inner.flatten()
    xy = np.stack([points.field("x").to_numpy(zero_copy_only=False), points.field("y").to_numpy(zero_copy_only=False)], 1) if len(points) else np.zeros((0, 2))
    sizes = np.array([n or 0 for n in inner.value_lengths().to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    out, at = [], 0
    for n in rings.value_lengths().to_pylist():
        parts = []
        for i in range(at, at + (n or 0)):
            r = xy[ends[i] - sizes[i] : ends[i]]
            if len(r) > 1:
                parts.append(np.hstack([r[:-1], r[1:]]))
                if (r[0] != r[-1]).any():
                    parts.append(np.hstack([r[-1:], r[:1]]))
        out.append(np.concatenate(parts) if parts else np.zeros((0, 4)))
        at += n or 0
    return out


def covers(polygons: DataFrame, keep: list[str], rings: str = "rings") -> DataFrame:
    """The columns ``keep`` and a row for each cell (columns of ``CELL``) of each row's rings, inside by the even-odd rule over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(k, pa.float64()) for k in ("ax", "ay", "bx", "by")])
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                edges = edges_of(b.column(rings))
                plain = [i for i, e in enumerate(edges) if 0 < len(e) <= EDGES]
                made = []
                if plain:
                    which, *rest = plain_cells([edges[i] for i in plain])
                    made.append((np.array(plain)[which], *rest))
                wide = [(i, *c) for i, e in enumerate(edges) if len(e) > EDGES for c in cells_of(e)]
                if wide:
                    *columns, near = zip(*wide, strict=True)
                    made.append((*(np.array(c) for c in columns), np.array([len(e) for e in near]), np.concatenate(near)))
                for which, level, cx, cy, px, py, inside, sizes, flat in made:
                    items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(4)], fields=list(kind))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), items)
                    took = pa.array(which)
                    numbers = [pa.array(level.astype(np.int32)), pa.array(cx.astype(np.int64)), pa.array(cy.astype(np.int64)), pa.array(px), pa.array(py), pa.array(inside)]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(took) for c in keep), *numbers, lists], [*keep, "level", "cx", "cy", "px", "py", "inside", "edges"])

    given = polygons.select(*keep, rings)
    return given.mapInArrow(run, StructType([*(given.schema[c] for c in keep), *StructType.fromDDL(CELL)]))


def holds(x: Column, y: Column) -> Column:
    """Whether the polygon of a cell (columns of ``CELL``) holds the point of the same cell."""

    def crossed(e: Column) -> Column:
        ax, ay, bx, by = (e[k] for k in ("ax", "ay", "bx", "by"))
        over = (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax
        up = (by - ay) * (F.col("px") - ax) / F.nullif(bx - ax, F.lit(0.0)) + ay
        along = ((ay > y) != (by > y)) & ((over > x) != (over > F.col("px")))
        across = ((ax > F.col("px")) != (bx > F.col("px"))) & ((up > y) != (up > F.col("py")))
        return F.coalesce(along.cast("int"), F.lit(0)) + F.coalesce(across.cast("int"), F.lit(0))

    return F.col("inside") != (F.aggregate("edges", F.lit(0), lambda n, e: n + crossed(e)) % 2 == 1)


def held_by(points: DataFrame, cells: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Each point (with its columns) with each polygon of ``covers`` that holds it (with its columns, of other names), of the same ``keys``.

    ``cells`` is read twice, so it should be a table. A point asks one cell of every level in use, of which there are few. A level with
    few cells is dealt out ``SALTS`` times, and the points that ask it are spread over these, so none of its cells is a hot key."""
    keys = keys or []
    levels = {r.level: r.n for r in cells.groupBy("level").agg(F.count("*").alias("n")).collect()}
    total = sum(levels.values())
    salts = {k: SALTS if n * SALTS <= total else 1 for k, n in levels.items()}
    if not levels:
        salts = {0: 1}
    many = F.element_at(F.create_map(*[F.lit(v) for k, n in sorted(salts.items()) for v in (k, n)]), F.col("level"))
    side = F.pow(F.lit(2.0), F.col("level"))
    asked = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in sorted(salts)])))
    asked = asked.withColumns({"cx": F.floor(F.col(x) / side), "cy": F.floor(F.col(y) / side), "salt": F.pmod(F.xxhash64(x, y), many).cast("int")})
    dealt = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1)))
    return asked.join(shuffled(dealt), [*keys, "level", "cx", "cy", "salt"]).where(holds(F.col(x), F.col(y))).drop("level", "cx", "cy", "salt", "px", "py", "inside", "edges")
