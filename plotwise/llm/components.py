"""Connected components: every task contracts the links it holds, then large-star and small-star rounds join what the tasks found.

Links that fit one task by their measured number (``LINKS_PER_TASK``) are solved by one contraction; more are dealt out
over as many tasks as that bound asks for, and every round is cut into shared storage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Links that one task holds at once; at about 300 bytes a link this bounds its memory.
LINKS_PER_TASK = 400_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of one task replaced by one link from every node to the least node that it reaches over them."""
    up: dict = {}

    def least(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    types = None
    for b in batches:
        types = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            up.setdefault(u, u), up.setdefault(v, v)
            x, y = least(u), least(v)
            if x != y:
                up[max(x, y)] = min(x, y)
    if types is not None:
        nodes = [x for x in up if up[x] != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, types), pa.array([least(x) for x in nodes], types)], ["u", "v"])


def _with_least(pairs: DataFrame, own: bool) -> DataFrame:
    """(u, v, m): m is the least of u's neighbours v (and u). The minima are cut first, so a hub's rows may be split among tasks."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = cut(least.select("u", F.least("u", "m").alias("m")) if own else least)
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the least node reachable. Self links are ignored."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        tasks = -(-edges.count() // LINKS_PER_TASK)
        held = edges.coalesce(1) if tasks <= 1 else edges.repartition(tasks)
        edges = cut(held.mapInArrow(_forest, edges.schema))
        if tasks <= 1 or _stars(edges):
            break
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = cut(_with_least(both, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = _with_least(large, False).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = cut(down.where("u <> v").distinct())
    rest = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
    return cut(stars.unionByName(rest))


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one least node that hangs on none."""
    n, distinct = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return n == distinct and edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
