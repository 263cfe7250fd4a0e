"""Near-duplicate vectors: a forest of random-projection trees with spill, compared within leaves, verified and united.

Fit: each tree splits a bounded sample (``SAMPLE`` distinct vectors, by hash) at random directions near the median,
as deep as the number of vectors asks for (leaves of about ``LEAF`` rows; the sample bounds the depth). Leaves that hold more than
``BLOCK`` rows are split again by a tree fitted on their own rows (about ``LEAF_SAMPLE``), until they are small or can't be split, so
leaves don't grow with the table. A row within ``SPILL`` quantiles of a split goes down both sides. A split must not part a dense group (rows linked to ``DENSE`` of the node's
sample): other places and directions are tried, and if all part it the node stays a leaf. Every vector is routed down every tree.
Leaves are compared whole; a leaf that stays over ``BLOCK`` rows is compared block by block, all blocks against all, so no task holds
more than two blocks. A pair counts in the first leaf that holds both, so a task gives one row for each linked vector, not for each pair.
Cosines are computed in double precision; links below the threshold are never reported. Equal vectors are one node.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are components of
their own, and so are vectors of another dimension than a leaf's others (they are never compared); repeated rows and repeated ids are rows of
their own; component_id is the least vec_id (null if none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import cut, table

COSINE = 0.95
TREES, LEAF, SPILL, SAMPLE, BLOCK, LEAF_SAMPLE = 8, 512, 0.05, 20_000, 4096, 2048
#: A group is dense from this share of a node's sample; a split may part so much of its links; rows of the sample looked at; directions tried.
DENSE, PARTED, PROBE, TRIES = 0.05, 0.05, 512, 4


@dataclass
class Split:
    direction: np.ndarray
    low: float
    high: float
    left: object
    right: object


def dense_links(x: np.ndarray, cosine: float) -> np.ndarray:
    """Per row that many others are linked to: its links, as a row of booleans; no rows if no group is dense."""
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    degree = linked.sum(1)
    linked[degree < max(8, DENSE * len(x))] = False
    return linked


def parted(linked: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """The share of links between rows that go down the low side only and rows that go down the high side only: over all links or a row's, the greater."""
    lost = (linked & (low[:, None] & high | high[:, None] & low)).sum(1)
    degree = linked.sum(1)
    dense = degree > 0
    return max(lost.sum() / degree.sum(), (lost[dense] / degree[dense]).mean())


def grow(x: np.ndarray, depth: float, draw: np.random.Generator, counter: list[int], spill: float = SPILL, cosine: float = COSINE):
    """A tree over the sample: Split nodes, leaves numbered by int. A node that every split tried would cut through a dense group is a leaf."""
    if depth > 0 and len(x) >= 16:
        probe = draw.choice(len(x), PROBE, replace=False) if len(x) > PROBE else np.arange(len(x))
        linked = dense_links(x[probe], cosine)
        dense = linked.any()
        directions = draw.normal(size=(TRIES if dense else 1, x.shape[1]))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        projected = x @ directions.T
        for at in (draw.uniform(0.45, 0.55), 0.35, 0.65, 0.25, 0.75) if dense else (draw.uniform(0.45, 0.55),):
            for direction, p in zip(directions, projected.T, strict=True):
                low, high = np.quantile(p, [at - spill, at + spill])
                if low == high or dense and parted(linked, p[probe] < low, p[probe] >= high) > PARTED:
                    continue
                # A balanced split counts as one level, an uneven one by what it leaves to each side.
                sides = (x[p < high], x[p >= low])
                left, right = (grow(y, depth + np.log2(len(y) / len(x) / (1 + 2 * spill)), draw, counter, spill, cosine) for y in sides)
                return Split(direction, low, high, left, right)
    counter[0] += 1
    return counter[0] - 1


def route(tree, x: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(rows):
        return
    if isinstance(tree, int):
        yield tree, rows
        return
    p = x[rows] @ tree.direction
    yield from route(tree.left, x, rows[p < tree.high])
    yield from route(tree.right, x, rows[p >= tree.low])


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Per row with a usable vector: vec_id, key (digest of its bytes), v (64-bit floats, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys, raw = [], [], []
            for i, v in enumerate(b.column("embedding").to_pylist()):
                if not v or any(x is None for x in v):
                    continue
                x = np.array(v, "<f8")
                if np.isfinite(x).all() and x.any():
                    rows.append(i)
                    raw.append((x + 0.0).tobytes())
                    keys.append(hashlib.blake2b(raw[-1], digest_size=16).digest())
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "key", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id bigint, key binary, v binary")


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, seed: int = 11, cosine: float = COSINE) -> list:
    """Trees for ``n`` vectors; leaves are numbered over all trees, ascending."""
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    draw, counter = np.random.default_rng(seed), [0]
    return [grow(sample, depth, draw, counter, cosine=cosine) for _ in range(trees)]


def shared_before(earlier: list[np.ndarray]) -> np.ndarray:
    """Bits per row of the earlier leaves that it shares with another row of the block."""
    ids = np.concatenate(earlier).astype("int64")
    row = np.repeat(np.arange(len(earlier)), [len(e) for e in earlier])
    _, column, count = np.unique(ids, return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column] if len(ids) else column
    bits = np.zeros((len(earlier), max(1, int((count > 1).sum()))), bool)
    bits[row[column >= 0], column[column >= 0]] = True
    return np.packbits(bits, axis=1)


def contract(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each node's least known fellow) after joining i with j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


#: A row in a leaf; ``earlier`` has its leaves of lower numbers.
PLACED = "leaf bigint, key binary, v binary, m bigint, earlier array<bigint>"


def split_again(placed: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """The rows in their final leaves, and per leaf its number of blocks. A leaf over ``BLOCK`` rows gets a tree from its own sample, fitted
    in a task for each leaf, and its rows meet that tree block by block; leaves that can't be split stay."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        leaf, n = int(pdf["leaf"].iloc[0]), int(pdf["n"].iloc[0])
        tree = grow(unit(pdf["v"].tolist()), np.ceil(np.log2(n / LEAF)), np.random.default_rng(leaf % (1 << 63)), [0], cosine=cosine)
        return pd.DataFrame({"leaf": [leaf], "tree": [pickle.dumps(tree) if isinstance(tree, Split) else None]})

    def move(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        moved = rows.iloc[:0].assign(part=0)
        if len(rows):
            found = route(pickle.loads(trees["tree"].iloc[0]), unit(rows["v"].tolist()), np.arange(len(rows)))
            moved = pd.concat([rows.iloc[at].assign(part=part) for part, at in found])
        return moved[["leaf", "part", "key", "v", "m"]]

    whole, again = None, False
    while True:
        sizes = cut(placed.groupBy("leaf").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
        big = sizes.where("blocks > 1")
        big = big if whole is None else big.join(whole, "leaf", "left_anti")
        part = (F.lit(float(1 << 30)) * LEAF_SAMPLE / F.col("n")).cast("long")
        sample = placed.join(big, "leaf").where(F.pmod(F.xxhash64("leaf", "key"), F.lit(1 << 30)) < part).select("leaf", "n", "key", "v")
        fitted = cut(sample.groupBy("leaf").applyInPandas(fit, "leaf bigint, tree binary"))
        trees = fitted.where("tree is not null").join(sizes.select("leaf", "blocks"), "leaf")
        if trees.isEmpty():
            break
        again = True
        stay = fitted.where("tree is null").select("leaf")
        whole = stay if whole is None else cut(whole.unionByName(stay))
        rows = placed.select("leaf", "key", "v", "m").join(trees.select("leaf", "blocks"), "leaf")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks")
        trees = trees.select("leaf", "tree", F.explode(F.expr("sequence(0, blocks - 1)")).alias("own"))
        moved = rows.groupBy("leaf", "own").cogroup(trees.groupBy("leaf", "own")).applyInPandas(move, "leaf bigint, part int, key binary, v binary, m bigint")
        moved = moved.withColumn("leaf", F.xxhash64("leaf", "part")).drop("part")
        rest = placed.join(fitted.where("tree is not null"), "leaf", "left_anti").select("leaf", "key", "v", "m")
        placed = cut(rest.unionByName(moved))
    if again:
        of = placed.groupBy("key").agg(F.collect_list("leaf").alias("leaves"))
        placed = cut(placed.join(of, "key").select("leaf", "key", "v", "m", F.filter("leaves", lambda x: x < F.col("leaf")).alias("earlier")))
    return placed, sizes.select("leaf", "blocks")


def links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per leaf block and row that is linked in it: a (its key), b (the key of its component within the block, if another), others (rows
    behind its linked vectors, each pair counted in the first leaf that holds both). ``nodes``: key, v, m."""
    spark, n = nodes.sparkSession, nodes.count()
    widths = [r[0] for r in nodes.select(F.length("v").alias("d")).distinct().collect()]
    out = None
    for width in widths:
        same = nodes.where(F.length("v") == width)
        share = int((1 << 30) * min(1.0, SAMPLE / max(1, n)))
        taken = same.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share).select("key", "v").collect()
        if not taken:
            taken = same.select("key", "v").limit(1).collect()
        taken.sort(key=lambda r: bytes(r.key))
        trees = spark.sparkContext.broadcast(forest(unit([bytes(r.v) for r in taken]), n, cosine=cosine))

        def leaves(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = unit(b.column("v").to_pylist())
                    before: list[list[int]] = [[] for _ in range(len(x))]
                    for tree in trees.value:
                        for leaf, rows in route(tree, x, np.arange(len(x))):
                            take = pa.array(rows)
                            earlier = pa.array([before[r] for r in rows], pa.list_(pa.int64()))
                            for r in rows:
                                before[r].append(leaf)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf)), b.column("key").take(take), b.column("v").take(take), b.column("m").take(take), earlier], ["leaf", "key", "v", "m", "earlier"])

        placed, sizes = split_again(cut(same.select("key", "v", "m").mapInArrow(leaves, PLACED)), cosine)
        dealt = placed.join(sizes, "leaf").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        dealt = dealt.select("leaf", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "key", "v", "m", "earlier")

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            first = int(pdf["x"].iloc[0])
            crossed = first != int(pdf["y"].iloc[0])
            keys, m = pdf["key"].tolist(), pdf["m"].to_numpy()
            v, before = unit(pdf["v"].tolist()), shared_before(pdf["earlier"].tolist())
            one = np.flatnonzero(pdf["own"].to_numpy() == first)
            two = np.flatnonzero(pdf["own"].to_numpy() != first) if crossed else one
            others, label = np.zeros(len(keys)), np.arange(len(keys))
            for at in range(0, len(one), 256):
                i, j = np.nonzero(v[one[at : at + 256]] @ v[two].T >= cosine)
                i, j = one[at + i], two[j]
                if not crossed:
                    i, j = i[i < j], j[i < j]
                fresh = ~(before[i] & before[j]).any(1)
                i, j = i[fresh], j[fresh]
                others += np.bincount(i, m[j], len(keys)) + np.bincount(j, m[i], len(keys))
                label = contract(label, i, j)
            found = np.flatnonzero(others)
            return pd.DataFrame({"a": [keys[r] for r in found], "b": [keys[label[r]] if label[r] != r else None for r in found], "others": others[found].astype("int64")})

        part = dealt.groupBy("leaf", "x", "y").applyInPandas(compare, "a binary, b binary, others bigint")
        out = part if out is None else out.unionByName(part)
    return cut(out) if out is not None else spark.createDataFrame([], "a binary, b binary, others bigint")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = cut(distinct_vectors(vectors))
    nodes = cut(rows.groupBy("key").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"), F.first("v").alias("v")))
    linked = links(nodes.select("key", "v", "m"), cosine)
    n = linked.groupBy(F.col("a").alias("key")).agg(F.sum("others").alias("others"))
    found = components(linked.where("b is not null").select("a", "b"))
    placed = nodes.select("key", "m", "least").join(found.select(F.col("node").alias("key"), "component"), "key", "left").join(n, "key", "left")
    placed = cut(placed.select("key", "least", F.coalesce("component", "key").alias("component"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    best = cut(placed.groupBy("component").agg(F.min("least").alias("component_id")))
    known = cut(placed.join(best, "component").select("key", "n_links", "component_id"))
    united = rows.select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rest = vectors.where(~F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return united.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings``: vec_id, n_links, component_id (least vec_id reachable by links), kept."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
