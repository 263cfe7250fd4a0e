"""Periodic runs of words: Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word extends and
that has at least ``EXPONENT`` periods and ``LEAST`` words. The texts of an Arrow slice are one array of word ids, interned by a table,
so that equal ids are equal words. Every text is halved again and again. At each midpoint two pairs of Z-functions, over the half on the
right read forwards and over the half on the left read backwards, tell for every period how far words repeat on both sides of
the midpoint, that is, how far the repetition extends. A run is found at the first midpoint that it crosses, for until there no half has
cut it; what could be extended past its half is a run that an earlier midpoint has found, so each interval is listed once. Of the periods
of an interval the smallest stays.

Midpoints that no run can cross are told in bulk, without error: a run of four periods or more has two whole periods on one side of
the midpoint, so there the midpoint's two words come again one period on and two stretches of a period and a word are equal. Stretches
are compared by a polynomial hash; only a midpoint with a pair of equal stretches gets Z-functions, which decide.

Defined results: a null, empty or blank text has no words and no runs, and collapses to ''; repeated rows are rows of their own;
very long texts are read whole; an empty table gives no rows; other columns stay, of any name but the new ones. A null doc_id is not
made periodic in the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import slices, table

EXPONENT, LEAST = 4, 6
#: Fixed value: the white space between words.
SPACE = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
U64 = np.uint64
#: The odd multiplier of the polynomial hash over word ids.
BASE = U64(0x9E3779B97F4A7C15)


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of ``s`` and of what begins there (at 0: the whole length)."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    low = high = 0
    for i in range(1, n):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def crossing(u: list[int], v: list[int]) -> Iterator[tuple[int, int, int]]:
    """(left, right, period): how many words of u's end and v's beginning a repetition across their border covers, for each period for
    which it is long enough, reaches both sides and has two periods on one of them."""
    for one, two, turned in ((u, v, False), (v[::-1], u[::-1], True)):
        most = len(two) // 2
        ahead, back = z_function(two), one[::-1]
        periods = [q for q in range(1, most + 1) if ahead[q] >= q]
        if not periods:
            continue
        # Behind the border: the common suffix of ``one`` and of ``one`` with the first q words of ``two``.
        behind = z_function([*back, -1, *two[::-1], *back])
        for q in periods:
            far, near = q + ahead[q], behind[len(one) + 1 + len(two) - q]
            if near and far + near >= max(LEAST, EXPONENT * q):
                yield (far, near, q) if turned else (near, far, q)


def nodes(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level the (low, middle, high) of the halves of all texts that can hold a run; ``bounds`` are the texts' first words and the end."""
    low, high = bounds[:-1], bounds[1:]
    while True:
        wide = high - low >= LEAST
        low, high = low[wide], high[wide]
        if not len(low):
            return
        mid = (low + high) // 2
        yield low, mid, high
        low, high = np.concatenate([low, mid]), np.concatenate([mid, high])


def promising(ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The nodes whose midpoint a run can cross."""
    n = len(ids)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pair = np.empty(n, U64)
    wide = U64(int(ids.max()) + 2)
    pair[0], pair[1:] = 0, (ids[:-1].astype(U64) + U64(1)) * wide + ids[1:].astype(U64) + U64(1)
    # The same pair in another text is another one; hashed, as the texts of a slice and the words may be many.
    key = (pair * BASE) ^ ((owner.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    fresh = np.empty(n, np.int64)
    fresh[0], fresh[1:] = 0, key[order][1:] != key[order][:-1]
    group = np.cumsum(fresh)
    place = group * (n + 1) + order
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    powers = np.empty(n + 1, U64)
    powers[0], powers[1:] = 1, BASE
    powers = np.cumprod(powers, dtype=U64)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((ids.astype(U64) + U64(1)) * powers[:n], dtype=U64, out=prefix[1:])

    def equal(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches from a and from b (b > a) hash alike."""
        return (prefix[a + length] - prefix[a]) * powers[b - a] == prefix[b + length] - prefix[b]

    for low, mid, high in nodes(bounds):
        at = group[rank[mid]] * (n + 1)
        hit = np.zeros(len(mid), bool)
        for first, last, right in ((mid + 1, mid + (high - mid) // 2, True), (mid - (mid - low) // 2, mid - 1, False)):
            start, end = np.searchsorted(place, at + first), np.searchsorted(place, at + last, side="right")
            many = np.maximum(0, end - start)
            node = np.repeat(np.arange(len(mid)), many)
            if not len(node):
                continue
            offset = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many)
            other, m = order[start[node] + offset], mid[node]
            q = np.abs(other - m)
            begin = m - 1 if right else m - 2 * q
            hit[node[equal(begin, begin + q, q + 1)]] = True
        yield from zip(low[hit].tolist(), mid[hit].tolist(), high[hit].tolist(), strict=True)


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per text its runs (start, length, period) by start, then period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(len(bounds) - 1)]
    if len(ids):
        for low, mid, high in promising(ids, bounds):
            text = int(np.searchsorted(bounds, low, side="right")) - 1
            own = found[text]
            for left, right, q in crossing(ids[low:mid].tolist(), ids[mid:high].tolist()):
                a, b = mid - left, mid + right
                # What goes on past the half has been cut by an earlier midpoint, where it was found whole.
                goes_on = a > bounds[text] and ids[a - 1] == ids[a - 1 + q] or b < bounds[text + 1] and ids[b] == ids[b - q]
                if not goes_on:
                    own[a, b] = min(q, own.get((a, b), q))
    return [sorted((a - int(bounds[i]), b - a, q) for (a, b), q in own.items()) for i, own in enumerate(found)]


def interned(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, their ids, one text after another, and the texts' bounds."""
    words = [t.split() if t else [] for t in texts]
    numbers = dict(zip(set(chain.from_iterable(words)), count()))
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(ws) for ws in words], out=bounds[1:])
    return words, np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(bounds[-1])), bounds


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay: of every run its first period, unless another run drops that."""
    if not runs:
        return b" ".join(words)
    stays = np.ones(len(words), bool)
    for start, length, q in runs:
        stays[start + q : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(stays).tolist()])


def collapse_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep`` if given) with ``runs`` (by start, then period; places are word numbers from 0) and ``collapsed``, the
    words that stay joined by one space. Columns of these names are replaced."""
    stay = [c for c in (docs.columns if keep is None else keep) if c not in ("runs", "collapsed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        for b in slices(batches):
            words, ids, bounds = interned(b.column(text).cast(pa.binary()).to_pylist())
            found = runs_of(ids, bounds)
            listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found], kind)
            left = pa.array([collapsed(ws, rs) for ws, rs in zip(words, found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in stay), listed, left], [*stay, "runs", "collapsed"])

    given = docs.select(*dict.fromkeys([*stay, text]))
    return given.mapInArrow(run, StructType([*(given.schema[c] for c in stay), *StructType.fromDDL(f"runs {RUNS}, collapsed string")]))


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period, of these the first (runs come by start, then period); null without a run."""
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))


def periodic_tail(doc_id: Column, text: Column) -> Column:
    """The text whose words, for a tenth of the ids (by crc32 h of the decimal id, g = h div 10), repeat with a period drawn from g behind a
    word drawn from g; the other texts as they are. Words are numbered by white space; built-in functions only."""
    h = F.crc32(F.encode(doc_id.cast("string"), "utf-8"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.coalesce(F.size(words), F.lit(0))
    at = F.struct(words.alias("w"), n.alias("n"), (g % F.greatest(n, F.lit(1))).cast("int").alias("a"))
    p = lambda x: (1 + F.floor((x["n"] - x["a"]) / (3 + g % 8))).cast("int")
    tail = lambda x: F.transform(F.sequence(x["a"], x["n"] - 1), lambda i: F.get(x["w"], (x["a"] + (i - x["a"]) % p(x)).cast("int")))
    made = F.transform(F.array(at), lambda x: F.array_join(F.concat(F.slice(x["w"], F.lit(1), x["a"]), tail(x)), " "))[0]
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, a tenth with a periodic tail: n_runs, the strongest run, digests of all runs and of the words that stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = collapse_runs(docs, keep=["doc_id"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.*", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
