"""Near-duplicate documents: consistent weighted sampling over TF-IDF word shingles, banded, verified by weighted Jaccard.

Words: the lower-cased text split at white space. Shingles: five words (one shingle of all words if there are fewer).
Weight of a shingle: its count in the text times the mean inverse document frequency of its words. Word frequencies
are counted over all documents in ``IDF_SLOTS`` hashed slots, a table of fixed size. Weighing by words, not by whole
shingles, keeps a large group of near copies from making its own shared shingles look common.

Sampling: ``BANDS * ROWS`` consistent weighted samples of each text. Element e with weight w has, for hash k, draws
r, c ~ Gamma(2, 1) and b ~ U(0, 1); t = floor(ln w / r + b); the element with the least ln c - r (t - b + 1) is the
sample, and (element, t) its value. The draws come from a table indexed by 16 bits of a hash of (e, k) and weights are
put on a grid of quarter powers of two, so that a sample costs one look-up; equal values break by the element's hash.

Candidates: texts that agree on a whole band share a bucket. In each bucket the least text is held against all
others. Of the buckets that then span several components, every pair of texts from different components is held
against each other; pairs within a component add nothing and are not made. This work is counted first and split into
ranges of texts by hash, at most ``WORK`` or ``WORK_PER_TEXT`` comparisons a text at once; what one range links is one
component for the next. Before all ranges, each text outside its bucket's largest component is held against the nearest
text of another component, which joins most of what can be joined. A comparison first counts the bits in which two
bitmaps of all shingles differ: bits differ only where shingles do, so this bounds the similarity from above without
error. One bitmap has a bit a shingle, the other a bit for each whole ``UNIT`` of a shingle's weight. A pair ends there only
if it can reach the similarity under neither weighing; texts too long for the bitmaps fill them and pass. The others are
verified with exact weights over whole texts. Sketches of ``BITS`` bits a sample spare the bitmaps most of the work: a pair ends there
only if its samples agree as at ``CLOSE`` or less under the TF-IDF weights (nine deviations from what 0.8 gives) and as at ``EQUAL_CLOSE``
or less under equal ones (seven). Equal texts are one node throughout. Classes are the connected components of verified links.

One rule holds for sampling, filtering and verifying: a link is a weighted Jaccard similarity of at least 0.8 under the TF-IDF weights or
under equal weights, for near copies that differ in rare words only are far under the first and close under the second. So
besides the bands drawn by TF-IDF weights there are ``EQUAL_BANDS`` of ``EQUAL_ROWS`` samples of all shingles alike (one hash a shingle, least
of its bin). A pair at 0.8 meets in a band of its weighing with probability 0.9993 (TF-IDF) or 0.998 (equal).

Defined results: texts without words (null, empty, blank) are never linked and are classes of their own; repeated
rows fall into one class; ``class_id`` is the least doc_id of the class (null if it has none); an empty table gives
no rows; other columns are ignored (by the stage: passed on).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import cut, slices, small_side, table

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
IDF_SLOTS = 1 << 16
#: A sketch holds four bits of every sample. Texts whose samples agree less than at a similarity of ``CLOSE`` are not
#: verified; those from ``NEAREST`` on may be a text's nearest.
BITS, CLOSE, NEAREST = 4, 0.5, 0.77
LONGS = -(-BANDS * ROWS // 64)
SKETCH = BITS * LONGS
#: 64-bit words of the bitmaps: all shingles alike, and by weight (a bit for each whole ``UNIT``, ``COPIES`` at most).
PLAIN, WEIGHED, UNIT, COPIES = 24, 20, 2.0, 6
#: Parts of a weight in which a text's total is stored.
PARTS = 1 << 10
#: Bands and rows of the samples under equal weights; longs of their sketch, and how little they may agree.
EQUAL_BANDS, EQUAL_ROWS, EQUAL_CLOSE = 16, 5, 0.45
BINS = EQUAL_BANDS * EQUAL_ROWS
#: For each bin the places of all bins in the order in which it asks them, at random.
LENDERS = np.random.default_rng(11).permuted(np.tile(np.arange(BINS, dtype=np.uint8), (BINS, 1)), axis=1)
EQUAL_LONGS = -(-BINS // 64)
EQUAL_SKETCH = BITS * EQUAL_LONGS
#: Where in a text's longs the bands end, and its sketches.
ALL = BANDS + EQUAL_BANDS
REST = ALL + SKETCH + EQUAL_SKETCH
#: Longs a text: bands, sketches, both bitmaps, number of distinct shingles, total weight.
WIDTH = REST + PLAIN + WEIGHED + 2
#: Comparisons between two merges: this many, or this many a text if that is more.
WORK, WORK_PER_TEXT, SLOTS = 20_000_000, 200, 1 << 15
LEVELS_PER_OCTAVE = 4
#: Shingles that are sampled at once, and those of one weight level that are sampled apart from the other levels'.
STEP, CROWD = 240_000, 4_000
#: Which half of a 64-bit number in memory is its high one.
HIGH = int(sys.byteorder == "little")
#: Powers of the words' hash that a worker keeps (16 bytes each); longer texts make their own.
KEEP = 1 << 20
U64 = np.uint64


#: White space outside ASCII, and the odd multiplier of the words' polynomial hash with its inverse mod 2**64.
WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX, HALF = U64(0xD6E8FEB86659FD93), U64(32)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and INVERSE**i for i up to n, kept between calls up to ``KEEP``."""
    if len(_powers[0]) > n:
        return _powers
    made = []
    for base in (BASE, INVERSE):
        steps = np.full(1 << n.bit_length(), base, U64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=U64))
    if n < KEEP:
        _powers[:] = made
    return made


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, all at once: differences of a running polynomial over the bytes, shifted to the word's start."""
    if not text:
        return np.zeros(0, U64)
    if not text.isascii() and any(c in text for c in WIDE_SPACE):
        text = " ".join(text.split())
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(raw))
    run = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], dtype=U64, out=run[1:])
    return mixed((run[end] - run[start]) * down[start] + (end - start).astype(U64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> HALF)
    x *= MIX
    x ^= x >> HALF
    x *= MIX
    x ^= x >> HALF
    return x


def shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their weights."""
    return counted_shingles(words, idf)[:2]


def counted_shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, their weights and how often each occurs."""
    n = max(1, len(words) - SHINGLE + 1)
    value = idf[words & U64(IDF_SLOTS - 1)]
    h, w = np.zeros(n, U64), np.zeros(n)
    width = min(SHINGLE, len(words))
    for i in range(width):
        h = mixed(h ^ words[i : i + n]) if i == 0 else mixed(h * U64(0x9E3779B97F4A7C15) + words[i : i + n])
        w += value[i : i + n]
    order = np.argsort(h)
    h = h[order]
    first = np.append(0, np.flatnonzero(h[1:] != h[:-1]) + 1)
    count = np.diff(first, append=n)
    return h[first], w[order[first]] / width * count, count


def alike(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity, under the TF-IDF weights or under equal weights of 1, whichever is more."""
    _, x, y = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    shared = np.minimum(one[1][x], two[1][y]).sum()
    plain = len(x) / (len(one[0]) + len(two[0]) - len(x))
    return max(plain, shared / (one[1].sum() + two[1].sum() - shared) * (1 + 1e-12))


class Sampler:
    """Band hashes of weighted shingle sets."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        n = 1 << 16
        self.r, self.c, self.b = draw.gamma(2, 1, n), draw.gamma(2, 1, n), draw.random(n)
        self.multipliers = draw.integers(1, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(U64) | U64(1)
        self.tables: dict[int, int] = {}
        self.scores = np.zeros((0, n), np.uint32)

    def rows_of(self, levels: np.ndarray) -> np.ndarray:
        """Offsets into the flat score table for weight levels, adding the tables of new levels."""
        known, where = np.unique(levels, return_inverse=True)
        for level in known.tolist():
            if level not in self.tables:
                ln = level * np.log(2) / LEVELS_PER_OCTAVE
                score = np.log(self.c) - self.r * (np.floor(ln / self.r + self.b) - self.b + 1)
                self.tables[level] = len(self.scores)
                self.scores = np.vstack([self.scores, ((np.clip(score, -60, 40) + 60) * ((1 << 32) - 1) / 100).astype(np.uint32)])
        return (np.array([self.tables[x] for x in known.tolist()], np.int64) << 16)[where]

    def bands(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, counts: np.ndarray | int = 1) -> np.ndarray:
        """Per text ``WIDTH`` longs: the band hashes under both weighings, their sketches (``BITS`` planes of one bit for each sample), then ``bitmaps``."""
        out = np.zeros((WIDTH, len(starts)), U64)
        hashed(self.samples(hashes, weights, starts), out, 0, BANDS, ALL)
        hashed(np.ascontiguousarray(equal_samples(hashes, starts).T), out, BANDS, EQUAL_BANDS, ALL + SKETCH)
        out[REST:] = bitmaps(hashes, weights, starts, counts).T
        return out.T.view(np.int64)

    def samples(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``BANDS * ROWS`` samples of each text (one column a text): the least score of its shingles, equal ones by hash.

        All samples of a level's shingles are drawn before the next level's, so its scores stay in the processor's cache; levels of
        few shingles are drawn together."""
        levels = np.rint(np.log2(weights) * LEVELS_PER_OCTAVE).astype(np.int16)
        offsets, known = self.rows_of(levels), np.bincount(levels - levels.min())
        owner = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(hashes)))
        crowded = np.flatnonzero(known >= CROWD) + levels.min()
        out = np.full((len(self.multipliers), len(starts)), 0xFFFFFFFFFFFFFFFF, U64)
        for at in [*(np.flatnonzero(levels == level) for level in crowded), np.flatnonzero(~np.isin(levels, crowded))]:
            if not len(at):
                continue
            h, offset = hashes[at], offsets[at].view(U64)
            alone = offset.min() == offset.max()
            scores = self.scores.ravel()[int(offset[0]) :][: 1 << 16] if alone else self.scores.ravel()
            first = np.flatnonzero(np.diff(owner[at], prepend=-1))
            least, packed = np.empty((len(out), len(first)), U64), h & U64(0xFFFFFFFF)
            place, score, high = np.empty(len(h), U64), np.empty(len(h), np.uint32), packed.view(np.uint32)[HIGH::2]
            for k, m in enumerate(self.multipliers):
                np.multiply(h, m, out=place)
                np.right_shift(place, U64(48), out=place)
                if not alone:
                    np.add(place, offset, out=place)
                high[:] = scores.take(place.view(np.int64), out=score, mode="clip")
                np.minimum.reduceat(packed, first, out=least[k])
            texts = owner[at][first]
            out[:, texts] = np.minimum(out[:, texts], least)
        return out


def hashed(samples: np.ndarray, out: np.ndarray, band: int, bands: int, sketch: int) -> None:
    """Puts the ``bands`` hashes of ``samples`` (one column a text) in ``out`` from row ``band``, and the planes of their sketch from row ``sketch``."""
    number, texts = samples.shape
    of_band, value = samples.reshape(bands, number // bands, texts), np.zeros((bands, texts), U64)
    for row in range(number // bands):
        value = mixed(value * U64(BASE) + of_band[:, row])
    out[band : band + bands] = value
    code, longs = mixed(samples), -(-number // 64)
    for bit in range(BITS):
        plane = np.zeros((texts, 64 * longs), np.uint8)
        plane[:, :number] = (code >> U64(bit) & U64(1)).T
        out[sketch + bit * longs : sketch + (bit + 1) * longs] = np.packbits(plane, axis=1, bitorder="little").view("<u8").T


def equal_samples(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text ``BINS`` samples of its shingles, all of the same weight: each shingle falls into one bin, whose least is its sample. An empty
    bin takes that of another one, the first full one in an order of its own (``LENDERS``) that is the same for all texts."""
    draw, none = mixed(hashes * U64(BASE) + U64(1)), U64(0xFFFFFFFFFFFFFFFF)
    row = np.repeat(np.arange(len(starts)) * BINS, np.diff(starts, append=len(hashes)))
    out = np.full((len(starts), BINS), none, U64)
    # The bin is the draw's share of the range, so within a bin the least draw is the sample.
    np.minimum.at(out.ravel(), row + ((draw >> U64(32)) * U64(BINS) >> U64(32)).astype(np.int64), draw)
    full = out != none
    for at in range(0, len(out), 256):
        text, bin_ = np.nonzero(~full[at : at + 256])
        other = np.where(full[at + text], LENDERS[bin_], BINS).argmin(1)
        out[at + text, bin_] = out[at + text, other]
    return out


def bitmaps(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, counts: np.ndarray | int = 1) -> np.ndarray:
    """Per text: both bitmaps of its shingles, their number and their total weight in ``PARTS``.

    A shingle of unit weight w that occurs n times has n * floor(w / UNIT) bits by weight (``COPIES`` at most): between two texts its
    bits never differ by more than its weights differ, in units.
    """
    sizes = np.diff(starts, append=len(hashes))
    owner = np.repeat(np.arange(len(starts)), sizes)
    plain, weighed = np.zeros((len(starts), 64 * PLAIN), bool), np.zeros((len(starts), 64 * WEIGHED), bool)
    plain[owner, (hashes >> U64(20)) % U64(64 * PLAIN)] = True
    draw = mixed(hashes ^ U64(BASE))
    copies = np.minimum(np.floor(weights / counts / UNIT) * counts, COPIES)
    for i in range(COPIES):
        has = copies > i
        if i:
            draw = mixed(draw)
        weighed[owner[has], (draw[has] >> U64(40)) * U64(64 * WEIGHED) >> U64(24)] = True
    packed = [np.packbits(x, axis=1, bitorder="little").view(U64) for x in (plain, weighed)]
    totals = np.rint(np.add.reduceat(weights, starts) * PARTS).astype(U64)
    return np.hstack([*packed, sizes.astype(U64)[:, None], totals[:, None]])


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "utf-8")))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency per hashed word slot, over all documents. Each task sums its own documents first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, last = np.zeros(IDF_SLOTS, np.int64), np.zeros(IDF_SLOTS, np.int64)
        docs_seen = 0
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                words = word_hashes(t)
                if len(words):
                    docs_seen += 1
                    at = (words & U64(IDF_SLOTS - 1)).astype(np.int64)
                    # Of the words in one slot a single one finds its own number there, so each slot counts once.
                    number = np.arange(len(at))
                    last[at] = number
                    slots[at[last[at] == number]] += 1
        full = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1).astype("int32")), pa.array(np.append(slots[full], docs_seen))], ["slot", "n"])

    sums = docs.select("text").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(IDF_SLOTS)
    total = 0
    for r in sums:
        if r.slot < 0:
            total = r.n
        else:
            n[r.slot] = r.n
    return (np.log((1 + total) / (1 + n)) + 1).astype(np.float32).astype(float)


def sign(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(id, key, bands) per row with words; id is doc_id or the least long for null."""
    shared_idf = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, idf = Sampler(), shared_idf.value
        for b in slices(batches):
            rows, bands, hs, ws, ns, starts, held = [], [], [], [], [], [], 0

            def flush():
                nonlocal hs, ws, ns, starts, held
                if starts:
                    bands.append(sampler.bands(np.concatenate(hs), np.concatenate(ws), np.array(starts), np.concatenate(ns)))
                hs, ws, ns, starts, held = [], [], [], [], 0

            for i, t in enumerate(b.column("text").to_pylist()):
                words = word_hashes(t)
                if not len(words):
                    continue
                h, w, n = counted_shingles(words, idf)
                rows.append(i)
                starts.append(held)
                hs.append(h)
                ws.append(w)
                ns.append(n)
                held += len(h)
                if held >= STEP:
                    flush()
            flush()
            if rows:
                flat = np.concatenate(bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype="int32") * WIDTH), pa.array(np.ascontiguousarray(flat).ravel()))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("key").take(take), lists], ["id", "key", "bands"])

    return docs.select("id", "key", "text").mapInArrow(run, "id bigint, key binary, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose whole texts have weighted Jaccard similarity of at least ``similarity``."""
    shared_idf = pairs.sparkSession.sparkContext.broadcast(idf)
    left, right = (texts.select(F.col("key").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    both = pairs.join(right, "b").join(left, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in slices(batches):
            good = []
            a, ta, tb = (batch.column(x).to_pylist() for x in ("a", "text_a", "text_b"))
            for i in range(len(a)):
                if a[i] != last:
                    last, one = a[i], shingles(word_hashes(ta[i]), shared_idf.value)
                two = shingles(word_hashes(tb[i]), shared_idf.value)
                if alike(one, two) >= similarity:
                    good.append(i)
            if good:
                take = pa.array(good)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with the component of each key: its own key if it has no link yet."""
    return members.join(found.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members of the buckets that span several components; ``minor`` marks those outside their bucket's largest component."""
    placed = cut(_placed(members.select("band", "value", "key"), found))
    sizes = placed.groupBy("band", "value", "component").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "component"))["component"]
    buckets = sizes.groupBy("band", "value").agg(most.alias("major"), F.count("*").alias("parts")).where("parts > 1")
    return placed.join(buckets.select("band", "value", "major"), ["band", "value"]).select("band", "value", "key", (F.col("component") != F.col("major")).alias("minor"))


def differing(x: str, y: str, start: int = ALL, longs: int = LONGS) -> Column:
    """The number of samples in which the sketches in two columns of band lists differ: by weight, or of the sketch that begins at ``start``."""
    planes = lambda i: [F.col(x)[start + bit * longs + i].bitwiseXOR(F.col(y)[start + bit * longs + i]) for bit in range(BITS)]
    return reduce(Column.__add__, [F.bit_count(reduce(Column.bitwiseOR, planes(i))) for i in range(longs)])


def close(x: str, y: str, least: float | None = None) -> Column:
    """Whether the samples under either weighing agree enough: as at ``CLOSE`` and ``EQUAL_CLOSE``, or at ``least`` under both."""
    by_weight = differing(x, y) <= most_differing(CLOSE if least is None else least)
    return by_weight | (differing(x, y, ALL + SKETCH, EQUAL_LONGS) <= most_differing(EQUAL_CLOSE if least is None else least, BINS))


def within_reach(x: str, y: str, similarity: float) -> Column:
    """Whether the bitmaps and totals in two columns of band lists leave room for ``similarity`` under either weighing."""

    def apart(start: int, longs: int) -> Column:
        bits = F.zip_with(F.slice(x, start + 1, longs), F.slice(y, start + 1, longs), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        return F.aggregate(bits, F.lit(0), lambda n, more: n + more)

    share, at = (1 - similarity) / (1 + similarity) * (1 + 1e-9), REST
    count, total = at + PLAIN + WEIGHED, at + PLAIN + WEIGHED + 1
    room = (F.col(x)[total] + F.col(y)[total] + 2) / PARTS * share
    plain = apart(at, PLAIN) <= (F.col(x)[count] + F.col(y)[count]) * share
    totals = F.abs(F.col(x)[total] - F.col(y)[total]) / PARTS <= room + 2 / PARTS
    return plain | (totals & (apart(at + PLAIN, WEIGHED) * UNIT <= room))


def most_differing(similarity: float, samples: int = BANDS * ROWS) -> int:
    """The samples expected to differ at a similarity."""
    return int((1 - similarity) * (1 - 2.0**-BITS) * samples)


def across(units: DataFrame, found: DataFrame, similarity: float, low: int = 0, high: int = SLOTS, least: float | None = None) -> DataFrame:
    """Pairs (x, key) of keys of different components that may reach ``similarity`` and whose first shared bucket is this one.

    One of each such pair is a minor member, so minor members are held against their bucket; the largest component is
    never held against itself. A pair belongs to the slot of its minor member, or of the lesser if both are minor.
    """
    now = _placed(units, found)
    slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS))
    ask = now.where(F.col("minor") & (slot >= low) & (slot < high))
    ask = ask.select("band", "value", F.col("key").alias("x"), F.col("component").alias("cx"), F.col("bands").alias("bx"))
    apart = (F.col("cx") != F.col("component")) & (~F.col("minor") | (F.col("x") < F.col("key")))
    near = ask.join(now, ["band", "value"]).where(apart & close("bx", "bands", least))
    first = F.array_position(F.zip_with(F.slice("bx", 1, ALL), F.slice("bands", 1, ALL), lambda p, q: p == q), True)
    differ = F.least(differing("bx", "bands") / (BANDS * ROWS), differing("bx", "bands", ALL + SKETCH, EQUAL_LONGS) / BINS)
    return near.where(first == F.col("band") + 1).where(within_reach("bx", "bands", similarity)).select("x", "key", differ.alias("differ"))


def nearest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (x, key), the one with the closest sketches for each x."""
    return pairs.groupBy("x").agg(F.min(F.struct("differ", "key"))["key"].alias("key"))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "key").alias("a"), F.greatest("x", "key").alias("b"))


def slots(work: int, texts: int) -> list[int]:
    """Ascending borders of the ranges of slots that are compared between two merges."""
    parts = -(-work // max(WORK, WORK_PER_TEXT * texts))
    return sorted({SLOTS * i // max(1, parts) for i in range(parts + 1)})


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): per row with words (id, key); per distinct text (key, class_id). ``docs`` has doc_id (long) and text."""
    null_id = -(1 << 63)
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(null_id)).alias("id"), text_key(F.col("text")).alias("key"), "text")
    idf = inverse_frequencies(slim)
    signed = cut(sign(slim, idf))
    texts = cut(signed.groupBy("key").agg(F.min("id").alias("id"), F.min(F.when(F.col("id") != null_id, F.col("id"))).alias("least"), F.first("bands").alias("bands")))
    entries = texts.select("key", F.posexplode(F.slice("bands", 1, ALL)).alias("band", "value"))
    shared = entries.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("key").alias("hub")).where("n > 1")
    shared = cut(shared.select("band", "value", "hub"))
    members = cut(entries.join(shared, ["band", "value"]).select("band", "value", "hub", "key"))
    pairs = cut(members.where("hub <> key").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct())
    nodes = cut(members.select("key").distinct().join(texts.select("key", "id", "bands"), "key"))
    n_nodes = nodes.count()
    pool = cut(slim.join(small_side(nodes.select("key", "id"), n_nodes, 64), ["id", "key"]).select("key", "text").dropDuplicates(["key"]))
    bands_of = lambda k: nodes.select(F.col("key").alias(k), F.col("bands").alias(f"bands_{k}"))
    first = pairs.join(bands_of("a"), "a").join(bands_of("b"), "b").where(close("bands_a", "bands_b")).where(within_reach("bands_a", "bands_b", similarity)).select("a", "b")
    found = components(verified(first, pool, idf, similarity))
    units = cut(_open(members, found).join(nodes.select("key", "bands"), "key"))
    per_bucket = units.groupBy("band", "value").agg(F.sum(F.col("minor").cast("long")).alias("m"), F.count("*").alias("n"))
    borders = slots(per_bucket.agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0, n_nodes)

    def joined(found: DataFrame, more: DataFrame) -> DataFrame:
        new = verified(ends(more).join(pairs, ["a", "b"], "left_anti"), pool, idf, similarity)
        return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new))

    if len(borders) > 1:
        found = joined(found, nearest(across(units, found, similarity, least=NEAREST)))
    for low, high in zip(borders, borders[1:]):
        found = joined(found, across(units, found, similarity, low, high))
    placed = texts.select("key", "least").join(found.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    best = cut(placed.groupBy("component").agg(F.min("least").alias("class_id")))
    groups = cut(placed.join(best, "component").select("key", "class_id"))
    return signed.select("id", "key"), groups


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, kept (the class's document with the least id)."""
    null_id = -(1 << 63)
    rows, groups = classes(docs, similarity)
    linked = rows.join(groups, "key").select(F.when(F.col("id") != null_id, F.col("id")).alias("doc_id"), "class_id")
    blank = F.coalesce(F.length(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", "")) == 0, F.lit(True))
    rest = docs.where(blank).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("class_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class left, its columns unchanged; documents without words all stay. Of rows that are equal
    in doc_id and text the one stays whose JSON text is least."""
    cols, null_id = docs.columns, -(1 << 63)
    rows, groups = classes(docs, similarity)
    counted = rows.groupBy("id", "key").agg(F.count("*").alias("n"))
    judged = cut(counted.join(groups, "key").select(F.col("id").alias("_pw_id"), F.col("key").alias("_pw_key"), "n", (F.coalesce(F.col("class_id"), F.lit(null_id)) == F.col("id")).alias("best")))
    losers = judged.where("not best").select("_pw_id", "_pw_key")
    repeated = judged.where("n > 1 and best").select("_pw_id", "_pw_key")
    held = docs.withColumn("_pw_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(null_id))).withColumn("_pw_key", text_key(docs["text"]))
    held = held.join(small_side(losers, losers.count(), 64), ["_pw_id", "_pw_key"], "left_anti")
    if not (again := repeated.count()):
        return held.select(*cols)
    twice, row = small_side(repeated, again, 64), F.struct(*[docs[c] for c in cols])
    one = held.join(twice, ["_pw_id", "_pw_key"], "left_semi").groupBy("_pw_id", "_pw_key").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return held.join(twice, ["_pw_id", "_pw_key"], "left_anti").select(*cols).unionByName(one)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, class_id (least doc_id of its class), kept (whether it is that document)."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
