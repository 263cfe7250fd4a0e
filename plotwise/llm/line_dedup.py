"""Line dedup: documents probe a sharded minimal perfect hash of the lines that many documents share.

A line's key is the line without white space at its ends, A-Z lower-cased; its hash has 128 bits. Tasks count the documents of
each key among their own first, so a common line is a few rows before anything is dealt out. The distinct hashes with their counts are
dealt to shards by hash, about ``SHARD`` to each. A shard's task builds a minimal perfect hash over its lines of at least ``least`` documents:
level by level every open key draws a place, keys alone at theirs stay (a bit is set), the others go on; a key's number is the count of
bits before its own. Two arrays run by that number: ``FINGER`` bits of the hash as a fingerprint, and the documents (up to 255, or 32 bits for
larger thresholds). That is about 3.5 bytes a shared line. Rarer lines have no number but may draw a set bit and meet
an equal fingerprint; the task has them at hand, tries them all and lists those few whole, as exceptions. So an answer is exact for every
line that was counted, as far as 128 bits tell keys apart.

Documents are read again and probe: their lines' hashes are sorted by shard, each shard answers in bulk. The index goes to all tasks if
its measured bytes are at most ``INDEX_BYTES``. A larger one stays where it is: the hashes of every distinct text's lines travel to the
shards, a row for each text and shard, meet the shard's arrays in one sorted stream and come back as the few that are shared.

Defined results: a null or empty text is one empty line; empty keys are never dropped; each row is a document, so repeated rows count
each; a document counts once for a key however often it has it; very long texts are read whole; an empty table gives no rows; columns of
any name stay, but ``n_lines``, ``n_dropped`` and ``kept_text``, which are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import cut, slices, table

DOCUMENTS = 10
#: Distinct lines a shard, keys that a task counts before it hands them on, bytes of an index that is sent to every task.
SHARD, HELD, INDEX_BYTES = 1 << 16, 1 << 18, 64 << 20
#: Places a key at each level, and levels: after these the keys left over are exceptions.
ROOM, LEVELS, FINGER = 2.0, 32, 16
#: Fixed value: the white space that a key loses at its ends.
WHITE = b" \t\n\x0b\x0c\r"
U64 = np.uint64


def keys_of(text: bytes | None) -> list[bytes]:
    return [k.strip(WHITE) for k in (text or b"").lower().split(b"\n")]


def hashes_of(keys: list[bytes]) -> np.ndarray:
    """(keys, 2): the 128 bits of each key as two longs."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return ((high >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


class Shard:
    """The minimal perfect hash of one shard with its arrays."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, fingers: np.ndarray, counts: np.ndarray, rare: np.ndarray):
        self.sizes, self.bits, self.fingers, self.counts = sizes, bits, fingers, counts
        self.bases = np.cumsum(sizes) - sizes
        self.before = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
        self.rare = {(int(a), int(b)): int(n) for a, b, n in rare.reshape(-1, 3)}

    @staticmethod
    def place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(low ^ (high * U64(2 * level + 1))) >> U64(32)) * U64(size) >> U64(32)

    @staticmethod
    def finger(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return (mixed(low * U64(0x9E3779B97F4A7C15) ^ high) >> U64(64 - FINGER)).astype(np.uint16)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, n: np.ndarray, least: int) -> Shard:
        """The shard of distinct hashes and their documents; those of fewer than ``least`` only make exceptions where they would be mistaken."""
        own = np.flatnonzero(n >= least)
        left, sizes, words = own, [], []
        while len(left) and len(sizes) < LEVELS:
            size = int(len(left) * ROOM / 64 + 1) * 64
            at = cls.place(high[left], low[left], len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(U64))
            sizes.append(size)
            left = left[~alone[at]]
        bits = np.concatenate(words) if words else np.zeros(0, U64)
        made = cls(np.array(sizes, np.int64), bits, np.zeros(0, np.uint16), np.zeros(0, np.uint8), np.zeros(0, U64))
        held = np.setdiff1d(own, left)
        number = made.number(high[held], low[held])
        made.fingers = np.empty(len(held), np.uint16)
        made.counts = np.empty(len(held), np.uint8 if least <= 255 else np.uint32)
        made.fingers[number] = cls.finger(high[held], low[held])
        made.counts[number] = np.minimum(n[held], np.iinfo(made.counts.dtype).max)
        wrong = np.flatnonzero((n < least) & (made.probe(high, low) >= least))
        made.rare = {(int(high[i]), int(low[i])): int(n[i]) for i in (*left, *wrong)}
        return made

    def number(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 where no level has a bit for one."""
        out, open_ = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, (size, base) in enumerate(zip(self.sizes.tolist(), self.bases.tolist(), strict=True)):
            if not len(open_):
                break
            at = base + self.place(high[open_], low[open_], level, size).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(U64)
            found = (word >> bit & U64(1)).astype(bool)
            rank = self.before[at[found] >> 6] + np.bitwise_count(word[found] & ((U64(1) << bit[found]) - U64(1)))
            out[open_[found]] = rank
            open_ = open_[~found]
        return out

    def probe(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The documents of each key by the arrays (a count at the top of its range may be more), 0 for what isn't there."""
        number = self.number(high, low)
        known = np.flatnonzero(number >= 0)
        known = known[self.fingers[number[known]] == self.finger(high[known], low[known])]
        out = np.zeros(len(high), np.int64)
        out[known] = self.counts[number[known]]
        for i in self.exceptions(high):
            out[i] = self.rare.get((int(high[i]), int(low[i])), out[i])
        return out

    def exceptions(self, high: np.ndarray) -> list[int]:
        """The places of keys that may be listed whole."""
        return np.flatnonzero(np.isin(high, np.array([a for a, _ in self.rare], U64))).tolist() if self.rare else []

    def parts(self) -> list[bytes]:
        rare = np.array([(a, b, n) for (a, b), n in self.rare.items()], U64)
        return [self.sizes.tobytes(), self.bits.tobytes(), self.fingers.tobytes(), bytes([self.counts.itemsize]) + self.counts.tobytes(), rare.tobytes()]

    @classmethod
    def read(cls, parts: list[bytes]) -> Shard:
        sizes, bits, fingers, counts, rare = parts
        return cls(np.frombuffer(sizes, np.int64), np.frombuffer(bits, U64), np.frombuffer(fingers, np.uint16), np.frombuffer(counts, np.uint8 if counts[0] == 1 else np.uint32, offset=1), np.frombuffer(rare, U64))


PARTS = "sizes binary, bits binary, fingers binary, counts binary, rare binary"
FIELDS = ("sizes", "bits", "fingers", "counts", "rare")


def line_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(high, low, n): the hash of every distinct key that is not empty, and the documents that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def drained() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
            made = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(list(seen.values()), pa.int64())], ["high", "low", "n"])
            seen.clear()
            return made

        for b in slices(batches):
            for t in b.column(text).cast(pa.binary()).to_pylist():
                keys = set(keys_of(t))
                keys.discard(b"")
                seen.update(map(xxhash.xxh3_128_digest, keys))
                if len(seen) >= HELD:
                    yield drained()
        if seen:
            yield drained()

    return docs.select(text).mapInArrow(count, "high bigint, low bigint, n bigint").groupBy("high", "low").agg(F.sum("n").alias("n"))


def line_index(docs: DataFrame, text: str = "text", least: int = DOCUMENTS) -> tuple[DataFrame, int]:
    """(shard and its arrays, one row a shard; number of shards) over the lines of ``docs`` that ``least`` documents share."""
    counted = cut(line_counts(docs, text))
    shards = max(1, -(-counted.count() // SHARD))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(b.column("high").to_numpy().view(U64), shards)), *b.columns], ["shard", *b.schema.names])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = Shard.build(pdf["high"].to_numpy().view(U64), pdf["low"].to_numpy().view(U64), pdf["n"].to_numpy(), least)
        return pd.DataFrame([[pdf["shard"].iloc[0], *made.parts()]], columns=["shard", *FIELDS])

    dealt = counted.mapInArrow(shard, "shard bigint, high bigint, low bigint, n bigint")
    return cut(dealt.groupBy("shard").applyInPandas(build, f"shard bigint, {PARTS}")), shards


def shared(h: np.ndarray, shards: int, of: Callable[[int], Shard | None], least: int) -> np.ndarray:
    """Which of the hashes ``least`` documents have. They are asked shard by shard."""
    out = np.zeros(len(h), bool)
    if not len(h):
        return out
    at = shard_of(h[:, 0], shards)
    order = np.argsort(at, kind="stable")
    names, starts = np.unique(at[order], return_index=True)
    for name, rows in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
        index = of(name)
        if index is not None:
            out[rows] = index.probe(h[rows, 0], h[rows, 1]) >= least
    return out


def kept_lines(text: bytes | None, drops: np.ndarray) -> bytes:
    return b"\n".join([line for line, gone in zip((text or b"").split(b"\n"), drops.tolist(), strict=True) if not gone])


def probed(docs: DataFrame, text: str, keep: list[str], answer: Callable[[pa.RecordBatch, list[list[bytes]]], np.ndarray]) -> DataFrame:
    """The columns ``keep`` with n_lines, n_dropped and kept_text; ``answer`` says of all lines of a slice which go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(text).cast(pa.binary()).to_pylist()
            keys = [keys_of(t) for t in texts]
            drops = answer(b, keys)
            n = np.array([len(k) for k in keys], np.int64)
            ends = np.cumsum(n)
            each = np.split(drops, ends[:-1]) if len(keys) else []
            left = [kept_lines(t, d) if d.any() else t or b"" for t, d in zip(texts, each, strict=True)]
            gone = pa.array([int(d.sum()) for d in each], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n), gone, pa.array(left, pa.binary()).cast(pa.string())], [*keep, "n_lines", "n_dropped", "kept_text"])

    fields = [docs.schema[c] for c in keep]
    return docs.mapInArrow(run, StructType([*fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_text", StringType())]))


def flat(keys: list[list[bytes]]) -> list[bytes]:
    return [k for ks in keys for k in ks]


def probe_near(docs: DataFrame, text: str, keep: list[str], index: DataFrame, shards: int, least: int) -> DataFrame:
    """Every task has the whole index (measured by the caller)."""
    held = docs.sparkSession.sparkContext.broadcast({r.shard: [bytes(r[f]) for f in FIELDS] for r in index.collect()})
    made: dict[int, Shard] = {}

    def of(name: int) -> Shard | None:
        if name not in made and name in held.value:
            made[name] = Shard.read(held.value[name])
        return made.get(name)

    def answer(_: pa.RecordBatch, keys: list[list[bytes]]) -> np.ndarray:
        all_ = flat(keys)
        return shared(hashes_of(all_), shards, of, least) & np.fromiter(map(len, all_), np.int64, len(all_)).astype(bool)

    return probed(docs.select(*dict.fromkeys([*keep, text])), text, keep, answer)


def probe_far(docs: DataFrame, text: str, keep: list[str], index: DataFrame, shards: int, least: int) -> DataFrame:
    """Each shard's arrays stay in one place: the hashes of every distinct text's lines travel there, a row for each text and shard."""
    name = F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 256))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows: list[tuple[int, int, bytes]] = []
            for i, t in enumerate(b.column("_text").cast(pa.binary()).to_pylist()):
                keys = set(keys_of(t))
                keys.discard(b"")
                if not keys:
                    continue
                h = hashes_of(list(keys))
                at = shard_of(h[:, 0], shards)
                order = np.argsort(at, kind="stable")
                names, starts = np.unique(at[order], return_index=True)
                rows += [(i, s, h[part].tobytes()) for s, part in zip(names.tolist(), np.split(order, starts[1:]), strict=True)]
            if rows:
                which, to, sent = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("_name").take(pa.array(which)), pa.array(to, pa.int64()), pa.array(sent, pa.binary())], ["_name", "shard", "asked"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        for b in slices(batches):
            names, found = [], []
            for r in b.to_pylist():
                if r["_name"] is None:
                    at, index = r["shard"], Shard.read([r[f] for f in FIELDS])
                elif r["shard"] == at:
                    h = np.frombuffer(r["asked"], U64).reshape(-1, 2)
                    hit = h[index.probe(h[:, 0], h[:, 1]) >= least]
                    if len(hit):
                        names.append(r["_name"])
                        found.append(hit.tobytes())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.binary())], ["_name", "found"])

    distinct = docs.select(name.alias("_name"), F.col(text).alias("_text"))
    asked = distinct.mapInArrow(ask, "_name binary, shard bigint, asked binary").groupBy("_name", "shard").agg(F.first("asked").alias("asked"))
    both = index.unionByName(asked, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("_name").asc_nulls_first())
    answers = cut(both.mapInArrow(meet, "_name binary, found binary").groupBy("_name").agg(F.collect_list("found").alias("_found")))
    given = docs.select(*dict.fromkeys([*keep, text])).withColumn("_name", name).join(answers, "_name", "left")

    def answer(b: pa.RecordBatch, keys: list[list[bytes]]) -> np.ndarray:
        out: list[bool] = []
        for found, ks in zip(b.column("_found").to_pylist(), keys, strict=True):
            whole = b"".join(found or ())
            hit = {whole[i : i + 16] for i in range(0, len(whole), 16)}
            out += [k != b"" and xxhash.xxh3_128_digest(k) in hit for k in ks] if hit else [False] * len(ks)
        return np.array(out, bool)

    return probed(given, text, keep, answer)


def drop_shared_lines(docs: DataFrame, text: str = "text", least: int = DOCUMENTS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep`` if given) with n_lines, n_dropped and kept_text: the text without the lines whose key ``least`` documents have."""
    stay = [c for c in (docs.columns if keep is None else keep) if c not in ("n_lines", "n_dropped", "kept_text")]
    index, shards = line_index(docs, text, least)
    size = index.agg(F.sum(sum((F.octet_length(f) for f in FIELDS), F.lit(0)))).first()[0] or 0
    return (probe_near if size <= INDEX_BYTES else probe_far)(docs, text, stay, index, shards, least)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, n_lines, n_dropped (lines whose key ten documents have), kept_sha256 of the rest."""
    found = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


#: Lines joined by their keys.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, (count(*) FILTER (c.key IS NOT NULL))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY r, doc_id
"""
