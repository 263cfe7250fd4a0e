"""Packing token streams: concatenate and cut.

Pass one encodes every text once and writes ids with their offset inside the partition to shared storage. The
partition totals give each partition's global offset by a prefix sum (one row a partition). Pass two lays fixed
windows over the global stream; a document that crosses a window's end yields one boundary record for each side.
Every sequence but the last is full, so only the last one is padded.

Defined results: a null or empty text is the end id alone; a null doc_id passes through; repeated rows are packed
once each; an empty table gives no rows; very long texts are cut over many sequences; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, slices, small_side, table

CONTEXT, END_ID = 2048, 1
#: Words in each of a worker's two caches (about 200 bytes each, longer words aside). When the newer is full it becomes the older,
#: and the older goes, so frequent words stay known and memory stays bounded. Both are emptied at the end of a task.
CACHE = 1 << 17
_encoders: dict[str, Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """encode(text) -> ids as uint16 bytes: exactly those of ``tokenizers`` for the file, without special tokens added.

    Byte-level BPE never merges across a single space followed by anything, so a text without double spaces is
    encoded word by word from a cache; words that miss go through tiktoken over the same ranks. Texts that hold
    double spaces, or the string of a special token, are encoded whole (the latter by ``tokenizers``, loaded on demand).
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        self.path, self.words, self.before, self.whole = path, {}, {}, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_of_char()
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(chars[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u2").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if "  " in text:
            return self.plain(text)
        head, *rest = text.split(" ")
        out = [self.plain(head)]
        for word in rest:
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) >= CACHE:
                    self.words, self.before = {}, self.words
                ids = self.words[word] = self.before.get(word) or self.plain(" " + word)
            out.append(ids)
        return b"".join(out)


def encoder(path: str):
    """The ``encode`` of the worker's Encoder for the file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path].encode


def forget() -> None:
    """Empties the caches of the worker's encoders."""
    for e in _encoders.values():
        e.words, e.before = {}, {}


def token_table(docs: DataFrame, path: str, end_id: int = END_ID, place: tuple[str, str] | None = None) -> DataFrame:
    """Per document: part and first (which come in the stream's order), local_start, doc_tokens (end id included), ids as little-endian
    16-bit binary. A part is what one task reads; with ``place`` (a file's name and the row in it) it is a stretch of following rows of one file."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, at = encoder(path), 0
        part, first, row = f"{TaskContext.get().partitionId():012d}", 0, -1
        end = np.array([end_id], "<u2").tobytes()
        for b in slices(batches):
            ids = [(one(t) if t else b"") + end for t in b.column("text").to_pylist()]
            n = [len(x) // 2 for x in ids]
            names, rows = (b.column(c).to_pylist() for c in place) if place else ([part] * len(n), range(row + 1, row + 1 + len(n)))
            told = []
            for size, name, r in zip(n, names, rows, strict=True):
                if name != part or r != row + 1:
                    part, first, at = name, r, 0
                row = r
                told.append((part, first, at))
                at += size
            parts, firsts, starts = zip(*told, strict=True) if told else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(parts, pa.string()), pa.array(firsts, pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "part", "first", "local_start", "doc_tokens", "ids"])
        forget()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *(place or ())).mapInArrow(encode, f"doc_id {id_type}, part string, first bigint, local_start bigint, doc_tokens bigint, ids binary")


def pack(docs: DataFrame, path: str | None = None, context: int = CONTEXT, end_id: int = END_ID, place: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. The stream runs by partition and row; with ``place``
    (columns of a file's name and the row in it) by these, whatever tasks read the files."""
    tokens = cut(token_table(docs, path or vocabulary(), end_id, place))
    totals = cut(tokens.groupBy("part", "first").agg(F.max(F.col("local_start") + F.col("doc_tokens")).alias("n")))
    before = Window.partitionBy(F.lit(0)).orderBy("part", "first").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(small_side(bases, totals.count(), 256), ["part", "first"]).select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("local_start")).alias("at"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows, out = [], []
            for i, (n, ids, at) in enumerate(zip(b.column("doc_tokens").to_pylist(), b.column("ids").to_pylist(), b.column("at").to_pylist(), strict=True)):
                wide, start = np.frombuffer(ids, "<u2").astype("<u4"), 0
                while start < n:
                    where = at + start
                    length = min(n - start, context - where % context)
                    rows.append(i)
                    out.append((start, length, zlib.crc32(wide[start : start + length]), n, where // context, where % context))
                    start += length
            if rows:
                numbers = np.array(out, "int64").T
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), *map(pa.array, numbers)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(windows, f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every row of ``documents``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(table(spark, sf_dir, "documents"))
