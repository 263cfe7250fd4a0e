"""Media columns: interleaved document sequences.

HTML is parsed to an ordered array of text and media-reference structs; media are stored once encoded, keyed by the
digest of their payload; a join on the digest resolves the references, and the sequence is put together again in its
order, captions beside their media.

The query makes a page of every document: its lines are paragraphs, a figure after the first of them refers to the payload by digest and is
captioned with the number of bytes, and behind the last come the payload again and a medium that is not stored. Positions, captions and the
size of the texts around them come from the parsed sequence, the payload's figures from the join.

Storage of a payload: bytes are grey samples of 8 bits, 24 to a row and 24 rows (576 bytes) to a tile, as a binary
portable graymap (P5). Features are computed from the samples read back: tiles, mean, deviation, an eight-bin
histogram and the 64-bit mean hash of the first tile.

Defined results: a null text is empty; the empty payload is one tile of 255; equal texts give equal values; repeated
rows are rows of their own; references without media resolve to nulls and keep their place; an empty table gives no
rows; very long texts are stored whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, slices, table

SIDE, TILE, FILL = 24, 576, b"\xff"
SEQUENCE = "array<struct<position int, kind string, text string, ref string, caption string>>"
REF = "media:"
AGAIN, LOST = "the same again", "not stored"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with 255 to a positive multiple of 576, and their number before."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + FILL * (max(1, -(-len(raw) // TILE)) * TILE - len(raw)), len(raw)


def store(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (SIDE, len(payload) // SIDE) + payload


def load(media: bytes) -> bytes:
    m = re.match(rb"P5\s(\d+)\s(\d+)\s255\s", media)
    if not m or len(media) != m.end() + int(m[1]) * int(m[2]):
        raise ValueError("not a graymap of 8 bits")
    return media[m.end() :]


def feature(payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    cells = x[:TILE].reshape(8, 3, 8, 3).sum((1, 3)).ravel()
    bits = int("".join("01"[int(c)] for c in cells * 64 > cells.sum()), 2)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = float(counts @ values) / len(x)
    deviation = max(0.0, float(counts @ values**2) / len(x) - mean**2) ** 0.5
    return f"tiles={len(x) // TILE};mean={mean:.4f};std={deviation:.4f};hist={','.join(map(str, counts.reshape(8, 32).sum(1).tolist()))};hash={bits:016x}"


class _Sequence(HTMLParser):
    """Texts and media in document order; a figure's caption goes to its media."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.caption, self.figure, self.skip = [], [], None, None, 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("img", "audio", "video", "source"):
            self.flush()
            src, alt = dict(attrs).get("src"), dict(attrs).get("alt")
            if src:
                self.items.append(["media", None, src, alt])
        elif tag == "figure":
            self.flush()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "section", "article", "td", "br"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.items[self.figure or 0 :]:
                if item[0] == "media":
                    item[3] = text
            self.caption = None
        elif tag == "figure":
            self.figure = None
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "section", "article", "td"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[tuple]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [(i, *item) for i, item in enumerate(parser.items)]


def interleave(html: Column) -> Column:
    """The ordered array of structs of an HTML column."""

    @F.pandas_udf(SEQUENCE)
    def parse(pages: pd.Series) -> pd.Series:
        names = ("position", "kind", "text", "ref", "caption")
        return pd.Series([[dict(zip(names, x, strict=True)) for x in sequence_of(p)] for p in pages], dtype=object)

    return parse(html)


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digest, media): the stored form of every text, keyed by its payload's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [payload_of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p, _ in made], pa.string()), pa.array([store(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "digest", "media"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, digest string, media binary")


def features(stored: DataFrame) -> DataFrame:
    """One row per digest, computed from the stored bytes read back."""

    @F.pandas_udf("payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    def measure(media: pd.Series) -> pd.DataFrame:
        rows = []
        for m in media:
            p = load(m)
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    one = stored.select("digest", measure("media").alias("f"))
    return one.groupBy("digest").agg(F.first("f").alias("f")).select("digest", "f.*")


def resolve(sequences: DataFrame, media: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``items``: the sequence of each row (column ``items``) in its order, media references resolved by digest.
    ``media`` has ``digest`` and further columns, which become the struct ``media`` of each item (null for texts and the unknown).
    Keys may have any name but ``items``. Hot digests are left to Spark's skew join, which splits their rows."""
    own = F.struct(*[F.col(k) for k in keys])
    rows = sequences.select(F.monotonically_increasing_id().alias("_row"), own.alias("_own"), "items").select("_row", "_own", F.explode_outer("items").alias("_item"))
    rows = rows.withColumn("_digest", F.regexp_extract("_item.ref", f"^{REF}([0-9a-f]{{64}})$", 1))
    known = media.select(F.col("digest").alias("_digest"), F.struct(*[c for c in media.columns if c != "digest"]).alias("media"))
    item = F.struct("_item.position", "_item.kind", "_item.text", "_item.ref", "_item.caption", "media")
    together = rows.join(known, "_digest", "left").groupBy("_row").agg(F.first("_own").alias("_own"), F.sort_array(F.collect_list(F.when(F.col("_item").isNotNull(), item))).alias("items"))
    return together.select("_own.*", "items")


def page_of(text: Column) -> Column:
    """The document (not null) as a page: a paragraph a line, after the first the figure of its payload, at the end that payload and an unknown one."""
    n_bytes = F.octet_length(text)
    pad = F.greatest(F.lit(1), F.ceil(n_bytes / TILE)) * TILE - n_bytes
    digest = F.sha2(F.concat(F.encode(text, "utf-8"), F.unhex(F.repeat(F.lit(FILL.hex()), pad.cast("int")))), 256)
    plain = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    figure = F.concat(F.lit(f'<figure><img src="{REF}'), digest, F.lit('"><figcaption>'), n_bytes.cast("string"), F.lit(" bytes</figcaption></figure>"))
    image = lambda d, alt: F.concat(F.lit(f'<img src="{REF}'), d, F.lit(f'" alt="{alt}">'))
    behind = F.array(image(digest, AGAIN), image(F.sha2(F.encode(digest, "utf-8"), 256), LOST))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(figure), F.slice(lines, F.lit(2), F.size(lines)), behind), "")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then position and caption of the first medium, n_items, n_text (code points of the text items), n_media (that
    were resolved), n_unknown, and the positions and captions of all media in their order, joined by commas and bars."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    measured = cut(features(cut(media_table(docs)).select("digest", "media")))
    pages = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), interleave(page_of(F.col("text"))).alias("all"))
    sizes = F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.length(x["text"]), F.lit(0)))
    slim = pages.select("doc_id", "n_bytes", F.size("all").cast("long").alias("n_items"), sizes.alias("n_text"), F.filter("all", lambda x: x["kind"] == "media").alias("items"))
    whole = resolve(slim, measured, ["doc_id", "n_bytes", "n_items", "n_text"]).withColumn("m", F.col("items")[0])
    n_media = F.size(F.filter("items", lambda x: x["media"].isNotNull())).cast("long")
    joined = lambda f, by: F.array_join(F.transform("items", f), by)
    told = [n_media.alias("n_media"), (F.size("items") - n_media).cast("long").alias("n_unknown"), joined(lambda x: x["position"].cast("string"), ",").alias("positions"), joined(lambda x: x["caption"], "|").alias("captions")]
    return whole.select("doc_id", "n_bytes", "m.media.*", "m.position", "n_items", "n_text", "m.caption", *told)
