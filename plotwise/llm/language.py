"""Language identification by compression: the language whose raw-content dictionary compresses a text best.

Dictionaries: for each language a bounded sample of training texts (about ``SAMPLE_DOCS`` pieces of at most ``SAMPLE_CHARS`` characters, taken
by hash of the id and the piece's number, repeated rows once; those that fit into ``DICT_BYTES`` together, in that order), normalised like
the texts. A text is one piece, a longer one is cut into as many as it takes, so every text can be learnt from, however long. Prediction: the whole text
is normalised (lower case, letters only, one space between words) and encoded with every dictionary; the smallest
frame wins, ties go to the language with more training rows (then by code point). ``score`` is the winner's share of 2**(-bits); ``rejected``
marks narrow margins (under ``MARGIN`` of the smallest frame's bytes).

Defined results: a text that is null or has no letter is ``und`` with score 0; without any training row every text
is ``und``; rows with a null lang or doc_id teach nothing, and rows with null doc_id are not held out; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, release, table

#: Bounds of the sample that dictionaries are made of; the zstandard level; the margin.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, LEVEL, MARGIN = 300, 20_000, 110_000, 6, 0.01
LETTERS = re.compile(r"[^\W\d_]+")
SCHEMA = "lang_pred string, score double, rejected boolean"


def normalised(text: str | None) -> bytes:
    return " ".join(LETTERS.findall(text.lower())).encode("utf-8", "replace") if text else b""


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """lang -> dictionary, most training rows first. Counts per language come from all training rows; only the sampled pieces reach the
    driver, about ``2 * sample_docs`` of at most ``SAMPLE_CHARS`` characters a language."""
    train = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    last = F.greatest(F.lit(0), F.floor((F.coalesce(F.length("text"), F.lit(0)) - 1) / SAMPLE_CHARS)).cast("int")
    told = train.groupBy("lang").agg(F.count("*").alias("n"), F.sum(last + 1).alias("pieces")).collect()
    counts = {r.lang: r.n for r in told}
    if not counts:
        return {}
    cut_up = train.select("lang", "doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    mark = F.when(F.col("piece") == 0, F.xxhash64("doc_id")).otherwise(F.xxhash64("doc_id", "piece"))
    draw = F.pmod(mark, F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*[F.lit(x) for r in sorted(told, key=lambda r: r.lang) for x in (r.lang, min(1.0, 2.0 * sample_docs / r.pieces))]), F.col("lang"))
    taken = cut_up.where(draw < share).select("lang", "doc_id", F.substring("text", F.col("piece") * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS)).alias("text"), draw.alias("at"))
    rows = taken.distinct().collect()
    out = {}
    for lang in sorted(counts, key=lambda k: (-counts[k], k)):
        taken, size = [], 0
        for r in sorted((r for r in rows if r.lang == lang), key=lambda r: (r.at, r.doc_id, r.text or ""))[:sample_docs]:
            text = normalised(r.text)
            if text and size + len(text) < dict_bytes:
                taken.append(text)
                size += len(text) + 1
        if taken:
            out[lang] = b" ".join(taken)
    return out


def predict_column(dictionaries: dict[str, bytes], text, level: int = LEVEL, margin: float = MARGIN):
    langs = list(dictionaries)

    @F.pandas_udf(SCHEMA)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard as z

        made = []
        for lang in langs:
            d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append(z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        for texts in batches:
            out = []
            for t in texts:
                raw = normalised(t)
                if not raw or not made:
                    out.append(("und", 0.0, True))
                    continue
                sizes = np.array([len(c(raw)) for c in made], float)
                best = int(sizes.argmin())
                rest = np.delete(sizes, best)
                narrow = bool(len(rest)) and rest.min() - sizes[best] < margin * sizes[best]
                out.append((langs[best], float(1 / np.exp2(np.maximum(-1000, 8 * (sizes[best] - sizes))).sum()), narrow))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])
        release()

    return predict(text)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, held_out, lang_pred (``und`` without a letter), score, rejected (a narrow margin)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict_column(learn(docs), F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
