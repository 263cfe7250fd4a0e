"""Quality classifier: a regularised quadratic discriminant over transformed statistics of the whole text.

Fit: the labelled training rows' statistics are summed per class (count, sums, products) on the executors; only
those sums, two small matrices, reach the driver. Each class covariance is shrunk towards a scaled identity and
factored once (Cholesky). Score: the logistic of the difference of the classes' log densities (Mahalanobis
distances by the cached factors) plus the log ratio of the classes' sizes.

Defined results: a null or empty text has the statistics of the empty string and a score as any other; rows whose
label or doc_id is null teach nothing; repeated labels count as often as they stand; without rows of both classes
every score is the share of label 1 among the training rows (0.5 without any); an empty table gives no rows; other
columns are ignored (by the stage: passed on).
"""

from __future__ import annotations

import operator
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, held_out, release, small_side, table

THRESHOLD, SHRINKAGE = 0.3, 0.05
#: The fit takes about this many labelled rows (by hash of the id), or all of them if there are fewer.
FIT_ROWS = 20_000
_kinds = np.empty(0, "uint8")


def kinds() -> np.ndarray:
    """For each code point of the basic plane: 0 other, 1 lower or caseless letter, 2 upper, 3 digit, 4 space, 5 full stop or comma, 6 line end."""
    global _kinds
    if not len(_kinds):
        major = {"Lu": 2, "Lt": 2, "Nd": 3, "Zs": 4}
        of = [major.get(c, 1 if c[0] == "L" else 0) for c in (unicodedata.category(chr(i)) for i in range(65536))]
        for c, k in ((" ", 4), ("\t", 4), (".", 5), (",", 5), ("\n", 6)):
            of[ord(c)] = k
        _kinds = np.array(of, "uint8")
    return _kinds


STATISTICS = ("word_length", "distinct_words", "repeated_neighbour", "upper", "digits", "symbols", "stops", "long_words", "distinct_lines", "compressed")
#: Characters, words and lines of ordinary prose that every text is taken to have besides its own, so that short texts stay near the middle.
PROSE_CHARS, PROSE_WORDS, PROSE_LINES = 200, 40, 5


def statistics(text: str | None) -> list[float]:
    """Of the whole text, transformed to be closer to normal: counts by logarithm, shares by square root."""
    text = text or ""
    words = text.split()
    n, raw = len(words), text.encode("utf-8", "replace")
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "uint32"), 65535)
    other, lower, upper, digit, _, stop, _ = np.bincount(kinds()[points], minlength=7)[:7].tolist()
    chars, slots = len(text) + PROSE_CHARS, n + PROSE_WORDS
    lines = [x for x in text.split("\n") if x]
    sizes = list(map(len, words))
    return [
        log((sum(sizes) + 5 * PROSE_WORDS) / slots),
        log((len(set(words)) + 0.8 * PROSE_WORDS) / slots),
        sqrt(sum(map(operator.eq, words, words[1:])) / slots),
        sqrt((upper + 0.02 * PROSE_CHARS) / (upper + lower + PROSE_CHARS)),
        sqrt(digit / chars),
        sqrt(other / chars),
        sqrt((stop + 0.02 * PROSE_CHARS) / chars),
        sqrt((sum(map((12).__lt__, sizes)) + 0.02 * PROSE_WORDS) / slots),
        log((len(set(lines)) + PROSE_LINES) / (len(lines) + PROSE_LINES)),
        log((len(zlib.compress(raw, 1)) + 0.5 * PROSE_CHARS) / (len(raw) + PROSE_CHARS)),
    ]


@dataclass(frozen=True)
class Discriminant:
    """What scoring needs: the scale of the statistics and, per class (0, 1), the mean, the inverse Cholesky factor and the constant."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    constant: np.ndarray
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.mean):
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        density = [self.constant[k] - 0.5 * (((z - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Discriminant:
    """From each class's count, sum vector and product matrix."""
    n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
    total, d = n[0] + n[1], len(STATISTICS)
    share = n[1] / total if total else 0.5
    if min(n.values()) < 2:
        empty = np.empty(0)
        return Discriminant(empty, empty, empty, empty, empty, share)
    centre = sum(sums[k][1] for k in (0, 1)) / total
    scale = np.sqrt(np.maximum(sum(np.diag(sums[k][2]) for k in (0, 1)) / total - centre**2, 1e-6))
    mean, factor, constant = [], [], []
    for k in (0, 1):
        m = sums[k][1] / n[k]
        cov = (sums[k][2] / n[k] - np.outer(m, m)) / np.outer(scale, scale)
        cov = (1 - shrinkage) * (cov + cov.T) / 2 + (shrinkage * max(np.trace(cov) / d, 1e-3) + 1e-6) * np.eye(d)
        low = np.linalg.cholesky(cov)
        mean.append((m - centre) / scale)
        factor.append(np.linalg.inv(low))
        constant.append(np.log(n[k] / total) - np.log(np.diag(low)).sum())
    return Discriminant(centre, scale, np.array(mean), np.array(factor), np.array(constant), share)


def statistics_column(text):
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.array(statistics(t)) for t in texts], dtype=object)
        release()

    return of(text)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Discriminant:
    """From labelled rows of ``docs`` that are not held out: about ``fit_rows`` of them, whose ids are broadcast."""
    wanted = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = wanted.count()
    drawn = cut(wanted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, fit_rows / max(1, n))))))
    known = docs.join(small_side(drawn, drawn.count(), 24), "doc_id").select("quality", statistics_column(F.col("text")).alias("x"))
    d = len(STATISTICS)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, rows in b.groupby("quality")["x"]:
                x = np.column_stack([np.ones(len(rows)), np.stack(list(rows))])
                got[int(k)] = got.get(int(k), 0) + x.T @ x
        for k, m in got.items():
            yield pd.DataFrame({"quality": k, "cell": np.arange(m.size), "v": m.ravel()})

    cells = known.mapInPandas(add, "quality int, cell int, v double").groupBy("quality", "cell").agg(F.sum("v").alias("v")).orderBy("quality", "cell").collect()
    sums = {}
    for k in (0, 1):
        m = np.array([r.v for r in cells if r.quality == k])
        if m.size:
            m = m.reshape(d + 1, d + 1)
            sums[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return discriminant(sums)


def score_column(model: Discriminant, text):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
            yield pd.Series(model.score(x))
        release()

    return score(text)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    model = fit(docs, labels)
    return docs.where(score_column(model, docs["text"]) >= threshold)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from 0.3 on)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
