"""Audit of how filters interact: incidence matrices times histograms of failure masks.

Every document gets a mask, one bit for each of the five filters that it fails. Masks are counted by part, over all documents, over those of
good quality and over toxic ones: three rows of 32 numbers a part. Four integer matrices of 32 by 600 (a column for each of the 120
orders and its five steps) say for each mask whether its documents are kept, removed, found redundant or fail alone there. The
rows, stacked, times the matrices are all outcomes at once; no order is ever run over documents.

Copies: a document fails E if a smaller doc_id has the same text (by SHA-256), so of each digest only the rows of the least doc_id pass.
These meet the documents by (digest, doc_id), a key that no group of copies makes hot; the least ids and all counts are summed in
part before they are dealt out.

Defined results: a null text is the empty one; a null source is part ''; each row is a document, so repeated rows count each and fail
E only for a smaller doc_id; a null doc_id has no labels, and is neither a copy nor makes one; a document is good (toxic) if any of
its rows in labels says so; an empty table gives no rows; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import n_words
from .shared import cut, table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Fixed values of the filters: least words, least share of distinct words and most share of capitals in per cent, symbols.
WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
#: Parts whose outcomes are multiplied and handed on at once.
PARTS = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


def incidence() -> dict[str, np.ndarray]:
    """The matrices, 32 by 600: kept, removed, redundant and unique; columns run by order, then step."""
    fails = np.array([[mask >> f & 1 for f in range(len(FILTERS))] for mask in range(MASKS)], bool)
    place = np.array([[FILTERS.index(f) for f in o] for o in orders()])
    here = fails[:, place]
    before = np.cumsum(here, axis=2) - here
    made = {"kept": ~here & (before == 0), "removed": here & (before == 0), "redundant": here & (before > 0), "unique": here & (fails.sum(1) == 1)[:, None, None]}
    return {k: m.reshape(MASKS, -1).astype(np.int64) for k, m in made.items()}


def failures(text: Column) -> Column:
    """The mask of filters A to D over a text that is not null, A the lowest bit."""
    size = n_words(text)
    distinct = F.size(F.array_distinct(F.filter(F.split(text, SPACE), lambda w: w != "")))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (size < WORDS, 100 * distinct < DISTINCT * size, 100 * capitals > CAPITALS * F.char_length(text), text.rlike(SYMBOLS))
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents of each part by the filters they fail. ``docs`` has doc_id, text, source."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("digest"), failures(text).alias("plain"))
    entries = cut(slim.groupBy("digest", "doc_id", "part", "plain").agg(F.count("*").alias("n")))
    first = entries.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    told = entries.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << FILTERS.index("E")).otherwise(0)
    weigh = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return told.groupBy("part", (F.col("plain") + copy).alias("mask")).agg(F.sum("n").alias("docs"), weigh("good").alias("good"), weigh("toxic").alias("toxic"))


def outcomes(counted: DataFrame) -> DataFrame:
    """Per part, order and step the counts, from ``histograms``: at most 32 rows a part are one row, then a block of the product."""
    rows = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("h"))
    names = orders()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = incidence()
        wide = np.hstack([made[k] for k in ("kept", "removed", "redundant", "unique")])
        place = np.array([[FILTERS.index(f) for f in o] for o in names])
        columns = place.size
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS):
                b = whole.slice(at, PARTS)
                stack = np.zeros((b.num_rows, 3, MASKS), np.int64)
                for i, h in enumerate(b.column("h").to_pylist()):
                    for x in h:
                        stack[i, :, x["mask"]] = x["docs"], x["good"], x["toxic"]
                product = (stack.reshape(-1, MASKS) @ wide).reshape(b.num_rows, 3, 4, columns)
                kept, removed, redundant, unique = (product[:, 0, k] for k in range(4))
                by_order = removed.reshape(b.num_rows, *place.shape)
                summed = np.stack([np.where(place == f, by_order, 0).sum((1, 2)) for f in range(len(FILTERS))], 1)
                values = (kept, removed, redundant, unique, product[:, 1, 1], product[:, 2, 1], summed[:, place.ravel()])
                parts = pa.array(np.repeat(np.arange(b.num_rows), columns))
                tiled = lambda x: np.tile(x, b.num_rows)
                order, step = tiled(np.repeat(np.array(names, object), len(FILTERS))), tiled(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(names)))
                yield pa.RecordBatch.from_arrays([b.column("part").take(parts), pa.array(order, pa.string()), pa.array(step), *(pa.array(v.ravel()) for v in values)], ["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(multiply, f"part string, filter_order string, step int, {', '.join(f'{c} bigint' for c in COUNTS)}")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of ``documents``, order of the filters and step: the documents kept, removed, redundant, failing alone, lost labels, Shapley sums."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return outcomes(histograms(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


#: The filters document by document, then each order step by step.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(ws) < 200)::INT AS fa, (100 * len(list_distinct(ws)) < 50 * len(ws))::INT AS fb,
  (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT AS fc, regexp_matches(t, '[#$%&*|]')::INT AS fd, coalesce(w.doc_id > least, false)::INT AS fe FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e WHERE a.k <> b.k AND c.k NOT IN (a.k, b.k) AND d.k NOT IN (a.k, b.k, c.k) AND e.k NOT IN (a.k, b.k, c.k, d.k)),
g AS (SELECT part, fa, fb, fc, fd, fe, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
e AS (SELECT g.*, filter_order, step, CASE substr(filter_order, step, 1) WHEN 'A' THEN fa WHEN 'B' THEN fb WHEN 'C' THEN fc WHEN 'D' THEN fd ELSE fe END AS here, substr(filter_order, 1, step - 1) AS past
  FROM g, o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
r AS (SELECT *, fa * contains(past, 'A')::INT + fb * contains(past, 'B')::INT + fc * contains(past, 'C')::INT + fd * contains(past, 'D')::INT + fe * contains(past, 'E')::INT AS earlier FROM e),
q AS (SELECT part, filter_order, step, sum(CASE WHEN here + earlier = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here = 1 AND earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN here = 1 AND earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here = 1 AND fa + fb + fc + fd + fe = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN here = 1 AND earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN here = 1 AND earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY part, filter_order, step)
SELECT *, (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM q
"""
