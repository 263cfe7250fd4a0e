"""Mixing sources to target weights with a golden-ratio source schedule. Built-in column functions only.

Each source is one stream of words: its documents in an order shuffled by md5, laid end to end by two-pass
prefix sums (bucket totals, then positions within a bucket). A stream is cut into equal blocks. Slot k of the
schedule has the point frac(k * golden ratio); the cumulative target shares map it to a source, and its rank
among that source's slots is the block it takes; ranks past the end of a stream start its second round. What the
low-discrepancy schedule leaves open of a target (a few blocks) follows as tail slots; blocks past it are left out.
The order of the mix is that of the slots; within a block documents keep the stream's order.

Defined results: a null text has size 0; a null source is a source of its own, last in order; sizes of 0 take
nothing and have no slot; repeated rows are rows of their own (rows alike in id, source and size are summed before they are
placed, so a group of them is one row until the end); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table

#: The words of a text, the repeating weights, the budget and the cap as multiples of size.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, BUDGET, CAP = (5, 2, 1), 1.5, 2.0
#: 2**31 divided by the golden ratio, rounded to an odd number: multiples mod 2**31 are the golden-ratio points.
POINTS, STEP = 1 << 31, 1327217885
#: Cells of the unit interval in which points meet the sources' intervals, and slots that are ranked together.
CELLS, CHUNK, BLOCK = 4096, 4096, 1024
SEED = "mix-1:"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column) -> Column:
    return F.md5(F.encode(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))), "utf-8"))


def targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, cap=CAP) -> DataFrame:
    """Per source: src (rank by code point, null last), source_size, target, goal (whole words). One row a source.

    The excess over the caps is reshared by weight until none is above; that level is the highest one reached when
    the sources are capped one after another by rising cap per weight.
    """
    every = Window.partitionBy(F.lit(0))
    by_ratio = every.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("src", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("top", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("top") / F.col("w"))
    left = F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("top").over(by_ratio), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0))))
    s = s.withColumn("target", F.least("top", F.max("level").over(every) * F.col("w")))
    return s.select("source", "src", "source_size", "target", F.round("target").cast("long").alias("goal"))


def place(docs: DataFrame, sources: DataFrame, bucket_rows: int = 2048) -> tuple[DataFrame, DataFrame]:
    """``docs`` (with source, size, key, n rows alike) plus src, bucket, source_size, target, goal and ``start``: words of its source
    before it; and the buckets (src, bucket, base: words before it, own: its words)."""
    rows = docs.count()
    buckets = max(1, -(-rows // bucket_rows))
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long")
    known = sources.withColumnRenamed("source", "_source")
    docs = docs.join(known, docs["source"].eqNullSafe(known["_source"])).drop("_source").withColumn("bucket", at)
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    words = F.sum(F.col("size") * F.col("n"))
    sums = docs.groupBy("src", "bucket").agg(words.alias("own")).withColumn("base", F.coalesce(F.sum("own").over(before), F.lit(0)))
    inside = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = docs.withColumn("run", F.coalesce(words.over(inside), F.lit(0)))
    sums = cut(sums)
    return run.join(sums.drop("own"), ["src", "bucket"]).withColumn("start", F.col("base") + F.col("run")).drop("base", "run"), sums


def schedule(spark: SparkSession, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots: k (position in the mix), src, rank (block of the source's stream).

    Points and the sources' intervals of the cumulative weights meet on ``CELLS`` cells, so neither side is compared whole.
    """
    upto = F.sum("target").over(Window.partitionBy(F.lit(0)).orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("target").over(Window.partitionBy(F.lit(0)))
    spans = sources.where("goal > 0").select("src", "target", "goal", upto.alias("upto"), total.alias("total"))
    last = F.lead("src").over(Window.partitionBy(F.lit(0)).orderBy("src")).isNull()
    from_ = F.lag("upto", 1, 0.0).over(Window.partitionBy(F.lit(0)).orderBy("src")) / F.col("total")
    spans = spans.select("src", from_.alias("low"), F.when(last, 1.0).otherwise(F.col("upto") / F.col("total")).alias("high"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    n = -(-(sources.agg(F.sum("goal")).first()[0] or 0) // block)
    u = (F.col("id") % POINTS * STEP) % POINTS / F.lit(float(POINTS))
    points = spark.range(n).withColumn("u", u).withColumn("cell", F.floor(F.col("u") * CELLS)).withColumn("chunk", F.floor(F.col("id") / CHUNK))
    slots = points.join(spans, "cell").where((F.col("low") <= F.col("u")) & (F.col("u") < F.col("high"))).select("id", "chunk", "src")
    counts = slots.groupBy("chunk", "src").count()
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("chunk", "src", "base")
    within = F.row_number().over(Window.partitionBy("chunk", "src").orderBy("id")) - 1
    ranked = slots.withColumn("within", within).join(base, ["chunk", "src"]).select(F.col("id").alias("k"), "src", (F.col("base") + F.col("within")).alias("rank"))
    goals = sources.select("src", "goal", F.ceil(F.col("goal") / block).alias("blocks"))
    open_ = goals.join(counts.groupBy("src").agg(F.sum("count").alias("given")), "src", "left").select("src", "blocks", F.coalesce("given", F.lit(0)).alias("given")).where("given < blocks")
    tail = open_.select("src", F.explode(F.expr("sequence(given, blocks - 1)")).alias("rank")).select((F.lit(n) + F.col("rank")).alias("k"), "src", "rank")
    kept = ranked.join(goals.select("src", "blocks"), "src").where("rank < blocks").drop("blocks").select("k", "src", "rank")
    return kept.unionByName(tail)


def mix(docs: DataFrame, block: int = BLOCK, **rule) -> DataFrame:
    """Per document (doc_id, text, source): doc_id, source, size, source_size, target, start, taken (words the mix takes), and
    first_slot and last_slot (slots of the schedule whose blocks hold its words; -1 if none is taken)."""
    spark = docs.sparkSession
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    sizes = cut(sizes.withColumn("key", order_key(F.col("doc_id"))))
    sources = cut(targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), **rule))
    placed = place(sizes, sources)[0].withColumn("i", F.explode(F.expr("sequence(0L, n - 1)"))).withColumn("start", F.col("start") + F.col("i") * F.col("size"))
    slots = schedule(spark, sources, block)
    span = placed.where("size > 0").withColumn("round", F.explode(F.array(F.lit(0), F.lit(1))))
    span = span.withColumn("a", F.col("start") + F.col("round") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("goal")))
    blocks = F.when(F.col("a") < F.col("b"), F.expr(f"sequence(a div {block}, (b - 1) div {block})"))
    pieces = span.withColumn("rank", F.explode_outer(blocks))
    taken = F.when(F.col("k").isNotNull(), F.least("b", (F.col("rank") + 1) * block) - F.greatest("a", F.col("rank") * block)).otherwise(0)
    keys = ["doc_id", "source", "size", "source_size", "target", "src", "start", "key"]
    hit = pieces.join(slots, ["src", "rank"], "left").groupBy(*keys).agg(F.sum(taken).cast("long").alias("taken"), F.coalesce(F.min("k"), F.lit(-1)).alias("first_slot"), F.coalesce(F.max("k"), F.lit(-1)).alias("last_slot"))
    empty = F.lit(-1).cast("long")
    none = placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), empty.alias("first_slot"), empty.alias("last_slot"))
    return hit.unionByName(none).drop("key", "src")


def repeat_documents(docs: DataFrame, block: int = BLOCK, **rule) -> DataFrame:
    """The mix as rows, in its order: a document stands at the slot of the block that holds its first word, once a round, and is
    emitted whole if that word lies before its source's target (so a source misses its target by less than a document). Documents
    without words are kept once, at the start. Partitions follow one another by slot. Columns of ``docs``.

    The stream's order is drawn by id and text, so only rows alike in both stand together in it."""
    cols = docs.columns
    key = F.md5(F.encode(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.encode("text", "utf-8")), F.lit(""))), "utf-8"))
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    sources = cut(targets(slim, **rule))
    packed = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), F.lit(1).alias("n"), F.struct(*[docs[c] for c in cols]).alias("row"))
    placed, buckets = place(packed, sources)
    # A bucket's words are consecutive, and so are the blocks that hold them: each round's slots are one array, which joins rows where
    # they lie, so that texts are not dealt out again.
    spans = buckets.join(sources.select("src", "source_size", "goal"), "src").withColumn("round", F.explode(F.array(F.lit(0), F.lit(1))))
    spans = spans.withColumn("a", F.col("base") + F.col("round") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("own"), F.col("goal"))).where("a < b")
    ranks = spans.withColumn("rank", F.explode(F.expr(f"sequence(a div {block}, (b - 1) div {block})"))).join(schedule(docs.sparkSession, sources, block), ["src", "rank"])
    rounds = ranks.groupBy("src", "bucket", "round").agg(F.min("rank").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "k"))), lambda x: x["k"]).alias("ks"))
    slots = cut(rounds.groupBy("src", "bucket").agg(F.map_from_entries(F.collect_list(F.struct("round", F.struct("first", "ks")))).alias("slots")))
    starts = F.when(F.col("size") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    at = placed.join(slots, ["src", "bucket"], "left").withColumn("round", F.explode(starts)).withColumn("a", F.col("start") + F.col("round") * F.col("source_size"))
    here = F.col("slots")[F.col("round")]
    k = F.when(F.col("size") == 0, F.lit(-1)).otherwise(F.get(here["ks"], (F.expr(f"a div {block}") - here["first"]).cast("int")))
    kept = at.where((F.col("size") == 0) | (F.col("a") < F.col("goal"))).select(k.alias("k"), "src", "a", "key", "row")
    return kept.repartitionByRange("k", "key").sortWithinPartitions("k", "src", "a", "key").select("row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, size, source_size, target and taken of the mix, first_slot and last_slot of the schedule (-1: none)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


#: The same numbers by plain arithmetic: whole rounds of a stream plus what of the next round lies before the goal; the slots by
#: the points one by one.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
lv AS (SELECT max((1.5::DOUBLE * (SELECT sum(ss) FROM w) - coalesce(c, 0)) / ((SELECT sum(w) FROM w) - coalesce(cw, 0))) AS lv FROM
  (SELECT sum(2.0::DOUBLE * ss) OVER o AS c, sum(w) OVER o AS cw FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * ss / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
t AS (SELECT source, ss, least(2.0::DOUBLE * ss, lv * w) AS target, round(least(2.0::DOUBLE * ss, lv * w))::BIGINT AS goal FROM w, lv),
p AS (SELECT d.*, t.ss, t.target, t.goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT (sum(goal) + 1023)::BIGINT // 1024 AS n FROM t),
cum AS (SELECT source, goal, (goal + 1023) // 1024 AS blocks, lag(upto, 1, 0.0) OVER o / total AS low, CASE WHEN lead(source_no) OVER o IS NULL THEN 1.0::DOUBLE ELSE upto / total END AS high
  FROM (SELECT source, goal, row_number() OVER (ORDER BY source NULLS LAST) AS source_no, sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto, sum(target) OVER () AS total FROM t WHERE goal > 0) WINDOW o AS (ORDER BY source_no)),
pts AS (SELECT k, ((k % 2147483648) * 1327217885 % 2147483648) / 2147483648.0::DOUBLE AS u FROM (SELECT unnest(range(n)) AS k FROM n)),
given AS (SELECT source, blocks, k, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS rank FROM pts JOIN cum ON low <= u AND u < high),
slots AS (SELECT source, rank, k FROM given WHERE rank < blocks UNION ALL
  SELECT source, rank, n + rank FROM (SELECT source, unnest(range(g, blocks)) AS rank FROM (SELECT cum.source, cum.blocks, count(k) AS g FROM cum LEFT JOIN given ON cum.source IS NOT DISTINCT FROM given.source GROUP BY ALL)), n),
pieces AS (SELECT doc_id, size, source, st, unnest(range(a // 1024, (b - 1) // 1024 + 1)) AS rank FROM
  (SELECT *, st + r * ss AS a, least(st + r * ss + size, goal) AS b FROM p, (VALUES (0), (1)) v(r) WHERE size > 0) WHERE a < b),
seen AS (SELECT doc_id, size, pieces.source, st, min(k) AS first_slot, max(k) AS last_slot FROM pieces JOIN slots ON pieces.rank = slots.rank AND pieces.source IS NOT DISTINCT FROM slots.source GROUP BY ALL)
SELECT p.doc_id, p.size, ss AS source_size, target,
  (CASE WHEN ss = 0 THEN 0 ELSE p.size * (goal // ss) + greatest(0, least(p.size, goal - ss * (goal // ss) - p.st)) END)::BIGINT AS taken, coalesce(first_slot, -1)::BIGINT AS first_slot, coalesce(last_slot, -1)::BIGINT AS last_slot
FROM p LEFT JOIN seen ON p.doc_id IS NOT DISTINCT FROM seen.doc_id AND p.source IS NOT DISTINCT FROM seen.source AND p.st = seen.st AND p.size = seen.size
"""
