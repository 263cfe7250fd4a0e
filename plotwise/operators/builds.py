"""Builds of the derived tables: replaced at once by an atomic write, or grown batch by batch under a manifest, with the counters that a
loader logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import lake, tables
from ..sources.shared import delete, numbered, small, written
from . import search

MANIFEST = "file string, length bigint, changed timestamp, gone boolean"


def is_built(spark: SparkSession, path: str) -> bool:
    """Whether a table is there and has a row."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def build_survey_index(parcels: DataFrame, to: str, rebuild: bool = False) -> DataFrame:
    """Writes the survey index of all villages, ranged and sorted by ``survey_key`` so that a prefix reads few row groups; an index
    that has rows stays unless ``rebuild``. One row: rows, villages."""
    spark = parcels.sparkSession
    if rebuild or not is_built(spark, to):
        index = search.survey_index(parcels)
        tables.write_index(index.repartitionByRange("survey_key"), to, ["survey_key", "village_name"])
    return spark.read.parquet(to).agg(F.count("*").alias("rows"), F.count_distinct(*search.HIERARCHY).alias("villages"))


def manifest(spark: SparkSession, to: str) -> DataFrame:
    """(file, length, changed, gone, batch): what each committed batch of an index has taken in, a row a file."""
    try:
        return spark.read.schema(f"{MANIFEST}, batch int").parquet(f"{to}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], f"{MANIFEST}, batch int")


def latest(done: DataFrame) -> DataFrame:
    """The last word of a manifest on each file."""
    return done.groupBy("file").agg(F.max_by(F.struct("length", "changed", "gone", "batch"), "batch").alias("m")).select("file", "m.*")


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """(path, file, length, changed, gone): files that the manifest does not know as they are now, and files it knows that are gone."""
    known = latest(done).where("not gone")
    new = files.join(known.select("file", "length", "changed"), ["file", "length", "changed"], "left_anti").select("path", "file", "length", "changed", F.lit(False).alias("gone"))
    lost = known.join(files.select("file"), "file", "left_anti").select(F.lit(None).cast("string").alias("path"), "file", "length", "changed", F.lit(True).alias("gone"))
    return new.unionByName(lost)


def build_in_batches(files: DataFrame, to: str, read: Callable[[list[str]], DataFrame], per_batch: int = 500, batches: int | None = None, sort: tuple[str, ...] = ("survey_key", "village_name")) -> int:
    """Takes the files that are new, changed or gone into the index at ``to``, at most ``per_batch`` at a time; returns how many batches
    were committed, at most ``batches``.

    ``files`` is (path, file, length, changed), ``read`` gives the index rows of some paths with their ``file``. A batch's rows go to a folder of
    their own; then one manifest file commits it. A build that is stopped goes on with the files that no committed batch has, and writes
    the folder of the batch it was in anew. Rows of a file's earlier state stay on disk until ``compact``, but ``read_index`` leaves them out."""
    spark = files.sparkSession
    done = manifest(spark, to)
    last = done.agg(F.max("batch")).first()[0] or 0
    todo = written(numbered(pending(files, done), ["file"], "_n", 0).withColumn("_slot", F.floor(F.col("_n") / per_batch)))
    slots = (todo.agg(F.max("_slot")).first()[0] or 0) + 1 if todo.limit(1).count() else 0
    for i in range(slots if batches is None else min(batches, slots)):
        own, batch = todo.where(F.col("_slot") == i), last + 1 + i
        paths = [r.path for r in own.where("not gone").select("path").collect()]
        if paths:
            rows = read(paths)
            rows.repartitionByRange(sort[0]).sortWithinPartitions(*sort).write.mode("overwrite").parquet(f"{to}/rows/batch={batch}")
        own.select("file", "length", "changed", "gone").coalesce(1).write.mode("overwrite").parquet(f"{to}/manifest/batch={batch}")
    return slots if batches is None else min(batches, slots)


def read_index(spark: SparkSession, to: str) -> DataFrame:
    """The rows of an index that its manifest vouches for: of each file those of the last batch that took it in. A filter on a row's
    columns reaches the scan; the manifest is a row a file."""
    now = latest(manifest(spark, to)).where("not gone").select("file", "batch")
    return spark.read.parquet(f"{to}/rows").join(small(now, now.count(), 256), ["file", "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, to: str, sort: tuple[str, ...] = ("survey_key", "village_name")) -> None:
    """Rewrites an index as one batch, ranged and sorted over all files, and deletes the batches before it."""
    now = written(latest(manifest(spark, to)))
    last = now.agg(F.max("batch")).first()[0]
    if last is None:
        return
    read_index(spark, to).repartitionByRange(sort[0]).sortWithinPartitions(*sort).write.mode("overwrite").parquet(f"{to}/rows/batch={last + 1}")
    now.where("not gone").select("file", "length", "changed", "gone").coalesce(1).write.mode("overwrite").parquet(f"{to}/manifest/batch={last + 1}")
    for i in range(1, last + 1):
        delete(spark, f"{to}/rows/batch={i}")
        delete(spark, f"{to}/manifest/batch={i}")


def build_lake_index(spark: SparkSession, root: str, to: str, per_batch: int = 500, batches: int | None = None) -> int:
    """``build_in_batches`` of the survey index over a lake of village files. Of each batch, files whose footer lacks a column that the
    index needs are left out before they are scanned."""

    def read(paths: list[str]) -> DataFrame:
        listed = spark.createDataFrame([(p,) for p in paths], "path string")
        good = [r.path for r in lake.having(listed).collect()]
        schema = "survey_no string, village_name string, village_code string"
        parcels = lake.read_files(spark, good, schema) if good else spark.createDataFrame([], f"{schema}, file string, dist string, taluk string, hobli string, vlg string")
        return search.survey_index(parcels, ("file",))

    return build_in_batches(lake.files(spark, root), to, read, per_batch, batches)


def village_counts(raw: DataFrame, state: int | None = None) -> DataFrame:
    """One row about a village file: rows (of the state), villages (codes that are kept), errors (rows without a code or a centroid)."""
    own = tables.of_state(raw, state)
    read = tables.village_rows(own)
    return read.agg(F.count("*").alias("rows"), F.count_distinct(F.when(F.col("ok"), F.col("lgd_code"))).alias("villages"), F.count_if(~F.col("ok")).alias("errors"))


def build_villages(raw: DataFrame, to: str, state: int | None = None) -> DataFrame:
    """Deletes and rebuilds the village table (last row of a code wins), clustered by centroid; returns ``village_counts``."""
    write_places(tables.load_villages(raw, state), to)
    return village_counts(raw, state)


def write_places(places: DataFrame, to: str, row_group: int | None = None) -> None:
    """Replaces a table of places (centroid_lat, centroid_lng), in ranges and rows along a Z-curve: minima and maxima of a row group are
    narrow both in latitude and in longitude, so the box of ``nearby`` reads few of them. ``row_group`` is its size in bytes."""
    placed = places.withColumn("_z", geo.morton(F.col("centroid_lat"), F.col("centroid_lng"))).repartitionByRange("_z").sortWithinPartitions("_z").drop("_z")
    writer = placed.write.mode("overwrite")
    if row_group:
        writer = writer.option("parquet.block.size", row_group).option("parquet.block.size.row.check.min", 100).option("parquet.page.size.row.check.min", 100)
    writer.parquet(to)


def load_counts(villages: DataFrame) -> DataFrame:
    """One row about enriched villages: rows, mapped, with_data."""
    return villages.agg(F.count("*").alias("rows"), F.count_if(F.col("vlg").isNotNull()).alias("mapped"), F.count_if("has_data").alias("with_data"))
