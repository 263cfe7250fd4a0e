"""Tables that cut lineage, in the folder that driver and executors share, and row numbers over a table in many tasks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured rows times its stated width stay under this many bytes.
BROADCAST_BYTES = 8 << 20
#: ``monotonically_increasing_id`` has the partition above so many bits and the row within it below.
ROW_BITS = 33
_made: set[str] = set()


def folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; it is deleted when the driver's Python ends. Without the setting a
    temporary folder serves in local mode, and a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="plotwise-")
        spark.conf.set("spark.checkpoint.dir", base)
    at = f"{base.rstrip('/')}/plotwise-tables-{spark.sparkContext.applicationId}"
    if at not in _made:
        _made.add(at)
        atexit.register(delete, spark, at)
    return at


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Spark's file system, if the session still runs."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again: what came before is not done twice, and a lost executor loses nothing."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it: local ones with or without a scheme, others by their scheme as Arrow knows it."""
    local = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


def small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``df`` with a hint to broadcast it if its measured size allows that, else ``shuffled``."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast. Left alone, Spark goes by the size of ``written`` files, and rows that
    compress to a few MB may take hundreds in the driver, before they are exploded."""
    return df.hint("merge")


def numbered_as_is(df: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Adds a long ``name``: the rows' numbers in the order of partitions and rows, as a sort leaves them, without a task that sees all.

    Partition and place come with each row as it is written; the partitions' rows are counted, and their sums before each (one number a
    partition) go to all tasks."""
    mask = F.lit((1 << ROW_BITS) - 1)
    placed = written(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    bases, total = [], start
    for p, n in counts:
        bases.append((p, total))
        total += n
    known = df.sparkSession.createDataFrame(bases, "_part long, _base long")
    out = placed.withColumn("_part", part).join(small(known, len(bases), 16), "_part")
    return out.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(mask)).drop("_at", "_part", "_base")


def numbered(df: DataFrame, order: list[Column | str], name: str, start: int = 1) -> DataFrame:
    """``df`` sorted by ``order`` over ranges, with each row's number over the whole table as the long ``name``. Ties are numbered in no
    certain order; nulls come first, as in a sort."""
    return numbered_as_is(df.orderBy(*order), name, start)
