"""Helpers that the operators share: tables, shared storage for cut lineage, and size-checked joins."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured rows times its stated row width stay under this many bytes.
BROADCAST_BYTES = 8 << 20
#: Bytes of an Arrow batch that a Python worker opens at once.
SLICE_BYTES = 4 << 20
_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in the one that driver and executors share (``spark.checkpoint.dir``); it is deleted when the
    driver's Python ends. Where the setting is absent a temporary folder serves, but only in local mode: a cluster would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="plotwise-")
        spark.conf.set("spark.checkpoint.dir", base)
    at = f"{base.rstrip('/')}/plotwise-{spark.sparkContext.applicationId}"
    if at not in _folders:
        _folders[at] = at
        atexit.register(_delete, spark, at)
    return at


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Spark's file system, if the session still runs."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so a lost executor never recomputes what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``SLICE_BYTES``; at the end of the task the worker's memory goes back to the system."""
    for b in batches:
        step = max(1, b.num_rows * SLICE_BYTES // max(SLICE_BYTES, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
    release()


def release() -> None:
    """Python workers outlive their tasks: hand back what they no longer use, so that it is not missed by the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is under ``BROADCAST_BYTES``; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text is divisible by 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))
