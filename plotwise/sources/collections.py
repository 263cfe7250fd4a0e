"""One GeoJSON file of any number of features, written by many tasks: a data source for ``DataFrame.write``.

Each task writes its features, joined by commas, to a part beside the file. When all have, the commit puts head, parts in the order of their
partitions, separators and tail into a new file, copying a block at a time, and renames it; before that there is no file. A task that
fails, or is run twice, leaves a part that no commit names, and the parts go at the end either way."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import numbered, opened

FORMAT = "feature_collection"
#: A feature a line, so that the file is read in pieces again.
HEAD, BETWEEN, TAIL = b'{"type":"FeatureCollection","features":[\n', b",\n", b"\n]}\n"
BLOCK = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    features: int


class CollectionWriter(DataSourceArrowWriter):
    def __init__(self, to: str):
        self.to, self.parts = to, f"{to}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        store, folder = opened(self.parts)
        store.create_dir(folder, recursive=True)
        path, n = f"{folder}/part-{task.partitionId():08d}-{task.taskAttemptId()}", 0
        with store.open_output_stream(path) as out:
            for batch in iterator:
                for text in batch.column(0).cast(pa.binary()).to_pylist():
                    if text is not None:
                        out.write(BETWEEN + text if n else text)
                        n += 1
        return Part(task.partitionId(), path, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, to = opened(self.to)
        made = f"{to}.new-{uuid.uuid4().hex}"
        with store.open_output_stream(made) as out:
            out.write(HEAD)
            for i, part in enumerate(sorted((m for m in messages if m is not None and m.features), key=lambda m: m.partition)):
                out.write(BETWEEN if i else b"")
                with store.open_input_stream(part.path) as one:
                    while block := one.read(BLOCK):
                        out.write(block)
            out.write(TAIL)
        store.move(made, to)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = opened(self.parts)
        store.create_dir(folder, recursive=True)
        store.delete_dir(folder)


class CollectionSource(DataSource):
    """Option ``path``: the file. One column of texts, the features; nulls are left out."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> CollectionWriter:
        if len(schema) != 1:
            raise ValueError("a collection is written from one column, the features' texts")
        store, to = opened(self.options["path"])
        if not overwrite and store.get_file_info(to).type.name != "NotFound":
            raise ValueError(f"{to} is there already")
        return CollectionWriter(self.options["path"])


def write_collection(features: DataFrame, order: list, to: str, column: str = "feature") -> None:
    """Writes the texts of ``column`` as one collection, sorted over ranges by ``order``; replaces the file at once. Readers see the old
    or the new one."""
    features.sparkSession.dataSource.register(CollectionSource)
    features.orderBy(*order).select(column).write.format(FORMAT).mode("overwrite").option("path", to).save()


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(place, feature): the features of a file that ``write_collection`` made, as texts with their place from 1. Long files are read in pieces."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    own = lines.where(F.col("value").startswith('{"type":"Feature",')).withColumn("feature", F.regexp_replace("value", ",$", ""))
    return numbered(own, ["_start", "_line"], "place").select("place", "feature")
