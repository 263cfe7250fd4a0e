"""A training corpus in five stages, each an operator of ``plotwise.llm`` over all its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm.minhash import drop_near_duplicates
from plotwise.llm.mixing import repeat_documents
from plotwise.llm.packing import pack
from plotwise.llm.pii import hide_private
from plotwise.llm.quality import keep_good
from plotwise.llm.shared import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant rejects go; null and empty texts are scored as empty ones."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one of least id; documents without words all stay, of repeated rows one."""
    return drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated identifiers in the text become pseudonyms; null and empty texts stay as they are."""
    return hide_private(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by their source's target, in the order of the schedule; those without words stand once, first."""
    return repeat_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, in the order of the mix; a null or empty text is its end id.

    The stage before wrote its parts in the order of its slots, so the order is that of file names and of rows in them; Spark deals files
    to tasks by size. Documents that come from no file are packed as they come."""
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_pw_file"), F.col("_metadata.row_index").alias("_pw_row"))
    except AnalysisException:
        return pack(docs)
    return pack(placed, place=("_pw_file", "_pw_row"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("private", private), ("mixing", mixing), ("packing", packing)]
#: The discriminant, the sampled signatures and the tokenizer have no SQL form; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
