"""The parcel lake, one file per village under dist_<d>/taluk_<t>/hobli_<h>/vlg_<v>.parquet, and its re-partitioned form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import geo, text, wkb
from .shared import opened

LEVELS = ("dist", "taluk", "hobli", "vlg")
#: The columns without which a file is no village file to the survey index.
NEEDED = ("survey_no", "village_name", "village_code")
PARCELS = "survey_no string, village_name string, village_code string, geometry binary"
#: The identifiers of longitude and latitude, and of zone 43 north.
WGS84, UTM43N = 4326, 32643


def with_hierarchy(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds the four codes of a path column; rows whose path has no such form are left out."""
    out = df.withColumns(text.hierarchy_columns(F.col(path)))
    return out.where(F.expr(" and ".join(f"{k} <> ''" for k in LEVELS)))


def scan(spark: SparkSession, root: str, schema: str | None = PARCELS, placed: bool = False, needed: tuple[str, ...] = ()) -> DataFrame:
    """All village files as one lazy scan; corrupt files are skipped. A filter on a code prunes files by their path.
    ``schema`` None merges whatever columns the files have (by name, missing ones null). ``placed`` adds path and pos (the row in the
    file): ordered by these, rows stand as in the files by name. ``needed`` names columns without which a file is left out: footers are read
first, in many tasks, and the scan gets the list of the files that have them all."""
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("pathGlobFilter", "vlg_*.parquet")
    reader = reader.schema(schema) if schema else reader.option("mergeSchema", "true")
    paths = [r.path for r in having(files(spark, root), needed).select("path").collect()] if needed else [root]
    if not paths:
        return scan(spark, root, schema, placed).where(F.lit(False))
    df = reader.parquet(*paths).select("*", F.col("_metadata.file_path").alias("path"), *([F.col("_metadata.row_index").alias("pos")] if placed else []))
    return with_hierarchy(df) if placed else with_hierarchy(df).drop("path")


def files(spark: SparkSession, root: str, names: str = "vlg_*.parquet") -> DataFrame:
    """(path, file, length, changed) of all files below ``root`` with such names; contents are not read. ``file`` is the path as
    ``_metadata.file_path`` of a scan has it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    return found.select("path", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("changed"))


def having(listed: DataFrame, columns: tuple[str, ...] = NEEDED) -> DataFrame:
    """Of ``files`` those whose Parquet footer has all ``columns`` and some row. Tasks read footers only; a file that can't be read is left out."""
    kept, wanted = listed.columns, set(columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[footer_has(p, wanted) for p in pdf["path"]]]

    # A footer takes one round trip, whatever its file's size: a few files a task, so that many are asked at once.
    spread = listed.repartition(max(1, min(listed.sparkSession.sparkContext.defaultParallelism * 4, 4096)))
    return spread.select(*kept).mapInPandas(read, listed.schema)


def footer_has(path: str, wanted: set[str]) -> bool:
    try:
        store, where = opened(path)
        footer = pq.read_metadata(where, filesystem=store)
    except (OSError, ValueError):
        return False
    return footer.num_rows > 0 and wanted <= set(footer.schema.to_arrow_schema().names)


def read_files(spark: SparkSession, paths: list[str], schema: str = PARCELS) -> DataFrame:
    """The parcels of these files with ``file`` and the codes of their paths."""
    df = spark.read.option("ignoreCorruptFiles", "true").schema(schema).parquet(*paths).select("*", F.col("_metadata.file_path").alias("file"))
    return with_hierarchy(df, "file")


def in_path_order(df: DataFrame) -> DataFrame:
    """Rows of a placed scan by file name as text (vlg_10 before vlg_2), then by their place in the file."""
    return df.orderBy("path", "pos")


def scoped(df: DataFrame, **codes: str | None) -> DataFrame:
    """Equality on every level that is given; None and '' mean any."""
    for level, code in codes.items():
        if code:
            df = df.where(F.col(level) == F.lit(code))
    return df


def polygons(df: DataFrame, srid: int | None = UTM43N, exchanged: bool = True) -> DataFrame:
    """Decodes ``geometry`` and keeps polygons: columns kind, srid (always WGS84 after this) and mpoly (longitude, latitude).

    ``srid`` is the input's reference system; an identifier in the geometry goes before it. None tells by the values: what
    lies within 180 and 90 is taken as degrees, the rest as zone 43N. Other systems raise an error. ``exchanged`` says that grid coordinates have
    their axes exchanged, as the parcel lake's have; degrees never have."""
    got = df.withColumn("_g", wkb.decoded(F.col("geometry"))).where(F.col("_g.kind").isin("Polygon", "MultiPolygon", "GeometryCollection") & (F.size("_g.parts") > 0))
    box = geo.bbox(F.col("_g.parts"))
    degrees = (box["min_x"] >= -180) & (box["max_x"] <= 180) & (box["min_y"] >= -90) & (box["max_y"] <= 90)
    own = F.coalesce(F.col("_g.srid"), F.lit(srid) if srid else F.when(degrees, WGS84).otherwise(UTM43N))
    utm = geo.to_wgs84(F.col("_g.parts")) if exchanged else geo.map_points(F.col("_g.parts"), lambda p: geo.utm43n_inverse(p["x"], p["y"]))
    known = F.when(own == WGS84, F.col("_g.parts")).when(own == UTM43N, utm)
    mpoly = F.coalesce(known, F.raise_error(F.concat(F.lit("no conversion from reference system "), own.cast("string"))).cast(got.schema["_g"].dataType["parts"].dataType))
    return got.withColumn("kind", F.when(F.size("_g.parts") == 1, "Polygon").otherwise("MultiPolygon")).withColumn("srid", F.lit(WGS84)).withColumn("mpoly", mpoly).drop("_g", "geometry")


def list_codes(df: DataFrame, level: str) -> DataFrame:
    """Distinct all-digit codes of a level, by number."""
    return df.where(text.all_digits(F.col(level))).select(F.col(level).alias("code")).distinct().orderBy(F.col("code").cast("bigint"))


def rewrite(df: DataFrame, to: str) -> None:
    """Writes the lake by district, taluk and hobli, sorted for min/max pruning on the survey number."""
    df.repartition("dist", "taluk", "hobli").sortWithinPartitions("dist", "taluk", "hobli", "vlg", "survey_no").write.mode("overwrite").partitionBy("dist", "taluk", "hobli").parquet(to)


def read_rewritten(spark: SparkSession, path: str) -> DataFrame:
    """Codes stay text: the files' columns are found first, then the table is read with the codes of its folders as texts. No setting of the
    session is touched."""
    found = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, StringType()) if f.name in LEVELS else f for f in found])).parquet(path)
