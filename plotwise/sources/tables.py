"""Name lists, village centroids, rosters, captured payloads and project rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from .lake import polygons

NAMES = "Vlglist array<struct<vlgcode: string, vlgname: string>>"
LEVELS = ("vlg", "hobli", "taluk", "dist")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(pos, vlgcode, vlgname) of the JSON document."""
    return spark.read.schema(NAMES).option("multiLine", "true").json(path).select(F.posexplode("Vlglist").alias("pos", "e")).select("pos", "e.vlgcode", "e.vlgname")


def explode_names(raw: DataFrame) -> DataFrame:
    """(level, dist, taluk, hobli, vlg, name): every level of every row ('' below the level), first wins by ``pos``.
    Rows with fewer than four parts in either text, or a null, are skipped."""
    parts = raw.select("pos", F.split("vlgcode", ",").alias("c"), F.split("vlgname", r"\|").alias("n")).where((F.size("c") >= 4) & (F.size("n") >= 4))
    blank = F.lit("")
    rows = [F.struct(F.lit(level).alias("level"), F.col("c")[3].alias("dist"), (F.col("c")[2] if i < 3 else blank).alias("taluk"), (F.col("c")[1] if i < 2 else blank).alias("hobli"), (F.col("c")[0] if i < 1 else blank).alias("vlg"), F.col("n")[i].alias("name")) for i, level in enumerate(LEVELS)]
    flat = parts.select("pos", F.explode(F.array(*rows)).alias("r")).select("pos", "r.*")
    return flat.groupBy("level", "dist", "taluk", "hobli", "vlg").agg(F.min_by("name", "pos").alias("name"))


def first_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The row with the least ``pos`` of each key, by one partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), pos).alias("_r")).select(*keys, "_r.*")


def last_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("_r")).select(*keys, "_r.*")


def of_state(raw: DataFrame, state: int | None) -> DataFrame:
    """The rows of a state; all if the column does not exist or no state is asked for."""
    return raw.where(F.col("state_lgd") == state) if state is not None and "state_lgd" in raw.columns else raw


def village_rows(raw: DataFrame) -> DataFrame:
    """The columns of ``load_villages`` for every row, with pos and ``ok``: whether it has a code and a valid centroid."""
    name = text.no_null(F.col("vilname11")) if "vilname11" in raw.columns else F.lit("")
    code = F.col("vil_lgd").try_cast("bigint") if "vil_lgd" in raw.columns else F.lit(None).cast("bigint")
    c = geo.centroid(F.col("mpoly"))
    rows = raw.select(code.alias("lgd_code"), name.alias("village_name"), c["y"].alias("centroid_lat"), c["x"].alias("centroid_lng"), geo.geojson(F.col("mpoly")).alias("geom_geojson"), "pos")
    return rows.withColumn("ok", F.col("lgd_code").isNotNull() & geo.valid_coordinate(F.col("centroid_lat"), F.col("centroid_lng")))


def load_villages(raw: DataFrame, state: int | None = None) -> DataFrame:
    """(lgd_code, village_name, centroid_lat, centroid_lng, geom_geojson) from vil_lgd, vilname11, state_lgd, mpoly, pos.
    The last row of a code wins; rows without a code or a centroid are left out; the state filter holds if the column exists."""
    rows = village_rows(of_state(raw, state)).where("ok").drop("ok")
    return last_wins(rows, ["lgd_code"], "pos").drop("pos")


def read_villages(spark: SparkSession, path: str, srid: int | None = None) -> DataFrame:
    """The raw columns of ``load_villages`` from a file of villages with geometry as well-known binary, in degrees or in the lake's grid
    without its exchange of axes; ``pos`` is the order of the rows in the file."""
    raw = spark.read.parquet(path).withColumn("pos", F.struct("_metadata.file_path", "_metadata.row_index"))
    return polygons(raw, srid=srid, exchanged=False)


def payload_records(raw: DataFrame, schema: str, body: str = "body", status: str = "status") -> DataFrame:
    """Records of captured answers: other columns of ``raw``, pos, and the record's fields.
    Only status 200 with a list under ``data`` counts; the body may be a text of JSON within JSON; 'nodata' and the rest give no rows."""
    keep = [c for c in raw.columns if c not in (body, status)]
    text_ = F.trim(F.col(body))
    inner = F.when(text_.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), text_, F.lit("}")), "v string")["v"]).otherwise(text_)
    data = F.get_json_object(inner, "$.data")
    ok = (F.col(status) == 200) & (F.lower(F.replace(text_, F.lit('"'), F.lit(""))) != "nodata") & data.startswith("[")
    return raw.where(ok).select(*keep, F.posexplode(F.from_json(data, f"array<struct<{schema}>>")).alias("pos", "r")).select(*keep, "pos", "r.*")


def write_index(df: DataFrame, to: str, sort: list[str]) -> None:
    """Replaces a derived table at once, in order, so that row groups prune by min and max."""
    df.sortWithinPartitions(*sort).write.mode("overwrite").parquet(to)


def add_project(spark: SparkSession, to: str, row: dict) -> DataFrame:
    """Appends a project, always as needs-review; returns the row."""
    schema = "id string, user_id string, name string, location string, status string, boundary string, created_at timestamp"
    df = spark.createDataFrame([(row["id"], row["user_id"], row["name"], row.get("location"), "needs-review", row.get("boundary"), row["created_at"])], schema)
    looked_up(df.write.mode("append"), "user_id").parquet(to)
    return df


def looked_up(writer: DataFrameWriter, column: str, values: int = 100_000) -> DataFrameWriter:
    """The writer with a Bloom filter of ``column`` in each row group, for about so many values: a look-up of one value reads only
    the row groups that may have it, though the table is not sorted by it. A dictionary would take the filter's place, so there is none."""
    return writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(values)).option(f"parquet.enable.dictionary#{column}", "false")


def write_projects(rows: DataFrame, to: str) -> None:
    """Replaces the table of projects: newest rows together, a user found by Bloom filters."""
    looked_up(rows.repartitionByRange("created_at").sortWithinPartitions("created_at", "id").write.mode("overwrite"), "user_id").parquet(to)


