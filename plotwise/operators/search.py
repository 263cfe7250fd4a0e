"""Hierarchy listings, survey numbers and village names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

SURVEY_LIMIT, VILLAGE_LIMIT = 25, 20
HIERARCHY = ["dist", "taluk", "hobli", "vlg"]


def list_level(codes: DataFrame, names: DataFrame, keys: list[str], level: str) -> DataFrame:
    """(code, name) by name, then number; a code without a name shows itself. Only all-digit codes are listed."""
    own = codes.where(text.all_digits(F.col(level))).select(*keys).distinct()
    out = own.join(names.select(*keys, "name"), keys, "left").select(F.col(level).alias("code"), F.coalesce("name", level).alias("name"))
    return out.orderBy("name", F.col("code").cast("bigint"))


def survey_index(parcels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """survey_no, survey_no_norm (its base), village_name, village_code and codes, and columns ``keep``; rows without a number are left out."""
    t = {c: text.no_null(F.col(c)) for c in ("survey_no", "village_name", "village_code")}
    out = parcels.select(*[v.alias(k) for k, v in t.items()], *HIERARCHY, *keep).withColumn("survey_no_norm", text.survey_base(F.col("survey_no")))
    return out.where("survey_no <> ''").withColumn("survey_key", F.lower("survey_no_norm"))


def survey_search(index: DataFrame, q: str, limit: int = SURVEY_LIMIT) -> DataFrame:
    """Distinct rows whose base begins with the query's, by leading number, then village; a query under two characters finds nothing.
    ``survey_key`` is a bare column, so the prefix reaches the scan."""
    base = q.split("/")[0].strip()
    found = index.where(F.col("survey_key").startswith(base.lower())) if len(base) >= 2 else index.where(F.lit(False))
    cols = ["survey_no", "village_name", *HIERARCHY]
    found = found.groupBy(*cols).agg(F.min(text.leading_int(F.col("survey_no_norm"))).alias("number"))
    return found.orderBy("number", "village_name", "survey_no", *HIERARCHY).limit(limit).drop("number")


def prefix_dictionary(index: DataFrame, limit: int = SURVEY_LIMIT, least: int = 2) -> DataFrame:
    """(prefix, rank, survey_no, village_name, codes): what ``survey_search`` answers to every prefix of the index, of at least ``least``
    characters. Of each prefix a task hands on its first ``limit`` rows only, so a short prefix that most rows have is no hot key."""
    cols = ["survey_no", "village_name", *HIERARCHY]
    rows = index.groupBy(*cols, "survey_key").agg(F.min(text.leading_int(F.col("survey_no_norm"))).alias("number"))
    every = rows.where(F.length("survey_key") >= least).select("*", F.explode(F.transform(F.sequence(F.lit(least), F.length("survey_key")), lambda n: F.substring("survey_key", F.lit(1), n))).alias("prefix"))
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("number", *cols[1:2], cols[0], *HIERARCHY))
    return every.withColumn("rank", rank).where(F.col("rank") <= limit).select("prefix", "rank", *cols)


def dictionary_search(dictionary: DataFrame, q: str) -> DataFrame:
    """The answer to a query from a ``prefix_dictionary``, in order: one filter on a bare column."""
    base = q.split("/")[0].strip().lower()
    found = dictionary.where(F.col("prefix") == base) if len(base) >= 2 else dictionary.where(F.lit(False))
    return found.orderBy("rank").drop("prefix", "rank")


def village_search(names: DataFrame, with_data: DataFrame, q: str, limit: int = VILLAGE_LIMIT) -> DataFrame:
    """Villages that have data and whose name begins with the query in any case, with district and taluk names.
    ``names`` has level, the four codes, name and pos."""
    q = q.strip().lower()
    villages = names.where(F.col("level") == "vlg")
    villages = villages.where(F.lower("name").startswith(q)) if len(q) >= 2 else villages.where(F.lit(False))
    villages = villages.join(with_data.select(*HIERARCHY).distinct(), HIERARCHY, "left_semi")
    dist = names.where("level = 'dist'").select("dist", F.col("name").alias("dist_name"))
    taluk = names.where("level = 'taluk'").select("dist", "taluk", F.col("name").alias("taluk_name"))
    out = villages.join(dist, "dist", "left").join(taluk, ["dist", "taluk"], "left")
    out = out.select(F.col("name").alias("village_name"), F.coalesce("dist_name", "dist").alias("dist_name"), F.coalesce("taluk_name", "taluk").alias("taluk_name"), *HIERARCHY, "pos")
    return out.orderBy("village_name", "pos").limit(limit).drop("pos")


def first_of_base(features: DataFrame, survey: str, order: list[str]) -> DataFrame:
    """The first feature, in the given order, whose survey number has the base of ``survey``."""
    return same_base(features, survey).orderBy(*order).limit(1)


def in_loaded(results: DataFrame, loaded: DataFrame, **codes: str | None) -> DataFrame:
    """Search results whose survey base is among those loaded and whose codes are those of the loaded village, as far as given; one of
    those alike in number and codes."""
    base = lambda df: df.withColumn("_base", text.survey_base(F.col("survey_no")))
    own = base(results).join(base(loaded).select("_base").distinct(), "_base", "left_semi").drop("_base")
    for level, code in codes.items():
        if code:
            own = own.where(F.col(level) == code)
    return own.dropDuplicates(["survey_no", *HIERARCHY])


def not_loaded(results: DataFrame, current: DataFrame) -> DataFrame:
    """The other results: those without a row alike in number and codes in ``in_loaded``."""
    return results.join(current, ["survey_no", *HIERARCHY], "left_anti")


def inset_search(loaded: DataFrame, q: str) -> DataFrame:
    """Distinct bases of the loaded parcels that begin with the query, in text order."""
    base = text.survey_base(F.col("survey_no"))
    return loaded.select(base.alias("survey_no")).distinct().where(F.col("survey_no").startswith(q.split("/")[0].strip())).orderBy("survey_no")


def parcels_of(parcels: DataFrame, survey: str | None = None, kinds: tuple[str, ...] = ("Polygon", "MultiPolygon")) -> DataFrame:
    """Parcels of polygon kinds; the survey filter is skipped if there is no such column."""
    if survey and "survey_no" in parcels.columns:
        parcels = parcels.where(F.col("survey_no") == survey)
    return parcels.where(F.col("kind").isin(*kinds))


def same_base(parcels: DataFrame, survey: str) -> DataFrame:
    return parcels.where(text.survey_base(F.col("survey_no")) == survey.split("/")[0].strip())


def property_sheet(parcels: DataFrame, keys: list[str], labels: DataFrame, hidden: tuple[str, ...] = ("survey_no", "geometry")) -> DataFrame:
    """(keys, key, label, value): shown attributes; nulls, blanks and 'nan' are left out; a key without a label loses its underscores."""
    shown = [c for c in parcels.columns if c not in keys and c not in hidden]
    long = parcels.select(*keys, *[F.col(c).cast("string").alias(c) for c in shown]).unpivot(keys, shown, "key", "value")
    long = long.where(F.col("value").isNotNull() & (F.trim("value") != "") & (F.col("value") != "nan"))
    return long.join(labels, "key", "left").select(*keys, "key", F.coalesce("label", F.replace("key", F.lit("_"), F.lit(" "))).alias("label"), "value")
