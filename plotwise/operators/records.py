"""Ownership cases, mutations and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

COMPLETE, REVIEW = "complete", "needs-review"


def dedup_by_key(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each non-empty key in the given order; rows with an empty key all stay."""
    filled = F.col(key) != ""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return records.where(filled).withColumn("_n", first).where("_n = 1").drop("_n").unionByName(records.where(~filled))


def owners(records: DataFrame, survey: str | None = None) -> DataFrame:
    """Cases of both sources (column rank: the preferred one first; pos within it), one per acknowledgement number; of these, the cases of
    a survey base if one is given. A number whose preferred case has another base is left out, whatever its other cases say."""
    r = records.withColumns({c: text.no_null(F.col(c)) for c in ("Ack_No", "Survey_no", "surnoc", "hissano")})
    one = dedup_by_key(r, "Ack_No", ["rank", "pos"])
    if survey:
        one = one.where(text.survey_base(F.col("Survey_no")) == survey.split("/")[0].strip())
    number = F.concat_ws("/", "Survey_no", text.dashed(F.col("surnoc")), text.dashed(F.col("hissano")))
    return one.select(F.col("Ack_No").alias("ack_no"), number.alias("survey_no"), F.col("ownername").alias("owner"), F.col("Case_Status").alias("status"), "rank", "pos")


def mutations(records: DataFrame, survey: str | None = None, exact: bool = False) -> DataFrame:
    """Mutations whose survey numbers contain the base as text; ``exact`` asks for a whole number instead."""
    out = records.select(F.col("MRNumber").alias("mr_number"), F.col("TypeofTransaction").alias("kind"), F.coalesce("SurveyNumbers", F.lit("")).alias("survey_numbers"), "status", "applicant")
    if not survey:
        return out
    base = survey.split("/")[0].strip()
    if exact:
        return out.where(F.exists(F.split("survey_numbers", r"[,;\s]+"), lambda s: text.survey_base(s) == base))
    return out.where(F.col("survey_numbers").contains(base))


def projects(rows: DataFrame, user: str) -> DataFrame:
    """A user's projects, newest first; unknown states count as needing review; a null location is ''."""
    status = F.when(F.col("status").isin(COMPLETE, REVIEW), F.col("status")).otherwise(REVIEW)
    own = rows.where(F.col("user_id") == user)
    return own.withColumns({"status": status, "location": F.coalesce("location", F.lit(""))}).orderBy(F.col("created_at").desc(), "id")


def project(rows: DataFrame, user: str, id_: str) -> DataFrame:
    """At most two rows, so a caller can tell one from none and from many."""
    return rows.where((F.col("user_id") == user) & (F.col("id") == id_)).limit(2)


def project_stats(rows: DataFrame, since=None) -> DataFrame:
    """total, complete, needs_review and this_month (created at or after ``since``: without it, the first of this month at midnight in
    the session's time zone) in one pass."""
    since = text.month_start(F.current_timestamp()) if since is None else since
    status = F.when(F.col("status").isin(COMPLETE, REVIEW), F.col("status")).otherwise(REVIEW)
    return rows.agg(F.count("*").alias("total"), F.count_if(status == COMPLETE).alias("complete"), F.count_if(status == REVIEW).alias("needs_review"), F.count_if(F.col("created_at") >= since).alias("this_month"))
