"""Text keys of survey numbers, names and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_null(c: Column) -> Column:
    """As text, trimmed; null becomes ''."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def survey_base(c: Column) -> Column:
    """What stands before the first '/', trimmed."""
    return F.trim(F.split_part(c, F.lit("/"), F.lit(1)))


def leading_int(c: Column) -> Column:
    """The signed number a text begins with, 0 if none: 12 for '12A'."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?[0-9]{1,18})", 1).try_cast("long"), F.lit(0))


def squashed(c: Column) -> Column:
    """Lower case without spaces, to match names."""
    return F.replace(F.trim(F.lower(c)), F.lit(" "), F.lit(""))


def all_digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def month_start(at: Column) -> Column:
    """Midnight of the first of the month, in the session's time zone."""
    return F.date_trunc("month", at)


def day_text(c: Column) -> Column:
    """A day as people read it: 5 Mar 2024."""
    return F.date_format(c, "d MMM yyyy")


def fixed(c: Column, places: int) -> Column:
    """A number with so many decimals, as text."""
    return F.format_string(f"%.{places}f", c.cast("double"))


def dashed(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))


def hierarchy_columns(path: Column) -> dict[str, Column]:
    """dist, taluk, hobli, vlg of a path like dist_1/taluk_9/hobli_3/vlg_46.parquet; '' where a part is missing."""
    parts = {k: F.regexp_extract(path, rf"(?:^|/){k}_([^/]+)/", 1) for k in ("dist", "taluk", "hobli")}
    return parts | {"vlg": F.regexp_extract(path, r"(?:^|/)vlg_(\w+)\.parquet$", 1)}
