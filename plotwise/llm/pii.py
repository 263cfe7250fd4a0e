"""PII: format-preserving Feistel pseudonyms. Built-in column functions only.

Kinds, validated before they are replaced: card (13 to 19 digits that pass the check digit), ssn (area 1 to 899 but not 666, group
and serial not 0), ip (each part at most 255) and date (a real calendar day of ISO form in the permuted range). Phone numbers and
emails have nothing to check beyond their form. The value is permuted by a
keyed Feistel network over its own format: digits stay digits, separators and the country code stay, a card's check
digit is made anew, a date becomes another date, an ssn another valid one, an address another address; an email's name keeps the
class of each ASCII letter and digit, its letters beyond ASCII stay within their sixteen code points, and its domain stays. The same value gets the same pseudonym in every document and under every run with the same key;
different values of one format get different ones.

Defined results: a null text stays null, an empty one empty; text without a find is unchanged to the byte; a candidate
that fails validation stays; repeated rows are treated alike; an empty table gives no rows; very long texts are
read whole; other columns are ignored (by the stage: passed on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Patterns of the kinds, tried in this order at each place. Possessive runs and look-behinds keep each linear.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<!\w)(?:\(\d{3}\) |\d{3}[.-])\d{3}[.-]\d{4}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w-])(?:19|20)\d{2}-\d{2}-\d{2}(?![\w-])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "card": r"(?<!\w)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\w)",
}
ANY = "|".join(PATTERNS.values())
#: A cheap test that a text may hold any of them: whatever matches a pattern matches this too.
HINT = r"@|\+\d|\d{3}[-. )]|\d{13}|\d\.\d|\d{4}-"
#: Days from 1970-01-01 to 1900-01-01; the permuted range is 270 * 271 days, up to 2100-05-01.
FIRST_DAY, DATE_A, DATE_B = -25567, 270, 271
#: KEY is public and for tests: operators are given a key, and the queries read it from the session's ``KEY_SETTING``.
ROUNDS, KEY, KEY_SETTING = 8, "plotwise-demo-key", "spark.plotwise.pseudonym.key"


def _round(key: str, kind: str, i: Column, half: Column) -> Column:
    """A keyed number under 2**48 from one half."""
    return F.conv(F.substring(F.sha2(F.encode(F.concat_ws(":", F.lit(f"{key}:{kind}"), i.cast("string"), half.cast("string")), "utf-8"), 256), 1, 12), 16, 10).cast("long")


def feistel(value: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A permutation of 0 .. a * b - 1: halves in Z_a and Z_b, shifted in turn by a keyed function of the other."""
    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, F.pmod(s["l"] + _round(key, kind, i, s["r"]), a)).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + _round(key, kind, i, s["l"]), b))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])
    return out


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits, from the left, replaced by those of ``digits``."""
    chars = F.split(shape, "")
    step = lambda s, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(s["t"], F.substr(digits, s["i"], F.lit(1))).alias("t"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i")))
    return F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), step, lambda s: s["t"])


def check_sum(digits: Column, from_right: int) -> Column:
    """Luhn sum; every second digit from the right is doubled, beginning with place ``from_right`` (0 or 1)."""
    n = F.length(digits)
    value = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == from_right, doubled(i)).otherwise(value(i)))


def power10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits of any length up to 18, permuted among the strings of that length."""
    n = F.length(digits)
    out = feistel(digits.cast("long"), power10(F.floor(n / 2)), power10(n - F.floor(n / 2)), key, kind)
    return F.lpad(out.cast("string"), n, F.lit("0"))


def new_card(x: Column, key: str) -> Column:
    d = digits_of(x)
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    made = permuted_digits(body, key, "card")
    full = F.concat(made, F.pmod(F.lit(10) - F.pmod(check_sum(made, 0), F.lit(10)), F.lit(10)).cast("string"))
    return F.when(check_sum(d, 1) % 10 == 0, refill(x, full)).otherwise(x)


def new_ssn(x: Column, key: str) -> Column:
    """Another valid number: area, group and serial are counted as one number without the areas, groups and serials that are not issued."""
    d = digits_of(x)
    area, group, serial = (F.substr(d, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("long")
    out = feistel((place * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn")
    first = F.floor(out / (99 * 9999))
    numbers = ((first + 1 + (first >= 665).cast("long"), 3), (F.pmod(F.floor(out / 9999), F.lit(99)) + 1, 2), (F.pmod(out, F.lit(9999)) + 1, 4))
    return F.when(valid, refill(x, F.concat(*[F.lpad(c.cast("long").cast("string"), n, "0") for c, n in numbers]))).otherwise(x)


def new_phone(x: Column, key: str) -> Column:
    """The last ten digits are permuted; what stands before them stays."""
    d = digits_of(x)
    n = F.length(d)
    return refill(x, F.concat(F.substr(d, F.lit(1), n - 10), permuted_digits(F.substr(d, n - 9, F.lit(10)), key, "phone")))


def new_ip(x: Column, key: str) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    out = feistel(value, F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
    text = F.concat_ws(".", *[F.pmod(F.floor(out / (256**k)), F.lit(256)).cast("long").cast("string") for k in (3, 2, 1, 0)])
    return F.when(F.forall(parts, lambda p: p <= 255), text).otherwise(x)


def new_date(x: Column, key: str) -> Column:
    day = F.datediff(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1970-01-01").cast("date")) - FIRST_DAY
    out = feistel(day.cast("long"), F.lit(DATE_A).cast("long"), F.lit(DATE_B).cast("long"), key, "date")
    return F.coalesce(F.when(day.between(0, DATE_A * DATE_B - 1), F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (out + FIRST_DAY).cast("int")), "yyyy-MM-dd")), x)


def new_email(x: Column, key: str) -> Column:
    """A Feistel network over the name's characters: each half is shifted, within the class of each character, by a keyed function of the other."""
    name, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    half = F.floor(F.length(name) / 2).cast("int")
    start = F.struct(F.substr(name, F.lit(1), half).alias("l"), F.substr(name, half + 1).alias("r"))

    def shifted(text: Column, other: Column, i: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            by = _round(key, "email", i * 1000 + at, other)
            code = F.ascii(c)
            turn = lambda low, n: F.chr((F.lit(low) + F.pmod(code - low + by, F.lit(n))).cast("long"))
            beyond = code.cast("long") - F.pmod(code, F.lit(16)) + F.pmod(code + by, F.lit(16))
            wide = F.decode(F.unhex(F.lpad(F.hex(beyond), 8, "0")), "UTF-32")
            out = F.when(code.between(97, 122), turn(97, 26)).when(code.between(65, 90), turn(65, 26)).when(code.between(48, 57), turn(48, 10))
            return out.when(code > 127, wide).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(shifted(s["r"], s["l"], i)).alias("r"))

    return F.concat(F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, step, lambda s: F.concat(s["l"], s["r"])), F.lit("@"), domain)


def kind_of(x: Column) -> Column:
    out = F.when(x.contains("@"), "email").when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
    return out.when(x.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip").when(x.rlike(r"^\d{13,19}$|^\d{4}[ -]\d{4}[ -]\d{4}|^\d{4}[ -]\d{6}"), "card").otherwise("phone")


def pseudonym(x: Column, key: str) -> Column:
    k = kind_of(x)
    return F.when(k == "email", new_email(x, key)).when(k == "ssn", new_ssn(x, key)).when(k == "date", new_date(x, key)).when(k == "ip", new_ip(x, key)).when(k == "card", new_card(x, key)).otherwise(new_phone(x, key))


def finds(text: Column) -> Column:
    """The candidates in a text, in order; null if it can't hold any."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def replaced(text: Column, found: Column, key: str) -> Column:
    """The text with each of its finds validated and replaced."""
    new = F.concat(F.transform(found, lambda x: pseudonym(x, key)), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), new, lambda a, b: F.concat(a, b)), "")
    return F.when(F.size(found) > 0, joined).otherwise(text)


def pseudonymised(text: Column, key: str = KEY) -> Column:
    """The whole text with every validated find replaced."""
    return replaced(text, finds(text), key)


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting; without it the public one, so that the queries run as they are."""
    return spark.conf.get(KEY_SETTING, KEY)


def hide_private(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` (and ``n_chars`` to match, if there); its columns otherwise unchanged. Without a key, the session's."""
    found = docs.withColumn("_pw_found", finds(docs["text"]))
    out = found.withColumn("text", replaced(F.col("text"), F.col("_pw_found"), key or session_key(docs.sparkSession)))
    out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    return out.select(*docs.columns)


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_found (candidates by pattern), changed (whether the text differs)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw"))
    found = docs.withColumn("found", finds(F.col("raw")))
    out = found.select("doc_id", "raw", replaced(F.col("raw"), F.col("found"), session_key(spark)).alias("text"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_found"))
    return out.select("doc_id", "text", "n_found", (~F.col("raw").eqNullSafe(F.col("text"))).alias("changed"))
