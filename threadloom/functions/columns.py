"""Scalar column expressions: names, times, months, safe arithmetic and placeholder tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python's str.strip() removes.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0        "
    "        　"
)
# Bodies, titles and authors that stand for something taken away.
PLACEHOLDERS = ("[deleted]", "[removed]")
DAY_SECONDS = 86400
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799  # years 1 to 9999


def strip(c: Column) -> Column:
    """Without outer blanks, Unicode blanks included."""
    return F.trim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def drop_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def compare_name(c: Column) -> Column:
    """Community name for comparison: stripped, lower case, without a leading ``r/``; null if nothing is left."""
    name = drop_prefix(F.lower(strip(c)), "r/")
    return F.when(name != "", name)


def post_key(c: Column) -> Column:
    """Submission id for comparison: stripped, lower case, without a leading ``t3_``; null if nothing is left."""
    key = drop_prefix(F.lower(strip(c)), "t3_")
    return F.when(key != "", key)


def is_placeholder(c: Column) -> Column:
    """True for a placeholder in any case and padding, never null."""
    return F.coalesce(F.lower(strip(c)).isin(*PLACEHOLDERS), F.lit(False))


def valid_author(c: Column) -> Column:
    """Stripped author name; null for null, blank and placeholder names."""
    return F.when(~is_placeholder(c) & (strip(c) != ""), strip(c))


def author_as_written(c: Column) -> Column:
    """Author as stored, null for null, empty and placeholder names (tested without case and padding)."""
    return F.when(~is_placeholder(c) & (c != ""), c)


def epoch_seconds(c: Column) -> Column:
    """Whole seconds from a number or numeric text, truncated toward zero; null if unreadable."""
    return c.cast("string").try_cast("double").try_cast("bigint")


def valid_second(c: Column) -> Column:
    return F.when(c.between(FIRST_SECOND, LAST_SECOND), c.cast("long"))


def epoch_day(c: Column) -> Column:
    """UTC date of epoch seconds, whatever the session's time zone; null outside years 1 to 9999."""
    return F.date_from_unix_date(F.floor(valid_second(c) / DAY_SECONDS).cast("int"))


def epoch_month(c: Column) -> Column:
    """UTC month as ``YYYY-MM``."""
    return F.date_format(epoch_day(c), "yyyy-MM")


def month_index(c: Column) -> Column:
    """Number of a ``YYYY-MM`` month for arithmetic: year * 12 + month - 1; null if unreadable."""
    year, month = F.substring(c, 1, 4).try_cast("int"), F.substring(c, 6, 2).try_cast("int")
    return F.when(c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), year * 12 + month - 1)


def index_month(c: Column) -> Column:
    """The ``YYYY-MM`` month of a month number."""
    return F.format_string("%04d-%02d", F.floor(c / 12).cast("int"), (F.pmod(c, F.lit(12)) + 1).cast("int"))


def share(part: Column, whole: Column) -> Column:
    """Quotient as double, 0.0 where the denominator is zero or either side is null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def shard_of(c: Column, n: int) -> Column:
    """Shard number by CRC-32 of the UTF-8 bytes."""
    return F.pmod(F.crc32(F.encode(c, "utf-8")), F.lit(n)).cast("int")


def unordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)
