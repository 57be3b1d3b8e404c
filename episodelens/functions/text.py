"""Lenient casts, formats, names and JSON as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    """Trimmed text, '' for null."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def lenient_long(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("bigint")


def lenient_double(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def first_filled(*cs: Column) -> Column:
    """The first of the values that is neither null nor ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


def ns_seconds(c: Column) -> Column:
    """Nanoseconds as seconds with nine digits."""
    size = F.abs(c)
    second = F.lit(10**9)
    whole = ((size - size % second) / second).cast("bigint")
    return F.concat(F.when(c < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad((size % second).cast("string"), 9, "0"))


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("bigint")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit("m"), (whole % 60).cast("string"), F.lit("s"))


def file_name(c: Column) -> Column:
    """Letters, digits, CJK, '_' and '-' stay, other runs become '_'; blank gives 'unknown'."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z_\\x{4e00}-\\x{9fff}-]+", "_"), "^_+|_+$", "")
    return F.when(clean == "", "unknown").otherwise(clean)


def column_side(c: Column) -> Column:
    """Side that a column name tells: _l or _r in it, else its file name."""
    return F.when(F.contains(c, F.lit("_l")), "left").when(F.contains(c, F.lit("_r")), "right").otherwise(file_name(c))


def topic_side(c: Column) -> Column:
    """Side that a topic tells: _l/ or _r/ in it, else its file name."""
    return F.when(F.contains(c, F.lit("_l/")), "left").when(F.contains(c, F.lit("_r/")), "right").otherwise(file_name(c))


def tolerance_ns(policy: Column, default_ns: int = 3_000_000) -> Column:
    """Tolerance of a sync policy in milliseconds; blank: the default; exact_frame: 3 ms; others that are no number of 0 or more: null."""
    p = text(policy)
    ms = p.try_cast("double")
    return F.when(p == "", F.lit(default_ns).cast("bigint")).when(p == "exact_frame", F.lit(3_000_000).cast("bigint")).when(ms >= 0, F.bround(ms * 1e6).cast("bigint"))


def ordered_in(path: Column, names: Column) -> Column:
    """Do the names occur in path one after the other?"""
    step = lambda at, n: F.when((at > 0) & (F.position(n, path, at) > 0), F.position(n, path, at) + F.length(n)).otherwise(-1)
    return F.aggregate(names, F.lit(1), step) > 0
