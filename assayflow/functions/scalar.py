"""Scalar column helpers (X1-X10). All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_id(c) -> Column:
    """Cast to string, strip white space of any kind at both ends, remove
    every space."""
    stripped = F.regexp_replace(_c(c).cast("string"), r"(?U)^\s+|\s+$", "")
    return F.replace(stripped, F.lit(" "), F.lit(""))


def clean_visit(c) -> Column:
    """X2: 'Day 0' -> 'Day0'."""
    return F.replace(_c(c).cast("string"), F.lit(" "), F.lit(""))


def neg_log10(p) -> Column:
    """-log10(p); p == 0 gives +inf (as numpy does), p < 0 or NULL gives NULL."""
    p = _c(p)
    return (F.when(p == 0, F.lit(float("inf")))
            .when(p > 0, -F.log10(p)))


def log2_safe(x) -> Column:
    """log2 for positive values, NULL otherwise."""
    x = _c(x)
    return F.when(x > 0, F.log2(x))


def ratio(num, den) -> Column:
    """Num / den, NULL on a zero denominator (works with ANSI on)."""
    return F.try_divide(_c(num), _c(den))


def short_label(c, sep: str = ";") -> Column:
    """Text before the first separator, used as display label."""
    return F.split_part(_c(c), F.lit(sep), F.lit(1))


def last_path_segment(c) -> Column:
    """Base file name of a path."""
    return F.element_at(F.split(_c(c), "/"), -1)


def false_if_null(cond: Column) -> Column:
    """Three-valued logic collapsed so that missing means false."""
    return F.coalesce(cond, F.lit(False))


def nan_to_null(c) -> Column:
    """NaN -> NULL; the library's single notion of missing."""
    c = _c(c)
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def hash_uniform(*parts) -> Column:
    """Order-independent uniform in [0, 1) from md5 of the parts joined by '|'.

    The first 13 hex digits (52 bits) are read as an integer and scaled by
    2^-52, so the same value is reproducible in any engine with md5.
    """
    key = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substr(F.md5(key), F.lit(1), F.lit(13)), 16, 10).cast("double") / float(2 ** 52)
