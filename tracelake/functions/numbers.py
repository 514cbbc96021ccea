"""Small numeric expressions with pandas-like null rules, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_nan(c: str | Column) -> Column:
    """NaN and infinities become null, as missing samples are stored."""
    c = col_of(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def is_zero(c: str | Column) -> Column:
    """True only for a present zero (missing is not zero)."""
    return F.coalesce(col_of(c) == 0, F.lit(False))


def non_zero_or_missing(c: str | Column) -> Column:
    return F.coalesce(col_of(c) != 0, F.lit(True))


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def rounded(c: Column, digits: int = 6) -> Column:
    """Round for comparison; the small shift keeps exact decimal halves from splitting engines."""
    return F.round(c + F.lit(1e-9), digits)


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` with 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
