"""Exact order statistics for groups of any size.

``percentile()`` keeps every distinct value of a group in one aggregation buffer.
Here values are first counted per (group, value) with map-side combine, so ties
(suppressed zeros, regular time steps) collapse, then ranked by
:func:`tracelake.operators.ordered.index_rows`, which splits large groups. Every
quantile and trimmed mean is then a conditional aggregate over ranked values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import index_rows, join_keys, strip_layout


def ranked_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, w, lo, n): distinct value, its count, first rank from 0, group size."""
    known = df.where(F.col(value).isNotNull())
    counted = (
        known.groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    return strip_layout(index_rows(counted, keys, ["v"], weight="w", row="lo", total="n", sizes_of=known))


def _at(rank: Column) -> Column:
    inside = (F.col("lo") <= rank) & (rank < F.col("lo") + F.col("w"))
    return F.max(F.when(inside, F.col("v")))


def quantile(p: float) -> Column:
    """Aggregate over ranked values: linear interpolation between order statistics."""
    pos = (F.col("n") - 1) * F.lit(float(p))
    low = F.floor(pos)
    high = F.least(low + 1, F.col("n") - 1)
    frac = F.max(pos - low)
    return _at(low) + (_at(high) - _at(low)) * frac


def trimmed_mean(share: float, minimum: int = 4) -> Column:
    """Mean without the lowest and highest ``share``; plain mean below ``minimum`` values."""
    cut = F.when(F.col("n") >= minimum, F.floor(F.col("n") * F.lit(float(share)))).otherwise(F.lit(0))
    first = F.greatest(F.col("lo"), cut)
    last = F.least(F.col("lo") + F.col("w"), F.col("n") - cut)
    kept = F.greatest(last - first, F.lit(0))
    return F.try_divide(F.sum(F.col("v") * kept), F.sum(kept))


def order_stats(df: DataFrame, keys: list[str], value: str, **stats: Column) -> DataFrame:
    """One row per group with the given aggregates over ranked values."""
    ranked = ranked_values(df, keys, value)
    return ranked.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])


def group_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return order_stats(df, keys, value, **{out: quantile(0.5)})


def with_group_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Attach the group's exact median to every row."""
    return join_keys(df, group_median(df, keys, value, out), keys, "left")


def average_rank(df: DataFrame, keys: list[str], value: str, out: str = "avg_rank") -> DataFrame:
    """(keys, value, rank) with ties sharing the mean of their ranks, counted from 1."""
    return ranked_values(df, keys, value).select(
        *keys, F.col("v").alias(value), (F.col("lo") + (F.col("w") + 1) / 2.0).alias(out))
