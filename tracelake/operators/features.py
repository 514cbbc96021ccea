"""Per-epoch features and independent-observation masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import micros_between
from ..functions.numbers import col_of
from .ordered import neighbours, running
from .timebase import GAP_SECONDS

# Floor of the log ratio, spike rate threshold per second.
LOG_FLOOR = 1e-6
SPIKE_RATE = 1.5


def sides_contributing(left: str | Column, right: str | Column) -> Column:
    return col_of(left).isNotNull().cast("int") + col_of(right).isNotNull().cast("int")


def bilateral_mean(left: str | Column, right: str | Column, require_both: bool = False) -> Column:
    l, r = col_of(left), col_of(right)
    both = (l + r) / 2.0
    return both if require_both else F.coalesce(both, l, r)


def regional_features(df: DataFrame, bands: list[str], require_both: bool = False,
                      pattern: str = "fft_{band}_{side}_{region}") -> DataFrame:
    """Anterior / posterior means per band; a column the export already has wins."""
    new = {}
    for band in bands:
        for region in ("anterior", "posterior"):
            name = f"fft_{band}_{region}"
            left, right = (pattern.format(band=band, side=s, region=region) for s in ("left", "right"))
            if name in df.columns or left not in df.columns or right not in df.columns:
                continue
            new[name] = bilateral_mean(left, right, require_both)
            new[f"{name}_sides_contributing"] = sides_contributing(left, right)
    return df.withColumns(new) if new else df


def total_power(*bands: str | Column) -> Column:
    return reduce(lambda a, b: a + b, [col_of(b) for b in bands])


def relative_power(band: str | Column, total: str | Column) -> Column:
    return F.try_divide(col_of(band), col_of(total))


band_ratio = relative_power


def log_band_ratio(num: str | Column, den: str | Column) -> Column:
    n, d = col_of(num), col_of(den)
    ratio = F.log10(F.greatest(n, F.lit(LOG_FLOOR)) / F.greatest(d, F.lit(LOG_FLOOR)))
    return F.when(n.isNotNull() & d.isNotNull(), ratio)


def derived_features(df: DataFrame, region: str) -> DataFrame:
    """Total and relative power and band ratios of a region; native columns win."""
    band = lambda b: f"fft_{b}_{region}"
    bands = ["delta", "theta", "alpha", "beta"]
    if any(band(b) not in df.columns for b in bands):
        return df
    total = total_power(*[band(b) for b in bands])
    new = {f"total_power_{region}": total}
    for b in bands:
        if f"rel_{b}_{region}" not in df.columns:
            new[f"rel_{b}_{region}"] = relative_power(band(b), total)
    for b in ("theta", "alpha"):
        new[f"{b}_delta_ratio_{region}"] = band_ratio(band(b), band("delta"))
        new[f"log_{b}_delta_ratio_{region}"] = log_band_ratio(band(b), band("delta"))
    return df.withColumns(new)


def independent_masks(df: DataFrame, keys: list[str], groups: dict[str, tuple[list[str], int]], ts: str | None = None,
                      gap_seconds: float = GAP_SECONDS) -> DataFrame:
    """Mask per group of columns that update together, true on independent rows.

    ``groups`` maps the mask's name to (columns, interval). A row is independent if
    it is the first, if a listed column changed from the previous row (both
    present), or every ``interval`` rows after the last such row. With the clock ``ts``
    counting begins again after a gap of more than ``gap_seconds``: instruments have
    updated since, even if to an equal value. ``df`` comes from ``index_rows``.
    """
    cols = sorted({c for columns, _ in groups.values() for c in columns})
    linked = neighbours(df, keys, prev={f"_was_{c}": c for c in cols} | ({"_was_at": ts} if ts else {}))
    begins = {}
    for name, (columns, _) in groups.items():
        changed = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) != F.col(f"_was_{c}"), F.lit(False)) for c in columns])
        if ts:
            changed = changed | F.coalesce(micros_between("_was_at", ts) > F.lit(gap_seconds * 1e6), F.lit(False))
        begins[f"_at_{name}"] = ("max", F.when((F.col("row_idx") == 0) | changed, F.col("row_idx")))
    marked = running(linked, keys, begins)
    masks = {name: (F.col("row_idx") - F.col(f"_at_{name}")) % F.lit(interval) == 0 for name, (_, interval) in groups.items()}
    return marked.withColumns(masks).drop(*[f"_was_{c}" for c in cols], "_was_at", *[f"_at_{n}" for n in groups])


def independent_mask(df: DataFrame, keys: list[str], columns: list[str], interval: int, out: str = "is_independent") -> DataFrame:
    if not columns:
        return df.withColumn(out, F.lit(True))
    return independent_masks(df, keys, {out: (columns, interval)})


def keep_independent(df: DataFrame, keys: list[str], columns: list[str], interval: int) -> DataFrame:
    return independent_mask(df, keys, columns, interval, "_ind").where("_ind").drop("_ind")


def select_analysis_variables(column_dict: DataFrame, families: list[str], prefixes: list[str],
                              name: str = "common_name", family: str = "family") -> DataFrame:
    """Dictionary rows whose family is analysed or whose name is a derived feature."""
    wanted = F.col(family).isin(families)
    for p in prefixes:
        wanted = wanted | F.col(name).startswith(p)
    return column_dict.where(wanted)


def spike_flags(left: str | Column, right: str | Column, generalized: str | Column, rate: float = SPIKE_RATE) -> dict[str, Column]:
    """0/1 flags, null when an input they need is missing."""
    l, r, g = col_of(left), col_of(right), col_of(generalized)
    both_known = l.isNotNull() & r.isNotNull()
    flag = lambda known, cond: F.when(known, cond.cast("int"))
    return {
        "left_only": flag(both_known, (l >= rate) & (r < rate)),
        "right_only": flag(both_known, (r >= rate) & (l < rate)),
        "bilateral": flag(both_known, (l >= rate) & (r >= rate)),
        "generalized": flag(g.isNotNull(), g >= rate),
    }


def identity_checks(df: DataFrame, keys: list[str], *, ordered: list[str] | None = None, one_hot: list[str] | None = None,
                    sums_to_one: list[str] | None = None, pair: tuple[str, str] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Do columns behave as their names say: ordering, one-hot, unit sums, pair agreement."""
    aggs = []
    if ordered:
        cond = reduce(lambda a, b: a & b, [F.col(a) <= F.col(b) for a, b in zip(ordered, ordered[1:])])
        aggs.append(F.avg(cond.cast("double")).alias("ordered_share"))
    if one_hot:
        aggs.append(F.avg((total_power(*one_hot) == 1).cast("double")).alias("one_hot_share"))
    if sums_to_one:
        aggs.append(F.avg((F.abs(total_power(*sums_to_one) - 1.0) < tolerance).cast("double")).alias("unit_sum_share"))
    if pair:
        a, b = pair
        aggs += [F.max(F.abs(F.col(a) - F.col(b))).alias("pair_max_diff"), F.corr(a, b).alias("pair_corr")]
    return df.groupBy(*keys).agg(*aggs)
