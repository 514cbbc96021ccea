"""Time-bin aggregation: statistics, effective counts, coverage, slopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CONTINUITY_THRESHOLD, LOG_STAT_PREFIXES, MIN_COVERAGE_HOURS, MISSINGNESS_LIMITS
from ..functions.numbers import count_where, share
from .ordered import join_keys
from .orderstats import order_stats, quantile, trimmed_mean

QUANTILES = {"p05": 0.05, "p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def check_edges(edges: list[float]) -> None:
    if len(edges) < 2 or edges[0] < 0 or any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("bin edges must be non-negative, increasing and at least two")


def bin_labels(edges: list[float]) -> list[str]:
    return [f"{a:.0f}-{b:.0f}h" for a, b in zip(edges, edges[1:])]


def bin_table(spark: SparkSession, edges: list[float]) -> DataFrame:
    """One row per configured bin (a handful, from the configuration)."""
    check_edges(edges)
    rows = [(lab, float(a), float(b)) for lab, a, b in zip(bin_labels(edges), edges, edges[1:])]
    return spark.createDataFrame(rows, "bin_label string, bin_start double, bin_end double")


def bin_of(hours: str, edges: list[float]) -> Column:
    """Label of the half-open bin holding ``hours``; null outside all bins."""
    h = F.col(hours)
    out = None
    for lab, a, b in zip(bin_labels(edges), edges, edges[1:]):
        cond = (h >= float(a)) & (h < float(b))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def assign_bins(df: DataFrame, edges: list[float], hours: str = "hours", out: str = "bin_label") -> DataFrame:
    check_edges(edges)
    return df.withColumn(out, bin_of(hours, edges))


def moment_columns(v: Column) -> dict[str, Column]:
    """n, mean, sd (0 for one value), min, max, geometric mean and log sd of positives."""
    ln = F.when(v > 0, F.ln(v))
    return {
        "n": F.count(v),
        "mean": F.avg(v),
        "sd": F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v)),
        "min": F.min(v),
        "max": F.max(v),
        "log_mean": F.exp(F.avg(ln)),
        "log_sd": F.when(F.count(ln) == 1, F.lit(0.0)).otherwise(F.stddev_samp(ln)),
    }


def moments(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    return df.groupBy(*groups).agg(*[c.alias(n) for n, c in moment_columns(F.col(value)).items()])


def has_log_stats(feature: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(feature).startswith(p) for p in LOG_STAT_PREFIXES])


def bin_stats(df: DataFrame, groups: list[str], value: str, mask: Column | None = None) -> DataFrame:
    """Every statistic of a value per group, plus observed and effective counts.

    ``mask`` marks independent rows; statistics use those only, ``n_observed``
    counts all present values.
    """
    kept = F.when(mask, F.col(value)) if mask is not None else F.col(value)
    base = df.groupBy(*groups).agg(F.count(value).alias("n_observed"), *[c.alias(n) for n, c in moment_columns(kept).items()])
    used = df.where(mask) if mask is not None else df
    stats = {n: quantile(p) for n, p in QUANTILES.items()}
    ranked = order_stats(used, groups, value, median=quantile(0.5), trimmed_mean_20pct=trimmed_mean(0.1), **stats)
    out = join_keys(base, ranked, groups, "left")
    return out.withColumns({
        "n": F.coalesce("n", F.lit(0)),
        "n_effective": F.coalesce("n", F.lit(0)),
        "iqr": F.col("p75") - F.col("p25"),
        "cv": F.when(F.col("mean") > 1e-10, F.col("sd") / F.col("mean")),
    })


STAT_COLUMNS = ["median", "mean", "sd", *QUANTILES, "iqr", "min", "max", "trimmed_mean_20pct", "cv", "log_mean", "log_sd"]


def mask_below_minimum(df: DataFrame, meets: str = "meets_minimum") -> DataFrame:
    """Bins under the coverage limit keep their row but lose statistics and counts."""
    ok = F.col(meets)
    new = {c: F.when(ok, F.col(c)) for c in [*STAT_COLUMNS, "n"] if c in df.columns}
    new |= {c: F.when(ok, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)) for c in ("n_observed", "n_effective") if c in df.columns}
    return df.withColumns(new)


def bin_coverage(df: DataFrame, keys: list[str], edges: list[float], usable: str = "usable", support: str = "support_hours",
                 min_hours: float = MIN_COVERAGE_HOURS, masks: list[str] | None = None, event: str | None = None,
                 event_base: str | None = None, suppression: list[str] | None = None,
                 threshold: float = CONTINUITY_THRESHOLD) -> DataFrame:
    """One row per key and configured bin, also for bins without epochs.

    Counts, observed / clean hours and fractions, minimum test, missingness class;
    with ``masks`` the smallest effective count, with ``event`` its hours over
    artifact-clean epochs, with ``suppression`` the continuity index.
    """
    u = F.col(usable)
    aggs = [
        F.count(F.lit(1)).alias("n_total_epochs"),
        count_where(u).alias("n_usable_epochs"),
        F.sum(support).alias("observed_hours"),
        F.sum(F.when(u, F.col(support))).alias("clean_hours"),
    ]
    for m in masks or []:
        aggs.append(count_where(u & F.col(m)).alias(f"n_effective_{m}"))
    if event:
        base = F.col(event_base) if event_base else u
        aggs.append(F.sum(F.when(F.col(event) & base, F.col(support))).alias("event_hours"))
    if suppression:
        valid = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in suppression])
        below = reduce(lambda a, b: a & b, [F.col(c) < threshold for c in suppression])
        aggs += [count_where(u & valid & below).alias("_below"), count_where(u & valid).alias("_valid")]
    binned = assign_bins(df, edges).where(F.col("bin_label").isNotNull()).groupBy(*keys, "bin_label").agg(*aggs)
    frame = df.select(*keys).distinct().withColumn("_bins", F.array(*[
        F.struct(F.lit(lab).alias("bin_label"), F.lit(float(a)).alias("bin_start"), F.lit(float(b)).alias("bin_end"))
        for lab, a, b in zip(bin_labels(edges), edges, edges[1:])
    ])).select(*keys, F.inline("_bins"))
    out = join_keys(frame, binned, [*keys, "bin_label"], "left")
    counts = ["n_total_epochs", "n_usable_epochs", *[f"n_effective_{m}" for m in masks or []]]
    new = {c: F.coalesce(c, F.lit(0)) for c in counts}
    new |= {c: F.coalesce(c, F.lit(0.0)) for c in ["observed_hours", "clean_hours", *(["event_hours"] if event else [])]}
    out = out.withColumns(new).withColumns({
        "expected_hours": F.col("bin_end") - F.col("bin_start"),
        "clean_of_observed": share(F.col("clean_hours"), F.col("observed_hours")),
        "clean_of_expected": F.col("clean_hours") / (F.col("bin_end") - F.col("bin_start")),
        "meets_minimum": F.col("clean_hours") >= min_hours,
    })
    if masks:
        names = [F.col(f"n_effective_{m}") for m in masks]
        out = out.withColumn("n_effective_cadence", F.least(*names) if len(names) > 1 else names[0])
    if suppression:
        out = out.withColumn("continuity_index", F.try_divide("_below", "_valid")).drop("_below", "_valid")
    return out.withColumn("missingness", missingness())


def missingness(total: str = "n_total_epochs", fraction: str = "clean_of_expected") -> Column:
    out = F.when(F.col(total) == 0, F.lit("no_data"))
    for name, limit in MISSINGNESS_LIMITS:
        out = out.when(F.col(fraction) >= limit, F.lit(name))
    return out.otherwise(F.lit("low_data"))


def bin_slopes(df: DataFrame, groups: list[str], median: str = "median", meets: str = "meets_minimum",
               start: str = "bin_start", end: str = "bin_end") -> DataFrame:
    """Slope of the median over bin midpoints, from two valid bins on."""
    mid = (F.col(start) + F.col(end)) / 2.0
    ok = df.where(F.col(meets) & F.col(median).isNotNull())
    return ok.groupBy(*groups).agg(
        F.when(F.count(F.lit(1)) >= 2, F.regr_slope(F.col(median), mid)).alias("slope"))


def aggregate_bins(df: DataFrame, keys: list[str], variables: list[str], edges: list[float], *, usable: str = "usable",
                   masks: dict[str, str] | None = None, basis: dict[str, str] | None = None, **coverage) -> DataFrame:
    """The full bin summary in long form: one row per key, bin and variable.

    ``masks`` maps a variable to its independent-row column, ``basis`` to the label
    of its effective count. Variables go through one unpivot of the usable rows.
    """
    masks, basis = masks or {}, basis or {}
    cover = bin_coverage(df, keys, edges, usable, masks=sorted(set(masks.values())) or None, **coverage)
    binned = assign_bins(df, edges).where(F.col(usable) & F.col("bin_label").isNotNull())
    pack = F.array(*[
        F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("value"),
                 (F.col(masks[v]) if v in masks else F.lit(True)).alias("independent"))
        for v in variables
    ])
    long = binned.select(*keys, "bin_label", F.inline(pack))
    groups = [*keys, "bin_label", "feature"]
    stats = bin_stats(long, groups, "value", F.col("independent"))
    stats = stats.withColumns({c: F.when(has_log_stats("feature"), F.col(c)) for c in ("log_mean", "log_sd")})
    features = F.array(*[
        F.struct(F.lit(v).alias("feature"), F.lit(basis.get(v, "engine_cadence_adjusted") if v in masks else "row_count").alias("basis"),
                 F.lit(basis.get(v, "not_estimated")).alias("empty_basis")) for v in variables])
    frame = cover.select("*", F.inline(features))
    joined = mask_below_minimum(join_keys(frame, stats, groups, "left"))
    joined = joined.withColumn("effective_basis", F.when(F.col("meets_minimum"), F.col("basis")).otherwise(F.col("empty_basis")))
    slopes = bin_slopes(joined, [*keys, "feature"])
    return join_keys(joined.drop("basis", "empty_basis"), slopes, [*keys, "feature"], "left")
