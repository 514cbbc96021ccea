"""Every statistic of every bin from one table of counted values.

Usable rows are counted per (recording, bin, variable, value), with integer numbers for
bins and variables: how many rows hold the value, and how many of them are independent.
All statistics are read from this one table in one pass: ranks by running counts, so
quantiles and trimmed means, and weighted sums, so moments and logs. Ties (suppressed
zeros, steps of an analogue scale) collapse before anything is moved. Over a stored
timeline counting, ranking and reading all happen inside its buckets; where recordings are
cut into slices, counts are combined on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LOG_STAT_PREFIXES
from .bins import QUANTILES, bin_coverage, bin_labels, bin_of, check_edges, mask_below_minimum
from .ordered import is_sliced
from .orderstats import quantile, trimmed_mean
from .stored_timeline import REC, counted_ranks

GROUPS = [REC, "bin_id", "variable_id"]


def value_counts(rows: DataFrame, variables: list[str], edges: list[float], usable: str = "usable", masks: dict[str, str] | None = None, hours: str = "hours") -> DataFrame:
    """(REC, bin_id, variable_id, v, w_all, w): rows and independent rows of every value of usable rows."""
    check_edges(edges)
    masks = masks or {}
    number = F.array_position(F.array(*[F.lit(x) for x in bin_labels(edges)]), bin_of(hours, edges)).cast("int") - 1
    pack = F.array(*[F.struct(F.lit(i).alias("variable_id"), F.col(v).cast("double").alias("v"), (F.col(masks[v]) if v in masks else F.lit(True)).alias("own"))
                     for i, v in enumerate(variables)])
    long = rows.where(F.col(usable)).select(REC, number.alias("bin_id"), pack.alias("_p")).where("bin_id IS NOT NULL").select(REC, "bin_id", F.inline("_p"))
    return long.where("v IS NOT NULL").groupBy(*GROUPS, "v").agg(F.count(F.lit(1)).alias("w_all"), F.count_if("own").alias("w"))


def counted_statistics(counts: DataFrame, groups: list[str], logs: Column) -> DataFrame:
    """One row per group: n_observed, n and all statistics of the independent values; log statistics where ``logs`` holds."""
    v, w = F.col("v"), F.col("w")
    whole = Window.partitionBy(*groups)
    ln = F.when(logs & (v > 0), F.ln(v))
    known = F.when(ln.isNotNull(), w).otherwise(0)
    ranked = counted_ranks(counts, groups).withColumns({
        "_mean": F.try_divide(F.sum(v * w).over(whole), F.col("n")), "_ln": ln, "_n_ln": F.sum(known).over(whole),
        "_mean_ln": F.try_divide(F.sum(ln * w).over(whole), F.sum(known).over(whole))})
    spread = lambda x, mean, n: F.when(n == 1, F.lit(0.0)).when(n > 1, F.sqrt(F.try_divide(F.sum(w * F.pow(x - mean, F.lit(2.0))), n - 1)))
    n, n_ln, mean, mean_ln = (F.max(c) for c in ("n", "_n_ln", "_mean", "_mean_ln"))
    out = ranked.groupBy(*groups).agg(
        F.sum("w_all").alias("n_observed"), n.alias("n"), mean.alias("mean"), spread(v, F.col("_mean"), n).alias("sd"), F.min(F.when(w > 0, v)).alias("min"),
        F.max(F.when(w > 0, v)).alias("max"), F.exp(mean_ln).alias("log_mean"), spread(F.col("_ln"), F.col("_mean_ln"), n_ln).alias("log_sd"),
        quantile(0.5).alias("median"), *[quantile(p).alias(name) for name, p in QUANTILES.items()], trimmed_mean(0.1).alias("trimmed_mean_20pct"))
    return out.withColumns({"n_effective": F.col("n"), "iqr": F.col("p75") - F.col("p25"), "cv": F.when(F.col("mean") > 1e-10, F.col("sd") / F.col("mean"))})


def aggregate_timeline(rows: DataFrame, variables: list[str], edges: list[float], *, usable: str = "usable", masks: dict[str, str] | None = None,
                       basis: dict[str, str] | None = None, **coverage) -> DataFrame:
    """The full bin summary of ``bins.aggregate_bins`` for the rows of a stored timeline (with hours, support and masks)."""
    masks, basis = masks or {}, basis or {}
    plain = rows.drop("_hot", "_slice") if is_sliced(rows) else rows
    cover = bin_coverage(plain, [REC], edges, usable, masks=sorted(set(masks.values())) or None, **coverage)
    labels = F.array(*[F.lit(x) for x in bin_labels(edges)])
    logs = F.col("variable_id").isin([i for i, v in enumerate(variables) if v.startswith(tuple(LOG_STAT_PREFIXES))])
    stats = counted_statistics(value_counts(rows, variables, edges, usable, masks), GROUPS, logs)
    named = F.array(*[F.struct(F.lit(i).alias("variable_id"), F.lit(v).alias("feature"), F.lit(basis.get(v, "engine_cadence_adjusted") if v in masks else "row_count").alias("_basis"),
                               F.lit(basis.get(v, "not_estimated")).alias("_empty")) for i, v in enumerate(variables)])
    frame = cover.withColumn("bin_id", F.array_position(labels, F.col("bin_label")).cast("int") - 1).select("*", F.inline(named))
    joined = mask_below_minimum(frame.join(stats, GROUPS, "left").withColumn("n", F.coalesce("n", F.lit(0))))
    per = Window.partitionBy(REC, "variable_id")
    point = F.when(F.col("meets_minimum"), F.col("median"))
    slope = F.when(F.count(point).over(per) >= 2, F.regr_slope(point, (F.col("bin_start") + F.col("bin_end")) / 2.0).over(per))
    return joined.withColumns({"effective_basis": F.when(F.col("meets_minimum"), F.col("_basis")).otherwise(F.col("_empty")), "slope": slope}).drop(
        "_basis", "_empty", "bin_id", "variable_id")
