"""Profiling and reconciliation: column profiles, rank correlation, recompute audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_zero
from ..sources.workdir import stored
from .merge import to_long
from .ordered import index_rows, join_keys, neighbours, strip_layout
from .orderstats import order_stats, quantile
from .retrieve import bin_frequency

# Tolerances of the recompute audit.
TOLERANCES = {"count": 0.0, "fraction": 1e-6, "numeric": 1e-6, "percent": 1e-4}
# Fixed value: relative error of means that the order of adding may cause.
RATIO_TOLERANCE = 1e-12


def column_profile(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, nulls, range, p01 / median / p99, distinct values and binary test per column."""
    v = F.col(value)
    base = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("n_null"),
        F.bool_and(v.isin(0.0, 1.0)).alias("_bin"))
    ranked = order_stats(long, keys, value, min=F.min("v"), p01=quantile(0.01), median=quantile(0.5), p99=quantile(0.99),
                         max=F.max("v"), n_distinct=F.count(F.lit(1)))
    out = join_keys(base, ranked, keys, "left")
    return out.withColumns({
        "pct_null": F.lit(100.0) * F.col("n_null") / F.col("n"),
        "n_distinct": F.coalesce("n_distinct", F.lit(0)),
        "is_binary": F.coalesce("_bin", F.lit(False)),
    }).drop("_bin")


def review_flags(columns: DataFrame, keys: list[str], name: str = "common_name", family: str = "family") -> DataFrame:
    """UNCLASSIFIED / COLLISION(xN) / INVALID_IDENTIFIER, or OK."""
    counts = columns.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_k"))
    out = join_keys(columns, counts, [*keys, name])
    flags = F.array_compact(F.array(
        F.when(F.coalesce(F.col(family), F.lit("")).isin("", "other"), F.lit("UNCLASSIFIED")),
        F.when(F.col("_k") > 1, F.concat(F.lit("COLLISION(x"), F.col("_k").cast("string"), F.lit(")"))),
        F.when(~F.coalesce(F.col(name), F.lit("")).rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit("INVALID_IDENTIFIER"))))
    return out.withColumn("review_flag", F.when(F.size(flags) > 0, F.array_join(flags, ";")).otherwise("OK")).drop("_k")


def spectrogram_profile(df: DataFrame, keys: list[str], array: str, family: str, expected: int) -> DataFrame:
    """Width, range, bin with the highest median and its frequency, share of nulls."""
    long = df.select(*keys, F.posexplode(array).alias("_p", "v0")).withColumn("v0", F.col("v0").cast("double"))
    base = long.groupBy(*keys).agg(
        F.countDistinct("_p").alias("width"), F.min("v0").alias("global_min"), F.max("v0").alias("global_max"),
        (F.lit(100.0) * F.count_if(F.col("v0").isNull()) / F.count(F.lit(1))).alias("pct_null"))
    med = order_stats(long, [*keys, "_p"], "v0", med=quantile(0.5))
    peak = med.groupBy(*keys).agg((F.max_by("_p", F.struct("med", -F.col("_p"))) + 1).alias("peak_bin"))
    out = join_keys(base, peak, keys, "left")
    return out.withColumns({"width_ok": F.col("width") == expected, "peak_hz": bin_frequency(family, "peak_bin")})


def _mean_ranks(values: DataFrame, weights: list[str], name: str) -> DataFrame:
    """(_col, _v, weights) with ``r_<weight>``: the mean rank of a value of its column among the rows that the weight counts.

    Values, each once, are dealt by range and stored with the number of their range, so no task orders a whole column; what
    lies before a range is one small row per range and column.
    """
    placed = stored(values.repartitionByRange("_col", "_v").withColumn("_range", F.spark_partition_id()), name)
    before = Window.partitionBy("_col").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_col", "_range").agg(*[F.sum(w).alias(w) for w in weights])
    starts = totals.select("_col", "_range", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"_before_{w}") for w in weights])
    inside = Window.partitionBy("_col", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = placed.withColumns({f"r_{w}": F.sum(w).over(inside) for w in weights}).join(F.broadcast(stored(starts, "starts")), ["_col", "_range"])
    return upto.select("_col", *[c for c in values.columns if c != "_col"], *[
        (F.col(f"r_{w}") + F.col(f"_before_{w}") - (F.col(w) - 1) / 2.0).alias(f"r_{w}") for w in weights])


def spearman(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(a, b, r): rank correlation of every left with every right column.

    Every pair uses the rows in which both are present, ties sharing the mean rank. The values
    of a left column are counted once, with a weight per right column, and ranked for all its
    pairs in one order; rows get these ranks by value. The values of a right column are then
    counted once, with the sum of the left ranks of their rows, so no table has a row per pair
    and row, and a column is ordered once, in ranges.
    """
    lefts, rights = range(len(left)), range(len(right))
    rows = df.select(*[F.col(a).cast("double").alias(f"x{j}") for j, a in enumerate(left)], *[F.col(b).cast("double").alias(f"y{i}") for i, b in enumerate(right)])

    def counted(table: DataFrame, structs: list[Column], *aggs: Column) -> DataFrame:
        each = table.select(F.explode(F.array(*structs)).alias("_p")).select("_p.*")
        return each.where(F.col("_v").isNotNull()).groupBy("_col", "_v").agg(*aggs)

    xs = [F.struct(F.lit(j).alias("_col"), F.col(f"x{j}").alias("_v"), *[F.col(f"y{i}").isNotNull().alias(f"w{i}") for i in rights]) for j in lefts]
    values = counted(rows, xs, *[F.count_if(f"w{i}").alias(f"w{i}") for i in rights])
    ranks = stored(_mean_ranks(values, [f"w{i}" for i in rights], "left_values"), "left_ranks")
    for j in lefts:
        part = ranks.where(F.col("_col") == j).select(F.col("_v").alias(f"x{j}"), *[F.col(f"r_w{i}").alias(f"x{j}_{i}") for i in rights])
        rows = rows.join(part, f"x{j}", "left")
    ys = [F.struct(F.lit(i).alias("_col"), F.col(f"y{i}").alias("_v"), *[F.col(f"x{j}_{i}").alias(f"x{j}") for j in lefts]) for i in rights]
    per_left = [c for j in lefts for c in (F.count(f"x{j}").alias(f"w{j}"), F.sum(f"x{j}").alias(f"s{j}"))]
    ranked = _mean_ranks(counted(rows, ys, *per_left), [f"w{j}" for j in lefts], "right_values")

    def sums(table: DataFrame, own: str, other: str, others: range, each: Callable[[int], dict[str, Column]]) -> DataFrame:
        per = [F.struct(F.lit(k).alias(other), *[F.sum(c).alias(n) for n, c in each(k).items()]) for k in others]
        return table.groupBy(F.col("_col").alias(own)).agg(F.array(*per).alias("_p")).select(own, F.explode("_p").alias("_p")).select(own, "_p.*")

    w, rank = (lambda k: F.col(f"w{k}")), (lambda k: F.col(f"r_w{k}"))
    of_x = sums(ranks, "_a", "_b", rights, lambda i: {"n": w(i), "x": w(i) * rank(i), "xx": w(i) * rank(i) * rank(i)})
    of_y = sums(ranked, "_b", "_a", lefts, lambda j: {"y": w(j) * rank(j), "yy": w(j) * rank(j) * rank(j), "xy": F.col(f"s{j}") * rank(j)})
    spread = lambda c: F.col(c + c) - F.col(c) * F.col(c) / F.col("n")
    r = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.sqrt(spread("x") * spread("y")))
    name = lambda names, k: F.get(F.array(*map(F.lit, names)), k)
    return of_x.where("n > 0").join(of_y, ["_a", "_b"]).select(name(left, F.col("_a")).alias("a"), name(right, F.col("_b")).alias("b"), r.alias("r"))


def top_partners(pairs: DataFrame) -> DataFrame:
    """Two best partners of every left column and their lead over the third."""
    w = Window.partitionBy("a").orderBy(F.col("r").desc(), "b")
    ranked = pairs.withColumn("k", F.row_number().over(w)).where("k <= 3")
    at = lambda i, c: F.max(F.when(F.col("k") == i, F.col(c)))
    return ranked.groupBy("a").agg(at(1, "b").alias("first"), at(2, "b").alias("second"), at(1, "r").alias("r_first"), at(2, "r").alias("r_second"),
                                   (at(2, "r") - at(3, "r")).alias("separation"))


def pairing_score(partners: DataFrame, candidate: DataFrame) -> DataFrame:
    """How many recovered pairs match a candidate pairing (a, x, y)."""
    j = partners.join(candidate, "a")
    same = (F.least("first", "second") == F.least("x", "y")) & (F.greatest("first", "second") == F.greatest("x", "y"))
    return j.agg(F.count_if(same).alias("matched"), F.count(F.lit(1)).alias("of"))


def window_coverage(long: DataFrame, keys: list[str], windows: dict[str, tuple[float, float]], hours: str = "hours", value: str = "value") -> DataFrame:
    """Per column and time window: rows, null share, mean, min, max, in one pass."""
    h = F.col(hours)
    tag = None
    for name, (lo, hi) in windows.items():
        cond = (h >= lo) & (h < hi)
        tag = F.when(cond, F.lit(name)) if tag is None else tag.when(cond, F.lit(name))
    return long.withColumn("span", tag).where(F.col("span").isNotNull()).groupBy(*keys, "span").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("n_null"), F.avg(value).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max")).withColumn("null_share", F.col("n_null") / F.col("n"))


def coverage_changes(cover: DataFrame, keys: list[str], early: str, late: str) -> DataFrame:
    """Columns lost, gained, flipped to missing, or with a mean shifted by more than a factor of two.

    A factor within ``RATIO_TOLERANCE`` of two is two: the last digits of a mean depend on the
    order in which its rows were added up, and must not decide.
    """
    at = lambda w, c: F.max(F.when(F.col("span") == w, F.col(c)))
    wide = cover.groupBy(*keys).agg(at(early, "null_share").alias("e"), at(late, "null_share").alias("l"), at(early, "mean").alias("em"), at(late, "mean").alias("lm"))
    ratio = F.when(F.abs("em") > 1e-9, F.col("lm") / F.col("em"))
    return wide.select(
        *keys,
        F.coalesce((F.col("e") < 0.5) & F.coalesce(F.col("l") >= 0.5, F.lit(True)), F.lit(False)).alias("lost"),
        F.coalesce((F.col("l") < 0.5) & F.coalesce(F.col("e") >= 0.5, F.lit(True)), F.lit(False)).alias("gained"),
        F.coalesce((F.col("e") < 0.05) & (F.col("l") > 0.8), F.lit(False)).alias("flipped"),
        F.coalesce((ratio > 2.0 * (1 + RATIO_TOLERANCE)) | (ratio < 0.5 * (1 - RATIO_TOLERANCE)), F.lit(False)).alias("shifted"))


def populated_bins(df: DataFrame, keys: list[str], array: str, windows: dict[str, tuple[float, float]], hours: str = "hours") -> DataFrame:
    """Mean number of present bins per row and null share, per time window."""
    h = F.col(hours)
    tag = None
    for name, (lo, hi) in windows.items():
        cond = (h >= lo) & (h < hi)
        tag = F.when(cond, F.lit(name)) if tag is None else tag.when(cond, F.lit(name))
    present = F.size(F.filter(array, lambda x: x.isNotNull()))
    return df.withColumn("span", tag).where(F.col("span").isNotNull()).groupBy(*keys, "span").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(present).alias("mean_populated"),
        (F.lit(1.0) - F.sum(present) / F.sum(F.size(array))).alias("null_share"))


def recompute_audit(exported: DataFrame, recomputed: DataFrame, keys: list[str], classes: dict[str, str], metric: str = "metric",
                    value: str = "value", tolerances: dict[str, float] = TOLERANCES) -> DataFrame:
    """Exported against recomputed values per metric under the tolerance of its class.

    Null exported values are not audited; an exported value that cannot be
    recomputed is ``not_checked``, never a match.
    """
    e = exported.where(F.col(value).isNotNull()).withColumnRenamed(value, "exported")
    r = recomputed.select(*keys, metric, F.col(value).alias("recomputed"), F.lit(True).alias("_there"))
    tol = F.lit(tolerances["numeric"])
    for m, cls in classes.items():
        tol = F.when(F.col(metric) == m, F.lit(float(tolerances[cls]))).otherwise(tol)
    joined = join_keys(e, r, [*keys, metric], "left")
    status = (F.when(F.col("_there").isNull(), "not_checked")
              .when(F.coalesce(F.abs(F.col("exported") - F.col("recomputed")) <= tol, F.lit(False)), "match").otherwise("mismatch"))
    return joined.withColumn("status", status).drop("_there")


def zero_and_null_counts(df: DataFrame, keys: list[str], representatives: dict[str, str]) -> DataFrame:
    """Zeros and nulls of one representative column per zero-semantics class."""
    aggs = []
    for cls, c in representatives.items():
        aggs += [F.count_if(is_zero(c)).alias(f"{cls}_zeros"), F.count_if(F.col(c).isNull()).alias(f"{cls}_nulls")]
    return df.groupBy(*keys).agg(*aggs)


def compare_tables(left: DataFrame, right: DataFrame, ids: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Cell-by-cell comparison of two reads of the same rows, relative tolerance, per column."""
    a = left.select(*ids, *columns)
    b = right.select(*ids, *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_there"))
    j = a.withColumn("_here", F.lit(True)).join(b, ids, "full_outer")
    def differs(c: str) -> Column:
        x, y = F.col(c), F.col(f"_o_{c}")
        close = F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
        return F.col("_here") & F.col("_there") & ~F.when(x.isNull() & y.isNull(), True).otherwise(F.coalesce(close, F.lit(False)))
    out = j.agg(F.count_if(F.col("_there").isNull()).alias("only_left"), F.count_if(F.col("_here").isNull()).alias("only_right"),
                *[F.count_if(differs(c)).alias(f"d_{c}") for c in columns])
    return out.select("only_left", "only_right", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("n_diff")) for c in columns])))


def conversion_columns(codes: DataFrame, stored_columns: list[str], fixed: list[str] = ()) -> DataFrame:
    """(file, n_codes, dropped, extra): header codes that the stored table lacks, and stored columns that no header code names."""
    have, filled = F.array(*[F.lit(c) for c in stored_columns if c not in fixed]), F.filter("codes", lambda c: (c != "") & ~c.isin(*fixed) if fixed else c != "")
    return codes.select("file", F.size(filled).alias("n_codes"), F.array_join(F.array_sort(F.array_except(filled, have)), ", ").alias("dropped"),
                        F.array_join(F.array_sort(F.array_except(have, filled)), ", ").alias("extra"))


def clock_check(rows: DataFrame, keys: list[str], order: list[str], ts: str = "ts") -> DataFrame:
    """Per key: whether the clock never runs back in row order, steps that do, median step and hours from first to last row."""
    placed = index_rows(rows.select(*keys, *order, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")), keys, order)
    stepped = neighbours(placed, keys, prev={"_last": "_us"}).withColumn("_step", (F.col("_us") - F.col("_last")) / 1e6)
    ends = strip_layout(stepped).groupBy(*keys).agg(
        F.count_if(F.col("_step") < 0).alias("n_back"), ((F.max_by("_us", "row_idx") - F.min_by("_us", "row_idx")) / 3.6e9).alias("duration_hours"))
    median = order_stats(strip_layout(stepped).select(*keys, "_step"), keys, "_step", median_step=quantile(0.5))
    return join_keys(ends, median, keys, "left").withColumn("monotonic", F.col("n_back") == 0)
