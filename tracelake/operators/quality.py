"""Validation and quality: suppressed zeros, artifact masks, column checks, reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ARTIFACT_MODE, DEAD_REFERENCE_SHARE, FAMILY_RANGES, INTENSITY_LIMIT, MIN_CLEAN_ELECTRODES, NEVER_NULL,
    QUALITY_LIMIT_PCT, REGION_FALLBACK, REGION_TOKENS, ZERO_IMPOSSIBLE, ZERO_LEGITIMATE,
)
from ..functions.clock import hours_between
from ..functions.numbers import col_of, count_where, is_zero, non_zero_or_missing
from .ordered import index_rows, join_keys, runs, running
from .orderstats import order_stats, quantile


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


# ---- leading zeros and ranges -------------------------------------------------


def drop_leading_zeros(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Remove each key's opening rows in which every listed column is zero."""
    seen = F.when(_any([non_zero_or_missing(c) for c in columns]), F.lit(1))
    return running(df, keys, {"_seen": ("max", seen)}).where(F.col("_seen").isNotNull()).drop("_seen")


def leading_zero_rows(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    awake = _any([non_zero_or_missing(c) for c in columns])
    return df.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(awake, F.col("row_idx"))), F.count(F.lit(1))).alias("leading_zero_rows"))


def out_of_range(df: DataFrame, keys: list[str], families: dict[str, list[str]],
                 ranges: dict[str, tuple[float, float]] = FAMILY_RANGES) -> DataFrame:
    """(keys, family, n_bad) for families with values outside their plausible range."""
    known = {f: cols for f, cols in families.items() if f in ranges}
    bad = lambda f, c: count_where((F.col(c) < float(ranges[f][0])) | (F.col(c) > float(ranges[f][1])))
    counts = df.groupBy(*keys).agg(*[reduce(lambda a, b: a + b, [bad(f, c) for c in cols]).alias(f) for f, cols in known.items()])
    pairs = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("n_bad")) for f in known])
    return counts.select(*keys, F.inline(pairs)).where(F.col("n_bad") > 0)


def has_identity(name: str | Column) -> Column:
    """A patient name that is more than placeholder X's."""
    return F.trim(F.regexp_replace(F.coalesce(col_of(name), F.lit("")), "[Xx]", "")) != ""


def strip_identity(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


# ---- suppressed zeros ---------------------------------------------------------


@dataclass(frozen=True)
class Instrument:
    """Columns that one instrument emits, with its family and region.

    With ``real_zeros`` its zeros are measured values: they are kept, and never count as
    rejection of its region.
    """

    name: str
    family: str
    region: str
    columns: tuple[str, ...] = ()
    array: str | None = None
    real_zeros: bool = False

    def null_flag(self) -> Column:
        if self.real_zeros:
            return F.lit(False)
        if self.array:
            return F.coalesce(F.forall(F.col(self.array), is_zero), F.lit(False))
        return _all([is_zero(c) for c in self.columns])

    def masked(self, mask: Column) -> dict[str, Column]:
        names = [self.array] if self.array else list(self.columns)
        return {c: F.when(~mask, F.col(c)) for c in names}

    def width(self) -> Column:
        return F.size(self.array) if self.array else F.lit(len(self.columns))


def region_of(label: str) -> str:
    low = (label or "").lower()
    return next((r for r in REGION_TOKENS if r.lower() in low), "")


def region_expr(label: str | Column) -> Column:
    low = F.lower(F.coalesce(col_of(label), F.lit("")))
    out = F.lit("")
    for r in reversed(REGION_TOKENS):
        out = F.when(low.contains(r.lower()), F.lit(r)).otherwise(out)
    return out


def rejection_flags(df: DataFrame, keys: list[str], instruments: list[Instrument], dead: float = DEAD_REFERENCE_SHARE) -> DataFrame:
    """Add the rejection flags that the null rule needs.

    ``_null_i`` per instrument, ``_live_r`` / ``_rej_r`` per region, ``n_regions``,
    ``n_rejected`` and ``all_regions``. A reference that is zero in at least
    ``dead`` of a key's rows informs nothing.
    """
    flags = {f"_null_{i}": ins.null_flag() for i, ins in enumerate(instruments)}
    seeds = [i for i, ins in enumerate(instruments) if ins.family in ZERO_IMPOSSIBLE and ins.region]
    flagged = df.withColumns(flags) if flags else df
    if not seeds:  # nothing tells a suppressed zero from a real one: no region is live, and nothing is rejected
        return flagged.withColumns({"n_regions": F.lit(0), "n_rejected": F.lit(0), "all_regions": F.lit(False)})
    shares = flagged.groupBy(*keys).agg(*[
        (F.avg(F.col(f"_null_{i}").cast("double")) < dead).alias(f"_seed_{i}") for i in seeds])
    out = join_keys(flagged, shares, keys)
    regions = sorted({instruments[i].region for i in seeds})
    per_region = {}
    for r, region in enumerate(regions):
        own = [i for i in seeds if instruments[i].region == region]
        per_region[f"_live_{r}"] = _any([F.col(f"_seed_{i}") for i in own])
        per_region[f"_rej_{r}"] = _any([F.col(f"_seed_{i}") for i in own]) & _all(
            [F.col(f"_null_{i}") | ~F.col(f"_seed_{i}") for i in own])
    out = out.withColumns(per_region)
    total = lambda p: reduce(lambda a, b: a + b, [F.col(f"{p}{r}").cast("int") for r in range(len(regions))], F.lit(0))
    return out.withColumns({"n_regions": total("_live_"), "n_rejected": total("_rej_")}).withColumn(
        "all_regions", (F.col("n_regions") > 0) & (F.col("n_rejected") == F.col("n_regions")))


def _regions(instruments: list[Instrument]) -> list[str]:
    return sorted({i.region for i in instruments if i.family in ZERO_IMPOSSIBLE and i.region})


def instrument_mask(i: int, instruments: list[Instrument]) -> Column:
    """Where instrument ``i`` is to be set to null (over :func:`rejection_flags`)."""
    ins, regions = instruments[i], _regions(instruments)
    if ins.family in ZERO_IMPOSSIBLE:
        mask = F.col(f"_null_{i}")
    elif ins.family in ZERO_LEGITIMATE:
        mask = F.lit(False)
        for region in reversed([ins.region, *REGION_FALLBACK.get(ins.region, [])]):
            if region in regions:
                r = regions.index(region)
                mask = F.when(F.col(f"_live_{r}"), F.col(f"_rej_{r}")).otherwise(mask)
    elif ins.family in NEVER_NULL:
        mask = F.col("all_regions")
    else:
        mask = F.lit(False)
    return mask & (F.col("n_regions") > 0)


def _drop_flags(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_null_", "_seed_", "_live_", "_rej_"))])


def null_suppressed_zeros(df: DataFrame, keys: list[str], instruments: list[Instrument], dead: float = DEAD_REFERENCE_SHARE) -> DataFrame:
    """Turn suppressed zeros into nulls; keeps ``n_regions``, ``n_rejected``, ``all_regions``."""
    flagged = rejection_flags(df, keys, instruments, dead)
    new = {}
    for i, ins in enumerate(instruments):
        new |= ins.masked(instrument_mask(i, instruments))
    return _drop_flags(flagged.withColumns(new))


def rejection_report(df: DataFrame, keys: list[str], instruments: list[Instrument], dead: float = DEAD_REFERENCE_SHARE) -> DataFrame:
    """Rows all / partially rejected, cells nulled, empty segments, one row per key."""
    flagged = rejection_flags(df, keys, instruments, dead)
    cells = reduce(lambda a, b: a + b, [
        F.when(instrument_mask(i, instruments), ins.width()).otherwise(0) for i, ins in enumerate(instruments)])
    aggs = [
        F.max("n_regions").alias("n_regions"),
        count_where(F.col("all_regions")).alias("rows_all_rejected"),
        count_where((F.col("n_rejected") > 0) & ~F.col("all_regions")).alias("rows_partial"),
        F.sum(cells).alias("cells_nulled"),
        (F.max("n_regions") == 0).alias("segment_empty"),
    ]
    for r, region in enumerate(_regions(instruments)):
        name = region.lower().replace(" ", "_").replace("-", "_")
        aggs.append(F.when(F.bool_or(f"_live_{r}"), F.round(F.avg(F.col(f"_rej_{r}").cast("double")) * 100, 3)).alias(f"pct_{name}"))
    return flagged.groupBy(*keys).agg(*aggs)


def rejection_survey(df: DataFrame, keys: list[str], instruments: list[Instrument], cadence: int = 8) -> DataFrame:
    """How rejection is distributed: spread over regions, run lengths, share divisible by the cadence."""
    flagged = rejection_flags(df, keys, instruments).withColumn("_some", F.col("n_rejected") > 0)
    regions = _regions(instruments)
    base = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("n_regions").alias("n_regions"),
        (F.avg(F.col("all_regions").cast("double")) * 100).alias("all_pct"),
        (F.avg(((F.col("n_rejected") > 0) & ~F.col("all_regions")).cast("double")) * 100).alias("partial_pct"),
        F.avg("n_rejected").alias("mean_rejected"),
        *[F.when(F.bool_or(f"_live_{r}"), F.avg(F.col(f"_rej_{r}").cast("double"))).alias(f"_share_{r}") for r in range(len(regions))],
    )
    shares = F.array_compact(F.array(*[F.col(f"_share_{r}") for r in range(len(regions))]))
    base = base.withColumn("_s", shares).withColumns({
        "reject_pct_min": F.array_min("_s") * 100,
        "reject_pct_max": F.array_max("_s") * 100,
        "spread": F.try_divide(F.array_max("_s"), F.array_min("_s")),
    }).drop("_s", *[f"_share_{r}" for r in range(len(regions))])
    found = runs(flagged, keys, "_some").where("_some").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        (F.avg((F.col("run_rows") % cadence == 0).cast("double")) * 100).alias("runs_multiple_pct"))
    return join_keys(base, found, keys, "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0)))


# ---- artifact filter and usable mask --------------------------------------------


def artifact_clean(df: DataFrame, mode: str = ARTIFACT_MODE, intensity: list[str] | None = None, quality: list[str] | None = None,
                   quality_array: str | None = None, intensity_limit: float = INTENSITY_LIMIT,
                   quality_pct: float = QUALITY_LIMIT_PCT, min_electrodes: int = MIN_CLEAN_ELECTRODES) -> Column:
    """True for epochs the filter keeps; a mode whose columns are absent filters nothing."""
    intensity = [c for c in intensity or [] if c in df.columns]
    quality = [c for c in quality or [] if c in df.columns]
    keep = F.lit(True)
    if mode in ("intensity", "combined") and intensity:
        top = F.greatest(*intensity) if len(intensity) > 1 else F.col(intensity[0])
        keep = keep & F.coalesce(top < intensity_limit, F.lit(False))
    if mode in ("quality", "combined") and (quality or quality_array):
        readings = F.col(quality_array) if quality_array else F.array(*quality)
        good = F.size(F.filter(readings, lambda x: F.coalesce(x <= quality_pct / 100.0, F.lit(False))))
        keep = keep & (good >= min_electrodes)
    return keep


def exclude_blank(clean: str | Column, all_regions: str | Column = "all_regions") -> Column:
    """Epochs with every region rejected are never clean, whatever the filter mode."""
    return col_of(clean) & ~F.coalesce(col_of(all_regions), F.lit(False))


def artifact_report(df: DataFrame, keys: list[str], clean: str = "artifact_clean") -> DataFrame:
    bad = count_where(~F.col(clean))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_epochs"), bad.alias("excluded_epochs"),
        (F.lit(100.0) * bad / F.count(F.lit(1))).alias("artifact_pct"))


def usable_mask(clean: str | Column, event: str | Column, exclude_events: bool = True) -> Column:
    return col_of(clean) & ~col_of(event) if exclude_events else col_of(clean)


# ---- column checks --------------------------------------------------------------


def column_ranges(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, n, lo, hi) from one aggregate over the wide frame."""
    packed = df.groupBy(*keys).agg(*[
        F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.min(F.col(c).cast("double")).alias("lo"),
                 F.max(F.col(c).cast("double")).alias("hi")).alias(f"_{i}") for i, c in enumerate(columns)])
    return packed.select(*keys, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))


def constant_columns(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns that never vary (``constant``) or hold nothing (``all_null``)."""
    kind = F.when(F.col("n") == 0, F.lit("all_null")).when(F.col("lo") == F.col("hi"), F.lit("constant"))
    return column_ranges(df, keys, columns).withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        *keys, "column", "kind", F.col("lo").alias("constant_value"))


def duplicate_columns(df: DataFrame, keys: list[str], columns: list[str], row: str = "row_idx") -> DataFrame:
    """(keys, column, duplicate_of): columns equal row by row, nulls included.

    Columns are bucketed by (count, min, max, two 64-bit content hashes), then each
    is compared with the first column of its bucket, never with all others.
    """
    sig = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        sig.append(F.struct(
            F.lit(i).alias("pos"), F.lit(c).alias("column"), F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
            F.bit_xor(F.when(v.isNotNull(), F.xxhash64(row, v))).alias("h1"),
            F.bit_xor(F.when(v.isNotNull(), F.xxhash64(v, F.lit("s"), row))).alias("h2")).alias(f"_{i}"))
    signatures = df.groupBy(*keys).agg(*sig).select(*keys, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))
    buckets = signatures.where(F.col("n") > 0).groupBy(*keys, "n", "lo", "hi", "h1", "h2").agg(
        F.sort_array(F.collect_list(F.struct("pos", "column"))).alias("members")).where(F.size("members") > 1)
    first = F.get(F.col("members"), F.lit(0))["column"]
    pairs = buckets.select(*keys, first.alias("duplicate_of"), F.explode(F.slice("members", F.lit(2), F.size("members"))["column"]).alias("column"))
    listed = pairs.groupBy(*keys).agg(F.collect_list(F.struct("column", "duplicate_of")).alias("_pairs"))
    values = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])
    checked = join_keys(df, listed, keys).withColumn("_m", values).select(*keys, "_m", F.inline("_pairs"))
    same = F.bool_and(F.col("_m")[F.col("column")].eqNullSafe(F.col("_m")[F.col("duplicate_of")]))
    return checked.groupBy(*keys, "column", "duplicate_of").agg(same.alias("_same")).where("_same").drop("_same")


def column_warnings(found: DataFrame, keys: list[str], duplicates: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """(keys, kind, columns, warning) over :func:`constant_columns` and :func:`duplicate_columns`.

    Kinds are all_null, constant (one non-zero value), zero, and one duplicate row per group of
    equal columns. ``columns`` names all of them, the text at most ``limit``.
    """
    kind = F.when((F.col("kind") == "constant") & (F.col("constant_value") == 0), "zero").otherwise(F.col("kind"))
    shown = F.when(kind == "constant", F.concat("column", F.lit("="), F.col("constant_value").cast("string"))).otherwise(F.col("column"))
    grouped = found.groupBy(*keys, kind.alias("kind")).agg(
        F.sort_array(F.collect_list("column")).alias("_all"), F.sort_array(F.collect_list(shown)).alias("_shown"))
    if duplicates is not None:
        equal = duplicates.groupBy(*keys, "duplicate_of").agg(F.sort_array(F.collect_list("column")).alias("_m"))
        group = F.concat(F.array("duplicate_of"), "_m")
        grouped = grouped.unionByName(equal.select(*keys, F.lit("duplicate").alias("kind"), group.alias("_all"), group.alias("_shown")))
    says = (F.when(F.col("kind") == "all_null", "without any value").when(F.col("kind") == "constant", "with one non-zero value throughout")
            .when(F.col("kind") == "zero", "with zeros only").otherwise("equal on every row"))
    more = F.when(F.size("_shown") > limit, ", ...").otherwise("")
    text = F.concat(F.size("_all").cast("string"), F.lit(" column(s) "), says, F.lit(": "), F.array_join(F.slice("_shown", 1, limit), ", "), more)
    return grouped.select(*keys, "kind", F.array_join("_all", ", ").alias("columns"), text.alias("warning"))


# ---- reports --------------------------------------------------------------------


def qc_report(df: DataFrame, keys: list[str], ts: str = "ts", clean: str = "artifact_clean", event: str = "seizure",
              leading: str | None = None) -> DataFrame:
    """Per recording: totals, usable epochs and hours, duration, event share."""
    total = F.count(F.lit(1))
    lead = count_where(F.col(leading)) if leading else F.lit(0)
    excluded = count_where(~F.col(clean))
    hours = hours_between(F.min(ts), F.max(ts))
    return df.groupBy(*keys).agg(
        total.alias("total_epochs"),
        excluded.alias("excluded_epochs"),
        lead.alias("leading_zeros"),
        (total - excluded - lead).alias("usable_epochs"),
        (F.lit(100.0) * excluded / total).alias("artifact_pct"),
        count_where(F.col(event)).alias("event_epochs"),
        (F.lit(100.0) * count_where(F.col(event)) / total).alias("event_pct"),
        hours.alias("duration_hours"),
    ).withColumn("usable_hours", F.when(
        F.col("total_epochs") > 1, F.col("usable_epochs") * F.col("duration_hours") / (F.col("total_epochs") - 1)))


def parsed_counts(df: DataFrame, keys: list[str], leading: list[str]) -> DataFrame:
    """(keys, parsed_epochs, leading_zero_rows) over all rows of a timeline, before anything is trimmed."""
    counted = leading_zero_rows(df, keys, leading) if leading else df.select(*keys).distinct().withColumn("leading_zero_rows", F.lit(0))
    return join_keys(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("parsed_epochs")), counted, keys)


def qc_of_parsed(qc: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """The report with totals of the parsed recording: usable epochs are those neither excluded nor leading zeros."""
    out = join_keys(qc, parsed, keys)
    usable = F.col("parsed_epochs") - F.col("excluded_epochs") - F.col("leading_zero_rows")
    out = out.withColumns({"total_epochs": F.col("parsed_epochs"), "leading_zeros": F.col("leading_zero_rows"), "usable_epochs": usable,
                           "event_pct": F.lit(100.0) * F.col("event_epochs") / F.col("parsed_epochs")})
    return out.withColumn("usable_hours", F.when(F.col("total_epochs") > 1, F.col("usable_epochs") * F.col("duration_hours") / (F.col("total_epochs") - 1))).drop(
        "parsed_epochs", "leading_zero_rows")


def median_suppression(df: DataFrame, keys: list[str], columns: list[str], clean: str = "artifact_clean") -> DataFrame:
    """Mean over columns of each column's median in clean epochs, one decimal."""
    pack = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v0")) for c in columns])
    long = df.where(F.col(clean)).select(*keys, F.inline(pack))
    med = order_stats(long, [*keys, "column"], "v0", med=quantile(0.5))
    return med.groupBy(*keys).agg(F.avg("med").alias("median_suppression_pct"))


def stage_counts(df: DataFrame, keys: list[str], stages: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("parsed"), *[count_where(c).alias(n) for n, c in stages.items()])


def acceptance_checks(columns: DataFrame, keys: list[str], expected: DataFrame, bins: DataFrame | None = None,
                      name: str = "common_name", family: str = "family", discarded: list[str] | None = None) -> DataFrame:
    """(keys, check_name, ok, detail): names unique and valid, nothing discarded kept, bin counts as expected."""
    per_name = columns.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_k"), F.max(
        F.col(family).isin(discarded or []).cast("int")).alias("_d"))
    base = per_name.groupBy(*keys).agg(
        F.count_if(F.col("_k") > 1).alias("names_unique"),
        F.count_if(~F.col(name).rlike("^[a-z][a-z0-9_]*$")).alias("names_valid"),
        F.count_if(F.col("_d") == 1).alias("discarded_absent"),
    )
    if bins is not None:
        wrong = join_keys(bins, expected, [family]).groupBy(*keys).agg(
            F.count_if(F.col("n_bins") != F.col("expected_bins")).alias("bins_expected"))
        base = join_keys(base, wrong, keys, "left").withColumn("bins_expected", F.coalesce("bins_expected", F.lit(0)))
    checks = [c for c in ("names_unique", "names_valid", "discarded_absent", "bins_expected") if c in base.columns]
    pack = F.array(*[F.struct(F.lit(c).alias("check_name"), (F.col(c) == 0).alias("ok"), F.col(c).alias("n_bad")) for c in checks])
    return base.select(*keys, F.inline(pack))


def store_acceptance(columns: DataFrame, source: DataFrame, kept: DataFrame, keys: list[str], name: str = "unique_name", resolution: str = "resolution") -> DataFrame:
    """(keys, check_name, ok, n_bad): may a stored full panel be used?

    Every column has its identity from the panel's order (or stands behind it), no name was
    told apart by a suffix, all cells arrived, every blank cell of the export (``source``: keys,
    n_cells, n_blank) is a null of the store (``kept``: keys, n_cells, n_null, n_nan), and no
    missing value is stored as a bare NaN.
    """
    named = columns.groupBy(*keys).agg(
        F.count_if(~F.coalesce(F.col(resolution).isin("ordinal", "tail"), F.lit(False))).alias("ordinal_resolution"), F.count_if(F.col(name).rlike(r"__dup\d+$")).alias("no_duplicates"))
    both = join_keys(join_keys(named, source.withColumnRenamed("n_cells", "_source"), keys), kept, keys, "left")
    missing = lambda c: F.coalesce(F.col(c), F.lit(0))
    counted = both.withColumns({"cells_complete": F.abs(F.col("_source") - missing("n_cells")), "nulls_transported": F.abs(F.col("n_blank") - missing("n_null") - missing("n_nan")), "no_bare_nan": missing("n_nan")})
    checks = ["ordinal_resolution", "no_duplicates", "cells_complete", "nulls_transported", "no_bare_nan"]
    return counted.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("check_name"), (F.col(c) == 0).alias("ok"), F.col(c).cast("long").alias("n_bad")) for c in checks])))


def axis_increasing(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Whether the frequency axis of every instrument rises with the bin position."""
    from .ordered import neighbours

    linked = neighbours(index_rows(df, keys, [position]), keys, prev={"_pv": value})
    return linked.groupBy(*keys).agg(F.coalesce(F.bool_and(F.col(value) > F.col("_pv")), F.lit(True)).alias("increasing"))


def zero_rates(df: DataFrame, keys: list[str], columns: list[str], limit: float = 0.9) -> DataFrame:
    packed = df.groupBy(*keys).agg(*[F.avg(is_zero(c).cast("double")).alias(c) for c in columns])
    pack = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("zero_rate")) for c in columns])
    return packed.select(*keys, F.inline(pack)).withColumn("ok", F.col("zero_rate") < limit)


def single_template(files: DataFrame, cohort: list[str], fingerprint: str) -> DataFrame:
    """A cohort may be run only if all its files come from one template."""
    kinds = files.select(*cohort, fingerprint).distinct()
    return kinds.groupBy(*cohort).agg(F.count(F.lit(1)).alias("n_templates")).withColumn("ok", F.col("n_templates") == 1)
