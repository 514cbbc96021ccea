"""Column identity: families, bands, locations, names and panel resolution as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ALTERNATIVE_SUBCOLUMNS, DISCARDED_FAMILIES, ENGINE_CADENCE, ENGINE_WINDOW, FAMILY_ENGINES, FIXED_SUBCOLUMNS,
    SINGLE_VALUE_FAMILIES, VARIABLE_SUBCOLUMNS,
)
from ..functions import labels as lb
from ..sources.workdir import stored
from .ordered import index_rows, join_keys, strip_layout
from .retrieve import bin_frequency

# Pseudo-columns after the panel, and nominal bin width per family.
TAIL_COLUMNS = 2
BIN_WIDTH_HZ = {"fft_spectrogram": 0.5, "asymmetry": 0.5, "rhythmicity": 0.25, "coherence_spectrogram": 0.5}


def lookup(key: str | Column, values: dict) -> Column:
    """Value of a small fixed mapping, null when absent."""
    key = F.col(key) if isinstance(key, str) else key
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def cadence_table(columns: DataFrame, template: DataFrame | None = None, family: str = "family") -> DataFrame:
    """Engine, rows per independent observation and window seconds of every column.

    A template's engine (``engine, step, win``) overrides the defaults.
    """
    out = columns.withColumn("engine", lookup(family, FAMILY_ENGINES))
    rows, window = lookup("engine", ENGINE_CADENCE), lookup("engine", ENGINE_WINDOW)
    if template is not None:
        out = out.join(template, "engine", "left")
        rows = F.coalesce(F.greatest(F.lit(1), F.bround("step")).cast("int"), rows)
        window = F.coalesce("win", window)
    basis = F.when(F.col("cadence_rows") > 1, F.concat(F.col(family), F.lit("_cadence_adjusted"))).otherwise(F.lit("row_count"))
    return out.withColumns({
        "cadence_rows": F.coalesce(rows, F.lit(1)).cast("int"),
        "window_seconds": F.coalesce(window, F.lit(1.0)).cast("double"),
    }).withColumn("effective_basis", basis)


# ---- identity of every column of a cohort ----------------------------------------

def parse_codes(columns: DataFrame, code: str = "code") -> DataFrame:
    """Instrument number and sub-index of codes ``I{n}_{k}``; other columns are dropped."""
    pattern = r"^I(\d+)_(\d+)$"
    return columns.where(F.col(code).rlike(pattern)).withColumns({
        "i_group": F.regexp_extract(code, pattern, 1).cast("int"), "sub_index": F.regexp_extract(code, pattern, 2).cast("int")})


def describe(columns: DataFrame, template: str | None = None, channels: str | None = None, template_family: str | None = None) -> DataFrame:
    """Family, frequencies, band, location, sub-column and common name per column.

    Staged in a few projections so that every expression is computed once. With a
    template its channel set gives the location and its name the finer identity.
    """
    out = lb.with_family(columns.withColumn("label", lb.normalize_electrodes("label")))
    if template_family:
        out = out.withColumn("family", F.when((F.col("family") == "other") & F.col(template_family).isNotNull(), F.col(template_family)).otherwise(F.col("family")))
    lo, hi = lb.frequency_range("label")
    out = out.withColumns({"_lo": lo, "_hi": hi, "electrode": lb.electrode_of("label"),
                           "_hemi": lb.hemisphere_of("label"), "_reg": lb.region_word("label")})
    centre = bin_frequency(F.col("family"), F.col("sub_index"))
    half = lookup("family", BIN_WIDTH_HZ) / 2.0
    missing = F.col("_lo").isNull() & F.col("_hi").isNull()
    hemi, reg = F.col("_hemi"), F.col("_reg")
    if channels:
        ch = F.coalesce(F.col(channels), F.lit(""))
        from_ch = F.when(ch.contains("Left"), "left").when(ch.contains("Right"), "right").otherwise("")
        reg_ch = F.when(ch.contains("Anterior"), "anterior").when(ch.contains("Posterior"), "posterior").when(ch.contains("Hemisphere"), "hemisphere").otherwise("")
        hemi, reg = F.when(from_ch != "", from_ch).otherwise(hemi), F.when(reg_ch != "", reg_ch).otherwise(reg)
    side = lb.chain_side("electrode")
    out = out.withColumns({
        "freq_min": F.when(missing, F.greatest(F.lit(0.0), centre - half)).otherwise(F.col("_lo")),
        "freq_max": F.when(missing, centre + half).otherwise(F.col("_hi")),
        "hemisphere": F.coalesce(side, hemi), "region": F.when(side.isNotNull(), "").otherwise(reg)})
    out = out.withColumns({
        "band": F.when(F.col("freq_min").isNotNull() & F.col("freq_max").isNotNull(), lb.band_of(F.col("freq_min"), F.col("freq_max"))).otherwise(""),
        "sub_name": lb.subcolumn_name("i_group", "sub_index", "label", "family", template)})
    out = lb.with_common_name(out, template).drop("_lo", "_hi", "_hemi", "_reg")
    # One-row generator: later filters on the results stay above it. Pushed through
    # the staged projections they would inline every stage into the predicate.
    found = [c for c in out.columns if c not in columns.columns or c == "label"]
    return out.select(*[c for c in out.columns if c not in found], F.inline(F.array(F.struct(*found))))


def unique_names(columns: DataFrame, keys: list[str], position: str = "col_idx", name: str = "common_name", suffix: str = "__dup") -> DataFrame:
    """Second and later uses of a name get ``{suffix}{n}``, never a name the export already has."""
    numbered = strip_layout(index_rows(columns, [*keys, name], [position], row="_nth", total="_uses"))
    pattern = rf"^(.*){suffix}(\d+)$"
    fits = F.col(name).rlike(pattern)
    taken = columns.where(fits).groupBy(*keys, F.regexp_extract(name, pattern, 1).alias(name)).agg(
        F.sort_array(F.collect_set(F.regexp_extract(name, pattern, 2).cast("bigint"))).alias("_taken"))
    out = join_keys(numbered, taken, [*keys, name], "left")
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<bigint>")), F.col("_nth") + 1,
                       lambda m, r: F.when((r <= m) & (r >= 2), m + 1).otherwise(m))
    unique = F.when(F.col("_nth") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(suffix), free.cast("string")))
    return out.withColumn("unique_name", unique).drop("_nth", "_uses", "_taken")


def build_dictionary(columns: DataFrame, keys: list[str], **template: str) -> DataFrame:
    """Described columns with unique names. The description is stored once, as naming reads it several times."""
    return unique_names(stored(describe(columns, **template), "columns"), keys)


def resolve_panels(columns: DataFrame, keys: list[str], panels: DataFrame) -> DataFrame:
    """(keys, panel) where exactly one panel has ``max(i_group) - 2`` instruments.

    ``panels``: (panel, n_instruments).
    """
    top = columns.groupBy(*keys).agg((F.max("i_group") - TAIL_COLUMNS).alias("_n"))
    hit = top.join(panels, F.col("_n") == F.col("n_instruments"))
    return hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.max("panel").alias("panel")).where("_k = 1").drop("_k")


def resolve_columns(columns: DataFrame, keys: list[str], panels: DataFrame, slots: DataFrame, instruments: DataFrame) -> DataFrame:
    """Identity by panel position, else by exact name, else by label; ``resolution`` says which.

    ``slots``: (panel, position, name, channels, template_family); ``instruments``:
    (name, channels, template_family).
    """
    resolved = join_keys(columns, resolve_panels(columns, keys, panels), keys, "left")
    sized = resolved.join(panels.withColumnRenamed("panel", "_p"), F.col("panel") == F.col("_p"), "left").drop("_p")
    s = slots.select(F.col("panel").alias("_p"), F.col("position").alias("_pos"), F.col("name").alias("_sn"), F.col("channels").alias("_sc"),
                     F.col("template_family").alias("_sf"))
    i = instruments.select(F.col("name").alias("_in"), F.col("channels").alias("_ic"), F.col("template_family").alias("_if"))
    out = sized.withColumn("_label", lb.normalize_electrodes("label"))
    out = out.join(s, (F.col("panel") == F.col("_p")) & (F.col("i_group") == F.col("_pos")), "left").join(i, F.col("_label") == F.col("_in"), "left")
    resolution = (F.when(F.col("_sn").isNotNull(), "ordinal").when(F.col("_in").isNotNull(), "name")
                  .when(F.col("panel").isNotNull() & (F.col("i_group") > F.col("n_instruments")), "tail").otherwise("regex"))
    return out.withColumns({
        "resolution": resolution, "template_name": F.coalesce("_sn", "_in"), "template_channels": F.coalesce("_sc", "_ic"),
        "template_family": F.coalesce("_sf", "_if")}).drop("_p", "_pos", "_sn", "_sc", "_sf", "_in", "_ic", "_if", "_label", "n_instruments")


def resolution_mix(columns: DataFrame, keys: list[str]) -> DataFrame:
    return columns.groupBy(*keys).agg(
        *[F.count_if(F.col("resolution") == r).alias(f"n_{r}") for r in ("ordinal", "name", "regex", "tail")],
        F.bool_and(F.col("resolution").isin("ordinal", "tail")).alias("fully_ordinal"))


def subcolumn_contract(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Instruments whose sub-column count breaks their family's contract."""
    label = F.min_by("label", F.when(F.col("label") != "", F.struct("sub_index", "label")))
    per = columns.groupBy(*keys, "i_group").agg(F.max("sub_index").alias("observed"), F.coalesce(label, F.lit("")).alias("label"))
    fam = lb.contract_family("label")
    fixed, variable = lookup("family", FIXED_SUBCOLUMNS), lookup("family", VARIABLE_SUBCOLUMNS)
    out = per.withColumn("family", fam).withColumns({
        "expected": F.coalesce(fixed, variable, F.when(F.col("family").isin(SINGLE_VALUE_FAMILIES), F.lit(1))),
        "severity": F.when(variable.isNotNull(), "warn").otherwise("error")})
    allowed = F.coalesce(lookup("family", ALTERNATIVE_SUBCOLUMNS) == F.col("observed"), F.lit(False))
    return out.where(F.col("expected").isNotNull() & (F.col("observed") != F.col("expected")) & ~allowed)


def drop_discarded(columns: DataFrame, families: list[str] = DISCARDED_FAMILIES) -> DataFrame:
    return columns.where(~F.col("family").isin(families))


def power_map(columns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, band, region_label, code) of absolute power columns; the last code wins."""
    words = ["Left Anterior", "Left Posterior", "Left Hemisphere", "Right Anterior", "Right Posterior", "Right Hemisphere"]
    region = lb.first_match(F.col("label"), [(w, w) for w in words])
    found = columns.where((F.col("family") == "fft_power") & (F.col("band") != "")).withColumn("region_label", region)
    return found.where(F.col("region_label").isNotNull()).groupBy(*keys, "band", "region_label").agg(F.max_by("code", "col_idx").alias("code"))


def header_audit(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Per file: columns, instruments, unclassified, colliding names, classifier disagreements, layout hash.

    Two files have the same layout exactly when their layout hashes agree; the
    hash is an order-independent combination of per-row hashes with positions.
    """
    names = columns.groupBy(*keys, "common_name").agg(F.count(F.lit(1)).alias("_k")).groupBy(*keys).agg(F.count_if(F.col("_k") > 1).alias("n_collisions"))
    second = lb.contract_family("label")
    base = columns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_columns"), F.countDistinct("i_group").alias("n_instruments"),
        F.count_if(F.col("family") == "other").alias("n_unclassified"),
        F.count_if(second.isNull() | (second != F.col("family"))).alias("n_disagree"),
        F.bit_xor(F.xxhash64("col_idx", "code", "label")).alias("layout_hash"))
    return join_keys(base, names, keys)


def layouts_equal(columns: DataFrame, file: str, reference: str) -> DataFrame:
    """Per file: how many (position, code, label) rows differ from the reference file."""
    ref = columns.where(F.col(file) == reference).select(F.col("col_idx").alias("_i"), F.col("code").alias("_c"), F.col("label").alias("_l"))
    other = columns.where(F.col(file) != reference)
    same = other.join(ref, F.col("col_idx") == F.col("_i"), "left")
    diff = ~(F.coalesce((F.col("code") == F.col("_c")) & (F.col("label") == F.col("_l")), F.lit(False)))
    sizes = ref.agg(F.count(F.lit(1)).alias("_n")).scalar()
    return same.groupBy(file).agg(F.count(F.lit(1)).alias("n_columns"), F.count_if(diff).alias("n_different")).withColumn(
        "identical", (F.col("n_different") == 0) & (F.col("n_columns") == sizes))


def candidate_labels(instruments: DataFrame) -> DataFrame:
    """(instrument_id, label): display labels an instrument may be exported under.

    Built from title (else name), frequency range and channel set; ``instruments``:
    instrument_id, name, title, channels, freq_min, freq_max.
    """
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.col("name"))
    num = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    span = F.concat(num("freq_min"), F.lit(" - "), num("freq_max"), F.lit(" Hz"))
    with_span = F.when(F.col("freq_min").isNotNull(), F.concat(title, F.lit(", "), span))
    forms = [title, F.concat(title, F.lit(", "), F.col("channels")), with_span, F.concat(with_span, F.lit(", "), F.col("channels"))]
    return instruments.select("instrument_id", F.explode(F.array_distinct(F.array_compact(F.array(*forms)))).alias("label"))


def match_labels(columns: DataFrame, keys: list[str], candidates: DataFrame) -> DataFrame:
    """Per exported instrument: resolved / ambiguous / unmatched, and double claims."""
    per = columns.groupBy(*keys, "i_group").agg(F.min_by("label", F.struct("sub_index", "label")).alias("label"))
    hits = per.join(candidates, "label", "left").groupBy(*keys, "i_group").agg(
        F.count("instrument_id").alias("n_hits"), F.max("instrument_id").alias("instrument_id"))
    status = F.when(F.col("n_hits") == 1, "resolved").when(F.col("n_hits") > 1, "ambiguous").otherwise("unmatched")
    out = hits.withColumn("status", status).withColumn("instrument_id", F.when(F.col("n_hits") == 1, F.col("instrument_id")))
    claims = out.where("status = 'resolved'").groupBy(*keys, "instrument_id").agg(F.count(F.lit(1)).alias("claims"))
    joined = join_keys(out, claims, [*keys, "instrument_id"], "left")
    return joined.withColumn("claimed_twice", F.coalesce(F.col("claims") > 1, F.lit(False))).drop("claims", "n_hits")


def panel_alignment(columns: DataFrame, keys: list[str], slots: DataFrame) -> DataFrame:
    """Per instrument: does the exported label start with the panel slot's display label?"""
    per = columns.groupBy(*keys, "panel", "i_group").agg(F.min_by("label", F.struct("sub_index", "label")).alias("label"), F.max("sub_index").alias("n_sub"))
    s = slots.select(F.col("panel").alias("_p"), F.col("position").alias("_pos"), F.col("name").alias("template_name"), F.col("title").alias("_t"))
    out = per.join(s, (F.col("panel") == F.col("_p")) & (F.col("i_group") == F.col("_pos")), "left").drop("_p", "_pos")
    shown = F.when(F.coalesce(F.trim("_t"), F.lit("")) != "", F.trim("_t")).otherwise(F.trim("template_name"))
    return out.withColumn("prefix_ok", F.when(F.col("template_name").isNotNull(), F.col("label").startswith(shown))).drop("_t")


def column_map(columns: DataFrame, engines: DataFrame | None = None, tiers: DataFrame | None = None) -> DataFrame:
    """Columns with engine statistics and evidence tier."""
    out = cadence_table(columns, engines)
    if tiers is not None:
        out = out.join(tiers, "family", "left").withColumn("evidence_tier", F.coalesce("evidence_tier", F.lit("EMP")))
    return out


def column_map_summary(mapped: DataFrame, keys: list[str]) -> DataFrame:
    return mapped.groupBy(*keys, "family").agg(
        F.count(F.lit(1)).alias("n_columns"), F.countDistinct("i_group").alias("n_instruments"), F.max("engine").alias("engine"),
        F.max("evidence_tier").alias("evidence_tier"))

