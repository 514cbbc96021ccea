"""Export shapes: wide, long, semi-long, dictionaries, panels, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ELECTRODE_CHAIN, FAMILY_UNITS, UNIT_VARIANTS
from .features import LOG_FLOOR
from .ordered import join_keys

# Families of every export group, derived prefixes that are always
# core, metadata kept in every export, and prefixes counted by the power engine.
GROUP_FAMILIES = {
    "core": [
        "fft_power", "fft_power_ratio", "adr", "relative_power", "aeeg", "seizure_probability", "seizure_detection",
        "seizure_notification", "status_epilepticus", "seizure_burden", "suppression_ratio", "spike_density",
        "alpha_variability", "heart_rate", "spectral_edge", "rda", "rhythmic_delta", "sleep", "peak_envelope",
    ],
    "electrode_detail": ["electrode_quality", "artifact_intensity"],
    "fft_spectrogram": ["fft_spectrogram"],
    "asymmetry_spectrogram": ["asymmetry"],
    "coherence_spectrogram": ["coherence_spectrogram"],
    "rhythmicity": ["rhythmicity"],
}
DERIVED_PREFIXES = [
    "fft_delta_", "fft_theta_", "fft_alpha_", "fft_beta_", "total_power_", "rel_delta_", "rel_theta_", "rel_alpha_",
    "rel_beta_", "theta_delta_ratio_", "alpha_delta_ratio_", "log_theta_delta_ratio_", "log_alpha_delta_ratio_", "aeeg_",
]
WIDE_STATS = ["median", "mean", "sd", "iqr", "min", "max", "n"]


def patient_wide(bins: DataFrame, keys: list[str], features: list[str], labels: list[str], stats: list[str] | None = None,
                 extras: list[DataFrame] | None = None, coverage: str | None = None) -> DataFrame:
    """One row per patient: ``{feature}_{stat}_{bin}``, coverage per bin, joined extras.

    Features and bins come from the configuration, so the column list is known and
    everything is one conditional aggregate.
    """
    aggs = []
    for f in features:
        for s in stats or WIDE_STATS:
            for b in labels:
                here = (F.col("feature") == f) & (F.col("bin_label") == b)
                aggs.append(F.max(F.when(here, F.col(s))).alias(f"{f}_{s}_{b}"))
    if coverage:
        aggs += [F.max(F.when(F.col("bin_label") == b, F.col(coverage))).alias(f"{coverage}_{b}") for b in labels]
    out = bins.groupBy(*keys).agg(*aggs)
    for extra in extras or []:
        out = join_keys(out, extra, keys, "left")
    return out


def effective_basis(feature: str | Column, basis: str | Column, dictionary_basis: str | Column) -> Column:
    """Own basis, else the dictionary's, else ``not_estimated``."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.coalesce(c(basis), c(dictionary_basis), F.lit("not_estimated"))


def bins_long(bins: DataFrame, keys: list[str], covariates: DataFrame | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """(patient, bin, feature) rows with effective-count basis and covariates."""
    out = bins
    if dictionary is not None:
        out = out.join(dictionary.select(F.col("common_name").alias("feature"), F.col("effective_basis").alias("_dict_basis")), "feature", "left")
        out = out.withColumn("effective_basis", effective_basis("feature", "effective_basis", "_dict_basis")).drop("_dict_basis")
    return join_keys(out, covariates, keys, "left") if covariates is not None else out


def semi_long(bins: DataFrame, keys: list[str], features: list[str], meta: list[str], covariates: DataFrame | None = None) -> DataFrame:
    """(patient, bin) rows, features as columns with log, n, cv and slope; bins without data dropped."""
    keep = bins.where(F.col("missingness") != "no_data")
    parts = {"": "median", "_log": "log_mean", "_n": "n", "_cv": "cv", "_trimmed_mean_20pct": "trimmed_mean_20pct", "_slope": "slope"}
    aggs = [F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{f}{s}") for f in features for s, c in parts.items() if c in bins.columns]
    out = keep.groupBy(*keys, "bin_label", *meta).agg(*aggs)
    return join_keys(out, covariates, keys, "left") if covariates is not None else out


def cohort_semi_long(parts: list[DataFrame], reference: DataFrame, keys: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """Stack semi-long tables with differing columns, add the time reference, rename codes."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return rename_features(join_keys(out, reference, keys, "left"), names or {})


def rename_features(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``{code}{suffix}`` to ``{name}{suffix}``; the longest code that fits wins."""
    new = {}
    for c in df.columns:
        code = max((k for k in names if c == k or c.startswith(k + "_")), key=len, default=None)
        if code:
            new[c] = names[code] + c[len(code):]
    return df.withColumnsRenamed(new)


def export_group(name: str = "common_name", family: str = "family") -> Column:
    """Export group of a dictionary row; unknown families are always kept (``core``)."""
    n, f = F.col(name), F.col(family)
    derived = F.lit(False)
    for p in DERIVED_PREFIXES:
        derived = derived | n.startswith(p)
    out = F.when(derived, "core").when((f == "asymmetry") & F.lower(n).contains("easi"), "core")
    for group, families in GROUP_FAMILIES.items():
        out = out.when(f.isin(families), group)
    return out.otherwise("core")


def filter_groups(bins: DataFrame, dictionary: DataFrame, groups: list[str], feature: str = "feature") -> DataFrame:
    """Bin rows of the features whose group is exported (core always is)."""
    wanted = dictionary.where(export_group().isin(["core", *groups])).select(F.col("common_name").alias(feature)).distinct()
    return bins.join(wanted, feature, "left_semi")


def variable_unit(name: str | Column, family: str | Column) -> Column:
    """Unit of a variable: that of the first variant its name fits, else its family's."""
    text, fam = F.lower(F.col(name) if isinstance(name, str) else name), F.col(family) if isinstance(family, str) else family
    rules = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(pattern).alias("p"), F.lit(unit).alias("u")) for families, pattern, unit in UNIT_VARIANTS for f in families])
    fitting = F.filter(rules, lambda r: (r["f"] == fam) & F.rlike(text, r["p"]))
    units = F.create_map(*[F.lit(x) for pair in FAMILY_UNITS.items() for x in pair])
    return F.coalesce(F.get(fitting, F.lit(0))["u"], F.try_element_at(units, fam), F.lit(""))


def data_dictionary(columns: DataFrame, template: DataFrame | None = None) -> DataFrame:
    """Name, family, unit, group, engine, cadence and window of every variable."""
    from .columns import cadence_table

    out = cadence_table(columns, template)
    return out.withColumns({"unit": variable_unit("common_name", "family"), "export_group": export_group()})


def column_mapping(columns: DataFrame) -> DataFrame:
    keep = ["file_id", "code", "common_name", "label", "family", "resolution"]
    return columns.select(*[c for c in keep if c in columns.columns])


_ENTRY = "variable_name string, label string, data_type string, unit string, family string, source_columns array<string>, formula string"
_BANDS, _REGIONS = ["delta", "theta", "alpha", "beta"], ["anterior", "posterior"]


def derived_entries(spark) -> DataFrame:
    """Dictionary entries of the features that runs derive, from the bands and regions they are made of."""
    rows = []
    for region in _REGIONS:
        power, ratio = FAMILY_UNITS["fft_power"], FAMILY_UNITS["fft_power_ratio"]
        own = {b: f"fft_{b}_{region}" for b in _BANDS}
        for b, name in own.items():
            sides = [f"fft_{b}_left_{region}", f"fft_{b}_right_{region}"]
            rows += [(name, f"{b} power, {region}, both sides", "float", power, "fft_power", sides, "mean of the sides that are present"),
                     (f"{name}_sides_contributing", f"sides behind {name}", "integer", "count", "fft_power", sides, "number of sides that are present")]
        rows.append((f"total_power_{region}", f"total power, {region}", "float", power, "fft_power", list(own.values()), " + ".join(own.values())))
        rows += [(f"rel_{b}_{region}", f"share of {b} power, {region}", "float", "proportion", "fft_power_ratio", [own[b], f"total_power_{region}"],
                  f"{own[b]} / total_power_{region}, null for a total of 0") for b in _BANDS]
        for b in ("theta", "alpha"):
            pair = [own[b], own["delta"]]
            rows += [(f"{b}_delta_ratio_{region}", f"{b} to delta, {region}", "float", ratio, "fft_power_ratio", pair, f"{pair[0]} / {pair[1]}, null for a delta of 0"),
                     (f"log_{b}_delta_ratio_{region}", f"log of {b} to delta, {region}", "float", "log10 ratio", "fft_power_ratio", pair,
                      f"log10 of both floored at {LOG_FLOOR:g}, numerator over denominator")]
    return spark.createDataFrame(rows, _ENTRY)


#: Statistics of a bin: unit (of the feature where empty) and how the value comes about.
STATISTIC_FORMULAS = {
    "median": ("", "middle of the sorted values"), "mean": ("", "sum of the values / n"), "sd": ("", "sample deviation; 0 for one value"),
    **{f"p{q:02d}": ("", f"value at rank (n - 1) * {q / 100:g}, interpolated") for q in (5, 10, 25, 75, 90, 95)}, "iqr": ("", "p75 - p25"), "min": ("", "least value"), "max": ("", "greatest value"),
    "trimmed_mean_20pct": ("", "mean without the lowest and highest tenth; mean below four values"), "cv": ("unitless", "sd / mean, for means over 1e-10"),
    "log_mean": ("", "exp of the mean logarithm of positive values, for power features"), "log_sd": ("log units", "sample deviation of those logarithms"),
    "slope": ("feature units per hour", "regression of medians on bin midpoints, over bins of enough coverage"),
}
#: Fields of a bin: unit, what they are made of, and how.
BIN_FIELDS = {
    "bin_expected_hours": ("hours", ["bin_start", "bin_end"], "bin_end - bin_start"), "observed_wall_clock_hours": ("hours", ["support_hours"], "sum of support of all rows"),
    "artifact_clean_hours": ("hours", ["support_hours", "usable"], "sum of support of usable rows"), "coverage_hours": ("hours", ["artifact_clean_hours"], "same as artifact_clean_hours"),
    "clean_fraction_of_observed": ("proportion (0–1)", ["artifact_clean_hours", "observed_wall_clock_hours"], "artifact_clean_hours / observed_wall_clock_hours"),
    "clean_fraction_of_expected": ("proportion (0–1)", ["artifact_clean_hours", "bin_expected_hours"], "artifact_clean_hours / bin_expected_hours"),
    "background_continuity_index": ("proportion", ["suppression"], "share of usable rows whose suppression is present and under the threshold"),
    "seizure_burden_hours": ("hours", ["support_hours", "seizure", "artifact_clean"], "sum of support of artifact-clean rows with an event"),
    "n_effective_cadence_adjusted": ("observations", ["independent masks"], "least number of independent usable rows over the engines"),
}


def statistic_entries(spark) -> DataFrame:
    """Dictionary entries of all statistics and bin fields of an export."""
    stats = [(n, f"{n} of a feature in a bin", "float", unit or "feature units", "statistic", [f"*_{n}"], how) for n, (unit, how) in STATISTIC_FORMULAS.items()]
    return spark.createDataFrame(stats + [(n, n.replace("_", " "), "float", unit, "time_binning", of, how) for n, (unit, of, how) in BIN_FIELDS.items()], _ENTRY)


def full_dictionary(columns: DataFrame, template: DataFrame | None = None) -> DataFrame:
    """``data_dictionary`` of the exported columns with the entries of derived features, statistics and bin fields below it."""
    own = data_dictionary(columns, template).select(
        F.col("common_name").alias("variable_name"), F.col("label"), F.lit("float").alias("data_type"), "unit", "family",
        F.array("code" if "code" in columns.columns else "common_name").alias("source_columns"), F.lit("as exported").alias("formula"))
    spark = columns.sparkSession
    made = derived_entries(spark).join(own.select("variable_name").distinct(), "variable_name", "left_anti")  # a column the export has itself wins
    return own.unionByName(made).unionByName(statistic_entries(spark))


def panel_variables(columns: DataFrame, panels: DataFrame) -> DataFrame:
    """(panel_id, variable) by family, region, side and name rules; bins of a spectrogram become one name.

    ``panels``: panel_id, family (one row each), region, hemisphere, contains, excludes (array),
    spectrogram (true, false or null for either). A spectrogram panel of one side leaves out
    columns of a region. The family is the equi-join key; the rest is a residual filter.
    """
    p = panels.withColumnsRenamed({"family": "p_family", "region": "p_region", "hemisphere": "p_hemisphere"})
    name, spectral = F.col("common_name"), F.contains(F.col("common_name"), F.lit("spectrogram"))
    shown = F.coalesce(F.col("spectrogram"), F.lit(False))
    regional = F.coalesce(F.col("region") != "", F.lit(False))
    hit = columns.join(p, (F.col("family") == F.col("p_family"))
                       & (F.col("p_region").isNull() | (F.col("region") == F.col("p_region")))
                       & (F.col("p_hemisphere").isNull() | (F.col("hemisphere") == F.col("p_hemisphere")))
                       & ~(shown & F.col("p_hemisphere").isNotNull() & regional)
                       & (F.col("spectrogram").isNull() | (F.col("spectrogram") == spectral))
                       & (F.col("contains").isNull() | name.contains(F.col("contains")))
                       & ~F.coalesce(F.exists("excludes", lambda x: name.contains(x)), F.lit(False)))
    out = F.when(shown, F.regexp_replace("common_name", r"(?i)_[\d.]+(?:-[\d.]+)?hz$", "")).otherwise(name)
    kept = hit.where((name != "") & ~name.rlike(r"_avg_|_avg$|_avg\d") & ~name.rlike(ELECTRODE_CHAIN))
    return kept.select("panel_id", out.alias("variable")).distinct()


def provenance(df: DataFrame, keys: list[str], sections: dict[str, list[str]]) -> DataFrame:
    """One JSON document per key with the named sections."""
    doc = F.to_json(F.struct(*[F.struct(*cols).alias(n) for n, cols in sections.items()]))
    return df.select(*keys, doc.alias("record"))


def alignment_block(reference: str = "reference", reference_ts: str = "reference_ts", event: str = "event_ts") -> Column:
    """How a recording's time axis was anchored, from the columns of ``timebase.reference_axis``."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.struct(
        F.coalesce(reference, F.lit("recording_start")).alias("time_reference"), stamp(reference_ts).alias("reference_time"), F.coalesce("is_aligned", F.lit(False)).alias("is_aligned"),
        stamp(event).alias("event_datetime"), F.col("hours_to_start").alias("hours_from_event_to_start"), F.coalesce("needs_trim", F.lit(False)).alias("has_pre_event_data"),
        F.coalesce("pre_event_hours", F.lit(0.0)).alias("pre_event_hours"), F.coalesce("warning", F.lit("")).alias("alignment_warning"))


def run_record(runs: DataFrame, keys: list[str], files: DataFrame, *, versions: dict[str, str], config: str, stages: list[str], clinical: list[str] = (),
               corrections: DataFrame | None = None, hash_strategy: str = "full_sha256") -> DataFrame:
    """(keys, record): the provenance of every run as one JSON document, with the same fields whatever is known.

    ``runs``: one row per run with the columns of ``alignment_block``, stage counts and
    clinical columns; ``files``: (keys, file, sha256); ``corrections``: (keys, segment, and
    what was applied). Files and corrections are in order of their names.
    """
    per_file = files.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("file", "sha256"))).alias("source_files"))
    out = join_keys(runs, per_file, keys, "left")
    if corrections is not None:
        rest = [c for c in corrections.columns if c not in keys and c != "segment"]
        applied = corrections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("segment", *rest))).alias("timing_corrections"))
        out = join_keys(out, applied, keys, "left")
    else:
        out = out.withColumn("timing_corrections", F.lit(None).cast("array<struct<segment: string>>"))
    doc = F.struct(
        F.struct(*[F.lit(v).alias(k) for k, v in sorted(versions.items())]).alias("versions"), F.lit(config).alias("config"), F.lit(hash_strategy).alias("hash_strategy"),
        F.coalesce("source_files", F.array().cast(out.schema["source_files"].dataType)).alias("source_files"), F.struct(*stages).alias("stage_row_counts"),
        (F.struct(*clinical) if clinical else F.lit(None).cast("string")).alias("clinical_metadata"),
        F.coalesce("timing_corrections", F.array().cast(out.schema["timing_corrections"].dataType)).alias("timing_corrections"), alignment_block().alias("alignment"))
    return out.select(*keys, F.to_json(doc, {"ignoreNullFields": "false"}).alias("record"))


def codebook_hash(dictionary: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Content hash of a dictionary, independent of row order.

    Every row is hashed and the hashes are added up in four parts, so the state
    per key is five numbers however many entries it has.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)
    part = lambda i: F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    summed = dictionary.withColumn("_h", row).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[part(i).alias(f"_p{i}") for i in range(4)])
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("_n", "_p0", "_p1", "_p2", "_p3")])
    return summed.select(*keys, F.sha2(text, 256).alias("codebook_hash"))
