"""A whole cohort as one plan: epochs in, epoch table, bins and reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CohortSettings
from ..functions.numbers import clean_nan
from ..operators import bins, events, features, quality, timebase
from ..operators.ordered import join_keys, strip_layout
from ..sources.workdir import stored


@dataclass(frozen=True)
class CohortInputs:
    """Named columns of a cohort's wide epoch table.

    ``epochs`` has the key columns, a timestamp and the signals. The rest says which
    columns play which part; parts that are absent are skipped.
    """

    epochs: DataFrame
    keys: list[str]
    order: list[str]
    ts: str = "ts"
    event_times: DataFrame | None = None
    leading: list[str] = ()
    instruments: list[quality.Instrument] = ()
    intensity: list[str] = ()
    quality: list[str] = ()
    probability: str | None = None
    detections: str | None = None
    suppression: list[str] = ()
    bands: list[str] = ()
    engines: dict[str, tuple[list[str], int]] = None
    variables: list[str] = ()
    variable_engine: dict[str, str] = None


@dataclass(frozen=True)
class CohortResult:
    epochs: DataFrame
    bins: DataFrame
    events: DataFrame
    qc: DataFrame


def process_cohort(inputs: CohortInputs, settings: CohortSettings | None = None) -> CohortResult:
    """Run every stage in order for all recordings at once.

    Suppressed zeros become null before the artifact filter, burden uses the mask
    before event exclusion, and independence is decided on all trimmed rows, anew after
    every gap of their clocks. The epoch table is written once; bins and reports read it with pruned columns.
    """
    cfg = settings or CohortSettings()
    keys, ts = inputs.keys, inputs.ts
    floats = [f.name for f in inputs.epochs.schema if f.dataType.typeName() in ("double", "float")]
    raw = inputs.epochs.withColumns({c: clean_nan(c) for c in floats}) if floats else inputs.epochs
    df = timebase.timeline(raw, keys, inputs.order, ts)
    parsed = stored(quality.parsed_counts(df, keys, list(inputs.leading)), "parsed")
    if inputs.leading:
        df = timebase.timeline(strip_layout(quality.drop_leading_zeros(df, keys, list(inputs.leading))).drop("row_idx", "n_rows", "start_ts"),
                               keys, inputs.order, ts)
    if inputs.event_times is not None:
        df = timebase.trim_before_event(timebase.reference_axis(df, keys, inputs.event_times, ts=ts))
        drop = ["row_idx", "n_rows", "start_ts", "hours_to_start", "is_aligned", "needs_trim", "pre_event_hours", "warning", "reference", "reference_ts"]
        kept = strip_layout(df).drop(*[c for c in drop if c in df.columns])
        df = timebase.timeline(kept, keys, inputs.order, ts)
    else:
        df = timebase.hours_relative(df, "start_ts", ts)
    df = timebase.step_support(stored(df, "timeline"), keys, ts, cfg.epoch_seconds)  # several steps read it, each more than once
    if inputs.instruments:
        df = quality.null_suppressed_zeros(df, keys, list(inputs.instruments))
    else:
        df = df.withColumn("all_regions", F.lit(False))
    clean = quality.artifact_clean(df, cfg.artifact.mode, list(inputs.intensity), list(inputs.quality), None, cfg.artifact.intensity_limit,
                                   cfg.artifact.quality_pct, cfg.artifact.min_electrodes)
    if cfg.artifact.exclude_blank:
        clean = quality.exclude_blank(clean)
    mask = events.event_mask(cfg.event.mode, inputs.probability, inputs.detections, cfg.event.threshold)
    df = df.withColumns({"artifact_clean": clean, "seizure": mask})
    df = df.withColumn("usable", quality.usable_mask("artifact_clean", "seizure", cfg.event.mode != "none"))
    if inputs.bands:
        df = features.regional_features(df, list(inputs.bands), cfg.require_both_sides)
        for region in ("anterior", "posterior"):
            df = features.derived_features(df, region)
    if inputs.engines:
        df = features.independent_masks(df, keys, {f"independent_{n}": spec for n, spec in inputs.engines.items()}, ts)
    epochs = stored(strip_layout(df), "epochs")

    masks = {v: f"independent_{e}" for v, e in (inputs.variable_engine or {}).items()}
    basis = {v: f"{e}_cadence_adjusted" for v, e in (inputs.variable_engine or {}).items()}
    summary = bins.aggregate_bins(
        epochs, keys, list(inputs.variables), list(cfg.bins.edges), masks=masks, basis=basis, min_hours=cfg.bins.min_hours, event="seizure",
        event_base="artifact_clean", suppression=list(inputs.suppression) or None, threshold=cfg.bins.continuity_threshold)
    again = timebase.timeline(epochs.drop("row_idx", "n_rows", "start_ts"), keys, inputs.order, ts)
    report = events.event_report(again, keys, "seizure", "artifact_clean", inputs.probability, epoch_seconds=cfg.epoch_seconds)
    return CohortResult(epochs, summary, report, quality.qc_of_parsed(quality.qc_report(epochs, keys, ts), parsed, keys))


def cohort_summary(result: CohortResult, keys: list[str]) -> DataFrame:
    """One row per recording: quality and event columns side by side."""
    return join_keys(result.qc, result.events.drop("n_epochs", "n_usable", "event_epochs"), keys, "left")
