"""From export files to a cohort's results in one call.

Files are read in their own encodings, their columns get their identity, and every file's
cells are packed into one array column per instrument. Clocks are corrected where a whole
patient is covered by corrections, files of a patient whose clocks overlap are merged, and
the cohort plan runs with the parts that the dictionary names: leading power columns, the
null rule's instruments, artifact and event columns, bands, engines and variables.

Merging takes an instrument's values of one clock from the file in which the instrument is
present most often, and fills from the others; values of one instrument come and go
together, so they stay together. Rows without a clock take no part and are counted.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..config import CohortSettings
from ..functions import clock as ck
from ..operators import columns as cl
from ..operators import instruments as im
from ..operators import quality, timebase
from ..operators.bins import bin_labels
from ..operators.features import regional_features
from ..operators.ordered import join_keys, strip_layout
from ..sources import exports as ex
from ..sources.workdir import stored
from .cohort import CohortInputs, CohortResult, process_cohort

KEY = ["patient_id"]
#: Families whose single sub-columns are tested one by one, so they are columns of their own.
SPREAD_FAMILIES = ["artifact_intensity", "electrode_quality"]
#: Families without a place in bin statistics: events, flags and things that are not measured.
NOT_ANALYSED = ["artifact_intensity", "electrode_quality", "seizure_detection", "seizure_probability", "seizure_notification", "annotation", "time_display", "other"]


@dataclass(frozen=True)
class ExportsResult:
    """The cohort's tables, and what was found on the way."""

    cohort: CohortResult
    #: file, patient_id, segment, encoding-independent header fields, rows, clocks and corrections.
    files: DataFrame
    #: The dictionary of every file's columns, and where instruments keep their values.
    columns: DataFrame
    layout: DataFrame
    slots: list[im.Slot]
    #: Per patient: alignment, rejection by the null rule, ranges out of bounds, rows after each stage.
    alignment: DataFrame
    null_rule: DataFrame
    validation: DataFrame
    stages: DataFrame


def _present(slot: im.Slot) -> Column:
    return F.exists(slot.name, lambda v: v.isNotNull()) if slot.is_array else F.col(slot.name).isNotNull()


def file_table(lines: DataFrame, codes: DataFrame) -> DataFrame:
    """(file, patient_id, segment, dat_stem, csv_stem) and the header fields of every file with a code row."""
    head = join_keys(codes.select("file"), ex.header_metadata(lines), ["file"], "left")
    csv, own = timebase.stem_of(F.col("file")), F.col("patient_id")
    named = ex.valid_id(own) & (own != csv)
    return head.withColumns({"csv_stem": csv, "dat_stem": timebase.stem_of(F.coalesce("file_path", F.lit(""))),
                             "patient_id": F.when(named, own).otherwise(F.coalesce(F.nullif(timebase.patient_of(csv), F.lit("")), csv))}).withColumn("segment", F.col("csv_stem"))


def event_times(clinical: DataFrame) -> DataFrame:
    """(patient_id, event_ts, age_days, event_clock) of accepted clinical rows."""
    return clinical.groupBy("patient_id").agg(F.min(F.try_to_timestamp("event_datetime").cast("timestamp_ntz")).alias("event_ts"), F.min("age_days").alias("event_age"),
                                              F.min(ck.clock_seconds(F.col("event_time"))).alias("event_clock"))


def corrected_files(files: DataFrame, corrections: DataFrame | None, events: DataFrame | None) -> DataFrame:
    """(file, segment_start, shifted_event) of patients all of whose files have a correction and whose age at the event is known."""
    if corrections is None or events is None:
        return files.select("file", F.lit(None).cast("timestamp_ntz").alias("segment_start"), F.lit(None).cast("timestamp_ntz").alias("shifted_event")).where(F.lit(False))
    found = timebase.lookup_correction(files.select("file", *KEY, "dat_stem", "csv_stem"), corrections.select("new_name", "age_days", "clock"))
    whole = found.groupBy(*KEY).agg(F.bool_and("has_correction").alias("_all"))
    known = join_keys(join_keys(found, whole, KEY), events, KEY).where(F.col("_all") & F.col("event_age").isNotNull())
    anchor = timebase.birth_anchor(F.col("event_ts"), F.col("event_age"))
    return known.select("file", timebase.segment_start(anchor, F.col("age_days"), ck.clock_seconds(F.col("clock"))).alias("segment_start"),
                        timebase.shifted_event(F.col("event_ts"), F.col("event_age"), F.col("event_clock")).alias("shifted_event"))


def with_corrected_clocks(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows (file, line_idx, ts) with the clocks of corrected files moved to their new starts."""
    if starts.isEmpty():
        return rows
    mine = join_keys(rows, starts, ["file"], "left_semi")
    moved = timebase.correct_clocks(timebase.timeline(mine, ["file"], ["line_idx"]), ["file"], starts.select("file", "segment_start"))
    moved = stored(strip_layout(moved).withColumn("ts", F.col("corrected_ts")).select(*rows.columns), "moved")
    return rows.join(starts.select("file"), "file", "left_anti").select(*rows.columns).unionByName(moved)


def merged_rows(rows: DataFrame, slots: list[im.Slot]) -> DataFrame:
    """One row per patient and clock: the first row of a clock within a file, instruments of overlapping files merged."""
    again = rows.groupBy("file", "ts").agg(F.min("line_idx").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    single = rows.join(stored(again, "clocks"), ["file", "ts"], "left").where("_first IS NULL OR line_idx = _first").drop("_first")
    shared = stored(single.groupBy(*KEY, "ts").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*KEY, "ts"), "shared_clocks")
    density = single.groupBy(*KEY, "file").agg(F.array(*[F.count_if(_present(s)) for s in slots]).alias("_d"))
    both = join_keys(join_keys(single, shared, [*KEY, "ts"]), density, [*KEY, "file"])
    pick = lambda i, s: F.min_by(s.name, F.when(_present(s), F.struct(-F.get("_d", F.lit(i)), "file"))).alias(s.name)
    merged = both.groupBy(*KEY, "ts").agg(*[pick(i, s) for i, s in enumerate(slots)])
    return join_keys(single, shared, [*KEY, "ts"], "left_anti").select(*KEY, "ts", *[s.name for s in slots]).unionByName(merged)


def spread(rows: DataFrame, slots: list[im.Slot]) -> tuple[DataFrame, list[quality.Instrument], dict[str, list[str]]]:
    """Rows, instruments of the null rule and scalar columns by family, with the arrays of SPREAD_FAMILIES as single columns."""
    new, gone, instruments, scalars = {}, [], [], {}
    for s, ins in zip(slots, im.null_rule_instruments(slots)):
        names = (s.name,)
        if s.is_array and s.family in SPREAD_FAMILIES:
            names = tuple(f"{s.name}_{i}" for i in range(1, s.width + 1))
            new |= {n: F.get(s.name, F.lit(i)) for i, n in enumerate(names)}
            gone.append(s.name)
            ins = quality.Instrument(s.name, s.family, s.region, names)
        instruments.append(ins)
        if not s.is_array or s.family in SPREAD_FAMILIES:
            scalars.setdefault(s.family, []).extend(names)
    return (rows.withColumns(new) if new else rows).drop(*gone), instruments, scalars


def cohort_inputs(rows: DataFrame, slots: list[im.Slot], events: DataFrame | None, variables: list[str] | None = None,
                  real_zeros: list[str] = ()) -> CohortInputs:
    """The cohort plan's inputs, with every part taken from the dictionary's families and names.

    A row is a leading zero row if all power columns hold suppressed zeros, which cannot be
    where one of them is in ``real_zeros``.
    """
    wide, instruments, of = spread(rows, slots)
    instruments = [replace(i, real_zeros=i.name in real_zeros) for i in instruments]
    leading = of.get("fft_power", [])
    family = {n: f for f, names in of.items() for n in names}
    bands = [b for b in C.FREQUENCY_BANDS if any(f"fft_{b}_{side}_{r}" in family for side in ("left", "right") for r in ("anterior", "posterior"))]
    made = [c for c in regional_features(wide, bands).columns if c not in wide.columns and not c.endswith("_sides_contributing")]
    own = [n for n, f in family.items() if f not in NOT_ANALYSED]
    engine = {n: C.FAMILY_ENGINES.get(f) for n, f in family.items()} | {n: C.FAMILY_ENGINES["fft_power"] for n in made}
    engines = {e: ([n for n in family if engine[n] == e], k) for e, k in C.ENGINE_CADENCE.items() if k > 1}
    engines = {e: x for e, x in engines.items() if x[0]}
    chosen = variables if variables is not None else own + made
    last = lambda f: of[f][-1] if f in of else None
    return CohortInputs(
        wide, KEY, ["ts"], event_times=events, leading=[] if set(leading) & set(real_zeros) else leading, instruments=instruments, intensity=of.get("artifact_intensity", []), quality=of.get("electrode_quality", []),
        probability=last("seizure_probability"), detections=last("seizure_detection"), suppression=of.get("suppression_ratio", []), bands=bands, engines=engines,
        variables=chosen, variable_engine={v: engine[v] for v in chosen if engine.get(v) in engines})


def process_exports(spark: SparkSession, path: str | list[str], clinical: DataFrame | None = None, corrections: DataFrame | None = None,
                    settings: CohortSettings | None = None, variables: list[str] | None = None, real_zeros: list[str] = (),
                    bundled: bool = False) -> ExportsResult:
    """Run everything over the export files under ``path``.

    ``clinical`` and ``corrections`` are the accepted rows of ``tables.read_clinical`` and
    ``tables.read_corrections``. With clinical times, time counts from the event wherever
    the recording is aligned with it. Zeros of instruments named in ``real_zeros`` are
    measured values, not suppressed ones. ``bundled`` files hold several exports each.
    """
    lines = stored(ex.read_exports(spark, path, bundled), "lines")
    codes = stored(ex.code_rows(lines), "codes")
    headers = stored(ex.header_files(lines, codes), "headers")
    own = codes.join(headers.where("file = header_file").select("file"), "file", "left_semi")
    columns = stored(cl.drop_discarded(cl.build_dictionary(cl.parse_codes(ex.export_columns(lines, own)), ["file"])), "dictionary")
    layout = stored(im.instrument_layout(columns, ["file"], "common_name"), "layout")
    slots = im.cohort_slots(layout)
    files = stored(file_table(lines, codes), "files")
    placed = codes.join(headers, "file").join(files.select("file", *KEY), "file")
    packed = stored(im.pack_lines(lines, placed, layout, slots, "header_file", KEY).withColumnRenamed("row_idx", "line_idx").drop("serial"), "packed")

    events = event_times(clinical) if clinical is not None else None
    starts = stored(corrected_files(files, corrections, events), "starts")
    clocked = with_corrected_clocks(packed, starts).where("ts IS NOT NULL")
    if events is not None:
        moved = join_keys(files, starts, ["file"]).groupBy(*KEY).agg(F.min("shifted_event").alias("_shifted"))
        events = join_keys(events, moved, KEY, "left").select(*KEY, F.coalesce("_shifted", "event_ts").alias("event_ts"))
    rows = stored(merged_rows(clocked, slots), "merged")

    inputs = cohort_inputs(rows, slots, events, variables, real_zeros)
    result = process_cohort(inputs, settings)
    per_file = packed.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.count("ts").alias("n_clocked"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    report = join_keys(join_keys(files, per_file, ["file"], "left"), starts.select("file", "segment_start"), ["file"], "left")
    begin = rows.groupBy(*KEY).agg(F.min("ts").alias("start_ts"))
    begin = join_keys(begin, events, KEY, "left") if events is not None else begin.withColumn("event_ts", F.lit(None).cast("timestamp_ntz"))
    aligned = timebase.alignment_guard(begin, "event_ts", "start_ts")
    aligned = aligned.withColumns({"reference": F.when(F.col("is_aligned"), "event").otherwise("recording_start"),
                                   "reference_ts": F.when(F.col("is_aligned"), F.col("event_ts")).otherwise(F.col("start_ts"))})
    ranges = {f: names for f, names in spread(rows, slots)[2].items()}
    every = lambda df: headers.join(df.withColumnRenamed("file", "header_file"), "header_file").drop("header_file")
    return ExportsResult(result, report, every(columns), every(layout), slots, aligned, quality.rejection_report(inputs.epochs, KEY, list(inputs.instruments)),
                         quality.out_of_range(inputs.epochs, KEY, ranges), stage_rows(packed, rows, result, inputs, settings or CohortSettings()))


def stage_rows(packed: DataFrame, merged: DataFrame, result: CohortResult, inputs: CohortInputs, settings: CohortSettings) -> DataFrame:
    """Rows of every patient after each stage, from the files to the bins.

    Bins without rows are emitted too, so a patient with epochs has every configured bin.
    """
    count = lambda df, **how: df.groupBy(*KEY).agg(*[c.alias(n) for n, c in how.items()])
    out = count(packed, parsed=F.count(F.lit(1)), without_clock=F.count_if(F.col("ts").isNull()))
    out = join_keys(out, count(merged, merged=F.count(F.lit(1))), KEY, "left")
    zeros = quality.leading_zero_rows(strip_layout(timebase.timeline(inputs.epochs, KEY, inputs.order)), KEY, list(inputs.leading)) if inputs.leading else None
    if zeros is not None:
        out = join_keys(out, zeros.withColumnRenamed("leading_zero_rows", "leading_zero_removed"), KEY, "left")
    else:
        out = out.withColumn("leading_zero_removed", F.lit(0).cast("long"))
    after = count(result.epochs, post_event_trim=F.count(F.lit(1)), artifact_clean=F.count_if("artifact_clean"), seizure_flagged=F.count_if("seizure"), usable=F.count_if("usable"))
    out = join_keys(out, after, KEY, "left")
    out = out.withColumn("binned_rows", F.when(F.col("usable").isNotNull(), F.lit(len(set(bin_labels(list(settings.bins.edges))))).cast("long")))
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("merged", "leading_zero_removed", "post_event_trim", "artifact_clean", "seizure_flagged", "usable")})
    return out.withColumn("pre_event_trimmed", F.col("merged") - F.col("leading_zero_removed") - F.col("post_event_trim"))
