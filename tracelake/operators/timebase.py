"""Time axis: reference selection, alignment, clock correction, steps and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import add_seconds, hours_between, micros_between
from ..functions.numbers import col_of, count_where
from ..sources.workdir import stored
from .ordered import index_rows, is_sliced, join_keys, neighbours, running, strip_layout
from .orderstats import group_median

# Longest accepted delay from the event to the recording start, gap
# thresholds, and the cap on one row's time support in median steps.
MAX_EVENT_TO_START_HOURS = 22.0
GAP_SECONDS = 60.0
AUDIT_GAP_SECONDS = 1.5
SUPPORT_CAP_STEPS = 3.0
DISPLAY_GAP_STEPS, DISPLAY_GAP_MIN_HOURS = 5.0, 0.5
SHIFTED_BIRTHDAY = "2000-01-01"


def timeline(df: DataFrame, keys: list[str], order: list[str], ts: str = "ts", start: str = "start_ts") -> DataFrame:
    """Row numbers per key plus the first timestamp of the key on every row."""
    return running(index_rows(df, keys, order), keys, {start: ("min", ts)})


def stored_if_sliced(df: DataFrame) -> DataFrame:
    """Cut the lineage of a timeline that holds hot keys; others stay lazy."""
    return stored(df, "timeline") if is_sliced(df) else df


def hours_relative(df: DataFrame, reference: str | Column, ts: str = "ts", out: str = "hours") -> DataFrame:
    return df.withColumn(out, hours_between(reference, ts))


def alignment_guard(df: DataFrame, event: str | Column, start: str | Column,
                    limit: float = MAX_EVENT_TO_START_HOURS) -> DataFrame:
    """Decide per row (one recording) whether time may be counted from the event."""
    h = hours_between(event, start)
    return df.withColumn("hours_to_start", h).withColumns({
        "is_aligned": F.coalesce(F.col("hours_to_start") <= limit, F.lit(False)),
        "needs_trim": F.coalesce(F.col("hours_to_start") < 0, F.lit(False)),
        "pre_event_hours": F.when(F.col("hours_to_start") < 0, -F.col("hours_to_start")).otherwise(F.lit(0.0)),
        "warning": F.when(F.col("hours_to_start").isNull(), F.lit("no event or start time; using recording-relative time"))
        .when(F.col("hours_to_start") < 0, F.lit("recording starts before the event; earlier epochs are trimmed"))
        .when(F.col("hours_to_start") > limit, F.lit("recording starts too long after the event; dates may be shifted"))
        .otherwise(F.lit("")),
    })


def reference_axis(df: DataFrame, keys: list[str], events: DataFrame, event: str = "event_ts", ts: str = "ts",
                   start: str = "start_ts") -> DataFrame:
    """Add ``reference`` (event / recording_start), ``reference_ts`` and ``hours``.

    ``df`` comes from :func:`timeline`; ``events`` has one row per key.
    """
    joined = join_keys(df, events.select(*keys, event), keys, "left")
    guarded = alignment_guard(joined, event, start)
    return guarded.withColumns({
        "reference": F.when(F.col("is_aligned"), F.lit("event")).otherwise(F.lit("recording_start")),
        "reference_ts": F.when(F.col("is_aligned"), F.col(event)).otherwise(F.col(start)),
    }).withColumn("hours", hours_between("reference_ts", ts))


def trim_before_event(df: DataFrame, hours: str = "hours") -> DataFrame:
    """Drop epochs before the event; recordings counted from their own start have none."""
    return df.where(F.col(hours) >= 0)


def trimmed_counts(df: DataFrame, keys: list[str], hours: str = "hours") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_where(F.col(hours) < 0).alias("n_trimmed"),
    )


def with_steps(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Seconds to the next row (``step_next``) and from the previous (``step_prev``)."""
    out = neighbours(df, keys, prev={"_pts": ts}, next={"_nts": ts})
    return out.withColumns({
        "step_prev": micros_between("_pts", ts) / F.lit(1e6),
        "step_next": micros_between(ts, "_nts") / F.lit(1e6),
    }).drop("_pts", "_nts")


def step_support(df: DataFrame, keys: list[str], ts: str = "ts", fallback_seconds: float = 1.0,
                 out: str = "support_hours") -> DataFrame:
    """Hours of recording each row stands for.

    The forward step, or the median positive step when there is none or it is not
    positive, capped at three median steps so that gaps do not count as observed.
    """
    stepped = with_steps(df, keys, ts)
    medians = group_median(stepped.where(F.col("step_next") > 0), keys, "step_next", "median_step")
    joined = join_keys(stepped, medians, keys, "left")
    med = F.coalesce(F.col("median_step"), F.lit(float(fallback_seconds)))
    own = F.when(F.col("step_next") > 0, F.col("step_next")).otherwise(med)
    return joined.withColumn(out, F.least(own, med * SUPPORT_CAP_STEPS) / 3600.0)


def timestamp_gaps(df: DataFrame, keys: list[str], ts: str = "ts", seconds: float = GAP_SECONDS) -> DataFrame:
    """Gaps longer than ``seconds``: row numbers on both sides and the length."""
    return with_steps(df, keys, ts).where(F.col("step_prev") > seconds).select(
        *keys, (F.col("row_idx") - 1).alias("start_idx"), F.col("row_idx").alias("end_idx"),
        F.col("step_prev").alias("gap_seconds"))


def display_gaps(df: DataFrame, keys: list[str], ts: str = "ts", hours: str = "hours") -> DataFrame:
    """Gaps worth drawing: longer than five median steps and half an hour."""
    stepped = with_steps(df, keys, ts)
    medians = group_median(stepped, keys, "step_prev", "median_step")
    joined = join_keys(stepped, medians, keys)
    limit = F.greatest(F.col("median_step") * DISPLAY_GAP_STEPS, F.lit(DISPLAY_GAP_MIN_HOURS * 3600))
    return joined.where(F.col("step_prev") > limit).select(
        *keys, (F.col(hours) - F.col("step_prev") / 3600.0).alias("start_hours"), F.col(hours).alias("end_hours"))


def axis_audit(df: DataFrame, keys: list[str], ts: str = "ts", gap_seconds: float = AUDIT_GAP_SECONDS,
               counter: str | None = None) -> DataFrame:
    """Step range, gap count / total / largest, span and (optionally) counter consistency."""
    stepped = with_steps(df, keys, ts)
    gap = F.col("step_prev") > gap_seconds
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.min("step_prev").alias("step_min"),
        F.max("step_prev").alias("step_max"),
        count_where(gap).alias("n_gaps"),
        F.coalesce(F.sum(F.when(gap, F.col("step_prev"))), F.lit(0.0)).alias("gap_total"),
        F.coalesce(F.max(F.when(gap, F.col("step_prev"))), F.lit(0.0)).alias("gap_largest"),
        (micros_between(F.min(ts), F.max(ts)) / F.lit(3.6e9)).alias("span_hours"),
    ]
    if counter:
        stepped = neighbours(stepped, keys, prev={"_pc": counter})
        aggs.append(F.coalesce(F.bool_and(F.col("_pc").isNull() | (F.col(counter) == F.col("_pc") + 1)), F.lit(True)).alias("counter_ok"))
    return stepped.groupBy(*keys).agg(*aggs)


# ---- segments and corrected clocks -------------------------------------------


def stem_of(path: Column) -> Column:
    """File stem with a trailing ``-N`` written ``_N``."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"-(\d+)$", "_$1")


def patient_of(stem: str | Column) -> Column:
    return F.substring_index(col_of(stem), "_", 1)


def lookup_correction(segments: DataFrame, corrections: DataFrame, primary: str = "dat_stem", fallback: str = "csv_stem",
                      name: str = "new_name") -> DataFrame:
    """Attach the correction named by the embedded stem, else by the file stem."""
    cols = [c for c in corrections.columns if c != name]
    first = corrections.select(F.col(name).alias("_n1"), *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(True).alias("_has1"))
    second = corrections.select(F.col(name).alias("_n2"), *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(True).alias("_has2"))
    out = segments.join(first, F.col(primary) == F.col("_n1"), "left").join(second, F.col(fallback) == F.col("_n2"), "left")
    picked = {c: F.when(F.col("_has1"), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")) for c in cols}
    picked["has_correction"] = F.coalesce(F.col("_has1"), F.col("_has2"), F.lit(False))
    return out.withColumns(picked).drop("_n1", "_n2", "_has1", "_has2", *[f"_a_{c}" for c in cols], *[f"_b_{c}" for c in cols])


def order_segments(segments: DataFrame, keys: list[str], age: str = "age_days", clock: str = "clock",
                   path: str = "path", out: str = "position") -> DataFrame:
    """Number segments by (age, clock text, path); those without a correction come last."""
    sort = {"_no": F.col(age).isNull().cast("int"), "_a": F.coalesce(F.col(age), F.lit(0)), "_c": F.coalesce(F.col(clock), F.lit(""))}
    indexed = index_rows(segments.withColumns(sort), keys, ["_no", "_a", "_c", path], row=out, total="_n")
    return strip_layout(indexed).withColumn(out, F.col(out) + 1).drop("_no", "_a", "_c", "_n")


def birth_anchor(event_ts: Column, age_days: Column) -> Column:
    """Event minus age; a fixed day when only the event's clock time is known."""
    known = add_seconds(event_ts, -age_days * 86400.0)
    return F.when(event_ts.isNotNull(), known).otherwise(F.lit(SHIFTED_BIRTHDAY).cast("timestamp_ntz"))


def shifted_event(event_ts: Column, age_days: Column, clock_sec: Column) -> Column:
    anchor = F.lit(SHIFTED_BIRTHDAY).cast("timestamp_ntz")
    return F.coalesce(event_ts, add_seconds(anchor, age_days * 86400.0 + clock_sec))


def segment_start(anchor: Column, age_days: Column, clock_sec: Column) -> Column:
    """Day of the anchor plus age in days plus clock time."""
    return add_seconds(F.date_trunc("DAY", anchor).cast("timestamp_ntz"), age_days * 86400.0 + clock_sec)


def correct_clocks(epochs: DataFrame, segment_keys: list[str], starts: DataFrame, ts: str = "ts", start: str = "segment_start",
                   fallback_seconds: float = 1.0, out: str = "corrected_ts") -> DataFrame:
    """Re-anchor every segment at its corrected start.

    Offsets inside the segment are kept. When any clock is missing or the clock
    does not increase, rows are spaced by the median positive step instead.
    ``epochs`` comes from :func:`timeline` over ``segment_keys``; ``starts`` has one
    row per segment.
    """
    stepped = with_steps(epochs, segment_keys, ts)
    shape = stepped.groupBy(*segment_keys).agg(
        F.bool_or(F.col(ts).isNull() | (F.coalesce(F.col("step_prev"), F.lit(1.0)) <= 0)).alias("_broken"),
        F.min_by(ts, "row_idx").alias("_first"),
    )
    medians = group_median(stepped.where(F.col("step_prev") > 0), segment_keys, "step_prev", "_step")
    per_segment = join_keys(join_keys(starts, shape, segment_keys), medians, segment_keys, "left")
    joined = join_keys(stepped, per_segment.select(*segment_keys, start, "_broken", "_first", "_step"), segment_keys)
    spaced = F.col("row_idx") * F.coalesce(F.col("_step"), F.lit(float(fallback_seconds)))
    offset = F.when(F.col("_broken"), spaced).otherwise(micros_between("_first", ts) / F.lit(1e6))
    return joined.withColumn(out, add_seconds(F.col(start), offset)).drop("_broken", "_first", "_step", "step_prev", "step_next")


def counter_blocks(df: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """Blocks that begin where the row counter does not increase; first / last per block."""
    linked = neighbours(df, keys, prev={"_pc": counter})
    begins = F.when(F.col("_pc").isNull() | (F.col(counter) <= F.col("_pc")), F.col("row_idx"))
    return running(linked, keys, {"block_start": ("max", begins)}).drop("_pc")


def block_bounds(blocks: DataFrame, keys: list[str], counter: str, ts: str = "ts") -> DataFrame:
    return blocks.groupBy(*keys, "block_start").agg(
        F.count(F.lit(1)).alias("block_rows"),
        F.min_by(counter, "row_idx").alias("counter_first"),
        F.max_by(counter, "row_idx").alias("counter_last"),
        F.min(ts).alias("ts_first"),
        F.max(ts).alias("ts_last"),
    )


def locate_blocks(blocks: DataFrame, keys: list[str], others: DataFrame, other_keys: list[str], value: str,
                  row: str = "row_idx") -> DataFrame:
    """Other exports that contain a whole block as an aligned run of equal values.

    ``value`` must identify a row inside one export (a clock does). Candidates come
    from the block's first row, are cut down by its last row, and only those that
    remain are compared row by row at their shift.
    """
    ends = blocks.groupBy(*keys, "block_start").agg(
        F.count(F.lit(1)).alias("block_rows"), F.min(row).alias("_i0"), F.max(row).alias("_i1"),
        F.min_by(value, row).alias("_v0"), F.max_by(value, row).alias("_v1"))
    outer = [f"other_{k}" for k in other_keys]
    right = others.select(*[F.col(k).alias(o) for k, o in zip(other_keys, outer)], F.col(row).alias("_j"), F.col(value).alias("_w"))
    start = ends.join(right, F.col("_v0") == F.col("_w")).withColumn("row_shift", F.col("_j") - F.col("_i0")).drop("_j", "_w")
    at = right.withColumnsRenamed({o: f"_x_{o}" for o in outer})
    same = lambda place: [F.col(o) == F.col(f"_x_{o}") for o in outer] + [F.col("_j") == place]
    found = start.join(at, [*same(F.col("_i1") + F.col("row_shift")), F.col("_v1") == F.col("_w")], "left_semi")
    rows = join_keys(blocks.select(*keys, "block_start", F.col(row).alias("_i"), F.col(value).alias("_v")),
                     found.select(*keys, "block_start", "block_rows", *outer, "row_shift"), [*keys, "block_start"])
    matched = rows.join(at, [*same(F.col("_i") + F.col("row_shift")), F.col("_v") == F.col("_w")])
    return matched.groupBy(*keys, "block_start", *outer, "row_shift", "block_rows").agg(F.count(F.lit(1)).alias("_m")).where(
        F.col("_m") == F.col("block_rows")).drop("_m")
