"""Event analytics over boolean epochs: burden, onsets, runs, sliding burden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import col_of, count_where
from .ordered import join_keys, neighbours, runs, sliding_sum

# Fixed values of the status screen.
LONGEST_MINUTES = 30.0
HOURLY_BURDEN_PCT = 50.0
ONSET_GAP_MINUTES = 5.0

_ROLE_LABEL = (
    r"(?i)seizure\s*(probabilit|detect|notif|burden|mask)"
    r"|seizureprobabilit|seizuredetect|seizurenotif"
)


def role_of_label(label: str | Column) -> Column:
    """probability / detections / notifications, or null."""
    c, low = col_of(label), F.lower(col_of(label))
    return F.when(
        c.rlike(_ROLE_LABEL),
        F.when(low.contains("probability"), F.lit("probability"))
        .when(low.contains("detection"), F.lit("detections"))
        .when(low.contains("notification"), F.lit("notifications")),
    )


def role_columns(columns: DataFrame, keys: list[str], label: str = "label", code: str = "code", position: str = "col_idx") -> DataFrame:
    """One row per (keys, role): the last column of the export that plays the role."""
    tagged = columns.withColumn("role", role_of_label(label)).where(F.col("role").isNotNull())
    return tagged.groupBy(*keys, "role").agg(F.max_by(code, position).alias(code))


def event_mask(mode: str, probability: str | Column | None = None, detections: str | Column | None = None,
               threshold: float = 0.5) -> Column:
    if mode == "detected" and detections is not None:
        return F.coalesce(col_of(detections), F.lit(0.0)) > 0
    if mode == "probability" and probability is not None:
        return F.coalesce(col_of(probability), F.lit(0.0)) >= threshold
    return F.lit(False)


def _longest(df: DataFrame, keys: list[str], flag: str, out: str) -> DataFrame:
    return runs(df, keys, flag).where(F.col(flag)).groupBy(*keys).agg(F.max("run_rows").alias(out))


def longest_run_minutes(df: DataFrame, keys: list[str], flag: str, epoch_seconds: float = 1.0) -> DataFrame:
    longest = _longest(df, keys, flag, "_rows")
    return longest.select(*keys, (F.col("_rows") * epoch_seconds / 60.0).alias("longest_minutes"))


def event_onsets(df: DataFrame, keys: list[str], flag: str, hours: str = "hours") -> DataFrame:
    """Rows where the flag turns on, with the previous row's flag taken as off at the start."""
    linked = neighbours(df.withColumn(flag, F.coalesce(F.col(flag), F.lit(False))), keys, prev={"_pf": flag})
    return linked.where(F.col(flag) & ~F.coalesce(F.col("_pf"), F.lit(False))).drop("_pf")


def burden(df: DataFrame, keys: list[str], event: str, usable: str, probability: str | None = None,
           hours: str = "hours") -> DataFrame:
    """Totals, burden % over usable epochs, time to first event, raw and clean."""
    e, u = F.col(event), F.col(usable)
    aggs = [
        F.count(F.lit(1)).alias("n_epochs"),
        count_where(u).alias("n_usable"),
        count_where(e).alias("event_epochs"),
        count_where(e & u).alias("event_epochs_clean"),
        F.min(F.when(e, F.struct("row_idx", hours)))[hours].alias("hours_to_first"),
        F.min(F.when(e & u, F.struct("row_idx", hours)))[hours].alias("hours_to_first_clean"),
    ]
    if probability:
        aggs.append(F.max(probability).alias("max_probability"))
    return df.groupBy(*keys).agg(*aggs).withColumn(
        "burden_pct",
        F.when(F.col("n_usable") > 0, F.lit(100.0) * F.col("event_epochs_clean") / F.col("n_usable")).otherwise(F.lit(0.0)))


def event_counts(df: DataFrame, keys: list[str], flag: str, out: str) -> DataFrame:
    onsets = event_onsets(df, keys, flag)
    return join_keys(df.select(*keys).distinct(), onsets.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)), keys, "left").withColumn(
        out, F.coalesce(out, F.lit(0)))


def max_hourly_burden(df: DataFrame, keys: list[str], flag: str, overall: DataFrame, epoch_seconds: float = 1.0,
                      block: int | None = None) -> DataFrame:
    """Highest share of flagged rows in a full one-hour frame of rows, in percent.

    Recordings shorter than the frame take ``overall.burden_pct``.
    """
    frame = int(3600 / epoch_seconds)
    slid = sliding_sum(df, keys, F.col(flag).cast("int"), frame, "_s", block=block)
    top = slid.groupBy(*keys).agg((F.max("_s") * 100.0 / frame).alias("_top"))
    return join_keys(overall.select(*keys, "burden_pct"), top, keys, "left").select(
        *keys, F.coalesce("_top", "burden_pct").alias("max_hourly_burden_pct"))


def repeated_onsets(df: DataFrame, keys: list[str], flag: str, hours: str = "hours",
                    minutes: float = ONSET_GAP_MINUTES, order: list[str] | None = None) -> DataFrame:
    """Whether two onsets lie less than ``minutes`` apart (onset to onset)."""
    gaps = neighbours(event_onsets(df, keys, flag, hours), keys, next={"_nh": hours})
    return gaps.groupBy(*keys).agg(
        F.coalesce(F.bool_or((F.col("_nh") - F.col(hours)) * 60.0 < minutes), F.lit(False)).alias("repeated"))


def event_report(df: DataFrame, keys: list[str], event: str, usable: str, probability: str | None = None,
                 hours: str = "hours", epoch_seconds: float = 1.0) -> DataFrame:
    """One row per recording with every event statistic and the status screen flag."""
    clean = "_clean_event"
    marked = df.withColumn(clean, F.col(event) & F.col(usable))
    base = burden(marked, keys, event, usable, probability, hours)
    parts = [
        runs(marked, keys, event).where(F.col(event)).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("events"), F.max("run_rows").alias("_longest")),
        runs(marked, keys, clean).where(F.col(clean)).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("events_clean"), F.max("run_rows").alias("_longest_clean")),
        repeated_onsets(marked, keys, clean, hours),
        max_hourly_burden(marked, keys, clean, base, epoch_seconds),
    ]
    out = base
    for part in parts:
        out = join_keys(out, part, keys, "left")
    minutes = lambda c: F.coalesce(F.col(c), F.lit(0)) * epoch_seconds / 60.0
    return out.withColumns({
        "events": F.coalesce("events", F.lit(0)),
        "events_clean": F.coalesce("events_clean", F.lit(0)),
        "longest_minutes": minutes("_longest"),
        "longest_minutes_clean": minutes("_longest_clean"),
        "repeated": F.coalesce("repeated", F.lit(False)),
    }).drop("_longest", "_longest_clean").withColumn("status_screen", status_screen())


def status_screen(longest: str = "longest_minutes_clean", hourly: str = "max_hourly_burden_pct", repeated: str = "repeated") -> Column:
    return (F.col(longest) >= LONGEST_MINUTES) | (F.col(hourly) >= HOURLY_BURDEN_PCT) | F.col(repeated)


def flagged_regions(df: DataFrame, keys: list[str], good: str, hours: str = "hours") -> DataFrame:
    """Runs of bad epochs as intervals: first bad hour to the first good hour after it
    (or the last hour of the recording when it ends bad)."""
    linked = neighbours(df.withColumn("_bad", ~F.coalesce(F.col(good), F.lit(False))), keys, next={"_nh": hours})
    found = runs(linked, keys, "_bad", carry=[
        F.min_by(hours, "row_idx").alias("start_hours"),
        F.max_by(F.coalesce("_nh", hours), "row_idx").alias("end_hours"),
    ])
    return found.where(F.col("_bad")).select(*keys, "run_start", "run_rows", "start_hours", "end_hours")
