"""Stored timelines and counted bin statistics against the operators that work without a store."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import bins, events, features, timebase
from tracelake.operators.bincounts import aggregate_timeline
from tracelake.operators.ordered import strip_layout
from tracelake.operators.stored_timeline import REC, corrected_clocks, recording_name, store_timeline, with_support

T0 = dt.datetime(2025, 3, 15, 10)


@pytest.fixture(scope="module")
def epochs(spark):
    rng, rows = random.Random(4), []
    for pid, site, n in (("a", "x", 60), ("b", "x", 25), ("a", None, 12), (None, "x", 7), ("a|1:x", "", 1)):
        at = 0
        for i in range(n):
            at += rng.choice([0, 10, 10, 10, 90, 3000])
            value = rng.choice([None, 0.0, 1.0, 1.0, rng.random() * 40, -3.0])
            rows.append((pid, site, i, T0 + dt.timedelta(seconds=at), value, rng.random() < 0.3, rng.random() < 0.8, None if value is None else value / 7))
    return spark.createDataFrame(rows, "pid string, site string, i long, ts timestamp_ntz, fft_x double, seizure boolean, ok boolean, y double")


KEYS = ["pid", "site"]


def table(df, ids, columns):
    show = lambda v: f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(show(r[c]) for c in [*ids, *columns]) for r in df.collect())


def test_names_of_recordings(spark):
    rows = [("a", "b"), ("a|1:b", None), (None, "b"), ("a", None), ("-", "b"), ("", "ab"), ("a", "|b")]
    names = [r[0] for r in spark.createDataFrame(rows, "pid string, site string").select(recording_name(KEYS)).collect()]
    assert len(set(names)) == len(rows) and None not in names


@pytest.mark.parametrize("layout, buckets", [("plain", None), ("sliced", None), ("plain", 3)], indirect=["layout"])
def test_store(spark, layout, epochs, buckets):
    tl = store_timeline(epochs, KEYS, ["ts", "i"], buckets=buckets)
    plain = timebase.with_steps(timebase.timeline(epochs, KEYS, ["ts", "i"]), KEYS)
    columns = ["i", "row_idx", "n_rows", "start_ts", "step_prev", "step_next"]
    assert table(tl.rows, KEYS, columns) == table(plain, KEYS, columns)
    medians = timebase.group_median(plain.where("step_next > 0"), KEYS, "step_next", "median_step")
    expected = plain.groupBy(*KEYS).agg(F.max("n_rows").alias("n_rows"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")).join(
        medians.withColumnsRenamed({k: f"_{k}" for k in KEYS}), (F.col("pid").eqNullSafe(F.col("_pid"))) & (F.col("site").eqNullSafe(F.col("_site"))), "left")
    assert table(tl.recordings, KEYS, ["n_rows", "start_ts", "end_ts", "median_step"]) == table(expected, KEYS, ["n_rows", "start_ts", "end_ts", "median_step"])
    if layout == "plain":
        plan = with_support(tl)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan


def test_support_and_events(spark, layout, epochs):
    tl = store_timeline(epochs, KEYS, ["ts", "i"])
    lazy = timebase.timeline(epochs, KEYS, ["ts", "i"])
    assert table(with_support(tl), KEYS, ["i", "support_hours"]) == table(timebase.step_support(lazy, KEYS), KEYS, ["i", "support_hours"])
    hours = lambda df: timebase.hours_relative(df, "start_ts")
    columns = ["n_epochs", "events", "events_clean", "longest_minutes_clean", "repeated", "burden_pct", "max_hourly_burden_pct", "status_screen"]
    own = events.event_report(hours(tl.rows), [REC], "seizure", "ok", epoch_seconds=300.0).join(tl.recordings.select(REC, *KEYS), REC)
    assert table(own, KEYS, columns) == table(events.event_report(hours(lazy), KEYS, "seizure", "ok", epoch_seconds=300.0), KEYS, columns)


def test_bins_equal_the_plain_summary(spark, layout, epochs):
    edges, names = [0, 1, 4, 9], ["fft_x", "y"]
    tl = store_timeline(epochs, KEYS, ["ts", "i"])
    mark = lambda df, keys: features.independent_mask(timebase.hours_relative(df, "start_ts").withColumn("usable", F.col("ok") & ~F.col("seizure")), keys, ["fft_x"], 3, "own")
    how = dict(masks={"fft_x": "own"}, basis={"fft_x": "power"}, min_hours=0.05, event="seizure", event_base="ok", suppression=["y"])
    own = aggregate_timeline(mark(with_support(tl), [REC]), names, edges, **how).join(tl.recordings.select(REC, *KEYS), REC)
    plain = bins.aggregate_bins(strip_layout(mark(timebase.step_support(timebase.timeline(epochs, KEYS, ["ts", "i"]), KEYS), KEYS)), KEYS, names, edges, **how)
    columns = [c for c in plain.columns if c not in KEYS]
    assert set(columns) <= set(own.columns) and table(own, KEYS, columns) == table(plain, KEYS, columns)
    assert sum(r["median"] is not None for r in own.collect()) > 5


def test_corrected_clocks(spark, layout, epochs):
    tl = store_timeline(epochs, KEYS, ["ts", "i"])
    starts = epochs.where("pid = 'a' OR pid IS NULL").select(*KEYS).distinct().withColumn("segment_start", F.lit(dt.datetime(2001, 1, 1)).cast("timestamp_ntz"))
    lazy = timebase.correct_clocks(timebase.timeline(epochs, KEYS, ["ts", "i"]), KEYS, starts)
    assert table(corrected_clocks(tl, starts), KEYS, ["i", "corrected_ts"]) == table(lazy, KEYS, ["i", "corrected_ts"])
