"""Literal expectations for single operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tracelake.functions import clock, labels
from tracelake.operators import bins, columns, events, features, merge, profile, quality, retrieve, shapes, timebase
from tracelake.operators.ordered import index_rows

T0 = dt.datetime(2025, 3, 15, 10, 0, 0)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def flags(spark, values, usable=None, step_hours=1 / 3600):
    usable = usable or [True] * len(values)
    rows = [("p", i, i * step_hours, v, u) for i, (v, u) in enumerate(zip(values, usable))]
    return index_rows(spark.createDataFrame(rows, "patient_id string, i int, hours double, seizure boolean, usable boolean"), ["patient_id"], ["i"])


def test_bin_labels_and_edges():
    assert bins.bin_labels([0, 6, 24, 72]) == ["0-6h", "6-24h", "24-72h"]
    with pytest.raises(ValueError):
        bins.check_edges([0, 6, 6])


def test_bin_assignment(spark):
    df = spark.createDataFrame([(0.0,), (6.0,), (100.0,)], "hours double")
    assert [r.b for r in bins.assign_bins(df, [0, 6, 12], out="b").collect()] == ["0-6h", "6-12h", None]


def test_bin_stats_literals(spark):
    df = spark.createDataFrame([("p", float(v)) for v in (1, 2, 3, 4, 5)], "k string, v double")
    r = bins.bin_stats(df, ["k"], "v").first()
    assert (r.median, r["mean"], r.iqr, r.n) == (3.0, 3.0, 2.0, 5)
    masked = spark.createDataFrame([("p", v, m) for v, m in zip((10.0, 20.0, 30.0, 40.0, 50.0), (True, False, True, False, True))], "k string, v double, m boolean")
    r = bins.bin_stats(masked, ["k"], "v", F.col("m")).first()
    assert (r.n_effective, r.n_observed, r["mean"]) == (3, 5, 30.0)
    geo = bins.bin_stats(spark.createDataFrame([("p", 1.0), ("p", 10.0), ("p", 100.0)], "k string, v double"), ["k"], "v").first()
    assert abs(geo.log_mean - 10.0) < 1e-9


def test_coverage_of_partial_bin_and_low_coverage(spark, layout):
    rows = [("p", T0 + dt.timedelta(hours=3, seconds=10 * i), True) for i in range(1080)]
    df = timebase.timeline(spark.createDataFrame(rows, "patient_id string, ts timestamp_ntz, usable boolean"), ["patient_id"], ["ts"])
    df = timebase.hours_relative(df, F.lit(T0).cast("timestamp_ntz"))
    out = {r.bin_label: r for r in bins.bin_coverage(timebase.step_support(df, ["patient_id"]), ["patient_id"], [0, 6, 12]).collect()}
    assert abs(out["0-6h"].observed_hours - 3.0) < 0.01 and abs(out["0-6h"].clean_of_expected - 0.5) < 0.01
    assert out["6-12h"].n_total_epochs == 0 and out["6-12h"].missingness == "no_data" and not out["6-12h"].meets_minimum


def test_gap_does_not_count_as_observed(spark):
    times = [T0 + dt.timedelta(seconds=i) for i in range(1800)] + [T0 + dt.timedelta(hours=4, minutes=30, seconds=i) for i in range(1800)]
    df = timebase.timeline(spark.createDataFrame([("p", t) for t in times], "patient_id string, ts timestamp_ntz"), ["patient_id"], ["ts"])
    assert timebase.step_support(df, ["patient_id"]).agg(F.sum("support_hours")).first()[0] < 1.5
    gap = timebase.timestamp_gaps(df, ["patient_id"]).collect()
    assert [(g.start_idx, g.end_idx) for g in gap] == [(1799, 1800)]


def test_event_counts_and_burden(spark, layout):
    df = flags(spark, [False, True, True, False, True])
    assert events.event_counts(df, ["patient_id"], "seizure", "n").first().n == 2
    r = events.event_report(flags(spark, [True, True, False, True, False], [False, True, True, True, True]), ["patient_id"], "seizure", "usable").first()
    assert (r.event_epochs, r.events, r.event_epochs_clean, r.events_clean) == (3, 2, 2, 2)
    assert r.burden_pct == 50.0


def test_status_screen_from_long_event(spark):
    r = events.event_report(flags(spark, [i < 1800 for i in range(3600)]), ["patient_id"], "seizure", "usable").first()
    assert r.status_screen and r.longest_minutes_clean == 30.0 and r.max_hourly_burden_pct == 50.0


def test_independent_mask_matches_the_greedy_loop(spark, layout):
    import random

    rnd = random.Random(2)
    vals = [rnd.choice([1.0, 1.0, 1.0, 2.0, None]) for _ in range(120)]
    df = index_rows(spark.createDataFrame([("p", i, v) for i, v in enumerate(vals)], "patient_id string, i int, v double"), ["patient_id"], ["i"])
    got = [r.m for r in features.independent_mask(df, ["patient_id"], ["v"], 4, "m").orderBy("i").collect()]
    want, last = [], 0
    for i, v in enumerate(vals):
        hit = i == 0 or (v is not None and vals[i - 1] is not None and v != vals[i - 1]) or i - last >= 4
        last = i if hit else last
        want.append(hit)
    assert got == want


def test_suppressed_zero_rules(spark):
    ins = [quality.Instrument("l", "fft_power", "Left Hemisphere", ("l",)), quality.Instrument("r", "fft_power", "Right Hemisphere", ("r",)),
           quality.Instrument("s", "suppression_ratio", "Left Hemisphere", ("s",)), quality.Instrument("d", "seizure_detection", "", ("d",))]
    rows = [("p", i, 0.0 if i in (2, 3, 6) else 5.0, 0.0 if i == 6 else 4.0, 0.0, 0.0) for i in range(8)]
    df = spark.createDataFrame(rows, "patient_id string, i int, l double, r double, s double, d double")
    rep = quality.rejection_report(df, ["patient_id"], ins).first()
    assert (rep.rows_all_rejected, rep.rows_partial, rep.n_regions) == (1, 2, 2)
    out = quality.null_suppressed_zeros(df, ["patient_id"], ins).orderBy("i").collect()
    assert [r.s is None for r in out] == [i in (2, 3, 6) for i in range(8)]
    assert [r.d is None for r in out] == [i == 6 for i in range(8)]
    empty = quality.rejection_report(df.withColumns({"l": F.lit(0.0), "r": F.lit(0.0)}), ["patient_id"], ins).first()
    assert empty.segment_empty and empty.cells_nulled == 0


def test_constant_and_duplicate_columns(spark):
    rows = [("p", i, 0.5, float(i), float(i), float(i) + (1e-6 if i == 7 else 0.0), None) for i in range(20)]
    df = spark.createDataFrame(rows, "patient_id string, row_idx long, c double, a double, b double, near double, none double")
    cols = ["c", "a", "b", "near", "none"]
    assert {(r.column, r.kind) for r in quality.constant_columns(df, ["patient_id"], cols).collect()} == {("c", "constant"), ("none", "all_null")}
    assert [(r.column, r.duplicate_of) for r in quality.duplicate_columns(df, ["patient_id"], cols).collect()] == [("b", "a")]


def test_segment_merge_density_and_fill(spark):
    def run(a, b):
        rows = [("p", 0, t, "x", v) for t, v in enumerate(a)] + [("p", 1, t, "x", v) for t, v in enumerate(b)]
        df = spark.createDataFrame(rows, "patient_id string, segment int, clock int, column string, value double")
        return [r.value for r in merge.merge_segments(df, ["patient_id"], "segment", "clock").orderBy("clock").collect()]

    assert run([1.0, 2.0, 3.0], [99.0, None, 99.0]) == [1.0, 2.0, 3.0]
    assert run([1.0, None, 3.0, 4.0], [None, 42.0, None, None]) == [1.0, 42.0, 3.0, 4.0]


def test_position_merge_pads_to_the_row_total(spark, layout):
    rows = [("p", 0, i, float(i)) for i in range(3)] + [("p", 1, i, 10.0 + i) for i in range(2)]
    out = merge.merge_by_position(spark.createDataFrame(rows, "patient_id string, segment int, i int, v double"), ["patient_id"], "segment", ["i"], ["v"])
    assert [r.v for r in out.orderBy("row_idx").collect()] == [0.0, 1.0, 2.0, None, None]


def test_clock_parsing(spark):
    assert one(spark, clock.clock_seconds(F.lit("7:05"))) == 7 * 3600 + 300
    assert one(spark, clock.clock_seconds(F.lit("12:00:30.5 AM"))) == 30.5
    assert one(spark, clock.clock_seconds(F.lit("1:02 pm"))) == 13 * 3600 + 120
    assert one(spark, clock.clock_seconds(F.lit("noon"))) is None
    assert one(spark, clock.serial_to_timestamp(F.lit(45366.5))) == dt.datetime(2024, 3, 15, 12)
    assert one(spark, clock.serial_to_timestamp(F.lit(0.5))) is None
    assert one(spark, clock.parse_reference_time(F.lit("3/15/24 9:30"))) == dt.datetime(2024, 3, 15, 9, 30)
    assert one(spark, clock.parse_reference_time(F.lit("45366.5"))) == dt.datetime(2024, 3, 15, 12)
    assert one(spark, clock.parse_reference_time(F.lit("soon"))) is None


def test_patient_ids(spark):
    for stem, pid in (("2046_1_2", "2046"), ("01-001_UUID_2", "01-001"), ("subject-10", "subject-10")):
        assert one(spark, timebase.patient_of(F.lit(stem))) == pid
    assert one(spark, timebase.stem_of(F.lit("/x/rec_1-2.dat"))) == "rec_1_2"


@pytest.mark.parametrize("label, family", [
    ("FFT Power, 1 - 4 Hz, Left Anterior", "fft_power"), ("FFT PowerRatio, 8-13/1-4 Hz, All 10-20", "adr"), ("Relative Alpha, 8-13/1-30 Hz", "relative_power"),
    ("FFT PowerRatio, 6-14/1-20 Hz, Left", "alpha_variability"), ("aEEG, 8-13/1-30 Hz", "aeeg"), ("Time Avg <0,120>", "other"), ("Time, clock", "time_display"),
    ("Boolean LPD+", "rhythmic_delta"), ("Rhythmic delta indicator", "rda"), ("", "other"),
])
def test_family(spark, label, family):
    assert one(spark, labels.family_of(F.lit(label))) == family


def named(spark, label, code="I900_1", template=None):
    df = columns.parse_codes(spark.createDataFrame([("f", 1, code, label, template)], "file_id string, col_idx int, code string, label string, tname string"))
    return columns.describe(df, template="tname").first().common_name


@pytest.mark.parametrize("label, code, template, name", [
    ("FFT Power, 1 - 4 Hz, Left Anterior", "I900_1", None, "fft_delta_left_anterior"),
    ("FFT Power, 1 - 4 Hz, All 10-20", "I900_1", None, "fft_delta_all"),
    ("FFT Power, 4 - 8 Hz, Asym Anterior", "I900_1", None, "fft_theta_anterior_asym"),
    ("FFT Power, 64 sec running ave, 4 - 8 Hz, Left Anterior", "I900_1", "Time Avg <0,1800> [FFT_Power]", "fft_avg1800s_theta_left_anterior"),
    ("aEEG, Left Hemisphere", "I900_3", None, "aeeg_left_p50"),
    ("FFT Spectrogram, Left Hemisphere", "I900_18", None, "fft_spec_left_hemisphere_9_00hz"),
    ("Rhythmicity Spectrogram FreqPow LA, Left Anterior", "I900_7", None, "rhythmicity_freqpow_left_anterior_4_9hz_power"),
    ("SleepStages", "I900_1", "= 3 <0> [SleepStages]", "sleep_stage_3"),
    ("Seizure probability and detections", "I900_1", "Time Max <0,120> [SeizureProbabilityP14 Detections]", "seizure_probability_p14_detections_max120s"),
    ("Spikes >=3 per ten seconds (blue=left)", "I900_1", "[>= 3 <0> [EventDensity Spike F3 OR Spike Fp1]]", "spike_left_threshold_per_10s"),
    ("Rhythmic delta indicator (blue=left)", "I900_1", "[Right Anterior] AND NOT[Left Anterior]", "rda_right"),
    ("Electrode Signal Quality", "I900_4", None, "esq_ch04"),
    ("Heart Rate 2", "I900_1", None, "heart_rate_2"),
    ("Coherence_Avg, 0 - 32 Hz, C3P3", "I900_1", None, "coherence_avg_c3p3_0_32hz"),
    ("SEF95, Asym Anterior", "I900_1", None, "sef_95_asym_anterior"),
    ("Suppression Ratio, Left Posterior", "I900_1", None, "suppression_left_posterior"),
    ("something else", "I900_1", None, "other_i900s1"),
])
def test_common_name(spark, label, code, template, name):
    assert named(spark, label, code, template) == name


def test_unique_names_respect_natural_ones(spark, layout):
    names = ["a", "a", "a__dup2", "a", "b"]
    df = spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "file_id string, col_idx int, common_name string")
    got = [r.unique_name for r in columns.unique_names(df, ["file_id"]).orderBy("col_idx").collect()]
    assert got == ["a", "a__dup3", "a__dup2", "a__dup4", "b"]


def test_downsampling_keeps_reference_rows(spark, layout):
    n, points = 97, 10
    df = index_rows(spark.createDataFrame([("p", i, float(i % 13)) for i in range(n)], "patient_id string, i int, v double"), ["patient_id"], ["i"])
    step = n / points
    mids = sorted((int(i * step) + min(int((i + 1) * step), n)) // 2 for i in range(points))
    assert sorted(r.i for r in retrieve.midpoint_rows(df, points).collect()) == mids
    tops = [max(i % 13 for i in range(int(b * step), min(int((b + 1) * step), n))) for b in range(points)]
    assert [r.v for r in retrieve.bucket_peaks(df, ["patient_id"], ["v"], points).orderBy("bucket").collect()] == tops
    stride = sorted({int(i * step + 0.5) for i in range(points)} | {n - 1})
    assert sorted(r.i for r in retrieve.stride_rows(df, points).collect()) == stride


def test_effective_basis_and_groups(spark):
    df = spark.createDataFrame([("sleep_x", "sleep"), ("asymmetry_spec_1", "asymmetry"), ("asymmetry_reasi_delta", "asymmetry"), ("new", "unheard_of")],
                               "common_name string, family string")
    assert [r.g for r in df.select(shapes.export_group().alias("g")).collect()] == ["core", "asymmetry_spectrogram", "core", "core"]


def test_a_mean_of_twice_the_other_is_no_shift_in_any_order_of_adding(spark):
    rows = [("p", "early", 0.0, 1.0), ("p", "late", 0.0, math.nextafter(2.0, 3.0)), ("q", "early", 0.0, 1.0), ("q", "late", 0.0, math.nextafter(0.5, 0.0)),
            ("r", "early", 0.0, 1.0), ("r", "late", 0.0, 2.000001)]
    cover = spark.createDataFrame(rows, "p string, span string, null_share double, mean double")
    assert {r.p: r.shifted for r in profile.coverage_changes(cover, ["p"], "early", "late").collect()} == {"p": False, "q": False, "r": True}
