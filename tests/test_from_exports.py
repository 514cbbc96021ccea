"""From written export files to a cohort's results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracelake.config import BinSettings, CohortSettings, EventSettings
from tracelake.plans.catalog_pipe import write_recordings
from tracelake.plans.from_exports import process_exports
from tracelake.sources import exports as ex
from tracelake.sources import tables as tb

T0 = dt.datetime(2025, 3, 15, 10)
WIDTHS = {"FFT Power, 1 - 4 Hz, Left Anterior": 1, "FFT Power, 1 - 4 Hz, Right Anterior": 1, "FFT Spectrogram, Left Hemisphere": 40, "Seizure Detections": 1, "Artifact Intensity": 3}
NAMES = list(WIDTHS)


def same(a, b):
    """Clocks in days with ten decimals are right to some microseconds."""
    return abs(a - b) < dt.timedelta(milliseconds=1)


def cells(name, i):
    """Cells of an instrument at second ``i``: five zero rows at the start, rejected rows 20-22, an event in rows 40-49, muscle in rows 60-64."""
    zero = i < 5 or 20 <= i < 23
    return {"FFT Power, 1 - 4 Hz, Left Anterior": ["0" if zero else str(2 + i // 8 % 5)], "FFT Power, 1 - 4 Hz, Right Anterior": ["0" if i < 5 else str(4 + i // 8 % 5)],
            "FFT Spectrogram, Left Hemisphere": ["0" if zero else str(k + 1) for k in range(40)], "Seizure Detections": ["1" if 40 <= i < 50 else "0"],
            "Artifact Intensity": ["9" if 60 <= i < 65 else "1", "0.1", "0.2"]}[name]


def export(folder, name, pid, seconds, start=T0, encoding="utf-8", order=None, blank=()):
    """Write one file; cells of instruments in ``blank`` are empty."""
    order = order or NAMES
    labels = ",".join(["", *[",".join([f'"{n}"', *[""] * (WIDTHS[n] - 1)]) for n in order]])
    codes = ",".join(["ClockDateTime", *[f"I{g}_{s}" for g, n in enumerate(order, 1) for s in range(1, WIDTHS[n] + 1)]])
    rows = []
    for i in seconds:
        serial = (start + dt.timedelta(seconds=i) - dt.datetime(1899, 12, 30)).total_seconds() / 86400
        rows.append(",".join([f"{serial:.10f}", *[x if n not in blank else "" for n in order for x in cells(n, i)]]))
    head = [f"File,C:\\é\\{name}.dat", "PatientName,XXXX", f"Patient ID,{pid}", "TestDate,2025.03.15", "TestTime,10:00:00", "made with 14"]
    (folder / f"{name}.csv").write_bytes("\r\n".join([*head, labels, codes, *rows, ""]).encode(encoding))


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    export(folder, "P1_1", "P1", range(0, 60))
    export(folder, "P1_2", "P1", range(50, 120), encoding="cp1252", order=NAMES[::-1], blank=["FFT Spectrogram, Left Hemisphere"])  # the first ten clocks are in both files
    export(folder, "P2_1", "P2", range(0, 90), start=dt.datetime(2000, 1, 1, 3))
    clinical = tb.clinical_rows(spark.createDataFrame([("P1", "09:59:50", "2025-03-15", "100"), ("P2", "08:00:00", "2025-03-15", "100")],
                                                      "patient_id string, rosc_time string, rosc_date string, age_at_arrest_days string"))
    corrections = tb.correction_rows(spark.createDataFrame([("P2_1", "101", "9:30:00", "0:01:30")], ", ".join(f"{c} string" for c in tb.CORRECTION_COLUMNS)))
    settings = CohortSettings(event=EventSettings("detected"), bins=BinSettings((0, 0.02, 0.04, 48), 0.001))
    return process_exports(spark, str(folder), clinical.where("reject IS NULL"), corrections.where("reject IS NULL"), settings)


def test_files_and_columns(result):
    files = {r["segment"]: r for r in result.files.collect()}
    assert {s: (r["patient_id"], r["n_rows"], r["segment_start"] is not None) for s, r in files.items()} == {"P1_1": ("P1", 60, False), "P1_2": ("P1", 70, False), "P2_1": ("P2", 90, True)}
    assert files["P1_2"]["dat_stem"] == "P1_2" and same(files["P1_1"]["start_ts"], T0)
    assert {(s.name, s.width) for s in result.slots if s.family in ("fft_power", "fft_spectrogram")} == {
        ("fft_delta_left_anterior", 1), ("fft_delta_right_anterior", 1), ("fft_spectrogram_left_hemisphere", 40)}


def test_merging_trimming_and_masks(result):
    stages = {r["patient_id"]: r.asDict() for r in result.stages.collect()}
    assert [stages["P1"][c] for c in ("parsed", "without_clock", "merged", "leading_zero_removed", "pre_event_trimmed", "post_event_trim")] == [130, 0, 120, 5, 0, 115]
    assert [stages["P2"][c] for c in ("parsed", "merged", "leading_zero_removed", "post_event_trim")] == [90, 90, 5, 85]
    assert stages["P1"]["seizure_flagged"] == 10 and stages["P1"]["artifact_clean"] <= 115
    epochs = result.cohort.epochs.where("patient_id = 'P1'")
    overlap = epochs.where(F.col("ts").between(T0 + dt.timedelta(seconds=49.5), T0 + dt.timedelta(seconds=59.5)))
    assert overlap.where("fft_spectrogram_left_hemisphere[39] = 40.0").count() == 10 and overlap.count() == 10
    rejected = epochs.where("fft_delta_left_anterior IS NULL").agg(F.min("ts"), F.count(F.lit(1))).first()
    assert same(rejected[0], T0 + dt.timedelta(seconds=20)) and rejected[1] == 3
    assert epochs.where("fft_delta_anterior_sides_contributing = 1").count() == 3


def test_clocks_events_and_alignment(result):
    aligned = {r["patient_id"]: r for r in result.alignment.collect()}
    assert aligned["P1"]["reference"] == "event" and abs(aligned["P1"]["hours_to_start"] - 10 / 3600) < 1e-6
    assert same(aligned["P2"]["start_ts"], dt.datetime(2025, 3, 16, 9, 30)) and aligned["P2"]["reference"] == "recording_start"  # a day and a half after the event
    report = {r["patient_id"]: r for r in result.cohort.events.collect()}
    assert report["P1"]["events"] == 1 and report["P2"]["event_epochs"] == 10


def test_bins_and_reports(result):
    bins = {(r["patient_id"], r["bin_label"], r["feature"]): r for r in result.cohort.bins.collect()}
    assert {f for _, _, f in bins} >= {"fft_delta_left_anterior", "fft_delta_anterior"} and not any("artifact" in f for _, _, f in bins)
    first = bins[("P1", "0-0h", "fft_delta_anterior")]
    assert first["effective_basis"] == "FFTEngine01_cadence_adjusted" and 0 < first["n_effective"] < first["n_observed"]
    null = {r["patient_id"]: r for r in result.null_rule.collect()}
    assert null["P1"]["rows_partial"] >= 3 and not null["P1"]["segment_empty"]
    assert result.validation.columns == ["patient_id", "family", "n_bad"]


def test_without_companions(spark, tmp_path):
    export(tmp_path, "Q_1", "", range(0, 30))
    out = process_exports(spark, str(tmp_path))
    assert [(r["patient_id"], r["reference"]) for r in out.alignment.collect()] == [("Q", "recording_start")]
    assert out.cohort.epochs.count() == 25 and {r["merged"] for r in out.stages.collect()} == {30}


def test_zeros_of_an_instrument_that_measures_them_are_kept(spark, tmp_path):
    """Rows 0-4 are zero on both sides: the left ones are suppressed, the right ones are values."""
    export(tmp_path, "P1_1", "P1", range(0, 60), blank=["FFT Spectrogram, Left Hemisphere"])
    settings = CohortSettings(bins=BinSettings((0, 1), 0.001))
    got = process_exports(spark, str(tmp_path), settings=settings, real_zeros=["fft_delta_right_anterior"])
    bins = {r["feature"]: r["n_observed"] for r in got.cohort.bins.collect()}
    assert (bins["fft_delta_left_anterior"], bins["fft_delta_right_anterior"], bins["fft_delta_anterior"]) == (52, 60, 60)
    stages, report = got.stages.first(), got.null_rule.first()
    assert (stages["leading_zero_removed"], stages["artifact_clean"]) == (0, 60)
    assert (report["rows_all_rejected"], report["rows_partial"]) == (0, 8)


def test_equal_values_on_both_sides_of_a_gap_are_independent(spark, tmp_path):
    """Rows 30 and 31 hold the same values; an hour apart, both of them count."""
    export(tmp_path, "P1_1", "P1", range(24, 31), blank=["FFT Spectrogram, Left Hemisphere"])
    export(tmp_path, "P1_2", "P1", range(31, 32), start=T0 + dt.timedelta(hours=1), blank=["FFT Spectrogram, Left Hemisphere"])
    got = process_exports(spark, str(tmp_path), settings=CohortSettings(bins=BinSettings((0, 2), 0.001)))
    left = got.cohort.bins.where("feature = 'fft_delta_left_anterior'").first()
    assert (left["n_observed"], left["n_effective"], left["mean"]) == (8, 2, 5.0)
    epochs = [r["independent_FFTEngine01"] for r in got.cohort.epochs.orderBy("ts").collect()]
    assert epochs == [True, *[False] * 6, True]


def test_bundles_of_exports_read_like_files(spark, layout, tmp_path):
    """Two exports in a bundle per encoding: the same lines as of single files, whose last lines end with a line feed."""
    single, bundles = tmp_path / "single", tmp_path / "bundles"
    for folder in (single, bundles):
        folder.mkdir()
    for encoding in ("utf-8", "cp1252"):
        names = [f"{encoding}_{i}" for i in (1, 2)]
        for i, name in enumerate(names):
            export(single, name, name, range(i, 3 * i + 4), encoding=encoding)
        (bundles / f"{encoding}.csv").write_bytes(b"".join((single / f"{n}.csv").read_bytes() for n in names))
    lines = [ex.read_exports(spark, str(folder), folder is bundles) for folder in (single, bundles)]
    names = [[F.element_at(F.split("file", "/"), -1).alias("file"), "line_no", "text"] for _ in lines]
    a, b = [sorted(tuple(r) for r in df.select(*n).collect()) for df, n in zip(lines, names)]
    assert {f for f, _, _ in b} == {"utf-8.csv#0.csv", "utf-8.csv#12.csv", "cp1252.csv#0.csv", "cp1252.csv#12.csv"}
    own = {f: t for f, n, t in b if n == 0}
    assert sorted((own[f].split("\\")[-1].removesuffix(".dat") + ".csv", n, t) for f, n, t in b) == a


def test_recordings_are_written_as_few_files(spark):
    files = spark.read.text(write_recordings(spark, "/root/testdata/sf0.001")).select(F.input_file_name().alias("f")).distinct()
    assert files.count() == 2


def test_files_with_equal_headers_are_described_once(spark, tmp_path):
    for name, order in (("A_1", NAMES), ("B_1", NAMES), ("C_1", NAMES[::-1])):
        export(tmp_path, name, name, range(0, 3), order=order)
    lines = ex.read_exports(spark, str(tmp_path))
    stem = lambda c: F.regexp_extract(c, r"([^/]*)\.csv$", 1)
    got = ex.header_files(lines, ex.code_rows(lines)).select(stem("file"), stem("header_file")).collect()
    assert {tuple(r) for r in got} == {("A_1", "A_1"), ("B_1", "A_1"), ("C_1", "C_1")}
