"""Files on disk: exports, companions, templates, stores and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracelake.operators.profile import compare_tables, recompute_audit
from tracelake.plans import catalog
from tracelake.sources import exports, tables, workdir
from tracelake.streaming import streams

HEAD = ["File,C:/data/2046_1-2.dat", "PatientName,XXXXX", "PatientID,X", "PatientBirthDate,XX", "TestDate,2025.03.15", "TestTime,10:00:00"]


def export_text(rows=12):
    labels = ',Artifact Intensity,,"FFT Power, 1 - 4 Hz, Left Anterior",aEEG Left Hemisphere,,'
    codes = "ClockDateTime,I1_1,I1_2,I10_1,I20_1,I20_2,"
    data = [f"{45731 + (36000 + 2 * i) / 86400},{i * 0.5},{'' if i % 3 else i},{i},1,2," for i in range(rows)]
    return "\n".join([*HEAD, labels, codes, *data]) + "\n"


@pytest.fixture
def export_file(tmp_path):
    path = tmp_path / "in" / "20250315_1000.csv"
    path.parent.mkdir()
    path.write_text(export_text(), encoding="utf-8-sig")
    return str(path.parent)


def test_export_end_to_end(spark, export_file):
    lines = exports.read_lines(spark, export_file)
    meta = exports.header_metadata(lines).first()
    assert (meta.file_path, meta.patient_id, meta.test_date) == ("C:/data/2046_1-2.dat", "X", "2025.03.15")
    codes = exports.code_rows(lines)
    assert codes.first().code_line == 7
    got = {r.code: r.label for r in exports.export_columns(lines, codes).collect()}
    assert got == {"I1_1": "Artifact Intensity", "I1_2": "Artifact Intensity", "I10_1": "FFT Power, 1 - 4 Hz, Left Anterior",
                   "I20_1": "aEEG Left Hemisphere", "I20_2": "aEEG Left Hemisphere"}
    wide = exports.export_wide(exports.export_rows(lines, codes), ["I1_1", "I1_2"]).orderBy("row_idx").collect()
    assert len(wide) == 12 and wide[0].ts == dt.datetime(2025, 3, 15, 10) and wide[3].I1_1 == 1.5
    assert wide[1].I1_2 is None and wide[3].I1_2 == 3.0
    scan = exports.quick_scan(lines).first()
    assert (scan.n_data_rows, scan.n_columns, scan.panel_class) == (12, 5, "trends") and abs(scan.duration_hours - 22 / 3600) < 1e-6
    assert exports.file_types(lines).first().file_type == "recording"


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("\n".join(f"line {i}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = exports.read_lines(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line_no, r.text) for r in rows) == [(i, f"line {i}") for i in range(5000)]


@pytest.mark.parametrize("encoding, expected", [("utf-8-sig", "utf-8-sig"), ("utf-8", "utf-8-sig"), ("utf-16", "utf-16"), ("cp1252", "cp1252")])
def test_encoding(spark, encoding, expected):
    raw = bytearray("File,müßig".encode(encoding))
    assert spark.createDataFrame([(raw,)], "raw binary").select(exports.encoding_of("raw").alias("e")).first().e == expected


def test_clinical_and_corrections(spark, tmp_path):
    (tmp_path / "c.csv").write_text("patient_id,rosc_timeage_at_arrest_days,rosc_date,sex\n1,10:00:00,2024-01-02,f\n2,11:00:00,,m\n,12:00:00,2024-01-02,m\n")
    good, bad = tables.read_clinical(spark, str(tmp_path / "c.csv"))
    assert [(r.patient_id, r.event_datetime) for r in good.collect()] == [("1", "2024-01-02 10:00:00")]
    assert {r.reject for r in bad.collect()} == {"neither date nor age", "patient_id is required"}
    (tmp_path / "k.csv").write_text("new_name,age_in_days_at_time_of_eeg,eeg_start_time,eeg_duration\n2046_1,6050,7:00:34,07:52:31\n2046_2,x,1:00,1:00\n")
    good, bad = tables.read_corrections(spark, str(tmp_path / "k.csv"))
    assert [r.age_days for r in good.collect()] == [6050] and bad.count() == 1
    with pytest.raises(ValueError):
        tables.correction_rows(spark.createDataFrame([("a",)], "new_name string"))


def test_template(spark, tmp_path):
    (tmp_path / "t.xml").write_text("""<Template Version="1"><Instruments><Montage>
      <Engine EngineName="FFTEngine01" RefId="e1" EpochDuration="4" EpochStep="8"/>
      <Instrument Name="FFT_Power 1-4" InstanceID="a" Channels="Left Anterior" GraphTitle="FFT Power" FreqMin="1" FreqMax="4"><Engine RefId="e1"/></Instrument>
      <Instrument Name="aEEG" InstanceID="b" Channels="All 10-20" GraphTitle=""/></Montage></Instruments>
      <Panel Name="P"><Instrument Name="x" InstanceID="b"/><Instrument Name="FFT_Power 1-4" InstanceID="gone"/><Instrument Name="none" InstanceID="none"/></Panel></Template>""")
    engines, instruments, slots = tables.read_template(spark, str(tmp_path / "t.xml"))
    assert [(r.engine, r.win, r.step) for r in engines.collect()] == [("FFTEngine01", 4.0, 8.0)]
    assert {(r.name, r.engine_ref) for r in instruments.collect()} == {("FFT_Power 1-4", "e1"), ("aEEG", None)}
    assert [(r.position, r.name) for r in slots.orderBy("position").collect()] == [(1, "aEEG"), (2, "FFT_Power 1-4")]


def test_store_and_cohort(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, 0.5), ("q", 2, None)], "patient_id string, i int, `FFT Power, 1 - 4 Hz` double")
    names = tables.write_epochs(df, str(tmp_path / "s"))
    assert names["FFT Power, 1 - 4 Hz"] == "fft_power_1_4_hz"
    back = tables.restore_names(spark.read.parquet(str(tmp_path / "s")), names)
    assert sorted(back.columns) == sorted(df.columns) and back.count() == 2
    tables.write_cohort([df.select("patient_id", "i"), df.withColumn("extra", F.lit(1))], str(tmp_path / "c"))
    assert spark.read.option("mergeSchema", True).parquet(str(tmp_path / "c")).where("patient_id = 'p'").count() == 2


def test_conversion_check_and_audit(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "i int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, 2.1)], "i int, v double")
    r = compare_tables(a, b, ["i"], ["v"]).first()
    assert (r.only_left, r.only_right, r.n_diff) == (1, 0, 1)
    exported = spark.createDataFrame([("p", "n", 5.0), ("p", "mean", 1.0), ("p", "max", 9.0), ("p", "sd", None)], "patient_id string, metric string, value double")
    again = spark.createDataFrame([("p", "n", 5.0), ("p", "mean", 1.1)], "patient_id string, metric string, value double")
    out = {r.metric: r.status for r in recompute_audit(exported, again, ["patient_id"], {"n": "count"}).collect()}
    assert out == {"n": "match", "mean": "mismatch", "max": "not_checked"}


def test_each_file_is_ingested_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    df.write.parquet(src)
    for _ in range(2):
        streams.ingest_new_files(spark, src, out, cp, df.schema)
    df.write.mode("append").parquet(src)
    streams.ingest_new_files(spark, src, out, cp, df.schema)
    assert spark.read.parquet(out).count() == 4


def test_work_dir_uses_the_shared_folder(spark):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: "hdfs://shared/cp/" if key == "spark.checkpoint.dir" else default)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app-1"

    assert workdir.work_dir(Session, "x").startswith("hdfs://shared/cp/tracelake/app-1/x-")
    assert workdir.work_dir(spark, "x") != workdir.work_dir(spark, "x")

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app-2"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError):
        workdir.work_dir(Cluster, "x")


@pytest.mark.parametrize("encoding, name", [("utf-8-sig", "utf-8-sig"), ("utf-16", "utf-16"), ("cp1252", "cp1252"), ("utf-16-be", "utf-16-be")])
def test_files_are_read_in_their_own_encoding(spark, tmp_path, encoding, name):
    lines = ["File,müßig", "", 'x,"a, ""b""",3']
    raw = "\r\n".join(lines)
    data = b"\xfe\xff" + raw.encode("utf-16-be") if encoding == "utf-16-be" else raw.encode(encoding)
    (tmp_path / "a.csv").write_bytes(data)
    assert [r.encoding for r in exports.file_encodings(spark, str(tmp_path)).collect()] == [name]
    got = exports.read_exports(spark, str(tmp_path)).withColumn("c", exports.cells("text")).orderBy("line_no").collect()
    assert [(r.line_no, r.text) for r in got] == list(enumerate(lines))
    assert got[2].c == ["x", 'a, "b"', "3"]


def test_cells_of_long_quoted_lines(spark):
    labels = ",".join(f'"FFT Power, {i} Hz"' for i in range(5000))
    text = [labels, "", ",", f'a,"{"q," * 20_000}",b', ' "x" , y ']
    got = [r.c for r in spark.createDataFrame([(t,) for t in text], "t string").select(exports.cells("t").alias("c")).collect()]
    assert got[0] == [f"FFT Power, {i} Hz" for i in range(5000)]
    assert got[1:3] == [[""], ["", ""]] and got[3] == ["a", "q," * 20_000, "b"] and got[4] == ["x", "y"]


def test_uploads_in_any_order_are_all_counted(spark, tmp_path):
    import datetime as dt

    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "patient_id int, ts timestamp, artifact_clean boolean, seizure boolean"
    for patient, day in ((1, 20), (2, 3), (3, 25), (2, 2)):
        rows = [(patient, dt.datetime(2024, 1, day, 1, i), True, i % 2 == 0) for i in range(6)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(src)
        streams.run_to_table(stream, lambda df: streams.bin_counters(df, ["patient_id"]), out, cp)
    got = streams.counters_so_far(spark, out, ["patient_id"]).collect()
    assert sorted((r.patient_id, r.window_start.day, r.n_epochs, r.n_events) for r in got) == [(1, 20, 6, 3), (2, 2, 6, 3), (2, 3, 6, 3), (3, 25, 6, 3)]


def test_quick_scan_reads_lines_once_more(spark):
    """All lines are numbered by costly plans: the scan's result reads them once, and grouping files does not repeat the scan."""
    text = ["File,a.dat", ",FFT Power 1,", "ClockDateTime,I1_1,I1_2", '45000.5,"1, x",2', '"45001.5",1,', "nan,1,2", "", "45000.75,,3"]
    lines = spark.createDataFrame([("/x/a.csv", i, t) for i, t in enumerate(text)], "file string, line_no long, text string")
    sources = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    scans = exports.quick_scan(lines)
    assert sources(scans) == 1
    grouped = exports.group_files(scans.withColumn("patient_id", F.lit("N1")))
    assert sources(grouped) == 0
    r = grouped.first()
    assert (r.n_data_rows, str(r.start_ts), str(r.end_ts)) == (4, "2023-03-15 12:00:00", "2023-03-15 18:00:00")
    assert (r.n_columns, r.panel_class, r.position, r.n_files) == (2, "trends", 0, 1)


def test_wide_cells_carry_no_path(spark):
    """The nation is taken from a file's path before the row becomes hundreds of cells."""
    plan = catalog.QUERIES["S1_wide_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(file" not in plan[:plan.index("Generate")], plan
