"""Source, sink and streaming queries; files are derived from the driver's tables."""

from pyspark.sql import functions as F

from ..functions.labels import identifier
from ..functions.numbers import rounded
from ..operators.ordered import index_rows, strip_layout
from ..operators.profile import clock_check, compare_tables, conversion_columns
from ..sources import exports as ex
from ..sources import tables as tb
from ..sources.hashing import file_hashes
from ..sources.workdir import work_dir
from ..streaming import streams as st
from .bindings import EP, KEY, epochs, recordings, table
from .registry import query

R = rounded

# Export lines: one file per supplier with six header lines (one more line for
# every fourth file), a label row, a code row, and its line items as data rows.
S = lambda c: c.cast("string")
FILE_SQL = "'/exports/' || s_suppkey || '_' || (s_suppkey % 3) || '.csv'"
LABELS = ['"FFT Power, 1 - 4 Hz, Left Anterior",,aEEG Left Hemisphere,', '"FFT Spectrogram, Left Hemisphere",,,', '"Time Avg <0,120> a",,"Time Avg <0,120> b",', "Coherence_Avg C3P3,,aEEG Left,", "FFT Power 1,,Coherence_Avg C3P3,"]


def file_name():
    return F.concat(F.lit("/exports/"), S(F.col("s_suppkey")), F.lit("_"), S(F.col("s_suppkey") % 3), F.lit(".csv")).alias("file")


def export_lines(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    head = F.array(
        F.concat(F.lit("File,/raw/"), S(k), F.lit("_"), S(F.col("s_nationkey")), F.lit("-2.dat")), F.lit("PatientName,XXXX"), F.concat(F.lit("Patient ID, P"), S(k)),
        F.concat(F.lit("TestDate,2024.01."), S(1 + k % 28)), F.lit("TestTime,10:00:00"), F.concat(F.lit("PatientBirthDate,"), F.lit("made with Persyst 14."), S(k % 5)))
    extra = F.when(k % 4 == 0, F.array(F.lit("free text"))).otherwise(F.array().cast("array<string>"))
    labels = F.get(F.array(*[F.lit(v) for v in LABELS]), (k % 5).cast("int"))
    codes = F.lit("ClockDateTime,I1_1,I1_2,I2_1,")
    top = s.select(file_name(), F.posexplode(F.concat(head, extra, F.array(F.concat(F.lit(","), labels), codes))).alias("line_no", "text"))
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    ix = strip_layout(index_rows(li, ["s_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"]))
    serial = 45000 + F.col("s_suppkey") + F.col("row_idx") * 30 / 86400.0
    text = F.concat_ws(",", S(serial), F.when(F.col("l_linenumber") == 3, '"seizure, ""left"""').otherwise(S(F.col("l_quantity"))), F.when(F.col("l_linenumber") == 2, "").otherwise(S(F.col("l_discount"))), S(F.col("l_tax")), F.lit(""))
    shift = F.when(k % 4 == 0, 9).otherwise(8)
    return top.withColumn("line_no", F.col("line_no").cast("bigint")).unionByName(ix.select(file_name(), (F.col("row_idx") + shift).cast("bigint").alias("line_no"), text.alias("text")))


ROWS = f"""
rw AS (SELECT l_suppkey AS s_suppkey, '/exports/' || l_suppkey || '_' || (l_suppkey % 3) || '.csv' AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS row_idx,
  CASE WHEN l_linenumber <> 3 THEN l_quantity END AS I1_1, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS I1_2, l_tax AS I2_1 FROM lineitem),
tsr AS (SELECT *, TIMESTAMP '1899-12-30' + to_microseconds(CAST(round((45000 + s_suppkey + row_idx * 30 / 86400.0) * 86400.0 * 1e6) AS BIGINT)) AS ts FROM rw)
"""


@query("S1_read_export", f'WITH {ROWS} SELECT file, row_idx, ts, I1_1 AS "I1_1", I1_2 AS "I1_2", I2_1 AS "I2_1" FROM tsr')
def read_export(spark, sf):
    return ex.export_wide(ex.export_rows(export_lines(spark, sf)), ["I1_1", "I1_2", "I2_1"])


@query("S2_header_metadata", f"""
SELECT {FILE_SQL} AS file, '/raw/' || s_suppkey || '_' || s_nationkey || '-2.dat' AS file_path, 'P' || s_suppkey AS patient_id, '2024.01.' || (1 + s_suppkey % 28) AS test_date, '10:00:00' AS test_time, 'Persyst 14.' || (s_suppkey % 5) AS software_version FROM supplier
""")
def header(spark, sf):
    return ex.header_metadata(export_lines(spark, sf))


@query("S3_code_row", f"SELECT {FILE_SQL} AS file, CASE WHEN s_suppkey % 4 = 0 THEN 8 ELSE 7 END::BIGINT AS code_line, 3 AS n_codes FROM supplier")
def code_row(spark, sf):
    codes = ex.code_rows(export_lines(spark, sf))
    return codes.select("file", "code_line", F.size(F.filter("codes", lambda c: c.rlike(ex.CODE))).alias("n_codes"))


LAB_SQL = "(['FFT Power, 1 - 4 Hz, Left Anterior', 'FFT Spectrogram, Left Hemisphere', 'Time Avg <0,120> a', 'Coherence_Avg C3P3', 'FFT Power 1'])[CAST(s_suppkey % 5 AS INT) + 1]"
LAB3_SQL = "(['aEEG Left Hemisphere', 'FFT Spectrogram, Left Hemisphere', 'Time Avg <0,120> b', 'aEEG Left', 'Coherence_Avg C3P3'])[CAST(s_suppkey % 5 AS INT) + 1]"


@query("S4_label_fill", f"""
SELECT {FILE_SQL} AS file, u.i AS col_idx, u.c AS code, u.l AS label FROM (SELECT s_suppkey, unnest([{{'i': 1, 'c': 'I1_1', 'l': {LAB_SQL}}}, {{'i': 2, 'c': 'I1_2', 'l': {LAB_SQL}}}, {{'i': 3, 'c': 'I2_1', 'l': {LAB3_SQL}}}]) AS u FROM supplier)
""")
def labels(spark, sf):
    return ex.export_columns(export_lines(spark, sf))


@query("S5_encoding", """
WITH l AS (SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '[^\\x{0000}-\\x{00FF}]', '?', 'g') AS line FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'utf-16' WHEN doc_id % 4 = 2 AND regexp_matches(line, '[^\\x00-\\x7F]') THEN 'cp1252' ELSE 'utf-8-sig' END AS encoding FROM l
""")
def encoding(spark, sf):
    line = F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), "[^\\u0000-\\u00FF]", "?")
    k = F.col("doc_id") % 4
    raw = F.when(k == 1, F.encode(line, "UTF-16")).when(k == 2, F.encode(line, "ISO-8859-1")).otherwise(F.encode(line, "UTF-8"))
    return table(spark, sf, "documents").withColumn("raw", raw).select("doc_id", ex.encoding_of("raw").alias("encoding"))


PANEL_CASE = "(['trends', 'spectrograms', 'time_averages', 'coherence_only', 'trends'])[CAST(supplier.s_suppkey % 5 AS INT) + 1]"
SCAN = f"""
{ROWS.strip()}, pr AS (SELECT s_suppkey, count(*) AS n, min(ts) AS a, max(ts) AS z FROM tsr GROUP BY 1),
sc AS (SELECT {FILE_SQL.replace("s_suppkey", "supplier.s_suppkey")} AS file, supplier.s_suppkey, s_nationkey, 3 AS n_columns, coalesce(n, 0) AS n_data_rows, a AS start_ts, z AS end_ts, date_diff('microsecond', a, z) / 3600000000.0 AS dur, {PANEL_CASE} AS panel_class FROM supplier LEFT JOIN pr ON pr.s_suppkey = supplier.s_suppkey)
"""


@query("S6_quick_scan", f"WITH {SCAN} SELECT file, n_columns, n_data_rows, start_ts, end_ts, round(dur+1e-9,6) AS duration_hours, panel_class FROM sc")
def quick_scan(spark, sf):
    return ex.quick_scan(export_lines(spark, sf)).withColumn("duration_hours", R(F.col("duration_hours")))


@query("S7_panel_class", """
WITH c AS (SELECT p_size AS file_id, CASE WHEN p_size % 4 = 0 AND p_partkey % 3 > 0 THEN 'FFT Spectrogram ' || p_name WHEN p_size % 4 = 1 AND p_partkey % 20 > 0 THEN 'time avg <0,64> ' || p_name WHEN p_size % 4 = 2 THEN 'Coherence Avg ' || p_name WHEN p_size % 8 = 3 AND p_partkey % 5 = 0 THEN 'Coherence_Avg' WHEN p_size % 8 = 7 THEN 'FFT Power, x' ELSE p_name END AS label FROM part),
g AS (SELECT file_id, avg(contains(label, 'Spectrogram')::INT) AS s, avg(starts_with(lower(label), 'time avg <')::INT) AS t, bool_or(contains(label, 'Coherence_Avg') OR contains(label, 'Coherence Avg')) AS c, bool_or(contains(label, 'FFT Power') OR contains(label, 'FFT_Power')) AS p FROM c GROUP BY 1)
SELECT file_id, CASE WHEN s >= 0.5 THEN 'spectrograms' WHEN t >= 0.8 THEN 'time_averages' WHEN c AND NOT p THEN 'coherence_only' ELSE 'trends' END AS panel_class FROM g
""")
def panel_class(spark, sf):
    p, k, s = table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    label = (F.when((s % 4 == 0) & (k % 3 > 0), F.concat(F.lit("FFT Spectrogram "), "p_name")).when((s % 4 == 1) & (k % 20 > 0), F.concat(F.lit("time avg <0,64> "), "p_name"))
             .when(s % 4 == 2, F.concat(F.lit("Coherence Avg "), "p_name")).when((s % 8 == 3) & (k % 5 == 0), "Coherence_Avg").when(s % 8 == 7, "FFT Power, x").otherwise(F.col("p_name")))
    return ex.panel_class(p.select(s.alias("file_id"), label.alias("label")), ["file_id"])


@query("S8_file_types", """
SELECT '/in/' || c_custkey || CASE WHEN c_custkey % 7 = 6 THEN '.EDF' WHEN c_custkey % 7 = 5 THEN '.txt' ELSE '.csv' END AS file, CASE WHEN c_custkey % 7 = 6 THEN 'raw' WHEN c_custkey % 7 = 5 THEN 'unknown' WHEN c_custkey % 4 = 0 THEN 'corrections' WHEN c_custkey % 4 = 1 THEN 'clinical' WHEN c_custkey % 4 = 2 THEN 'recording' ELSE 'unknown' END AS file_type FROM customer
""")
def file_types(spark, sf):
    k = F.col("c_custkey")
    first = F.when(k % 4 == 0, "New_Name,age_in_days_at_time_of_eeg,x").when(k % 4 == 1, "patient_id,Age_Days").when(k % 4 == 2, "File,abc").otherwise("nothing,here")
    second = F.when(k % 4 == 2, F.concat(F.lit("ClockDateTime, I"), S(k), F.lit("_1"))).otherwise(F.concat(F.lit("1,"), S(k)))
    name = F.concat(F.lit("/in/"), S(k), F.when(k % 7 == 6, ".EDF").when(k % 7 == 5, ".txt").otherwise(".csv"))
    lines = table(spark, sf, "customer").select(name.alias("file"), F.posexplode(F.array(first, second)).alias("line_no", "text"))
    return ex.file_types(lines)


GROUPED = f"""
{SCAN.strip()}, gp AS (SELECT *, CASE WHEN s_suppkey % 6 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'N' || s_nationkey END AS patient FROM sc)
"""


def grouped(spark, sf):
    s = table(spark, sf, "supplier").select(file_name(), F.when(F.col("s_suppkey") % 6 == 0, "xxx").otherwise(F.concat(F.lit("N"), S(F.col("s_nationkey")))).alias("patient_id"))
    return ex.group_files(ex.quick_scan(export_lines(spark, sf)).join(s, "file"))


@query("S9_patient_grouping", f"""
WITH {GROUPED} SELECT patient, file, row_number() OVER (PARTITION BY patient ORDER BY coalesce(CAST(start_ts AS VARCHAR), ''), file) - 1 AS position, count(*) OVER (PARTITION BY patient) AS n_files FROM gp
""")
def grouping(spark, sf):
    return grouped(spark, sf).select("patient", "file", "position", "n_files")


@query("S10_manifest", f"""
WITH {GROUPED}, g AS (SELECT patient, count(*) AS n_files, count(*) FILTER (panel_class = 'trends') AS n_trends, CAST(coalesce(sum(n_data_rows) FILTER (panel_class = 'trends'), 0) AS BIGINT) AS total_epochs, round(coalesce(sum(dur) FILTER (panel_class = 'trends'), 0)+1e-9,6) AS total_hours,
  coalesce(bool_or(NOT (year(start_ts) BETWEEN 2000 AND 2040)), FALSE) AS needs_corrections FROM gp GROUP BY 1)
SELECT patient, n_files, n_trends, total_epochs, total_hours, '' AS errors, CASE WHEN starts_with(patient, 'N') AND CAST(substr(patient, 2) AS INT) % 2 = 0 THEN '' ELSE 'no clinical data' END AS warnings FROM g
""")
def manifest(spark, sf):
    clin = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("N"), S(F.col("n_nationkey"))).alias("patient"))
    out = ex.validate_manifest(ex.patient_groups(grouped(spark, sf)), clin, corrections_found=True)
    return out.select("patient", "n_files", "n_trends", "total_epochs", R(F.col("total_hours")).alias("total_hours"), "errors", "warnings")


@query("S11_clinical_load", """
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 29 = 7 THEN ' ' ELSE 'P' || c_custkey END AS pid, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '0' || (c_custkey % 10) || ':30:00' END AS t1, CASE WHEN c_custkey % 10 = 0 THEN '11:00:00' END AS t2, CASE WHEN c_custkey % 3 = 1 THEN '2024-02-0' || (1 + c_custkey % 9) END AS d, CASE WHEN c_custkey % 17 = 3 THEN 'old' WHEN c_custkey % 4 = 2 THEN CAST(c_custkey % 900 AS VARCHAR) END AS age FROM customer),
x AS (SELECT *, nullif(trim(pid), '') AS p, coalesce(nullif(t1, ''), t2) AS t FROM r)
SELECT p AS patient_id, t AS event_time, CASE WHEN d IS NOT NULL THEN d || coalesce(' ' || t, '') END AS event_datetime, TRY_CAST(age AS INT) AS age_days,
 CASE WHEN p IS NULL THEN 'patient_id is required' WHEN t IS NULL THEN 'event time is required' WHEN age IS NOT NULL AND TRY_CAST(age AS INT) IS NULL THEN 'age must be an integer' WHEN d IS NULL AND TRY_CAST(age AS INT) IS NULL THEN 'neither date nor age' END AS reject FROM x
""")
def clinical(spark, sf):
    k = F.col("c_custkey")
    raw = table(spark, sf, "customer").select(
        F.when(k % 29 == 7, " ").otherwise(F.concat(F.lit("P"), S(k))).alias("patient_id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("0"), S(k % 10), F.lit(":30:00"))).alias("rosc_time"),
        F.when(k % 10 == 0, "11:00:00").alias("rosc_timeage_at_arrest_days"), F.when(k % 3 == 1, F.concat(F.lit("2024-02-0"), S(1 + k % 9))).alias("rosc_date"),
        F.when(k % 17 == 3, "old").when(k % 4 == 2, S(k % 900)).alias("age_days"))
    return tb.clinical_rows(raw).select("patient_id", "event_time", "event_datetime", "age_days", "reject")


@query("S12_corrections_load", """
SELECT CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'seg_' || o_orderkey END AS new_name, CASE WHEN o_orderkey % 23 = 5 THEN NULL ELSE CAST(o_custkey % 6000 AS INT) END AS age_days, CASE WHEN o_orderkey % 31 = 0 THEN 'new_name is required' WHEN o_orderkey % 23 = 5 THEN 'age must be an integer' END AS reject FROM orders
""")
def corrections(spark, sf):
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        F.when(k % 31 == 0, " ").otherwise(F.concat(F.lit("seg_"), S(k))).alias("new_name"), F.when(k % 23 == 5, "n/a").otherwise(S(F.col("o_custkey") % 6000)).alias("age_in_days_at_time_of_eeg"),
        F.lit("7:00:31").alias("eeg_start_time"), F.lit("22:19:31").alias("eeg_duration"))
    return tb.correction_rows(raw).select("new_name", "age_days", "reject")


@query("S13_column_binding", "SELECT c_custkey AS id, c_mktsegment AS grp, NULL::VARCHAR AS missing FROM customer")
def binding(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(tb.bind_column(c, ["subject", "C_CUSTKEY", "c_name"]).alias("id"), tb.bind_column(c, ["c_mktsegment"]).alias("grp"), tb.bind_column(c, ["nope"]).alias("missing"))


PLAIN = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax"]


@query("S14_convert", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax FROM lineitem")
def convert(spark, sf):
    src = table(spark, sf, "lineitem").select(*PLAIN)
    base = work_dir(spark, "convert")
    tb.write_result(src, f"{base}/csv", "csv")
    tb.write_result(tb.read_result(spark, f"{base}/csv", "csv", src.schema), f"{base}/parquet", "parquet")
    return spark.read.parquet(f"{base}/parquet")


@query("S15_pruned_read", "SELECT l_suppkey, sum(l_quantity) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def pruned(spark, sf):
    from ..operators.retrieve import project_columns

    df = project_columns(table(spark, sf, "lineitem"), ["l_suppkey"], ["L_QUANTITY", "l_shipdate", "absent"])
    return df.where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("total"))


@query("S16_typed_write", """
SELECT c AS "column", (SELECT count(*) FROM events) AS n_rows, CASE c WHEN 'value' THEN (SELECT count(*) FROM events WHERE event_id % 23 = 0) ELSE 0 END AS n_null FROM (SELECT unnest(['event_id', 'value', 'channel']) AS c)
""")
def typed_write(spark, sf):
    path = work_dir(spark, "typed")
    df = epochs(spark, sf).withColumnsRenamed({"value": "FFT Power, 1 - 4 Hz"})
    names = tb.write_epochs(df, path)
    back = tb.restore_names(spark.read.parquet(path), names).withColumnsRenamed({"FFT Power, 1 - 4 Hz": "value"})
    return tb.null_counts(back, ["event_id", "value", "channel"])


@query("S17_clean_names", """
WITH r AS (SELECT p_partkey, (p_partkey % 5) || ' ' || p_name || ', ' || p_size || ' - ' || (p_size + 4) || ' Hz (' || p_brand || ')/' || p_type || ' 5.5% <x>' AS n FROM part),
c AS (SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(n, ', ', '_'), ',', '_'), ' - ', '_'), ' ', '_'), '(', ''), ')', ''), '/', '_over_'), '.', '_'), 'Hz', 'hz'), '%', 'pct'), '<', 'lt'), '>', 'gt'), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g')) AS s FROM r)
SELECT p_partkey, rtrim(CASE WHEN regexp_matches(s, '^[0-9]') THEN 'x' || s ELSE s END, '_') AS clean FROM c
""")
def clean_names(spark, sf):
    s = F.col("p_size")
    n = F.concat(S(F.col("p_partkey") % 5), F.lit(" "), "p_name", F.lit(", "), S(s), F.lit(" - "), S(s + 4), F.lit(" Hz ("), "p_brand", F.lit(")/"), "p_type", F.lit(" 5.5% <x>"))
    return table(spark, sf, "part").select("p_partkey", identifier(n).alias("clean"))


@query("S18_template", """
SELECT 'panel ' || (p_partkey // 50) AS panel, CAST(1 + p_partkey % 50 AS INT) AS position, p_name || ' ' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Left Anterior' ELSE 'All 10-20' END AS channels FROM part
""")
def template(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    base = work_dir(spark, "template")
    name = F.concat("p_name", F.lit(" "), S(k))
    defs = p.select(name.alias("_Name"), F.concat(F.lit("id"), S(k)).alias("_InstanceID"), F.when(k % 2 == 0, "Left Anterior").otherwise("All 10-20").alias("_Channels"), F.lit("title").alias("_GraphTitle"))
    defs.write.format("xml").option("rootTag", "Instruments").option("rowTag", "Instrument").save(f"{base}/t/instruments")
    ref = F.struct(name.alias("_Name"), F.when(k % 3 == 0, F.lit("gone")).otherwise(F.concat(F.lit("id"), S(k))).alias("_InstanceID"))
    panels = p.groupBy(F.concat(F.lit("panel "), S(F.floor(k / 50))).alias("_Name")).agg(F.sort_array(F.collect_list(F.struct((k % 50).alias("o"), ref.alias("r")))).alias("x"))
    panels = panels.select("_Name", F.transform("x", lambda s: s["r"]).alias("Instrument"))
    panels.write.format("xml").option("rootTag", "Panels").option("rowTag", "Panel").save(f"{base}/t/panels")
    _, _, slots = tb.read_template(spark, f"{base}/t/*", one_file=True)
    return slots.select("panel", "position", "name", "channels")


@query("S19_sinks", """
SELECT l_suppkey, max(l_quantity) AS top, count(*) AS n, u AS fmt FROM lineitem, (SELECT unnest(['csv', 'json', 'parquet']) AS u) GROUP BY l_suppkey, u
""")
def sinks(spark, sf):
    df = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max("l_quantity").alias("top"), F.count(F.lit(1)).alias("n"))
    base, out = work_dir(spark, "sinks"), None
    for fmt in ("csv", "json", "parquet"):
        tb.write_result(df, f"{base}/{fmt}", fmt)
        part = tb.read_result(spark, f"{base}/{fmt}", fmt, df.schema).withColumn("fmt", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


@query("S20_cohort_dataset", f"""
WITH {EP} SELECT patient_id, count(*) AS n_epochs, round(max(hrs) - min(hrs), 2) AS duration_hours, count(value) FILTER (patient_id % 2 = 1) AS n_values FROM tl GROUP BY 1
""")
def cohort(spark, sf):
    rec = recordings(spark, sf)
    path = work_dir(spark, "cohort")
    tb.write_cohort([rec.where("patient_id % 2 = 0").select("patient_id", "event_id", "hours"), rec.where("patient_id % 2 = 1").select("patient_id", "event_id", "hours", "value")], path)
    back = spark.read.option("mergeSchema", True).parquet(path).withColumn("patient_id", F.col("patient_id").cast("bigint"))
    values = back.groupBy("patient_id").agg(F.count("value").alias("n_values"))
    return tb.attach_reference(tb.cohort_manifest(back, KEY), values, KEY)


@query("S21_run_catalog", """
WITH i AS (SELECT doc_id, substr(sha256(concat_ws('|', '1.0', sha256(text), lang, coalesce(source, ''))), 1, 16) AS run_key FROM documents)
SELECT doc_id, run_key FROM i WHERE run_key NOT IN (SELECT run_key FROM i WHERE doc_id % 3 <> 0)
""")
def run_catalog(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tb.run_key("1.0", F.sha2("text", 256), F.col("lang"), F.col("source")).alias("run_key"))
    return tb.stale_inputs(d, d.where("doc_id % 3 <> 0")).select("doc_id", "run_key")


@query("S21_changed_patients", f"""
WITH {EP} SELECT patient_id, count(*) AS n_epochs, max(CASE WHEN patient_id % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS written_by, max(patient_id % 5 = 0) AS is_new FROM tl WHERE patient_id % 7 <> 3 GROUP BY 1
""")
def changed_patients(spark, sf):
    """A cohort written twice: a fifth of its patients changed, a seventh left, and a run between that failed before its manifest."""
    path = work_dir(spark, "cohort")
    rec = epochs(spark, sf).select("patient_id", "event_id", "value")
    ids = rec.select("patient_id").distinct()
    tb.write_changed(rec, ids.withColumn("run_key", F.lit("v1")), path)
    rec.where("patient_id % 2 = 0").withColumn("run", F.lit("failed")).write.mode("append").partitionBy("run").parquet(f"{path}/data")
    fifth = F.col("patient_id") % 5 == 0
    again = ids.where("patient_id % 7 <> 3").withColumn("run_key", F.when(fifth, "v2").otherwise("v1"))
    stale = tb.write_changed(rec, again, path).select(F.col("patient_id").alias("_p"))
    back = tb.read_cohort(spark, path).groupBy(F.col("patient_id").cast("long").alias("patient_id")).agg(F.count(F.lit(1)).alias("n_epochs"), F.max("commit").alias("written_by"))
    return back.join(stale, F.col("patient_id") == F.col("_p"), "left").select("patient_id", "n_epochs", "written_by", F.col("_p").isNotNull().alias("is_new"))


@query("S22_fingerprint", """
SELECT page_id, sha256(html) AS content_sha, sha256(concat_ws('|', url, CAST(length(html) AS VARCHAR), 't' || page_id, left(html, 64), right(html, 64))) AS print FROM pages
""")
def fingerprints(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tb.content_hash("html").alias("content_sha"), tb.fingerprint(
        F.col("url"), F.length("html"), F.concat(F.lit("t"), S(F.col("page_id"))), F.substring("html", 1, 64), F.right("html", F.lit(64))).alias("print"))


@query("S22_file_hashes", """
WITH f AS (SELECT c_nationkey::INT AS nation, string_agg(c_custkey || ';' || c_name || ';' || c_mktsegment || chr(10), '' ORDER BY c_custkey) AS t FROM customer GROUP BY 1)
SELECT nation, strlen(t) AS size, sha256(t) AS sha256, sha256(left(t, 256) || CASE WHEN strlen(t) > 256 THEN right(t, 256) ELSE '' END) AS ends_sha256, TRUE AS own_fingerprint FROM f
""")
def file_hashes_(spark, sf):
    """One written text file per nation, hashed from its bytes; copies of a file keep its hash but not its fingerprint."""
    base = work_dir(spark, "hashed")
    line = F.concat_ws(";", S(F.col("c_custkey")), "c_name", "c_mktsegment").alias("value")
    rows = table(spark, sf, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", line)
    for copy in ("a", "b"):
        rows.write.partitionBy("c_nationkey").text(f"{base}/{copy}")
    nation = F.regexp_extract("file", "c_nationkey=([0-9]+)/part-", 1).cast("int").alias("nation")
    found = file_hashes(spark, base, span=256).where(F.col("file").rlike("/part-")).select(nation, "size", "sha256", "ends_sha256", "fingerprint")
    return found.groupBy("nation", "size", "sha256", "ends_sha256").agg((F.count_distinct("fingerprint") == 2).alias("own_fingerprint"))


@query("S24_conversion_check", """
SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 500 = 3) AS only_left, 0::BIGINT AS only_right, 'o_totalprice' AS "column", (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 7 AND o_orderkey % 500 <> 3) AS n_diff
UNION ALL SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 500 = 3), 0, 'o_custkey', 0
""")
def conversion_check(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    other = o.where("o_orderkey % 500 <> 3").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 7, F.col("o_totalprice") + 1.0).otherwise(F.col("o_totalprice") * (1 + 1e-12)))
    return compare_tables(o, other, ["o_orderkey"], ["o_totalprice", "o_custkey"])


@query("S24_conversion_columns", f"SELECT {FILE_SQL} AS file, 3 AS n_codes, 'I2_1' AS dropped, 'I9_9' AS extra FROM supplier")
def conversion_columns_(spark, sf):
    return conversion_columns(ex.code_rows(export_lines(spark, sf)), ["ClockDateTime", "I1_1", "I1_2", "I9_9"], ["ClockDateTime"])


@query("S24_clock_check", f"""
WITH {EP}, d AS (SELECT patient_id, event_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY patient_id ORDER BY event_id) AS step FROM tl)
SELECT patient_id, count(*) FILTER (step < 0) AS n_back, round((arg_max(epoch_us(ts), event_id) - arg_min(epoch_us(ts), event_id)) / 3600000000.0+1e-9,6) AS duration_hours, round(median(step / 1000000.0)+1e-9,6) AS median_step, count(*) FILTER (step < 0) = 0 AS monotonic FROM d GROUP BY 1
""")
def clock_check_(spark, sf):
    return clock_check(epochs(spark, sf), KEY, ["event_id"]).withColumns({c: R(F.col(c)) for c in ("duration_hours", "median_step")})


WIDE = 320


def wide_files(spark, sf):
    """One export file per nation with WIDE columns, quoted labels and values, written and found by their encodings again."""
    c, base = table(spark, sf, "customer"), work_dir(spark, "wide")
    codes = ",".join(["ClockDateTime", *[f"I{i}_1" for i in range(1, WIDE + 1)]])
    labels = ",".join(["", *[f'"FFT Power, {i} - {i + 1} Hz, Left Anterior"' for i in range(1, WIDE + 1)]])
    head = ["File,C:\\a.dat", "PatientName,XXXX", "Patient ID,", "TestDate,2024.01.01", "TestTime,10:00:00", "made with Persyst 14.2", "", labels, codes]
    top = c.select("c_nationkey").distinct().select("c_nationkey", F.posexplode(F.array(*[F.lit(h) for h in head])).alias("line_no", "value"))
    cell = lambda i: F.when((F.col("c_custkey") + i) % 11 == 0, "").when((F.col("c_custkey") + i) % 13 == 0, '"artifact, left"').otherwise(
        (F.col("c_custkey") + i).cast("string"))
    rows = c.select("c_nationkey", (100 + F.col("c_custkey")).cast("int").alias("line_no"), F.concat_ws(",", (45000 + F.col("c_custkey")).cast("string"), F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(WIDE)), cell), ",")).alias("value"))
    lines = top.withColumn("line_no", F.col("line_no").cast("int")).unionByName(rows).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "line_no")
    lines.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(base)
    return ex.read_exports(spark, base)


@query("S1_wide_files", f"""
WITH v AS (SELECT c_nationkey AS nation, 'I' || i || '_1' AS code, CASE WHEN (c_custkey + i) % 11 <> 0 AND (c_custkey + i) % 13 <> 0 THEN c_custkey + i END AS x FROM customer, range(1, {WIDE + 1}) r(i))
SELECT nation::INT AS nation, code, count(x) AS n, sum(x)::DOUBLE AS total FROM v WHERE x IS NOT NULL GROUP BY 1, 2
""")
def wide_files_(spark, sf):
    # the nation is read once a row, not once a cell
    rows = ex.export_rows(wide_files(spark, sf)).withColumn("file", F.regexp_extract("file", "c_nationkey=([0-9]+)", 1))
    return ex.export_values(rows).groupBy(F.col("file").cast("int").alias("nation"), "code").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("S4_wide_labels", f"""
SELECT n_nationkey::INT AS nation, i::INT AS col_idx, 'I' || i || '_1' AS code, 'FFT Power, ' || i || ' - ' || (i + 1) || ' Hz, Left Anterior' AS label
FROM (SELECT DISTINCT c_nationkey AS n_nationkey FROM customer), range(1, {WIDE + 1}) r(i)
""")
def wide_labels_(spark, sf):
    nation = F.regexp_extract("file", "c_nationkey=([0-9]+)", 1).cast("int").alias("nation")
    return ex.export_columns(wide_files(spark, sf)).select(nation, F.col("col_idx").cast("int").alias("col_idx"), "code", "label")


# ---- streaming ---------------------------------------------------------------------

@query("S23_incremental_ingest", "SELECT event_type AS channel, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY 1")
def ingest(spark, sf):
    base = work_dir(spark, "ingest")
    ep = epochs(spark, sf).select("event_id", "channel", "raw_value")
    ep.where("event_id % 2 = 0").write.parquet(f"{base}/in", mode="append")
    st.ingest_new_files(spark, f"{base}/in", f"{base}/out", f"{base}/cp", ep.schema)
    ep.where("event_id % 2 = 1").write.parquet(f"{base}/in", mode="append")
    st.ingest_new_files(spark, f"{base}/in", f"{base}/out", f"{base}/cp", ep.schema)
    return spark.read.parquet(f"{base}/out").groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"))


def epoch_uploads(spark, sf, reduced, name):
    """Three uploads out of time order, each drained before the next comes."""
    base = work_dir(spark, name)
    ep = epochs(spark, sf).select("patient_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "artifact_clean", "seizure")
    for part in (2, 0, 1):
        ep.where(F.pmod(F.crc32(F.col("patient_id").cast("string")), F.lit(3)) == part).write.mode("append").parquet(f"{base}/in")
        st.run_to_table(spark.readStream.schema(ep.schema).parquet(f"{base}/in"), reduced, f"{base}/out", f"{base}/cp")
    return f"{base}/out"


@query("ST1_ingest_lines", f"WITH {ROWS} SELECT file, count(*) AS n_rows FROM rw GROUP BY 1")
def ingest_lines(spark, sf):
    base = work_dir(spark, "lines")
    lines = export_lines(spark, sf)
    lines.write.parquet(f"{base}/in")
    st.ingest_new_files(spark, f"{base}/in", f"{base}/out", f"{base}/cp", lines.schema)
    st.ingest_new_files(spark, f"{base}/in", f"{base}/out", f"{base}/cp", lines.schema)
    return ex.export_rows(spark.read.parquet(f"{base}/out")).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))


@query("ST2_bin_counters", f"""
WITH {EP} SELECT patient_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n_epochs, count(*) FILTER (artifact_clean) AS n_clean, count(*) FILTER (artifact_clean AND seizure) AS n_events FROM tl GROUP BY 1, 2
""")
def counters(spark, sf):
    out = epoch_uploads(spark, sf, lambda rows: st.bin_counters(rows, KEY), "counters")
    return st.counters_so_far(spark, out, KEY).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("ST3_event_sessions", f"""
WITH {EP}, s AS (SELECT patient_id, ts, ts - lag(ts) OVER (PARTITION BY patient_id ORDER BY ts) > INTERVAL '24 hours' AS brk FROM tl WHERE seizure), i AS (SELECT *, sum(coalesce(brk, FALSE)::INT) OVER (PARTITION BY patient_id ORDER BY ts) AS k FROM s)
SELECT patient_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_epochs FROM i GROUP BY patient_id, k
""")
def sessions(spark, sf):
    out = epoch_uploads(spark, sf, lambda rows: st.event_rows(rows, KEY), "sessions")
    return st.sessions_so_far(spark, out, KEY, 24 * 3600).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})
