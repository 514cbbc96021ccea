"""Recording exports as lines: headers, code rows, labels, values, quick scans.

A file is (file, line_no, text) rows. Every step is an aggregate, window or join
over such rows, so a cohort of files is read as one job and a large file is split
like any other text file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import JUNK_IDS
from ..functions.clock import implausible_year, micros_between, serial_to_timestamp
from ..functions.numbers import clean_nan
from ..operators.ordered import index_rows, join_keys, last_known, running, strip_layout
from ..operators.timebase import patient_of, stem_of
from .workdir import stored

# Header keys kept, lines scanned for them and for the code row.
HEADER_KEYS = {"file": "file_path", "patientid": "patient_id", "testdate": "test_date", "testtime": "test_time"}
HEADER_LINES, CODE_ROW_LINES = 6, 61
CLOCK = "ClockDateTime"
#: How the first line of an export begins, which tells where the next one of a bundle starts.
FIRST_LINE = "File,"
CODE = r"^I\d+_\d+$"
VERSION = r"(?i)(Persyst\s+\d+[\.\d]*)"
RAW_EXTENSIONS = ["edf", "lay", "dat", "eeg", "bdf"]


#: Detected encodings: the charset that decodes a line's bytes, and the bytes between lines.
CHARSETS = {"utf-8-sig": ("UTF-8", "\n"), "cp1252": ("ISO-8859-1", "\n"), "latin-1": ("ISO-8859-1", "\n"),
            "utf-16": ("UTF-16LE", "\n\0"), "utf-16-be": ("UTF-16BE", "\0\n")}
_CP1252 = {i: bytes([i]).decode("cp1252", "ignore") for i in range(0x80, 0xA0)}


def read_lines(spark: SparkSession, path: str | list[str], encoding: str = "utf-8-sig", bundled: bool = False) -> DataFrame:
    """(file, line_no, text) of text files; line numbers count across the splits of a file, blank lines too.

    ``encoding`` is one that ``file_encodings`` names. Byte order marks and carriage returns go.
    A ``bundled`` file holds whole exports one after the other, each from its ``File,`` line
    on: they are files of their own, named by the bundle and their first line in it.
    """
    charset, separator = CHARSETS[encoding]
    rows = spark.read.option("lineSep", separator).text(path)
    text = F.decode(F.col("value").cast("binary"), charset) if charset != "UTF-8" else F.col("value")
    if encoding == "cp1252":
        known = {i: c for i, c in _CP1252.items() if c}
        text = F.translate(text, "".join(map(chr, known)), "".join(known.values()))
    placed = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_seq"), F.regexp_replace(text, "^\ufeff|\r$", "").alias("text"))
    numbered = index_rows(placed, ["file"], ["_block", "_seq"], row="line_no", total="_n")
    if bundled:
        begins = F.when(F.startswith("text", F.lit(FIRST_LINE)), F.col("line_no"))
        numbered = running(numbered, ["file"], {"_first": ("max", begins)}, row="line_no")
        first = F.coalesce("_first", F.lit(0))
        numbered = numbered.withColumns({"file": F.concat("file", F.lit("#"), first.cast("string"), F.lit(".csv")), "line_no": F.col("line_no") - first}).drop("_first")
    return strip_layout(numbered).drop("_block", "_seq", "_n")


def file_encodings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, encoding) from the first bytes of every file, up to its first line feed."""
    first = spark.read.option("lineSep", "\n").text(path).where("_metadata.file_block_start = 0").groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.first(F.col("value").cast("binary")).alias("_raw"))
    big = F.substring(F.hex("_raw"), 1, 4) == "FEFF"
    return first.select("file", F.when(big & ~F.is_valid_utf8(F.col("_raw").cast("string")), "utf-16-be").otherwise(encoding_of("_raw")).alias("encoding"))


def read_exports(spark: SparkSession, path: str | list[str], bundled: bool = False) -> DataFrame:
    """``read_lines`` of every file in its own encoding; one small row per file comes to the driver."""
    by: dict[str, list[str]] = {}
    for r in file_encodings(spark, path).collect():
        by.setdefault(r["encoding"], []).append(r["file"])
    parts = [read_lines(spark, files, encoding, bundled) for encoding, files in sorted(by.items())]
    return reduce(DataFrame.unionByName, parts) if parts else read_lines(spark, path)


def encoding_of(first_line: str | Column) -> Column:
    """First encoding that can read the line's bytes: utf-8-sig, utf-16, cp1252, latin-1."""
    raw = F.col(first_line) if isinstance(first_line, str) else first_line
    hexed = F.hex(raw)
    undefined = hexed.rlike("^(?:..)*(?:81|8D|8F|90|9D)")
    return (F.when(F.is_valid_utf8(raw.cast("string")), "utf-8-sig").when(F.substring(hexed, 1, 4).isin("FFFE", "FEFF"), "utf-16")
            .when(~undefined, "cp1252").otherwise("latin-1"))


#: A cell after its comma: quoted, with doubled quotes inside, or plain. Possessive, so it neither recurses nor backtracks.
_CELL = r',(\s*"(?:[^"]*+(?:""[^"]*+)*+)"[^,]*+|[^,]*+)'


def cells(text: str | Column) -> Column:
    """Comma-separated cells, trimmed; quoted commas are kept, outer quotes are not, doubled ones become one."""
    t = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.concat(F.lit(","), t), F.lit(_CELL), F.lit(1))
    inner = lambda c: F.replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda c: F.trim(F.when(F.contains(c, F.lit('"')), inner(c)).otherwise(c)))


def header_metadata(lines: DataFrame) -> DataFrame:
    """One row per file: path, patient id, date, time and software version; names never kept."""
    head = lines.where(F.col("line_no") < HEADER_LINES).withColumn("_c", cells("text"))
    key = F.replace(F.lower(F.get("_c", F.lit(0))), F.lit(" "), F.lit(""))
    value = F.coalesce(F.get("_c", F.lit(1)), F.lit(""))
    aggs = [F.max_by(F.when(F.col("_k") == k, F.col("_v")), F.when(F.col("_k") == k, F.col("line_no"))).alias(n) for k, n in HEADER_KEYS.items()]
    version = F.when(F.col("text").rlike(VERSION), F.regexp_extract("text", VERSION, 1))
    return head.withColumns({"_k": key, "_v": value}).groupBy("file").agg(
        *aggs, F.min_by(version, F.when(version.isNotNull(), F.col("line_no"))).alias("software_version"))


def code_rows(lines: DataFrame) -> DataFrame:
    """(file, code_line, codes): the first early line with a clock cell and mostly codes."""
    early = lines.where((F.col("line_no") < CODE_ROW_LINES) & F.col("text").contains(CLOCK)).withColumn("codes", cells("text"))
    filled = F.size(F.filter("codes", lambda c: c != ""))
    n_codes = F.size(F.filter("codes", lambda c: c.rlike(CODE)))
    is_code = F.array_contains("codes", CLOCK) & (n_codes >= F.greatest(F.lit(1.0), (filled - 1) / 2.0))
    return early.where(is_code).groupBy("file").agg(
        F.min("line_no").alias("code_line"), F.min_by("codes", "line_no").alias("codes"))


def _label_rows(lines: DataFrame, codes: DataFrame) -> DataFrame:
    """The line above the code row of every file that has one."""
    return lines.where(F.col("line_no") < CODE_ROW_LINES).join(
        codes.select(F.col("file").alias("_f"), (F.col("code_line") - 1).alias("_l")), (F.col("file") == F.col("_f")) & (F.col("line_no") == F.col("_l")))


def header_files(lines: DataFrame, codes: DataFrame) -> DataFrame:
    """(file, header_file): the first file by name that has the same label row and codes, so that columns are described once."""
    labelled = codes.select("file", "codes").join(_label_rows(lines, codes).select("file", "text"), "file", "left")
    marked = labelled.select("file", F.sha2(F.to_json(F.struct("text", "codes")), 256).alias("_header"))
    first = marked.groupBy("_header").agg(F.min("file").alias("header_file"))
    return marked.join(first, "_header").drop("_header")


def export_columns(lines: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """(file, col_idx, code, label): labels filled forward over merged cells."""
    codes = codes if codes is not None else code_rows(lines)
    above = _label_rows(lines, codes)
    labels = above.select("file", F.posexplode(cells("text")).alias("col_idx", "_label")).withColumn("_label", F.when(F.col("_label") != "", F.col("_label")))
    columns = codes.select("file", F.posexplode("codes").alias("col_idx", "code"))
    joined = columns.join(labels, ["file", "col_idx"], "left")
    filled = last_known(index_rows(joined, ["file"], ["col_idx"], total="_n"), ["file"], "_label", "label")
    out = strip_layout(filled).where((F.col("code") != "") & (F.col("code") != CLOCK))
    return out.select("file", "col_idx", "code", F.coalesce("label", F.lit("")).alias("label"))


def export_rows(lines: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """(file, row_idx, ts, serial, codes, values): data lines under the code row as arrays."""
    codes = codes if codes is not None else code_rows(lines)
    data = lines.join(codes, "file").where((F.col("line_no") > F.col("code_line")) & (F.trim("text") != ""))
    plain = F.transform(F.split("text", ",", -1), lambda c: clean_nan(F.trim(c).try_cast("double")))
    quoted = F.transform(cells("text"), lambda c: clean_nan(c.try_cast("double")))
    values = F.when(F.contains("text", F.lit('"')), quoted).otherwise(plain)
    out = data.select("file", (F.col("line_no") - F.col("code_line") - 1).alias("row_idx"), "codes", values.alias("values"))
    clock = F.get("values", F.array_position("codes", CLOCK).cast("int") - 1)
    return out.withColumn("serial", clock).withColumn("ts", serial_to_timestamp("serial"))


def export_values(rows: DataFrame) -> DataFrame:
    """(file, row_idx, ts, code, value) in long form; columns without any value vanish with it."""
    pairs = F.arrays_zip(F.col("codes").alias("code"), F.col("values").alias("value"))
    long = rows.select("file", "row_idx", "ts", F.inline(pairs).alias("code", "value"))
    return long.where((F.col("code") != "") & (F.col("code") != CLOCK) & F.col("value").isNotNull())


def export_wide(rows: DataFrame, codes: list[str]) -> DataFrame:
    """(file, row_idx, ts, <code columns>) for the named codes."""
    pick = [F.get("values", F.array_position("codes", c).cast("int") - 1) for c in codes]
    kept = [F.when(F.array_position("codes", c) > 0, v).alias(c) for c, v in zip(codes, pick)]
    return rows.select("file", "row_idx", "ts", *kept)


def _clocks(lines: DataFrame, codes: DataFrame) -> DataFrame:
    """(file, row_idx, ts) of the data lines, as ``export_rows`` has them."""
    clock = codes.select("file", "code_line", F.array_position("codes", CLOCK).cast("int").alias("_at"))
    data = lines.join(clock, "file").where((F.col("line_no") > F.col("code_line")) & (F.trim("text") != ""))
    cell = F.when(F.contains("text", F.lit('"')), F.get(cells("text"), F.col("_at") - 1)).otherwise(
        F.trim(F.get(F.split("text", ",", -1), F.col("_at") - 1)))
    serial = clean_nan(cell.try_cast("double"))
    return data.select("file", (F.col("line_no") - F.col("code_line") - 1).alias("row_idx"), serial_to_timestamp(serial).alias("ts"))


def quick_scan(lines: DataFrame) -> DataFrame:
    """First and last clock, data rows, hours, column count and panel class per file.

    The first lines of the files are stored, so all lines are numbered once more only; of data lines the clock alone is read.
    """
    early = stored(lines.where(F.col("line_no") < CODE_ROW_LINES).select("file", "line_no", "text"), "early_lines")
    codes = stored(code_rows(early), "code_rows")
    per = _clocks(lines, codes).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_data_rows"), F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("row_idx"))).alias("start_ts"),
        F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("row_idx"))).alias("end_ts"))
    widths = codes.select("file", F.size(F.filter("codes", lambda c: c.rlike(CODE))).alias("n_columns"))
    panels = panel_class(export_columns(early, codes), ["file"])
    out = widths.join(per, "file", "left").join(panels, "file", "left")
    return out.withColumns({"n_data_rows": F.coalesce("n_data_rows", F.lit(0)), "duration_hours": micros_between("start_ts", "end_ts") / F.lit(3.6e9)})


def panel_class(columns: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """spectrograms / time_averages / coherence_only / trends from the labels of a file."""
    t = F.col(label)
    shown = t != ""
    share = lambda cond: F.avg(F.when(shown, cond.cast("double")))
    coherence = F.bool_or(shown & (t.contains("Coherence_Avg") | t.contains("Coherence Avg")))
    power = F.bool_or(shown & (t.contains("FFT Power") | t.contains("FFT_Power")))
    cls = (F.when(share(t.contains("Spectrogram")) >= 0.5, "spectrograms").when(share(t.rlike("(?i)^Time Avg <")) >= 0.8, "time_averages")
           .when(coherence & ~power, "coherence_only").otherwise("trends"))
    return columns.groupBy(*keys).agg(cls.alias("panel_class"))


def file_types(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """corrections / clinical / recording / raw / unknown per file."""
    head = lines.where(F.col("line_no") <= 65).withColumn("_c", F.transform(cells("text"), lambda c: F.lower(c)))
    first = F.col("line_no") == 0
    has = lambda name: F.array_contains("_c", name)
    flags = head.groupBy("file").agg(
        F.bool_or(first & has("new_name") & F.exists("_c", lambda c: c.contains("age_in_days"))).alias("_corr"),
        F.bool_or(first & has("patient_id") & has("age_days")).alias("_clin"),
        F.bool_or(F.exists(cells("text"), lambda c: c.rlike(CODE))).alias("_rec"))
    ext = F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1))
    return flags.select("file", F.when(ext.isin(RAW_EXTENSIONS), "raw").when(ext != "csv", "unknown").when(F.col("_corr"), "corrections")
                        .when(F.col("_clin"), "clinical").when(F.col("_rec"), "recording").otherwise("unknown").alias("file_type"))


def valid_id(pid: str | Column) -> Column:
    p = F.col(pid) if isinstance(pid, str) else pid
    return p.isNotNull() & ~F.lower(F.trim(p)).isin(JUNK_IDS) & (F.length(p) > 1)


def group_files(scans: DataFrame) -> DataFrame:
    """Files with their patient (header id, or the stem's when that is a placeholder) and position by start."""
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    own = valid_id("patient_id") & (F.col("patient_id") != stem)
    from_stem = F.coalesce(F.nullif(patient_of(stem), F.lit("")), stem)
    tagged = scans.withColumn("patient", F.when(own, F.col("patient_id")).otherwise(from_stem)).withColumn(
        "_start", F.coalesce(F.col("start_ts").cast("string"), F.lit("")))
    tagged = stored(tagged, "scans")  # files are counted per patient first; that must not scan them twice
    return strip_layout(index_rows(tagged, ["patient"], ["_start", "file"], row="position", total="n_files")).drop("_start")


def patient_groups(grouped: DataFrame) -> DataFrame:
    """Per patient: files per panel class, epochs and hours of the trend files."""
    cls = F.col("panel_class")
    trend = cls == "trends"
    return grouped.groupBy("patient").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(trend).alias("n_trends"), F.count_if(cls == "spectrograms").alias("n_spectrograms"),
        F.count_if(cls == "time_averages").alias("n_time_averages"),
        F.coalesce(F.sum(F.when(trend, F.col("n_data_rows"))), F.lit(0)).alias("total_epochs"),
        F.coalesce(F.sum(F.when(trend, F.col("duration_hours"))), F.lit(0.0)).alias("total_hours"),
        F.min(F.when(trend, F.col("n_columns"))).alias("min_columns"), F.max(F.when(trend, F.col("n_columns"))).alias("max_columns"),
        F.bool_or(implausible_year("start_ts")).alias("needs_corrections"))


def validate_manifest(groups: DataFrame, clinical: DataFrame | None, corrections_found: bool, raw: DataFrame | None = None) -> DataFrame:
    """Errors and warnings per patient as text, plus the number of raw companions by id prefix."""
    out = groups
    if clinical is not None:
        out = join_keys(out, clinical.select("patient").distinct().withColumn("_clin", F.lit(True)), ["patient"], "left")
    else:
        out = out.withColumn("_clin", F.lit(None).cast("boolean"))
    if raw is not None:
        per = raw.select(F.substring_index(stem_of(F.col("file")), "_", 1).alias("patient")).groupBy("patient").agg(F.count(F.lit(1)).alias("n_raw"))
        out = join_keys(out, per, ["patient"], "left").withColumn("n_raw", F.coalesce("n_raw", F.lit(0)))
    errors = F.array_compact(F.array(
        F.when(F.col("n_files") == 0, "no export files"),
        F.when(F.col("needs_corrections") & F.lit(not corrections_found), "shifted dates without corrections")))
    warnings = F.array_compact(F.array(
        F.when(F.col("min_columns") != F.col("max_columns"), "trend files differ in column count"),
        F.when(F.col("_clin").isNull(), "no clinical data")))
    return out.withColumns({"errors": F.array_join(errors, "; "), "warnings": F.array_join(warnings, "; ")}).drop("_clin")
