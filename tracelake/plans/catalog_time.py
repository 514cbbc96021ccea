"""Time base and alignment queries."""

from pyspark.sql import functions as F

from ..constants import ENGINE_CADENCE, ENGINE_WINDOW, FAMILY_ENGINES
from ..functions import clock as ck
from ..functions.numbers import rounded
from ..operators import timebase as tb
from ..operators.columns import cadence_table
from ..operators.merge import prefix_matches
from ..operators.ordered import SLICE_ROWS_CONF, index_rows, join_keys, strip_layout
from ..operators.stored_timeline import corrected_clocks, store_timeline, with_support
from .bindings import EP, KEY, SUPPORT, epochs, indexed, recordings, stored_recordings, table
from .registry import also_sliced, query

R = rounded


@query("T1_serial_to_timestamp", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN -5.0 WHEN o_orderkey % 19 = 0 THEN 3000000.0 ELSE 34000 + o_totalprice / 64.0 END AS serial FROM orders)
SELECT o_orderkey, CASE WHEN serial BETWEEN 1 AND 2958465 THEN TIMESTAMP '1899-12-30' + to_microseconds(CAST(round(serial * 86400.0 * 1e6) AS BIGINT)) END AS ts FROM s
""")
def serials(spark, sf):
    s = F.when(F.col("o_orderkey") % 13 == 0, -5.0).when(F.col("o_orderkey") % 19 == 0, 3000000.0).otherwise(34000 + F.col("o_totalprice") / 64.0)
    return table(spark, sf, "orders").select("o_orderkey", ck.serial_to_timestamp(s).alias("ts"))


CLOCK_SQL = """
c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 5
    WHEN 0 THEN (l_partkey % 24) || ':' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0')
    WHEN 1 THEN (l_partkey % 24) || ':' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_orderkey % 60 AS VARCHAR), 2, '0')
    WHEN 2 THEN (1 + l_partkey % 12) || ':' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0') || ' PM'
    WHEN 3 THEN (1 + l_partkey % 12) || ':' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0') || ':30.5am'
    ELSE 'at ' || l_partkey END AS txt FROM lineitem)
"""


def clock_texts(spark, sf):
    li = table(spark, sf, "lineitem")
    mm = F.lpad((F.col("l_suppkey") % 60).cast("string"), 2, "0")
    ss = F.lpad((F.col("l_orderkey") % 60).cast("string"), 2, "0")
    h24, h12 = (F.col("l_partkey") % 24).cast("string"), (1 + F.col("l_partkey") % 12).cast("string")
    kind = F.col("l_linenumber") % 5
    txt = (F.when(kind == 0, F.concat(h24, F.lit(":"), mm)).when(kind == 1, F.concat(h24, F.lit(":"), mm, F.lit(":"), ss))
           .when(kind == 2, F.concat(h12, F.lit(":"), mm, F.lit(" PM"))).when(kind == 3, F.concat(h12, F.lit(":"), mm, F.lit(":30.5am")))
           .otherwise(F.concat(F.lit("at "), F.col("l_partkey").cast("string"))))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", txt.alias("txt"))


@query("T2_clock_parse", f"""
WITH {CLOCK_SQL},
p AS (SELECT *, regexp_extract(txt, '^\\s*(\\d+):(\\d+)(?::(\\d+(?:\\.\\d*)?))?\\s*([AaPp][Mm])?\\s*$', ['h','m','s','k']) AS g FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN g.h <> '' THEN
  (CASE WHEN upper(g.k) = 'PM' AND TRY_CAST(g.h AS INT) < 12 THEN TRY_CAST(g.h AS INT) + 12 WHEN upper(g.k) = 'AM' AND TRY_CAST(g.h AS INT) = 12 THEN 0 ELSE TRY_CAST(g.h AS INT) END) * 3600.0
  + TRY_CAST(g.m AS INT) * 60.0 + coalesce(TRY_CAST(g.s AS DOUBLE), 0.0) END::DOUBLE AS seconds FROM p
""")
def clocks(spark, sf):
    return clock_texts(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", ck.clock_seconds("txt").alias("seconds"))


@query("T3_reference_time", """
WITH r AS (SELECT o_orderkey, CASE CAST(o_orderkey % 6 AS INT)
   WHEN 0 THEN strftime(o_orderdate + to_minutes(o_custkey % 1440), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate + to_minutes(o_custkey % 1440), '%Y-%m-%d %H:%M')
   WHEN 2 THEN strftime(o_orderdate + to_minutes(o_custkey % 1440), '%m/%d/%Y %H:%M:%S') WHEN 3 THEN strftime(o_orderdate + to_minutes(o_custkey % 1440), '%m/%d/%Y %H:%M')
   WHEN 4 THEN CAST(30000 + o_custkey % 9000 AS VARCHAR) || '.25' ELSE 'n/a ' || o_custkey END AS txt, o_orderdate + to_minutes(o_custkey % 1440) AS t, o_custkey FROM orders)
SELECT o_orderkey, CASE CAST(o_orderkey % 6 AS INT) WHEN 4 THEN TIMESTAMP '1899-12-30 06:00:00' + to_days(CAST(30000 + o_custkey % 9000 AS INT)) WHEN 5 THEN NULL ELSE t END AS ref FROM r
""")
def reference_times(spark, sf):
    o = table(spark, sf, "orders").withColumn("t", ck.ntz("o_orderdate") + F.make_dt_interval(mins=(F.col("o_custkey") % 1440).cast("int")))
    k = F.col("o_orderkey") % 6
    fmt = lambda f: F.date_format("t", f)
    txt = (F.when(k == 0, fmt("yyyy-MM-dd HH:mm:ss")).when(k == 1, fmt("yyyy-MM-dd HH:mm")).when(k == 2, fmt("MM/dd/yyyy HH:mm:ss"))
           .when(k == 3, fmt("MM/dd/yyyy HH:mm")).when(k == 4, F.concat((30000 + F.col("o_custkey") % 9000).cast("string"), F.lit(".25")))
           .otherwise(F.concat(F.lit("n/a "), F.col("o_custkey").cast("string"))))
    return o.select("o_orderkey", ck.parse_reference_time(txt).alias("ref"))


@query("T4_hours_relative", f"""
WITH {EP} SELECT event_id, round(date_diff('microsecond', TIMESTAMP '2024-01-10 06:00:00', ts) / 3600000000.0 + 1e-9, 6) AS hrs FROM ep
""")
def hours_rel(spark, sf):
    out = tb.hours_relative(epochs(spark, sf), F.lit("2024-01-10 06:00:00").cast("timestamp_ntz"))
    return out.select("event_id", R(F.col("hours")).alias("hrs"))


EVENTS_SQL = """
ct AS (SELECT patient_id, TIMESTAMP '2024-01-01' + to_hours(CAST((patient_id * 7) % 60 AS BIGINT)) - to_hours(30) AS event_ts
       FROM (SELECT DISTINCT user_id AS patient_id FROM events) WHERE patient_id % 9 <> 4)
"""


def clinical(spark, sf):
    ids = table(spark, sf, "events").select(F.col("user_id").alias("patient_id")).distinct().where(F.col("patient_id") % 9 != 4)
    base = F.lit("2024-01-01").cast("timestamp_ntz")
    return ids.withColumn("event_ts", ck.add_seconds(base, ((F.col("patient_id") * 7) % 60 - 30) * 3600.0))


AXIS_SQL = f"""
WITH {EP}, {EVENTS_SQL},
ax AS (SELECT tl.*, event_ts, date_diff('microsecond', event_ts, start_ts) / 3600000000.0 AS hts FROM tl LEFT JOIN ct USING (patient_id)),
rf AS (SELECT *, CASE WHEN hts <= 22 THEN 'event' ELSE 'recording_start' END AS reference, CASE WHEN hts <= 22 THEN event_ts ELSE start_ts END AS reference_ts FROM ax),
hr AS (SELECT *, date_diff('microsecond', reference_ts, ts) / 3600000000.0 AS h FROM rf)
"""


def axis(spark, sf):
    return tb.reference_axis(recordings(spark, sf), KEY, clinical(spark, sf))


@query("T5_reference_axis", AXIS_SQL + "SELECT event_id, patient_id, reference, reference_ts, round(h+1e-9,6) AS h FROM hr")
def reference_axis(spark, sf):
    return axis(spark, sf).select("event_id", "patient_id", "reference", "reference_ts", R(F.col("hours")).alias("h"))


@query("T6_alignment_guard", AXIS_SQL + """
SELECT DISTINCT patient_id, round(hts+1e-9,6) AS hours_to_start, coalesce(hts <= 22, FALSE) AS is_aligned, coalesce(hts < 0, FALSE) AS needs_trim,
  round(CASE WHEN hts < 0 THEN -hts ELSE 0.0 END+1e-9,6) AS pre_event_hours FROM hr
""")
def guard(spark, sf):
    starts = epochs(spark, sf).groupBy("patient_id").agg(F.min("ts").alias("start_ts"))
    joined = join_keys(starts, clinical(spark, sf), KEY, "left")
    return tb.alignment_guard(joined, "event_ts", "start_ts").select(
        "patient_id", R(F.col("hours_to_start")).alias("hours_to_start"), "is_aligned", "needs_trim", R(F.col("pre_event_hours")).alias("pre_event_hours"))


@query("T7_trim", AXIS_SQL + """
SELECT patient_id, count(*) AS n_rows, count(*) FILTER (h < 0) AS n_trimmed FROM hr GROUP BY 1
""")
def trim(spark, sf):
    return tb.trimmed_counts(axis(spark, sf), KEY)


SEG = """
sg_e AS (SELECT user_id AS patient_id, event_id % 3 AS segment, event_id, ts,
   CASE WHEN user_id % 5 = 2 AND event_id % 3 = 1 THEN NULL ELSE ts END AS clk,
   row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) - 1 AS row_idx FROM events),
sg_c AS (SELECT patient_id, segment, 100 + segment AS age_days, (patient_id % 24) * 3600.0 + segment * 60.0 AS clock_sec FROM (SELECT DISTINCT patient_id, segment FROM sg_e)),
sg_s AS (SELECT *, date_diff('microsecond', lag(clk) OVER (PARTITION BY patient_id, segment ORDER BY row_idx), clk) / 1e6 AS step FROM sg_e),
sg_m AS (SELECT patient_id, segment, bool_or(clk IS NULL OR coalesce(step, 1.0) <= 0) AS broken, arg_min(ts, row_idx) AS first_ts, median(step) FILTER (step > 0) AS med FROM sg_s GROUP BY 1, 2)
"""


_SEGMENTS = {}


def segments(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("patient_id"), (F.col("event_id") % 3).alias("segment"), "event_id", ck.ntz("ts").alias("ts"))
    ix = index_rows(ev, ["patient_id", "segment"], ["ts", "event_id"])
    return ix.withColumn("clk", F.when((F.col("patient_id") % 5 == 2) & (F.col("segment") == 1), None).otherwise(F.col("ts")))


def stored_segments(spark, sf):
    """The segments as a stored timeline, made once per session."""
    at = (spark.sparkContext.applicationId, sf, spark.conf.get(SLICE_ROWS_CONF, ""))
    if at not in _SEGMENTS:
        rows = strip_layout(segments(spark, sf)).drop("row_idx", "n_rows")
        _SEGMENTS[at] = store_timeline(rows, ["patient_id", "segment"], ["ts", "event_id"], ts="clk")
    return _SEGMENTS[at]


def segment_corrections(spark, sf):
    keys = table(spark, sf, "events").select(F.col("user_id").alias("patient_id"), (F.col("event_id") % 3).alias("segment")).distinct()
    return keys.withColumns({"age_days": 100 + F.col("segment"), "clock_sec": (F.col("patient_id") % 24) * 3600.0 + F.col("segment") * 60.0})


@query("T8_clock_correction", f"""
WITH {SEG}
SELECT event_id, TIMESTAMP '2000-01-01' + to_microseconds(CAST(round((age_days * 86400.0 + clock_sec) * 1e6) AS BIGINT))
  + to_microseconds(CAST(round((CASE WHEN broken THEN row_idx * coalesce(med, 1.0) ELSE date_diff('microsecond', first_ts, clk) / 1e6 END) * 1e6) AS BIGINT)) AS corrected_ts
FROM sg_s JOIN sg_m USING (patient_id, segment) JOIN sg_c USING (patient_id, segment)
""")
def correction(spark, sf):
    anchor = F.lit(tb.SHIFTED_BIRTHDAY).cast("timestamp_ntz")
    starts = segment_corrections(spark, sf).withColumn("segment_start", tb.segment_start(anchor, F.col("age_days"), F.col("clock_sec")))
    return corrected_clocks(stored_segments(spark, sf), starts, ts="clk").select("event_id", "corrected_ts")


@query("T9_anchor", f"""
WITH {SEG}, {EVENTS_SQL}, a AS (SELECT patient_id, 90 + patient_id % 10 AS age, event_ts, bool_and(segment <> 2 OR patient_id % 7 <> 3) AS all_corrected
  FROM sg_c LEFT JOIN ct USING (patient_id) GROUP BY ALL)
SELECT patient_id, CASE WHEN event_ts IS NOT NULL THEN event_ts - to_days(CAST(age AS INT)) ELSE TIMESTAMP '2000-01-01' END AS anchor,
  coalesce(event_ts, TIMESTAMP '2000-01-01' + to_days(CAST(age AS INT)) + to_seconds(5400)) AS event_used FROM a WHERE all_corrected
""")
def anchor(spark, sf):
    seg = segment_corrections(spark, sf).groupBy("patient_id").agg(
        F.bool_and((F.col("segment") != 2) | (F.col("patient_id") % 7 != 3)).alias("_all")).where("_all")
    df = join_keys(seg, clinical(spark, sf), KEY, "left").withColumn("age", 90 + F.col("patient_id") % 10)
    return df.select("patient_id", tb.birth_anchor(F.col("event_ts"), F.col("age")).alias("anchor"),
                     tb.shifted_event(F.col("event_ts"), F.col("age"), F.lit(5400.0)).alias("event_used"))


PATHS_SQL = """
ph AS (SELECT p_partkey, p_size AS patient, '/data/' || p_brand || '/' || p_size || '_' || (p_partkey % 9) || '_' || replace(p_name, ' ', '') || '-' || (p_partkey % 4) || '.csv' AS path,
   '/raw/' || p_size || '_' || p_partkey || '.dat' AS dat FROM part),
st AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '\\.[^.]*$', ''), '-(\\d+)$', '_\\1') AS csv_stem,
   regexp_replace(regexp_extract(dat, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') AS dat_stem FROM ph),
co AS (SELECT DISTINCT p_size || '_' || p_partkey AS new_name, p_partkey % 300 AS age_days, lpad(CAST(p_partkey % 24 AS VARCHAR), 2, '0') || ':00:00' AS clock FROM part WHERE p_partkey % 4 = 1
   UNION ALL SELECT csv_stem, min(p_partkey % 200), '09:30:00' FROM st GROUP BY 1)
"""


def paths(spark, sf):
    p = table(spark, sf, "part")
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    path = F.concat(F.lit("/data/"), "p_brand", F.lit("/"), s("p_size"), F.lit("_"), s(F.col("p_partkey") % 9), F.lit("_"),
                    F.replace("p_name", F.lit(" "), F.lit("")), F.lit("-"), s(F.col("p_partkey") % 4), F.lit(".csv"))
    dat = F.concat(F.lit("/raw/"), s("p_size"), F.lit("_"), s("p_partkey"), F.lit(".dat"))
    return p.select("p_partkey", F.col("p_size").alias("patient"), path.alias("path"), dat.alias("dat")).withColumns(
        {"csv_stem": tb.stem_of(F.col("path")), "dat_stem": tb.stem_of(F.col("dat"))})


def correction_rows(spark, sf):
    p = table(spark, sf, "part").where(F.col("p_partkey") % 4 == 1)
    clock = F.concat(F.lpad((F.col("p_partkey") % 24).cast("string"), 2, "0"), F.lit(":00:00"))
    a = p.select(F.concat(F.col("p_size").cast("string"), F.lit("_"), F.col("p_partkey").cast("string")).alias("new_name"),
                 (F.col("p_partkey") % 300).alias("age_days"), clock.alias("clock"))
    b = paths(spark, sf).groupBy(F.col("csv_stem").alias("new_name")).agg(F.min(F.col("p_partkey") % 200).alias("age_days")).withColumn("clock", F.lit("09:30:00"))
    return a.unionByName(b)


@query("T10_correction_lookup", f"""
WITH {PATHS_SQL}
SELECT p_partkey, CASE WHEN a.new_name IS NOT NULL THEN a.age_days ELSE b.age_days END AS age_days, CASE WHEN a.new_name IS NOT NULL THEN a.clock ELSE b.clock END AS clock,
  a.new_name IS NOT NULL OR b.new_name IS NOT NULL AS has_correction
FROM st LEFT JOIN co a ON st.dat_stem = a.new_name LEFT JOIN co b ON st.csv_stem = b.new_name
""")
def lookup(spark, sf):
    return tb.lookup_correction(paths(spark, sf), correction_rows(spark, sf)).select("p_partkey", "age_days", "clock", "has_correction")


@query("T11_stem_and_patient", f"WITH {PATHS_SQL} SELECT p_partkey, csv_stem, split_part(csv_stem, '_', 1) AS patient_id FROM st")
def stems(spark, sf):
    return paths(spark, sf).select("p_partkey", "csv_stem", tb.patient_of("csv_stem").alias("patient_id"))


@query("T12_segment_order", f"""
WITH {PATHS_SQL}, k AS (SELECT p_partkey, patient, path, co.age_days, co.clock FROM st LEFT JOIN co ON st.dat_stem = co.new_name)
SELECT p_partkey, row_number() OVER (PARTITION BY patient ORDER BY age_days IS NULL, coalesce(age_days, 0), coalesce(clock, ''), path, p_partkey) AS position FROM k
""")
def ordering(spark, sf):
    co = correction_rows(spark, sf)
    seg = paths(spark, sf).join(co, F.col("dat_stem") == F.col("new_name"), "left").withColumn("path", F.struct("path", "p_partkey"))
    return tb.order_segments(seg, ["patient"]).select("p_partkey", "position")


@query("T13_event_to_start", """
WITH cl AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 400 AS age, (c_nationkey % 24) * 3600.0 + 900.0 AS ev_sec FROM customer),
co AS (SELECT o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_' || (o_orderkey % 5) END AS name, o_orderkey, o_custkey % 400 + o_orderkey % 4 AS age_start, lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':15:00' AS clock FROM orders),
f AS (SELECT id, min(struct_pack(a := age_start, b := clock)) AS s FROM cl JOIN co ON name = id OR starts_with(name, id || '_') GROUP BY 1)
SELECT id, round((s.a - age) * 24.0 + (CAST(left(s.b, 2) AS INT) * 3600.0 + 900.0 - ev_sec) / 3600.0, 2) AS hours_to_start FROM f JOIN cl USING (id)
""")
def event_to_start(spark, sf):
    cl = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 400).alias("age"), ((F.col("c_nationkey") % 24) * 3600.0 + 900.0).alias("ev_sec"))
    o = table(spark, sf, "orders")
    name = F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(
        F.concat(F.lit("_"), (F.col("o_orderkey") % 5).cast("string"))))
    co = o.select(name.alias("name"), (F.col("o_custkey") % 400 + F.col("o_orderkey") % 4).alias("age_start"),
                  F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":15:00")).alias("clock"))
    hit = prefix_matches(co, cl, "name", "id")
    first = hit.groupBy("id", "age", "ev_sec").agg(F.min(F.struct("age_start", "clock")).alias("s"))
    hours = (F.col("s.age_start") - F.col("age")) * 24.0 + (ck.clock_seconds(F.col("s.clock")) - F.col("ev_sec")) / 3600.0
    return first.select("id", F.round(hours, 2).alias("hours_to_start"))


@query("T14_shifted_dates", """
SELECT o_orderkey, NOT (year(o_orderdate + to_years(CAST(o_custkey % 60 AS INT) - 10)) BETWEEN 2000 AND 2040) AS shifted FROM orders
""")
def shifted(spark, sf):
    moved = ck.ntz("o_orderdate") + F.make_ym_interval((F.col("o_custkey") % 60).cast("int") - 10)
    return table(spark, sf, "orders").select("o_orderkey", ck.implausible_year(moved).alias("shifted"))


@query("T15_step_support", f"WITH {EP}, {SUPPORT} SELECT event_id, round(support + 1e-9, 6) AS support_hours FROM su")
def support(spark, sf):
    return with_support(stored_recordings(spark, sf)).select("event_id", R(F.col("support_hours")).alias("support_hours"))


@query("T16_timestamp_gaps", f"""
WITH {EP}, {SUPPORT} SELECT patient_id, row_idx - 1 AS start_idx, row_idx AS end_idx, round(step_prev + 1e-9, 6) AS gap_seconds FROM st WHERE step_prev > 3600
""")
def gaps(spark, sf):
    return tb.timestamp_gaps(indexed(spark, sf), KEY, seconds=3600.0).withColumn("gap_seconds", R(F.col("gap_seconds")))


@query("T17_display_gaps", f"""
WITH {EP}, {SUPPORT}, m AS (SELECT patient_id, median(step_prev) AS m FROM st GROUP BY 1)
SELECT patient_id, round(hrs - step_prev / 3600.0 + 1e-9, 6) AS start_hours, round(hrs + 1e-9, 6) AS end_hours FROM st JOIN m USING (patient_id) WHERE step_prev > greatest(m * 5, 1800.0)
""")
def display_gaps(spark, sf):
    out = tb.display_gaps(recordings(spark, sf), KEY)
    return out.withColumns({c: R(F.col(c)) for c in ("start_hours", "end_hours")})


@query("T18_axis_audit", f"""
WITH {EP}, {SUPPORT}, c AS (SELECT *, lag(event_id) OVER (PARTITION BY patient_id ORDER BY row_idx) AS pe FROM st)
SELECT patient_id, count(*) AS n_rows, round(min(step_prev)+1e-9,6) AS step_min, round(max(step_prev)+1e-9,6) AS step_max, count(*) FILTER (step_prev > 7200) AS n_gaps,
  round(coalesce(sum(step_prev) FILTER (step_prev > 7200), 0)+1e-9,4) AS gap_total, round(coalesce(max(step_prev) FILTER (step_prev > 7200), 0)+1e-9,6) AS gap_largest,
  round(date_diff('microsecond', min(ts), max(ts)) / 3600000000.0+1e-9,6) AS span_hours, coalesce(bool_and(pe IS NULL OR event_id = pe + 1), TRUE) AS counter_ok
FROM c GROUP BY 1
""")
def axis_audit(spark, sf):
    out = tb.axis_audit(indexed(spark, sf), KEY, gap_seconds=7200.0, counter="event_id")
    return out.select("patient_id", "n_rows", *[R(F.col(c)).alias(c) for c in ("step_min", "step_max", "gap_largest", "span_hours")],
                      "n_gaps", R(F.col("gap_total"), 4).alias("gap_total"), "counter_ok")


@query("T19_counter_blocks", f"""
WITH {EP}, k AS (SELECT *, event_id % 1000 AS counter FROM tl), l AS (SELECT *, lag(counter) OVER (PARTITION BY patient_id ORDER BY row_idx) AS pc FROM k),
b AS (SELECT *, max(CASE WHEN pc IS NULL OR counter <= pc THEN row_idx END) OVER (PARTITION BY patient_id ORDER BY row_idx) AS block_start FROM l)
SELECT patient_id, block_start, count(*) AS block_rows, arg_min(counter, row_idx) AS counter_first, arg_max(counter, row_idx) AS counter_last, min(ts) AS ts_first, max(ts) AS ts_last FROM b GROUP BY 1, 2
""")
def blocks(spark, sf):
    df = indexed(spark, sf).withColumn("counter", F.col("event_id") % 1000)
    return tb.block_bounds(tb.counter_blocks(df, KEY, "counter"), KEY, "counter")


@query("T19_locate_blocks", f"""
WITH {EP}, k AS (SELECT *, event_id % 1000 AS counter FROM tl), l AS (SELECT *, lag(counter) OVER (PARTITION BY patient_id ORDER BY row_idx) AS pc FROM k),
b AS (SELECT *, max(CASE WHEN pc IS NULL OR counter <= pc THEN row_idx END) OVER (PARTITION BY patient_id ORDER BY row_idx) AS block_start FROM l),
o AS (SELECT patient_id AS other_patient_id, ts AS w, row_number() OVER (PARTITION BY patient_id ORDER BY ts, event_id) - 1 AS j FROM ep WHERE event_id % 41 <> 0),
h AS (SELECT patient_id, block_start, other_patient_id, j - row_idx AS row_shift, count(*) AS m FROM b JOIN o ON b.ts = o.w GROUP BY ALL),
s AS (SELECT patient_id, block_start, count(*) AS block_rows FROM b GROUP BY 1, 2)
SELECT patient_id, block_start, other_patient_id, row_shift, block_rows FROM h JOIN s USING (patient_id, block_start) WHERE m = block_rows
""")
def locate(spark, sf):
    df = indexed(spark, sf).withColumn("counter", F.col("event_id") % 1000)
    others = index_rows(epochs(spark, sf).where(F.col("event_id") % 41 != 0), KEY, ["ts", "event_id"])
    return tb.locate_blocks(tb.counter_blocks(df, KEY, "counter"), KEY, others, KEY, "ts")


def _case(values):
    return " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items())


FAMILY_LIST = [*FAMILY_ENGINES, "heart_rate"]
FAMILY_SQL = "['" + "','".join(FAMILY_LIST) + "'][CAST(p_partkey % %d AS INT) + 1]" .replace("%d", str(len(FAMILY_LIST)))


@query("T20_cadence", f"""
WITH f AS (SELECT p_partkey, {FAMILY_SQL} AS family FROM part),
e AS (SELECT *, CASE family {_case(FAMILY_ENGINES)} END AS engine FROM f),
tp AS (SELECT * FROM (VALUES ('FFTEngine01', 2.4, 4.0), ('Amplitude01', 0.2, 12.0)) t(engine, step, win))
SELECT p_partkey, family, engine, CAST(coalesce(greatest(1, round_even(step, 0)), CASE engine {_case(ENGINE_CADENCE)} END, 1) AS INT) AS cadence_rows,
  CAST(coalesce(win, CASE engine {_case(ENGINE_WINDOW)} END, 1.0) AS DOUBLE) AS window_seconds
FROM e LEFT JOIN tp USING (engine)
""")
def cadence(spark, sf):
    names = F.array(*[F.lit(f) for f in FAMILY_LIST])
    cols = table(spark, sf, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(FAMILY_LIST)).cast("int")).alias("family"))
    template = spark.createDataFrame([("FFTEngine01", 2.4, 4.0), ("Amplitude01", 0.2, 12.0)], "engine string, step double, win double")
    return cadence_table(cols, template).select("p_partkey", "family", "engine", "cadence_rows", "window_seconds")


also_sliced("T8_clock_correction")
also_sliced("T15_step_support")
also_sliced("T16_timestamp_gaps")
