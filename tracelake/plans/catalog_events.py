"""Event analytics queries."""

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import events as ev
from ..operators.stored_timeline import REC
from .bindings import EP, KEY, recordings, stored_recordings, table
from .registry import also_sliced, query

RUNS = """
rn AS (
  SELECT *, sum(CASE WHEN lag_f IS NULL OR lag_f <> f THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id ORDER BY row_idx) AS island
  FROM (SELECT *, lag(f) OVER (PARTITION BY patient_id ORDER BY row_idx) AS lag_f FROM fl))
"""


@query("E1_event_roles", """
WITH c AS (SELECT p_size AS file_id, p_partkey AS col_idx, 'I' || p_partkey || '_1' AS code,
  (['Seizure Probability P14','Seizure Detections','SeizureNotifications','EEG Left','Seizure Burden','aEEG Right'])[CAST(p_partkey % 6 AS BIGINT) + 1]
   || ', ' || p_name AS label FROM part),
r AS (SELECT *, CASE WHEN regexp_matches(lower(label), 'seizure\\s*(probabilit|detect|notif|burden|mask)|seizureprobabilit|seizuredetect|seizurenotif') THEN
   CASE WHEN contains(lower(label),'probability') THEN 'probability' WHEN contains(lower(label),'detection') THEN 'detections'
        WHEN contains(lower(label),'notification') THEN 'notifications' END END AS role FROM c)
SELECT file_id, role, arg_max(code, col_idx) AS code FROM r WHERE role IS NOT NULL GROUP BY 1, 2
""")
def event_roles(spark, sf):
    kinds = F.array(*[F.lit(k) for k in (
        "Seizure Probability P14", "Seizure Detections", "SeizureNotifications", "EEG Left", "Seizure Burden", "aEEG Right")])
    cols = table(spark, sf, "part").select(
        F.col("p_size").alias("file_id"), F.col("p_partkey").alias("col_idx"),
        F.concat(F.lit("I"), F.col("p_partkey"), F.lit("_1")).alias("code"),
        F.concat(F.get(kinds, (F.col("p_partkey") % 6).cast("int")), F.lit(", "), F.col("p_name")).alias("label"))
    return ev.role_columns(cols, ["file_id"])


@query("E2_event_masks", f"""
WITH {EP}
SELECT patient_id, event_id, FALSE AS mask_none, coalesce(CASE WHEN channel = 'purchase' THEN value END, 0.0) > 0 AS mask_detected,
       coalesce(value / 100.0, 0.0) >= 0.5 AS mask_probability FROM tl
""")
def event_masks(spark, sf):
    df = recordings(spark, sf).withColumn("prob", F.col("value") / 100.0).withColumn(
        "det", F.when(F.col("channel") == "purchase", F.col("value")))
    return df.select("patient_id", "event_id", ev.event_mask("none").alias("mask_none"),
                     ev.event_mask("detected", detections="det").alias("mask_detected"),
                     ev.event_mask("probability", probability="prob").alias("mask_probability"))


@query("E3_burden", f"""
WITH {EP}
SELECT patient_id, count(*) AS n_epochs, count(*) FILTER (artifact_clean) AS n_usable,
  count(*) FILTER (seizure) AS event_epochs, count(*) FILTER (seizure AND artifact_clean) AS event_epochs_clean,
  max(value) AS max_probability,
  round(CASE WHEN count(*) FILTER (artifact_clean) > 0 THEN 100.0 * count(*) FILTER (seizure AND artifact_clean) / count(*) FILTER (artifact_clean) ELSE 0.0 END + 1e-9, 6) AS burden_pct
FROM tl GROUP BY 1
""")
def burden(spark, sf):
    out = ev.burden(recordings(spark, sf), KEY, "seizure", "artifact_clean", "value")
    return out.drop("hours_to_first", "hours_to_first_clean").withColumn("burden_pct", rounded(F.col("burden_pct")))


@query("E4_event_count", f"""
WITH {EP}, lg AS (SELECT *, lag(seizure, 1, FALSE) OVER (PARTITION BY patient_id ORDER BY row_idx) AS p FROM tl)
SELECT patient_id, count(*) FILTER (seizure AND NOT p) AS events FROM lg GROUP BY 1
""")
def event_count(spark, sf):
    return ev.event_counts(recordings(spark, sf), KEY, "seizure", "events")


@query("E5_time_to_first", f"""
WITH {EP}
SELECT patient_id, round(arg_min(hrs, row_idx) FILTER (seizure) + 1e-9, 6) AS hours_to_first,
       round(arg_min(hrs, row_idx) FILTER (seizure AND artifact_clean) + 1e-9, 6) AS hours_to_first_clean
FROM tl GROUP BY 1
""")
def time_to_first(spark, sf):
    out = ev.burden(recordings(spark, sf), KEY, "seizure", "artifact_clean")
    return out.select("patient_id", rounded(F.col("hours_to_first")).alias("hours_to_first"),
                      rounded(F.col("hours_to_first_clean")).alias("hours_to_first_clean"))


@query("E6_longest_run", f"""
WITH {EP}, fl AS (SELECT patient_id, row_idx, artifact_clean AS f FROM tl), {RUNS},
g AS (SELECT patient_id, island, count(*) AS n FROM rn WHERE f GROUP BY 1, 2)
SELECT patient_id, round(max(n) * 1.0 / 60.0 + 1e-9, 6) AS longest_minutes FROM g GROUP BY 1
""")
def longest_run(spark, sf):
    out = ev.longest_run_minutes(recordings(spark, sf), KEY, "artifact_clean")
    return out.withColumn("longest_minutes", rounded(F.col("longest_minutes")))


@query("E7_max_hourly_burden", f"""
WITH {EP}, w AS (
  SELECT patient_id, row_idx, sum(CASE WHEN seizure AND artifact_clean THEN 1 ELSE 0 END) OVER (
    PARTITION BY patient_id ORDER BY row_idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS s FROM tl),
t AS (SELECT patient_id, max(s) FILTER (row_idx >= 59) AS top FROM w GROUP BY 1),
b AS (SELECT patient_id, 100.0 * count(*) FILTER (seizure AND artifact_clean) / count(*) FILTER (artifact_clean) AS pct FROM tl GROUP BY 1)
SELECT b.patient_id, round(coalesce(top * 100.0 / 60, pct) + 1e-9, 6) AS max_hourly_burden_pct FROM b JOIN t USING (patient_id)
""")
def hourly_burden(spark, sf):
    tl = stored_recordings(spark, sf)
    df = tl.rows.withColumn("m", F.col("seizure") & F.col("artifact_clean"))
    base = ev.burden(df, [REC], "seizure", "artifact_clean")
    out = ev.max_hourly_burden(df, [REC], "m", base, epoch_seconds=60.0).join(tl.recordings.select(REC, *KEY), REC).drop(REC)
    return out.withColumn("max_hourly_burden_pct", rounded(F.col("max_hourly_burden_pct")))


@query("E8_repeated_onsets", f"""
WITH {EP}, c AS (SELECT *, seizure AND artifact_clean AS m FROM tl),
lg AS (SELECT *, lag(m, 1, FALSE) OVER (PARTITION BY patient_id ORDER BY row_idx) AS p FROM c),
o AS (SELECT patient_id, hrs, lead(hrs) OVER (PARTITION BY patient_id ORDER BY row_idx) AS nh FROM lg WHERE m AND NOT p)
SELECT patient_id, coalesce(bool_or((nh - hrs) * 60.0 < 600.0), FALSE) AS repeated FROM o GROUP BY 1
""")
def repeated(spark, sf):
    df = recordings(spark, sf).withColumn("m", F.col("seizure") & F.col("artifact_clean"))
    return ev.repeated_onsets(df, KEY, "m", minutes=600.0)


REPORT_SQL = f"""
WITH {EP}, c AS (SELECT *, seizure AND artifact_clean AS m FROM tl),
lg AS (SELECT *, lag(seizure, 1, FALSE) OVER w AS ps, lag(m, 1, FALSE) OVER w AS pm,
   row_number() OVER w - row_number() OVER (PARTITION BY patient_id, seizure ORDER BY row_idx) AS gs,
   row_number() OVER w - row_number() OVER (PARTITION BY patient_id, m ORDER BY row_idx) AS gm
   FROM c WINDOW w AS (PARTITION BY patient_id ORDER BY row_idx)),
b AS (SELECT patient_id, count(*) FILTER (seizure) AS event_epochs, count(*) FILTER (m) AS event_epochs_clean,
   count(*) FILTER (seizure AND NOT ps) AS events, count(*) FILTER (m AND NOT pm) AS events_clean,
   100.0 * count(*) FILTER (m) / count(*) FILTER (artifact_clean) AS burden_pct FROM lg GROUP BY 1),
ls AS (SELECT patient_id, max(n) AS n FROM (SELECT patient_id, gs, count(*) AS n FROM lg WHERE seizure GROUP BY 1, 2) GROUP BY 1),
lm AS (SELECT patient_id, max(n) AS n FROM (SELECT patient_id, gm, count(*) AS n FROM lg WHERE m GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT patient_id, hrs, lead(hrs) OVER (PARTITION BY patient_id ORDER BY row_idx) AS nh FROM lg WHERE m AND NOT pm),
rp AS (SELECT patient_id, coalesce(bool_or((nh - hrs) * 60.0 < 5.0), FALSE) AS repeated FROM o GROUP BY 1),
w AS (SELECT patient_id, row_idx, sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id ORDER BY row_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS s FROM c),
t AS (SELECT patient_id, max(s) FILTER (row_idx >= 29) AS top FROM w GROUP BY 1),
r AS (SELECT b.*, coalesce(ls.n, 0) * 120.0 / 60.0 AS longest_minutes, coalesce(lm.n, 0) * 120.0 / 60.0 AS longest_minutes_clean,
   coalesce(rp.repeated, FALSE) AS repeated, coalesce(t.top * 100.0 / 30, burden_pct) AS mh
   FROM b LEFT JOIN ls USING (patient_id) LEFT JOIN lm USING (patient_id) LEFT JOIN rp USING (patient_id) LEFT JOIN t USING (patient_id))
"""
REPORT_COLS = ["patient_id", "event_epochs", "event_epochs_clean", "events", "events_clean", "longest_minutes", "longest_minutes_clean", "repeated"]


@query("E9_status_screen", REPORT_SQL + """
SELECT patient_id, (longest_minutes_clean >= 30.0 OR mh >= 50.0 OR repeated) AS status_screen FROM r
""")
def status_screen(spark, sf):
    return ev.event_report(recordings(spark, sf), KEY, "seizure", "artifact_clean", "value", epoch_seconds=120.0).select(
        "patient_id", "status_screen")


@query("E10_event_report", REPORT_SQL + """
SELECT patient_id, event_epochs, event_epochs_clean, events, events_clean, longest_minutes, longest_minutes_clean, repeated,
  round(burden_pct + 1e-9, 6) AS burden_pct, round(mh + 1e-9, 6) AS max_hourly_burden_pct FROM r
""")
def event_report(spark, sf):
    tl = stored_recordings(spark, sf)
    out = ev.event_report(tl.rows, [REC], "seizure", "artifact_clean", "value", epoch_seconds=120.0).join(tl.recordings.select(REC, *KEY), REC)
    return out.select(*REPORT_COLS, rounded(F.col("burden_pct")).alias("burden_pct"),
                      rounded(F.col("max_hourly_burden_pct")).alias("max_hourly_burden_pct"))


@query("E11_flagged_regions", f"""
WITH {EP}, n AS (SELECT *, lead(hrs) OVER (PARTITION BY patient_id ORDER BY row_idx) AS nh,
  row_idx - row_number() OVER (PARTITION BY patient_id, artifact_clean ORDER BY row_idx) AS g FROM tl)
SELECT patient_id, min(row_idx) AS run_start, count(*) AS run_rows, round(min(hrs) + 1e-9, 6) AS start_hours,
  round(arg_max(coalesce(nh, hrs), row_idx) + 1e-9, 6) AS end_hours
FROM n WHERE NOT artifact_clean GROUP BY patient_id, g
""")
def flagged(spark, sf):
    out = ev.flagged_regions(recordings(spark, sf), KEY, "artifact_clean")
    return out.withColumns({c: rounded(F.col(c)) for c in ("start_hours", "end_hours")})


also_sliced("E10_event_report")
