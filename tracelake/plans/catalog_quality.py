"""Validation, quality and feature queries."""

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import features as ft
from ..operators import quality as ql
from ..operators.columns import cadence_table
from ..operators.merge import to_long
from ..operators.ordered import index_rows, join_keys, running, strip_layout
from .bindings import EP, KEY, SG, epochs, indexed, indexed_signals, recordings, signals, table
from .registry import query

R = rounded


# ---- validation ----------------------------------------------------------------

@query("Q1_leading_zeros", """
WITH z AS (SELECT l_suppkey AS patient_id, l_discount, l_tax, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount + l_tax > 0.03, l_orderkey, l_linenumber, l_partkey) - 1 AS row_idx,
  CASE WHEN l_discount + l_tax > 0.03 THEN l_discount ELSE 0.0 END AS a, CASE WHEN l_discount + l_tax > 0.03 THEN CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax END ELSE 0.0 END AS b FROM lineitem),
f AS (SELECT patient_id, coalesce(min(row_idx) FILTER (coalesce(a <> 0, TRUE) OR coalesce(b <> 0, TRUE)), count(*)) AS leading_zero_rows, count(*) AS n FROM z GROUP BY 1)
SELECT patient_id, leading_zero_rows, n - leading_zero_rows AS rows_kept FROM f
""")
def leading_zeros(spark, sf):
    li = table(spark, sf, "lineitem")
    awake = F.col("l_discount") + F.col("l_tax") > 0.03
    df = li.select(F.col("l_suppkey").alias("patient_id"), awake.cast("int").alias("k"), "l_orderkey", "l_linenumber", "l_partkey",
                   F.when(awake, F.col("l_discount")).otherwise(0.0).alias("a"),
                   F.when(awake, F.when(F.col("l_linenumber") % 3 == 0, None).otherwise(F.col("l_tax"))).otherwise(0.0).alias("b"))
    ix = index_rows(df, KEY, ["k", "l_orderkey", "l_linenumber", "l_partkey"])
    kept = ql.drop_leading_zeros(ix, KEY, ["a", "b"]).groupBy("patient_id").agg(F.count(F.lit(1)).alias("rows_kept"))
    return join_keys(ql.leading_zero_rows(ix, KEY, ["a", "b"]), kept, KEY, "left").withColumn("rows_kept", F.coalesce("rows_kept", F.lit(0)))


@query("Q2_out_of_range", """
WITH s AS (SELECT l_suppkey AS patient_id, l_quantity * 12.0 AS a, l_extendedprice / 150.0 AS b, l_discount * 12.0 - 0.1 AS c, l_tax * 10.0 AS d FROM lineitem),
g AS (SELECT patient_id, count(*) FILTER (a < 0 OR a > 500) + count(*) FILTER (b < 0 OR b > 500) AS x, count(*) FILTER (c < 0 OR c > 1) AS y, count(*) FILTER (d < 0 OR d > 1) AS z FROM s GROUP BY 1)
SELECT patient_id, 'fft_power' AS family, x AS n_bad FROM g WHERE x > 0 UNION ALL SELECT patient_id, 'relative_power', y FROM g WHERE y > 0 UNION ALL SELECT patient_id, 'coherence_spectrogram', z FROM g WHERE z > 0
""")
def ranges(spark, sf):
    li = table(spark, sf, "lineitem")
    df = li.select(F.col("l_suppkey").alias("patient_id"), (F.col("l_quantity") * 12.0).alias("a"), (F.col("l_extendedprice") / 150.0).alias("b"),
                   (F.col("l_discount") * 12.0 - 0.1).alias("c"), (F.col("l_tax") * 10.0).alias("d"))
    return ql.out_of_range(df, KEY, {"fft_power": ["a", "b"], "relative_power": ["c"], "coherence_spectrogram": ["d"], "sleep": ["a"]})


@query("Q3_identity_check", """
WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'XXXX xx' WHEN c_custkey % 3 = 1 THEN c_name END AS name FROM customer)
SELECT c_custkey, trim(regexp_replace(coalesce(name, ''), '[Xx]', '', 'g')) <> '' AS identity_found FROM n
""")
def identity(spark, sf):
    k = F.col("c_custkey") % 3
    df = table(spark, sf, "customer").withColumn("name", F.when(k == 0, "XXXX xx").when(k == 1, F.col("c_name")))
    return ql.strip_identity(df.withColumn("identity_found", ql.has_identity("name")), ["name", "c_name"]).select("c_custkey", "identity_found")


# Suppressed zeros: two positive-definite regional references (discount, tax), a
# whole-head one, a zero-legitimate and a fallback column, a binary column.
INSTRUMENTS = [
    ql.Instrument("left power", "fft_power", "Left Hemisphere", ("lp1", "lp2")),
    ql.Instrument("right power", "fft_power", "Right Hemisphere", ("rp",)),
    ql.Instrument("envelope", "peak_envelope", "", ("env",)),
    ql.Instrument("left suppression", "suppression_ratio", "Left Hemisphere", ("sup",)),
    ql.Instrument("asymmetry", "asymmetry", "Asym Hemi", ("asym",)),
    ql.Instrument("detections", "seizure_detection", "", ("det",)),
    ql.Instrument("dead reference", "aeeg", "Left Anterior", ("dead",)),
]
AR = """
a0 AS (SELECT l_suppkey AS patient_id, l_orderkey, l_linenumber, l_partkey, l_discount AS lp1, CASE WHEN l_discount = 0 AND l_linenumber <> 7 THEN 0.0 ELSE l_quantity END AS lp2,
   CASE WHEN l_linenumber % 4 = 0 THEN l_discount ELSE l_tax END AS rp, l_tax AS env, l_quantity % 3 AS sup, l_quantity % 5 - 2 AS asym, CAST(l_linenumber = 1 AS INT)::DOUBLE AS det, 0.0 AS dead FROM lineitem),
a1 AS (SELECT *, lp1 = 0 AND lp2 = 0 AS nl, rp = 0 AS nr, env = 0 AS ne FROM a0),
a2 AS (SELECT *, avg(nl::INT) OVER (PARTITION BY patient_id) < 0.95 AS sl, avg(nr::INT) OVER (PARTITION BY patient_id) < 0.95 AS sr FROM a1),
a3 AS (SELECT *, sl AND nl AS rl, sr AND nr AS rr, sl::INT + sr::INT AS n_regions, (sl AND nl)::INT + (sr AND nr)::INT AS n_rejected FROM a2),
a4 AS (SELECT *, n_regions > 0 AND n_rejected = n_regions AS all_regions,
   n_regions > 0 AND nl AS ml, n_regions > 0 AND nr AS mr, n_regions > 0 AND ne AS me,
   n_regions > 0 AND CASE WHEN sl THEN rl ELSE FALSE END AS ms, n_regions > 0 AND CASE WHEN sl THEN rl WHEN sr THEN rr ELSE FALSE END AS ma, n_regions > 0 AS md FROM a3)
"""


def suppressed(spark, sf):
    li = table(spark, sf, "lineitem")
    d, t, q, n = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.col("l_linenumber")
    return li.select(
        F.col("l_suppkey").alias("patient_id"), "l_orderkey", "l_linenumber", "l_partkey", d.alias("lp1"),
        F.when((d == 0) & (n != 7), 0.0).otherwise(q).alias("lp2"), F.when(n % 4 == 0, d).otherwise(t).alias("rp"), t.alias("env"),
        (q % 3).alias("sup"), (q % 5 - 2).alias("asym"), (n == 1).cast("int").cast("double").alias("det"), F.lit(0.0).alias("dead"))


IDS = ["patient_id", "l_orderkey", "l_linenumber", "l_partkey"]


@query("Q4_rejection_masks", f"""
WITH {AR} SELECT patient_id, l_orderkey, l_linenumber, l_partkey, n_regions, n_rejected, all_regions FROM a4
""")
def rejection_masks(spark, sf):
    return ql.rejection_flags(suppressed(spark, sf), KEY, INSTRUMENTS).select(*IDS, "n_regions", "n_rejected", "all_regions")


@query("Q5_null_suppressed", f"""
WITH {AR} SELECT patient_id, l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT ml THEN lp1 END AS lp1, CASE WHEN NOT ml THEN lp2 END AS lp2, CASE WHEN NOT mr THEN rp END AS rp,
  CASE WHEN NOT me THEN env END AS env, CASE WHEN NOT ms THEN sup END AS sup, CASE WHEN NOT ma THEN asym END AS asym, CASE WHEN NOT all_regions THEN det END AS det, CASE WHEN NOT md THEN dead END AS dead FROM a4
""")
def null_suppressed(spark, sf):
    out = ql.null_suppressed_zeros(suppressed(spark, sf), KEY, INSTRUMENTS)
    return out.select(*IDS, "lp1", "lp2", "rp", "env", "sup", "asym", "det", "dead")


@query("Q5_null_spectra", """
WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda e: CASE WHEN (vec_id + label) % 6 = 0 THEN 0.0::DOUBLE ELSE e::DOUBLE END) AS bins FROM embeddings),
f AS (SELECT *, len(list_filter(bins, lambda e: e = 0)) = len(bins) AS z FROM x), s AS (SELECT *, avg(z::INT) OVER (PARTITION BY label) < 0.95 AS live FROM f)
SELECT vec_id, label, live AND z AS suppressed, CASE WHEN NOT (live AND z) THEN round(list_sum(bins) + 1e-9, 6) END AS bin_total FROM s
""")
def null_spectra(spark, sf):
    e = table(spark, sf, "embeddings")
    df = e.withColumn("bins", F.transform("embedding", lambda x: F.when((F.col("vec_id") + F.col("label")) % 6 == 0, F.lit(0.0)).otherwise(x.cast("double"))))
    ins = [ql.Instrument("spectrogram", "fft_spectrogram", "Left Hemisphere", array="bins")]
    out = ql.null_suppressed_zeros(df, ["label"], ins)
    total = F.aggregate("bins", F.lit(0.0), lambda a, b: a + b)
    return out.select("vec_id", "label", F.col("bins").isNull().alias("suppressed"), R(total).alias("bin_total"))


@query("Q6_rejection_report", f"""
WITH {AR} SELECT patient_id, max(n_regions) AS n_regions, count(*) FILTER (all_regions) AS rows_all_rejected, count(*) FILTER (n_rejected > 0 AND NOT all_regions) AS rows_partial,
  CAST(sum(2*ml::INT + mr::INT + me::INT + ms::INT + ma::INT + all_regions::INT + md::INT) AS BIGINT) AS cells_nulled, max(n_regions) = 0 AS segment_empty,
  round(CASE WHEN bool_or(sl) THEN avg(rl::INT) * 100 END, 3) AS pct_left_hemisphere, round(CASE WHEN bool_or(sr) THEN avg(rr::INT) * 100 END, 3) AS pct_right_hemisphere
FROM a4 GROUP BY 1
""")
def rejection_report(spark, sf):
    out = ql.rejection_report(suppressed(spark, sf), KEY, INSTRUMENTS)
    return out.drop("pct_left_anterior")


@query("Q7_artifact_filter", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, TRUE AS clean_none, coalesce(greatest(l_quantity / 10.0, l_tax * 60.0) < 5.0, FALSE) AS clean_intensity,
  (coalesce(l_discount * 10 <= 0.5, FALSE))::INT + (coalesce(l_tax * 10 <= 0.5, FALSE))::INT + (coalesce(CASE WHEN l_linenumber > 2 THEN l_quantity / 50.0 END <= 0.5, FALSE))::INT >= 2 AS clean_quality,
  coalesce(greatest(l_quantity / 10.0, l_tax * 60.0) < 5.0, FALSE) AND (coalesce(l_discount * 10 <= 0.5, FALSE))::INT + (coalesce(l_tax * 10 <= 0.5, FALSE))::INT + (coalesce(CASE WHEN l_linenumber > 2 THEN l_quantity / 50.0 END <= 0.5, FALSE))::INT >= 2 AS clean_combined
FROM lineitem
""")
def artifact_filter(spark, sf):
    df = table(spark, sf, "lineitem").withColumns({
        "i1": F.col("l_quantity") / 10.0, "i2": F.col("l_tax") * 60.0, "q1": F.col("l_discount") * 10, "q2": F.col("l_tax") * 10,
        "q3": F.when(F.col("l_linenumber") > 2, F.col("l_quantity") / 50.0)})
    clean = lambda m: ql.artifact_clean(df, m, ["i1", "i2"], ["q1", "q2", "q3", "absent"], min_electrodes=2)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[
        clean(m).alias(f"clean_{m}") for m in ("none", "intensity", "quality", "combined")])


@query("Q8_exclude_blank", f"""
WITH {AR}, c AS (SELECT *, l_linenumber <> 5 AND NOT all_regions AS clean FROM a4)
SELECT patient_id, count(*) AS total_epochs, count(*) FILTER (NOT clean) AS excluded_epochs, round(100.0 * count(*) FILTER (NOT clean) / count(*) + 1e-9, 6) AS artifact_pct FROM c GROUP BY 1
""")
def exclude_blank(spark, sf):
    df = ql.null_suppressed_zeros(suppressed(spark, sf), KEY, INSTRUMENTS)
    df = df.withColumn("artifact_clean", ql.exclude_blank(F.col("l_linenumber") != 5))
    return ql.artifact_report(df, KEY).withColumn("artifact_pct", R(F.col("artifact_pct")))


@query("Q9_usable_mask", f"WITH {EP} SELECT event_id, artifact_clean AND NOT seizure AS usable, artifact_clean AS usable_keep_events FROM tl")
def usable(spark, sf):
    return epochs(spark, sf).select("event_id", ql.usable_mask("artifact_clean", "seizure").alias("usable"),
                                    ql.usable_mask("artifact_clean", "seizure", False).alias("usable_keep_events"))


COLS_SQL = """
w AS (SELECT l_suppkey AS patient_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS row_idx, l_quantity AS c_qty, l_quantity + 0.0 AS c_copy,
   CASE WHEN l_suppkey % 2 = 0 AND l_linenumber = 1 AND l_orderkey % 50 = 0 THEN l_quantity + 0.000001 ELSE l_quantity END AS c_near, CASE WHEN l_linenumber % 2 = 0 THEN 5.0 END AS c_const,
   CAST(NULL AS DOUBLE) AS c_null, l_tax AS c_tax, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS c_tax_gap, CASE WHEN l_suppkey % 6 = 0 THEN 0.0 WHEN l_suppkey % 3 = 0 THEN 1.0 ELSE l_discount END AS c_mixed FROM lineitem)
"""
COLS = ["c_qty", "c_copy", "c_near", "c_const", "c_null", "c_tax", "c_tax_gap", "c_mixed"]


def column_frame(spark, sf):
    li = table(spark, sf, "lineitem")
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    df = li.select(
        F.col("l_suppkey").alias("patient_id"), "l_orderkey", "l_linenumber", "l_partkey", q.alias("c_qty"), (q + 0.0).alias("c_copy"),
        F.when((F.col("l_suppkey") % 2 == 0) & (n == 1) & (F.col("l_orderkey") % 50 == 0), q + 0.000001).otherwise(q).alias("c_near"),
        F.when(n % 2 == 0, 5.0).alias("c_const"), F.lit(None).cast("double").alias("c_null"), F.col("l_tax").alias("c_tax"),
        F.when(n == 3, None).otherwise(F.col("l_tax")).alias("c_tax_gap"), F.when(F.col("l_suppkey") % 6 == 0, 0.0).when(F.col("l_suppkey") % 3 == 0, 1.0).otherwise(F.col("l_discount")).alias("c_mixed"))
    return index_rows(df, KEY, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("Q10_constant_columns", f"""
WITH {COLS_SQL}, l AS (UNPIVOT (SELECT patient_id, row_idx, coalesce(CAST(c_qty AS DOUBLE), CAST('nan' AS DOUBLE)) AS c_qty, coalesce(CAST(c_copy AS DOUBLE), CAST('nan' AS DOUBLE)) AS c_copy, coalesce(CAST(c_near AS DOUBLE), CAST('nan' AS DOUBLE)) AS c_near, coalesce(CAST(c_const AS DOUBLE), CAST('nan' AS DOUBLE)) AS c_const,
   coalesce(CAST(c_null AS DOUBLE), CAST('nan' AS DOUBLE)) AS c_null, coalesce(CAST(c_tax AS DOUBLE), CAST('nan' AS DOUBLE)) AS c_tax, coalesce(CAST(c_tax_gap AS DOUBLE), CAST('nan' AS DOUBLE)) AS c_tax_gap, coalesce(CAST(c_mixed AS DOUBLE), CAST('nan' AS DOUBLE)) AS c_mixed FROM w) ON COLUMNS('c_.*') INTO NAME col VALUE v),
g AS (SELECT patient_id, col, count(*) FILTER (NOT isnan(v)) AS n, min(v) FILTER (NOT isnan(v)) AS lo, max(v) FILTER (NOT isnan(v)) AS hi FROM l GROUP BY 1, 2)
SELECT patient_id, col AS "column", CASE WHEN n = 0 THEN 'all_null' ELSE 'constant' END AS kind, lo AS constant_value FROM g WHERE n = 0 OR lo = hi
""")
def constants(spark, sf):
    return ql.constant_columns(column_frame(spark, sf), KEY, COLS)


@query("Q11_duplicate_columns", f"""
WITH {COLS_SQL}, e AS (SELECT patient_id, bool_and(c_qty IS NOT DISTINCT FROM c_copy) AS a, bool_and(c_qty IS NOT DISTINCT FROM c_near) AS b, bool_and(c_tax IS NOT DISTINCT FROM c_tax_gap) AS c FROM w GROUP BY 1)
SELECT patient_id, 'c_copy' AS "column", 'c_qty' AS duplicate_of FROM e WHERE a UNION ALL SELECT patient_id, 'c_near', 'c_qty' FROM e WHERE b UNION ALL SELECT patient_id, 'c_tax_gap', 'c_tax' FROM e WHERE c
""")
def duplicates(spark, sf):
    return ql.duplicate_columns(column_frame(spark, sf), KEY, COLS)


@query("Q12_column_warnings", f"""
WITH {COLS_SQL}, e AS (SELECT patient_id, bool_and(c_mixed = 1.0) AS one, bool_and(c_mixed = 0.0) AS zero, bool_and(c_qty IS NOT DISTINCT FROM c_copy) AS a, bool_and(c_qty IS NOT DISTINCT FROM c_near) AS b, bool_and(c_tax IS NOT DISTINCT FROM c_tax_gap) AS c FROM w GROUP BY 1),
q AS (SELECT patient_id, 'c_qty' || CASE WHEN a THEN ', c_copy' ELSE '' END || CASE WHEN b THEN ', c_near' ELSE '' END AS g, 1 + a::INT + b::INT AS n FROM e WHERE a OR b)
SELECT patient_id, 'all_null' AS kind, 'c_null' AS "columns", '1 column(s) without any value: c_null' AS warning FROM e UNION ALL
SELECT patient_id, 'constant', CASE WHEN one THEN 'c_const, c_mixed' ELSE 'c_const' END, CASE WHEN one THEN '2 column(s) with one non-zero value throughout: c_const=5.0, c_mixed=1.0' ELSE '1 column(s) with one non-zero value throughout: c_const=5.0' END FROM e UNION ALL
SELECT patient_id, 'zero', 'c_mixed', '1 column(s) with zeros only: c_mixed' FROM e WHERE zero UNION ALL
SELECT patient_id, 'duplicate', g, n || ' column(s) equal on every row: ' || g FROM q UNION ALL
SELECT patient_id, 'duplicate', 'c_tax, c_tax_gap', '2 column(s) equal on every row: c_tax, c_tax_gap' FROM e WHERE c
""")
def warnings(spark, sf):
    frame = column_frame(spark, sf)
    return ql.column_warnings(ql.constant_columns(frame, KEY, COLS), KEY, ql.duplicate_columns(frame, KEY, COLS))


@query("Q13_qc_report", f"""
WITH {EP}, f AS (SELECT *, row_idx < 2 AND NOT seizure AS lead0 FROM tl),
g AS (SELECT patient_id, count(*) AS total_epochs, count(*) FILTER (NOT artifact_clean) AS excluded_epochs, count(*) FILTER (lead0) AS leading_zeros, count(*) FILTER (seizure) AS event_epochs,
  date_diff('microsecond', min(ts), max(ts)) / 3600000000.0 AS dur FROM f GROUP BY 1)
SELECT patient_id, total_epochs, excluded_epochs, leading_zeros, total_epochs - excluded_epochs - leading_zeros AS usable_epochs, round(100.0 * excluded_epochs / total_epochs+1e-9,6) AS artifact_pct,
  event_epochs, round(100.0 * event_epochs / total_epochs+1e-9,6) AS event_pct, round(dur+1e-9,6) AS duration_hours,
  round(CASE WHEN total_epochs > 1 THEN (total_epochs - excluded_epochs - leading_zeros) * dur / (total_epochs - 1) END+1e-9,6) AS usable_hours FROM g
""")
def qc(spark, sf):
    df = recordings(spark, sf).withColumn("lead0", (F.col("row_idx") < 2) & ~F.col("seizure"))
    out = ql.qc_report(df, KEY, leading="lead0")
    return out.withColumns({c: R(F.col(c)) for c in ("artifact_pct", "event_pct", "duration_hours", "usable_hours")})


@query("Q14_median_suppression", f"""
WITH {EP}, m AS (SELECT patient_id, median(value) AS a, median(raw_value / 2.0) AS b FROM tl WHERE artifact_clean GROUP BY 1)
SELECT patient_id, round(((a + b) / 2.0)+1e-9, 6) AS median_suppression_pct FROM m
""")
def med_suppression(spark, sf):
    df = recordings(spark, sf).withColumn("half", F.col("raw_value") / 2.0)
    return ql.median_suppression(df, KEY, ["value", "half"]).withColumn("median_suppression_pct", R(F.col("median_suppression_pct")))


@query("Q15_stage_counts", f"""
WITH {EP} SELECT patient_id, count(*) AS parsed, count(*) FILTER (hrs >= 1.0) AS after_trim, count(*) FILTER (hrs >= 1.0 AND artifact_clean) AS artifact_clean,
  count(*) FILTER (hrs >= 1.0 AND seizure) AS seizure_flagged, count(*) FILTER (hrs >= 1.0 AND usable) AS usable FROM tl GROUP BY 1
""")
def stages(spark, sf):
    kept = F.col("hours") >= 1.0
    return ql.stage_counts(recordings(spark, sf), KEY, {
        "after_trim": kept, "artifact_clean": kept & F.col("artifact_clean"), "seizure_flagged": kept & F.col("seizure"), "usable": kept & F.col("usable")})


@query("Q16_rejection_survey", f"""
WITH {AR}, o AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS row_idx, n_rejected > 0 AS s FROM a4),
i AS (SELECT *, row_idx - row_number() OVER (PARTITION BY patient_id, s ORDER BY row_idx) AS g FROM o),
r AS (SELECT patient_id, count(*) AS n_runs, avg((n % 2 = 0)::INT) * 100 AS mult FROM (SELECT patient_id, g, count(*) AS n FROM i WHERE s GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT patient_id, count(*) AS n_rows, max(n_regions) AS n_regions, avg(all_regions::INT) * 100 AS all_pct, avg((n_rejected > 0 AND NOT all_regions)::INT) * 100 AS partial_pct, avg(n_rejected) AS mean_rejected,
  least(CASE WHEN bool_or(sl) THEN avg(rl::INT) END, CASE WHEN bool_or(sr) THEN avg(rr::INT) END) AS lo, greatest(CASE WHEN bool_or(sl) THEN avg(rl::INT) END, CASE WHEN bool_or(sr) THEN avg(rr::INT) END) AS hi FROM o GROUP BY 1)
SELECT patient_id, n_rows, n_regions, round(all_pct+1e-9,6) AS all_pct, round(partial_pct+1e-9,6) AS partial_pct, round(mean_rejected+1e-9,6) AS mean_rejected,
  round(lo*100+1e-9,6) AS reject_pct_min, round(hi*100+1e-9,6) AS reject_pct_max, round(CASE WHEN lo > 0 THEN hi/lo END+1e-9,6) AS spread, coalesce(n_runs, 0) AS n_runs, round(mult+1e-9,6) AS runs_multiple_pct FROM b LEFT JOIN r USING (patient_id)
""")
def survey(spark, sf):
    df = index_rows(suppressed(spark, sf), KEY, ["l_orderkey", "l_linenumber", "l_partkey"])
    out = ql.rejection_survey(df, KEY, INSTRUMENTS, cadence=2)
    return out.withColumns({c: R(F.col(c)) for c in ("all_pct", "partial_pct", "mean_rejected", "reject_pct_min", "reject_pct_max", "spread", "runs_multiple_pct")})


@query("Q17_acceptance_checks", """
WITH c AS (SELECT p_size AS file_id, CASE WHEN p_partkey % 97 = 0 THEN '1bad name' ELSE lower(replace(p_name, ' ', '_')) || '_' || (p_partkey % 400) END AS common_name, p_type AS family FROM part),
n AS (SELECT file_id, common_name, count(*) AS k, max((family IN ('PROMO'))::INT) AS d FROM c GROUP BY 1, 2),
b AS (SELECT file_id, family, count(*) AS n_bins FROM c GROUP BY 1, 2), w AS (SELECT file_id, count(*) FILTER (n_bins <> 7) AS x FROM b WHERE family IN ('LARGE', 'SMALL') GROUP BY 1),
g AS (SELECT file_id, count(*) FILTER (k > 1) AS a, count(*) FILTER (NOT regexp_matches(common_name, '^[a-z][a-z0-9_]*$')) AS v, count(*) FILTER (d = 1) AS dd FROM n GROUP BY 1)
SELECT file_id, u.check_name, u.n_bad = 0 AS ok, u.n_bad FROM (SELECT g.file_id, unnest([{'check_name': 'names_unique', 'n_bad': a}, {'check_name': 'names_valid', 'n_bad': v}, {'check_name': 'discarded_absent', 'n_bad': dd},
  {'check_name': 'bins_expected', 'n_bad': coalesce(x, 0)}]) AS u FROM g LEFT JOIN w USING (file_id))
""")
def acceptance(spark, sf):
    p = table(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 97 == 0, "1bad name").otherwise(F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_"), (F.col("p_partkey") % 400).cast("string")))
    cols = p.select(F.col("p_size").alias("file_id"), name.alias("common_name"), F.col("p_type").alias("family"))
    bins = cols.groupBy("file_id", "family").agg(F.count(F.lit(1)).alias("n_bins"))
    expected = p.sparkSession.createDataFrame([("LARGE", 7), ("SMALL", 7)], "family string, expected_bins long")
    return ql.acceptance_checks(cols, ["file_id"], expected, bins, discarded=["PROMO"])


@query("Q17_axis_and_zero_rate", """
WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
a AS (SELECT vec_id, label, k, v, lag(abs(v) + k / 4.0) OVER (PARTITION BY vec_id ORDER BY k) AS p FROM e)
SELECT vec_id, coalesce(bool_and(abs(v) + k / 4.0 > p), TRUE) AS increasing FROM a GROUP BY 1
""")
def axis_check(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    e = e.withColumns({"k": F.col("i") + 1, "f": F.abs("v") + (F.col("i") + 1) / 4.0})
    return ql.axis_increasing(e, ["vec_id"], "k", "f")


@query("Q17_zero_rates", """
WITH z AS (SELECT l_suppkey AS patient_id, avg((l_discount = 0)::INT) AS discount, avg((l_tax = 0)::INT) AS tax, avg((l_linenumber > 1)::INT) AS late FROM lineitem GROUP BY 1)
SELECT patient_id, "column", round(zero_rate+1e-9,6) AS zero_rate, zero_rate < 0.8 AS ok FROM (UNPIVOT z ON discount, tax, late INTO NAME "column" VALUE zero_rate)
""")
def zero_rates(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("patient_id"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
                                             (F.col("l_linenumber") <= 1).cast("double").alias("late"))
    return ql.zero_rates(df, KEY, ["discount", "tax", "late"], 0.8).withColumn("zero_rate", R(F.col("zero_rate")))


@query("Q18_single_template", """
WITH f AS (SELECT DISTINCT source AS cohort, sha256(lang || CASE WHEN doc_id % 7 < 6 THEN '' ELSE source END) AS fp FROM documents)
SELECT cohort, count(*) AS n_templates, count(*) = 1 AS ok FROM f GROUP BY 1
""")
def single_template(spark, sf):
    d = table(spark, sf, "documents")
    fp = F.sha2(F.concat("lang", F.when(F.col("doc_id") % 7 < 6, "").otherwise(F.col("source"))), 256)
    return ql.single_template(d.select(F.col("source").alias("cohort"), fp.alias("fp")), ["cohort"], "fp")


# ---- features ------------------------------------------------------------------

SID = ["l_orderkey", "l_linenumber", "l_partkey", "patient_id"]


@query("F1_bilateral_mean", f"WITH {SG} SELECT l_orderkey, l_linenumber, l_partkey, patient_id, coalesce((dl + dr) / 2.0, dl, dr) AS any_side, (dl + dr) / 2.0 AS both_sides FROM sg")
def bilateral(spark, sf):
    l, r = "fft_delta_left_anterior", "fft_delta_right_anterior"
    return signals(spark, sf).select(*SID, ft.bilateral_mean(l, r).alias("any_side"), ft.bilateral_mean(l, r, True).alias("both_sides"))


@query("F2_sides_contributing", f"WITH {SG} SELECT l_orderkey, l_linenumber, l_partkey, patient_id, (dl IS NOT NULL)::INT + (dr IS NOT NULL)::INT AS sides FROM sg")
def sides(spark, sf):
    return signals(spark, sf).select(*SID, ft.sides_contributing("fft_delta_left_anterior", "fft_delta_right_anterior").alias("sides"))


@query("F3_regional_features", f"""
WITH {SG} SELECT l_orderkey, l_linenumber, l_partkey, patient_id, coalesce((dl + dr) / 2.0, dl, dr) AS fft_delta_anterior, (dl IS NOT NULL)::INT + (dr IS NOT NULL)::INT AS fft_delta_anterior_sides_contributing,
  (thl + thr) / 2.0 AS fft_theta_anterior, price AS fft_alpha_anterior FROM sg
""")
def regional(spark, sf):
    df = signals(spark, sf).withColumn("fft_alpha_anterior", F.col("price"))
    out = ft.regional_features(df, ["delta", "theta", "alpha"])
    return out.select(*SID, "fft_delta_anterior", "fft_delta_anterior_sides_contributing", "fft_theta_anterior", "fft_alpha_anterior")


def with_regions(spark, sf):
    return ft.regional_features(signals(spark, sf), ["delta", "theta", "alpha", "beta"])


RG = SG + """, rg AS (SELECT *, coalesce((dl + dr) / 2.0, dl, dr) AS d, (thl + thr) / 2.0 AS th, (al + ar) / 2.0 AS a, (bl + br) / 2.0 AS b FROM sg),
tp AS (SELECT *, d + th + a + b AS tot FROM rg)"""


@query("F4_total_power", f"WITH {RG} SELECT l_orderkey, l_linenumber, l_partkey, patient_id, round(tot+1e-9,6) AS total FROM tp")
def total(spark, sf):
    df = with_regions(spark, sf)
    return df.select(*SID, R(ft.total_power(*[f"fft_{b}_anterior" for b in ("delta", "theta", "alpha", "beta")])).alias("total"))


@query("F5_ratios", f"""
WITH {RG} SELECT l_orderkey, l_linenumber, l_partkey, patient_id, round(CASE WHEN tot <> 0 THEN d / tot END+1e-9,6) AS rel, round(CASE WHEN thl <> 0 THEN thr / thl END+1e-9,6) AS ratio FROM tp
""")
def ratios(spark, sf):
    df = with_regions(spark, sf)
    tot = ft.total_power(*[f"fft_{b}_anterior" for b in ("delta", "theta", "alpha", "beta")])
    return df.select(*SID, R(ft.relative_power("fft_delta_anterior", tot)).alias("rel"),
                     R(ft.band_ratio("fft_theta_right_anterior", "fft_theta_left_anterior")).alias("ratio"))


@query("F6_log_ratio", f"""
WITH {SG} SELECT l_orderkey, l_linenumber, l_partkey, patient_id, round(CASE WHEN dl IS NOT NULL THEN log10(greatest(thr, 1e-6) / greatest(dl, 1e-6)) END+1e-9,6) AS lr FROM sg
""")
def log_ratio(spark, sf):
    return signals(spark, sf).select(*SID, R(ft.log_band_ratio("fft_theta_right_anterior", "fft_delta_left_anterior")).alias("lr"))


@query("F7_derived_features", f"""
WITH {RG} SELECT l_orderkey, l_linenumber, l_partkey, patient_id, round(tot+1e-9,6) AS total_power_anterior, round(CASE WHEN tot <> 0 THEN d / tot END+1e-9,6) AS rel_delta_anterior, discount AS rel_theta_anterior,
 round(CASE WHEN tot <> 0 THEN a / tot END+1e-9,6) AS rel_alpha_anterior, round(CASE WHEN tot <> 0 THEN b / tot END+1e-9,6) AS rel_beta_anterior,
 round(CASE WHEN d <> 0 THEN th / d END+1e-9,6) AS theta_delta_ratio_anterior, round(CASE WHEN d <> 0 THEN a / d END+1e-9,6) AS alpha_delta_ratio_anterior,
 round(CASE WHEN d IS NOT NULL AND th IS NOT NULL THEN log10(greatest(th, 1e-6) / greatest(d, 1e-6)) END+1e-9,6) AS log_theta_delta_ratio_anterior,
 round(CASE WHEN d IS NOT NULL AND a IS NOT NULL THEN log10(greatest(a, 1e-6) / greatest(d, 1e-6)) END+1e-9,6) AS log_alpha_delta_ratio_anterior FROM tp
""")
def derived(spark, sf):
    df = with_regions(spark, sf).withColumn("rel_theta_anterior", F.col("discount"))
    out = ft.derived_features(df, "anterior")
    names = [c for c in out.columns if c.endswith("_anterior") and c.startswith(("total_", "rel_", "theta_", "alpha_", "log_"))]
    return out.select(*SID, *[(F.col(c) if c == "rel_theta_anterior" else R(F.col(c))).alias(c) for c in names])


IND = f"""
WITH {EP}, lv AS (SELECT *, floor(value / 50.0) AS level, floor(raw_value / 100.0) AS coarse FROM tl),
ch AS (SELECT *, lag(level) OVER w AS pl, lag(coarse) OVER w AS pc FROM lv WINDOW w AS (PARTITION BY patient_id ORDER BY row_idx)),
lc AS (SELECT *, max(CASE WHEN row_idx = 0 OR coalesce(level <> pl, FALSE) THEN row_idx END) OVER w AS a1, max(CASE WHEN row_idx = 0 OR coalesce(coarse <> pc, FALSE) THEN row_idx END) OVER w AS a2,
  max(CASE WHEN row_idx = 0 OR coalesce(level <> pl, FALSE) OR coalesce(coarse <> pc, FALSE) THEN row_idx END) OVER w AS a3 FROM ch WINDOW w AS (PARTITION BY patient_id ORDER BY row_idx))
"""


def levels(spark, sf):
    return indexed(spark, sf).withColumns({"level": F.floor(F.col("value") / 50.0), "coarse": F.floor(F.col("raw_value") / 100.0)})


@query("F8_independent_mask", IND + "SELECT event_id, (row_idx - a3) % 8 = 0 AS is_independent FROM lc")
def ind_mask(spark, sf):
    return ft.independent_mask(levels(spark, sf), KEY, ["level", "coarse"], 8).select("event_id", "is_independent")


@query("F9_keep_independent", IND + "SELECT event_id, value FROM lc WHERE (row_idx - a1) % 4 = 0")
def keep_ind(spark, sf):
    return ft.keep_independent(levels(spark, sf), KEY, ["level"], 4).select("event_id", "value")


@query("F10_engine_masks", IND + "SELECT event_id, (row_idx - a1) % 8 = 0 AS mask_power, (row_idx - a2) % 10 = 0 AS mask_amplitude, 'fft_power_cadence_adjusted' AS basis_power, 'suppression_ratio_cadence_adjusted' AS basis_amplitude FROM lc")
def engine_masks(spark, sf):
    out = ft.independent_masks(levels(spark, sf), KEY, {"mask_power": (["level"], 8), "mask_amplitude": (["coarse"], 10)})
    basis = lambda f: F.lit(f"{f}_cadence_adjusted")
    return out.select("event_id", "mask_power", "mask_amplitude", basis("fft_power").alias("basis_power"), basis("suppression_ratio").alias("basis_amplitude"))


@query("F11_analysis_variables", """
SELECT p_partkey, p_name, p_type FROM part WHERE p_type IN ('PROMO', 'LARGE') OR starts_with(p_name, 'red ') OR starts_with(p_name, 'hot ')
""")
def analysis_variables(spark, sf):
    return ft.select_analysis_variables(table(spark, sf, "part"), ["PROMO", "LARGE"], ["red ", "hot "], "p_name", "p_type").select("p_partkey", "p_name", "p_type")


@query("F12_spike_flags", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity / 20.0 END AS l, l_tax * 30 AS r, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_discount * 20 END AS g FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN (l >= 1.5 AND r < 1.5)::INT END AS left_only, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN (r >= 1.5 AND l < 1.5)::INT END AS right_only,
  CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN (l >= 1.5 AND r >= 1.5)::INT END AS bilateral, CASE WHEN g IS NOT NULL THEN (g >= 1.5)::INT END AS generalized FROM s
""")
def spikes(spark, sf):
    n = F.col("l_linenumber")
    flags = ft.spike_flags(F.when(n != 2, F.col("l_quantity") / 20.0), F.col("l_tax") * 30, F.when(n != 4, F.col("l_discount") * 20))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(k) for k, c in flags.items()])


@query("F13_identity_checks", f"""
WITH {SG} SELECT patient_id, round(avg((thl <= thr AND thr <= br)::INT)+1e-9,6) AS ordered_share, round(avg(((flag = 'A')::INT + (flag = 'R')::INT + (flag = 'N')::INT = 1)::INT)+1e-9,6) AS one_hot_share,
  round(avg((abs(discount + (1 - discount) - 1.0) < 1e-6)::INT)+1e-9,6) AS unit_sum_share, round(max(abs(dl - quantity))+1e-9,6) AS pair_max_diff, round(corr(dl, quantity)+1e-9,6) AS pair_corr FROM sg GROUP BY 1
""")
def identity_checks(spark, sf):
    hot = {f"is_{k}": (F.col("flag") == k).cast("int") for k in ("A", "R", "N")}
    df = signals(spark, sf).withColumns(hot | {"rest": 1 - F.col("discount")})
    out = ft.identity_checks(df, KEY, ordered=["fft_theta_left_anterior", "fft_theta_right_anterior", "fft_beta_right_anterior"], one_hot=list(hot),
                             sums_to_one=["discount", "rest"], pair=("fft_delta_left_anterior", "quantity"))
    return out.select("patient_id", *[R(F.col(c)).alias(c) for c in ("ordered_share", "one_hot_share", "unit_sum_share", "pair_max_diff", "pair_corr")])
