"""Retrieval and export-shape queries."""

from pyspark.sql import functions as F

from ..constants import FAMILY_UNITS
from ..functions.numbers import rounded
from ..operators import bins as bn
from ..operators import retrieve as rt
from ..operators import shapes as sh
from ..operators.merge import to_long
from ..operators.ordered import index_rows, join_keys
from ..operators.shapes import BIN_FIELDS, STATISTIC_FORMULAS
from ..operators.timebase import step_support
from .bindings import EDGES, EP, KEY, SG, indexed, indexed_signals, recordings, signals, table
from .catalog_bins import SUMMARY, summary
from .registry import query

R = rounded
LABELS = bn.bin_labels(EDGES)
FAMILIES = ["fft_power", "aeeg", "asymmetry", "fft_spectrogram", "electrode_quality", "rhythmicity", "status_epilepticus", "sleep", "unlisted", "coherence_spectrogram"]
FAM_SQL = "(['" + "','".join(FAMILIES) + "'])[CAST(p_partkey % 10 AS INT) + 1]"
NAME_SQL = "lower(replace(p_name, ' ', '_')) || '_' || p_partkey"


def dictionary(spark, sf):
    p = table(spark, sf, "part")
    fam = F.get(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("p_partkey") % 10).cast("int"))
    name = F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_"), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", F.col("p_size").alias("file_id"), name.alias("common_name"), fam.alias("family"), F.col("p_name").alias("label"))


# ---- retrieval -------------------------------------------------------------------

@query("R1_family_projection", f"""
WITH d AS (SELECT p_partkey, {FAM_SQL} AS family, p_name FROM part)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM d WHERE family IN ('fft_power', 'aeeg') OR starts_with(p_name, 'hot'))
""")
def family_projection(spark, sf):
    long = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return rt.select_families(long, dictionary(spark, sf), ["fft_power", "aeeg"], F.col("label").startswith("hot"), column="l_partkey", name="p_partkey")


@query("R2_name_filter", f"SELECT p_partkey, {NAME_SQL} AS common_name FROM part WHERE contains(lower({NAME_SQL}), lower('LT_1'))")
def name_filter(spark, sf):
    return rt.filter_names(dictionary(spark, sf), "LT_1").select("p_partkey", "common_name")


@query("R3_midpoint_rows", f"""
WITH {EP}, b AS (SELECT *, CASE WHEN n_rows <= 20 THEN row_idx ELSE ((row_idx + 1) * 20 - 1) // n_rows END AS bucket FROM tl),
m AS (SELECT *, (bucket * n_rows) // 20 AS s, least(((bucket + 1) * n_rows) // 20, n_rows) AS e FROM b)
SELECT patient_id, bucket, event_id, value FROM m WHERE n_rows <= 20 OR row_idx = (s + e) // 2
""")
def midpoints(spark, sf):
    return rt.midpoint_rows(indexed(spark, sf), 20).select("patient_id", "bucket", "event_id", "value")


@query("R4_bucket_peaks", f"""
WITH {EP} SELECT patient_id, CASE WHEN n_rows <= 20 THEN row_idx ELSE ((row_idx + 1) * 20 - 1) // n_rows END AS bucket, max(value) AS value, max(raw_value) AS raw_value FROM tl GROUP BY 1, 2
""")
def peaks(spark, sf):
    return rt.bucket_peaks(indexed(spark, sf), KEY, ["value", "raw_value"], 20)


@query("R5_peak_rows", f"""
WITH {EP}, b AS (SELECT *, CASE WHEN n_rows <= 25 THEN row_idx ELSE least((25 * (2 * row_idx + 1) - 1) // (2 * n_rows), 24) END AS bucket FROM tl),
k AS (SELECT *, row_number() OVER (PARTITION BY patient_id, bucket ORDER BY coalesce(value, -1) DESC, row_idx) AS k FROM b)
SELECT DISTINCT patient_id, row_idx, n_rows, value FROM k WHERE k = 1 OR row_idx = n_rows - 1
""")
def peak_rows(spark, sf):
    return rt.peak_rows(indexed(spark, sf), KEY, "value", 25)


@query("R6_stride_rows", f"""
WITH {EP}, t AS (SELECT DISTINCT patient_id, n_rows, CAST(unnest(CASE WHEN n_rows <= 30 THEN range(n_rows) ELSE list_transform(range(30), lambda i: (2 * i * n_rows + 30) // 60) || [n_rows - 1] END) AS BIGINT) AS row_idx FROM (SELECT DISTINCT patient_id, n_rows FROM tl))
SELECT DISTINCT tl.patient_id, tl.event_id, tl.row_idx FROM tl JOIN t USING (patient_id, row_idx)
""")
def stride(spark, sf):
    return rt.stride_rows(indexed(spark, sf), 30).select("patient_id", "event_id", "row_idx")


SPEC = """
sc AS (SELECT vec_id % 7 AS file_id, label AS i_group, unnest(range(1, 31 + CAST((label * 7 + vec_id % 7) % 20 AS INT))) AS sub_index, CASE WHEN label < 6 THEN 'fft_spectrogram' ELSE 'rhythmicity' END AS family,
  CASE WHEN label % 2 = 0 THEN 'left' ELSE 'right' END AS hemisphere, CASE WHEN label % 3 = 0 THEN 'Spectrogram Hemisphere' ELSE 'Spectrogram Anterior' END AS label FROM (SELECT DISTINCT vec_id % 7 AS vec_id, label FROM embeddings)),
sgp AS (SELECT file_id, i_group, count(*) AS width, max((contains(lower(label), 'hemisphere'))::INT) AS liked FROM sc WHERE family = 'fft_spectrogram' AND hemisphere = 'left' GROUP BY 1, 2)
"""


def spectrogram_columns(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 7).alias("file_id"), F.col("label").alias("i_group")).distinct()
    width = 30 + (F.col("i_group") * 7 + F.col("file_id")) % 20
    return e.withColumn("sub_index", F.explode(F.sequence(F.lit(1).cast("bigint"), width.cast("bigint")))).withColumns({
        "family": F.when(F.col("i_group") < 6, "fft_spectrogram").otherwise("rhythmicity"),
        "hemisphere": F.when(F.col("i_group") % 2 == 0, "left").otherwise("right"),
        "label": F.when(F.col("i_group") % 3 == 0, "Spectrogram Hemisphere").otherwise("Spectrogram Anterior")})


@query("R7_spectrogram_choice", f"""
WITH {SPEC} SELECT file_id, arg_min(i_group, struct_pack(a := -liked, b := abs(width - 40), c := i_group)) AS i_group, arg_min(width, struct_pack(a := -liked, b := abs(width - 40), c := i_group)) AS width FROM sgp GROUP BY 1
""")
def spectrogram_choice(spark, sf):
    return rt.spectrogram_instrument(spectrogram_columns(spark, sf), ["file_id"], "fft_spectrogram", "left", "hemisphere")


@query("R7_spectrogram_values", f"""
WITH {SPEC}, ch AS (SELECT file_id, arg_min(i_group, struct_pack(a := -liked, b := abs(width - 40), c := i_group)) AS i_group FROM sgp GROUP BY 1),
v AS (SELECT e.vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS bin FROM embeddings e JOIN ch ON e.vec_id % 7 = file_id AND label = i_group)
SELECT vec_id, CAST(bin AS INT) AS bin, CASE WHEN bin <= 40 THEN bin * 0.5::DOUBLE END AS freq_hz, value::DOUBLE AS value FROM v
""")
def spectrogram_values(spark, sf):
    chosen = rt.spectrogram_instrument(spectrogram_columns(spark, sf), ["file_id"], "fft_spectrogram", "left", "hemisphere")
    rows = table(spark, sf, "embeddings").withColumns({"file_id": F.col("vec_id") % 7, "i_group": F.col("label")})
    return rt.spectrogram_long(rt.chosen_spectrogram(rows, chosen, ["file_id"]), ["vec_id"], "embedding", "fft_spectrogram")


GRID_ONLY = f"WITH {EP}, g AS (SELECT patient_id, s, e FROM (SELECT DISTINCT patient_id FROM tl), (VALUES (0.0::DOUBLE, 48.0::DOUBLE), (48.0, 168.0), (168.0, 720.0)) b(s, e))"


@query("R8_bin_boundaries", GRID_ONLY + " SELECT patient_id, s AS edge FROM g UNION SELECT patient_id, e FROM g")
def boundaries(spark, sf):
    cover = bn.bin_coverage(recordings(spark, sf).withColumn("support_hours", F.lit(0.0)), KEY, EDGES)
    return rt.bin_boundaries(cover, KEY)


@query("R9_tidy_metrics", f"""
WITH {SG}, w AS (SELECT patient_id, median(quantity) AS m, avg(price) AS a, count(tax)::DOUBLE AS n, exp(avg(ln(quantity))) AS g FROM sg GROUP BY 1)
SELECT patient_id, 'quantity_median' AS metric, round(m+1e-9,6) AS value FROM w UNION ALL SELECT patient_id, 'unit_price_mean', round(a+1e-9,6) FROM w UNION ALL SELECT patient_id, 'tax_n', n FROM w UNION ALL SELECT patient_id, 'quantity_log_mean', round(g+1e-9,6) FROM w
""")
def tidy(spark, sf):
    from ..operators.orderstats import order_stats, quantile

    df = signals(spark, sf)
    med = order_stats(df, KEY, "quantity", I1_1_median=quantile(0.5))
    rest = df.groupBy("patient_id").agg(F.avg("price").alias("I2_1_mean"), F.count("tax").alias("tax_n"), F.exp(F.avg(F.ln("quantity"))).alias("I1_1_log_mean"))
    wide = join_keys(med, rest, KEY)
    out = rt.tidy_metrics(wide, KEY, ["I1_1_median", "I2_1_mean", "tax_n", "I1_1_log_mean"], {"I1_1": "quantity", "I2_1": "unit_price"})
    return out.withColumn("value", F.when(F.col("metric") == "tax_n", F.col("value")).otherwise(R(F.col("value"))))


@query("R10_patient_listing", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def listing(spark, sf):
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("study"))
    return rt.list_patients(table(spark, sf, "customer").select("c_custkey", "c_name"), m, ["c_custkey"], "1-URGENT")


@query("R11_compare_patients", SUMMARY + """,
q AS (SELECT patient_id, 100.0 * count(*) FILTER (NOT artifact_clean) / count(*) AS art, 100.0 * count(*) FILTER (seizure AND artifact_clean) / count(*) FILTER (artifact_clean) AS bur, date_diff('microsecond', min(ts), max(ts)) / 3600000000.0 AS dur FROM tl GROUP BY 1)
SELECT patient_id, 'Artifact (%)' AS metric_name, round(art+1e-9,6) AS value, NULL::VARCHAR AS bin_label FROM q UNION ALL SELECT patient_id, 'Seizure Burden (%)', round(bur+1e-9,6), NULL FROM q
UNION ALL SELECT patient_id, 'Duration (h)', round(dur+1e-9,6), NULL FROM q UNION ALL SELECT patient_id, feature || ' (median)', round(median+1e-9,6), bin_label FROM j WHERE median IS NOT NULL
""")
def compare(spark, sf):
    from ..operators.events import burden
    from ..operators.quality import qc_report

    rec = recordings(spark, sf)
    top = join_keys(qc_report(rec, KEY).select("patient_id", "artifact_pct", "duration_hours"), burden(rec, KEY, "seizure", "artifact_clean").select("patient_id", "burden_pct"), KEY)
    out = rt.compare(top, KEY, {"Artifact (%)": F.col("artifact_pct"), "Seizure Burden (%)": F.col("burden_pct"), "Duration (h)": F.col("duration_hours")}, summary(spark, sf))
    return out.withColumn("value", R(F.col("value")))


@query("R12_sorted_epochs", f"WITH {EP} SELECT patient_id, row_idx, event_id FROM tl ORDER BY patient_id, row_idx")
def sorted_epochs(spark, sf):
    return indexed(spark, sf).select("patient_id", "row_idx", "event_id").orderBy("patient_id", "row_idx")


# ---- shapes ----------------------------------------------------------------------

FEATS = ["fft_delta_value", "raw_value"]
WIDE_SQL = ", ".join(
    f"max({'n_effective' if s == 'n' else 'round(' + s + '+1e-9,6)'}) FILTER (feature = '{f}' AND bin_label = '{b}') AS \"{f}_{s}_{b}\""
    for f in FEATS for s in ("median", "mean", "n") for b in LABELS)


@query("X1_patient_wide", SUMMARY + f""", w AS (SELECT patient_id, {WIDE_SQL.replace("max(n_effective)", "max(CASE WHEN ok THEN n_effective END)")},
  {", ".join(f"round(max(clean) FILTER (bin_label = '{b}')+1e-9,6) AS " + chr(34) + f"clean_hours_{b}" + chr(34) for b in LABELS)} FROM j GROUP BY 1)
SELECT w.*, c_mktsegment AS outcome FROM w LEFT JOIN customer ON c_custkey = patient_id AND c_nationkey <> 3
""")
def patient_wide(spark, sf):
    outcome = table(spark, sf, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("outcome"))
    out = sh.patient_wide(summary(spark, sf), KEY, FEATS, LABELS, ["median", "mean", "n"], [outcome], coverage="clean_hours")
    return out.withColumns({c: R(F.col(c)) for c in out.columns if "_median_" in c or "_mean_" in c or c.startswith("clean_hours")})


@query("X2_bins_long", SUMMARY + """
SELECT j.patient_id, bin_label, feature, round(median+1e-9,6) AS median, n_effective, CASE WHEN ok THEN 'row_count' ELSE 'not_estimated' END AS effective_basis, c_mktsegment AS site
FROM j LEFT JOIN customer ON c_custkey = patient_id
""")
def bins_long(spark, sf):
    cov = table(spark, sf, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("site"))
    dic = spark.createDataFrame([("fft_delta_value", "fft_power_cadence_adjusted")], "common_name string, effective_basis string")
    out = sh.bins_long(summary(spark, sf), KEY, cov, dic)
    return out.select("patient_id", "bin_label", "feature", R(F.col("median")).alias("median"), "n_effective", "effective_basis", "site")


SEMI = ", ".join(f"max(round({c}+1e-9,6)) FILTER (feature = '{f}') AS \"{f}{s}\"" for f in FEATS for s, c in (("", "median"), ("_log", "log_mean"), ("_slope", "slope")))


@query("X3_semi_long", SUMMARY + f"""
SELECT patient_id, bin_label, {SEMI}, max(CASE WHEN ok THEN n_effective END) FILTER (feature = 'raw_value') AS raw_value_n FROM j LEFT JOIN sl USING (patient_id, feature) WHERE n_total > 0 GROUP BY 1, 2
""")
def semi_long(spark, sf):
    out = sh.semi_long(summary(spark, sf), KEY, FEATS, [])
    cols = [f"{f}{s}" for f in FEATS for s in ("", "_log", "_slope")]
    return out.select("patient_id", "bin_label", *[R(F.col(c)).alias(c) for c in cols], "raw_value_n")


@query("X4_cohort_semi_long", SUMMARY + """
SELECT patient_id, bin_label, 'recording_start' AS reference, max(round(median+1e-9,6)) FILTER (feature = 'fft_delta_value') AS delta_power, max(round(median+1e-9,6)) FILTER (feature = 'raw_value' AND patient_id % 2 = 1) AS amplitude
FROM j WHERE n_total > 0 GROUP BY 1, 2
""")
def cohort_semi(spark, sf):
    bins = summary(spark, sf)
    even = sh.semi_long(bins.where("patient_id % 2 = 0"), KEY, FEATS[:1], []).select("patient_id", "bin_label", "fft_delta_value")
    odd = sh.semi_long(bins.where("patient_id % 2 = 1"), KEY, FEATS, []).select("patient_id", "bin_label", "fft_delta_value", "raw_value")
    ref = recordings(spark, sf).select("patient_id", F.lit("recording_start").alias("reference")).distinct()
    out = sh.cohort_semi_long([even, odd], ref, KEY, {"fft_delta_value": "delta_power", "raw_value": "amplitude"})
    return out.withColumns({c: R(F.col(c)) for c in ("delta_power", "amplitude")})


GROUP_SQL = """CASE WHEN family IN ('fft_power','aeeg','status_epilepticus','sleep') THEN 'core' WHEN family = 'asymmetry' THEN 'asymmetry_spectrogram' WHEN family = 'fft_spectrogram' THEN 'fft_spectrogram'
 WHEN family = 'electrode_quality' THEN 'electrode_detail' WHEN family = 'rhythmicity' THEN 'rhythmicity' WHEN family = 'coherence_spectrogram' THEN 'coherence_spectrogram' ELSE 'core' END"""


@query("X5_group_filter", f"""
WITH d AS (SELECT p_partkey, {FAM_SQL} AS family FROM part)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN d ON p_partkey = l_partkey WHERE {GROUP_SQL} IN ('core', 'rhythmicity')
""")
def group_filter(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    d = dictionary(spark, sf).withColumn("common_name", F.col("p_partkey").cast("string"))
    return sh.filter_groups(li.withColumn("k", F.col("l_partkey").cast("string")), d, ["rhythmicity"], "k").drop("k")


@query("X6_rename", "SELECT l_suppkey AS patient_id, max(l_quantity) AS delta_left_max, min(l_tax) AS \"theta_min\", count(*) AS n_rows FROM lineitem GROUP BY 1")
def rename(spark, sf):
    df = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("patient_id")).agg(
        F.max("l_quantity").alias("I1_1_max"), F.min("l_tax").alias("I1_min"), F.count(F.lit(1)).alias("n_rows"))
    return sh.rename_features(df, {"I1_1": "delta_left", "I1": "theta"})


@query("X7_data_dictionary", f"""
WITH d AS (SELECT p_partkey, {NAME_SQL} || CASE WHEN p_partkey % 4 = 2 THEN '_percent' ELSE '' END AS common_name, {FAM_SQL} AS family FROM part)
SELECT p_partkey, family, CASE WHEN family = 'status_epilepticus' AND p_partkey % 4 = 2 THEN '% (0–100)' WHEN family = 'sleep' THEN 'binary (0/1) — one-hot flag for this stage'
  {" ".join(f"WHEN family = '{f}' THEN '" + u.replace("'", "''") + "'" for f, u in FAMILY_UNITS.items())} ELSE '' END AS unit, {GROUP_SQL} AS export_group,
  CAST(CASE WHEN family IN ('fft_power','asymmetry','fft_spectrogram') THEN 8 WHEN family = 'rhythmicity' THEN 2 ELSE 1 END AS INT) AS cadence_rows,
  CASE WHEN family IN ('fft_power','asymmetry','fft_spectrogram') THEN 4.0 WHEN family = 'rhythmicity' THEN 3.0 WHEN family = 'electrode_quality' THEN 1.2 ELSE 1.0 END::DOUBLE AS window_seconds FROM d
""")
def data_dictionary(spark, sf):
    d = dictionary(spark, sf).withColumn("common_name", F.concat("common_name", F.when(F.col("p_partkey") % 4 == 2, "_percent").otherwise("")))
    return sh.data_dictionary(d).select("p_partkey", "family", "unit", "export_group", "cadence_rows", "window_seconds")


_DERIVED_SQL = """
WITH r AS (SELECT unnest(['anterior', 'posterior']) AS region), b AS (SELECT unnest(['delta', 'theta', 'alpha', 'beta']) AS band)
SELECT 'fft_' || band || '_' || region AS variable_name, 'fft_power' AS family, 'fft_' || band || '_left_' || region || '+fft_' || band || '_right_' || region AS made_of FROM r, b
UNION ALL SELECT 'fft_' || band || '_' || region || '_sides_contributing', 'fft_power', 'fft_' || band || '_left_' || region || '+fft_' || band || '_right_' || region FROM r, b
UNION ALL SELECT 'total_power_' || region, 'fft_power', 'fft_delta_' || region || '+fft_theta_' || region || '+fft_alpha_' || region || '+fft_beta_' || region FROM r
UNION ALL SELECT 'rel_' || band || '_' || region, 'fft_power_ratio', 'fft_' || band || '_' || region || '+total_power_' || region FROM r, b
UNION ALL SELECT p || band || '_delta_ratio_' || region, 'fft_power_ratio', 'fft_' || band || '_' || region || '+fft_delta_' || region FROM r, b, (SELECT unnest(['', 'log_']) AS p) WHERE band IN ('theta', 'alpha')
"""


@query("X7_full_dictionary", f"""
WITH own AS (SELECT CASE WHEN p_partkey % 9 = 1 THEN 'fft_delta_anterior' ELSE {NAME_SQL} || p_partkey END AS variable_name, {FAM_SQL} AS family FROM part),
made AS ({_DERIVED_SQL}),
stat AS (SELECT unnest({list(STATISTIC_FORMULAS)}) AS variable_name, 'statistic' AS family UNION ALL SELECT unnest({list(BIN_FIELDS)}), 'time_binning')
SELECT variable_name, family, '' AS made_of, count(*) AS n FROM own GROUP BY 1, 2 UNION ALL SELECT variable_name, family, made_of, 1 FROM made WHERE variable_name NOT IN (SELECT variable_name FROM own)
UNION ALL SELECT variable_name, family, '', 1 FROM stat
""")
def full_dictionary(spark, sf):
    k = F.col("p_partkey")
    d = dictionary(spark, sf).withColumn("common_name", F.when(k % 9 == 1, "fft_delta_anterior").otherwise(F.concat("common_name", k.cast("string"))))
    out = sh.full_dictionary(d)
    derived = F.col("formula") != "as exported"
    of = F.when(derived & ~F.col("family").isin("statistic", "time_binning"), F.array_join("source_columns", "+")).otherwise("")
    return out.groupBy("variable_name", "family", of.alias("made_of")).agg(F.count(F.lit(1)).alias("n"))


@query("X8_column_mapping", f"SELECT p_size AS file_id, {NAME_SQL} AS common_name, p_name AS label, {FAM_SQL} AS family FROM part")
def mapping(spark, sf):
    return sh.column_mapping(dictionary(spark, sf))


@query("X9_panel_variables", f"""
WITH d AS (SELECT lower(replace(p_name, ' ', '_')) || (['_spectrogram', '_x', '_spectrogram_rate', ''])[CAST(p_partkey // 10 % 4 AS INT) + 1] ||
    (['_4_50.5hz', '_avg2m', '_f3c3p3', '', '_4_0.5-1hz', '_avg', ''])[CAST(p_partkey % 7 AS INT) + 1] AS common_name, {FAM_SQL} AS family,
    (['anterior', 'posterior', ''])[CAST(p_partkey % 3 AS INT) + 1] AS region, CASE WHEN p_partkey % 20 < 10 THEN 'left' ELSE 'right' END AS hemisphere FROM part),
p AS (SELECT * FROM (VALUES ('power', 'fft_power', 'anterior', NULL, NULL, NULL, FALSE), ('spectra', 'fft_spectrogram', NULL, NULL, NULL, NULL, TRUE), ('spectra_left', 'fft_spectrogram', NULL, 'left', NULL, NULL, TRUE),
  ('amplitude', 'aeeg', NULL, NULL, 'a', 'rate', NULL)) v(panel_id, pf, pr, ph, pc, px, sp))
SELECT DISTINCT panel_id, CASE WHEN sp THEN regexp_replace(common_name, '(?i)_[0-9.]+(-[0-9.]+)?hz$', '') ELSE common_name END AS variable
FROM d JOIN p ON family = pf AND (pr IS NULL OR region = pr) AND (ph IS NULL OR hemisphere = ph) AND (pc IS NULL OR contains(common_name, pc)) AND (px IS NULL OR NOT contains(common_name, px))
  AND (sp IS NULL OR contains(common_name, 'spectrogram') = sp) AND NOT (coalesce(sp, FALSE) AND ph IS NOT NULL AND region <> '')
WHERE NOT regexp_matches(common_name, '_avg_|_avg$|_avg[0-9]') AND NOT regexp_matches(common_name, '[a-z]{{1,3}}[0-9]{{1,2}}[a-z]{{1,3}}[0-9]{{1,2}}')
""")
def panels(spark, sf):
    k = F.col("p_partkey")
    one_of = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    d = dictionary(spark, sf).withColumns({
        "common_name": F.concat(F.lower(F.replace("label", F.lit(" "), F.lit("_"))), one_of(["_spectrogram", "_x", "_spectrogram_rate", ""], F.floor(k / 10) % 4),
                                one_of(["_4_50.5hz", "_avg2m", "_f3c3p3", "", "_4_0.5-1hz", "_avg", ""], k % 7)),
        "region": one_of(["anterior", "posterior", ""], k % 3), "hemisphere": F.when(k % 20 < 10, "left").otherwise("right")})
    rows = [("power", "fft_power", "anterior", None, None, None, False), ("spectra", "fft_spectrogram", None, None, None, None, True),
            ("spectra_left", "fft_spectrogram", None, "left", None, None, True), ("amplitude", "aeeg", None, None, "a", ["rate"], None)]
    p = spark.createDataFrame(rows, "panel_id string, family string, region string, hemisphere string, contains string, excludes array<string>, spectrogram boolean")
    return sh.panel_variables(d, p)


@query("X10_provenance", """
SELECT o_orderkey, '{"source":{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"},"alignment":{"reference":"event"}}' AS record FROM orders
""")
def provenance(spark, sf):
    o = table(spark, sf, "orders").withColumn("reference", F.lit("event"))
    return sh.provenance(o, ["o_orderkey"], {"source": ["o_custkey", "o_orderstatus"], "alignment": ["reference"]})


@query("X10_run_record", """
WITH f AS (SELECT o_custkey AS patient_id, min(o_orderdate) AS start_ts, count(*) AS parsed, count(*) FILTER (o_orderstatus = 'F') AS usable,
    list_sort(list({'file': 'seg_' || o_orderkey, 'h': sha256('seg_' || o_orderkey)})) AS files, count(*) FILTER (o_orderkey % 5 = 0) AS n_corrected FROM orders GROUP BY 1),
e AS (SELECT f.*, c_nationkey, CASE WHEN patient_id % 4 <> 0 THEN start_ts - to_hours(CAST(patient_id % 40 AS INT) - 5) END AS ev FROM f JOIN customer ON c_custkey = patient_id),
g AS (SELECT *, date_diff('microsecond', ev, start_ts) / 3600000000.0 AS h FROM e)
SELECT patient_id, parsed, usable, CASE WHEN coalesce(h <= 22, FALSE) THEN 'event' ELSE 'recording_start' END AS time_reference, coalesce(h <= 22, FALSE) AS is_aligned, coalesce(h < 0, FALSE) AS has_pre_event_data,
  CASE WHEN h < 0 THEN -h ELSE 0.0 END::DOUBLE AS pre_event_hours, strftime(CASE WHEN coalesce(h <= 22, FALSE) THEN ev ELSE start_ts END, '%Y-%m-%dT%H:%M:%S') AS reference_time, len(files) AS n_files, files[1].file AS first_file, files[1].h AS first_sha,
  c_nationkey::VARCHAR AS site, n_corrected FROM g
""")
def run_record(spark, sf):
    from ..operators.timebase import alignment_guard

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id"), "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    segment = F.concat(F.lit("seg_"), F.col("o_orderkey").cast("string"))
    runs = o.groupBy("patient_id").agg(F.min("ts").alias("start_ts"), F.count(F.lit(1)).alias("parsed"), F.count_if(F.col("o_orderstatus") == "F").alias("usable"))
    runs = runs.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").cast("string").alias("site")), "patient_id")
    pid = F.col("patient_id")
    shift = F.make_dt_interval(F.lit(0), (pid % 40 - 5).cast("int"))
    runs = alignment_guard(runs.withColumn("event_ts", F.when(pid % 4 != 0, F.col("start_ts") - shift)), "event_ts", "start_ts")
    runs = runs.withColumns({"reference": F.when(F.col("is_aligned"), "event").otherwise("recording_start"), "reference_ts": F.when(F.col("is_aligned"), F.col("event_ts")).otherwise(F.col("start_ts"))})
    files = o.select("patient_id", segment.alias("file"), F.sha2(segment, 256).alias("sha256"))
    applied = o.where("o_orderkey % 5 = 0").select("patient_id", segment.alias("segment"), (pid % 100).alias("age_days"))
    rec = sh.run_record(runs, ["patient_id"], files, versions={"pipeline": "1", "columns": "8"}, config="{}", stages=["parsed", "usable"], clinical=["site"], corrections=applied)
    schema = ("versions struct<pipeline: string>, hash_strategy string, source_files array<struct<file: string, sha256: string>>, stage_row_counts struct<parsed: long, usable: long>, clinical_metadata struct<site: string>, "
              "timing_corrections array<struct<segment: string, age_days: long>>, alignment struct<time_reference: string, reference_time: string, is_aligned: boolean, has_pre_event_data: boolean, pre_event_hours: double>")
    r = rec.select("patient_id", F.from_json("record", schema).alias("r"))
    a, first = F.col("r.alignment"), F.get("r.source_files", F.lit(0))
    return r.select("patient_id", "r.stage_row_counts.parsed", "r.stage_row_counts.usable", a["time_reference"].alias("time_reference"), a["is_aligned"].alias("is_aligned"),
                    a["has_pre_event_data"].alias("has_pre_event_data"), a["pre_event_hours"].alias("pre_event_hours"), a["reference_time"].alias("reference_time"),
                    F.size("r.source_files").cast("long").alias("n_files"), first["file"].alias("first_file"), first["sha256"].alias("first_sha"), F.col("r.clinical_metadata.site").alias("site"),
                    F.size("r.timing_corrections").cast("long").alias("n_corrected"))


@query("X11_codebook_hash", f"""
WITH d AS (SELECT p_size AS file_id, sha256({NAME_SQL} || '|' || {FAM_SQL}) AS h FROM part)
SELECT file_id, sha256(concat_ws('|', count(*), sum(('0x' || substr(h, 1, 8))::BIGINT), sum(('0x' || substr(h, 9, 8))::BIGINT), sum(('0x' || substr(h, 17, 8))::BIGINT), sum(('0x' || substr(h, 25, 8))::BIGINT))) AS codebook_hash FROM d GROUP BY 1
""")
def codebook(spark, sf):
    return sh.codebook_hash(dictionary(spark, sf), ["file_id"], ["common_name", "family"])
