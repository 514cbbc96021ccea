"""Profiling and reconciliation queries."""

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import profile as pf
from ..operators.bincounts import aggregate_timeline
from ..operators.features import independent_mask
from ..operators.merge import to_long
from ..operators.ordered import join_keys
from ..operators.recompute import audit as audit_bins
from ..operators.recompute import recomputed_bins
from ..operators.stored_timeline import REC, with_support
from .bindings import EDGES, EP, KEY, SG, epochs, recordings, signals, stored_recordings, table
from .catalog_bins import FULL
from .catalog_retrieve import FAM_SQL, dictionary
from .registry import query

R = rounded


@query("P1_column_profile", f"""
WITH {EP} SELECT patient_id, channel, count(*) AS n, count(*) - count(value) AS n_null, round(100.0 * (count(*) - count(value)) / count(*)+1e-9,6) AS pct_null, min(value) AS min, round(quantile_cont(value, 0.01)+1e-9,6) AS p01,
  round(median(value)+1e-9,6) AS median, round(quantile_cont(value, 0.99)+1e-9,6) AS p99, max(value) AS max, count(DISTINCT value) AS n_distinct, coalesce(bool_and(value IN (0.0, 1.0)), FALSE) AS is_binary FROM ep GROUP BY 1, 2
""")
def column_profile(spark, sf):
    out = pf.column_profile(epochs(spark, sf), ["patient_id", "channel"])
    return out.withColumns({c: R(F.col(c)) for c in ("pct_null", "p01", "median", "p99")})


@query("P2_review_flags", f"""
WITH d AS (SELECT p_size AS file_id, p_partkey, CASE WHEN p_partkey % 50 = 0 THEN '9 ' || p_name ELSE replace(p_name, ' ', '_') END AS name, CASE WHEN p_partkey % 10 = 8 THEN 'other' ELSE {FAM_SQL} END AS family FROM part),
k AS (SELECT *, count(*) OVER (PARTITION BY file_id, name) AS k FROM d)
SELECT p_partkey, coalesce(nullif(concat_ws(';', CASE WHEN family = 'other' THEN 'UNCLASSIFIED' END, CASE WHEN k > 1 THEN 'COLLISION(x' || k || ')' END, CASE WHEN NOT regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') THEN 'INVALID_IDENTIFIER' END), ''), 'OK') AS review_flag FROM k
""")
def review_flags(spark, sf):
    k = F.col("p_partkey")
    d = dictionary(spark, sf).withColumns({
        "common_name": F.when(k % 50 == 0, F.concat(F.lit("9 "), F.col("label"))).otherwise(F.replace("label", F.lit(" "), F.lit("_"))),
        "family": F.when(k % 10 == 8, "other").otherwise(F.col("family"))})
    return pf.review_flags(d, ["file_id"]).select("p_partkey", "review_flag")


@query("P3_spectrogram_profile", """
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v0, generate_subscripts(embedding, 1) AS k FROM embeddings), v AS (SELECT label, k, CASE WHEN abs(v0) < 0.01 THEN NULL ELSE v0 END AS v FROM x),
m AS (SELECT label, k, median(v) AS med FROM v GROUP BY 1, 2), p AS (SELECT label, arg_max(k, struct_pack(a := med, b := -k)) AS peak FROM m GROUP BY 1)
SELECT label, count(DISTINCT k) AS width, min(v) AS global_min, max(v) AS global_max, round(100.0 * count(*) FILTER (v IS NULL) / count(*)+1e-9,6) AS pct_null, CAST(any_value(peak) AS INT) AS peak_bin, count(DISTINCT k) = 63 AS width_ok,
 round(CASE WHEN any_value(peak) <= 63 THEN (any_value(peak) - 1) * (32.0 / 62.0) END+1e-9,6) AS peak_hz FROM v JOIN p USING (label) GROUP BY 1
""")
def spectrogram_profile(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("bins", F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) >= 0.01, x.cast("double"))))
    out = pf.spectrogram_profile(e, ["label"], "bins", "coherence_spectrogram", 63)
    return out.withColumns({c: R(F.col(c)) for c in ("pct_null", "peak_hz")})


SPEAR_PAIRS = [(a, b) for a in ("al", "ar") for b in ("quantity", "price", "discount", "tax")]
SPEAR = f"""
WITH {SG}, w AS (SELECT CASE WHEN quantity % 10 <> 0 THEN quantity END AS quantity, price, discount, CASE WHEN tax <> 0 THEN tax END AS tax, al, ar FROM sg),
p AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM w WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in SPEAR_PAIRS)}),
r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS y FROM p),
c AS (SELECT struct_pack(a := CASE a WHEN 'al' THEN 'fft_alpha_left_anterior' ELSE 'fft_alpha_right_anterior' END, b := b, r := corr(x, y)) AS s FROM r GROUP BY a, b)
"""


def spearman_pairs(spark, sf):
    df = signals(spark, sf).withColumns({"quantity": F.when(F.col("quantity") % 10 != 0, F.col("quantity")), "tax": F.when(F.col("tax") != 0, F.col("tax"))})
    return pf.spearman(df, ["fft_alpha_left_anterior", "fft_alpha_right_anterior"], ["quantity", "price", "discount", "tax"])


@query("P4_rank_correlation", SPEAR + "SELECT s.a AS a, s.b AS b, round(s.r+1e-9,6) AS r FROM c")
def rank_correlation(spark, sf):
    return spearman_pairs(spark, sf).withColumn("r", R(F.col("r")))


@query("P4_top_partners", SPEAR + """, k AS (SELECT s.a AS a, s.b AS b, s.r AS r, row_number() OVER (PARTITION BY s.a ORDER BY s.r DESC, s.b) AS k FROM c)
SELECT a, max(b) FILTER (k = 1) AS first, max(b) FILTER (k = 2) AS second, round(max(r) FILTER (k = 1)+1e-9,6) AS r_first, round(max(r) FILTER (k = 2)+1e-9,6) AS r_second, round(max(r) FILTER (k = 2) - max(r) FILTER (k = 3)+1e-9,6) AS separation FROM k GROUP BY 1
""")
def top_partners(spark, sf):
    out = pf.top_partners(spearman_pairs(spark, sf))
    return out.withColumns({c: R(F.col(c)) for c in ("r_first", "r_second", "separation")})


COVER = f"""
WITH {EP}, w AS (SELECT patient_id, channel, CASE WHEN hrs >= 0 AND hrs < 240 THEN 'early' WHEN hrs >= 480 AND hrs < 700 THEN 'late' END AS span, CASE WHEN channel = 'view' AND hrs > 400 THEN NULL WHEN channel = 'signup' AND hrs > 400 THEN value * 4 ELSE value END AS v FROM tl),
g AS (SELECT patient_id, channel, span, count(*) AS n, count(*) - count(v) AS n_null, avg(v) AS mean, min(v) AS min, max(v) AS max, (count(*) - count(v)) / count(*) AS null_share FROM w WHERE span IS NOT NULL GROUP BY 1, 2, 3)
"""
WINDOWS = {"early": (0.0, 240.0), "late": (480.0, 700.0)}


def coverage(spark, sf):
    late = F.col("hours") > 400
    v = F.when((F.col("channel") == "view") & late, None).when((F.col("channel") == "signup") & late, F.col("value") * 4).otherwise(F.col("value"))
    return pf.window_coverage(recordings(spark, sf).withColumn("value", v), ["patient_id", "channel"], WINDOWS)


@query("P5_window_coverage", COVER + "SELECT patient_id, channel, span, n, n_null, round(mean+1e-9,6) AS mean, min, max, round(null_share+1e-9,6) AS null_share FROM g")
def window_coverage(spark, sf):
    return coverage(spark, sf).withColumns({c: R(F.col(c)) for c in ("mean", "null_share")})


@query("P5_coverage_changes", COVER + """, p AS (SELECT patient_id, channel, max(null_share) FILTER (span = 'early') AS e, max(null_share) FILTER (span = 'late') AS l, max(mean) FILTER (span = 'early') AS em, max(mean) FILTER (span = 'late') AS lm FROM g GROUP BY 1, 2)
SELECT patient_id, channel, coalesce(e < 0.5 AND coalesce(l >= 0.5, TRUE), FALSE) AS lost, coalesce(l < 0.5 AND coalesce(e >= 0.5, TRUE), FALSE) AS gained, coalesce(e < 0.05 AND l > 0.8, FALSE) AS flipped,
  coalesce(CASE WHEN abs(em) > 1e-9 THEN lm / em > 2.0 OR lm / em < 0.5 END, FALSE) AS shifted FROM p
""")
def coverage_changes(spark, sf):
    return pf.coverage_changes(coverage(spark, sf), ["patient_id", "channel"], "early", "late")


@query("P6_populated_bins", """
WITH v AS (SELECT label, CASE WHEN vec_id < 200 THEN 'early' WHEN vec_id >= 300 THEN 'late' END AS span, len(list_filter(embedding, lambda x: abs(x::DOUBLE) >= 0.02)) AS k, len(embedding) AS w FROM embeddings)
SELECT label, span, count(*) AS n_rows, round(avg(k)+1e-9,6) AS mean_populated, round(1.0 - sum(k) / sum(w)+1e-9,6) AS null_share FROM v WHERE span IS NOT NULL GROUP BY 1, 2
""")
def populated(spark, sf):
    e = table(spark, sf, "embeddings").withColumns({
        "bins": F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) >= 0.02, x)), "hours": F.col("vec_id").cast("double")})
    out = pf.populated_bins(e, ["label"], "bins", {"early": (0, 200), "late": (300, 1e12)})
    return out.withColumns({c: R(F.col(c)) for c in ("mean_populated", "null_share")})


@query("P7_recompute_audit", f"""
WITH {EP}, s AS (SELECT patient_id, channel, avg(value) AS mean, max(value) AS top, count(value)::DOUBLE AS n FROM tl GROUP BY 1, 2),
l AS (SELECT patient_id, channel, unnest([struct_pack(metric := 'mean', v := mean), struct_pack(metric := 'max', v := top), struct_pack(metric := 'n', v := n)]) AS u FROM s)
SELECT patient_id, channel, u.metric AS metric, CASE WHEN patient_id % 11 = 4 THEN 'not_checked' WHEN (u.metric = 'mean' AND patient_id % 7 = 2) OR (u.metric = 'n' AND patient_id % 5 = 1) THEN 'mismatch' ELSE 'match' END AS status FROM l WHERE u.v IS NOT NULL
""")
def audit(spark, sf):
    rec = recordings(spark, sf)
    stats = rec.groupBy("patient_id", "channel").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.count("value").cast("double").alias("n"))
    again = to_long(stats, ["patient_id", "channel"], ["mean", "max", "n"], "metric")
    pid = F.col("patient_id")
    drift = F.when((F.col("metric") == "mean") & (pid % 7 == 2), F.col("value") + 0.01).when((F.col("metric") == "n") & (pid % 5 == 1), F.col("value") + 1).otherwise(F.col("value"))
    exported = again.withColumn("value", drift)
    out = pf.recompute_audit(exported, again.where(pid % 11 != 4), ["patient_id", "channel"], {"n": "count", "mean": "numeric", "max": "numeric"})
    return out.select("patient_id", "channel", "metric", "status")


@query("P8_zero_and_null_counts", f"""
WITH {SG} SELECT patient_id, count(*) FILTER (thl = 0) AS impossible_zeros, count(*) FILTER (thl IS NULL) AS impossible_nulls, count(*) FILTER (tax = 0) AS legitimate_zeros, count(*) FILTER (tax IS NULL) AS legitimate_nulls,
  count(*) FILTER (dl = 0) AS never_null_zeros, count(*) FILTER (dl IS NULL) AS never_null_nulls FROM sg GROUP BY 1
""")
def zero_null(spark, sf):
    return pf.zero_and_null_counts(signals(spark, sf), KEY, {"impossible": "fft_theta_left_anterior", "legitimate": "tax", "never_null": "fft_delta_left_anterior"})


# Drift planted in the exported summary: metric i of recordings with patient_id % 23 = i is off, some bins are missing on one side.
AUDITED = ["n", "mean", "sd", "min", "max", "p05", "p10", "p25", "median", "p75", "p90", "p95", "iqr", "trimmed_mean_20pct", "cv", "log_mean", "log_sd", "n_total_epochs", "observed_hours", "clean_hours",
           "clean_of_expected", "clean_of_observed", "slope"]
_OF = {"n": "n", "n_total_epochs": "n_total", "observed_hours": "obs", "clean_hours": "clean", "clean_of_expected": "clean / (bin_end - bin_start)",
       "clean_of_observed": "CASE WHEN obs > 0 THEN clean / obs ELSE 0.0 END"}
_FIELDS = ["n_total_epochs", "observed_hours", "clean_hours", "clean_of_expected", "clean_of_observed"]


@query("P7_recomputed_bins", FULL + f""",
m AS (SELECT patient_id, bin_label, feature, unnest({[m for m in AUDITED if m not in (*_FIELDS, 'slope')]}) AS metric,
        unnest([{", ".join(f"CASE WHEN ok THEN {_OF.get(m, m)} END::DOUBLE" for m in AUDITED if m not in (*_FIELDS, 'slope'))}]) AS v FROM j WHERE ok AND n > 0
      UNION ALL SELECT DISTINCT patient_id, bin_label, '', unnest({_FIELDS}), unnest([{", ".join(f"({_OF[m]})::DOUBLE" for m in _FIELDS)}]) FROM cv WHERE n_total > 0
      UNION ALL SELECT patient_id, 'all', feature, 'slope', slope FROM sl)
SELECT patient_id, bin_label, feature, metric, CASE WHEN patient_id % 31 = 3 AND bin_label = '48-168h' THEN 'only_recomputed' WHEN patient_id % 37 = 5 AND bin_label = '0-48h' THEN 'only_exported'
  WHEN patient_id % 23 = list_position({AUDITED}, metric) - 1 THEN 'mismatch' ELSE 'match' END AS status FROM m WHERE v IS NOT NULL
""")
def recomputed(spark, sf):
    tl = stored_recordings(spark, sf)
    rows = with_support(tl).withColumns({"fft_delta_value": F.col("value"), "level": F.floor(F.col("value") / 50.0)})
    rows = independent_mask(rows, [REC], ["level"], 8, "m_power")
    names, masks = ["fft_delta_value", "raw_value"], {"fft_delta_value": "m_power"}
    summary = aggregate_timeline(rows, names, EDGES, masks=masks, min_hours=40.0).join(tl.recordings.select(REC, *KEY), REC)
    melt = lambda df, metrics: F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics]))
    stats = summary.where("n > 0").select("patient_id", "bin_label", "feature", melt(summary, [m for m in AUDITED if m not in (*_FIELDS, "slope")]))
    fields = summary.where("n_total_epochs > 0").select("patient_id", "bin_label", F.lit("").alias("feature"), melt(summary, _FIELDS)).distinct()
    slopes = summary.select("patient_id", F.lit("all").alias("bin_label"), "feature", F.lit("slope").alias("metric"), F.col("slope").alias("value")).distinct()
    pid = F.col("patient_id")
    number = F.array_position(F.array(*[F.lit(m) for m in AUDITED]), F.col("metric")) - 1
    drift = F.when(pid % 23 == number, F.when(F.col("metric").isin("n", "n_total_epochs"), 1.0).otherwise(F.greatest(F.lit(1.0), F.abs("value")) * 1e-4)).otherwise(0.0)
    exported = stats.unionByName(fields).unionByName(slopes).where("value IS NOT NULL").withColumn("value", F.col("value") + drift)
    again = recomputed_bins(rows.withColumnRenamed(KEY[0], "_p"), [REC], names, EDGES, masks=masks, min_hours=40.0).join(tl.recordings.select(REC, *KEY), REC)
    label = F.when(F.col("bin_id") < 0, "all").otherwise(F.get(F.array(*[F.lit(f"{a:.0f}-{b:.0f}h") for a, b in zip(EDGES, EDGES[1:])]), "bin_id"))
    again = again.withColumn("bin_label", label).where("metric <> 'n_usable_epochs'")
    gone = lambda df, k, r, b: df.where(~((F.col("patient_id") % k == r) & (F.col("bin_label") == b)))
    out = audit_bins(gone(exported, 31, 3, "48-168h"), gone(again, 37, 5, "0-48h"), ["patient_id", "bin_label", "feature"], {"n": "count", "n_total_epochs": "count"})
    return out.select("patient_id", "bin_label", "feature", "metric", "status")
