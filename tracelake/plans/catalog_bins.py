"""Time-bin aggregation queries."""

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import bins as bn
from ..operators import features as ft
from ..operators.orderstats import order_stats, trimmed_mean
from ..operators.timebase import step_support
from ..sources.workdir import stored
from ..operators.bincounts import aggregate_timeline
from ..operators.stored_timeline import REC, with_support
from .bindings import BIN_OF, EDGES, EP, KEY, SUPPORT, recordings, stored_recordings, table
from .registry import also_sliced, query

R = rounded


def binned(spark, sf):
    return bn.assign_bins(recordings(spark, sf), EDGES)


BN = f"bn AS (SELECT *, {BIN_OF} AS bin_label FROM tl)"


@query("A1_bin_table", """
WITH e AS (SELECT list_sort(list(DISTINCT CAST(6 * (1 + p_size % 12) AS DOUBLE))) AS l FROM part),
x AS (SELECT unnest([0.0] || l) AS a, unnest(l || [NULL]) AS b FROM e)
SELECT CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(b AS BIGINT) AS VARCHAR) || 'h' AS bin_label, a AS bin_start, b AS bin_end FROM x WHERE b IS NOT NULL
""")
def bin_table(spark, sf):
    found = table(spark, sf, "part").select((6.0 * (1 + F.col("p_size") % 12)).alias("e")).distinct().orderBy("e").collect()
    return bn.bin_table(spark, [0.0, *[r.e for r in found]])


@query("A2_bin_stats", f"""
WITH {EP}, {BN}, u AS (SELECT * FROM bn WHERE usable AND bin_label IS NOT NULL AND value IS NOT NULL)
SELECT patient_id, bin_label, count(*) AS n, round(median(value)+1e-9,6) AS median, round(avg(value)+1e-9,6) AS mean,
  round(coalesce(stddev_samp(value),0)+1e-9,6) AS sd, round(quantile_cont(value,0.05)+1e-9,6) AS p05, round(quantile_cont(value,0.1)+1e-9,6) AS p10,
  round(quantile_cont(value,0.25)+1e-9,6) AS p25, round(quantile_cont(value,0.75)+1e-9,6) AS p75, round(quantile_cont(value,0.9)+1e-9,6) AS p90,
  round(quantile_cont(value,0.95)+1e-9,6) AS p95, round(quantile_cont(value,0.75)-quantile_cont(value,0.25)+1e-9,6) AS iqr,
  min(value) AS min, max(value) AS max FROM u GROUP BY 1,2
""")
def bin_stats(spark, sf):
    df = binned(spark, sf).where(F.col("usable") & F.col("bin_label").isNotNull())
    out = bn.bin_stats(df, ["patient_id", "bin_label"], "value").where(F.col("n") > 0)
    return out.select("patient_id", "bin_label", "n", *[R(F.col(c)).alias(c) for c in (
        "median", "mean", "sd", "p05", "p10", "p25", "p75", "p90", "p95", "iqr")], "min", "max")


@query("A3_effective_counts", f"""
WITH {EP}, lv AS (SELECT *, floor(value / 50.0) AS level FROM tl),
ch AS (SELECT *, lag(level) OVER (PARTITION BY patient_id ORDER BY row_idx) AS pl FROM lv),
lc AS (SELECT *, max(CASE WHEN row_idx = 0 OR coalesce(level <> pl, FALSE) THEN row_idx END) OVER (PARTITION BY patient_id ORDER BY row_idx) AS at_ FROM ch),
mk AS (SELECT *, (row_idx - at_) % 4 = 0 AS ind, {BIN_OF} AS bin_label FROM lc)
SELECT patient_id, bin_label, count(value) AS n_observed, count(value) FILTER (ind) AS n_effective FROM mk
WHERE usable AND bin_label IS NOT NULL GROUP BY 1, 2
""")
def effective_counts(spark, sf):
    df = binned(spark, sf).withColumn("level", F.floor(F.col("value") / 50.0))
    df = ft.independent_mask(df, KEY, ["level"], 4, "ind").where(F.col("usable") & F.col("bin_label").isNotNull())
    return df.groupBy("patient_id", "bin_label").agg(
        F.count("value").alias("n_observed"), F.count(F.when(F.col("ind"), F.col("value"))).alias("n_effective"))


@query("A4_trimmed_mean", f"""
WITH {EP}, {BN}, u AS (SELECT patient_id, bin_label, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY patient_id, bin_label) AS n
  FROM bn WHERE usable AND bin_label IS NOT NULL AND value IS NOT NULL WINDOW w AS (PARTITION BY patient_id, bin_label ORDER BY value))
SELECT patient_id, bin_label, round(avg(value) FILTER (n < 4 OR (i >= floor(n * 0.1) AND i < n - floor(n * 0.1))) + 1e-9, 6) AS trimmed_mean FROM u GROUP BY 1, 2
""")
def trimmed(spark, sf):
    df = binned(spark, sf).where(F.col("usable") & F.col("bin_label").isNotNull())
    out = order_stats(df, ["patient_id", "bin_label"], "value", trimmed_mean=trimmed_mean(0.1))
    return out.withColumn("trimmed_mean", R(F.col("trimmed_mean")))


@query("A5_cv", f"""
WITH {EP}, {BN}
SELECT patient_id, bin_label, round(CASE WHEN avg(value) > 1e-10 THEN coalesce(stddev_samp(value), 0.0) / avg(value) END + 1e-9, 6) AS cv
FROM bn WHERE usable AND bin_label IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2
""")
def cv(spark, sf):
    df = binned(spark, sf).where(F.col("usable") & F.col("bin_label").isNotNull() & F.col("value").isNotNull())
    m = bn.moments(df, ["patient_id", "bin_label"], "value")
    return m.select("patient_id", "bin_label", R(F.when(F.col("mean") > 1e-10, F.col("sd") / F.col("mean"))).alias("cv"))


@query("A6_geometric_mean", f"""
WITH {EP}, {BN}
SELECT patient_id, bin_label, round(exp(avg(ln(value))) + 1e-9, 6) AS log_mean, round(coalesce(stddev_samp(ln(value)), 0.0) + 1e-9, 6) AS log_sd
FROM bn WHERE usable AND bin_label IS NOT NULL AND value > 0 GROUP BY 1, 2
""")
def geometric(spark, sf):
    df = binned(spark, sf).where(F.col("usable") & F.col("bin_label").isNotNull())
    m = bn.moments(df, ["patient_id", "bin_label"], "value").where(F.col("log_mean").isNotNull())
    return m.select("patient_id", "bin_label", R(F.col("log_mean")).alias("log_mean"), R(F.col("log_sd")).alias("log_sd"))


MASKS_SQL = f"""
lv AS (SELECT *, floor(value / 50.0) AS level, floor(value / 20.0) AS fine FROM su),
ch AS (SELECT *, lag(level) OVER w AS pl, lag(fine) OVER w AS pf FROM lv WINDOW w AS (PARTITION BY patient_id ORDER BY row_idx)),
lc AS (SELECT *, max(CASE WHEN row_idx = 0 OR coalesce(level <> pl, FALSE) THEN row_idx END) OVER w AS at_,
  max(CASE WHEN row_idx = 0 OR coalesce(fine <> pf, FALSE) THEN row_idx END) OVER w AS at2 FROM ch WINDOW w AS (PARTITION BY patient_id ORDER BY row_idx)),
mk AS (SELECT *, (row_idx - at_) % 8 = 0 AS m_power, (row_idx - at2) % 10 = 0 AS m_amp, {BIN_OF} AS bin_label FROM lc)
"""
GRID = """gr AS (SELECT patient_id, b.bin_label, b.bin_start, b.bin_end FROM (SELECT DISTINCT patient_id FROM tl),
  (VALUES ('0-48h', 0.0::DOUBLE, 48.0::DOUBLE), ('48-168h', 48.0, 168.0), ('168-720h', 168.0, 720.0)) b(bin_label, bin_start, bin_end))"""


def masked(spark, sf):
    df = step_support(recordings(spark, sf), KEY)
    df = df.withColumns({"level": F.floor(F.col("value") / 50.0), "fine": F.floor(F.col("value") / 20.0)})
    return ft.independent_masks(df, KEY, {"m_power": (["level"], 8), "m_amp": (["fine"], 10)})


@query("A7_bin_totals", f"""
WITH {EP}, {SUPPORT}, {MASKS_SQL}, {GRID}
SELECT gr.patient_id, gr.bin_label, count(mk.event_id) AS n_total_epochs, count(*) FILTER (usable) AS n_usable_epochs,
  count(*) FILTER (usable AND m_power) AS n_effective_m_power,
  least(count(*) FILTER (usable AND m_power), count(*) FILTER (usable AND m_amp)) AS n_effective_cadence
FROM gr LEFT JOIN mk USING (patient_id, bin_label) GROUP BY 1, 2
""")
def bin_totals(spark, sf):
    out = bn.bin_coverage(masked(spark, sf), KEY, EDGES, masks=["m_power", "m_amp"])
    return out.select("patient_id", "bin_label", "n_total_epochs", "n_usable_epochs", "n_effective_m_power", "n_effective_cadence")


COVER = f"""
cv AS (SELECT gr.patient_id, gr.bin_label, bin_start, bin_end, count(bs.event_id) AS n_total, coalesce(sum(support), 0) AS obs,
  coalesce(sum(support) FILTER (usable), 0) AS clean, coalesce(sum(support) FILTER (seizure AND artifact_clean), 0) AS ev
  FROM gr LEFT JOIN (SELECT *, {BIN_OF} AS bin_label FROM su) bs USING (patient_id, bin_label) GROUP BY 1, 2, 3, 4)
"""


@query("A8_coverage", f"""
WITH {EP}, {SUPPORT}, {GRID}, {COVER}
SELECT patient_id, bin_label, n_total AS n_total_epochs, round(obs+1e-9,6) AS observed_hours, round(clean+1e-9,6) AS clean_hours, bin_end - bin_start AS expected_hours,
  round(CASE WHEN obs > 0 THEN clean / obs ELSE 0.0 END+1e-9,6) AS clean_of_observed, round(clean / (bin_end - bin_start)+1e-9,6) AS clean_of_expected,
  clean >= 1.0 AS meets_minimum FROM cv
""")
def coverage(spark, sf):
    tl = stored_recordings(spark, sf)
    out = bn.bin_coverage(with_support(tl), [REC], EDGES).join(tl.recordings.select(REC, *KEY), REC)
    return out.select("patient_id", "bin_label", "n_total_epochs", R(F.col("observed_hours")).alias("observed_hours"), R(F.col("clean_hours")).alias("clean_hours"),
                      "expected_hours", R(F.col("clean_of_observed")).alias("clean_of_observed"),
                      R(F.col("clean_of_expected")).alias("clean_of_expected"), "meets_minimum")


@query("A9_below_minimum", f"""
WITH {EP}, {SUPPORT}, {GRID}, {COVER}, {BN},
s AS (SELECT patient_id, bin_label, median(value) AS med, count(value) AS n FROM bn WHERE usable GROUP BY 1, 2)
SELECT cv.patient_id, cv.bin_label, round(CASE WHEN clean >= 40 THEN med END+1e-9,6) AS median,
  CASE WHEN clean >= 40 THEN coalesce(n, 0) ELSE 0 END AS n_observed, CASE WHEN clean >= 40 THEN coalesce(n, 0) ELSE 0 END AS n_effective
FROM cv LEFT JOIN s USING (patient_id, bin_label)
""")
def below_minimum(spark, sf):
    df = stored(step_support(recordings(spark, sf), KEY).select("patient_id", "hours", "usable", "support_hours", "value"), "epochs")
    out = bn.aggregate_bins(df, KEY, ["value"], EDGES, min_hours=40.0)
    return out.select("patient_id", "bin_label", R(F.col("median")).alias("median"), "n_observed", "n_effective")


@query("A10_continuity", f"""
WITH {EP}, {BN}, {GRID}, s AS (SELECT patient_id, bin_label,
  count(*) FILTER (usable AND value IS NOT NULL AND raw_value IS NOT NULL AND value < 10.0 AND raw_value < 20.0) AS b,
  count(*) FILTER (usable AND value IS NOT NULL AND raw_value IS NOT NULL) AS v FROM bn WHERE bin_label IS NOT NULL GROUP BY 1, 2)
SELECT gr.patient_id, gr.bin_label, round(CASE WHEN v > 0 THEN b * 1.0 / v END+1e-9,6) AS continuity_index FROM gr LEFT JOIN s USING (patient_id, bin_label)
""")
def continuity(spark, sf):
    df = step_support(recordings(spark, sf), KEY).withColumn("half", F.col("raw_value") / 2.0)
    out = bn.bin_coverage(df, KEY, EDGES, suppression=["value", "half"])
    return out.select("patient_id", "bin_label", R(F.col("continuity_index")).alias("continuity_index"))


@query("A11_event_hours", f"""
WITH {EP}, {SUPPORT}, {GRID}, {COVER}
SELECT patient_id, bin_label, round(ev+1e-9,6) AS event_hours FROM cv
""")
def event_hours(spark, sf):
    out = bn.bin_coverage(step_support(recordings(spark, sf), KEY), KEY, EDGES, event="seizure", event_base="artifact_clean")
    return out.select("patient_id", "bin_label", R(F.col("event_hours")).alias("event_hours"))


SUMMARY = f"""
WITH {EP}, {SUPPORT}, {GRID}, {COVER},
bl AS (SELECT *, {BIN_OF} AS bin_label FROM tl),
lo AS (SELECT patient_id, bin_label, 'fft_delta_value' AS feature, value AS v FROM bl WHERE usable UNION ALL
       SELECT patient_id, bin_label, 'raw_value' AS feature, raw_value AS v FROM bl WHERE usable),
s AS (SELECT patient_id, bin_label, feature, median(v) AS median, avg(v) AS mean, CASE WHEN count(v) = 1 THEN 0.0 ELSE stddev_samp(v) END AS sd,
   quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.95) AS p95, count(v) AS n, exp(avg(ln(CASE WHEN v > 0 THEN v END))) AS lm FROM lo GROUP BY 1, 2, 3),
ff AS (SELECT * FROM (VALUES ('fft_delta_value'), ('raw_value')) f(feature)),
j AS (SELECT cv.patient_id, cv.bin_label, bin_start, bin_end, feature, clean, n_total, clean >= 1.0 AS ok,
   CASE WHEN clean >= 1.0 THEN median END AS median, CASE WHEN clean >= 1.0 THEN mean END AS mean, CASE WHEN clean >= 1.0 THEN sd END AS sd,
   CASE WHEN clean >= 1.0 THEN p05 END AS p05, CASE WHEN clean >= 1.0 THEN p95 END AS p95,
   CASE WHEN clean >= 1.0 AND feature = 'fft_delta_value' THEN lm END AS log_mean,
   CASE WHEN clean >= 1.0 THEN coalesce(n, 0) ELSE 0 END AS n_effective
   FROM cv CROSS JOIN ff LEFT JOIN s USING (patient_id, bin_label, feature)),
sl AS (SELECT patient_id, feature, CASE WHEN count(*) >= 2 THEN regr_slope(median, (bin_start + bin_end) / 2.0) END AS slope
   FROM j WHERE ok AND median IS NOT NULL GROUP BY 1, 2)
"""


def summary(spark, sf):
    tl = stored_recordings(spark, sf)
    rows = with_support(tl).withColumn("fft_delta_value", F.col("value"))
    out = aggregate_timeline(rows, ["fft_delta_value", "raw_value"], EDGES)
    return out.join(tl.recordings.select(REC, *KEY), REC)


@query("A12_bin_slopes", SUMMARY + "SELECT patient_id, feature, round(slope+1e-9,6) AS slope FROM sl")
def slopes(spark, sf):
    ok = summary(spark, sf).where(F.col("meets_minimum") & F.col("median").isNotNull())
    return ok.groupBy("patient_id", "feature").agg(F.any_value(R(F.col("slope"))).alias("slope"))


MISSING = """CASE WHEN n_total = 0 THEN 'no_data' WHEN clean / (bin_end - bin_start) >= 0.95 THEN 'complete'
 WHEN clean / (bin_end - bin_start) >= 0.5 THEN 'high_artifact' WHEN clean / (bin_end - bin_start) >= 0.1 THEN 'moderate_artifact' ELSE 'low_data' END"""


@query("A13_missingness", f"""
WITH {EP}, {SUPPORT}, {GRID}, {COVER} SELECT patient_id, bin_label, {MISSING} AS missingness FROM cv
""")
def missing(spark, sf):
    return bn.bin_coverage(step_support(recordings(spark, sf), KEY), KEY, EDGES).select("patient_id", "bin_label", "missingness")


def _rounded(*names):
    return ", ".join(f"round({n}+1e-9,6) AS {n}" for n in names)


# All statistics, over independent rows for the first variable, and the columns of the bin.
INDEPENDENT = ["median", "mean", "sd", "p05", "p10", "p25", "p75", "p90", "p95", "iqr", "min", "max", "trimmed_mean_20pct", "cv", "log_mean", "log_sd"]
FULL = f"""
WITH {EP}, {SUPPORT}, {GRID}, {COVER}, {MASKS_SQL},
lo AS (SELECT patient_id, bin_label, 'fft_delta_value' AS feature, value AS v, m_power AS own FROM mk WHERE usable AND bin_label IS NOT NULL UNION ALL
       SELECT patient_id, bin_label, 'raw_value', raw_value, TRUE FROM mk WHERE usable AND bin_label IS NOT NULL),
rk AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY patient_id, bin_label, feature) AS k FROM lo WHERE own AND v IS NOT NULL
       WINDOW w AS (PARTITION BY patient_id, bin_label, feature ORDER BY v)),
s AS (SELECT patient_id, bin_label, feature, median(v) AS median, avg(v) AS mean, CASE WHEN count(v) = 1 THEN 0.0 ELSE stddev_samp(v) END AS sd,
   {", ".join(f"quantile_cont(v, {p}) AS {n}" for n, p in bn.QUANTILES.items())}, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, min(v) AS min, max(v) AS max,
   avg(v) FILTER (k < 4 OR (i >= floor(k * 0.1) AND i < k - floor(k * 0.1))) AS trimmed_mean_20pct, count(v) AS n,
   CASE WHEN feature LIKE 'fft%' THEN exp(avg(ln(CASE WHEN v > 0 THEN v END))) END AS log_mean,
   CASE WHEN feature LIKE 'fft%' THEN CASE WHEN count(*) FILTER (v > 0) = 1 THEN 0.0 ELSE stddev_samp(ln(CASE WHEN v > 0 THEN v END)) END END AS log_sd FROM rk GROUP BY 1, 2, 3),
ob AS (SELECT patient_id, bin_label, feature, count(v) AS n_observed FROM lo GROUP BY 1, 2, 3),
ff AS (SELECT * FROM (VALUES ('fft_delta_value', 'power_cadence_adjusted'), ('raw_value', 'row_count')) f(feature, basis)),
nm AS (SELECT gr.patient_id, gr.bin_label, count(*) FILTER (usable AND m_power) AS n_power FROM gr LEFT JOIN mk USING (patient_id, bin_label) GROUP BY 1, 2),
j AS (SELECT *, CASE WHEN mean > 1e-10 THEN sd / mean END AS cv, clean >= 40.0 AS ok FROM cv CROSS JOIN ff LEFT JOIN s USING (patient_id, bin_label, feature)
   LEFT JOIN ob USING (patient_id, bin_label, feature) JOIN nm USING (patient_id, bin_label)),
sl AS (SELECT patient_id, feature, CASE WHEN count(*) >= 2 THEN regr_slope(median, (bin_start + bin_end) / 2.0) END AS slope FROM j WHERE ok AND median IS NOT NULL GROUP BY 1, 2)
"""


@query("A14_bin_summary", FULL + f"""
SELECT patient_id, bin_label, feature, n_total AS n_total_epochs, n_power AS n_effective_cadence, {_rounded("obs", "clean")}, ok AS meets_minimum, {MISSING} AS missingness,
  {", ".join(f"CASE WHEN ok THEN round({c}+1e-9,6) END AS {c}" for c in INDEPENDENT)}, CASE WHEN ok THEN coalesce(n_observed, 0) ELSE 0 END AS n_observed,
  CASE WHEN ok THEN coalesce(n, 0) ELSE 0 END AS n_effective, CASE WHEN ok THEN basis WHEN feature = 'raw_value' THEN 'not_estimated' ELSE basis END AS effective_basis, round(slope+1e-9,6) AS slope
FROM j LEFT JOIN sl USING (patient_id, feature)
""")
def bin_summary(spark, sf):
    """Every statistic of the bin summary, over a timeline stored once; the first variable counts independent rows only."""
    tl = stored_recordings(spark, sf)
    rows = with_support(tl).withColumns({"fft_delta_value": F.col("value"), "level": F.floor(F.col("value") / 50.0)})
    rows = ft.independent_mask(rows, [REC], ["level"], 8, "m_power")
    out = aggregate_timeline(rows, ["fft_delta_value", "raw_value"], EDGES, masks={"fft_delta_value": "m_power"}, basis={"fft_delta_value": "power_cadence_adjusted"}, min_hours=40.0)
    out = out.join(tl.recordings.select(REC, *KEY), REC)
    return out.select("patient_id", "bin_label", "feature", "n_total_epochs", "n_effective_cadence", R(F.col("observed_hours")).alias("obs"), R(F.col("clean_hours")).alias("clean"),
                      "meets_minimum", "missingness", *[R(F.col(c)).alias(c) for c in INDEPENDENT], "n_observed", "n_effective", "effective_basis", R(F.col("slope")).alias("slope"))


also_sliced("A14_bin_summary")
also_sliced("A3_effective_counts")
