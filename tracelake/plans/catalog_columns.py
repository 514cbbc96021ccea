"""Column identity queries over labels derived from ``part``."""

from pyspark.sql import functions as F

from ..constants import FAMILY_PATTERNS
from ..functions import labels as lb
from ..functions.numbers import rounded
from ..operators import columns as cl
from ..operators.retrieve import bin_frequency
from .bindings import table
from .registry import query

R = rounded

KINDS = [
    "FFT Power", "FFT PowerRatio", "aEEG", "Suppression Ratio", "Asymmetry, Relative Index (REASI)", "Rhythmicity Spectrogram", "FFT Spectrogram",
    "Artifact Intensity", "Seizure Probability P14", "Spike Detections per sec", "Coherence_Spectrogram", "Heart Rate", "Electrode Signal Quality",
    "SleepStages", "Comment", "Artifact Detector", "mystery", "FFT_Edge SEF95", "Boolean LPD+", "PeakEnvelope", "Time", "Status Epilepticus ACNS Percent",
]
BANDS = ["1 - 4 Hz", "4 - 8 Hz", "8 - 13 Hz", "13 - 20 Hz", "0 - 20 Hz", "20 - 40 Hz"]
RATIOS = ["8-13/1-30 Hz", "8-13/1-4 Hz", "4-8/1-4 Hz", "6-14/1-20 Hz", "4-8/1-30 Hz", "2-3/5-9 Hz"]
LOCS = ["Left Anterior", "Right Posterior", "Left Hemisphere", "Asym Hemi", "F3C3P3", "All 10-20", ".T4T6O2", "Anterior"]
WITH_BAND = [0, 4, 19]
NO_PLACE = [7, 8, 12, 14, 15, 20]


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


LB = f"""
pk AS (SELECT p_partkey, p_size AS file_id, CAST(p_partkey % {len(KINDS)} AS INT) AS k, CAST((p_partkey // {len(KINDS)}) % 6 AS INT) AS b, CAST((p_partkey // 5) % {len(LOCS)} AS INT) AS l,
   CAST(200 + p_partkey % 60 AS INT) AS i_group, CAST(1 + p_partkey % 7 AS INT) AS sub_index, p_partkey AS col_idx FROM part),
lb AS (SELECT *, 'I' || i_group || '_' || sub_index AS code, ({_list(KINDS)})[k + 1]
   || CASE WHEN k = 1 THEN ', ' || ({_list(RATIOS)})[b + 1] WHEN k IN (0, 4, 19) THEN ', ' || ({_list(BANDS)})[b + 1] ELSE '' END
   || CASE WHEN k IN (7, 8, 12, 14, 15, 20) THEN '' ELSE ', ' || ({_list(LOCS)})[l + 1] END AS label FROM pk)
"""


def labelled(spark, sf):
    p = F.col("p_partkey")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i)
    k, b, loc = (p % len(KINDS)).cast("int"), (F.floor(p / len(KINDS)) % 6).cast("int"), (F.floor(p / 5) % len(LOCS)).cast("int")
    label = F.concat(pick(KINDS, k), F.when(k == 1, F.concat(F.lit(", "), pick(RATIOS, b))).when(k.isin(WITH_BAND), F.concat(F.lit(", "), pick(BANDS, b))).otherwise(""),
                     F.when(k.isin(NO_PLACE), "").otherwise(F.concat(F.lit(", "), pick(LOCS, loc))))
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("file_id"), k.alias("k"), F.col("p_partkey").alias("col_idx"),
                                         (200 + p % 60).cast("int").alias("i_group"), (1 + p % 7).cast("int").alias("sub_index"), label.alias("label"))
    return df.withColumn("code", F.concat(F.lit("I"), "i_group", F.lit("_"), "sub_index"))


def described(spark, sf):
    return cl.describe(labelled(spark, sf))


def _pattern_sql(family, pattern):
    if family == "time_display":
        return "(regexp_matches(label, '^Time[,\\s]') AND NOT regexp_matches(label, '^Time[,\\s]Avg\\s*<'))"
    return f"regexp_matches(label, '{pattern}')"


KW = "CASE " + " ".join(f"WHEN {_pattern_sql(f, p)} THEN '{f}'" for f, p in FAMILY_PATTERNS) + " END"
RATIO_RE = r"(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*/+\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)"
FAM = f"""
{LB.strip()},
rt AS (SELECT *, {KW} AS kw, TRY_CAST(regexp_extract(label, '{RATIO_RE}', 1) AS DOUBLE) AS n1, TRY_CAST(regexp_extract(label, '{RATIO_RE}', 2) AS DOUBLE) AS n2,
  TRY_CAST(regexp_extract(label, '{RATIO_RE}', 3) AS DOUBLE) AS d1, TRY_CAST(regexp_extract(label, '{RATIO_RE}', 4) AS DOUBLE) AS d2 FROM lb),
rk AS (SELECT *, CASE WHEN abs(d1 - 1) < 0.51 AND abs(d2 - 30) < 0.51 THEN 'relative_power' WHEN abs(d1 - 1) < 0.51 AND abs(d2 - 20) < 0.51 THEN 'alpha_variability' WHEN abs(d1 - 1) < 0.51 AND abs(d2 - 4) < 0.51 THEN 'adr' ELSE 'fft_power_ratio' END AS rfam FROM rt),
fm AS (SELECT *, CASE WHEN n1 IS NOT NULL AND (regexp_matches(label, 'FFT[_ ]PowerRatio') OR coalesce(kw IN ('fft_power','fft_power_ratio','alpha_variability'), TRUE)) AND rfam <> 'fft_power_ratio' THEN rfam ELSE coalesce(kw, 'other') END AS family FROM rk)
"""


@query("C1_family", f"WITH {FAM} SELECT p_partkey, label, family FROM fm")
def family(spark, sf):
    return labelled(spark, sf).select("p_partkey", "label", lb.family_of("label").alias("family"))


@query("C2_frequency_range", f"""
WITH {LB} SELECT p_partkey, TRY_CAST(coalesce(nullif(regexp_extract(label, '{RATIO_RE}\\s*Hz', 1), ''), regexp_extract(label, '(\\d+)\\s*-\\s*(\\d+)\\s*Hz', 1)) AS DOUBLE) AS lo,
  TRY_CAST(coalesce(nullif(regexp_extract(label, '{RATIO_RE}\\s*Hz', 2), ''), regexp_extract(label, '(\\d+)\\s*-\\s*(\\d+)\\s*Hz', 2)) AS DOUBLE) AS hi,
  TRY_CAST(regexp_extract(label, '{RATIO_RE}', 3) AS DOUBLE) AS den_lo, TRY_CAST(regexp_extract(label, '{RATIO_RE}', 4) AS DOUBLE) AS den_hi FROM lb
""")
def frequency_range(spark, sf):
    lo, hi = lb.frequency_range("label")
    r = lb.ratio_bands("label")
    return labelled(spark, sf).select("p_partkey", lo.alias("lo"), hi.alias("hi"), r["den_lo"].alias("den_lo"), r["den_hi"].alias("den_hi"))


@query("C3_ratio_kind", f"""
WITH {FAM} SELECT p_partkey, rfam AS ratio_family, CASE rfam WHEN 'relative_power' THEN CASE WHEN n1 >= 0 AND n2 <= 1 THEN 'infraslow' WHEN n1 >= 1 AND n2 <= 4 THEN 'delta' WHEN n1 >= 4 AND n2 <= 8 THEN 'theta' WHEN n1 >= 8 AND n2 <= 13 THEN 'alpha' ELSE 'broadband' END
  WHEN 'alpha_variability' THEN 'rav' WHEN 'adr' THEN CASE WHEN abs(n1 - 8) < 0.51 THEN 'adr' WHEN abs(n1 - 4) < 0.51 THEN 'tdr' ELSE 'adr' END ELSE '' END AS kind FROM fm WHERE n1 IS NOT NULL
""")
def ratio_kind(spark, sf):
    fam, kind = lb.ratio_kind("label")
    return labelled(spark, sf).where(lb.ratio_bands("label")["num_lo"].isNotNull()).select("p_partkey", fam.alias("ratio_family"), kind.alias("kind"))


@query("C4_band", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 2.0 AS lo, l_quantity / 2.0 + l_linenumber AS hi FROM lineitem),
bands AS (SELECT * FROM (VALUES (1, 'infraslow', 0.0, 1.0), (2, 'delta', 1.0, 4.0), (3, 'theta', 4.0, 8.0), (4, 'alpha', 8.0, 13.0), (5, 'beta', 13.0, 20.0), (6, 'beta_wide', 13.0, 30.0)) b(ord, band, a, z))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(arg_min(band, ord), '') AS band FROM r LEFT JOIN bands ON lo >= a AND hi <= z GROUP BY 1, 2, 3, 4
""")
def band(spark, sf):
    lo = F.col("l_quantity") / 2.0
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", lb.band_of(lo, lo + F.col("l_linenumber")).alias("band"))


ELEC = "F10|Fp1|Fp2|F3|F4|C3|C4|P3|P4|O1|O2|F7|F8|T3|T4|T5|T6|Fz|Cz|Pz|A1|A2|P7|P8|T7|T8|F9"
TAIL = "CASE WHEN contains(label, ',') THEN trim(string_split(label, ',')[-1]) ELSE label END"


@query("C5_location", f"""
WITH {LB}, t AS (SELECT *, {TAIL} AS tail FROM lb),
e AS (SELECT *, replace(coalesce(nullif(regexp_extract(ltrim(tail, '.'), '(?i)({ELEC})(-?({ELEC}))*'), ''), regexp_extract(label, '(?i)({ELEC})(-?({ELEC}))*')), '-', '') AS electrode FROM t)
SELECT p_partkey, CASE WHEN contains(tail, 'Left') THEN 'left' WHEN contains(tail, 'Right') THEN 'right' WHEN contains(label, 'Left') THEN 'left' WHEN contains(label, 'Right') THEN 'right' ELSE '' END AS hemisphere,
  CASE WHEN contains(tail, 'Anterior') THEN 'anterior' WHEN contains(tail, 'Posterior') THEN 'posterior' WHEN contains(tail, 'Hemisphere') THEN 'hemisphere' WHEN contains(label, 'Anterior') THEN 'anterior' WHEN contains(label, 'Posterior') THEN 'posterior' WHEN contains(label, 'Hemisphere') THEN 'hemisphere' ELSE '' END AS region,
  electrode, CASE electrode WHEN 'F3C3P3' THEN 'left' WHEN 'T4T6O2' THEN 'right' END AS chain_side, CASE electrode WHEN 'F3C3P3' THEN 'frontal_central_parietal' WHEN 'T4T6O2' THEN 'temporal_occipital' END AS chain_region FROM e
""")
def location(spark, sf):
    e = lb.electrode_of("label")
    return labelled(spark, sf).select("p_partkey", lb.hemisphere_of("label").alias("hemisphere"), lb.region_word("label").alias("region"), e.alias("electrode"),
                                      lb.chain_side(e).alias("chain_side"), lb.chain_region(e).alias("chain_region"))


@query("C6_electrode_names", f"""
WITH {LB}, x AS (SELECT p_partkey, label || ', T3-T5 T30 ' || ({_list(['T3', 'T4', 'T5', 'T6'])})[CAST(p_partkey % 4 AS INT) + 1] AS t FROM lb)
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\bT3\\b', 'T7', 'g'), '\\bT4\\b', 'T8', 'g'), '\\bT5\\b', 'P7', 'g'), '\\bT6\\b', 'P8', 'g') AS normalized FROM x
""")
def electrode_names(spark, sf):
    pick = F.get(F.array(*[F.lit(v) for v in ("T3", "T4", "T5", "T6")]), (F.col("p_partkey") % 4).cast("int"))
    return labelled(spark, sf).select("p_partkey", lb.normalize_electrodes(F.concat("label", F.lit(", T3-T5 T30 "), pick)).alias("normalized"))


# What the generator put into a label decides the expected names, without parsing it.
LOC_SLUG = "([ 'left_anterior', 'right_posterior', 'left_hemisphere', '', 'f3c3p3', 'all', 't4t6o2', 'anterior'])[l + 1]"
CHAIN_SLUG = "(['left_anterior', 'right_posterior', 'left_hemisphere', '', 'f3c3p3', '', 't4t6o2', 'anterior'])[l + 1]"
HEMI = "(['left', 'right', 'left', '', 'left', '', 'right', ''])[l + 1]"
HEMI_REG = "(['left_anterior', 'right_posterior', 'left_hemisphere', '', 'left', '', 'right', 'anterior'])[l + 1]"
ASYM = "CASE WHEN l = 3 THEN '_asym' ELSE '' END"
BSLUG = "(['delta', 'theta', 'alpha', 'beta', 'power', 'power'])[b + 1]"
HZ2 = "replace(printf('%.2f', {f}), '.', '_') || 'hz'"
FIVE = "(['max', 'min', 'p50', 'p75', 'p25'])[sub_index]"
ESQ = "(['Fp1', 'Fp2', 'F7', 'F3', 'Fz', 'F4', 'F8'])[sub_index]"
SUB = f"""CASE k WHEN 0 THEN CASE WHEN l IN (4, 6) THEN {CHAIN_SLUG} WHEN l IN (0, 1, 2) THEN {CHAIN_SLUG} ELSE '' END WHEN 1 THEN CASE WHEN b NOT IN (3, 5) THEN '' WHEN l IN (0, 1, 2, 4, 6) THEN {CHAIN_SLUG} ELSE '' END
  WHEN 2 THEN coalesce({FIVE}, nullif((['left', 'right', 'left', '', '', '', '', ''])[l + 1], ''), '') WHEN 4 THEN concat_ws('_', 'reasi', CASE WHEN b = 4 THEN 'broadband' END, CASE WHEN l = 3 THEN 'hemisphere' END)
  WHEN 7 THEN coalesce((['emg', 'eye_vertical', 'eye_horizontal'])[sub_index], '') WHEN 9 THEN CASE WHEN l IN (0, 2) THEN 'left_per_sec' WHEN l = 1 THEN 'right_per_sec' ELSE '' END
  WHEN 12 THEN {ESQ} WHEN 13 THEN 'stage_display' WHEN 18 THEN 'left_posterior' ELSE '' END"""
NM = f"""nm AS (SELECT *, CASE WHEN k = 4 AND s0 = 'reasi' THEN '' ELSE s0 END AS sub_name FROM (SELECT *, {SUB} AS s0 FROM fm))"""
NAME = f"""CASE k WHEN 0 THEN concat_ws('_', 'fft', {BSLUG}, nullif({LOC_SLUG}, '')) || {ASYM}
 WHEN 1 THEN CASE WHEN b IN (0, 4) THEN concat_ws('_', 'rel', CASE WHEN b = 0 THEN 'alpha' ELSE 'theta' END, nullif({LOC_SLUG}, '')) || CASE WHEN l = 3 THEN '_asym' ELSE '' END
   WHEN b = 1 THEN concat_ws('_', 'adr', nullif({LOC_SLUG}, '')) WHEN b = 2 THEN concat_ws('_', 'tdr', nullif({LOC_SLUG}, '')) WHEN b = 3 THEN concat_ws('_', 'rav', nullif({LOC_SLUG}, '')) ELSE concat_ws('_', 'ratio', nullif({LOC_SLUG}, '')) END
 WHEN 2 THEN concat_ws('_', 'aeeg', nullif(CASE WHEN l = 7 THEN 'anterior' ELSE {HEMI} END, ''), nullif(sub_name, ''))
 WHEN 3 THEN CASE WHEN l = 5 THEN 'suppression_all' ELSE concat_ws('_', 'suppression', nullif(CASE WHEN l = 2 THEN 'left' ELSE {HEMI_REG} END, '')) END
 WHEN 4 THEN CASE WHEN sub_name <> '' THEN 'asymmetry_' || sub_name ELSE concat_ws('_', 'asymmetry_spec', nullif({CHAIN_SLUG}, ''), {HZ2.format(f='sub_index * 0.5')}) END
 WHEN 5 THEN concat_ws('_', 'rhythmicity', nullif({CHAIN_SLUG}, ''), {HZ2.format(f='(1 + (sub_index - 1) / 24.0) ** 2')})
 WHEN 6 THEN concat_ws('_', 'fft_spec', nullif({CHAIN_SLUG}, ''), {HZ2.format(f='sub_index * 0.5')})
 WHEN 7 THEN concat_ws('_', 'artifact_intensity', nullif(sub_name, '')) WHEN 8 THEN 'seizure_probability_p14' WHEN 9 THEN CASE WHEN sub_name <> '' THEN 'spike_' || sub_name ELSE 'spike_per_sec' END
 WHEN 10 THEN concat_ws('_', 'coherence_spec', CASE WHEN l IN (4, 6) THEN {CHAIN_SLUG} ELSE 'ch' END, {HZ2.format(f='(sub_index - 1) * 32.0 / 62.0')}) WHEN 11 THEN CASE WHEN l IN (4, 6) THEN 'heart_rate_' || {CHAIN_SLUG} ELSE 'heart_rate' END
 WHEN 12 THEN 'esq_ch' || lpad(CAST(sub_index AS VARCHAR), 2, '0') WHEN 13 THEN 'sleep_stage_display' WHEN 14 THEN 'annotation' WHEN 15 THEN 'artifact_detector_i' || i_group || 's' || sub_index WHEN 16 THEN 'other_i' || i_group || 's' || sub_index
 WHEN 17 THEN concat_ws('_', 'sef_95', CASE WHEN l = 5 THEN 'all' WHEN l = 3 THEN 'asym_hemi' WHEN l = 7 THEN 'anterior' WHEN l = 4 THEN 'f3c3p3' WHEN l = 6 THEN 't4t6o2' ELSE {HEMI_REG} END)
 WHEN 18 THEN 'rhythmic_delta_left_posterior' WHEN 19 THEN concat_ws('_', 'peak_envelope', nullif({HEMI_REG}, '')) WHEN 20 THEN 'other_i' || i_group || 's' || sub_index WHEN 21 THEN 'status_epilepticus_persyst_acns_percent' END"""
NAMES = f"{FAM.strip()}, {NM}, nn AS (SELECT *, {NAME} AS common_name FROM nm)"


@query("C7_subcolumn_names", f"WITH {NAMES} SELECT p_partkey, k, sub_name AS sub_name FROM nn")
def subcolumns(spark, sf):
    return described(spark, sf).select("p_partkey", "k", "sub_name")


@query("C8_common_names", f"WITH {NAMES} SELECT p_partkey, k, common_name FROM nn")
def names(spark, sf):
    return described(spark, sf).select("p_partkey", "k", "common_name")


@query("C9_unique_names", """
WITH c AS (SELECT p_size AS file_id, p_partkey AS col_idx, CASE WHEN p_partkey % 37 = 5 THEN split_part(p_name, ' ', 1) || '__dup2' ELSE split_part(p_name, ' ', 1) END AS n FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY file_id, n ORDER BY col_idx) - 1 AS nth FROM c),
r AS (SELECT DISTINCT file_id, left(n, -6) AS n, TRUE AS two FROM c WHERE ends_with(n, '__dup2'))
SELECT o.file_id, col_idx, CASE WHEN nth = 0 THEN o.n ELSE o.n || '__dup' || CASE WHEN two THEN nth + 2 ELSE nth + 1 END END AS unique_name FROM o LEFT JOIN r ON r.file_id = o.file_id AND r.n = o.n
""")
def unique(spark, sf):
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    c = table(spark, sf, "part").select(F.col("p_size").alias("file_id"), F.col("p_partkey").alias("col_idx"),
                                        F.when(F.col("p_partkey") % 37 == 5, F.concat(word, F.lit("__dup2"))).otherwise(word).alias("common_name"))
    return cl.unique_names(c, ["file_id"]).select("file_id", "col_idx", "unique_name")


PANEL_SQL = "pn AS (SELECT * FROM (VALUES ('research', 257::BIGINT), ('trends', 256), ('trends2', 256), ('mini', 255), ('wide', 250)) p(panel, n_instruments))"
RESOLVE = f"""
{LB.strip()}, {PANEL_SQL}, tp AS (SELECT file_id, max(i_group) - 2 AS n FROM lb GROUP BY 1), pm AS (SELECT file_id, max(panel) AS panel FROM tp JOIN pn ON n = n_instruments GROUP BY 1 HAVING count(*) = 1),
sl AS (SELECT panel, i_group AS pos, 'Inst ' || panel || ' ' || i_group AS name, CASE WHEN i_group % 2 = 0 THEN 'Left Anterior' ELSE 'All 10-20' END AS ch FROM pn, (SELECT unnest(range(200, 258)) AS i_group) WHERE i_group <= n_instruments),
rs AS (SELECT lb.*, pm.panel, n_instruments, sl.name AS sname, CASE WHEN label = 'Comment' THEN 'Comment' END AS iname FROM lb LEFT JOIN pm USING (file_id) LEFT JOIN pn ON pn.panel = pm.panel LEFT JOIN sl ON sl.panel = pm.panel AND sl.pos = lb.i_group),
rr AS (SELECT *, CASE WHEN sname IS NOT NULL THEN 'ordinal' WHEN iname IS NOT NULL THEN 'name' WHEN panel IS NOT NULL AND i_group > n_instruments THEN 'tail' ELSE 'regex' END AS resolution FROM rs)
"""
PANELS = [("research", 257), ("trends", 256), ("trends2", 256), ("mini", 255), ("wide", 250)]


def panel_tables(spark):
    panels = spark.createDataFrame(PANELS, "panel string, n_instruments bigint")
    slots = panels.select("panel", F.explode(F.sequence(F.lit(200), F.col("n_instruments").cast("int"))).alias("position")).withColumns({
        "name": F.concat(F.lit("Inst "), "panel", F.lit(" "), F.col("position").cast("string")),
        "channels": F.when(F.col("position") % 2 == 0, "Left Anterior").otherwise("All 10-20"), "template_family": F.lit(None).cast("string"), "title": F.lit("")})
    instruments = spark.createDataFrame([("Comment", "", None)], "name string, channels string, template_family string")
    return panels, slots, instruments


def resolved(spark, sf):
    return cl.resolve_columns(labelled(spark, sf), ["file_id"], *panel_tables(spark))


@query("C10_panel_resolution", f"WITH {RESOLVE} SELECT file_id, panel FROM pm")
def panel_resolution(spark, sf):
    return cl.resolve_panels(labelled(spark, sf), ["file_id"], panel_tables(spark)[0])


@query("C11_column_resolution", f"""
WITH {RESOLVE} SELECT p_partkey, panel, resolution, coalesce(sname, iname) AS template_name FROM rr
""")
def column_resolution(spark, sf):
    return resolved(spark, sf).select("p_partkey", "panel", "resolution", "template_name")


@query("C12_schema", f"""
WITH {NAMES}, u AS (SELECT *, row_number() OVER (PARTITION BY file_id, common_name ORDER BY col_idx) AS nth FROM nn)
SELECT p_partkey, family, CASE WHEN nth = 1 THEN common_name ELSE common_name || '__dup' || nth END AS unique_name FROM u
""")
def schema(spark, sf):
    return cl.build_dictionary(labelled(spark, sf), ["file_id"]).select("p_partkey", "family", "unique_name")


@query("C13_resolution_mix", f"""
WITH {RESOLVE} SELECT file_id, count(*) FILTER (resolution = 'ordinal') AS n_ordinal, count(*) FILTER (resolution = 'name') AS n_name, count(*) FILTER (resolution = 'regex') AS n_regex, count(*) FILTER (resolution = 'tail') AS n_tail,
 bool_and(resolution IN ('ordinal', 'tail')) AS fully_ordinal FROM rr GROUP BY 1
""")
def mix(spark, sf):
    return cl.resolution_mix(resolved(spark, sf), ["file_id"])


@query("C14_subcolumn_contract", f"""
WITH {LB}, g AS (SELECT file_id, i_group, max(sub_index) AS observed, arg_min(label, struct_pack(a := sub_index, b := label)) AS label FROM lb GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN starts_with(label, 'Boolean LPD+') THEN 'boolean_indicator' WHEN starts_with(label, 'Artifact Intensity') THEN 'artifact_intensity' WHEN starts_with(label, 'Electrode Signal') THEN 'electrode_signal_quality' WHEN starts_with(label, 'aEEG') THEN 'aeeg'
  WHEN starts_with(label, 'Rhythmicity Spec') THEN 'rhythmicity_spectrogram' WHEN starts_with(label, 'Coherence_Spec') THEN 'coherence_spectrogram' WHEN starts_with(label, 'Asymmetry, Rel') THEN 'reasi' WHEN starts_with(label, 'FFT Spec') THEN 'fft_spectrogram'
  WHEN starts_with(label, 'Seizure Prob') THEN 'seizure_probability' WHEN contains(label, 'SEF95') THEN 'fft_edge_sef' WHEN starts_with(label, 'FFT PowerRatio') THEN 'fft_power_ratio' WHEN starts_with(label, 'FFT Power') THEN 'fft_power' WHEN starts_with(label, 'Suppression') THEN 'suppression_ratio'
  WHEN starts_with(label, 'PeakEnv') THEN 'peak_envelope' WHEN starts_with(label, 'Spike Det') THEN 'spike_density' WHEN starts_with(label, 'SleepSt') THEN 'sleep_stages' WHEN starts_with(label, 'Heart') THEN 'heart_rate' WHEN starts_with(label, 'Comment') THEN 'comment' END AS family FROM g),
e AS (SELECT *, CASE family WHEN 'artifact_intensity' THEN 3 WHEN 'electrode_signal_quality' THEN 22 WHEN 'aeeg' THEN 5 WHEN 'rhythmicity_spectrogram' THEN 97 WHEN 'coherence_spectrogram' THEN 63 WHEN 'fft_spectrogram' THEN 40 ELSE 1 END AS expected FROM f WHERE family IS NOT NULL)
SELECT file_id, i_group, observed, family, CAST(expected AS INT) AS expected, CASE WHEN family = 'electrode_signal_quality' THEN 'warn' ELSE 'error' END AS severity FROM e WHERE observed <> expected
""")
def contract(spark, sf):
    return cl.subcolumn_contract(labelled(spark, sf), ["file_id"]).drop("label")


@query("C15_bin_frequency", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (['fft_spectrogram', 'coherence_spectrogram', 'rhythmicity', 'aeeg'])[l_linenumber % 4 + 1] AS f, CAST(l_partkey % 110 AS INT) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN f = 'fft_spectrogram' AND k BETWEEN 1 AND 40 THEN k * 0.5 WHEN f = 'coherence_spectrogram' AND k BETWEEN 1 AND 63 THEN (k - 1) * (32.0 / 62.0) WHEN f = 'rhythmicity' AND k BETWEEN 1 AND 97 THEN pow(1 + (k - 1) / 24.0, 2) END::DOUBLE + 1e-9, 6) AS hz FROM x
""")
def bin_hz(spark, sf):
    fam = F.get(F.array(*[F.lit(f) for f in ("fft_spectrogram", "coherence_spectrogram", "rhythmicity", "aeeg")]), F.col("l_linenumber") % 4)
    df = table(spark, sf, "lineitem").withColumns({"f": fam, "k": F.col("l_partkey") % 110})
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R(bin_frequency(F.col("f"), "k")).alias("hz"))


@query("C16_discard", f"WITH {FAM} SELECT p_partkey, family FROM fm WHERE family <> 'artifact_detector'")
def discard(spark, sf):
    return cl.drop_discarded(described(spark, sf)).select("p_partkey", "family")


@query("C17_power_map", f"""
WITH {LB} SELECT file_id, (['delta', 'theta', 'alpha', 'beta'])[b + 1] AS band, ({_list(LOCS)})[l + 1] AS region_label, arg_max(code, col_idx) AS code FROM lb WHERE k = 0 AND b < 4 AND l < 3 GROUP BY 1, 2, 3
""")
def power_map(spark, sf):
    return cl.power_map(described(spark, sf), ["file_id"])


@query("C18_header_audit", f"""
WITH {NAMES}, n AS (SELECT file_id, common_name, count(*) AS c FROM nn GROUP BY 1, 2), cc AS (SELECT file_id, count(*) FILTER (c > 1) AS n_collisions FROM n GROUP BY 1)
SELECT file_id, count(*) AS n_columns, count(DISTINCT i_group) AS n_instruments, count(*) FILTER (family = 'other') AS n_unclassified, any_value(n_collisions) AS n_collisions,
 count(*) FILTER (k IN (4, 5, 12, 13, 14, 15, 16, 17, 18, 20, 21) OR (k = 1 AND family <> 'fft_power_ratio')) AS n_disagree FROM nn JOIN cc USING (file_id) GROUP BY 1
""")
def header_audit(spark, sf):
    return cl.header_audit(described(spark, sf), ["file_id"]).drop("layout_hash")


@query("C18_layouts", """
WITH c AS (SELECT o_orderpriority AS file_name, CAST(o_orderkey % 3000 AS BIGINT) AS col_idx, 'I' || (o_orderkey % 3000) AS code, CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderkey % 3000 = 17 THEN 'changed' ELSE 'L' || (o_orderkey % 3000) % 7 END AS label FROM orders WHERE TRUE),
u AS (SELECT DISTINCT * FROM c), r AS (SELECT col_idx, code, label FROM u WHERE file_name = '1-URGENT'), n AS (SELECT count(*) AS n FROM r)
SELECT file_name, count(*) AS n_columns, count(*) FILTER (r.code IS NULL OR r.code <> u.code OR r.label <> u.label) AS n_different, count(*) FILTER (r.code IS NULL OR r.code <> u.code OR r.label <> u.label) = 0 AND count(*) = max(n.n) AS identical
FROM u LEFT JOIN r USING (col_idx), n WHERE file_name <> '1-URGENT' GROUP BY 1
""")
def layouts(spark, sf):
    i = F.col("o_orderkey") % 3000
    changed = (F.col("o_orderpriority") == "3-MEDIUM") & (i == 17)
    c = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("file_name"), i.alias("col_idx"), F.concat(F.lit("I"), i.cast("string")).alias("code"),
                                          F.when(changed, "changed").otherwise(F.concat(F.lit("L"), (i % 7).cast("string"))).alias("label")).distinct()
    return cl.layouts_equal(c, "file_name", "1-URGENT")


@query("C19_label_matching", """
WITH ins AS (SELECT p_partkey AS instrument_id, p_name || ' ' || (p_partkey % 30) AS t, p_brand AS ch, CASE WHEN p_partkey % 2 = 0 THEN 1.0 END AS lo FROM part),
cand AS (SELECT DISTINCT instrument_id, unnest([t, t || ', ' || ch, CASE WHEN lo IS NOT NULL THEN t || ', 1 - 4 Hz' END, CASE WHEN lo IS NOT NULL THEN t || ', 1 - 4 Hz, ' || ch END]) AS label FROM ins),
col AS (SELECT p_size AS file_id, p_partkey AS i_group, p_name || ' ' || ((p_partkey + p_partkey % 4) % 30) || CASE WHEN p_partkey % 5 = 1 THEN ', ' || p_brand WHEN p_partkey % 5 = 2 THEN ', 1 - 4 Hz' ELSE '' END AS label FROM part),
h AS (SELECT file_id, i_group, count(instrument_id) AS n, max(instrument_id) AS instrument_id FROM col LEFT JOIN cand USING (label) GROUP BY 1, 2),
s AS (SELECT file_id, i_group, CASE WHEN n = 1 THEN instrument_id END AS instrument_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status FROM h),
c AS (SELECT file_id, instrument_id, count(*) AS k FROM s WHERE status = 'resolved' GROUP BY 1, 2)
SELECT s.file_id, s.i_group, s.instrument_id, s.status, coalesce(k > 1, FALSE) AS claimed_twice FROM s LEFT JOIN c ON c.file_id = s.file_id AND c.instrument_id = s.instrument_id
""")
def label_matching(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    s = lambda c: c.cast("string")
    ins = p.select(k.alias("instrument_id"), F.concat("p_name", F.lit(" "), s(k % 30)).alias("name"), F.lit("").alias("title"), F.col("p_brand").alias("channels"),
                   F.when(k % 2 == 0, 1.0).alias("freq_min"), F.lit(4.0).alias("freq_max"))
    label = F.concat("p_name", F.lit(" "), s((k + k % 4) % 30), F.when(k % 5 == 1, F.concat(F.lit(", "), "p_brand")).when(k % 5 == 2, ", 1 - 4 Hz").otherwise(""))
    cols = p.select(F.col("p_size").alias("file_id"), k.alias("i_group"), F.lit(1).alias("sub_index"), label.alias("label"))
    return cl.match_labels(cols, ["file_id"], cl.candidate_labels(ins))


@query("C20_panel_alignment", f"""
WITH {RESOLVE}, g AS (SELECT file_id, panel, i_group, arg_min(label, struct_pack(a := sub_index, b := label)) AS label, max(sub_index) AS n_sub FROM rr WHERE panel IS NOT NULL GROUP BY 1, 2, 3)
SELECT file_id, i_group, n_sub, sl.name AS template_name, CASE WHEN sl.name IS NOT NULL THEN starts_with(label, sl.name) END AS prefix_ok FROM g LEFT JOIN sl ON sl.panel = g.panel AND sl.pos = g.i_group
""")
def alignment(spark, sf):
    df = resolved(spark, sf).where(F.col("panel").isNotNull())
    return cl.panel_alignment(df, ["file_id"], panel_tables(spark)[1]).select("file_id", "i_group", "n_sub", "template_name", "prefix_ok")


@query("C21_column_map", f"""
WITH {FAM}, t AS (SELECT * FROM (VALUES ('fft_power', 'DOC'), ('aeeg', 'P-COMM')) v(family, tier)),
e AS (SELECT fm.*, CASE WHEN family IN ('fft_power','fft_power_ratio','adr','relative_power','alpha_variability','fft_spectrogram','spectral_edge','asymmetry') THEN 'FFTEngine01' WHEN family = 'suppression_ratio' THEN 'Amplitude01' WHEN family IN ('rhythmicity','rhythmic_delta') THEN 'RhythmicityEngine01'
  WHEN family IN ('artifact_intensity','electrode_quality') THEN 'Artifact01' WHEN family = 'aeeg' THEN 'aEEG01' WHEN family = 'peak_envelope' THEN 'PeakEnvelope01' WHEN family = 'seizure_probability' THEN 'SeizureProbabilityP1401' WHEN family = 'spike_density' THEN 'SpikeDensityV101' END AS engine, coalesce(tier, 'EMP') AS tier2 FROM fm LEFT JOIN t USING (family))
SELECT file_id, family, count(*) AS n_columns, count(DISTINCT i_group) AS n_instruments, max(engine) AS engine, max(tier2) AS evidence_tier FROM e GROUP BY 1, 2
""")
def column_map(spark, sf):
    tiers = spark.createDataFrame([("fft_power", "DOC"), ("aeeg", "P-COMM")], "family string, evidence_tier string")
    return cl.column_map_summary(cl.column_map(described(spark, sf), tiers=tiers), ["file_id"])
