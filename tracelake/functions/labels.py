"""What a column label says: family, frequencies, location, sub-column and name.

Everything is a Column expression generated from the rule tables in
``tracelake.constants``, so a cohort's whole vocabulary is classified by one
projection over ``export_columns``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .numbers import col_of

_NUM = r"(\d+(?:\.\d+)?)"
_RATIO = _NUM + r"\s*-\s*" + _NUM + r"\s*/+\s*" + _NUM + r"\s*-\s*" + _NUM
_RATIO_HZ = _NUM + r"\s*-\s*" + _NUM + r"\s*/\s*\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?\s*Hz"
_RATIO_ANY = r"\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?\s*/\s*\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?"
_RANGE_HZ = _NUM + r"\s*-\s*" + _NUM + r"\s*Hz"
_ONE_ELECTRODE = "(?:" + "|".join(sorted(C.ELECTRODES, key=len, reverse=True)) + ")"
_CHAIN = f"(?i){_ONE_ELECTRODE}(?:-?{_ONE_ELECTRODE})*"
_WINDOW = r"\bTime\s+Avg\s*<\s*\d+\s*,\s*(\d+)\s*>"
_ANY_WINDOW = r"\bTime\s+(Max|Avg|Min)\s*<\s*\d+\s*,\s*(\d+)\s*>"


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Value of the first (pattern, value) rule that matches, else null."""
    out = None
    for pattern, value in rules:
        out = F.when(text.rlike(pattern), F.lit(value)) if out is None else out.when(text.rlike(pattern), F.lit(value))
    return out


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def _near(a: Column, value: float) -> Column:
    return F.abs(a - value) < C.RATIO_TOLERANCE


def ratio_bands(label: str | Column) -> dict[str, Column]:
    t = col_of(label)
    return {n: _number(t, _RATIO, i + 1) for i, n in enumerate(("num_lo", "num_hi", "den_lo", "den_hi"))}


def band_of(lo: Column, hi: Column) -> Column:
    """First band that contains the range, else an empty string."""
    out = None
    for name, (a, b) in C.FREQUENCY_BANDS.items():
        cond = (lo >= a) & (hi <= b)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(""))


def ratio_kind(label: str | Column) -> tuple[Column, Column]:
    """(family, kind) of a power ratio, decided by its denominator."""
    r = ratio_bands(label)
    is_den = lambda lo, hi: _near(r["den_lo"], lo) & _near(r["den_hi"], hi)
    band = band_of(r["num_lo"], r["num_hi"])
    family = (F.when(is_den(1, 30), "relative_power").when(is_den(1, 20), "alpha_variability").when(is_den(1, 4), "adr").otherwise("fft_power_ratio"))
    delta = F.when(_near(r["num_lo"], 8), "adr").when(_near(r["num_lo"], 4), "tdr").otherwise("adr")
    kind = (F.when(is_den(1, 30), F.when(band == "", "broadband").otherwise(band)).when(is_den(1, 20), "rav").when(is_den(1, 4), delta).otherwise(""))
    return family, kind


def family_of(label: str | Column) -> Column:
    """Feature family of a label; power ratios are re-routed by their denominator."""
    t = col_of(label)
    word = first_match(t, [(p, f) for f, p in C.FAMILY_PATTERNS])
    power = F.coalesce(word.isin(C.POWER_FAMILIES), F.lit(True))
    routed = t.rlike("FFT[_ ]PowerRatio") | (t.rlike(_RATIO_ANY) & power)
    by_ratio, _ = ratio_kind(t)
    return F.when(routed & (by_ratio != "fft_power_ratio"), by_ratio).otherwise(F.coalesce(word, F.lit("other")))


def with_family(df: DataFrame, out: str = "family", label: str = "label") -> DataFrame:
    """:func:`family_of` in two projections, so that no pattern runs twice."""
    t = F.col(label)
    by_ratio, _ = ratio_kind(t)
    staged = df.withColumns({"_word": first_match(t, [(p, f) for f, p in C.FAMILY_PATTERNS]), "_ratio": by_ratio,
                             "_is_ratio": t.rlike(_RATIO_ANY), "_named": t.rlike("FFT[_ ]PowerRatio")})
    power = F.coalesce(F.col("_word").isin(C.POWER_FAMILIES), F.lit(True))
    routed = (F.col("_named") | (F.col("_is_ratio") & power)) & (F.col("_ratio") != "fft_power_ratio")
    return staged.withColumn(out, F.when(routed, F.col("_ratio")).otherwise(F.coalesce("_word", F.lit("other")))).drop("_word", "_ratio", "_is_ratio", "_named")


def contract_family(label: str | Column) -> Column:
    return first_match(col_of(label), [(f"(?i){p}", f) for p, f in C.CONTRACT_PATTERNS])


def frequency_range(label: str | Column) -> tuple[Column, Column]:
    """(low, high) in Hz; the numerator of a ratio; null when the label has none."""
    t = col_of(label)
    lo = F.coalesce(_number(t, _RATIO_HZ, 1), _number(t, _RANGE_HZ, 1))
    hi = F.coalesce(_number(t, _RATIO_HZ, 2), _number(t, _RANGE_HZ, 2))
    return lo, hi


def normalize_electrodes(label: str | Column) -> Column:
    out = col_of(label)
    for old, new in C.RENAMED_ELECTRODES.items():
        out = F.regexp_replace(out, rf"\b{old}\b", new)
    return out


def tail_of(label: str | Column) -> Column:
    t = col_of(label)
    return F.when(t.contains(","), F.trim(F.element_at(F.split(t, ","), -1))).otherwise(t)


def _word_in(label: Column, words: dict[str, str]) -> Column:
    out = None
    for text in (tail_of(label), label):
        for word, value in words.items():
            out = F.when(text.contains(word), F.lit(value)) if out is None else out.when(text.contains(word), F.lit(value))
    return out.otherwise(F.lit(""))


def hemisphere_of(label: str | Column) -> Column:
    return _word_in(col_of(label), {"Left": "left", "Right": "right"})


def region_word(label: str | Column) -> Column:
    return _word_in(col_of(label), {"Anterior": "anterior", "Posterior": "posterior", "Hemisphere": "hemisphere"})


def electrode_of(label: str | Column) -> Column:
    """Electrode or chain from the label's tail, else from the whole label; hyphens dropped."""
    t = col_of(label)
    tail = F.regexp_extract(F.regexp_replace(tail_of(t), r"^\.+", ""), _CHAIN, 0)
    whole = F.regexp_extract(t, _CHAIN, 0)
    return F.replace(F.when(tail != "", tail).otherwise(whole), F.lit("-"), F.lit(""))


def chain_side(electrode: str | Column) -> Column:
    """Side of a known electrode chain, null for anything else."""
    e = col_of(electrode)
    left = [k for k, v in C.CHAIN_REGIONS.items() if v[0] == "left"]
    right = [k for k, v in C.CHAIN_REGIONS.items() if v[0] == "right"]
    return F.when(e.isin(left), "left").when(e.isin(right), "right")


def chain_region(electrode: str | Column) -> Column:
    e, out = col_of(electrode), None
    for k, (_, region) in C.CHAIN_REGIONS.items():
        out = F.when(e == k, F.lit(region)) if out is None else out.when(e == k, F.lit(region))
    return out


def slug(*parts: Column) -> Column:
    """Non-empty parts joined by ``_``, lower case, only ``[a-z0-9_]``, runs collapsed."""
    kept = [F.when(p != "", p) for p in parts]
    text = F.regexp_replace(F.lower(F.concat_ws("_", *kept)), r"[^a-z0-9_]", "_")
    return F.regexp_replace(F.regexp_replace(text, r"_+", "_"), r"^_|_$", "")


def identifier(name: str | Column) -> Column:
    """Label to a column identifier for storage."""
    t = col_of(name)
    for old, new in ((", ", "_"), (",", "_"), (" - ", "_"), (" ", "_"), ("(", ""), (")", ""), ("/", "_over_"), (".", "_"),
                     ("Hz", "hz"), ("%", "pct"), ("<", "lt"), (">", "gt")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-zA-Z0-9_]", "_"), r"_+", "_")
    t = F.when(t.rlike(r"^\d"), F.concat(F.lit("x"), t)).otherwise(t)
    return F.regexp_replace(F.lower(t), r"_+$", "")


def frequency_slug(family: str, sub: Column) -> Column:
    """``9_00hz`` for a spectrogram bin, the plain index outside the axis."""
    from ..operators.retrieve import bin_frequency

    f = bin_frequency(family, sub)
    text = F.concat(F.replace(F.format_string("%.2f", f), F.lit("."), F.lit("_")), F.lit("hz"))
    return F.when(f.isNotNull(), text).otherwise(sub.cast("string"))


def _any_word(text: Column, words: list[str]) -> Column:
    return text.rlike(r"\b(?:" + "|".join(words) + r")\b")


def _template_subcolumn(family: Column, label: Column, name: Column) -> Column:
    """Sub-column identity that only the template's expression carries (null: none)."""
    stage = F.regexp_extract(F.trim(name), r"^=\s*(\d+)\s*<", 1)
    sleep = F.when(stage != "", F.concat(F.lit("stage_"), stage)).when(F.lower(label).contains("sleep-wake"), "wake_state")
    kind = F.lower(F.regexp_extract(name, r"\b(Probability|Detections)\]?\s*$", 1))
    window = F.concat(F.lit("_"), F.lower(F.regexp_extract(name, _ANY_WINDOW, 1)), F.regexp_extract(name, _ANY_WINDOW, 2), F.lit("s"))
    seizure = F.when(kind != "", F.concat(kind, F.when(name.rlike(_ANY_WINDOW), window).otherwise("")))
    head = F.when(name.contains("AND NOT["), F.substring_index(name, "AND NOT[", 1)).otherwise(name)
    l, r = _any_word(head, C.SPIKE_LEFT), _any_word(head, C.SPIKE_RIGHT)
    side = F.when(name.contains("SpikeGen"), "generalized").when(l & r, "bilateral").when(l, "left").when(r, "right")
    suffix = F.when(name.contains(" AND "), "_indicator").when(name.contains(">="), "_threshold").otherwise("")
    spike = F.concat(side, suffix)
    hl, hr = head.contains("Left"), head.contains("Right")
    rda = F.when(name.contains("AND NOT["), F.when(hl & ~hr, "left").when(hr & ~hl, "right")).when(hl & hr, "bilateral")
    return (F.when(family == "sleep", sleep).when(family == "seizure_probability", seizure)
            .when(family == "spike_density", spike).when(family == "rda", F.coalesce(rda, F.lit(""))))


def _schema_subcolumn(family: Column, sub: Column) -> Column:
    out = F.lit(None).cast("string")
    for fam, names in C.SUBCOLUMN_NAMES.items():
        out = F.when(family == fam, F.get(F.array(*[F.lit(n) for n in names]), (sub - 1).cast("int"))).otherwise(out)
    return out


def _instrument_subcolumn(group: Column, sub: Column) -> Column:
    out = F.lit(None).cast("string")
    for g, names in C.INSTRUMENT_SUBCOLUMNS.items():
        out = F.when(group == g, F.get(F.array(*[F.lit(n) for n in names]), (sub - 1).cast("int"))).otherwise(out)
    return out


def _count_words(text: Column, words: list[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + text.rlike(rf"\b{w}\b").cast("int")
    return total


def _label_subcolumn(family: Column, label: Column) -> Column:
    low = F.lower(label)
    hemi, reg, elec = hemisphere_of(label), region_word(label), electrode_of(label)

    def first_in(words: dict[str, str]) -> Column:
        out = None
        for w, v in words.items():
            out = F.when(label.contains(w), F.lit(v)) if out is None else out.when(label.contains(w), F.lit(v))
        return out.otherwise(F.lit(""))

    parts = F.concat_ws("_", *[F.when(p != "", p) for p in (first_in(C.ASYMMETRY_BANDS), first_in(C.ASYMMETRY_REGIONS))])
    index = F.when(label.contains("EASI") & (parts != ""), F.concat(F.when(label.contains("REASI"), "reasi_").otherwise("easi_"), parts))
    rate = F.when(low.contains("per sec"), "_per_sec").when(low.contains("per 10"), "_per_10s").otherwise("")
    lc, rc = _count_words(low, C.SPIKE_LEFT_LABEL), _count_words(low, C.SPIKE_RIGHT_LABEL)
    spike = F.when(low.contains("spikegen") | low.contains("spike gen"), F.concat(F.lit("generalized"), rate))
    for kw in ("burst bilateral", "all foci", "generalized", "vertex", "threshold"):
        spike = spike.when(low.contains(kw), F.concat(F.lit(kw.replace(" ", "_")), rate))
    spike = spike.when(low.contains("spike") & (lc > rc), F.concat(F.lit("left"), rate)).when(low.contains("spike") & (rc > lc), F.concat(F.lit("right"), rate))
    for kw in ("left", "right", "burst"):
        spike = spike.when(low.contains(kw), F.concat(F.lit(kw), rate))
    power = F.when(elec != "", F.lower(elec)).when((hemi != "") & (reg != ""), F.concat_ws("_", hemi, reg))
    rda = (F.when(low.contains("blue") | low.contains("left"), "left").when(low.contains("red") | low.contains("right"), "right")
           .when(low.contains("green") | low.contains("gen"), "generalized"))
    flag = r"(?i)Boolean\s+([LR])([APR])D\+?"
    side = F.when(F.lower(F.regexp_extract(label, flag, 1)) == "l", "left").otherwise("right")
    area = F.lower(F.regexp_extract(label, flag, 2))
    quadrant = F.when(label.rlike(flag), F.concat_ws("_", side, F.when(area == "a", "anterior").when(area == "p", "posterior").otherwise("hemisphere")))
    return (F.when(family == "asymmetry", index).when(family == "sleep", "stage_display").when(family == "spike_density", spike)
            .when(family.isin("fft_power", "fft_power_ratio", "alpha_variability"), power).when(family == "rda", rda)
            .when(family == "rhythmic_delta", quadrant).when(family == "aeeg", F.when(hemi != "", hemi)))


def subcolumn_name(group: str | Column, sub: str | Column, label: str | Column, family: str | Column,
                   template: str | Column | None = None) -> Column:
    """Identity of a sub-column: template expression, then fixed layout, then label."""
    g, s, t, f = col_of(group), col_of(sub), col_of(label), col_of(family)
    schema, by_label, by_group = _schema_subcolumn(f, s), _label_subcolumn(f, t), _instrument_subcolumn(g, s)
    if template is None:
        return F.coalesce(schema, by_group, by_label, F.lit(""))
    name = col_of(template)
    known = name.isNotNull() & (name != "")
    from_template = F.when(known, _template_subcolumn(f, t, name))
    return F.coalesce(from_template, schema, F.when(name.isNull(), by_group), by_label, F.lit(""))


def with_common_name(df: DataFrame, template: str | None = None) -> DataFrame:
    """Add ``common_name``, the canonical name by family; only ``[a-z0-9_]``.

    Reads label, family, sub_index, sub_name, band, hemisphere, region, electrode,
    freq_min, freq_max, i_group and code. Shared parts are computed in earlier
    projections so that the final choice stays a flat expression.
    """
    t, fam, k, sub, hemi, reg, elec = (F.col(c) for c in ("label", "family", "sub_index", "sub_name", "hemisphere", "region", "electrode"))
    L = F.lit

    def _or(x: Column, y: Column) -> Column:
        return F.when(x != "", x).otherwise(y)

    _, kind = ratio_kind(t)
    name = F.coalesce(F.col(template), L("")) if template else L("")
    df = df.withColumns({
        "_low": F.lower(t), "_tail": F.lower(tail_of(t)), "_kind": kind, "_tname": name, "_place": slug(hemi, reg),
        "_hz": F.when(fam == "rhythmicity", frequency_slug("rhythmicity", k)).when(fam == "coherence_spectrogram", frequency_slug("coherence_spectrogram", k))
        .otherwise(frequency_slug("fft_spectrogram", k))})
    low, tail, kind, name, place, hz = (F.col(c) for c in ("_low", "_tail", "_kind", "_tname", "_place", "_hz"))
    secs = F.regexp_extract(name, _WINDOW, 1).try_cast("int")
    df = df.withColumns({
        "_secs": secs, "_chain": F.when(elec != "", F.lower(elec)).otherwise(place),
        "_whole": tail.contains("all 10-20") | (F.trim(tail) == "all"), "_asym": low.contains("asym"),
        "_win": F.when(name.rlike(_ANY_WINDOW), F.concat(L("_"), F.lower(F.regexp_extract(name, _ANY_WINDOW, 1)), F.regexp_extract(name, _ANY_WINDOW, 2), L("s"))).otherwise(""),
        "_last": F.regexp_extract(t, r"(\d+)\s*$", 1)})
    secs, chain, whole, asym = F.col("_secs"), F.col("_chain"), F.col("_whole"), F.col("_asym")
    running = low.contains("running")
    two_min = F.when(secs.isNotNull(), secs == 120).otherwise((t.contains("2 min") & running) | t.contains("<0,120>"))
    one_min = F.when(secs.isNotNull(), secs == 64).otherwise((t.contains("64 sec") & running) | t.contains("<0,64>"))
    average = F.when(two_min, "2m").when(one_min, "64s").when(secs.isNotNull(), F.concat(secs.cast("string"), L("s"))).otherwise("")
    df = df.withColumns({"_avg": average, "_here": F.when(elec != "", F.lower(elec)).when(whole, "all").otherwise(place)})
    avg, here = F.col("_avg"), F.col("_here")
    df = df.withColumn("_sfx", F.when(asym & (here != ""), "_asym").otherwise(""))
    sfx = F.col("_sfx")

    power = F.concat(slug(F.when(avg != "", F.concat(L("fft_avg"), avg)).otherwise("fft"), _or(F.col("band"), L("power")), here),
                     F.when(asym, "_asym").otherwise(""))
    rel = F.concat(slug(L("rel"), F.when(kind != "broadband", kind).otherwise(""), here), F.when(asym, "_asym").otherwise(""))
    short = F.when(avg == "2m", "_avg").when(avg == "64s", "_avg64s").otherwise("")
    adr = F.concat(slug(F.concat(F.when(kind.isin("adr", "tdr"), kind).otherwise("adr"), short), here), sfx)
    rav = F.concat(slug(F.when(avg == "2m", "rav_avg").when(avg != "", F.concat(L("rav_avg"), avg)).otherwise("rav"), here), sfx)

    method = F.when(low.contains("acns"), "acns").when(low.contains("advanced"), "advanced").when(low.contains("combined"), "combined").otherwise("")
    output = F.when(low.contains("percent"), "percent").when(low.contains("binary"), "binary").otherwise("")
    status = slug(L(f"status_epilepticus_{C.NATIVE_TAG}"), method, output, F.when((method == "") & (output == ""), F.col("_last")).otherwise(""))
    unit = F.when(low.contains("category"), "category").when(low.contains("percent"), "percentage").otherwise("")
    burden = slug(L(f"seizure_burden_{C.NATIVE_TAG}"), unit, F.when(unit == "", F.col("_last")).otherwise(""))
    detection = F.when(name.contains("SeizureProbabilityP14"), F.concat(L("seizure_detection_p14"), F.col("_win"))).otherwise(
        slug(L("seizure"), _or(sub, L("detection"))))
    df = df.withColumn("_spike", F.when(sub != "", slug(L("spike"), sub)).otherwise("spike"))
    spike = F.col("_spike")
    rate = F.when(low.contains("per sec"), "_per_sec").when(low.rlike("per 10s|per ten sec|per 10 sec"), "_per_10s").otherwise("")
    spike = F.when(spike.endswith("per_sec") | spike.endswith("per_10s"), spike).otherwise(F.concat(spike, rate))

    asym_group = F.lower(F.regexp_extract(t, r"Asym\s+(\w+)", 1))
    asymmetry = F.when(sub != "", slug(L("asymmetry"), sub)).otherwise(slug(L("asymmetry_spec"), _or(chain, asym_group), hz))
    sef = _or(F.regexp_extract(t, r"SEF\s*(\d+)", 1), F.regexp_extract(t, r"FFT_Edge\s+(\d+)", 1))
    sef_place = (F.when(tail.contains("all 10-20") | (tail == "all"), "all").when(tail.startswith("asym "), slug(L("asym"), F.trim(F.substring(tail, 6, 1000))))
                 .when((hemi != "") & (reg != ""), place).when(tail != "", slug(tail)).otherwise("all"))
    suppression = (F.when(tail.contains("all"), "suppression_all").when((reg != "") & (reg != "hemisphere"), slug(L("suppression"), hemi, reg))
                   .otherwise(slug(L("suppression"), hemi)))
    ordinal = F.regexp_extract(t, r"\bHeart\s*Rate\s*(\d+)\s*$", 1)
    heart = (F.when(elec != "", slug(L("heart_rate"), F.lower(elec))).when((ordinal != "") & (ordinal != "1"), F.concat(L("heart_rate_"), ordinal))
             .otherwise("heart_rate"))

    measure = F.when(t.contains("delta freq"), "delta_freq").when(t.contains("delta power"), "delta_power").otherwise("sum")
    threshold = F.regexp_extract(t, r"^Threshold\s+(\S+),", 1)
    threshold = F.when(threshold != "", F.replace(F.lower(threshold), L(">="), L("_gte_"))).otherwise(F.col("i_group").cast("string"))
    step, pos = F.floor((k - 1) / 4).cast("int"), ((k - 1) % 4).cast("int")
    freqpow = F.when(k.between(1, 16), F.concat_ws("_", F.get(F.array(*[L(b) for b in C.FREQPOW_BANDS]), step), F.get(F.array(*[L(v) for v in C.FREQPOW_VALUES]), pos))).otherwise(
        F.concat(L("sub"), k.cast("string")))
    rhythmicity = (F.when(t.startswith("SumValues"), slug(L("rhythmicity_sum"), chain, measure))
                   .when(t.startswith("Threshold"), slug(L("rhythmicity_thresh"), chain, threshold))
                   .when(t.contains("FreqPow"), slug(L("rhythmicity_freqpow"), chain, freqpow)).otherwise(slug(L("rhythmicity"), chain, hz)))
    pair = F.when(elec != "", F.lower(elec)).otherwise("ch")
    plain = lambda c: F.replace(F.regexp_replace(F.col(c).cast("string"), r"\.0$", ""), L("."), L("_"))
    span = F.when(F.col("freq_min").isNotNull() & F.col("freq_max").isNotNull(), F.concat(plain("freq_min"), L("_"), plain("freq_max"), L("hz"))).otherwise("broadband")
    coherence = F.when(F.replace(low, L(" "), L("_")).contains("coherence_avg"), slug(L("coherence_avg"), pair, span)).otherwise(slug(L("coherence_spec"), pair, hz))

    chosen = (
        F.when(fam == "fft_power", power).when(fam == "relative_power", rel).when(fam == "adr", adr)
        .when(fam == "alpha_variability", rav).when(fam == "fft_power_ratio", slug(L("ratio"), here))
        .when(fam == "artifact_intensity", slug(L("artifact_intensity"), sub))
        .when(fam == "electrode_quality", F.concat(L("esq_ch"), F.lpad(k.cast("string"), 2, "0")))
        .when(fam == "status_epilepticus", status).when(fam == "seizure_burden", burden).when(fam == "rda", slug(L("rda"), sub))
        .when(fam == "peak_envelope", slug(L("peak_envelope"), hemi, reg)).when(fam == "seizure_probability", slug(L("seizure_probability_p14"), sub))
        .when(fam == "seizure_detection", detection).when(fam == "seizure_notification", "seizure_notification_p14")
        .when(fam == "spike_density", spike).when(fam == "sleep", F.when(sub != "", slug(L("sleep"), sub)).otherwise("sleep_stage"))
        .when(fam == "aeeg", slug(L("aeeg"), _or(hemi, reg), sub)).when(fam == "asymmetry", asymmetry)
        .when(fam == "spectral_edge", slug(L("sef"), sef, sef_place)).when(fam == "suppression_ratio", suppression).when(fam == "heart_rate", heart)
        .when(fam == "rhythmic_delta", F.when(sub != "", slug(L("rhythmic_delta"), sub)).otherwise("rhythmic_delta"))
        .when(fam == "rhythmicity", rhythmicity).when(fam == "fft_spectrogram", slug(L("fft_spec"), chain, hz))
        .when(fam == "coherence_spectrogram", coherence).when(fam == "annotation", "annotation").when(fam == "time_display", "time_display")
        .otherwise(slug(fam, F.replace(F.col("code"), L("_"), L("s"))))
    )
    helpers = [c for c in df.columns if c in {"_low", "_tail", "_kind", "_tname", "_place", "_hz", "_secs", "_chain", "_whole", "_asym", "_win", "_last", "_avg",
                                              "_here", "_sfx", "_spike"}]
    return df.withColumn("common_name", chosen).drop(*helpers)
