"""Read queries: projection, down-sampling, spectrograms, overlays, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import join_keys

# Bins expected per spectrogram family and regions asked for by view.
EXPECTED_BINS = {"fft_spectrogram": 40, "asymmetry": 40, "rhythmicity": 97, "coherence_spectrogram": 63}


def select_families(long: DataFrame, column_dict: DataFrame, families: list[str], extra: Column | None = None,
                    column: str = "column", name: str = "common_name", family: str = "family") -> DataFrame:
    """Values of the columns whose family is asked for (plus ``extra`` by name)."""
    wanted = F.col(family).isin(families)
    if extra is not None:
        wanted = wanted | extra
    names = column_dict.where(wanted).select(F.col(name).alias(column)).distinct()
    return long.join(names, column, "left_semi")


def project_columns(df: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """Column-pruned read: only ids and the named columns that exist reach the scan."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*ids, *[have[n.lower()] for n in names if n.lower() in have])


def filter_names(column_dict: DataFrame, text: str, name: str = "common_name") -> DataFrame:
    return column_dict.where(F.lower(F.col(name)).contains(text.lower()))


def bucket_of(row: str, total: str, points: int) -> Column:
    """Bucket ``i`` holds rows ``floor(i*n/p) .. floor((i+1)*n/p) - 1``, in integers."""
    r, n = F.col(row), F.col(total)
    return F.when(n <= points, r).otherwise(F.floor(((r + 1) * points - 1) / n)).cast("bigint")


def _bounds(bucket: Column, total: Column, points: int) -> tuple[Column, Column]:
    start = F.floor(bucket * total / points)
    end = F.least(F.floor((bucket + 1) * total / points), total)
    return start, end


def midpoint_rows(df: DataFrame, points: int, row: str = "row_idx", total: str = "n_rows") -> DataFrame:
    """One row per bucket, the middle one; all rows if there are no more than ``points``."""
    start, end = _bounds(F.col("bucket"), F.col(total), points)
    mid = F.floor((start + end) / 2)
    return df.withColumn("bucket", bucket_of(row, total, points)).where((F.col(total) <= points) | (F.col(row) == mid))


def bucket_peaks(df: DataFrame, keys: list[str], values: list[str], points: int, row: str = "row_idx", total: str = "n_rows") -> DataFrame:
    """Largest present value per bucket."""
    return df.withColumn("bucket", bucket_of(row, total, points)).groupBy(*keys, "bucket").agg(*[F.max(v).alias(v) for v in values])


def round_bucket(row: str, total: str, points: int) -> Column:
    """Bucket whose rounded start ``round(i*n/p)`` is the last one not after the row."""
    r, n = F.col(row), F.col(total)
    return F.floor((F.lit(points) * (2 * r + 1) - 1) / (2 * n)).cast("bigint")


def peak_rows(df: DataFrame, keys: list[str], value: str, points: int, row: str = "row_idx", total: str = "n_rows") -> DataFrame:
    """Per bucket the first row with the highest value (missing as -1), then the last row."""
    n = F.col(total)
    place = F.when(n <= points, F.col(row)).otherwise(F.least(round_bucket(row, total, points), F.lit(points - 1)))
    best = F.max_by(F.struct(row, total, value), F.struct(F.coalesce(F.col(value), F.lit(-1.0)), -F.col(row)))
    kept = df.withColumn("bucket", place).groupBy(*keys, "bucket").agg(best.alias("_b")).select(*keys, "_b.*")
    last = df.where(F.col(row) == F.col(total) - 1).select(*keys, row, total, value)
    return kept.unionByName(last).distinct()


def stride_rows(df: DataFrame, points: int, row: str = "row_idx", total: str = "n_rows") -> DataFrame:
    """Rows ``round(i*n/p)`` and the last row, picked by arithmetic on the row number."""
    r, n = F.col(row), F.col(total)
    i = round_bucket(row, total, points)
    hit = (F.floor((2 * i * n + points) / F.lit(2 * points)) == r) & (i < points)
    return df.where((n <= points) | hit | (r == n - 1))


def bin_frequency(family: str | Column, k: str | Column) -> Column:
    """Centre frequency of bin ``k`` (from 1): k/2; (k-1)*32/62; (1+(k-1)/24)^2."""
    fam = F.lit(family) if isinstance(family, str) else family
    k = F.col(k) if isinstance(k, str) else k
    return (F.when(fam.isin("fft_spectrogram", "asymmetry", "asymmetry_spectrogram") & k.between(1, 40), k * 0.5)
            .when((fam == "coherence_spectrogram") & k.between(1, 63), (k - 1) * (32.0 / 62.0))
            .when(fam.isin("rhythmicity", "rhythmicity_spectrogram") & k.between(1, 97), F.pow(1.0 + (k - 1) / 24.0, F.lit(2.0))))


def spectrogram_instrument(columns: DataFrame, keys: list[str], family: str, hemisphere: str | None = None,
                           prefer: str | None = None) -> DataFrame:
    """The instrument of a family whose width is closest to the expected one.

    ``columns``: (keys, i_group, sub_index, family, hemisphere, label). Instruments
    whose label holds ``prefer`` go first.
    """
    found = columns.where(F.col("family") == family)
    if hemisphere:
        found = found.where(F.col("hemisphere") == hemisphere)
    liked = F.max(F.lower("label").contains(prefer.lower()).cast("int")) if prefer else F.lit(0)
    groups = found.groupBy(*keys, "i_group").agg(F.count(F.lit(1)).alias("width"), liked.alias("_liked"))
    rank = F.struct(-F.col("_liked"), F.abs(F.col("width") - EXPECTED_BINS[family]), F.col("i_group"))
    return groups.groupBy(*keys).agg(F.min_by(F.struct("i_group", "width"), rank).alias("_g")).select(*keys, "_g.*")


def spectrogram_long(df: DataFrame, ids: list[str], array: str, family: str) -> DataFrame:
    """(ids, bin, freq_hz, value) with bins in order from 1."""
    out = df.select(*ids, F.posexplode(array).alias("_p", "value"))
    return out.select(*ids, (F.col("_p") + 1).alias("bin"), bin_frequency(family, F.col("_p") + 1).alias("freq_hz"), F.col("value").cast("double").alias("value"))


def bin_boundaries(bins: DataFrame, keys: list[str], start: str = "bin_start", end: str = "bin_end") -> DataFrame:
    return bins.select(*keys, F.col(start).alias("edge")).union(bins.select(*keys, F.col(end).alias("edge"))).distinct()


def tidy_metrics(bins: DataFrame, ids: list[str], columns: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """Wide bin columns ``{feature}_{stat}`` as (ids, metric, value), codes renamed."""
    names = names or {}
    suffixes = ["_log_mean", "_log_sd", "_median", "_mean", "_sd", "_iqr", "_min", "_max", "_n"]
    packed = []
    for c in columns:
        suffix = next((s for s in suffixes if c.endswith(s)), None)
        if suffix:
            base = c[: -len(suffix)]
            packed.append(F.struct(F.lit(names.get(base, base) + suffix).alias("metric"), F.col(c).cast("double").alias("value")))
    return bins.select(*ids, F.inline(F.array(*packed)))


def list_patients(patients: DataFrame, membership: DataFrame | None, keys: list[str], study: str | None = None, study_col: str = "study") -> DataFrame:
    if study is None or membership is None:
        return patients
    return patients.join(membership.where(F.col(study_col) == study).select(*keys).distinct(), keys, "left_semi")


def compare(patients: DataFrame, keys: list[str], metrics: dict[str, Column], medians: DataFrame, feature: str = "feature",
            bin_label: str = "bin_label", median: str = "median") -> DataFrame:
    """Patient-level metrics and per-bin medians in one tidy table, missing medians dropped."""
    pack = F.array(*[F.struct(F.lit(n).alias("metric_name"), c.cast("double").alias("value"), F.lit(None).cast("string").alias("bin_label")) for n, c in metrics.items()])
    top = patients.select(*keys, F.inline(pack))
    low = medians.where(F.col(median).isNotNull()).select(
        *keys, F.concat(F.col(feature), F.lit(" (median)")).alias("metric_name"), F.col(median).cast("double").alias("value"), F.col(bin_label).alias("bin_label"))
    return top.unionByName(low)


def chosen_spectrogram(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    return join_keys(rows, chosen.select(*keys, "i_group"), [*keys, "i_group"], "left_semi")
