"""Joins and merges: overlapping segments, covariates, cohort filters, best run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import index_rows, join_keys, strip_layout


def to_long(df: DataFrame, ids: list[str], columns: list[str], name: str = "column", value: str = "value",
            keep_nulls: bool = True) -> DataFrame:
    """Wide to long by an inline array, narrow and inside one projection."""
    pack = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    long = df.select(*ids, F.inline(pack))
    return long if keep_nulls else long.where(F.col(value).isNotNull())


def first_per_clock(df: DataFrame, keys: list[str], clock: str, order: str, values: list[str]) -> DataFrame:
    """Within a segment, the first row of every clock value."""
    picked = F.min_by(F.struct(*values), order)
    return df.groupBy(*keys, clock).agg(picked.alias("_s")).select(*keys, clock, "_s.*")


def segment_density(long: DataFrame, patient: list[str], segment: str, column: str = "column", value: str = "value") -> DataFrame:
    """Non-null count of every column in every segment (after de-duplication of clocks)."""
    return long.groupBy(*patient, segment, column).agg(F.count(value).alias("density"))


def merge_segments(long: DataFrame, patient: list[str], segment: str, clock: str, column: str = "column", value: str = "value") -> DataFrame:
    """One value per (patient, clock, column): the densest segment wins, others fill.

    ``long`` holds de-duplicated rows with nulls kept. Equal density goes to the
    lower segment. The winner is a mergeable aggregate, so nothing is ranked in a window.
    """
    density = segment_density(long, patient, segment, column, value)
    ranked = join_keys(long, density, [*patient, segment, column])
    order = F.struct((-F.col("density")).alias("d"), F.col(segment).alias("s"))
    return ranked.groupBy(*patient, clock, column).agg(
        F.min_by(value, F.when(F.col(value).isNotNull(), order)).alias(value))


def merge_by_position(df: DataFrame, patient: list[str], segment: str, order: list[str], columns: list[str]) -> DataFrame:
    """Merge segments that carry no clock: aligned by row position, padded to the row total.

    Position ``p`` of every segment meets position ``p`` of the others; positions
    from the longest segment's length up to the sum of all rows stay null.
    """
    placed = index_rows(df, [*patient, segment], order, row="_pos", total="_len")
    sizes = placed.groupBy(*patient, segment).agg(F.count(F.lit(1)).alias("_len2"))
    totals = sizes.groupBy(*patient).agg(F.sum("_len2").alias("_total"))
    long = to_long(strip_layout(placed), [*patient, segment, "_pos"], columns)
    merged = merge_segments(long, patient, segment, "_pos")
    wide = merged.groupBy(*patient, "_pos").pivot("column", columns).agg(F.first("value"))
    block = 1 << 16
    starts = totals.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_total") - 1, F.lit(block).cast("bigint"))))
    frame = starts.repartition(*patient, "_from").withColumn("_pos", F.explode(F.sequence(
        F.col("_from"), F.least(F.col("_from") + block, F.col("_total")) - 1)))
    return join_keys(frame.select(*patient, "_pos"), wide, [*patient, "_pos"], "left").withColumnRenamed("_pos", "row_idx")


def winning_entry(entries: DataFrame, density: DataFrame, patient: list[str], segment: str, column: str, fields: list[str]) -> DataFrame:
    """Schema entry of the densest contributor of each column."""
    joined = join_keys(entries, density, [*patient, segment, column])
    order = F.struct((-F.col("density")).alias("d"), F.col(segment).alias("s"))
    return joined.groupBy(*patient, column).agg(
        F.min_by(F.struct(segment, *fields), order).alias("_e")).select(*patient, column, "_e.*")


def attach(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return join_keys(df, other, keys, how)


def with_default_reference(df: DataFrame, clinical: DataFrame, keys: list[str], own: str, clinical_time: str) -> DataFrame:
    """Explicit reference time, else the clinical one."""
    return join_keys(df, clinical.select(*keys, clinical_time), keys, "left").withColumn(own, F.coalesce(own, clinical_time))


def members(df: DataFrame, cohort: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(cohort.select(*keys).distinct(), keys, "left_semi")


def orphans(df: DataFrame, cohort: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(cohort.select(*keys).distinct(), keys, "left_anti")


def prefix_matches(df: DataFrame, ids: DataFrame, name: str, id_col: str) -> DataFrame:
    """Names equal to an id or starting with ``id_``, as one equi-join.

    A name yields its own text and every prefix that ends before an underscore.
    """
    parts = F.split(F.col(name), "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    tagged = df.withColumn("_id", F.explode(F.array_distinct(prefixes)))
    return tagged.join(ids, F.col("_id") == F.col(id_col)).drop("_id")


def best_run(runs: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """The run with the highest rank tuple per key, as a mergeable aggregate."""
    rest = [c for c in runs.columns if c not in keys]
    order = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_b")).select(*keys, "_b.*")
