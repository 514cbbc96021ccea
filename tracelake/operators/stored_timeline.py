"""Timelines that are written once, in the layout all ordered steps need.

Row numbers, neighbours, runs and medians of recordings all want the rows of a recording
together and in order. Instead of shuffling and counting for every step, the rows are
written as a table bucketed by recording (and slice, where a recording is long enough to be
cut) and sorted by row number. Steps over it then need no exchange, and as the table knows
its own slices, no counting job.

* ``recording_key`` (``REC``) names a recording: a text made of its keys that is never null, so joins are plain
  equalities whose hashes are those of the buckets.
* ``rows``: REC, the keys, the given columns, row_idx, n_rows, start_ts, step_prev and
  step_next (seconds), and the slice columns of :mod:`.ordered` if any recording is cut.
* ``recordings``: the catalogue, one row per recording, bucketed alike: REC, the keys,
  n_rows, start_ts, end_ts and median_step (of positive steps).

Values of whole recordings are counted per distinct value before they are ranked, so ties
collapse; where no recording is cut this happens inside the buckets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import micros_between
from ..sources.workdir import work_dir
from .ordered import LAYOUT, NEVER_NULL, is_sliced
from .orderstats import group_median, quantile
from .timebase import SUPPORT_CAP_STEPS, timeline, with_steps

REC = NEVER_NULL[0]
#: Rows of a bucket, about; a table has as many buckets as the session has shuffle partitions at least.
BUCKET_ROWS = 4_000_000


@dataclass(frozen=True)
class Timeline:
    rows: DataFrame
    recordings: DataFrame
    keys: list[str]


def recording_name(keys: list[str]) -> Column:
    """Keys as one text, null ones marked, so that different keys never give one name."""
    part = lambda k: F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-"))
    return F.concat_ws("|", *[part(k) for k in keys])


def bucketed(df: DataFrame, by: list[str], sort: list[str], buckets: int, name: str) -> DataFrame:
    """Write ``df``, whose tasks hold whole buckets, once as a table of ``buckets`` sorted files in the shared folder."""
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    path = work_dir(df.sparkSession, name)
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *by).sortBy(*sort).saveAsTable(table)
    return df.sparkSession.table(table)


def store_timeline(df: DataFrame, keys: list[str], order: list[str], ts: str = "ts", buckets: int | None = None) -> Timeline:
    """Number, link and store the rows of all recordings, and catalogue them."""
    spark = df.sparkSession
    numbered = with_steps(timeline(df.withColumn(REC, recording_name(keys)), [REC], order, ts), [REC], ts)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if is_sliced(numbered):
        by, buckets = [REC, LAYOUT[1]], buckets or max(tasks, -(-df.count() // BUCKET_ROWS))
        numbered = numbered.repartition(buckets, *by)
    else:  # the windows above have dealt the rows by recording into as many tasks
        by, same = [REC], buckets in (None, tasks)
        buckets, numbered = buckets or tasks, numbered if same else numbered.repartition(buckets, REC)
    rows = bucketed(numbered, by, [*by, "row_idx"], buckets, "timeline")
    return Timeline(rows, bucketed(_catalogue(rows, keys, ts).repartition(buckets, REC) if is_sliced(rows) else _catalogue(rows, keys, ts), [REC], [REC], buckets, "recordings"), list(keys))


def _catalogue(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One row per recording. Steps are counted by value with everything else, so unless recordings are cut one pass over the buckets does it."""
    facts = [*[F.any_value(k).alias(k) for k in keys], F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts")]
    if is_sliced(rows):
        whole = rows.groupBy(REC).agg(F.count(F.lit(1)).alias("n_rows"), *facts)
        return whole.join(group_median(rows.where("step_next > 0"), [REC], "step_next", "median_step"), REC, "left")
    step = F.when(F.col("step_next") > 0, F.col("step_next"))
    counted = rows.groupBy(REC, step.alias("v")).agg(F.count(F.lit(1)).alias("n_rows"), F.count(step).alias("w"), *facts)
    again = [*[F.any_value(k).alias(k) for k in keys], F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts")]
    return counted_ranks(counted, [REC]).groupBy(REC).agg(F.sum("n_rows").alias("n_rows"), *again, quantile(0.5).alias("median_step"))


def counted_ranks(counted: DataFrame, groups: list[str], weight: str = "w") -> DataFrame:
    """Distinct values with weights -> ``lo`` (first rank from 0) and ``n`` (weight of the group), as quantiles take them."""
    win = Window.partitionBy(*groups).orderBy("v")
    return counted.withColumns({"lo": F.sum(weight).over(win.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight),
                                "n": F.sum(weight).over(Window.partitionBy(*groups))})


def with_support(tl: Timeline, fallback_seconds: float = 1.0, out: str = "support_hours") -> DataFrame:
    """Rows with the hours each stands for, by the rule of ``timebase.step_support``."""
    joined = tl.rows.join(tl.recordings.select(REC, "median_step"), REC)
    med = F.coalesce("median_step", F.lit(float(fallback_seconds)))
    own = F.when(F.col("step_next") > 0, F.col("step_next")).otherwise(med)
    return joined.withColumn(out, F.least(own, med * SUPPORT_CAP_STEPS) / 3600.0)


def corrected_clocks(tl: Timeline, starts: DataFrame, ts: str = "ts", start: str = "segment_start", fallback_seconds: float = 1.0,
                     out: str = "corrected_ts") -> DataFrame:
    """Rows re-anchored at their segment's corrected start, by the rule of ``timebase.correct_clocks``; a timeline's recordings are the segments.

    ``starts`` has one row per segment: the keys and ``start``.
    """
    from ..functions.clock import add_seconds

    shape = tl.rows.groupBy(REC).agg(F.bool_or(F.col(ts).isNull() | (F.coalesce(F.col("step_prev"), F.lit(1.0)) <= 0)).alias("_broken"), F.min_by(ts, "row_idx").alias("_first"))
    named = starts.select(recording_name(tl.keys).alias(REC), start)
    per = named.join(shape, REC).join(tl.recordings.select(REC, "median_step"), REC)
    joined = tl.rows.join(per, REC)
    spaced = F.col("row_idx") * F.coalesce(F.col("median_step"), F.lit(float(fallback_seconds)))
    offset = F.when(F.col("_broken"), spaced).otherwise(micros_between("_first", ts) / F.lit(1e6))
    return joined.withColumn(out, add_seconds(F.col(start), offset)).drop("_broken", "_first", "median_step")
