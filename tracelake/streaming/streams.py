"""Incremental forms of ingestion, bin counters and event sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ordered import index_rows, neighbours, running, strip_layout


def ingest_new_files(spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType, fmt: str = "parquet") -> None:
    """Append the files that arrived since the last run, each exactly once, then stop."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    query = (stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def bin_counters(rows: DataFrame, keys: list[str], ts: str = "ts", width: str = "6 hours",
                 clean: str | Column = "artifact_clean", event: str | Column = "seizure") -> DataFrame:
    """Epoch, clean and event counts per key and tumbling window."""
    c = F.col(clean) if isinstance(clean, str) else clean
    e = F.col(event) if isinstance(event, str) else event
    counted = rows.groupBy(*keys, F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_epochs"), F.count_if(c).alias("n_clean"), F.count_if(c & e).alias("n_events"))
    return counted.select(*keys, F.col("w.start").alias("window_start"), "n_epochs", "n_clean", "n_events")


def event_rows(rows: DataFrame, keys: list[str], event: str = "seizure", ts: str = "ts") -> DataFrame:
    """What sessions are made of: key and time of the event epochs."""
    return rows.where(F.col(event)).select(*keys, F.col(ts).alias("ts"))


def run_to_table(stream: DataFrame, reduced: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Drain what is available; every micro-batch writes its reduced rows to its own folder, so a retried batch replaces itself.

    Recordings have clocks of their own and are uploaded in any order, so there is no
    watermark: a batch keeps no state, and readers add up what all batches wrote.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        reduced(batch).write.mode("overwrite").parquet(f"{target}/part={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def counters_so_far(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Counters of every key and window over all micro-batches."""
    rows = spark.read.parquet(target)
    sums = [F.sum(c).alias(c) for c in ("n_epochs", "n_clean", "n_events")]
    return rows.groupBy(*keys, "window_start").agg(*sums)


def sessions_so_far(spark: SparkSession, target: str, keys: list[str], gap_seconds: float = 300.0) -> DataFrame:
    """Sessions over all micro-batches: one ends when no event epoch follows within the gap."""
    rows = spark.read.parquet(target).select(*keys, "ts").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    timed = neighbours(index_rows(rows, keys, ["_us"]), keys, prev={"_last": "_us"})
    begins = F.col("_last").isNull() | (F.col("_us") - F.col("_last") > gap_seconds * 1e6)
    placed = running(timed.withColumn("_new", begins.cast("int")), keys, {"_session": ("sum", "_new")})
    return strip_layout(placed).groupBy(*keys, "_session").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_epochs")).drop("_session")
