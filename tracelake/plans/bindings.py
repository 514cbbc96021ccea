"""The driver's tables seen as recordings, and the same views as SQL text.

* ``epochs``: every ``events`` row is one epoch of recording ``user_id``; values are
  missing where ``event_id % 23 = 0`` and suppressed (zero) where ``% 17 = 0``.
* ``signals``: every ``lineitem`` row is one wide epoch of recording ``l_suppkey``.
* ``labels``: every ``part`` row is one labelled column of export file ``p_size``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import SLICE_ROWS_CONF, index_rows
from ..operators.stored_timeline import Timeline, store_timeline
from ..operators.timebase import timeline

KEY = ["patient_id"]
EDGES = [0, 48, 168, 720]
EVENT_LEVEL = 60.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 23 == 0, None).when(F.col("event_id") % 17 == 0, 0.0).otherwise(F.col("value"))
    return ev.select(
        F.col("user_id").alias("patient_id"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_type").alias("channel"), F.col("value").alias("raw_value"), value.alias("value"),
        (F.col("event_type") != "error").alias("artifact_clean"),
        (F.coalesce(value, F.lit(0.0)) >= EVENT_LEVEL).alias("seizure"),
    )


EP = """
ep AS (
  SELECT user_id AS patient_id, event_id, ts, event_type AS channel, value AS raw_value,
         CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 0.0 ELSE value END AS value,
         event_type <> 'error' AS artifact_clean
  FROM events),
ix AS (
  SELECT *, coalesce(value, 0.0) >= 60.0 AS seizure,
         row_number() OVER (PARTITION BY patient_id ORDER BY ts, event_id) - 1 AS row_idx,
         count(*) OVER (PARTITION BY patient_id) AS n_rows,
         min(ts) OVER (PARTITION BY patient_id) AS start_ts
  FROM ep),
tl AS (
  SELECT *, date_diff('microsecond', start_ts, ts) / 3600000000.0 AS hrs,
         artifact_clean AND NOT seizure AS usable
  FROM ix)
"""


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_rows(epochs(spark, sf_dir), KEY, ["ts", "event_id"])


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs with row numbers, hours from the recording start and masks."""
    tl = timeline(epochs(spark, sf_dir), KEY, ["ts", "event_id"])
    hours = F.timestamp_diff("MICROSECOND", "start_ts", "ts") / F.lit(3.6e9)
    return tl.withColumns({"hours": hours, "usable": F.col("artifact_clean") & ~F.col("seizure")})


_STORED: dict[tuple[str, str, str], Timeline] = {}


def stored_recordings(spark: SparkSession, sf_dir: str) -> Timeline:
    """The recordings as a timeline stored once per session; hours and masks are columns of its rows."""
    at = (spark.sparkContext.applicationId, sf_dir, spark.conf.get(SLICE_ROWS_CONF, ""))
    if at not in _STORED:
        tl = store_timeline(epochs(spark, sf_dir), KEY, ["ts", "event_id"])
        hours = F.timestamp_diff("MICROSECOND", "start_ts", "ts") / F.lit(3.6e9)
        _STORED[at] = replace(tl, rows=tl.rows.withColumns({"hours": hours, "usable": F.col("artifact_clean") & ~F.col("seizure")}))
    return _STORED[at]


SUPPORT = """
st AS (
  SELECT *, date_diff('microsecond', ts, lead(ts) OVER w) / 1e6 AS step_next,
         date_diff('microsecond', lag(ts) OVER w, ts) / 1e6 AS step_prev
  FROM tl WINDOW w AS (PARTITION BY patient_id ORDER BY row_idx)),
md AS (
  SELECT patient_id, median(step_next) AS med FROM st WHERE step_next > 0 GROUP BY 1),
su AS (
  SELECT st.*, coalesce(med, 1.0) AS med,
         least(CASE WHEN step_next > 0 THEN step_next ELSE coalesce(med, 1.0) END, coalesce(med, 1.0) * 3) / 3600.0 AS support
  FROM st LEFT JOIN md USING (patient_id))
"""

BIN_OF = """CASE WHEN hrs >= 0 AND hrs < 48 THEN '0-48h' WHEN hrs >= 48 AND hrs < 168 THEN '48-168h'
       WHEN hrs >= 168 AND hrs < 720 THEN '168-720h' END"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return li.select(
        F.col("l_suppkey").alias("patient_id"), "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_shipdate").cast("timestamp_ntz").alias("ship"),
        F.when(F.col("l_linenumber") % 7 == 3, None).otherwise(q).alias("fft_delta_left_anterior"),
        F.when(F.col("l_partkey") % 11 == 5, None).otherwise(F.col("l_extendedprice") / 1000.0).alias("fft_delta_right_anterior"),
        (d * 100.0).alias("fft_theta_left_anterior"), (t * 100.0).alias("fft_theta_right_anterior"),
        (q * d).alias("fft_alpha_left_anterior"), (q * t).alias("fft_alpha_right_anterior"),
        (t * 50.0).alias("fft_beta_left_anterior"), (d * 50.0).alias("fft_beta_right_anterior"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        q.alias("quantity"), F.col("l_extendedprice").alias("price"), d.alias("discount"), t.alias("tax"),
    )


SIGNAL_ORDER = ["l_orderkey", "l_linenumber", "l_partkey"]

SG = """
sg0 AS (
  SELECT l_suppkey AS patient_id, l_orderkey, l_linenumber, l_partkey, l_shipdate AS ship,
         CASE WHEN l_linenumber % 7 = 3 THEN NULL ELSE l_quantity END AS dl,
         CASE WHEN l_partkey % 11 = 5 THEN NULL ELSE l_extendedprice / 1000.0 END AS dr,
         l_discount * 100.0 AS thl, l_tax * 100.0 AS thr,
         l_quantity * l_discount AS al, l_quantity * l_tax AS ar,
         l_tax * 50.0 AS bl, l_discount * 50.0 AS br,
         l_returnflag AS flag, l_linestatus AS status,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax
  FROM lineitem),
sg AS (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS row_idx,
         count(*) OVER (PARTITION BY patient_id) AS n_rows
  FROM sg0)
"""


def indexed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_rows(signals(spark, sf_dir), KEY, SIGNAL_ORDER)
