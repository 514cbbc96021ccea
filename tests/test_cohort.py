"""The whole cohort plan, and a sample of registered queries against their SQL."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tracelake.config import BinSettings, CohortSettings, EventSettings
from tracelake.operators.ordered import SLICE_ROWS_CONF
from tracelake.operators.quality import Instrument
from tracelake.plans import catalog
from tracelake.plans.cohort import CohortInputs, cohort_summary, process_cohort

T0 = dt.datetime(2025, 3, 15, 10)
SF = "/root/testdata/sf0.001"


def recording(pid, n, start=T0):
    for i in range(n):
        left = 0.0 if i < 5 or 100 <= i < 110 else 2.0 + (i // 8) % 7
        yield (pid, i, start + dt.timedelta(seconds=10 * i), left, 0.0 if i < 5 or 105 <= i < 110 else 3.0 + (i // 8) % 5, 1.0 if 200 <= i < 230 else 0.0)


def test_process_cohort(spark, layout):
    if layout == "sliced":
        spark.conf.set(SLICE_ROWS_CONF, "200")
    df = spark.createDataFrame([*recording("a", 900), *recording("b", 400, T0 + dt.timedelta(hours=1))],
                               "patient_id string, i int, ts timestamp_ntz, l double, r double, det double")
    df = df.withColumnsRenamed({"l": "fft_delta_left_anterior", "r": "fft_delta_right_anterior"})
    times = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=10)), ("b", T0)], "patient_id string, event_ts timestamp_ntz")
    inputs = CohortInputs(
        df, ["patient_id"], ["ts", "i"], event_times=times, leading=["fft_delta_left_anterior", "fft_delta_right_anterior"], detections="det",
        instruments=[Instrument("l", "fft_power", "Left Anterior", ("fft_delta_left_anterior",)), Instrument("r", "fft_power", "Right Anterior", ("fft_delta_right_anterior",)),
                     Instrument("d", "seizure_detection", "", ("det",))],
        bands=["delta"], engines={"power": (["fft_delta_left_anterior"], 8)}, variables=["fft_delta_anterior"], variable_engine={"fft_delta_anterior": "power"})
    res = process_cohort(inputs, CohortSettings(event=EventSettings("detected"), bins=BinSettings((0, 1, 2, 4), 0.1)))
    assert res.epochs.where("patient_id = 'a'").agg(F.min("hours")).first()[0] == 0.0
    assert res.epochs.where("all_regions AND artifact_clean").count() == 0 and res.epochs.where("all_regions").count() == 10
    qc = {r.patient_id: r for r in cohort_summary(res, ["patient_id"]).collect()}
    assert qc["a"].total_epochs == 900 and qc["b"].total_epochs == 400
    assert qc["a"].leading_zeros == qc["b"].leading_zeros == 5 and qc["b"].usable_epochs == 395 - qc["b"].excluded_epochs
    assert qc["a"].events_clean == 1 and qc["a"].longest_minutes_clean == 0.5
    rows = {(r.patient_id, r.bin_label): r for r in res.bins.collect()}
    assert len(rows) == 6 and rows[("b", "0-1h")].missingness == "no_data"
    first = rows[("a", "0-1h")]
    assert first.effective_basis == "power_cadence_adjusted" and first.n_effective < first.n_observed and first.log_mean > 0


SAMPLE = ["A2_bin_stats", "E10_event_report", "Q6_rejection_report", "J1_segment_merge", "R3_midpoint_rows", "T8_clock_correction", "P1_column_profile", "C8_common_names"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "part", "orders", "customer", "embeddings", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(catalog.ORACLES[name])
    cols = [d[0] for d in cur.description]
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    text = lambda rows: sorted(tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v) for v in r) for r in rows)
    assert text(df.select(*cols).collect()) == text(cur.fetchall())


def test_every_query_with_sql_has_a_counterpart():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
