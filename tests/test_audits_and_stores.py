"""Recomputed statistics, file hashes and cohort stores that change in part."""

import hashlib
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import profile, recompute
from tracelake.sources import hashing, workdir
from tracelake.sources import tables as tb


def test_sorted_statistics_over_many_batches(spark):
    rng = np.random.default_rng(2)
    groups = {("a", "fft_x"): rng.normal(5, 2, 700), ("a", "y"): rng.normal(0, 1, 3), (None, "fft_x"): np.array([4.0]), ("b", "fft_x"): np.repeat([1.0, -1.0, 2.5], 40)}
    rows = [(k, f, float(v)) for (k, f), x in groups.items() for v in x] + [("a", "y", None), ("c", "y", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r["k"], r["feature"]): r.asDict() for r in recompute.sorted_statistics(spark.createDataFrame(rows, "k string, feature string, value double"), ["k", "feature"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(groups)
    for key, x in groups.items():
        r, x = got[key], np.sort(x)
        cut = int(len(x) * 0.1) if len(x) >= 4 else 0
        expected = {"n": len(x), "mean": x.mean(), "sd": statistics.stdev(x) if len(x) > 1 else 0.0, "min": x[0], "max": x[-1], "trimmed_mean_20pct": x[cut:len(x) - cut].mean(),
                    "iqr": np.quantile(x, 0.75) - np.quantile(x, 0.25)} | {n: np.quantile(x, p) for n, p in recompute.RANKS.items()}
        for name, value in expected.items():
            assert math.isclose(r[name], value, rel_tol=1e-9, abs_tol=1e-12), (key, name)
        logs = np.log(x[x > 0])
        assert (r["log_mean"] is None) == (key[1] == "y") and (r["cv"] is None) == (x.mean() <= 1e-10)
        if r["log_mean"] is not None:
            assert math.isclose(r["log_mean"], math.exp(logs.mean())) and math.isclose(r["log_sd"], statistics.stdev(logs) if len(logs) > 1 else 0.0, rel_tol=1e-9)


def test_audit_reports_both_sides(spark):
    schema = "p string, metric string, value double"
    left = spark.createDataFrame([("a", "n", 3.0), ("a", "mean", 1.0), ("b", "n", 5.0), ("c", "n", 1.0), ("d", "share", 10.00005)], schema)
    right = spark.createDataFrame([("a", "n", 3.0), ("a", "mean", 1.0 + 1e-9), ("b", "n", 6.0), ("e", "n", 1.0), ("d", "share", 10.0)], schema)
    got = {(r["p"], r["metric"]): r["status"] for r in recompute.audit(left, right, ["p"], {"n": "count", "share": "percent"}).collect()}
    assert got == {("a", "n"): "match", ("a", "mean"): "match", ("b", "n"): "mismatch", ("c", "n"): "only_exported", ("e", "n"): "only_recomputed", ("d", "share"): "match"}


def test_hashes_of_small_and_of_huge_files(spark, tmp_path):
    (tmp_path / "small é.txt").write_bytes(b"abc")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "ends").write_bytes(bytes(range(256)) * 64)
    with open(tmp_path / "huge", "wb") as f:  # sparse, and longer than a row may be
        f.truncate((1 << 31) + 5)
    rows = {r["file"].rsplit("/", 1)[-1]: r for r in hashing.file_hashes(spark, str(tmp_path), whole=False).collect()}
    assert {n: r["size"] for n, r in rows.items()} == {"small é.txt": 3, "ends": 16384, "huge": (1 << 31) + 5}  # empty files are not listed
    assert rows["huge"]["sha256"] is None and rows["huge"]["ends_sha256"] == hashlib.sha256(bytes(8192)).hexdigest()
    assert len({r["fingerprint"] for r in rows.values()}) == 3
    (tmp_path / "huge").unlink()
    whole = {r["file"].rsplit("/", 1)[-1]: r["sha256"] for r in hashing.file_hashes(spark, str(tmp_path), block=1000).collect()}
    assert whole == {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in whole} and len(whole) == 2


def test_only_changed_patients_are_written(spark, tmp_path):
    path, schema = str(tmp_path / "cohort"), "patient_id long, v double"
    inputs = lambda **keys: spark.createDataFrame([(int(k[1:]), v) for k, v in keys.items()], "patient_id long, run_key string")
    rows = lambda x: spark.createDataFrame([(p, x) for p in (1, 1, 2, 3)], schema)
    read = lambda: sorted((r["patient_id"], r["v"], r["commit"]) for r in tb.read_cohort(spark, path).collect())
    assert tb.write_changed(rows(1.0), inputs(p1="a", p2="a", p3="a"), path).count() == 3
    assert read() == [(1, 1.0, 1), (1, 1.0, 1), (2, 1.0, 1), (3, 1.0, 1)]
    assert [r["patient_id"] for r in tb.write_changed(rows(2.0), inputs(p1="a", p2="b"), path).collect()] == [2]
    assert read() == [(1, 1.0, 1), (1, 1.0, 1), (2, 2.0, 2)]
    rows(3.0).withColumn("run", F.lit("x")).write.mode("append").partitionBy("run", "patient_id").parquet(f"{path}/data")  # a run that ended before its manifest
    assert read() == [(1, 1.0, 1), (1, 1.0, 1), (2, 2.0, 2)]
    assert tb.write_changed(rows(4.0), inputs(p1="a", p2="b"), path).count() == 0 and read() == [(1, 1.0, 1), (1, 1.0, 1), (2, 2.0, 2)]


def test_folders_of_stores_do_not_grow_with_patients(spark, tmp_path):
    rows = spark.range(900).select((F.col("id") % 300).alias("patient_id"), F.col("id").cast("double").alias("v"))
    folders = lambda path: sum(p.is_dir() for p in path.rglob("*"))
    tb.write_cohort([rows.where("patient_id < 100"), rows.where("patient_id >= 100").drop("v")], str(tmp_path / "whole"))
    whole = spark.read.option("mergeSchema", True).parquet(str(tmp_path / "whole"))
    assert folders(tmp_path / "whole") == 0 and (whole.count(), whole.where("v IS NOT NULL").count()) == (900, 300)
    path = tmp_path / "changed"
    inputs = rows.select("patient_id").distinct()
    tb.write_changed(rows, inputs.withColumn("run_key", F.lit("a")), str(path))
    tb.write_changed(rows, inputs.withColumn("run_key", F.when(F.col("patient_id") < 10, "b").otherwise("a")), str(path))
    assert folders(path / "data") == 2
    got = {r["commit"]: (r["n"], r["k"]) for r in tb.read_cohort(spark, str(path)).groupBy("commit").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("k")).collect()}
    assert got == {1: (870, 290), 2: (30, 10)}


def test_run_folder_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workdir, "run_folder", lambda _: str(tmp_path / "run"))
    assert workdir.stored(spark.range(3), "numbers").count() == 3 and list((tmp_path / "run").iterdir())
    workdir.remove_run_folder(spark)
    assert not (tmp_path / "run").exists()


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_rank_correlation_counts_each_column_once(spark, monkeypatch, coalesced):
    import random

    rng = random.Random(5)
    some = lambda v: None if rng.random() < 0.2 else v
    rows = [(some(rng.random()), some(float(rng.randrange(4))), some(rng.random()), some(-0.0 if k % 2 else 0.0), some(float(rng.randrange(3))),
             some(rng.random()) if k < 50 else None) for k in range(300)]
    kept = []
    real = profile.stored
    monkeypatch.setattr(profile, "stored", lambda df, name: kept.append(real(df, name)) or kept[-1])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, coalesced)
    try:
        df = spark.createDataFrame(rows, "a1 double, a2 double, b1 double, b2 double, b3 double, b4 double")
        got = {(r.a, r.b): r.r for r in profile.spearman(df, ["a1", "a2"], ["b1", "b2", "b3", "b4"]).collect()}
        most = max(t.count() for t in kept)
    finally:
        spark.conf.unset(key)

    def ranks(values):
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

    assert len(got) == 8
    for i, a in enumerate(["a1", "a2"]):
        for j, b in enumerate(["b1", "b2", "b3", "b4"], 2):
            x, y = zip(*[(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
            x, y = ranks(x), ranks(y)
            mx, my = sum(x) / len(x), sum(y) / len(y)
            spread = (sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y)) ** 0.5
            if spread:
                assert got[a, b] == pytest.approx(sum((p - mx) * (q - my) for p, q in zip(x, y)) / spread, abs=1e-9)
            else:
                assert got[a, b] is None
    assert most <= 4 * len(rows) / 2  # values of one side, not a row per pair and row
    assert profile.spearman(df.where("a1 IS NULL"), ["a1"], ["b1"]).count() == 0
