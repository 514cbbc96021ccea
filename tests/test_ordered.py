"""Ordered operators against plain loops, with and without hot-key slicing."""

import random

from pyspark.sql import functions as F

from tracelake.operators import ordered as od
from tracelake.operators.orderstats import average_rank, order_stats, quantile, trimmed_mean


def sequence(spark, seed=7, rows=300):
    rnd = random.Random(seed)
    data = [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), i, rnd.choice([None, 0.0, 1.0, 2.5, 4.0]), rnd.random() < 0.4) for i in range(rows)]
    rnd.shuffle(data)
    return data, spark.createDataFrame(data, "k string, t int, v double, f boolean")


def by_key(data):
    out = {}
    for row in sorted(data, key=lambda r: r[1]):
        out.setdefault(row[0], []).append(row)
    return out


def test_index_neighbours_running(spark, layout):
    data, df = sequence(spark)
    ix = od.index_rows(df, ["k"], ["t"])
    assert od.is_sliced(ix) == (layout == "sliced")
    nb = od.neighbours(ix, ["k"], prev={"pt": "t"}, next={"nt": "t"})
    rn = od.running(nb, ["k"], {"s": ("sum", "v"), "m": ("max", "v")})
    got = {(r.k, r.t): r for r in rn.collect()}
    for key, rows in by_key(data).items():
        total, top = None, None
        for i, (_, t, v, _) in enumerate(rows):
            if v is not None:
                total = (total or 0.0) + v
                top = v if top is None else max(top, v)
            r = got[(key, t)]
            assert (r.row_idx, r.n_rows) == (i, len(rows))
            assert r.pt == (rows[i - 1][1] if i else None)
            assert r.nt == (rows[i + 1][1] if i + 1 < len(rows) else None)
            assert r.s == total and r.m == top


def test_runs_and_fill(spark, layout):
    data, df = sequence(spark, 11)
    ix = od.index_rows(df, ["k"], ["t"])
    got = {(r.k, r.run_start): (r.f, r.run_rows) for r in od.runs(ix, ["k"], "f").collect()}
    fill = {(r.k, r.t): r.last for r in od.last_known(ix, ["k"], "v", "last").collect()}
    want, last = {}, None
    for key, rows in by_key(data).items():
        start, last = 0, None
        for i, row in enumerate(rows):
            if i and row[3] != rows[i - 1][3]:
                start = i
            flag, n = want.get((key, start), (row[3], 0))
            want[(key, start)] = (flag, n + 1)
            last = row[2] if row[2] is not None else last
            assert fill[(key, row[1])] == last
    assert got == want


def test_sliding_sum(spark, layout):
    data, df = sequence(spark, 3)
    ix = od.index_rows(df, ["k"], ["t"])
    out = od.sliding_sum(ix, ["k"], F.col("f").cast("int"), 10, "s", block=16)
    got = {(r.k, r.t): r.s for r in out.collect()}
    for key, rows in by_key(data).items():
        for i, row in enumerate(rows):
            want = sum(r[3] for r in rows[i - 9:i + 1]) if i >= 9 else None
            assert got[(key, row[1])] == want


def test_order_statistics(spark, layout):
    data, df = sequence(spark, 5, 400)
    got = {r.k: r for r in order_stats(df, ["k"], "v", med=quantile(0.5), p10=quantile(0.1), tm=trimmed_mean(0.1)).collect()}
    for key, rows in by_key(data).items():
        v = sorted(r[2] for r in rows if r[2] is not None)

        def q(p, v=v):
            pos = (len(v) - 1) * p
            lo = int(pos)
            return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (pos - lo)

        cut = int(len(v) * 0.1) if len(v) >= 4 else 0
        kept = v[cut:len(v) - cut]
        assert abs(got[key].med - q(0.5)) < 1e-12 and abs(got[key].p10 - q(0.1)) < 1e-12
        assert abs(got[key].tm - sum(kept) / len(kept)) < 1e-9


def test_average_rank(spark, layout):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0)], "k string, v double")
    assert {r.v: r.avg_rank for r in average_rank(df, ["k"], "v").collect()} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_plain_plan_has_no_extra_join(spark):
    _, df = sequence(spark)
    plan = od.index_rows(df, ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
