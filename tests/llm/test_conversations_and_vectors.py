"""Conversation repair, prefix trie and multi-index neighbours against plain versions, and the cases their docstrings define."""

import hashlib
import math
import random
from functools import lru_cache, reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import multi_index, prefix_trie, repair
from tracelake.llm.common import joined_sha256

TURNS = "conv_id long, turn long, role string, text string, at long, chunk long, n long"


def conversations(spark, rows):
    """Rows (conv_id, turn, role, text) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS)


# --- joined digests


def test_joined_sha256(spark):
    rows = [(1, 2, "b"), (1, 1, "a"), (None, 1, "x"), (2, 1, ""), (2, 2, "ü")]
    got = joined_sha256(spark.createDataFrame(rows, "k long, o long, v string"), ["k"], ["o"], "v", ",", "d").collect()
    assert {r.k: r.d for r in got} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in {1: "a,b", None: "x", 2: ",ü"}.items()}


# --- repair


NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def plain_repair(rows):
    """(faults, cost, audit, lines) of one conversation by memoised search over whole edit sequences."""
    seen, kinds = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, q, inserts):
        out = []
        if i == len(rows):
            if q in (0, 3):
                return 0, "", ()
        else:
            (role, text), kind = rows[i], kinds[i]
            c, a, lines = best(i + 1, q, 0)
            out.append((2 + c, "D" + a, lines))
            if kind not in ("blank", "duplicate"):
                extra = 5 if kind == "truncated" else 0
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(q)
                if to is not None:
                    c, a, lines = best(i + 1, to, 0)
                    out.append((extra + c, "K" + a, (f"{role}:{text}", *lines)))
                c, a, lines = best(i + 1, NEXT[q], 0)
                out.append((1 + extra + c, "R" + a, (f"{'assistant' if q == 2 else 'user'}:{text}", *lines)))
        if inserts < 3:
            c, a, lines = best(i, NEXT[q], inserts + 1)
            out.append((5 + c, "I" + a, (f"{'assistant' if q == 2 else 'user'}:", *lines)))
        return min(out, key=lambda x: x[:2]) if out else (math.inf, "", ())

    cost, audit, lines = best(0, 0, 0)
    return [kinds.count(k) for k in ("blank", "duplicate", "truncated")], cost, audit, list(lines)


def damaged_rows():
    rng = random.Random(11)
    rows = []
    for conv in [*range(40), None]:
        n = rng.choice([1, 2, 3, 5, 8, 21]) if conv != 7 else 90
        for t in range(n):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "User", None, "usr"])
            text = rng.choice(["Yes.", "no", "  ", "", None, f"t{t}!", f"t{t} ", f"word {t}.\n\t", f"cut {t}"])
            rows.append((conv, rng.choice([t, t, t, t + 3, None]), role, text))
    rows += [(100, t, "user", f"never ends {t}") for t in range(60)]  # truncated throughout: no chunk forgets its start
    rows += [(101, t, "assistant", "same.") for t in range(30)] + [(102, t, ["user", "assistant"][t % 2], f"fine {t}.") for t in range(41)]
    return rows


@pytest.mark.parametrize("layout, chunk, fix_ups", [("plain", 4096, 8), ("sliced", 3, 50), ("plain", 3, 0), ("plain", 4, 2)], indirect=["layout"])
def test_repair_equals_plain_search(spark, layout, chunk, fix_ups):
    rows = damaged_rows()
    found = repair.repair(conversations(spark, rows), chunk=chunk, fix_ups=fix_ups)
    summary = {r.conv: r for r in found.summary.collect()}
    lines = {}
    for r in sorted(found.rows.collect(), key=lambda r: (r["at"], r["sub"])):
        lines.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    assert set(summary) == set(by)
    for conv, own in by.items():
        own.sort()
        turns = {t for known, t, _, _ in own if known}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        faults, cost, audit, kept = plain_repair(tuple((role, text) for _, _, role, text in own))
        r = summary[conv]
        assert [r["blank"], r["duplicate"], r["truncated"]] == faults
        assert (r["cost"], r["audit"], lines.get(conv, [])) == (cost, audit, kept), conv
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0) and r["n_rows"] == len(own)
        assert r["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)


def test_repair_of_nothing(spark):
    found = repair.repair(conversations(spark, []))
    assert found.summary.collect() == [] and found.rows.collect() == []


def test_damage(spark):
    import zlib

    rows = [(c, t, "system", f"A. b! {c}?") for c in range(30) for t in (0, 1)] + [(None, None, None, None)]
    got = {}
    for r in repair.damaged(conversations(spark, rows)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if how == 1 else text.translate({ord(c): None for c in ".!?"}) if how == 2 else text
        expected = [("user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
        assert got.get((conv, turn), []) == expected


# --- prefix trie


def trie_rows():
    rng = random.Random(12)
    rows = []
    for conv in range(60):
        n = rng.choice([1, 2, 3, 4, 9])
        rows += [(conv, t if rng.random() < 0.95 else None, rng.choice(["user", "user", "assistant", None]), rng.choice(["a", "a", "a", "bé", None])) for t in range(n)]
    rows += [(conv, t, "user", f"long {t}") for conv in (70, 71, 72) for t in range(23)]  # equal conversations longer than the bands of the test
    rows += [(73, t, "user", f"long {t}" if t < 11 else f"other {t}") for t in range(23)] + [(None, 0, "user", "x"), (74, 0, "user", "a"), (74, 0, "user", "a")]
    return rows


def plain_trie(rows, extra):
    by = {c: [] for c in extra}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    paths = {c: tuple((r, t) for _, _, r, t in sorted(v)) for c, v in by.items()}
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, own in members.items():
        below = [m for m in members if m[:len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[:len(m)] == m for x in members)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("layout, shard_rows, band", [("plain", 1 << 14, 4096), ("sliced", 20, 4), ("plain", 7, 1)], indirect=["layout"])
def test_trie_equals_plain_version(spark, layout, shard_rows, band):
    rows = trie_rows()
    turns = prefix_trie.numbered_turns(conversations(spark, rows))
    convs = turns.select("conv_id").distinct().unionAll(spark.createDataFrame([(500,), (501,)], "conv_id long"))  # two without turns
    got = prefix_trie.prefix_trie(turns, convs, shard_rows, band).select(*NODE).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows, [500, 501])


def test_trie_of_nothing(spark):
    turns = prefix_trie.numbered_turns(conversations(spark, []))
    assert prefix_trie.prefix_trie(turns, turns.select("conv_id").distinct()).collect() == []


def test_colliding_digests_are_found_and_hashed_again(spark, monkeypatch):
    rows, honest, seeds = trie_rows(), prefix_trie.prefixes, []

    def weak(turns, convs, seed):
        seeds.append(seed)
        out = honest(turns, convs, seed)
        return out if seed else out.withColumns({c: F.when(F.col(d) == 0, 0).otherwise(F.pmod(c, F.lit(3)) + 1) for c, d in (("hi", "d"), ("lo", "d"))}).withColumns(
            {c: F.when(F.col("d") <= 1, 0).otherwise(F.pmod(c, F.lit(3)) + 1) for c in ("phi", "plo")})

    monkeypatch.setattr(prefix_trie, "prefixes", weak)
    turns = prefix_trie.numbered_turns(conversations(spark, rows))
    got = prefix_trie.prefix_trie(turns, turns.select("conv_id").distinct()).select(*NODE).collect()
    assert seeds == [0, 1] and sorted((tuple(r) for r in got), key=str) == plain_trie(rows, [])


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 40_000):
        hi, lo = rng.integers(0, 2**63, n, dtype=np.uint64), np.arange(n, dtype=np.uint64)
        hi[: n // 2] = 7  # half of the keys differ in one part only
        slots = prefix_trie.PerfectHash(hi, lo).slots(hi, lo)
        assert sorted(slots.tolist()) == list(range(n))


# --- multi-index neighbours


def plain_nearest(rows, k, asks):
    """Exact neighbours, with the sums in the order of components."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    width = max((len(v) for _, v in good), default=0)
    pad = {(i, (*v, *[0.0] * (width - len(v)))) for i, v in good}
    out = {}
    for i, v in pad:
        if asks(i):
            scored = sorted((-reduce(lambda s, xy: s + xy[0] * xy[1], zip(v, w), 0.0), j) for j, w in pad if j != i)
            out[(i, v)] = [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(x for found in out.values() for x in found)


def found_nearest(spark, rows, k=3, **how):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, cell int")
    got = multi_index.nearest(df, F.col("id") % 4 == 0, k, **how)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


def vector_rows():
    rng = random.Random(13)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]  # a large group of copies
    rows += [(i, [round(x) for x in rows[i - 300][1]]) for i in range(300, 340)]  # ties
    rows += [(400, None), (404, []), (408, [0.0] * 6), (412, [1.0, None]), (416, [float("nan")] * 6), (420, [float("inf")] * 6), (None, [1.0] * 6)]
    return [(i, v if v is None else [x if x is None else float(x) for x in v]) for i, v in [*rows, (500, [2.0]), (504, [0.5, 0.25, 0.0]), rows[8], (508, [1e200] * 6)]]


@pytest.mark.parametrize("how", [dict(shard=7, block=5, centroids=4), dict(centroids=1), dict(shard=1000, centroids=9)])
def test_visiting_everything_is_exact(spark, how):
    rows = vector_rows()
    assert found_nearest(spark, rows, recall=1.0, **how | {"centroids": 1}) == plain_nearest(rows, 3, lambda i: i % 4 == 0)
    got, true = found_nearest(spark, rows, recall=1.0, **how), plain_nearest(rows, 3, lambda i: i % 4 == 0)
    assert len(got) == len(true) and len(set(got) & set(true)) >= 0.9 * len(true)


def test_few_or_no_vectors(spark):
    assert found_nearest(spark, []) == [] and found_nearest(spark, [(1, None), (4, [0.0])]) == []
    assert found_nearest(spark, [(4, [1.0])]) == []
    assert found_nearest(spark, [(4, [1.0]), (8, [2.0]), (1, [3.0])]) == [(4, 1, 1, 3.0), (4, 2, 8, 2.0), (8, 1, 1, 6.0), (8, 2, 4, 2.0)]


@pytest.mark.parametrize("name", ["0.001", "0.01"])
def test_recall_on_the_given_vectors(spark, name):
    df = spark.read.parquet(f"/root/testdata/sf{name}/embeddings.parquet")
    got = multi_index.nearest(df, F.col("id") % 20 == 0).collect()
    rows = df.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x, ids = np.array(rows["embedding"].tolist(), np.float64), rows["vec_id"].to_numpy()
    hits = wanted = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = np.where(ids == ids[q], -np.inf, x @ x[q])
        own = [r for r in got if r["query_id"] == ids[q]]
        assert [r["rank"] for r in sorted(own, key=lambda r: (-r["score"], r["vec_id"]))] == list(range(1, 21))
        assert all(abs(r["score"] - scores[np.searchsorted(ids, r["vec_id"])]) < 1e-12 for r in own)
        hits += len({r["vec_id"] for r in own} & set(ids[np.lexsort([ids, -scores])[:20]].tolist()))
        wanted += 20
    assert hits >= 0.9 * wanted
