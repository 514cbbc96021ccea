"""The corpus pipeline on a small folder of tables, each stage judged on its own input."""

import random

import pytest

import corpus_pipeline
from tracelake.llm import fm_index, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "w" + str(rng.randrange(900))
    text = lambda n: " ".join(word() for _ in range(n))
    bad, shared, item = ["scumbag", "idiotic", "morons"], [text(12) for _ in range(3)], text(14)
    rows = []
    for i in range(240):
        lines = [text(rng.randrange(15, 40)) for _ in range(4)]
        if i % 6 == 0:
            lines[1] += " " + " ".join(rng.choices(bad, k=4))
        if i % 40 == 5:
            lines += shared
        if i % 40 == 7:
            lines[2] = f"{lines[2]} {item}, {text(5)}"
        rows.append((i, "\n".join(lines)))
    copy = dict(rows)
    rows += [(300, copy[10]), (301, copy[11].replace(" ", "  ", 3) + " end"), (302, None), (303, ""), (304, copy[11])]
    path = tmp_path_factory.mktemp("tables")
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), item


def test_stages(spark, folder):
    path, item = folder
    docs, steps = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.columns == COLUMNS
            out.write.parquet(f"{path}/{name}")
            out = spark.read.parquet(f"{path}/{name}")
            assert out.where("n_chars IS DISTINCT FROM length(text)").count() == 0
        steps[name] = ({r.doc_id: r.text for r in docs.collect()}, out)
        docs = out
    before, out = steps["toxicity"]
    assert {r.doc_id for r in out.collect()} == {i for i in before if i >= 240 or i % 6}
    before, out = steps["line_dedup"]
    after = {r.doc_id: r.text for r in out.collect()}
    assert set(before) - set(after) == {300, 304}  # copies whose lines are all gone
    passages = [i for i in after if i % 40 == 5 and i < 240]
    assert passages and all((after[i] == before[i]) == (i == min(passages)) for i in passages)
    assert all(after[i] == before[i] for i in after if i % 40 != 5)
    before, out = steps["near_dedup"]
    assert set(before) - {r.doc_id for r in out.collect()} == {301}
    before, out = steps["decontamination"]
    after = {r.doc_id: r.text for r in out.collect()}
    assert set(after) == set(before)
    hit = [i for i in after if after[i] != before[i]]
    assert hit and all(i % 40 == 7 and item not in after[i] and before[i].replace(item, "") == after[i] for i in hit)
    before, out = steps["packing"]
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == set(before) and max(r.offset + r.length for r in pieces) <= 2048


def test_run_equals_its_stages(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    docs = spark.read.parquet(f"{path}/decontamination")
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    assert fm_index.WIDTH == 10 and toxicity.SAMPLE == 6_000
