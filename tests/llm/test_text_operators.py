"""Every operator against a plain version on small tables, and the cases its docstring defines."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import components, fm_index, language, line_windows, minhash, packing, phrases, revisits, token_files, top_k, toxicity
from tracelake.llm.common import WordEncoder, word_tokenizer_path

DOCS = "doc_id long, text string, lang string, id long, key string, n long"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "und", "über", "naïve", "x", "Zeta", "y1"]


def documents(spark, rows):
    """Rows (id, text) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, 7, "k", None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Small texts with copies, near copies, shared passages, repeats, nulls, empty and long ones."""
    rng = random.Random(5)
    word = lambda: rng.choice(WORDS) + str(rng.randrange(40))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(30), text(120)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, base), (5, base), (6, base.upper()), (None, text(50)), (7, text(4000))]
    for i in range(8, 40):
        words = base.split()
        words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)) if i % 3 == 0 else (i, f"{text(25)}\n{passage}  {text(25)}") if i % 3 == 1 else (i, text(rng.randrange(1, 90))))
    rows += [(40, f"{passage} {passage} {passage}"), (41, "a b c " * 60), (42, "l1\nl2\nl3\nl4\n" * 3), (43, "\n" * 9), (4, base), (44, "ä" * 30_000)]
    return rows


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: tuple((x is not None, x) if not isinstance(x, list) else x for x in r))


# --- word encoder, packing, token files


def test_encoder_equals_the_tokenizer():
    import pyarrow as pa

    rng = random.Random(1)
    letters = [chr(c) for c in [*range(32, 127), *range(0xC0, 0x180), *range(0x300, 0x308), *range(9, 32), 0x85, 0xA0, 0x130, 0x3A3, 0x2028, 0x4E2D, 0x1F600]]
    texts = [None, "", " ", "Don't I'LL <|endoftext|> ŉ ẞ. K, É.. ab1c2 x,y.z", *("".join(rng.choices(letters, k=50)) for _ in range(400))]
    encoder = WordEncoder(word_tokenizer_path(), limit=300)
    whole = encoder.whole
    expected = [np.asarray(whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(encoder.encode(pa.array(texts, pa.string()))) == expected


def _ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(word_tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 1]


def test_packing(spark, corpus):
    rows = packing.pack(documents(spark, corpus), word_tokenizer_path(), window=256, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) <= 256 and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
    for i, text in corpus:
        if i != 4:
            pieces = sorted(by_doc[i], key=lambda r: r.start)
            assert [x for p in pieces for x in p.ids] == _ids(text) and {p.doc_tokens for p in pieces} == {len(_ids(text))}
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    assert packing.pack(documents(spark, []), word_tokenizer_path()).count() == 0


def test_best_fit_against_plain_search():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 500)
    sequence, offset, free = packing.best_fit_decreasing(lengths, 64)
    rooms, expected = [], []
    for need in sorted(lengths.tolist(), reverse=True):
        fitting = [r for r in rooms if r >= need]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - need)
        else:
            rooms.append(64 - need)
    used = np.bincount(sequence, lengths, minlength=free).astype(int)
    assert sorted(64 - used) == sorted(rooms) and free == len(rooms)


def test_token_files(spark, corpus, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    token_files.write_token_files(documents(spark, corpus), path, word_tokenizer_path())
    files = token_files.read_token_files(spark, path)
    got = token_files.with_start(token_files.token_checksums(files), files).orderBy("start").collect()
    expected, start = [], 0
    for i, text in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = _ids(text)
        expected.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected
    one = files.where("doc_id = 7").select("ids").first()[0]
    assert one == _ids(dict(corpus)[7])
    column = pq.ParquetFile(glob.glob(path + "/*.parquet")[0]).metadata.row_group(0).column(4)
    assert column.path_in_schema == "ids.list.element" and column.has_column_index and column.has_offset_index
    assert any("DICTIONARY" in e for e in column.encodings)
    token_files.write_token_files(documents(spark, []), path + "0", word_tokenizer_path())
    empty = token_files.read_token_files(spark, path + "0")
    assert token_files.with_start(token_files.token_checksums(empty), empty).count() == 0


# --- near duplicates


def _plain_components(rows, size):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i is not None and j is not None and i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, corpus, size):
    got = minhash.near_duplicates(documents(spark, corpus), size=size).collect()
    expected = _plain_components(corpus, size)
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id), r
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_lists_go_on_until_all_pairs_are_settled(spark, monkeypatch):
    """Many texts that share most of a passage: one leader a time must still find the two that are alike."""
    monkeypatch.setattr(minhash, "LEADERS", 1)
    rng = random.Random(2)
    shared = [f"s{i}" for i in range(90)]
    rows = [(i, " ".join(shared + [f"o{i}_{j}" for j in range(14)])) for i in range(9)]
    rows.append((9, rows[8][1] + " " + " ".join(f"p{j}" for j in range(3))))
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), size=4).collect()}
    assert got == {i: c for i, (_, c) in _plain_components(sorted(rows), 4).items()}


@pytest.mark.parametrize("wide", [512, 64])
def test_groups_just_below_the_threshold(spark, monkeypatch, wide):
    """Blocks of a group find its links, and the pairs to verify do not grow with its square (unless sets exceed the sketch)."""
    tried, verified = [], minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *a: tried.append(pairs.count()) or verified(pairs, *a))
    for name, value in (("BLOCK", 8), ("GROUP_ROWS", 20), ("WIDE", wide)):
        monkeypatch.setattr(minhash, name, value, raising=False)
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(130)]
    rows = [(i, " ".join(shared + [f"o{i}_{j}" for j in range(20)])) for i in range(60)]
    rows += [(100 + i, " ".join([*rows[i][1].split(), *(f"p{i}_{j}" for j in range(k))])) for i in range(0, 60, 7) for k in [1 + i % 4]]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), size=4).collect()}
    assert got == {i: c for i, (_, c) in _plain_components(sorted(rows), 4).items()}
    assert wide < 150 or sum(tried) < 5 * len(rows), tried


def test_needed_overlap_holds():
    rng = np.random.default_rng(0)
    for n in (30, 80, 96, 120, 400):
        for union in range(n, n * 100 // 80 + 1, max(1, n // 12)):
            common = -(-union * 80 // 100)
            if common > n:
                continue
            for _ in range(30):
                values = rng.permutation(10**6)[:union]
                other = union - common
                a = np.sort(np.concatenate([values[:common], values[common:common + min(other, n - common)]]))[:96]
                b = np.sort(np.concatenate([values[:common], values[common + min(other, n - common):]]))[:96]
                assert len(np.intersect1d(a, b)) >= min(minhash.needed(n, 96, 80), minhash.needed(union - (n - common), 96, 80))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (7, 7), (30, 4), (None, 3), (30, 31), (1, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 30: 1, 31: 1, 10: 10, 11: 10, 12: 10}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_dedup_writes_few_files(spark, corpus, monkeypatch):
    """Tables between the steps are as many files as their rows ask for, also where shuffle partitions are many and not merged."""
    written = []
    for module in (minhash, components):
        monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: written.append((name, f(df, name))) or written[-1][1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = minhash.near_duplicates(documents(spark, corpus), size=4).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    expected = _plain_components(corpus, 4)
    assert [(r.n_shingles, r.component_id) for r in got] == [expected[r.doc_id] for r in got] and len(got) == len(corpus)
    files = [(name, len(df.inputFiles())) for name, df in written]
    assert {"classes", "lists", "members", "texts", "pairs", "edges"} <= {name for name, _ in files}
    assert max(n for _, n in files) == 1, files


# --- repeated passages and lines


@pytest.mark.parametrize("hot", [1_000, 2])
def test_repeated_passages(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(phrases, "HOT", hot)
    got = {}
    for r in phrases.drop_repeated_passages(documents(spark, corpus), with_text=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    seen, texts = {}, {}
    for i, t in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0)):
        if i in texts:
            continue
        texts[i] = w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k:k + 20]) in seen:
                gone[k:k + 20] = [True] * 20
            seen.setdefault(tuple(w[k:k + 20]), i)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        for r in got[i]:
            assert (r.n_words, r.n_removed, r.kept_sha256, r.kept) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    assert sum(map(len, got.values())) == len(corpus)
    assert phrases.drop_repeated_passages(documents(spark, [])).count() == 0


def test_phrases_are_few_symbols(monkeypatch):
    import ahocorasick

    made = []

    class Counted:
        def __init__(self):
            self.of, self.length, self.phrases = ahocorasick_automaton(), 0, 0
            made.append(self)

        def add_word(self, phrase, value):
            self.length, self.phrases = self.length + len(phrase), self.phrases + 1
            return self.of.add_word(phrase, value)

        def __getattr__(self, name):
            return getattr(self.of, name)

    ahocorasick_automaton = ahocorasick.Automaton
    monkeypatch.setattr(ahocorasick, "Automaton", Counted)
    words = [b"w%d" % i for i in range(600)]
    runs = [(3, 60), (10, 47), (2, 25), (100, 140), (101, 130), (500, 520), (30, 70)]
    got = phrases.located([b" ".join(words[a:b]) for a, b in runs], [1, 1, 2, 1, 1, 1, 1], [7, 5, 9, 1, 0, 2, 3], 20)
    where = {}
    for (a, b), n, doc in zip(runs, [1, 1, 2, 1, 1, 1, 1], [7, 5, 9, 1, 0, 2, 3]):
        for i in range(a, b - 19):
            known = where.get(i, (0, doc))
            where[i] = known[0] + n, min(known[1], doc)
    assert got == [[where[i][1] if where[i][0] > 1 else None for i in range(a, b - 19)] for a, b in runs]
    assert made[0].phrases == sum(n > 1 for n, _ in where.values()) and made[0].length <= 8 * made[0].phrases


def test_digests_of_words_and_spans():
    texts = ["a b c d a b c", "", "ab a  b é " + "x" * 5_000, "c d a b", "c d b a", "x" * 4_999 + "y a"]
    words, offsets = phrases.split_flat(pa.array(texts))
    hashes = phrases.byte_hashes(words, 2)
    plain = words.to_pylist()
    for lane in hashes:
        assert len(dict(zip(plain, lane.tolist()))) == len(set(lane.tolist())) and len(set(zip(plain, lane.tolist()))) == len(set(plain))
    assert (phrases.byte_hashes(words, 1) == hashes[:1]).all() and (phrases.byte_hashes(words[5:9], 2) == hashes[:, 5:9]).all()
    bounds = [(a, b) for a in range(len(plain)) for b in range(a + 1, len(plain) + 1)]
    digest = phrases.span_digests(hashes, *np.array(bounds).T)
    for lane in digest:
        assert len(set(lane.tolist())) == len({tuple(plain[a:b]) for a, b in bounds}) == len({(tuple(plain[a:b]), d) for (a, b), d in zip(bounds, lane.tolist())})
    assert phrases.byte_hashes(pa.array([], pa.string()), 2).shape == (2, 0)


def test_repeated_lines(spark, corpus):
    got = line_windows.drop_repeated_lines(documents(spark, corpus)).collect()
    assert len(got) == len(corpus)
    seen, expected = set(), {}
    for i, t in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0)):
        if i in expected:
            continue
        lines = t.split("\n") if t is not None else []
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k:k + 3])
            if any(x.strip(" ") for x in w):
                gone |= {k, k + 1, k + 2} if w in seen else set()
                seen.add(w)
        expected[i] = (len(lines), len(gone), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    for r in got:
        assert (r.n_lines, r.n_removed, r.text) == expected[r.doc_id]
        assert (r.id, r.key) == (7, "k")
    assert line_windows.drop_repeated_lines(documents(spark, [])).count() == 0


# --- benchmark passages


def _plain_spans(text, items, width=10):
    fold = lambda t: re.findall(rb"[^ ]+", (t or "").encode().translate(fm_index._FOLD))
    words, hit, names = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            window = w[k:k + width]
            for at in range(len(words) - len(window) + 1):
                if words[at:at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    names.add(str(item))
    return len(words), hit, sorted(names)


@pytest.mark.parametrize("block_words", [1_000_000, 8])
def test_benchmark_passages(spark, corpus, block_words):
    rows = [r for r in corpus if r[0] != 44]
    items = [(1, " ".join(dict(corpus)[4].split()[10:35])), (2, "A b, C!"), (3, None), (4, ""), (5, "zzz yyy"), (6, "one"), (10, "b c a"), (7, "... ---")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = fm_index.find_passages(documents(spark, rows), bench, block_words=block_words)
    got = found.collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        n, hit, names = _plain_spans(texts[r.doc_id], items)
        assert r.n_words == n and r["items"] == names
        assert sorted(x for s in r.spans for x in range(s.begin, s.end)) == sorted(hit)
        assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:]))
    cut = fm_index.cut_passages(documents(spark, rows), found).collect()
    assert len(cut) == len(rows) and {r.id for r in cut} == {7}
    by_id = {r.doc_id: r.text for r in cut}
    assert by_id[0] is None and by_id[1] == "" and by_id[3] == "" and by_id[41].strip() == ""
    assert by_id[7] == texts[7]
    assert fm_index.find_passages(documents(spark, []), bench).count() == 0
    none = fm_index.find_passages(documents(spark, rows), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(rows) and not any(r.spans for r in none)


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 4, 3000)
    text[-1] = 0
    index = fm_index.FMIndex(text.astype(np.int32), 3)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        pattern = rng.integers(1, 4, n)
        low, high = index.search(np.pad(pattern, (7 - n, 0))[None, :], np.array([n]))
        found = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
        assert found == [i for i in range(len(text) - n + 1) if (text[i:i + n] == pattern).all()]


# --- language, toxicity


def test_language(spark):
    rng = random.Random(3)
    en, de = ["the", "house", "with", "water", "thing", "shore"], ["das", "haus", "mit", "wasser", "ding", "straße"]
    rows = [(i, " ".join(rng.choices(en if i % 2 else de, k=12)), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "123 ... !", "de"), (102, "watering thingshore", None), (103, "wasserhaus straßen", None), (None, "the water", None), (104, "WATER " * 30_000, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, kind string")
    model = language.fit(docs, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert got[100] == got[101] == ("und", 0.0)
    assert [got[i][0] for i in (102, 103, None, 104)] == ["en", "de", "en", "en"]
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(60)) and all(0 <= s <= 1 for _, s in got.values())
    nothing = language.fit(docs, F.lit(False))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    plain, bad = [f"word{i}" for i in range(300)], ["scum", "idiot", "loserly", "loserous", "losering"]
    rows = []
    for i in range(400):
        words = rng.choices(plain, k=60)
        if i % 5 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
    docs = documents(spark, [*rows, (900, None), (901, ""), (None, "scum idiot scum"), (903, "word1 " * 50_000)])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(1, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    learn = F.col("doc_id") % 2 == 0
    voters, coefficients = toxicity.fit(docs, labels, learn)
    got = {r.doc_id: r.score for r in toxicity.score(docs, voters, coefficients).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(400)) and all(0 <= s <= 1 for s in got.values())
    assert got[900] == got[901] < 0.5 and got[903] < 0.5
    left = toxicity.reject_toxic(docs, labels, learn)
    assert left.columns == docs.columns and left.count() == sum(s < 0.5 for s in got.values())
    unlearned = toxicity.fit(docs, labels.limit(0), learn)
    assert {round(r.score, 6) for r in toxicity.score(docs, *unlearned).collect()} <= {0.0001}
    assert toxicity.score(documents(spark, []), voters, coefficients).count() == 0


# --- top-k, revisits


def test_top_k(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.3, 8).round(3).tolist()) for i in range(300)]
    rows += [(300, None), (301, [0.1, None] + [0.0] * 6), (302, [float("nan")] + [0.1] * 7), (303, [float("inf")] * 8), (350, [0.5] * 4), (351, []), (50, rows[50][1]), (400, rows[9][1]),
             (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(5)).withColumn("v", F.lit("c"))
    got = collected(top_k.top_k(table, F.col("id") % 50 == 0, chunk=70, block=3), "query_id", "rank", "vec_id", "score")
    whole = [(i, [int(np.floor(x * 256)) for x in v] + [0] * (8 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, v in {(i, tuple(v)) for i, v in whole if i % 50 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in whole if i != q)[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(expected)
    assert top_k.top_k(table.limit(0), F.col("id") % 50 == 0).count() == 0
    few = top_k.top_k(table.where("vec_id in (0, 1, 2)"), F.col("id") % 50 == 0)
    assert few.count() == 2


RECORDS = "record_id long, record_type string, url string, captured_at timestamp, headers map<string,string>, payload_digest string, slice long, own string"


def test_revisits(spark):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    full = lambda i, url, h, tag, **more: (i, "response", url, at(h) if h is not None else None, {"ETag": tag, "Content-Length": "9", "X": "old"} | more, f"d{i}", 1, "o")
    again = lambda i, url, h, headers: (i, "revisit", url, at(h) if h is not None else None, headers, None, 1, "o")
    rows = [
        full(1, "http://WWW.Site.org:80/a/?b=2&a=1#x", 0, "t1"), full(2, "https://site.org/a?a=1&b=2", 30, "t2"), full(3, "site.org/a?a=1&b=2&utm_x=1", 30, "t3"),
        full(4, None, 1, "t"), full(5, "http://n.org/", None, "t"), full(6, "http://m.org/q", 5, "t", **{"last-modified": "Mon"}),
        again(10, "https://site.org/a/?b=2&a=1", 20, {"etag": 'W/t1', "x": "new", "content-length": "0"}), again(11, "http://site.org/a?a=1&b=2", 300, {"etag": "t3"}),
        again(12, "http://site.org/a?a=1&b=2", 30, {"etag": "t1"}), again(13, "http://site.org/a?a=1&b=2", 31, {"etag": "t2"}), again(14, "http://site.org/a?a=1&b=2", -1, {"etag": "t1"}),
        again(15, None, 9, None), again(16, "http://n.org/", None, {}), again(17, "http://m.org/q", 6, {"Last-Modified": "Mon", "LAST-MODIFIED": "Tue"}),
        again(18, "http://m.org/q", 7, {}), again(19, "http://m.org/q", 8, {"last-modified": "Tue"}), again(10, "https://site.org/a/?b=2&a=1", 20, {"etag": "t1"}),
    ]
    in_order = F.create_map(*[F.lit(x) for x in ("Last-Modified", "Mon", "LAST-MODIFIED", "Tue")])  # a map made here keeps its order; one from Python need not
    records = spark.createDataFrame(rows, RECORDS).withColumn("headers", F.when(F.col("record_id") == 17, in_order).otherwise(F.col("headers")))
    got = sorted((r.record_id, r.outcome, r.response_id, r.payload_digest) for r in revisits.resolve_revisits(records).collect())
    assert got == sorted([
        (10, "resolved", 1, "d1"), (10, "resolved", 1, "d1"), (11, "resolved", 3, "d3"), (12, "resolved", 1, "d1"), (13, "validator_mismatch", None, None),
        (14, "no_earlier_response", None, None), (15, "no_earlier_response", None, None), (16, "no_earlier_response", None, None), (17, "resolved", 6, "d6"),
        (18, "unchecked", 6, "d6"), (19, "validator_mismatch", None, None)], key=lambda r: r[0])
    headers = {r.record_id: r.headers for r in revisits.resolve_revisits(spark.createDataFrame(rows[:7], RECORDS)).collect()}
    assert headers[10] == {"etag": "W/t1", "x": "new", "content-length": "9"}
    assert revisits.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_words_hold_letters_only():
    assert language.words_of("\u00bd \u2461 \u2167 x\u00b2y 12 Stra\u00dfe \u4e00\u4e8c a_b") == ["x", "y", "stra\u00dfe", "\u4e00\u4e8c", "a", "b"]
    assert language.words_of("\u00bd\u2461\u2167 7") == [] and language.words_of(None) == []


def test_items_without_an_id_still_cover_words(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = documents(spark, [(1, f"a {text} b"), (2, "nothing here")])
    items = spark.createDataFrame([(None, text), ("x", "three four five six seven eight nine ten eleven twelve")], "item_id string, text string")
    got = {r["doc_id"]: r for r in fm_index.find_passages(docs, items).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(1, 12)] and got[1]["items"] == [] and got[2]["spans"] == []


def test_large_components_take_part(spark):
    rows = [(0, [1.0, 2.0]), (50, [3.0, -1.0]), (1, [1e12, 0.0]), (2, [2.0**40, 5.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0])]
    got = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, 2)
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows[:4]}
    expected = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:2]
        expected += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == expected
    far = spark.createDataFrame([(0, [2.0**50]), (1, [2.0**50])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception):
        top_k.top_k(far, F.col("id") % 50 == 0).collect()
    with pytest.raises(Exception):
        top_k.top_k(spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
