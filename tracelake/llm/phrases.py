"""Removing repeated passages, located by Aho-Corasick automata over confirmed phrases.

A window of ``width`` words that occurs more than once keeps its first occurrence, by
(id, place in the text); every word that a later occurrence covers is removed. Windows are
judged on the input.

1. Candidates: the anchor of a window is its ``gram``-word piece with the smallest hash, so
   equal windows have equal anchors. Anchors of all texts are counted; only the windows of
   an anchor that occurs again can recur. Windows that follow each other under one anchor
   are one span.
2. Confirmation and automata: spans are dealt to shards by their anchor. A shard counts the
   windows in its spans, word by word, and compiles those that recur into an automaton
   (pyahocorasick, one symbol per group of words). All its spans run through the automaton, which
   locates every occurrence and gives each phrase its smallest document.
3. Every span of every document gets its phrases' first documents back, by the span's
   digest. Repeats inside one document are found where the document is read last.

A span that many documents share goes to its shard once per batch of documents, with a
count. An anchor of more than ``HOT`` occurrences, with ever different words around it,
deals its windows by their own hash instead. So no shard grows with one phrase; shards are
as many as the spans need. Joins back are split by adaptive execution.

Defined cases: null and empty texts have no words; texts of fewer words than a window are
kept; ids are whole numbers, null ids come first and rows of one id do not precede each
other; rows of one id and one text share their result, and repeated rows are kept as often as
they come; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import chain, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, arrow_map, byte_hashes, gathered, sliced_by_bytes, span_digests, split_flat, stored, window_hashes

WIDTH = 20
GRAM = 5
#: Occurrences of an anchor from which its windows are dealt one by one.
HOT = 1_000
#: Spans of a shard, about.
SHARD_SPANS = 8_000
_FIRST = -(1 << 63)
_NOWHERE = (1 << 63) - 1
#: Stands for a group of words that no phrase has.
_OTHER = "\xff\xff"


def spans_of(hashes: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, first window, last window) of every run of windows with one anchor; windows by their first word."""
    nothing = (np.empty(0, np.int64),) * 4
    if len(hashes) < width:
        return nothing
    pieces = window_hashes(hashes, gram)
    covered = width - gram + 1
    least, reach = np.arange(len(pieces)), 1
    while reach < covered:  # leftmost smallest piece among `reach`, then twice as many, then `covered`
        by = min(reach, covered - reach)
        a, b = least[:-by], least[by:]
        least, reach = np.where(pieces[a] <= pieces[b], a, b), reach + by
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    window = np.flatnonzero(text[:len(least)] == text[width - 1:])
    if not len(window):
        return nothing
    anchor = least[window]
    new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(window) != 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(window)]]) - 1
    return text[window[first]], pieces[anchor[first]].view(np.int64), window[first], window[last]


def _marked_twice(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (text, value) pairs in order of text, and which of them come more than once."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(value) != 0)]) if len(text) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return text[first], value[first], np.diff(np.concatenate([first, [len(text)]])) > 1


def _lists(text: np.ndarray, values: np.ndarray, count: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(count + 1)).astype(np.int32)), pa.array(values))


def _anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(key, anchors, inside, again) of every text with a window: its different anchors, those it has more than once, and
    whether one of its windows seems to repeat inside it."""
    def run(batches):
        for batch in batches:
            at = 0
            for texts in sliced_by_bytes(batch[1], SLICE_BYTES):
                words, offsets = split_flat(texts)
                hashes = byte_hashes(words, 1)[0]
                text, anchor, _, _ = spans_of(hashes, offsets, width, gram)
                text, anchor, twice = _marked_twice(text, anchor)
                again = np.zeros(len(texts), bool)
                if twice.any():
                    again[text[twice]] = True
                    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
                    window = np.flatnonzero((owner[:len(owner) - width + 1] == owner[width - 1:]) & again[owner[:len(owner) - width + 1]])
                    own, _, repeated = _marked_twice(owner[window], window_hashes(hashes, width)[window])
                    again[:] = False
                    again[own[repeated]] = True
                yield {"key": batch[0].slice(at, len(texts)), "anchors": _lists(text, anchor, len(texts)),
                       "inside": _lists(text[twice], anchor[twice], len(texts)), "again": again}
                at += len(texts)

    longs = T.ArrayType(T.LongType(), False)
    schema = T.StructType().add("key", T.LongType()).add("anchors", longs).add("inside", longs).add("again", T.BooleanType())
    return arrow_map(docs.select("key", "text"), run, schema).where(F.size("anchors") > 0)


def _among(text: np.ndarray, anchor: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which (text, anchor) are in the list of that text."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    listed, values = np.repeat(np.arange(len(lists)), sizes), np.asarray(lists.flatten(), np.int64)
    different, which = np.unique(np.concatenate([values, anchor]), return_inverse=True)
    pairs = np.concatenate([listed, text]) * len(different) + which
    return np.isin(pairs[len(values):], pairs[:len(values)])


def _found_spans(batch: pa.RecordBatch, width: int, gram: int):
    """Per slice of the batch (row, shard key, first window in its text, digests, cut) of the spans under recurring anchors;
    columns: text, some, hot. ``cut`` gives the spans with the given numbers: their words joined by one space.
    """
    at = 0
    for texts in sliced_by_bytes(batch[0], SLICE_BYTES):
        words, offsets = split_flat(texts)
        hashes = byte_hashes(words, 2)
        text, anchor, first, last = spans_of(hashes[0], offsets, width, gram)
        some, hot = (_among(text, anchor, batch[i].slice(at, len(texts))) for i in (1, 2))
        size = np.where(hot, last - first + 1, 0)
        single = gathered(np.arange(len(words)), first[hot], size[hot])
        text, alone = np.concatenate([text[some], np.repeat(text, size)]), len(single)
        first, end = np.concatenate([first[some], single]), np.concatenate([last[some], single]) + width
        digest = span_digests(hashes, first, end)
        key = np.concatenate([anchor[some], digest[0, len(first) - alone:]])

        def cut(which: np.ndarray, words=words, first=first, end=end) -> list[bytes]:
            begin = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(words), np.int64) + 1)])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary())), b" ")[0].as_py()
            return [joined[a:b] for a, b in zip(begin[first[which]].tolist(), (begin[end[which]] - 1).tolist())]

        yield at + text, key, first - offsets[text], digest, cut
        at += len(texts)


def located(spans: list[bytes], counts: list[int], docs: list[int], width: int) -> list[list[int | None]]:
    """Per span and window, the smallest document the window occurs in; None for windows that do not recur.

    A symbol of the automaton is a group of ``step`` words, so a phrase has ``width / step`` of them; a span is read once from
    each of its first ``step`` words. A node of the automaton looks through its children one by one, so a group is written with
    two characters of small alphabets.
    """
    import ahocorasick

    split = [s.split(b" ") for s in spans]
    letters = dict(zip(dict.fromkeys(chain.from_iterable(split)), map(chr, chain(range(0x100, 0xD800), range(0xE000, 0x110000)))))
    texts = ["".join(map(letters.__getitem__, words)) for words in split]
    seen: Counter = Counter()
    for text, n in zip(texts, counts):
        for i in range(len(text) - width + 1):
            seen[text[i:i + width]] += n
    step = next(k for k in (5, 4, 3, 2, 1) if width % k == 0)
    parts = [p[i:i + step] for p, n in seen.items() if n > 1 for i in range(0, width, step)]
    out: list[list] = [[None] * (len(t) - width + 1) for t in texts]
    if not parts:
        return out
    groups = dict(zip(dict.fromkeys(parts), map("".join, product(map(chr, range(0x200, 0xD800)), map(chr, range(0x100, 0x200))))))
    symbols = list(map(groups.__getitem__, parts))
    automaton, least, each = ahocorasick.Automaton(), [_NOWHERE] * (len(parts) * step // width), width // step
    for phrase in range(len(least)):
        automaton.add_word("".join(symbols[phrase * each:(phrase + 1) * each]), phrase)
    automaton.make_automaton()
    orders: dict[int, list[int]] = {}
    for row, text, doc in zip(out, texts, docs):
        n = len(text) - step + 1
        if (order := orders.get(n)) is None:
            order = orders[n] = [i for k in range(step) for i in (*range(k, n, step), n)]
        read = [groups.get(text[i:i + step], _OTHER) for i in range(n)]
        read.append(_OTHER)
        for end, phrase in automaton.iter("".join([read[i] for i in order])):
            row[order[end // 2] - width + step] = phrase
            if doc < least[phrase]:
                least[phrase] = doc
    return [[None if p is None else least[p] for p in row] for row in out]


def _confirmed(marked: DataFrame, width: int, gram: int, shards: int) -> DataFrame:
    """(high, low, least): per different span, by its digest, with a phrase that another document has first, its windows' smallest documents."""
    def spans(batches):
        for batch in batches:
            found = list(_found_spans(batch, width, gram))
            row, key, digest = (np.concatenate([x[i] for x in found], -1) for i in (0, 1, 3))
            if not len(row):
                continue
            slices = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            order = np.lexsort((slices, *digest))
            slices, digest, doc = slices[order], digest[:, order], np.asarray(pc.fill_null(batch[3], _FIRST))[row[order]]
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(digest) != 0).any(0)]))
            same = {"doc": np.minimum.reduceat(doc, begin), "count": np.diff(begin, append=len(doc)), "last": np.maximum.reduceat(doc, begin)}
            before = np.cumsum([0, *(len(x[0]) for x in found)])
            for i, (*_, cut) in enumerate(found):  # a span is written with the first slice that has it
                here = slices[begin] == i
                at = order[begin[here]]
                yield {"shard": key[at] % shards, "span": cut(at - before[i])} | {
                    name: values[here] for name, values in same.items()}

    schema = T.StructType().add("shard", T.LongType()).add("span", T.BinaryType())
    for name in ("doc", "count", "last"):
        schema = schema.add(name, T.LongType())
    rows = arrow_map(marked.select("text", "some", "hot", "id"), spans, schema)

    def confirm(group: pa.Table) -> pa.Table:
        same: dict[bytes, list] = {}  # a span comes once per batch that has it
        for text, doc, count, last in zip(*(group[c].to_pylist() for c in ("span", "doc", "count", "last"))):
            if (known := same.get(text)) is None:
                same[text] = [doc, count, last]
            else:
                known[0], known[1], known[2] = min(known[0], doc), known[1] + count, max(known[2], last)
        texts, (docs, counts, lasts) = list(same), zip(*same.values())
        merged = [(t, x) for t, x, last in zip(texts, located(texts, counts, docs, width), lasts) if any(d is not None and d < last for d in x)]
        words, offsets = split_flat(pa.array([t for t, _ in merged], pa.binary()).view(pa.string()))
        high, low = span_digests(byte_hashes(words, 2), offsets[:-1], offsets[1:])
        return pa.table({"high": high, "low": low, "least": pa.array([x for _, x in merged], pa.list_(pa.int64()))})

    out = T.StructType().add("high", T.LongType()).add("low", T.LongType()).add("least", T.ArrayType(T.LongType()))
    return rows.groupBy("shard").applyInArrow(confirm, out)


def _placed(marked: DataFrame, width: int, gram: int) -> DataFrame:
    """(high, low, key, id, first) of every span under a recurring anchor; the first two are its digest."""
    def run(batches):
        for batch in batches:
            for row, _, first, digest, _ in _found_spans(batch, width, gram):
                rows = pa.array(row)
                yield {"high": digest[0], "low": digest[1], "key": batch[3].take(rows), "id": batch[4].take(rows), "first": first}

    schema = T.StructType()
    for name in ("high", "low", "key", "id", "first"):
        schema = schema.add(name, T.LongType())
    return arrow_map(marked.select("text", "some", "hot", "key", "id"), run, schema)


def _repeats_inside(words: list[bytes], width: int) -> list[int]:
    seen: set[tuple] = set()
    out = []
    for i, window in enumerate(zip(*(words[k:] for k in range(width)))):
        if window in seen:
            out.append(i)
        seen.add(window)
    return out


def _kept(rows: DataFrame, width: int, id_col: str, id_type: T.DataType, with_text: bool) -> DataFrame:
    schema = (T.StructType().add(id_col, id_type).add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_sha256", T.StringType()))
    if with_text:
        schema = schema.add("kept", T.StringType())

    def run(batches):
        for batch in batches:
            n, removed, digests, kept = [], [], [], []
            for text, again, starts in zip(*(batch[i].to_pylist() for i in (1, 2, 3))):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                left, n_words = words, len(words)
                if starts := [*(starts or ()), *(_repeats_inside(words, width) if again else ())]:
                    gone = np.zeros(n_words, bool)
                    gone[(np.unique(starts)[:, None] + np.arange(width)).ravel()] = True
                    left = [words[i] for i in np.flatnonzero(~gone).tolist()]
                n.append(n_words)
                removed.append(n_words - len(left))
                left = b" ".join(left)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "surrogatepass") if with_text else None)
            yield {"id": batch[0], "n": n, "removed": removed, "digest": digests} | ({"kept": kept} if with_text else {})

    return arrow_map(rows, run, schema)


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM,
                           with_text: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed and kept_sha256 of the kept words joined by one space (and ``kept``, if asked for)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    anchors = stored(_anchors(rows, width, gram), "anchors")
    counted = anchors.select(F.explode(F.concat("anchors", "inside")).alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = stored(counted.select("anchor", "n", (F.col("n") > HOT).alias("hot")), "recurring")
    spans = counted.agg(F.sum(F.when(F.col("hot"), 8 * F.col("n")).otherwise(F.col("n")))).first()[0] or 0
    each = anchors.select("key", "again", F.explode("anchors").alias("anchor"))
    some, hot = (F.collect_list(F.when(F.col("hot") == h, F.col("anchor"))).alias(name) for name, h in (("some", False), ("hot", True)))
    lists = each.join(counted.select("anchor", "hot"), "anchor").groupBy("key").agg(some, hot, F.max("again").alias("again"))
    texts = stored(rows.join(lists, "key", "left"), "texts")
    marked = texts.where(F.col("some").isNotNull())
    least = stored(_confirmed(marked, width, gram, max(1, -(-spans // SHARD_SPANS))), "phrases")
    back = _placed(marked, width, gram).join(least, ["high", "low"])
    before = F.coalesce(F.col("id"), F.lit(_FIRST))
    starts = F.filter(F.transform("least", lambda x, i: F.when(x < before, F.col("first") + i)), lambda x: x.isNotNull())
    gone = stored(back.select("key", starts.alias("starts")).where(F.size("starts") > 0).groupBy("key").agg(
        F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")), "starts")
    last = texts.select("id", "text", "again", "key").join(gone, "key", "left")
    return _kept(last.select("id", "text", "again", "starts"), width, id_col, T.LongType(), with_text)
