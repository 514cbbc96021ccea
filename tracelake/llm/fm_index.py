"""Removing benchmark passages from training text with an FM-index per shard.

Test items become windows of ``width`` consecutive words (a shorter item is one window).
Each task reads its documents in shards of about ``SHARD_WORDS`` words and builds an
FM-index of a shard: suffix order by prefix doubling, the Burrows-Wheeler transform in a
wavelet tree, and every ``SAMPLE``-th suffix position. All windows are searched backwards
at once through the tree's ranks; occurrences are located by walking to a sampled
position, and merged to spans of words per document.

Words that no test item has cannot be part of an occurrence. They only separate runs of
known words, and runs shorter than the shortest window are left out of the index.

Nothing is shuffled for the search. The windows go to all tasks in blocks of at most
about ``BLOCK_WORDS`` words of test items, the bound of what is broadcast; a larger test
set is searched in several passes whose spans are merged per document.

Defined cases: null or empty text has no words and no spans; items of null or empty text have
no windows, an item without an id covers words but is not named, and an empty test set or
table gives rows without spans or no rows; null and
repeated ids are rows like any other; other columns are ignored or passed on, whatever
their names.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, column_type

WIDTH = 10
SHARD_WORDS = 2_000_000
BLOCK_WORDS = 1_000_000
SAMPLE = 16
#: Occurrences located together.
AT_ONCE = 1 << 20
#: A-Z in lower case; other ASCII characters than letters and digits become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def folded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD) if text else b""


class BitRank:
    """A bit vector with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, low = i >> 6, np.uint64(1) << (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & (low - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector per level, zeros of a level before its ones."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = []
        for shift in reversed(range(max(1, int(largest).bit_length()))):
            bit = (symbols >> shift) & 1 == 1
            self.levels.append((shift, int(len(bit) - bit.sum()), BitRank(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before position ``i``."""
        start, end = np.zeros_like(i), i.copy()
        for shift, zeros, bits in self.levels:
            one = (symbol >> shift) & 1 == 1
            s, e = bits.rank(start), bits.rank(end)
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling. Symbol 0 separates and each 0 counts as different, in order; the text ends with 0."""
    n, stops = len(text), np.flatnonzero(text == 0)
    key = text.astype(np.int64) + len(stops)
    key[stops] = np.arange(len(stops))
    order = np.argsort(key, kind="stable")
    head = np.concatenate([[True], np.diff(key[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        tied = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
        if not len(tied):
            return order
        own = order[tied]
        key = rank[own] * n + rank[own + step]
        by = np.argsort(key, kind="stable")
        key, own = key[by], own[by]
        order[tied] = own
        head[tied] = np.concatenate([[True], np.diff(key) != 0])
        rank[own] = np.maximum.accumulate(np.where(head[tied], tied, 0))
        step *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, largest: int):
        order = suffix_order(text)
        self.last = text[order - 1]
        self.last[order == 0] = 0
        self.tree = WaveletTree(self.last, largest)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        known = (order % SAMPLE == 0) | (self.last == 0)  # a walk ends at the start of a run at the latest
        self.marked, self.sampled = BitRank(known), order[known]
        self.rows = len(text)

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of windows, which stand right-aligned in their rows."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.rows, np.int64)
        width = windows.shape[1]
        for back in range(width):
            on = np.flatnonzero((lengths > back) & (low < high))
            symbol = windows[on, width - 1 - back]
            both = self.first[np.tile(symbol, 2)] + self.tree.rank(np.tile(symbol, 2), np.concatenate([low[on], high[on]]))
            low[on], high[on] = both[:len(on)], both[len(on):]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, walking, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(walking):
            here = rows[walking]
            done = self.marked.get(here)
            at[walking[done]] = self.sampled[self.marked.rank(here[done])] + steps
            walking, here, steps = walking[~done], here[~done], steps + 1
            symbol = self.last[here]
            rows[walking] = self.first[symbol] + self.tree.rank(symbol, here)
        return at


class Phrases:
    """Windows of test items as numbers of words; what tasks get."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple, set[int]] = {}
        self.items = sorted({str(i) for i, _ in items if i is not None})
        place = {x: k for k, x in enumerate(self.items)}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in folded(text).split()]
            for at in range(max(1, len(words) - width + 1) if words else 0):
                owners = windows.setdefault(tuple(words[at:at + width]), set())
                if item is not None:
                    owners.add(place[str(item)])
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.windows = np.zeros((len(windows), width), np.int64)
        for row, w in enumerate(windows):
            self.windows[row, width - len(w):] = w
        self.owners = np.concatenate([np.fromiter(sorted(x), np.int64) for x in windows.values()]) if windows else np.empty(0, np.int64)
        self.owned = np.concatenate([[0], np.cumsum([len(x) for x in windows.values()])]).astype(np.int64)

    def find(self, docs: list[np.ndarray]) -> tuple[list[list], list[list[str]]]:
        """Merged spans and items of every document of a shard, given as word numbers (0: in no item)."""
        sizes = np.array([len(x) + 1 for x in docs], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        words = np.zeros(begin[-1], np.int32)
        for at, x in zip(begin.tolist(), docs):
            words[at:at + len(x)] = x
        spans, items = [[] for _ in docs], [[] for _ in docs]
        edge = np.diff(np.concatenate([[0], (words > 0).view(np.int8), [0]]))
        heads, tails = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(self.lengths):
            long = tails - heads >= self.lengths.min()
            heads, tails = heads[long], tails[long]
        if not len(self.lengths) or not len(heads):
            return spans, items
        run = tails - heads + 1  # with the separator
        source = np.repeat(heads - np.concatenate([[0], np.cumsum(run)[:-1]]), run) + np.arange(run.sum())
        index = FMIndex(words[source], len(self.numbers))
        low, high = index.search(self.windows, self.lengths)
        cover, pairs = np.zeros(len(words) + 1, np.int32), []
        for window, row in _ranges(low, high):
            at = source[index.locate(row)]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + self.lengths[window], -1)
            doc = np.searchsorted(begin, at, "right") - 1
            many = self.owned[window + 1] - self.owned[window]
            owner = self.owners[np.repeat(self.owned[window] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            pairs.append(np.unique(np.repeat(doc, many) * len(self.items) + owner))
        for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else []:
            items[pair // len(self.items)].append(self.items[pair % len(self.items)])
        edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).view(np.int8)]))
        heads, tails = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for a, b, d in zip(heads.tolist(), tails.tolist(), (np.searchsorted(begin, heads, "right") - 1).tolist()):
            spans[d].append({"begin": a - int(begin[d]), "end": b - int(begin[d])})
        return spans, items


def _ranges(low: np.ndarray, high: np.ndarray):
    """(window, row) of all rows of all ranges, at most AT_ONCE at a time."""
    hit = np.flatnonzero(low < high)
    many = high[hit] - low[hit]
    total = np.concatenate([[0], np.cumsum(many)])
    for at in range(0, int(total[-1]), AT_ONCE):
        flat = np.arange(at, min(at + AT_ONCE, int(total[-1])))
        which = np.searchsorted(total, flat, "right") - 1
        yield hit[which], low[hit[which]] + flat - total[which]


SPANS = T.ArrayType(T.StructType().add("begin", T.LongType()).add("end", T.LongType()))


def _searched(docs: DataFrame, id_col: str, text_col: str, phrases: Phrases) -> DataFrame:
    schema = (T.StructType().add(id_col, column_type(docs, id_col)).add("text_hash", T.LongType()).add("n_words", T.LongType())
              .add("spans", SPANS).add("items", T.ArrayType(T.StringType())))

    def run(batches):
        number = phrases.numbers.get
        ids, hashes, words, total = [], [], [], 0

        def found():
            spans, items = phrases.find(words)
            return {"id": ids, "hash": hashes, "n": [len(x) for x in words], "spans": spans, "items": items}

        for batch in batches:
            for name, hashed, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(name)
                hashes.append(hashed)
                words.append(np.array([number(w, 0) for w in folded(text).split()], np.int32))
                total += len(words[-1]) + 1
                if total >= SHARD_WORDS:
                    yield found()
                    ids, hashes, words, total = [], [], [], 0
        if ids:
            yield found()

    return arrow_map(docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), text_col), run, schema)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, block_words: int) -> list[Phrases]:
    """The test set, collected and prepared block by block; a block's size is checked by counting characters first."""
    chars = benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0
    count = max(1, -(-chars // (6 * block_words)))
    rows = benchmark.select(item_col, text_col)
    if count == 1:
        return [Phrases([tuple(r) for r in rows.collect()], width)]
    numbered = rows.withColumn("_block", F.pmod(F.xxhash64(item_col), F.lit(count)))
    return [Phrases([tuple(r)[:2] for r in numbered.where(F.col("_block") == b).collect()], width) for b in range(count)]


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row: id, text_hash, n_words, spans of hit words (begin, end; merged, sorted) and items with occurring windows (sorted)."""
    parts = [_searched(docs, id_col, text_col, p) for p in _blocks(benchmark, item_col, item_text_col, width, block_words)]
    if len(parts) == 1:
        return parts[0]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    whole = whole.groupBy(id_col, "text_hash", "n_words").agg(
        F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count(F.lit(1)) / len(parts)).cast("int").alias("_rows"))

    def merged(batches):
        for batch in batches:
            ids, hashes, n, spans, items, rows = batch.columns
            joined = []
            for of_row in spans.to_pylist():
                out = []
                for s in of_row:
                    if out and s["begin"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], s["end"])
                    else:
                        out.append(s)
                joined.append(out)
            yield {"id": ids, "hash": hashes, "n": n, "spans": joined, "items": items, "rows": rows}

    whole = arrow_map(whole, merged, whole.schema)
    return whole.withColumn("_rows", F.explode(F.array_repeat(F.lit(1), F.col("_rows")))).drop("_rows")


def cut_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words in ``found``'s spans, and what stands between words of one span; columns as before."""
    spans = (found.where(F.size("spans") > 0).select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
             .dropDuplicates(["_id", "_hash"]))
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col(id_col).alias("_own"), F.xxhash64(text_col).alias("_text_hash"))
    rows = own.join(spans, (F.col("_hash") == F.col("_text_hash")) & F.col("_own").eqNullSafe(F.col("_id")), "left").select("_row.*", "_spans")
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch[at].to_pylist()
            for i, of_row in enumerate(batch[len(names)].to_pylist()):
                if of_row:
                    raw = texts[i].encode("utf-8", "surrogatepass")
                    words, out, last = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_FOLD))], [], 0
                    for s in of_row:
                        out.append(raw[last:words[s["begin"]][0]])
                        last = words[s["end"] - 1][1]
                    texts[i] = b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")
            yield {k: texts if k == at else batch[k] for k in range(len(names))}

    return arrow_map(rows, run, docs.schema)
