"""Near duplicates by bottom-k sketches from one hash function.

1. Each text becomes its set of word shingles. Texts with equal sets are one class, and
   all that follows is about classes, so copies of a text are never paired. A class is
   known by a 128-bit digest of its set, not by a document id.
2. The sketch of a set is its ``k`` smallest shingle hashes. Sets with a Jaccard
   similarity of at least ``threshold`` must share ``needed(n)`` retained values: exactly,
   as long as a sketch can hold their union; else up to the tail of a random draw that a
   link at the threshold misses with a probability of 1e-6 (see ``needed``).
3. An inverted list per retained value is built only over the rarest
   ``len(sketch) - needed + 1`` values of each sketch, in one order for all, so that
   similar sets still meet in a list. Values of one class fill these places first and lead
   nowhere; a passage that many documents share leads nowhere, unless it is most of a
   document.
4. Lists first give the pairs of their first member with all others. Sizes and bitmaps of
   the sketches drop most pairs where they are made, without dropping a link; the rest are
   filtered by the sketch of the union, then verified on the full sets of word shingles.
   Verified links make components, so a group of thousands of near copies costs a star.
5. Lists whose other members are in different components go on as clusters, one for all
   lists with the same first member. A cluster is cut into blocks, and pairs of blocks are
   compared as matrices of retained values, of which only pairs that join components come
   out, to be verified as before. Every pair of different components in a list is tried, so
   no link is left out; a set of up to ``WIDE`` shingles is retained whole, and for larger
   ones a link at the threshold is missed with a further 1e-6. A cluster of sets that
   resemble each other below the threshold still costs comparisons with its square, but
   rows with its square over ``BLOCK`` only.

Leaders are ranked with a limit per task; lists are aggregated with map-side combine or
joined, so the rows of a hot value are split by adaptive execution.

Defined cases: null and empty texts and texts without words have an empty set and no
links; fewer words than a shingle are one shingle; rows that repeat an id share its fate
if their texts agree, else each counts by its own text; a null id is its own component
unless linked to others, and is kept only if no row with an id is reachable; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (SLICE_BYTES, arrow_map, ascii_words, column_type, fewer_tasks, sliced_by_bytes, split_flat, stored, stored_in_small_batches,
                     window_hashes, word_hashes)
from .components import components

SHINGLE = 5
THRESHOLD = 80
SKETCH = 96
#: First members of a list that are paired with all others before blocks are compared; they settle groups of near copies.
LEADERS = 1
#: Retained values where blocks of sets are compared; sets of up to so many shingles are compared whole.
WIDE = 512
#: Members of a block, about, and rows of a group in which pairs of blocks are compared.
BLOCK, GROUP_ROWS = 256, 2_000
#: Longs of the bitmap that stands for a sketch where pairs are made; pairs with too few bits in common are not.
BITMAP = 8
#: Pairs up to which texts are picked out by a broadcast of their keys (40 bytes a pair), not by a shuffle of all texts.
FEW_PAIRS = 50_000
#: Rows of the input of a task, and pairs to verify of one, at least, where tables are written between the steps.
TASK_ROWS, TASK_PAIRS = 2_000, 256
#: Miss probability of a link at the threshold, for the overlap that two sketches must have.
MISS = 1e-6


def needed(n: int, k: int, threshold: int) -> int:
    """Retained values that a set of ``n`` shingles shares with any set of at least the threshold.

    The union of the two has at most ``n / threshold`` members. Where all of them fit into a
    sketch, the shared ones are counted exactly. Else the ``k`` smallest of the union are a
    draw from it, and the result is the largest count that such a draw falls short of with a
    probability of at most MISS.
    """
    union = n * 100 // threshold
    if union <= k:
        return -(-n * threshold // 100)
    return min(_of_draw(union, k, threshold), -(-n * threshold // 100))


def _of_draw(union: int, k: int, threshold: int) -> int:
    common = -(-union * threshold // 100)
    below, c, all_ = 0.0, 0, math.lgamma(union + 1) - math.lgamma(k + 1) - math.lgamma(union - k + 1)
    ways = lambda m, r: math.lgamma(m + 1) - math.lgamma(r + 1) - math.lgamma(m - r + 1)
    while True:
        if k - c <= union - common:
            below += math.exp(ways(common, c) + ways(union - common, k - c) - all_)
        if below > MISS:
            return c
        c += 1


def _needed(n: Column, k: int, threshold: int) -> Column:
    """``needed`` as an expression: exact for small sets, then steps down to what sets of any size share."""
    top = k * threshold // 100
    last = needed(top + 1, k, threshold)
    out = F.lit(last)
    for size in [*range(top + 2, 20 * k), 10**4, 10**5, 10**7]:
        if (c := needed(size, k, threshold)) != last:
            out = out + F.when(n >= size, c - last).otherwise(0)
            last = c
    return F.when(n <= top, F.ceil(n * threshold / 100)).otherwise(out)


def shingles(words: list, size: int) -> set:
    """The exact set: tuples of words, or all words of a shorter text."""
    return set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else {tuple(words)} if words else set()


def _set_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The different shingle hashes of a text in order, from its word hashes."""
    return np.unique(window_hashes(words, min(len(words), size)) >> np.uint64(1)).astype(np.int64) if len(words) else np.empty(0, np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, k: int, with_sketch: bool = True) -> DataFrame:
    """Per row: id, text hash, set size, class key (null for an empty set) and sketch."""
    schema = T.StructType().add(id_col, column_type(docs, id_col)).add("text_hash", T.LongType()).add("n", T.LongType()).add("key", T.BinaryType())
    if with_sketch:
        schema = schema.add("sketch", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            sizes, keys, kept = [], [], []
            for texts in sliced_by_bytes(batch[2], SLICE_BYTES):
                words, offsets = split_flat(pc.ascii_lower(texts))
                hashes = word_hashes(words)
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    values = _set_hashes(hashes[a:b], size)
                    sizes.append(len(values))
                    keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if b > a else None)
                    kept.append(values[:k])
            yield {"id": batch[0], "hash": batch[1], "n": sizes, "key": keys} | ({"sketch": kept} if with_sketch else {})

    return arrow_map(docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), text_col), run, schema)


def inverted_lists(classes: DataFrame, k: int, threshold: int) -> DataFrame:
    """(value, node) over the rarest values of every sketch, for values that at least two classes retain."""
    postings = classes.select("node", F.col("n").cast("int").alias("n"), F.explode("sketch").alias("value"))
    often = postings.groupBy("value").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1")
    shared = postings.join(often, "value").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    kept = F.least(F.col("n"), F.lit(k))
    places = kept - _needed(F.col("n"), k, threshold) + 1 - (kept - F.size("values"))  # own values take the first places
    return shared.where(places > 0).select("node", F.explode(F.slice("values", F.lit(1), places.cast("int"))).alias("v")).select("v.value", "node")


def _bitmap(sketch: Column) -> Column:
    """BITMAP longs in which each retained value sets one bit."""
    place = lambda v: F.pmod(v, F.lit(64 * BITMAP)).cast("int")
    places = F.transform(sketch, place)
    of_word = lambda w: F.aggregate(
        F.filter(places, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda bits, b: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)))
    return F.array(*[of_word(w) for w in range(BITMAP)])


def _bits(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(F.col(a), F.lit(w)).bitwiseAND(F.get(F.col(b), F.lit(w)))) for w in range(BITMAP)])


def _leaders(rows: DataFrame, count: int) -> DataFrame:
    by = Window.partitionBy("value").orderBy("node")
    first = rows.withColumn("_at", F.row_number().over(by)).where(F.col("_at") <= count)
    return first.select("value", F.col("node").alias("leader"), F.col("n").alias("ln"), F.col("bits").alias("lbits"))


def _may_be_alike(k: int, threshold: int) -> Column:
    """No pair of at least the threshold fails: sizes, and bits in common plus those that a sketch's own values share."""
    ratio = F.least("n", "ln") * 100 >= F.greatest("n", "ln") * threshold
    shared = lambda n, bits: F.least(F.col(n), F.lit(k)) - _bits(bits, bits)
    return ratio & (_bits("bits", "lbits") + F.least(shared("n", "bits"), shared("ln", "lbits")) >= _needed(F.least("n", "ln"), k, threshold))


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sizes and union sketch allow the threshold, as class keys (ka, kb)."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("key").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where("ka != kb")
    least = _needed(F.least("na", "nb"), k, threshold)
    ratio = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold) & (F.size(F.array_intersect("sa", "sb")) >= least)
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    whole = (F.col("na") <= k) & (F.col("nb") <= k) & (F.size(F.array_union("sa", "sb")) <= k)
    enough = F.when(whole, common * 100 >= F.size(union) * threshold).otherwise(common >= least)
    return both.where(ratio).where(enough).select("ka", "kb")


def _verified(pairs: DataFrame, many: int, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Pairs (ka, kb) whose full shingle sets reach the threshold. Many pairs share ``ka``; its set is built once in a row."""
    def side(x: str) -> DataFrame:
        wanted = texts.join(F.broadcast(pairs.select(F.col(f"k{x}").alias("key")).distinct()), "key", "left_semi") if many <= FEW_PAIRS else texts
        return wanted.select(F.col("key").alias(f"k{x}"), F.col("text").alias(f"t{x}"))

    rows = fewer_tasks(pairs.join(side("b"), "kb").join(side("a"), "ka").select("ka", "kb", "ta", "tb"), many, TASK_PAIRS)

    def run(batches):
        last, one = None, set()
        for batch in batches:
            for at in range(0, len(batch), 256):
                good_a, good_b = [], []
                for ka, kb, ta, tb in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if ka != last:
                        last, one = ka, shingles(ascii_words(ta), size)
                    other = shingles(ascii_words(tb), size)
                    common = len(one & other)
                    if 100 * common >= threshold * (len(one) + len(other) - common):
                        good_a.append(ka)
                        good_b.append(kb)
                yield {"u": good_a, "v": good_b}

    return arrow_map(rows, run, T.StructType().add("u", T.BinaryType()).add("v", T.BinaryType()))


def _star(lists: DataFrame, classes: DataFrame, texts: DataFrame, total: int, size: int, k: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (u, v) of the first member of every list with its others, and the first members (value, node)."""
    led = _leaders(lists, LEADERS)
    pairs = lists.join(led, "value").where(F.col("node") > F.col("leader")).where(_may_be_alike(k, threshold))
    pairs = pairs.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    close = stored(fewer_tasks(_estimated(pairs, classes, k, threshold), total, TASK_ROWS), "pairs")
    return _verified_links(close, texts, size, threshold), led.select("value", F.col("leader").alias("node"))


def _verified_links(close: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    if not (many := close.count()):
        return close.select(F.col("ka").alias("u"), F.col("kb").alias("v"))
    return stored_in_small_batches(_verified(close, many, texts, size, threshold), "links")


def _block_pairs(rows: DataFrame, total: int) -> DataFrame:
    """(leader, lo, hi, block, node, part): every member of a cluster in each pair of blocks that it is compared in.

    A cluster is the union of the lists with one first member, so that sets that share many
    values meet once. Members that are linked with the first one are in blocks of their own,
    which are not compared with each other.
    """
    first = rows.groupBy("value").agg(F.min(F.struct("node", "part")).alias("first"))
    inside = (F.col("part") == F.col("first.part")).alias("inside")
    members = rows.join(first, "value").select(F.col("first.node").alias("leader"), "node", "part", inside).distinct()
    members = stored(fewer_tasks(members, total, TASK_ROWS), "clusters")
    blocks = lambda cond: F.ceil(F.count_if(cond) / BLOCK).cast("int")
    sizes = members.groupBy("leader").agg(blocks(~F.col("inside")).alias("others"), blocks(F.col("inside")).alias("own")).where("others > 0")
    placed = members.join(sizes, "leader").withColumn("block", F.when(F.col("inside"), F.col("others") + F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(
        F.pmod(F.xxhash64("node"), F.col("others"))).cast("int"))
    against = F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("others")).otherwise(F.col("others") + F.col("own")) - 1)).alias("_against")
    return placed.select("leader", "node", F.xxhash64("part").alias("part"), "block", against).select(
        "leader", F.least("block", "_against").alias("lo"), F.greatest("block", "_against").alias("hi"), "block", "node", "part")


def _wide_sketches(texts: DataFrame, size: int, k: int) -> DataFrame:
    """(node, n, values): set size and the ``k`` smallest hashes, for sets of up to ``k`` all of them."""
    schema = T.StructType().add("node", T.LongType()).add("n", T.LongType()).add("values", T.ArrayType(T.LongType(), False))

    def run(batches):
        for batch in batches:
            at = 0
            for part in sliced_by_bytes(batch[1], SLICE_BYTES):
                sizes, kept = [], []
                words, offsets = split_flat(pc.ascii_lower(part))
                hashes = word_hashes(words)
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    values = _set_hashes(hashes[a:b], size)
                    sizes.append(len(values))
                    kept.append(values[:k])
                yield {"node": batch[0].slice(at, len(part)), "n": sizes, "values": kept}
                at += len(part)

    return arrow_map(texts.select(F.xxhash64("key").alias("node"), "text"), run, schema)


def _common(values: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each row of ``left`` shares with each row of ``right``; a row's values are different ones."""
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    _, which, count = np.unique(values, return_inverse=True, return_counts=True)
    row, which = row[count[which] > 1], which[count[which] > 1]
    order = np.argsort(which, kind="stable")
    row, which = row[order], np.cumsum(np.diff(which[order], prepend=which[order][:1]) != 0)
    place = np.full((2, len(ends)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(which[-1]) + 1 if len(which) else 0, 4096):
        a, b = np.searchsorted(which, (at, at + 4096))
        sides = []
        for side, rows in zip(place, (left, right)):
            one, seen = np.zeros((len(rows), 4096), np.float32), side[row[a:b]]
            one[seen[seen >= 0], which[a:b][seen >= 0] - at] = 1
            sides.append(one)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _linked(part: np.ndarray, n: np.ndarray, values: np.ndarray, ends: np.ndarray, block: np.ndarray, k: int, threshold: int) -> list[tuple[int, int]]:
    """Pairs of rows of two blocks (or one) that join different parts: of whole sets one pair for each two parts that it
    joins, of larger sets all pairs whose sketches allow the threshold."""
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    common = _common(values, ends, left, right)
    a, b = n[left][:, None], n[right][None, :]
    whole = (a <= k) & (b <= k)
    alike = np.where(whole, 100 * common >= threshold * (a + b - common),
                     (100 * np.minimum(a, b) >= threshold * np.maximum(a, b)) & (common >= needed(10**7, k, threshold)))
    alike &= part[left][:, None] != part[right][None, :]
    if block.min() == block.max():
        alike = np.triu(alike, 1)
    out = [(left[i], right[j]) for i, j in np.argwhere(alike & ~whole).tolist()]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    parts = part.tolist()
    for i, j in np.argwhere(alike & whole).tolist():
        x, y = top(parts[left[i]]), top(parts[right[j]])
        if x != y:
            root[x] = y
            out.append((left[i], right[j]))
    return out


def _compared(pairs: DataFrame, wide: DataFrame, k: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of nodes in different parts that may be linked, found within pairs of blocks; see ``_linked``."""
    pairs = stored(pairs, "blocks")
    groups = max(1, pairs.count() // GROUP_ROWS)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys = [np.asarray(group[c]) for c in ("leader", "lo", "hi")]
        order = np.lexsort(keys)
        group = group.take(pa.array(order))
        new = reduce(np.logical_or, [np.diff(x[order]) != 0 for x in keys])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(order)]
        node, part, n, block = (np.asarray(group[c]) for c in ("node", "part", "n", "block"))
        lists = group["values"].combine_chunks()
        values, ends = np.asarray(lists.flatten()), np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))
        found: list[tuple[int, int]] = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e - s == 1 or (keys[1][order[s]] != keys[2][order[s]] and block[s:e].min() == block[s:e].max()):
                continue  # one of the two blocks has no members
            base = int(ends[s - 1]) if s else 0
            found += [(s + i, s + j) for i, j in _linked(part[s:e], n[s:e], values[base:ends[e - 1]], ends[s:e] - base, block[s:e], k, threshold)]
        a, b = ([int(node[p[i]]) for p in found] for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = pairs.join(wide, "node").withColumn("_group", F.pmod(F.xxhash64("leader", "lo", "hi"), F.lit(groups)))
    return rows.groupBy("_group").applyInArrow(run, T.StructType().add("a", T.LongType()).add("b", T.LongType()))


def _links(lists: DataFrame, classes: DataFrame, texts: DataFrame, total: int, size: int, k: int, threshold: int) -> DataFrame:
    """(node, root) of the components that verified links make. ``total``: rows of the input."""
    edges, led = _star(lists, classes, texts, total, size, k, threshold)
    links = edges.count()
    found = components(edges, links)
    part = found.select(F.xxhash64("node").alias("node"), F.col("root").alias("part"))
    rest = lists.select("value", "node").join(led, ["value", "node"], "left_anti")
    placed = rest.join(part, "node", "left").withColumn("part", F.coalesce("part", F.col("node").cast("string").cast("binary")))
    several = placed.groupBy("value").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi")).where("_lo != _hi").select("value")
    rows = stored(fewer_tasks(placed.join(several, "value"), total, TASK_ROWS), "lists")
    if rows.isEmpty():
        return found
    keys = classes.select("node", "key")
    wide = _wide_sketches(texts.join(keys.join(rows.select("node").distinct(), "node", "left_semi").select("key"), "key", "left_semi"), size, WIDE)
    pairs = stored(fewer_tasks(_compared(_block_pairs(rows, total), wide, WIDE, threshold).distinct(), total, TASK_ROWS), "pairs")
    side = lambda x: keys.select(F.col("node").alias(x), F.col("key").alias(f"k{x}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").where("ka != kb").select("ka", "kb")
    close = stored(fewer_tasks(close, total, TASK_ROWS), "pairs")
    new = _verified_links(close, texts, size, threshold)
    return components(edges.unionAll(new), links + more) if (more := new.count()) else found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD,
                    k: int = SKETCH) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable, its own included) and kept."""
    total = docs.count()
    base = sketches(docs, id_col, text_col, size, k).where("n > 0")
    classes = base.groupBy("key").agg(
        F.min(id_col).alias("label"), F.min(F.struct(id_col, "text_hash")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    small = lambda df, name: stored(fewer_tasks(df, total, TASK_ROWS), name)
    classes = small(classes.withColumn("node", F.xxhash64("key")), "classes")
    lists = inverted_lists(classes, k, threshold)
    several = lists.groupBy("value").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("value")
    lists = small(lists.join(several, "value"), "lists")
    wanted = classes.join(lists.select("node").distinct(), "node", "left_semi").select("key", F.col("rep.text_hash").alias("_h"), F.col(f"rep.{id_col}").alias("_id"))
    texts = (docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_t"))
             .join(wanted, (F.col("_t") == F.col("_h")) & F.col("_d").eqNullSafe(F.col("_id"))).select("key", "text"))
    texts = small(texts.dropDuplicates(["key"]), "texts")
    members = small(classes.select("node", "key", "n", "sketch").join(lists.select("node").distinct(), "node", "left_semi"), "members")
    lists = small(lists.join(members.select("node", "n", _bitmap(F.col("sketch")).alias("bits")), "node"), "lists")
    found = _links(lists, members, texts, total, size, k, threshold)
    labelled = classes.select("key", "label").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = labelled.groupBy("root").agg(F.min("label").alias("_least"))
    assigned = labelled.join(least, "root").select(F.col("key").alias("_key"), "_least")
    rows = sketches(docs, id_col, text_col, size, k, with_sketch=False)
    out = rows.join(assigned, F.col("key") == F.col("_key"), "left")
    component = F.coalesce("_least", id_col)
    return out.select(id_col, F.col("n").alias("n_shingles"), component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; columns as before."""
    kept = near_duplicates(docs, id_col, text_col, size, threshold).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("_kept_id")), "left_semi")
