"""Approximate nearest neighbours by inner product through an inverted multi-index.

1. Vectors are cut into two halves, and each half gets its own codebook of ``centroids``
   (k-means over a sample of at most about ``SAMPLE`` vectors, those with the lowest hash of
   id and vector; this bounds the fit only). Every vector is indexed: its cell is the pair
   of its nearest centroids.
2. A query sorts both codebooks by inner product with its halves and takes pairs from a
   heap, best sum first, until the cells it met hold ``visits`` entries.
3. ``visits`` is measured, not chosen: for ``PROBES`` queries the true neighbours are found
   in one pass over all vectors, and the least number of entries is taken that reaches
   ``RECALL`` of them by this order. So data without clusters cost more, not recall.
4. Cells lie behind each other in shards of about ``SHARD`` entries; a cell that is larger
   spreads over several. Queries come in blocks of about ``BLOCK``. A (block, shard) group
   gets each query with the cells it wants there, and reranks their entries by exact inner
   products, summed in the order of components. The best of all shards are merged.

Of equal vectors only the ``k + 1`` smallest ids can be results of any query, so only those
are indexed: copies cannot fill a cell, and no result changes.

Defined cases: null, empty and zero vectors and vectors with a null or non-finite component
take no part, nor rows without an id; shorter vectors count as padded with zeros; a row is
never a neighbour of a query with its id; rows that repeat id and vector count once; equal
scores go by the smaller id; fewer than ``k`` others give fewer rows, and an empty table
none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, stored

SAMPLE = 16_384
ROUNDS = 12
#: Entries of a cell, about, from which the size of codebooks follows; and their largest size.
PER_CELL = 32
MOST_CENTROIDS = 1_024
PROBES = 128
RECALL = 0.95
SHARD = 16_384
BLOCK = 4_096
_HASHES = 1 << 30


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, v as doubles without zeros at its end."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    length = F.aggregate(F.sequence(F.lit(1), F.size("v")), F.lit(0), lambda last, i: F.when(F.get("v", i - 1) != 0, i).otherwise(last))
    some = rows.where(finite & (F.size("v") > 0)).where(F.exists("v", lambda c: c != 0))
    return some.select("id", F.when(F.get("v", F.size("v") - 1) != 0, F.col("v")).otherwise(F.slice("v", F.lit(1), length)).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = np.asarray(lists.flatten())
    return out


def _codebook(points: np.ndarray, count: int, rounds: int) -> np.ndarray:
    """k-means from evenly spaced points of the sample; an emptied centroid stays where it is."""
    at = points[np.linspace(0, len(points) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        of = _nearest(points, at)
        held = np.bincount(of, minlength=count)
        sums = np.zeros_like(at)
        np.add.at(sums, of, points)
        at[held > 0] = sums[held > 0] / held[held > 0, None]
    return at


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    return np.concatenate([np.argmax(points[a:a + 4096] @ centroids.T - half, axis=1) for a in range(0, len(points), 4096)] or [np.empty(0, int)])


class Index(NamedTuple):
    width: int
    #: Largest component of all vectors; centroids are in its units, so that no square overflows.
    scale: float
    first: np.ndarray
    second: np.ndarray
    #: Entries of each cell, flat, and of all cells before it.
    counts: np.ndarray
    before: np.ndarray
    visits: int
    shard: int

    def cells_of(self, v: np.ndarray) -> np.ndarray:
        cut, v = self.first.shape[1], v / self.scale
        return _nearest(v[:, :cut], self.first) * len(self.second) + _nearest(v[:, cut:], self.second)

    def sums(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut, v = self.first.shape[1], v / self.scale
        return v[:, :cut] @ self.first.T, v[:, cut:] @ self.second.T

    def cells_for(self, a: np.ndarray, b: np.ndarray, visits: int) -> list[int]:
        """Cells in falling order of ``a[i] + b[j]`` until they hold ``visits`` entries."""
        by_a, by_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        fall_a, fall_b, wide = (-a[by_a]).tolist(), (-b[by_b]).tolist(), len(by_b)
        heap, found, left, counts = [(fall_a[0] + fall_b[0], 0, 0)], [], visits, self.counts
        while heap and left > 0:
            _, i, j = heapq.heappop(heap)
            cell = by_a[i] * wide + by_b[j]
            if counts[cell]:
                found.append(cell)
                left -= counts[cell]
            if j + 1 < wide:
                heapq.heappush(heap, (fall_a[i] + fall_b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(by_a):
                heapq.heappush(heap, (fall_a[i + 1] + fall_b[0], i + 1, 0))
        return found


def _products(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Inner products of all pairs; sums of very large components may overflow as doubles do."""
    with np.errstate(over="ignore", invalid="ignore"):
        return q @ e.T


def _exact(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of components."""
    out = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        for x, y in zip(q.T, e.T):
            out += x * y
    return out


def _best(scores: np.ndarray, q: np.ndarray, e: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, ids, exact scores) of the ``k`` best of each row of ``scores``; -inf is no candidate, nor a sum that overflows both ways."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-9 * np.abs(q).sum(1) * np.abs(e).max()  # far above what the order of a sum can change
            rows, at = np.nonzero(~(scores < (least - slack)[:, None]) & (scores > -np.inf))
    else:
        rows, at = np.nonzero(scores > -np.inf)
    exact = _exact(q[rows], e[at])
    order = np.lexsort([ids[at], -exact, rows])
    rows, at, exact = rows[order], at[order], exact[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[at[keep]], exact[keep]


_FOUND = T.StructType().add("query", T.LongType()).add("query_hash", T.LongType()).add("id", T.LongType()).add("score", T.DoubleType())


def _true_neighbours(entries: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """Cells of the ``k`` nearest entries of each probe, found in one pass that keeps ``k`` per probe and task."""
    width = q.shape[1]
    schema = T.StructType().add("p", T.IntegerType()).add("id", T.LongType()).add("cell", T.IntegerType()).add("score", T.DoubleType())

    def run(batches):
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                e, own, cell = _matrix(part["v"], width), np.asarray(part["id"]), np.asarray(part["cell"], np.int64)
                scores = np.where(ids[:, None] == own, -np.inf, _products(q, e))
                rows, at_, exact = _best(scores, q, e, np.arange(len(own)), k)
                new = [rows, own[at_], cell[at_], exact]
                p, i, c, s = (np.concatenate(x) for x in zip(kept, new))
                order = np.lexsort([i, -s, p])
                p, i, c, s = p[order], i[order], c[order], s[order]
                keep = np.arange(len(p)) - np.searchsorted(p, p) < k
                kept = [p[keep], i[keep], c[keep], s[keep]]
        yield dict(enumerate(kept))

    by = Window.partitionBy("p").orderBy(F.desc("score"), "id")
    best = arrow_map(entries.select("id", "v", "cell"), run, schema).withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= k)
    out = [[] for _ in ids]
    for r in best.select("p", "cell").collect():
        out[r.p].append(r.cell)
    return [np.array(c, np.int64) for c in out]


def _visits(index: Index, q: np.ndarray, cells: list[np.ndarray], recall: float, least: int) -> int:
    """Entries to visit so that the probes meet ``recall`` of their true neighbours."""
    needed = []
    for row, own in enumerate(cells):
        a, b = index.sums(q[row:row + 1])
        sums = (a[0][:, None] + b[0]).ravel()
        order = np.argsort(-sums, kind="stable")
        until = np.empty(len(sums), np.int64)
        until[order] = np.cumsum(index.counts[order])
        needed.extend(until[own] if len(own) else [])
    return max(least, int(math.ceil(np.quantile(needed, recall)))) if needed else least


def build(rows: DataFrame, is_query: Column, k: int, centroids: int | None = None, recall: float = RECALL, shard: int = SHARD) -> tuple[DataFrame, Index | None]:
    """Entries (id, v, cell) of all vectors and the index over them; ``rows`` are stored (id, v)."""
    total, width, scale = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not total:
        return rows, None
    lowest = lambda df, n, of: df.where(F.pmod(F.xxhash64("id", "v"), F.lit(_HASHES)) < F.lit(min(_HASHES, 1 + n * _HASHES // of)))
    sample = _matrix(lowest(rows.select("id", "v"), SAMPLE, total).select("v").toArrow()["v"].combine_chunks(), width)
    if not len(sample):
        sample = np.zeros((1, width))
    sample = sample[np.lexsort(sample.T)]
    count = min(len(sample), centroids or min(MOST_CENTROIDS, max(1, round(math.sqrt(total / PER_CELL)))))
    cut = max(1, width // 2)
    first, second = (_codebook(part / scale, count, ROUNDS) for part in (sample[:, :cut], sample[:, cut:]))
    none = np.zeros(0, np.int64)
    bare = Index(width, scale, first, second, none, none, 0, shard)

    def assign(batches):
        for batch in batches:
            yield {"id": batch["id"], "v": batch["v"], "cell": bare.cells_of(_matrix(batch["v"], width)).astype(np.int32)}

    schema = T.StructType([rows.schema["id"], rows.schema["v"], T.StructField("cell", T.IntegerType())])
    by = Window.partitionBy("v").orderBy("id")
    smallest = rows.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= k + 1).select("id", "v")
    entries = stored(arrow_map(smallest, assign, schema), "entries")
    counts = np.zeros(len(first) * len(second), np.int64)
    for r in entries.groupBy("cell").count().collect():
        counts[r[0]] = r[1]
    index = bare._replace(counts=counts, before=np.cumsum(counts) - counts)
    asked, all_asked = rows.where(is_query), rows.where(is_query).count()
    probes = lowest(asked, PROBES, max(1, all_asked)).toArrow()
    q, ids = _matrix(probes["v"].combine_chunks(), width), np.asarray(probes["id"])
    cells = _true_neighbours(entries, ids, q, k) if len(ids) else []
    return entries, index._replace(visits=_visits(index, q, cells, recall, k + 1))


def _asked(queries: DataFrame, index: Index, blocks: int) -> DataFrame:
    """(query, query_hash, v, block, shard, cells): a row for each shard in which a query wants cells."""
    schema = T.StructType().add("query", T.LongType()).add("query_hash", T.LongType()).add("v", T.ArrayType(T.DoubleType()))
    schema = schema.add("block", T.IntegerType()).add("shard", T.IntegerType()).add("cells", T.ArrayType(T.IntegerType()))

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 128):
                batch = whole.slice(at, 128)
                a, b = index.sums(_matrix(batch["v"], index.width))
                row, shard, cells = [], [], []
                for i in range(len(batch)):
                    want = np.sort(np.array(index.cells_for(a[i], b[i], index.visits), np.int64))
                    low, high = index.before[want] // index.shard, (index.before[want] + index.counts[want] - 1) // index.shard
                    for s in np.unique(np.concatenate([low, high, *[np.arange(x, y) for x, y in zip(low[high > low + 1], high[high > low + 1])]])).tolist():
                        row.append(i)
                        shard.append(s)
                        cells.append(want[(low <= s) & (high >= s)].astype(np.int32))
                yield {"query": batch["query"].take(row), "query_hash": batch["query_hash"].take(row), "v": batch["v"].take(row), "block": batch["block"].take(row),
                       "shard": pa.array(shard, pa.int32()), "cells": cells}

    salted = F.pmod(F.xxhash64("query", "query_hash"), F.lit(blocks)).cast("int")
    return arrow_map(queries.withColumn("block", salted).repartition("query", "query_hash"), run, schema)


def _rerank(width: int, k: int):
    schema = pa.schema([("query", pa.int64()), ("query_hash", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        if not len(queries) or not len(entries):
            return schema.empty_table()
        order = np.argsort(entries["cell"].to_numpy(), kind="stable")
        cell, ids = entries["cell"].to_numpy()[order], entries["id"].to_numpy()[order]
        e = _matrix(entries["v"].combine_chunks(), width)[order]
        here, begin = np.unique(cell, return_index=True)
        until = np.append(begin[1:], len(cell))
        parts = []
        for at in range(0, len(queries), 128):
            part = queries.slice(at, 128)
            q, asker = _matrix(part["v"].combine_chunks(), width), part["query"].to_numpy()
            lists = part["cells"].combine_chunks()
            owner, wanted = np.repeat(np.arange(len(part)), np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten())
            by_cell = np.argsort(wanted, kind="stable")
            owner, wanted = owner[by_cell], wanted[by_cell]
            scores = np.full((len(part), len(ids)), -np.inf)
            low, high = np.searchsorted(wanted, here), np.searchsorted(wanted, here, "right")
            for x, y, a, b in zip(low.tolist(), high.tolist(), begin.tolist(), until.tolist()):
                if y > x:
                    scores[owner[x:y], a:b] = _products(q[owner[x:y]], e[a:b])
            scores[asker[:, None] == ids] = -np.inf
            rows, found, exact = _best(scores, q, e, ids, k)
            parts.append(pa.table([asker[rows], part["query_hash"].to_numpy()[rows], found, exact], schema=schema))
        return pa.concat_tables(parts)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int | None = None,
            recall: float = RECALL, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` nearest found; ``is_query`` is a condition on ``id``."""
    rows = stored(usable(vectors, id_col, vector_col).withColumn("_h", F.xxhash64("v")).dropDuplicates(["id", "_h", "v"]).select("id", "v"), "vectors")
    entries, index = build(rows, is_query, k, centroids, recall, shard)
    if index is None:
        named = rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
        return named.limit(0)
    queries = rows.where(is_query).select(F.col("id").alias("query"), F.xxhash64("v").alias("query_hash"), "v")
    blocks = max(1, -(-queries.count() // block))
    asked = _asked(queries, index, blocks)
    table = [(int(c), int(index.before[c]), int(index.counts[c])) for c in np.flatnonzero(index.counts)]
    spans = F.broadcast(entries.sparkSession.createDataFrame(table, "cell int, before long, n long"))
    in_shard = ((F.col("before") + F.pmod(F.xxhash64("id", "v"), F.col("n"))) / index.shard).cast("int")
    dealt = entries.join(spans, "cell").select("id", "v", "cell", in_shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = asked.groupBy("block", "shard").cogroup(dealt.groupBy("block", "shard")).applyInArrow(_rerank(index.width, k), _FOUND)
    by = Window.partitionBy("query", "query_hash").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
