"""Exact top-k by inner product with sorted access only (no random access to single scores).

Candidates are dealt to chunks, queries to blocks; every (block, chunk) is one group of a
co-grouped map, so neither side is held whole anywhere and there is no cross join of rows.
In a group each dimension is a list of its candidates sorted by value, read from its high
end by queries with a positive weight there and from its low end by the others. All lists
are read to the same depth, in a few steps. After each step a candidate's score lies
between a lower bound (what was read of it, and the least of each list it was not yet met
in) and an upper bound (what was read, and where each other list now stands). Candidates
whose upper bound is under the k-th best lower bound are outsiders. A query for which few
others are left stops reading; their scores are then resolved. Otherwise its lists are read
to the end. The k best of every chunk are merged by rank.

The sums of a step are matrix products of 0/1 reading masks, exact in doubles up to 2**53;
larger numbers use 64-bit integers, and groups whose sums could pass those whole numbers of
any size, without bounds.

Defined cases: null vectors and vectors with a null or non-finite component take no part; a scaled
component or a result that does not fit a long is an error; shorter vectors count as padded with zeros; a candidate with the
query's own id is never its result; repeated candidate rows are ranked one by one, repeated
query rows count once; null ids are neither; fewer than k candidates give fewer rows, and
an empty table none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 4096
BLOCK = 1024
#: Shares of a list that are read before bounds are looked at.
DEPTHS = (0.5, 0.75, 0.875)
#: Lower bounds are taken for this many times k candidates with the highest upper bounds.
CLOSEST = 4
#: A query stops when at most this share of a chunk is left.
FEW = 0.125
#: Numbers from here on are no longs; a vector that holds one is an error, not left out.
TOO_LARGE = float(1 << 63)


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * component) of every vector that takes part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * scale)
    finite = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    long = lambda c: F.when(F.abs(c) < TOO_LARGE, F.floor(c)).otherwise(F.raise_error(F.lit("a scaled component is no long")).cast("long"))
    known = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    return known.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).withColumn("v", F.transform("v", long))


class Chunk:
    """Sorted lists over the candidates of one chunk."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.lexsort([ids])  # by id, so that a stable choice among equal scores takes the smaller id
        self.ids, self.values = ids[order], values[order]
        by_value = np.argsort(self.values, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.values, by_value, 0)
        self.place = np.empty_like(by_value)
        np.put_along_axis(self.place, by_value, np.arange(len(ids))[:, None], 0)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(candidate rows, scores) of each query, best first."""
        n, out = len(self.ids), [None] * len(queries)
        open_, up, down = np.arange(len(queries)), np.maximum(queries, 0), np.minimum(queries, 0)
        high, low = up * self.lists[-1] + down * self.lists[0], up * self.lists[0] + down * self.lists[-1]  # ends of each list
        for depth in DEPTHS:
            t = int(n * depth)
            if not t or not len(open_):
                continue
            from_top, from_bottom = self.place >= n - t, self.place < t
            front = up[open_] * self.lists[n - t] + down[open_] * self.lists[t - 1]
            positive = queries[open_] > 0
            read = np.hstack([self.values * from_top, self.values * from_bottom])
            met = np.hstack([from_top, from_bottom]).astype(self.values.dtype)
            split = lambda x: np.hstack([x * positive, x * ~positive])
            upper = np.hstack([read, met]) @ np.hstack([up[open_], down[open_], -split(front)]).T + front.sum(1)
            upper = np.where(self.ids[:, None] == query_ids[open_], -np.inf if upper.dtype.kind == "f" else np.iinfo(upper.dtype).min, upper)
            take = min(CLOSEST * k, n)
            near = np.argpartition(-upper, take - 1, axis=0)[:take]
            still = []
            for j, q in enumerate(open_.tolist()):
                rows = near[:, j]
                rows = rows[self.ids[rows] != query_ids[q]]
                seen = np.where(positive[j], from_top[rows], from_bottom[rows])
                lower = np.where(seen, self.values[rows] * queries[q], low[q]).sum(1)
                left = np.flatnonzero(upper[:, j] >= np.partition(lower, len(lower) - k)[len(lower) - k]) if len(lower) >= k else np.arange(n)
                if len(left) <= max(k, FEW * n):
                    out[q] = self._ranked(left, self.values[left] @ queries[q], query_ids[q], k)
                else:
                    still.append(q)
            open_ = np.array(still, np.int64)
        if len(open_):
            scores = self.values @ queries[open_].T
            for j, q in enumerate(open_.tolist()):
                out[q] = self._ranked(np.arange(n), scores[:, j], query_ids[q], k)
        return out

    def _ranked(self, rows: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        keep = self.ids[rows] != own
        rows, scores = rows[keep], scores[keep]
        if len(rows) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= least], scores[scores >= least]
        order = np.argsort(-scores, kind="stable")[:k]
        return rows[order], scores[order]


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(lists.flatten())
    return out


def _in_whole_numbers(queries: pa.Table, candidates: pa.Table, q: np.ndarray, c: np.ndarray, k: int, schema: pa.Schema) -> pa.Table:
    """The best of a group whose sums may not fit a long: numbers of any size, every list read to its end; a result that is no long is an error."""
    rows, ids, hashes, left = [], candidates["id"].to_pylist(), queries["h"].to_pylist(), c.astype(object)
    for i, query in enumerate(queries["id"].to_pylist()):
        scores = left @ q[i].astype(object)
        best = sorted((-s, j) for s, j in zip(scores.tolist(), ids) if j != query)[:k]
        rows += [(query, hashes[i], j, -s) for s, j in best]
    return pa.table([list(x) for x in zip(*rows)], schema=schema) if rows else schema.empty_table()


def _group(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def best(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return schema.empty_table()
        q, c = _matrix(queries["v"]), _matrix(candidates["v"])
        width = max(q.shape[1], c.shape[1], 1)
        q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
        bound = 4 * width * int(np.abs(q.astype(np.float64)).max(initial=0)) * int(np.abs(c.astype(np.float64)).max(initial=0))
        if bound >= 2**63:
            return _in_whole_numbers(queries, candidates, q, c, k, schema)
        if bound < 2**53:
            q, c = q.astype(np.float64), c.astype(np.float64)
        chunk, ids = Chunk(np.asarray(candidates["id"]), c), np.asarray(queries["id"])
        found = chunk.best(ids, q, k)
        count = [len(rows) for rows, _ in found]
        return pa.table([np.repeat(ids, count), np.repeat(np.asarray(queries["h"]), count), np.concatenate([chunk.ids[r] for r, _ in found]),
                         np.concatenate([s for _, s in found]).astype(np.int64)], schema=schema)

    return best


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
          chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` best other rows; ``is_query`` is a condition on ``id``."""
    rows = whole_numbers(vectors, id_col, vector_col, scale)
    n, m = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    chunks, blocks = max(1, -(-n // chunk)), max(1, -(-m // block))
    every = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    salted = F.xxhash64("id", F.monotonically_increasing_id())  # also many rows of one id are dealt evenly
    candidates = rows.select("id", "v", F.pmod(salted, F.lit(chunks)).cast("int").alias("chunk")).select("id", "v", "chunk", every("block", blocks))
    asked = rows.where(is_query).withColumn("h", F.xxhash64("v")).dropDuplicates(["id", "h"])
    asked = asked.select("id", "v", "h", F.pmod(F.xxhash64("id", "h"), F.lit(blocks)).cast("int").alias("block")).select("id", "v", "h", "block", every("chunk", chunks))
    schema = T.StructType().add("query_id", T.LongType()).add("query_hash", T.LongType()).add("vec_id", T.LongType()).add("score", T.LongType())
    found = asked.groupBy("block", "chunk").cogroup(candidates.groupBy("block", "chunk")).applyInArrow(_group(k), schema)
    by = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
