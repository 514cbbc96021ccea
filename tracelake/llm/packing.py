"""Packing documents into token windows by best-fit decreasing.

Documents are encoded and closed with an end id. A document longer than the window
is first cut into full windows, each a sequence of its own; what is left of it, and
every shorter document, is a piece. Pieces are placed longest first into the open
window with the least room that still takes them. A segment tree over the possible
remaining capacities, holding how many open windows have each, finds that window in
``log2(window)`` steps.

Every input partition packs its own pieces, so nothing is shuffled and no task sees
more than its split. A block of ``BLOCK`` pieces is packed at a time; each block and
partition leaves a few windows partly filled, which is what padding costs.

Defined cases: null text is an empty document (its end id alone); null, repeated or
tied ids are rows like any other; an empty table gives no rows; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WordEncoder, arrow_map, column_type

WINDOW = 2048
END_ID = 1
#: Pieces that are placed together; 40 bytes each.
BLOCK = 500_000
#: Sequence ids of a partition start here times its number.
PER_PARTITION = 1 << 40


class OpenWindows:
    """Open windows by remaining capacity under a segment tree of counts."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        self._add(room, 1)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of a window with the least room of at least ``need``, taken out of the tree."""
        count, node = self.count, need + self.leaves
        while not count[node]:
            while node & 1:  # a right child: its parent holds nothing further right
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the next free sequence number. Equal lengths keep their order."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, free = OpenWindows(window), first
    order = np.argsort(-lengths, kind="stable")
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        room, at = tree.take_tightest(need) or (window, -1)
        if at < 0:
            at, free = free, free + 1
        sequence[i], offset[i] = at, window - room
        if room > need:
            tree.put(room - need, at)
    return sequence, offset, free


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids``, if asked for).

    ``sequence_id`` is unique over all partitions and the same again when a task is repeated.
    """
    fields = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()),
              ("sequence_id", T.LongType()), ("offset", T.LongType())]
    schema = T.StructType([T.StructField(id_col, column_type(docs, id_col))] + [T.StructField(n, t) for n, t in fields])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        encoder, free = WordEncoder.of_worker(tokenizer), TaskContext.get().partitionId() * PER_PARTITION
        names, kept, numbers = [], [], array("q")

        def packed():
            nonlocal free
            start, length, crc, total = np.frombuffer(numbers, np.int64).reshape(-1, 4).T.copy()
            full = length == window
            sequence, offset = np.empty(len(length), np.int64), np.zeros(len(length), np.int64)
            sequence[full] = free + np.arange(full.sum())
            free += int(full.sum())
            sequence[~full], offset[~full], free = best_fit_decreasing(length[~full], window, free)
            out = {id_col: names, "start": start, "length": length, "crc": crc, "total": total, "sequence": sequence, "offset": offset}
            return out | ({"ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in kept]} if with_ids else {})

        for batch in batches:
            for name, ids in zip(batch[0].to_pylist(), encoder.encode(batch[1])):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start:4 * (start + window)]
                    names.append(name)
                    numbers.extend((start, len(piece) // 4, zlib.crc32(piece), total))
                    if with_ids:
                        kept.append(piece)
            if len(names) >= BLOCK:
                yield packed()
                names, kept, numbers = [], [], array("q")
        if names:
            yield packed()

    return arrow_map(docs.select(id_col, text_col), run, schema)
