"""Cheapest repair of damaged conversations by a parallel Viterbi pass over chunks.

Roles must read ``(s?(ua)+)?``. Edits, by their initials: Keep a row (0), Rerole it to user
or assistant (1), Delete it (2; the only way for blank rows and for rows whose role and
text were seen before), Insert an empty user or assistant row (5); a truncated row that
stays adds 5. Of the cheapest edits the ASCII-least sequence of initials is taken.

A row's part in this is one byte, so a chunk of ``CHUNK`` rows is a short byte string and
every conversation, however long, is a number of chunks:

1. Costs to the end run backwards, one vector of four states per row. The last chunk of a
   conversation starts from the true end, every other from a speculative vector (zeros).
2. Fix-up passes: a chunk whose successor now starts with another vector than it assumed is
   run again from that vector, beside the old run, and stops where both differ by a
   constant only: costs are compared with each other, so the rest of the old run stands.
   Passes go on until no chunk changes. A chunk that keeps differences (all its rows are
   truncated, say) hands a change on by one chunk a pass; what is open after ``FIX_UPS``
   passes gets its vectors from transfer matrices of the open chunks, combined by doubling.
3. The stitched vectors drive the trace: from each state a chunk could begin in, the least
   initial that keeps the cost. End states are combined by doubling, then each chunk is
   traced once from its true state.

Numbers of rows, first occurrences and neighbours come from operators that split long
conversations; first occurrences are sums with map-side combine; vectors move by joins on
(conversation, chunk). No group larger than a chunk is ever held.

Defined cases: a null role or text counts as one space; rows go by turn (nulls first), then
role, then text; a null conversation id is one conversation; an empty table gives no rows;
other columns are ignored, whatever their names. Roles count by their first letter, so an
unknown or empty role must be changed or deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import index_rows, neighbours, strip_layout
from .common import arrow_map, stored

CHUNK = 4_096
FIX_UPS = 8
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: States: nothing yet, after a system row, after a user row, after an assistant row; 4 is none.
_AFTER_INSERT = np.array([2, 2, 3, 2])
_NEVER = 1 << 28
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int32)
#: Codes of rows: place of the role's initial in "?sua", 4 more if truncated; GONE must be deleted.
GONE = 8
_KEEP = np.full((9, 4), 4)
_KEEP[1::4, 0], _KEEP[2::4, [0, 1, 3]], _KEEP[3::4, 2] = 1, 2, 3
_KEEP[GONE] = 4
_REROLE = np.tile(_AFTER_INSERT, (9, 1))
_REROLE[GONE] = 4
_STAYS = np.array([0] * 4 + [TRUNCATED] * 4 + [0], np.int32)[:, None]


def _step(codes: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cost vectors (n, 4) before one row each, from those behind it."""
    wide = np.concatenate([v, np.full((len(v), 1), _NEVER, v.dtype)], 1)
    of = lambda to: np.take_along_axis(wide, to, 1)
    best = np.minimum(DELETE + v, np.minimum(of(_KEEP[codes]), REROLE + of(_REROLE[codes])) + _STAYS[codes])
    for _ in range(2):
        best = np.minimum(best, INSERT + best[:, _AFTER_INSERT])
    return best


def _relative(v: np.ndarray) -> np.ndarray:
    return v - v.min(1, keepdims=True)


class Chunks:
    """Ragged rows of many chunks, longest first, so that one step serves all chunks that have it."""

    def __init__(self, codes: list[bytes]):
        self.size = np.fromiter(map(len, codes), np.int64, len(codes))
        self.order = np.argsort(-self.size, kind="stable")
        self.flat = np.frombuffer(b"".join(codes), np.uint8)
        self.begin = np.cumsum(self.size) - self.size

    def backward(self, start: np.ndarray, old: tuple[np.ndarray, np.ndarray] | None = None, seen: Callable | None = None,
                 scale: Callable = _relative) -> np.ndarray:
        """Vectors before each chunk's first row. ``old`` (start, result) is an earlier run: where both are parallel, its result stands."""
        v, size, order = start[self.order].astype(np.int32), self.size[self.order], self.order
        w = None if old is None else old[0][self.order].astype(np.int32)
        live = np.ones(len(v), bool)
        for step in range(int(size.max(initial=0))):
            here = np.flatnonzero(live[:int(np.searchsorted(-size, -step))])
            at = self.begin[order[here]] + size[here] - 1 - step
            v[here] = scale(_step(self.flat[at], v[here]))
            if seen:
                seen(at, v[here])
            if w is not None:
                w[here] = _relative(_step(self.flat[at], w[here]))
                live[here] = (v[here] != w[here]).any(1)
        out = np.empty_like(v)
        out[order] = v if old is None else np.where(live[:, None], v, old[1][order])
        return out

    def forward(self, end: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ops, end states, costs) of the least cheapest edits from ``start``; an op is edit + 4 * inserts before it + 16 * state before those."""
        before = np.empty((len(self.flat), 4), np.int32)  # of each row, relative
        self.backward(end, seen=lambda at, v: before.__setitem__(at, v))
        ops, q, cost = np.zeros(len(self.flat), np.uint8), start.copy(), np.zeros(len(start), np.int64)
        size, order = self.size[self.order], self.order
        for step in range(int(size.max(initial=0))):
            k = order[:int(np.searchsorted(-size, -step))]
            at = self.begin[k] + step
            after = np.where((step + 1 < self.size[k])[:, None], before[np.minimum(at + 1, len(before) - 1)], end[k])
            codes, one = self.flat[at], np.arange(len(k))
            exact = _step(codes, after)
            wide = np.concatenate([after, np.full((len(k), 1), _NEVER, after.dtype)], 1)
            inserts, state, base = np.zeros(len(k), np.int64), q[k], q[k].copy()
            for _ in range(2):
                more = (exact[one, state] != DELETE + after[one, state]) & (exact[one, state] == INSERT + exact[one, _AFTER_INSERT[state]])
                inserts += more
                state = np.where(more, _AFTER_INSERT[state], state)
            deleted = exact[one, state] == DELETE + after[one, state]
            kept = ~deleted & (exact[one, state] == wide[one, _KEEP[codes, state]] + _STAYS[codes, 0])
            edit = np.where(deleted, 0, np.where(kept, 1, 2))
            ops[at] = edit + 4 * inserts + 16 * base
            cost[k] += INSERT * inserts + np.where(deleted, DELETE, np.where(kept, 0, REROLE) + _STAYS[codes, 0])
            q[k] = np.where(deleted, state, np.where(kept, _KEEP[codes, state], _REROLE[codes, state]))
        return ops, q, cost


_INTS = T.ArrayType(T.IntegerType())


def _rows_of(batch, name: str) -> np.ndarray:
    return np.asarray(batch[name].flatten()).reshape(len(batch), -1)


def _mapped(chunks: DataFrame, keep: list[str], new: dict[str, T.DataType], fn: Callable) -> DataFrame:
    """``keep`` columns and those that ``fn(Chunks, batch)`` yields."""
    schema = T.StructType([*[chunks.schema[c] for c in keep], *[T.StructField(n, t) for n, t in new.items()]])

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                yield {c: batch[c] for c in keep} | fn(Chunks(batch["codes"].to_pylist()), batch)

    return arrow_map(chunks, run, schema)


def _next_to(chunks: DataFrame, values: DataFrame, names: dict[str, str], step: Column, how: str = "left") -> DataFrame:
    """``chunks`` with columns of the chunk ``step`` further on; both by (conv, chunk)."""
    other = values.select(F.col("conv").alias("_c"), F.col("chunk").alias("_k"), *[F.col(c).alias(n) for c, n in names.items()])
    return chunks.join(other, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("chunk") + step == F.col("_k")), how).drop("_c", "_k")


def _speculate(chunks: DataFrame) -> DataFrame:
    """conv, chunk, last, codes, ``end`` (vector assumed behind the chunk) and ``out`` (before it)."""
    def run(ragged, batch):
        end = np.where(np.asarray(batch["last"])[:, None], _END, 0)
        return {"end": list(end), "out": list(ragged.backward(end))}

    return _mapped(chunks, ["conv", "chunk", "last", "codes"], {"end": _INTS, "out": _INTS}, run)


def _run_again(open_: DataFrame) -> DataFrame:
    def run(ragged, batch):
        new = _rows_of(batch, "new_end")
        return {"end": list(new), "out": list(ragged.backward(new, (_rows_of(batch, "end"), _rows_of(batch, "out"))))}

    return _mapped(open_, ["conv", "chunk", "last", "codes"], {"end": _INTS, "out": _INTS}, run)


def _vectors_by_doubling(state: DataFrame, longest: int) -> DataFrame:
    """``end`` of every chunk from the transfer matrices of the chunks behind it."""
    def matrices(ragged, batch):
        within = lambda v: np.minimum(v, _NEVER)
        to = [np.where(np.arange(4) == j, 0, _NEVER) for j in range(4)]
        columns = [ragged.backward(np.tile(v, (len(batch), 1)), scale=within) for v in to]
        return {"m": list(np.stack(columns, 2).reshape(len(batch), 16))}

    m = stored(_mapped(state, ["conv", "chunk", "last"], {"m": T.ArrayType(T.IntegerType())}, matrices), "matrices")
    cell = lambda a, b, i, j: F.array_min(F.array(*[F.get(a, F.lit(4 * i + x)) + F.get(b, F.lit(4 * x + j)) for x in range(4)]))
    reach = 1
    while reach < longest:
        two = _next_to(m, m, {"m": "m2"}, F.lit(reach))
        both = F.array(*[F.least(cell(F.col("m"), F.col("m2"), i, j), F.lit(_NEVER)) for i in range(4) for j in range(4)])
        both = F.when(F.col("m2").isNull(), F.col("m")).otherwise(both)
        scaled = F.transform("both", lambda x: F.when(x < _NEVER, x - F.array_min("both")).otherwise(x))
        m, reach = stored(two.select("conv", "chunk", "last", both.alias("both")).select("conv", "chunk", "last", scaled.alias("m")), "matrices"), 2 * reach
    out = F.array(*[F.array_min(F.array(*[F.get("m", F.lit(4 * i + x)) + F.lit(int(_END[x])) for x in range(4)])) for i in range(4)])
    vectors = m.select("conv", "chunk", F.transform(out, lambda x: (x - F.array_min(out)).cast("int")).alias("v"))
    true_end = F.when(F.col("last"), F.array(*[F.lit(int(x)) for x in _END])).otherwise(F.col("v"))
    return _next_to(state.drop("end", "out"), vectors, {"v": "v"}, F.lit(1)).withColumn("end", true_end).drop("v")


def stitched(chunks: DataFrame, longest: int, fix_ups: int = FIX_UPS) -> DataFrame:
    """``chunks`` with ``end``, the cost vector behind each chunk up to a constant."""
    if longest <= 1:
        return chunks.withColumn("end", F.array(*[F.lit(int(x)) for x in _END]))
    state = stored(_speculate(chunks), "vectors")
    for _ in range(fix_ups):
        linked = _next_to(state, state, {"out": "new_end"}, F.lit(1))
        changed = ~F.col("last") & (F.col("new_end") != F.col("end"))
        if linked.where(changed).isEmpty():
            return state.drop("out")
        again = _run_again(linked.where(changed))
        state = stored(linked.where(~changed).drop("new_end").unionByName(again), "vectors")
    return stored(_vectors_by_doubling(state, longest), "vectors")


def _states(state: DataFrame, longest: int) -> DataFrame:
    """``begin``, the state before each chunk: end states of all four beginnings, combined by doubling."""
    def run(ragged, batch):
        end = _rows_of(batch, "end")
        return {"to": list(np.stack([ragged.forward(end, np.full(len(end), q))[1] for q in range(4)], 1))}

    maps = stored(_mapped(state, ["conv", "chunk"], {"to": _INTS}, run), "states")
    reach = 1
    while reach < longest:
        two = _next_to(maps, maps, {"to": "to2"}, F.lit(-reach))
        through = F.transform("to2", lambda q: F.get("to", q))
        maps, reach = stored(two.select("conv", "chunk", F.coalesce(through, "to").alias("to")), "states"), 2 * reach
    return _next_to(state, maps, {"to": "_to"}, F.lit(-1)).withColumn("begin", F.coalesce(F.get("_to", F.lit(0)), F.lit(0))).drop("_to")


def traced(chunks: DataFrame, longest: int, fix_ups: int = FIX_UPS) -> DataFrame:
    """conv, chunk, ops (see ``Chunks.forward``), audit (initials), cost and tail (state behind the last chunk's last row)."""
    state = stitched(chunks, longest, fix_ups)
    state = _states(state, longest) if longest > 1 else state.withColumn("begin", F.lit(0))

    def run(ragged, batch):
        ops, to, cost = ragged.forward(_rows_of(batch, "end"), np.asarray(batch["begin"], np.int64))
        last = np.asarray(batch["last"])
        pending = last & (to == 2)  # a user row at the end gets its answer
        parts = [ops[a:a + n] for a, n in zip(ragged.begin.tolist(), ragged.size.tolist())]
        audits = ["".join("I" * (o >> 2 & 3) + "DKR"[o & 3] for o in p.tolist()) + "I" * t for p, t in zip(parts, pending.tolist())]
        return {"ops": [p.astype(np.int8) for p in parts], "audit": audits, "cost": cost + INSERT * pending, "tail": to}

    return _mapped(state, ["conv", "chunk", "last"], {"ops": T.ArrayType(T.ByteType()), "audit": T.StringType(), "cost": T.LongType(), "tail": T.LongType()}, run)


class Repaired(NamedTuple):
    #: conv, n_rows, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation with rows.
    summary: DataFrame
    #: conv, at (number of the damaged row), sub, edit, role and text of every row after repair.
    rows: DataFrame


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           chunk: int = CHUNK, fix_ups: int = FIX_UPS) -> Repaired:
    """Faults, cheapest edits and repaired rows of all conversations."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"))
    at = index_rows(given, ["conv"], ["turn", "role", "text"], row="at", total="n_rows")
    initial = F.substring("role", 1, 1)
    linked = neighbours(at, ["conv"], prev={"prior": initial}, row="at")
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    rows = stored(strip_layout(linked).select(
        "conv", "turn", "role", "text", "at", "n_rows", (bare == "").alias("is_blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("is_cut"),
        (F.col("prior").isNotNull() & ~F.concat("prior", initial).isin("su", "ua", "au")).alias("is_illegal")), "turns")
    of_role = F.instr(F.lit("?sua"), initial) - 1
    code = F.when(F.col("role").rlike("^[sua]"), of_role).otherwise(0) + F.when(F.col("is_cut"), 4).otherwise(0)
    firsts = rows.where(~F.col("is_blank")).groupBy("conv", "role", F.sha2("text", 256).alias("_text")).agg(
        F.min("at").alias("at"), F.max("n_rows").alias("n_rows"), F.max(code.cast("int")).alias("code"))
    firsts = stored(firsts.select("conv", "at", "n_rows", "code"), "firsts")
    marks = rows.select("conv", "at", "n_rows", F.lit(None).cast("int").alias("code")).unionByName(firsts)
    marks = marks.groupBy("conv", F.floor(F.col("at") / chunk).alias("chunk")).agg(
        F.count_if(F.col("code").isNull()).alias("n"), F.max("n_rows").alias("n_rows"),
        F.collect_list(F.when(F.col("code").isNotNull(), F.struct((F.col("at") % chunk).cast("int").alias("o"), F.col("code").alias("c")))).alias("marks"))
    schema = T.StructType([marks.schema["conv"], T.StructField("chunk", T.LongType()), T.StructField("last", T.BooleanType()), T.StructField("codes", T.BinaryType())])

    def coded(batches):
        for batch in batches:
            out = []
            for n, items in zip(batch["n"].to_pylist(), batch["marks"]):
                codes = np.full(n, GONE, np.uint8)
                if len(items):
                    codes[np.asarray(items.values.field("o"))] = np.asarray(items.values.field("c"))
                out.append(codes.tobytes())
            yield {"conv": batch["conv"], "chunk": batch["chunk"], "last": [(k + 1) * chunk >= n for k, n in zip(batch["chunk"].to_pylist(), batch["n_rows"].to_pylist())], "codes": out}

    chunks = stored(arrow_map(marks, coded, schema), "chunks")
    longest = (chunks.agg(F.max("chunk")).first()[0] or 0) + 1
    edits = stored(traced(chunks, longest, fix_ups), "edits")

    turns = rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_blank").alias("blank"), F.count_if("is_illegal").alias("illegal"))
    of_turns = turns.groupBy("conv").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), F.sum("blank").alias("blank"), F.sum("illegal").alias("illegal"))
    of_firsts = firsts.groupBy("conv").agg(F.count(F.lit(1)).alias("n_first"), F.count_if(F.col("code") >= 4).alias("truncated"))
    of_edits = edits.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    for part in (of_firsts, of_edits):
        renamed = part.withColumnRenamed("conv", "_conv")
        of_turns = of_turns.join(renamed, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    none = F.lit(0).cast("long")
    n_first = F.coalesce("n_first", none)
    summary = of_turns.select("conv", "n_rows", F.col("gaps").cast("long").alias("gaps"), "blank", (F.col("n_rows") - F.col("blank") - n_first).alias("duplicate"),
                              F.coalesce("truncated", none).alias("truncated"), "illegal", "cost", "audit")
    return Repaired(summary, _repaired_rows(rows, edits, chunk))


def _repaired_rows(rows: DataFrame, edits: DataFrame, chunk: int) -> DataFrame:
    answer = lambda state: F.when(state == 2, "assistant").otherwise("user")
    after = lambda state: F.when(state == 2, 3).otherwise(2)
    placed = edits.select(F.col("conv").alias("_c"), F.col("chunk").alias("_k"), "ops")
    both = rows.join(placed, F.col("conv").eqNullSafe(F.col("_c")) & (F.floor(F.col("at") / chunk) == F.col("_k")))
    both = both.withColumn("op", F.get("ops", (F.col("at") % chunk).cast("int")).cast("int"))
    both = both.withColumns({"edit": F.col("op").bitwiseAND(3), "n": F.shiftright("op", 2).bitwiseAND(3), "q0": F.shiftright("op", 4)})
    both = both.withColumn("q1", F.when(F.col("n") > 0, after(F.col("q0"))).otherwise(F.col("q0")))
    both = both.withColumn("q2", F.when(F.col("n") > 1, after(F.col("q1"))).otherwise(F.col("q1")))
    made = lambda sub, edit, role, text: F.struct(F.lit(sub).alias("sub"), F.lit(edit).alias("edit"), role.alias("role"), text.alias("text"))
    items = F.array(F.when(F.col("n") > 0, made(0, "I", answer(F.col("q0")), F.lit(""))), F.when(F.col("n") > 1, made(1, "I", answer(F.col("q1")), F.lit(""))),
                    F.when(F.col("edit") == 1, made(2, "K", F.col("role"), F.col("text"))).when(F.col("edit") == 2, made(2, "R", answer(F.col("q2")), F.col("text"))))
    out = both.select("conv", "at", F.explode(F.array_compact(items)).alias("x")).select("conv", "at", "x.*")
    tails = edits.where("last AND tail = 2").select("conv", ((F.col("chunk") + 1) * chunk).alias("at"), F.lit(3).alias("sub"), F.lit("I").alias("edit"),
                                                    F.lit("assistant").alias("role"), F.lit("").alias("text"))
    return out.unionByName(tails)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with faults put in by crc32(conv_id:turn) % 20: dropped, emptied, cut, repeated, or said by the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                                (F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20).alias("_how"))
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_how") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_how") == 3, 2).otherwise(1)))
    return rows.where("_how != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
