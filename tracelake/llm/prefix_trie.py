"""Prefix trie of conversations as flat node tables behind minimal perfect hashes.

1. Every prefix of a conversation gets a 128-bit digest: running sums of hashes of (place,
   role, text), so a prefix needs no rows but its own turn and the sum before it, and a
   conversation of any length can be cut for the sums.
2. Conversations are dealt to shards of about ``SHARD_ROWS`` prefixes, very long ones in
   bands of ``BAND`` depths. A shard takes its distinct digests into a minimal perfect
   hash; a digest's slot is its place in flat arrays. A slot is verified: every row that
   reaches it must have the slot's digest, depth, parent digest and SHA-256 of role and
   text; if two sequences share a digest, all is done again with another seed. Counts are
   scattered into the arrays.
3. Equal prefixes of all shards are summed to one node each. A node belongs to its smallest
   member, and so its weights to one slot of one shard. Shards add weights up through
   their parent-slot arrays, deepest slots first; the sums of all shards make the totals
   of subtrees. What hangs below a band is handed to the last node of the band above.

A first turn that a third of all conversations share is one slot per shard and one sum,
never a group of its members.

Defined cases: rows without a conversation id are left out; a null role or text counts as
empty; turns of equal number go by role and text, and equal turns stay two turns; an empty
table has no node, not even a root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import index_rows, running, strip_layout
from .common import joined_sha256, mixed, stored

#: Prefixes of a shard, about; and depths after which a conversation goes on in another shard.
SHARD_ROWS = 16_384
BAND = 4_096
#: Ids that are joined before they are hashed.
ID_RANGE = 1_024


class PerfectHash:
    """Slots 0..n-1 for n different (hi, lo) keys: each level gives slots to the keys that are alone in their place."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels, base, left = [], 0, np.arange(len(hi))
        while len(left):
            size = len(left) + len(left) // 2 + 1
            place = self._place(hi[left], lo[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((alone, base - 1 + np.cumsum(alone)))
            base += int(alone.sum())
            left = left[~alone[place]]

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) % 2**64)
        return (mixed(mixed(hi ^ salt) + lo) % np.uint64(size)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of every key; of a key that is not in the table any slot or -1."""
        out, left = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(hi[left], lo[left], level, len(alone))
            hit = alone[place]
            out[left[hit]] = rank[place[hit]]
            left = left[~hit]
        return out


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), n_turns, role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    at = index_rows(rows.where("conv_id IS NOT NULL"), ["conv_id"], ["turn", "role", "text"], row="pos", total="n_turns")
    return strip_layout(at).select("conv_id", (F.col("pos") + 1).alias("pos"), "n_turns", "role", "text")


def _halves(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, 32), h.bitwiseAND(0xFFFFFFFF)]


def _packed(a: Column, b: Column) -> Column:
    return F.shiftleft(a.bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(b.bitwiseAND(0xFFFFFFFF))


def prefixes(turns: DataFrame, convs: DataFrame, seed: int) -> DataFrame:
    """A row per prefix of every conversation: conv_id, d, digest (hi, lo) and its parent's (phi, plo), check, bytes and ends."""
    hashed = [half for s in (2 * seed, 2 * seed + 1) for half in _halves(F.xxhash64(F.lit(s), "pos", "role", "text"))]
    check = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text")), 256))
    narrow = turns.select("conv_id", "pos", check.alias("check"), F.octet_length("text").cast("long").alias("bytes"), *[h.alias(f"h{i}") for i, h in enumerate(hashed)])
    at = index_rows(narrow, ["conv_id"], ["pos"])
    summed = running(at, ["conv_id"], {f"s{i}": ("sum", f"h{i}") for i in range(4)})
    before = [F.col(f"s{i}") - F.col(f"h{i}") for i in range(4)]
    s = [F.col(f"s{i}") for i in range(4)]
    rows = summed.select("conv_id", F.col("pos").alias("d"), _packed(s[0], s[1]).alias("hi"), _packed(s[2], s[3]).alias("lo"),
                         _packed(before[0], before[1]).alias("phi"), _packed(before[2], before[3]).alias("plo"), "check", "bytes",
                         (F.col("row_idx") + 1 == F.col("n_rows")).alias("ends"))
    zero = F.lit(0).cast("long")
    sizes = convs.select("conv_id", F.lit(0).alias("_n")).unionAll(turns.where("pos = 1").select("conv_id", F.lit(1).alias("_n"))).groupBy("conv_id").agg(F.max("_n").alias("_n"))
    roots = sizes.select("conv_id", zero.alias("d"), zero.alias("hi"), zero.alias("lo"), zero.alias("phi"), zero.alias("plo"), F.lit(b"").alias("check"),
                         zero.alias("bytes"), (F.col("_n") == 0).alias("ends"))
    return rows.unionByName(roots)


_NODE = [("hi", pa.int64()), ("lo", pa.int64()), ("phi", pa.int64()), ("plo", pa.int64()), ("d", pa.int64()), ("check", pa.binary()), ("bytes", pa.int64())]
_LOCAL = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("parent_slot", pa.int64()), *_NODE, ("n", pa.int64()), ("n_ends", pa.int64()), ("first", pa.int64()), ("clash", pa.bool_())])
_SUMS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("children", pa.int64()), ("parent", pa.int64())])
_SPARK = {pa.int64(): T.LongType(), pa.binary(): T.BinaryType(), pa.bool_(): T.BooleanType()}


def _spark(schema: pa.Schema) -> T.StructType:
    return T.StructType([T.StructField(f.name, _SPARK[f.type]) for f in schema])


def _longs(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy() for n in names]


def node_table(rows: pa.Table) -> pa.Table:
    """Distinct prefixes of one shard in the order of their slots; parents from outside are slots without members."""
    conv, d, bytes_, hi, lo, phi, plo = _longs(rows, "conv_id", "d", "bytes", "hi", "lo", "phi", "plo")
    ends = np.asarray(rows["ends"].combine_chunks())
    checks = rows["check"].combine_chunks().dictionary_encode()
    check = np.asarray(checks.indices)
    deep = np.flatnonzero(d > 0)
    both = np.unique(np.stack([np.concatenate([hi, phi[deep]]), np.concatenate([lo, plo[deep]])], 1).view(np.uint64), axis=0)
    table = PerfectHash(both[:, 0], both[:, 1])
    n = len(both)
    keys = np.empty_like(both)
    keys[table.slots(both[:, 0], both[:, 1])] = both
    slot = table.slots(hi.view(np.uint64), lo.view(np.uint64))
    up = table.slots(phi.view(np.uint64), plo.view(np.uint64))
    count, ended = np.bincount(slot, minlength=n), np.bincount(slot[ends], minlength=n)
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, slot, conv)
    own = np.zeros((5, n), np.int64)  # depth, bytes, check, parent digest
    own[2] = -1
    own[0, up[deep]] = d[deep] - 1
    of_row = np.stack([d, bytes_, check, phi, plo])
    own[:, slot] = of_row
    clash = np.zeros(n, bool)
    np.logical_or.at(clash, slot, (own[:, slot] != of_row).any(0))
    np.logical_or.at(clash, up[deep], own[0, up[deep]] != d[deep] - 1)
    parent = np.full(n, -1, np.int64)
    parent[slot[deep]] = up[deep]
    has = own[2] >= 0
    shard = rows["shard"][0].as_py()
    digest = keys.view(np.int64)
    return pa.table([np.full(n, shard), np.arange(n), parent, digest[:, 0], digest[:, 1], pa.array(own[3], mask=~has), pa.array(own[4], mask=~has), own[0],
                     checks.dictionary.take(pa.array(own[2], mask=~has)).cast(pa.binary()), own[1], count, ended, pa.array(first, mask=count == 0), clash], schema=_LOCAL)


def _accumulate(band: int):
    def run(rows: pa.Table) -> pa.Table:
        """Subtree sums of what this shard's conversations own, and the smallest member of every owned node's parent."""
        rows = rows.take(pa.array(np.argsort(rows["slot"].to_numpy())))
        parent, d, bytes_, n, n_ends, leaves, saved, first, owner = _longs(
            rows, "parent_slot", "d", "bytes", "g_n", "g_ends", "c_leaves", "c_saved", "first_or", "g_first")
        owned = (rows["n"].to_numpy() > 0) & (first == owner)
        leaves, saved = leaves + (owned & (n == n_ends)), saved + np.where(owned, (n - 1) * bytes_, 0)
        children = np.bincount(parent[owned & (parent >= 0)], minlength=len(parent))
        for depth in np.unique(d)[::-1]:
            if depth % band:
                here = np.flatnonzero((d == depth) & (parent >= 0))
                np.add.at(leaves, parent[here], leaves[here])
                np.add.at(saved, parent[here], saved[here])
        above = pa.array(owner[parent], mask=~owned | (parent < 0))
        return pa.table([rows["hi"], rows["lo"], leaves, saved, children, above], schema=_SUMS)

    return run


def _below_bands(rows: DataFrame, nodes: DataFrame, band: int) -> DataFrame:
    """What each conversation owns below a band, on the band's last node in its shard: shard, hi, lo, c_leaves, c_saved."""
    owned = nodes.where(F.col("d") >= band).groupBy(F.col("g_first").alias("conv_id"), (F.floor(F.col("d") / band) - 1).alias("band")).agg(
        F.count_if(F.col("g_n") == F.col("g_ends")).alias("c_leaves"), F.sum((F.col("g_n") - 1) * F.col("bytes")).alias("c_saved"))
    anchors = rows.where((F.col("d") % band == band - 1) & ~F.col("ends")).select("conv_id", F.floor(F.col("d") / band).alias("band"), "shard", "hi", "lo")
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("band"))
    below = anchors.join(owned, ["conv_id", "band"], "left").select("shard", "hi", "lo", *[F.sum(F.coalesce(c, F.lit(0))).over(deeper).alias(c) for c in ("c_leaves", "c_saved")])
    return below.groupBy("shard", "hi", "lo").agg(F.sum("c_leaves").alias("c_leaves"), F.sum("c_saved").alias("c_saved"))


def _nodes(turns: DataFrame, convs: DataFrame, shard_rows: int, band: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prefix rows, verified node tables of the shards and nodes of the whole trie."""
    clashes, seed = True, 0
    while clashes:
        rows = stored(prefixes(turns, convs, seed), "prefixes")
        shards = max(1, -(-rows.count() // shard_rows))
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("conv_id", F.floor(F.col("d") / band)), F.lit(shards).cast("long")))
        local = stored(rows.groupBy("shard").applyInArrow(node_table, _spark(_LOCAL)), "slots")
        same = [F.max(c) != F.min(c) for c in ("d", "check", "phi", "plo")]
        clash = F.coalesce(F.max("clash") | reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in same]), F.lit(False))
        nodes = stored(local.groupBy("hi", "lo").agg(
            F.sum("n").alias("g_n"), F.sum("n_ends").alias("g_ends"), F.min("first").alias("g_first"), F.max("d").alias("d"), F.max("bytes").alias("bytes"), clash.alias("clash")), "nodes")
        clashes, seed = not nodes.where("clash").isEmpty(), seed + 1
    return rows, local, nodes


def prefix_trie(turns: DataFrame, convs: DataFrame, shard_rows: int = SHARD_ROWS, band: int = BAND) -> DataFrame:
    """A row per node from numbered ``turns`` (conv_id, pos from 1 without gaps, role, text) and all ``convs`` (conv_id, also without turns).

    hi, lo (digest), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes that members need not store again, over the subtree) and
    ends_sha256 (of the comma-joined ids of members that end here).
    """
    rows, local, nodes = _nodes(turns, convs, shard_rows, band)
    known = local.join(nodes.select("hi", "lo", "g_n", "g_ends", "g_first"), ["hi", "lo"])
    if (nodes.agg(F.max("d")).first()[0] or 0) >= band:
        known = known.join(_below_bands(rows, nodes, band), ["shard", "hi", "lo"], "left")
        known = known.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("c_leaves", "c_saved")})
    else:
        known = known.withColumns({c: F.lit(0).cast("long") for c in ("c_leaves", "c_saved")})
    known = known.withColumn("first_or", F.coalesce("first", F.lit(0).cast("long"))).select(
        "shard", "slot", "parent_slot", "hi", "lo", "d", "bytes", "n", "first_or", "g_n", "g_ends", "g_first", "c_leaves", "c_saved")
    sums = known.groupBy("shard").applyInArrow(_accumulate(band), _spark(_SUMS)).groupBy("hi", "lo").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum("children").alias("n_children"), F.max("parent").alias("parent_conv_id"))
    ids = rows.where("ends").groupBy("hi", "lo", F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ended = joined_sha256(ids, ["hi", "lo"], ["range"], "ids", ",", "ends_sha256")
    out = nodes.join(sums, ["hi", "lo"]).join(ended, ["hi", "lo"], "left")
    return out.select("hi", "lo", F.col("g_first").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("g_n").alias("n_convs"), "n_children", "n_leaves",
                      "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
