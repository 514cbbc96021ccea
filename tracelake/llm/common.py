"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.workdir import stored, work_dir  # noqa: F401  (used by the operators)

#: Words a worker keeps with their ids at most; about 250 bytes each.
CACHED_WORDS = 300_000
#: Text of a batch that is worked on together, in bytes.
SLICE_BYTES = 4_000_000
#: Words whose bytes are hashed together.
HASHED_WORDS = 1 << 16
_BASES = (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def fewer_tasks(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, in a task per ``each`` rows, or as it is if those are more tasks.

    For small tables that are written: a task writes a file, and for every file a local file system
    without native code starts processes, each of which counts as the executor's memory once more until it runs.
    """
    return df.coalesce(max(1, -(-rows // each)))


def stored_in_small_batches(df: DataFrame, name: str) -> DataFrame:
    """``stored`` for rows that may hold several long texts: fewer of them go to Python at a time."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, "16m")
    try:
        return stored(df, name)
    finally:
        conf.set(key, before)


_HASHES = 1 << 30


def lowest_hashes(rows: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """(group, key) of about ``size`` rows per group at most, those whose key hashes lowest; all of smaller groups.

    Groups are counted first (one small row each comes to the driver), and only rows under a
    hash that about twice as many reach are ranked, so no task ranks a large group.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    counts = rows.groupBy(group).count().collect()
    below = F.lit(0)
    for r in counts:
        below = F.when(F.col(group) == F.lit(r[0]), F.lit(min(_HASHES, 2 * size * _HASHES // r[1]))).otherwise(below)
    hashed = rows.select(group, key, F.pmod(F.xxhash64(key), F.lit(_HASHES)).alias("_h")).where(F.col("_h") < below)
    by = Window.partitionBy(group).orderBy("_h", key)
    return hashed.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= size).select(group, key)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` whose ``fn`` yields dicts of columns (lists or arrays) in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches):
        for columns in fn(batches):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns.values(), target, strict=True)]
            arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, target, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def joined_sha256(rows: DataFrame, keys: list[str], order: list[str], value: str, separator: str, out: str) -> DataFrame:
    """Keys and the SHA-256 (hex) of each key's string ``value``s in ``order``, joined by ``separator``.

    Rows come sorted and pass by a running hash, so a key of any size needs the memory of one batch.
    """
    import hashlib

    n, sep = len(keys), separator.encode()
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(out, T.StringType())])

    def run(batches):
        last, running, found = None, None, []
        for batch in batches:
            for *key, text in zip(*(c.to_pylist() for c in batch.columns[:n + 1])):
                if key != last:
                    if running is not None:
                        found.append([*last, running.hexdigest()])
                    last, running = key, hashlib.sha256()
                else:
                    running.update(sep)
                running.update(text.encode("utf-8", "surrogatepass"))
            if found:
                yield dict(enumerate(zip(*found)))
                found = []
        if running is not None:
            yield dict(enumerate(zip([*last, running.hexdigest()])))

    dealt = rows.select(*keys, value, *order).repartition(*keys).sortWithinPartitions(*keys, *order)
    return arrow_map(dealt, run, schema)


def kept_in_worker(name: str, make: Callable):
    """One object per Python worker process and name, for caches that later tasks of the process go on with."""
    holder = sys.modules.setdefault("_tracelake_worker", types.ModuleType("_tracelake_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


class WordEncoder:
    """Ids of whole texts as little-endian uint32 bytes, for the word tokenizer (see the README of the vocabularies).

    Its tokens never cross white space, so only the different words of a piece of a batch
    are encoded, and what they consist of is remembered for later ones. Most words are
    letters with a mark behind them. Their letters are put in lower case by Arrow and go to
    the library's model without its normaliser, which is most of its time; all other words
    go through the whole tokenizer.
    """

    #: Composed letters whose lower case is the same everywhere; one mark may follow.
    PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+[.,]?$"

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.limit, self.known, self.others = Tokenizer.from_file(path), limit, {}, {}
        self.model_only = Tokenizer(self.whole.model)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.byte_symbols = "".join(chr(b if b in printable else next(rest)) for b in range(256))

    @classmethod
    def of_worker(cls, path: str) -> WordEncoder:
        return kept_in_worker(f"words:{path}", lambda: cls(path))

    def _looked_up(self, words: list[str], known: dict, tokenizer, written: Callable[[str], str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind each other, and where each word's ids end; unknown words are encoded first."""
        if new := [w for w in words if w not in known]:
            for _ in range(len(known) // 2 if len(known) + len(new) > self.limit else 0):
                known.popitem()  # the newest: words known for long are the frequent ones
            new = [w for w in words if w not in known]
            for at in range(0, len(new), 4096):
                part = new[at:at + 4096]
                got = tokenizer.encode([written(w) for w in part], is_pretokenized=True, add_special_tokens=False)
                raw, owner = np.asarray(got.ids, "<u4").tobytes(), np.asarray(got.word_ids, np.int64)
                cuts = (np.searchsorted(owner, np.arange(len(part) + 1)) * 4).tolist()
                known.update(zip(part, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]))
        ids = [known[w] for w in words]
        return np.frombuffer(b"".join(ids), "<u4"), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, and where each word's ids end."""
        plain = pc.match_substring_regex(words, self.PLAIN)
        is_plain = np.asarray(plain)
        marked = words.filter(plain)
        last = pc.utf8_slice_codeunits(marked, -1)
        mark = np.asarray(pc.is_in(last, value_set=pa.array([".", ","])))
        letters = pc.utf8_lower(pc.if_else(pa.array(mark), pc.utf8_slice_codeunits(marked, 0, -1), marked))
        pieces = pa.concat_arrays([letters, pa.array([".", ","])]).dictionary_encode()
        place = np.asarray(pieces.indices)
        symbols = self.byte_symbols
        ids, ends = self._looked_up(pieces.dictionary.to_pylist(), self.known, self.model_only,
                                    lambda p: p if p.isascii() else p.encode().decode("latin-1").translate(symbols))
        more, more_ends = self._looked_up(words.filter(pc.invert(plain)).to_pylist(), self.others, self.whole, str)
        # Each word is a part of the ids, and a mark behind it; the parts are numbered: pieces, then other words, then nothing.
        ends = np.concatenate([[0], ends, len(ids) + more_ends])
        first, second = np.empty(len(words), np.int64), np.full(len(words), -1, np.int64)
        first[is_plain], first[~is_plain] = place[:-2], len(pieces.dictionary) + np.arange(len(more_ends))
        comma = np.asarray(pc.equal(last, ","))
        second[is_plain] = np.where(mark, np.where(comma, place[-1], place[-2]), -1)
        parts = np.stack([first, second], 1).ravel()
        size = np.where(parts < 0, 0, ends[parts + 1] - ends[parts])
        ids = gathered(np.concatenate([ids, more]), ends[parts], size)
        return ids, np.cumsum(size)[1::2]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        for piece in sliced_by_bytes(texts, SLICE_BYTES):
            lists = pc.ascii_split_whitespace(pc.fill_null(piece, ""))
            words = lists.flatten().dictionary_encode()
            ids, ends = self._of_words(words.dictionary)
            which = np.asarray(words.indices)
            size = np.diff(ends, prepend=0)
            until = np.concatenate([[0], np.cumsum(size[which])])
            raw = gathered(ids, (ends - size)[which], size[which]).tobytes()
            offsets = np.asarray(lists.offsets)
            cuts = (until[offsets - offsets[0]] * 4).tolist()
            yield from (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:]))


def gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``values[begin:begin + size]`` of all pairs behind each other."""
    until = np.cumsum(size)
    return values[np.repeat(begin - until + size, size) + np.arange(until[-1] if len(until) else 0)]


def sliced_by_bytes(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Slices of about ``limit`` bytes, one text at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    until, at = np.cumsum(sizes), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(until, until[at] - sizes[at] + limit, "right")))
        yield texts.slice(at, to - at)
        at = to


def word_tokenizer_path() -> str:
    """The vocabulary file that the registered queries name; it is a parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def split_flat(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space of all texts (null: none), and where each text's words begin and end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, offsets = lists.flatten(), np.asarray(lists.offsets, np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(np.asarray(full), dtype=np.int64)])
    return words.filter(full), before[offsets - offsets[0]]


def word_hashes(words: pa.Array) -> np.ndarray:
    """A uint64 hash of each word; every different word is hashed once."""
    import xxhash

    coded, digest = words.dictionary_encode(), xxhash.xxh3_64_intdigest
    different = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return different[np.asarray(coded.indices)] if len(words) else np.empty(0, np.uint64)


def byte_hashes(words: pa.Array, lanes: int) -> np.ndarray:
    """``lanes`` rows of uint64 hashes of words, none of them null or empty, summed up from their bytes and the bytes' places.

    All words are hashed at once: texts with many different words cost no more than others.
    """
    raw = words.cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if len(raw) else np.empty(0, np.uint8)
    out = np.empty((lanes, len(raw)), np.uint64)
    for at in range(0, len(raw), HASHED_WORDS):
        cuts = bounds[at:at + HASHED_WORDS + 1]
        first, size = cuts[:-1] - cuts[0], np.diff(cuts)
        h = np.arange(cuts[-1] - cuts[0]) - np.repeat(first, size)
        h = mixed((h.view(np.uint64) << np.uint64(8) | data[cuts[0]:cuts[-1]]) * np.uint64(0x9E3779B97F4A7C15))
        for lane in out:
            lane[at:at + HASHED_WORDS] = mixed(np.add.reduceat(h, first))
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return out


def span_digests(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Per lane of word hashes, a digest of the words ``first`` to before ``end``: differences of running sums with powers as weights."""
    out = np.empty((len(hashes), len(first)), np.int64)
    for lane, digest, base in zip(hashes, out, _BASES):
        sums = np.zeros(len(lane) + 1, np.uint64)
        np.cumsum(lane * np.multiply.accumulate(np.full(len(lane), base, np.uint64)), out=sums[1:])
        back = np.multiply.accumulate(np.full(len(lane) + 1, pow(base, -1, 1 << 64), np.uint64))
        digest[:] = mixed((sums[end] - sums[first]) * back[first] + (end - first).astype(np.uint64)).view(np.int64)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A uint64 hash of each ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    acc = words[:n].copy()
    for i in range(1, size):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n]
    return mixed(acc)
