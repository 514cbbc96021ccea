"""Token ids as Parquet files that can be read in part.

One row per document, in order of id over all files: the id, the number of tokens,
the file's number, the tokens before the document in its file, and the ids as a list
column. The ids are dictionary encoded (a dictionary page per row group, then packed
indexes); the number columns are delta encoded (writer version 2). Row groups and
pages have set sizes and page indexes are written, so that a reader of some documents
decodes their pages only and a reader of lengths touches no ids.

Order comes from a range exchange over (id, hash of the text), so that many rows of one
id are still spread; each task then sorts and encodes its own range. ``start``, the ids
of all documents before one, is the number in its own file plus the sum of the files
before, for which one row per file is enough.

Defined cases: null text is an empty document (its end id alone); null ids come first;
rows of one id follow each other in order of their texts, and repeated rows are written
as often as they come; an empty table gives no files and no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordEncoder, arrow_map, column_type

END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
WRITE_OPTIONS = {
    "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES), "parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true",
}


def file_schema(id_name: str, id_type: T.DataType) -> T.StructType:
    return (T.StructType().add(id_name, id_type).add("n_tokens", T.LongType()).add("part", T.IntegerType())
            .add("before", T.LongType()).add("ids", T.ArrayType(T.IntegerType(), False)))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every text, close it with ``end_id`` and write the files to ``path`` (a folder all executors share)."""
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        encoder, part, before = WordEncoder.of_worker(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), 2048):
                piece = batch.slice(at, 2048)
                texts = [x + end for x in encoder.encode(piece[1])]
                sizes = np.array([len(x) // 4 for x in texts], np.int64)
                ends = np.cumsum(sizes)
                values = pa.array(np.frombuffer(b"".join(texts), "<u4").astype(np.int32))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)
                yield {"id": piece[0], "n": sizes, "part": np.full(len(piece), part, np.int32), "before": before + ends - sizes, "ids": ids}
                before += int(ends[-1])

    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col), F.xxhash64(text_col)).sortWithinPartitions(id_col, text_col)
    arrow_map(ordered, run, file_schema(id_col, column_type(docs, id_col))).write.mode("errorifexists").options(**WRITE_OPTIONS).parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", id_type: T.DataType | None = None) -> DataFrame:
    """The files as they are; select or filter to read less. An empty folder reads as no rows."""
    return spark.read.schema(file_schema(id_col, id_type or T.LongType())).parquet(path)


def with_start(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Replace ``before`` by ``start``, the tokens of all documents before this one; reads two number columns of ``files``."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    # One row per written file, so the window and the broadcast hold as many rows as the write had tasks.
    base = sums.select(F.col("part"), (F.sum("_sum").over(Window.orderBy("part")) - F.col("_sum")).alias("_base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("before") + F.col("_base")).drop("_base", "before", "part")


def token_checksums(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the ids in the files: id, n_tokens, part, before, ids_crc32 over little-endian uint32."""
    source = files.select(id_col, "part", "before", "ids")
    schema = (T.StructType().add(id_col, column_type(files, id_col)).add("part", T.IntegerType()).add("before", T.LongType())
              .add("n_tokens", T.LongType()).add("ids_crc32", T.LongType()))

    def run(batches):
        for batch in batches:
            ids = batch[3]
            ends, values = ids.offsets.to_numpy(), np.asarray(ids.values).astype("<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield {"id": batch[0], "part": batch[1], "before": batch[2], "n": np.diff(ends), "crc": crc}

    return arrow_map(source, run, schema)
