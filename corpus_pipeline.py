"""Corpus preparation from raw documents to packed token windows, stage by stage.

Toxic documents go; lines that repeat in windows of three are removed, and documents of
which nothing is left go; of near duplicates (five-word shingles, similarity 0.8 or more)
one stays; benchmark passages are cut out; what remains is packed. All stages but the last
return the columns of ``documents``, with ``n_chars`` kept true to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import stored, table, word_tokenizer_path
from tracelake.llm.fm_index import cut_passages, find_passages
from tracelake.llm.line_windows import drop_repeated_lines
from tracelake.llm.minhash import drop_near_duplicates
from tracelake.llm.packing import pack
from tracelake.llm.toxicity import reject_toxic


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    return reject_toxic(docs, table(spark, sf_dir, "labels"), learn)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = drop_repeated_lines(docs)
    return _measured(left.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(cut_passages(docs, find_passages(docs, table(spark, sf_dir, "benchmark"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_tokenizer_path())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: Learned scores and tokens are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
