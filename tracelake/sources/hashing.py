"""Hashes of files of any size.

Files are listed without their contents; a task opens its files itself and reads ranges of
them: a few bytes at both ends for the fingerprint that catalogues compare, and, where the
whole content counts, all blocks in order past one running hash. So a file larger than a
row may be needs the memory of one block. A file is the unit of work, as SHA-256 cannot be
split; many files are hashed side by side.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: bytes of either end that a fingerprint covers.
END_BYTES = 4_096
BLOCK_BYTES = 1 << 20


def listed_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, size, modified) of every file under ``path``; contents are not read, and empty files are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def open_file(uri: str):
    """A random-access file of any store that pyarrow knows; plain and ``file:`` names are local ones."""
    from pyarrow import fs

    local = re.fullmatch(r"(?:file:/*(?=/))?(/.*)", uri)
    if local:
        return fs.LocalFileSystem().open_input_file(local[1])
    system, name = fs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


def _ends(source, size: int, span: int) -> tuple[bytes, bytes]:
    head = source.read(min(span, size))
    if size <= span:
        return head, b""
    source.seek(max(0, size - span))
    return head, source.read(span)


def file_hashes(spark: SparkSession, path: str | list[str], whole: bool = True, span: int = END_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """(file, size, modified, fingerprint, ends_sha256, sha256) of every file.

    ``fingerprint`` covers name, size, time of change and both ends, ``ends_sha256`` the
    bytes of both ends only (the tail is empty for files of at most ``span`` bytes);
    ``sha256`` of all bytes is null unless ``whole``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, size, modified in zip(frame["file"], frame["size"].tolist(), frame["modified"].tolist()):
                with open_file(file) as source:
                    head, tail = _ends(source, size, span)
                    name = f"{file.rsplit('/', 1)[-1]}|{size}|{modified}|".encode()
                    content = hashlib.sha256() if whole else None
                    if whole:
                        source.seek(0)
                        while piece := source.read(block):
                            content.update(piece)
                rows.append((file, size, modified, hashlib.sha256(name + head + b"|" + tail).hexdigest(), hashlib.sha256(head + tail).hexdigest(), content.hexdigest() if whole else None))
            yield pd.DataFrame(rows, columns=["file", "size", "modified", "fingerprint", "ends_sha256", "sha256"])

    listed = listed_files(spark, path)
    return listed.repartition("file").mapInPandas(run, "file string, size long, modified long, fingerprint string, ends_sha256 string, sha256 string")
