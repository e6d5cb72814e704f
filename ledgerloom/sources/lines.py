"""Transcripts as files of JSON lines: physical lines, byte for byte, and what is on them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.runtime import ship_package

LINES = "session string, line long, raw binary, sha256 string"


def split_lines(data: bytes) -> list[bytes]:
    """Lines with their terminators; carriage returns and an unterminated last line are kept."""
    parts = data.split(b"\n")
    return [x + b"\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _explode(batches):
    import pyarrow as pa

    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            lines = split_lines(content or b"")
            for k in range(0, len(lines), 10_000):
                part = lines[k : k + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(part), pa.string()),
                        pa.array(range(k + 1, k + 1 + len(part)), pa.int64()),
                        pa.array(part, pa.binary()),
                        pa.array(["sha256:" + hashlib.sha256(x).hexdigest() for x in part], pa.string()),
                    ],
                    names=["session", "line", "raw", "sha256"],
                )


def explode_lines(df: DataFrame) -> DataFrame:
    """(session, line, raw, sha256) of the physical lines of ``df(session STRING, content BINARY)``."""
    ship_package(df.sparkSession)
    return df.select("session", "content").mapInArrow(_explode, LINES)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session, line, raw, sha256) of each file under ``path``; the session is the file."""
    files = spark.read.format("binaryFile").load(path)
    return explode_lines(files.select(F.col("path").alias("session"), "content"))


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("session").agg(F.count("*").alias("lines"), F.sum(F.octet_length("raw")).alias("bytes"))
