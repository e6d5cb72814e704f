"""Trees of files and patches as sources: checksums, binary detection, added lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.scan import binary
from ledgerloom.runtime import ship_package, spread

SKIPPED = ("node_modules", "dist", ".git")


def read_tree(spark: SparkSession, path: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, length, is_binary, content) of the files below ``path``, some folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    keep = ~F.exists(F.split("path", "/"), lambda x: x.isin(*skipped)) if skipped else F.lit(True)
    return files.where(keep).select("path", "length", binary(F.col("content")).alias("is_binary"), "content")


def checksums(files: DataFrame) -> DataFrame:
    """(sha256, path), the rows of a checksum manifest; sort by path to write one."""
    return files.select(F.sha2("content", 256).alias("sha256"), "path")


def compare_checksums(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """(path, state): same, changed, missing or new against a recorded manifest."""
    a, b = now.select("path", F.col("sha256").alias("x")), recorded.select("path", F.col("sha256").alias("y"))
    state = F.when(F.col("x").isNull(), "missing").when(F.col("y").isNull(), "new").when(F.col("x") == F.col("y"), "same").otherwise("changed")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def _added(batches):
    import re

    import pyarrow as pa

    hunk = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@")
    for b in batches:
        at, file, line, text = [], [], [], []
        for i, patch in enumerate(b.column(1).to_pylist()):
            name, n = None, None
            for s in patch.split("\n") if patch else ():
                if s.startswith("diff --git "):
                    name, n = s.rpartition(" b/")[2].rstrip("\r"), None
                elif m := hunk.match(s):
                    n = int(m[1])
                elif n is not None and not s.startswith("\\"):
                    if s.startswith("+"):
                        at.append(i)
                        file.append(name)
                        line.append(n)
                        text.append(s[1:])
                    if s[:1] in ("+", " "):
                        n += 1
                    elif s[:1] != "-":
                        n = None  # the hunk has ended
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(at, pa.int64())), pa.array(file, pa.string()), pa.array(line, pa.int64()), pa.array(text, pa.string())], names=["k", "file", "line", "text"]
        )


def added_lines(df: DataFrame, key: Column, patch: Column) -> DataFrame:
    """(k, file, line, text) of the lines that patches add, numbered as in the new file.

    A patch is read where it lies: its lines are not shuffled.
    """
    ship_package(df.sparkSession)
    src = df.select(key.alias("k"), patch.alias("p")).where("p is not null")
    return spread(src, "k").mapInArrow(_added, f"k {src.schema['k'].dataType.simpleString()}, file string, line long, text string")
