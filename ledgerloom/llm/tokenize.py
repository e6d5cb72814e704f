"""Encoding of a whole corpus with a public byte-level BPE (problem 8).

A text is an element of a monoid: (text, ids).  A short one is encoded directly; a long one
is split in halves, recursively, and neighbours are joined.  Joining re-encodes a window
around the seam that grows on each side until it reaches a place where the tokens beyond
are provably the same: the step from a non-blank character to a blank one.  No branch of
the pre-tokeniser's pattern matches across such a step, and none looks further back or
ahead than the character on either side of it, so what was encoded beyond the step does not
depend on anything on the other side.

Defined results: null and empty text give an empty list; strings of special tokens are
ordinary text; ids of a text do not depend on where it was split.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame

from ledgerloom.runtime import ship_package, spread

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pre-tokeniser of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: characters of a leaf; longer texts are encoded as a tree
LEAF = 1 << 15

_loaded: dict = {}


class Tokenizer:
    """One loaded vocabulary; kept for the life of a Python worker."""

    def __init__(self, path: str = VOCAB):
        import numpy as np
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)

    def leaf(self, text: str):
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str, leaf: int = LEAF):
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        a, b = text[:half], text[half:]
        return self.join(a, self.encode(a, leaf), b, self.encode(b, leaf))

    def join(self, left: str, left_ids, right: str, right_ids):
        """The ids of ``left + right`` from those of both parts."""
        import numpy as np

        i, j = _last_step(left), _first_step(right)
        tail, head = left[i:], right[:j]
        keep = len(left_ids) - self._count(left_ids[::-1], len(tail.encode()))
        skip = self._count(right_ids, len(head.encode()))
        return np.concatenate([left_ids[:keep], self.leaf(tail + head), right_ids[skip:]])

    def _count(self, ids, size: int) -> int:
        """How many ids from the front make up ``size`` bytes."""
        import numpy as np

        step = 64
        while size and int(self.lengths[ids[:step]].sum()) < size:
            step *= 4
        return int(np.searchsorted(np.cumsum(self.lengths[ids[:step]]), size)) + 1 if size else 0

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids) -> bytes:
        if len(ids) <= 4096:
            return b"".join([self.pieces[i] for i in ids])
        half = len(ids) // 2
        return self.decode_bytes(ids[:half]) + self.decode_bytes(ids[half:])


def _last_step(text: str) -> int:
    """The last place where a blank follows a non-blank, looking back in growing windows; 0 if none."""
    import re

    size = 64
    while True:
        lo = max(0, len(text) - size)
        at = -1
        for m in re.finditer(r"(?<=\S)\s", text[lo:]):
            at = lo + m.start()
        if at >= 0 or lo == 0:
            return max(at, 0)
        size *= 4


def _first_step(text: str) -> int:
    """The first such place, or the length of the text."""
    import re

    m = re.search(r"(?<=\S)\s", text)
    return m.start() if m else len(text)


def tokenizer(path: str = VOCAB) -> Tokenizer:
    """The tokenizer of a vocabulary file; in a worker, of the copy that was sent along."""
    if path not in _loaded:
        import os

        from pyspark import SparkFiles

        sent = SparkFiles.get(os.path.basename(path)) if SparkFiles._is_running_on_worker else path
        _loaded[path] = Tokenizer(sent if os.path.exists(sent) else path)
    return _loaded[path]


def _send(spark, path: str) -> None:
    """Makes the vocabulary file reach every worker, once for each application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        spark.sparkContext.addFile(path)
        _sent.add(key)


_sent: set = set()


def encode_column(df: DataFrame, key: Column, text: Column, path: str = VOCAB, leaf: int = LEAF) -> DataFrame:
    """(key, ids ARRAY<INT>), one row per row of ``df``."""
    ship_package(df.sparkSession)
    _send(df.sparkSession, path)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ledgerloom.llm.tokenize import tokenizer

        t = tokenizer(path)
        none = np.zeros(0, np.uint32)
        for b in batches:
            ids = [t.encode(s, leaf) if s else none for s in b.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            values = np.concatenate(ids).astype(np.int32) if ids else none.astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["k", "ids"])

    src = df.select(key.alias("k"), text.alias("t"))
    name = src.schema["k"].dataType.simpleString()
    return spread(src, "k").mapInArrow(run, f"k {name}, ids array<int>")


def decode_column(df: DataFrame, key: Column, ids: Column, path: str = VOCAB) -> DataFrame:
    """(key, text): the texts of lists of ids; null gives an empty text."""
    ship_package(df.sparkSession)
    _send(df.sparkSession, path)

    def run(batches):
        import pyarrow as pa

        from ledgerloom.llm.tokenize import tokenizer

        t = tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["k", "text"])

    src = df.select(key.alias("k"), ids.alias("i"))
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, text string")
