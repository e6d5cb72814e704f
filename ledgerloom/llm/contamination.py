"""Evaluation texts leaking into training text (problem 9).

1. Every n-gram of the test items is counted in the corpus (one pass, map-side combined).
2. Each ``run``-word window of an item keeps its rarest n-grams as seeds, the rarest one at
   least, so that a document that holds any such window must hold one of its seeds; n-grams
   about as rare stay seeds too, as an edited copy may have lost the rarest.
3. A second pass looks the seeds up in each document and, where one hits, aligns item and
   document locally (Smith-Waterman over words), in place: no text is shuffled.

An n-gram is four words, so that a copy with every fifth word changed still holds seeds.

The items are a stated query set: they are taken to the driver in blocks of ``max_items_mb``
of text, so the index broadcast (about ten bytes a byte of it, in flat arrays) is bounded by a
parameter and not by the data.

Words are maximal runs of letters or digits in lower case.  Defined results: null and empty
texts match nothing; an item of fewer than ``run`` words matches nothing exactly; repeated
items are reported each under its own id.  Every seeded pair is aligned, and what its alignment
matches decides whether it is reported: from ``least_words`` on, 0 for every pair.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import ship_package, spread

NGRAM = 4
RUN = 13
NEAR = 8
LEAST = 10
_WORD = re.compile(r"[^\W_]+")
_OUT = "item_id long, doc_id {doc}, longest_run int, score double, matched int, item_words int"


def words(text: str) -> list[str]:
    low = text.lower() if "İ" not in text else None
    return _WORD.findall(low) if low is not None else [w.lower() for w in _WORD.findall(text)]


class Index:
    """Item words as numbers and n-grams as 64-bit mixes of them, in flat arrays.  Two n-grams
    with the same mix would only cost a needless alignment: every hit is compared word by word."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int = NGRAM):
        import numpy as np

        self.n = n
        self.vocab: dict[str, int] = {}
        self.ids = np.array([i for i, _ in items], np.int64)
        self.items = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int32) for _, ws in items]
        grams = [self.grams(w) for w in self.items]
        sizes = np.array([len(g) for g in grams], np.int64)
        # every n-gram's places, the n-grams in order: those of keys[i] are starts[i] to starts[i + 1]
        self.keys, which = np.unique(np.concatenate([np.zeros(0, np.int64), *grams]), return_inverse=True)
        order = np.argsort(which, kind="stable")
        self.item_of = np.repeat(np.arange(len(items), dtype=np.int32), sizes)[order]
        self.place_of = np.concatenate([np.zeros(0, np.int32), *[np.arange(k, dtype=np.int32) for k in sizes]])[order]
        self.starts = np.searchsorted(which[order], np.arange(len(self.keys) + 1))

    def grams(self, w):
        """The mixes of all n-grams of a row of word numbers; 0 where it holds a 0."""
        import numpy as np

        m = len(w) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        h, ok = np.zeros(m, np.uint64), np.ones(m, bool)
        with np.errstate(over="ignore"):
            for i in range(self.n):
                x = w[i : i + m]
                ok &= x > 0
                h = (h ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        g = h.view(np.int64).copy()
        g[~ok] = 0
        return g

    def numbers(self, text: str):
        import numpy as np

        get = self.vocab.get
        return np.array([get(w, 0) for w in words(text)], np.int32)

    def hits(self, w):
        """(places of ``w`` that hold an item's n-gram, the numbers of those n-grams)."""
        import numpy as np

        g = self.grams(w)
        if not len(g) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        at = np.flatnonzero((self.keys[i] == g) & (g != 0))
        return at, i[at]

    def choose(self, counts, run: int = RUN):
        """Which n-grams are seeds: of each window the rarest, by how many corpus documents hold
        it, and all that are in no more than ``NEAR`` times as many."""
        import numpy as np

        view = np.lib.stride_tricks.sliding_window_view
        chosen = np.zeros(len(self.keys), bool)
        span = max(1, run - self.n + 1)
        for w in self.items:
            at = np.searchsorted(self.keys, self.grams(w))
            if not len(at):
                continue
            c = counts[at]
            k = min(span, len(c))
            most = NEAR * (view(c, k).min(axis=1) + 1)
            # the greatest limit of the windows that hold a place
            limit = view(np.pad(most, k - 1), k).max(axis=1)
            chosen[at[c <= limit]] = True
        return chosen


def longest_run(item, doc, ip: int, dp: int) -> tuple[int, int, int]:
    """(length, item start, document start) of the equal run through the given places."""
    if item[ip] != doc[dp]:
        return 0, ip, dp
    a = 0
    while ip - a > 0 and dp - a > 0 and item[ip - a - 1] == doc[dp - a - 1]:
        a += 1
    b = 1
    while ip + b < len(item) and dp + b < len(doc) and item[ip + b] == doc[dp + b]:
        b += 1
    return a + b, ip - a, dp - a


def smith_waterman(item, doc, match: float = 2.0, mismatch: float = -1.0, gap: float = -1.0) -> float:
    """Best local alignment score of two rows of word numbers (0 matches nothing)."""
    import numpy as np

    if not len(item) or not len(doc):
        return 0.0
    # rows are kept less the slope of a gap along them, which makes such gaps a running maximum
    step = gap * np.arange(len(doc) + 1)
    floor = -step[1:]
    prev, diag, up, best = -step, np.empty(len(doc)), np.empty(len(doc)), 0.0
    block = max(1, (1 << 18) // len(doc))  # rows at a time, so that a long item stays in bounds
    for a in range(0, len(item), block):
        x = item[a : a + block, None]
        gain = np.where((doc == x) & (x != 0), match - gap, mismatch - gap)
        rows = np.zeros((len(gain), len(doc) + 1))
        for row, g in zip(rows, gain):
            np.add(prev[:-1], g, out=diag)
            np.add(prev[1:], gap, out=up)
            np.maximum(diag, up, out=diag)
            np.maximum(diag, floor, out=row[1:])
            np.maximum.accumulate(row, out=row)
            prev = row
        best = max(best, float((rows + step).max()))
    return best


def compare(index: Index, seeds, text: str, least_words: int = 0, least_run: int = 0) -> list[tuple]:
    """(item id, longest run, score, words matched, item words) of the items seeded in a text."""
    w = index.numbers(text)
    places, grams = index.hits(w)
    near: dict[int, list[tuple[int, int]]] = {}
    keep = seeds[grams]
    for d, g in zip(places[keep].tolist(), grams[keep].tolist()):
        for j in range(index.starts[g], index.starts[g + 1]):
            near.setdefault(int(index.item_of[j]), []).append((int(index.place_of[j]), d))
    out = []
    for k, hits in near.items():
        item_id, item = int(index.ids[k]), index.items[k]
        run, covered = 0, {}
        for p, d in hits:
            if covered.get(d - p, -1) >= d:  # on a diagonal that was walked already
                continue
            n, _, ds = longest_run(item, w, p, d)
            covered[d - p] = ds + n - 1
            run = max(run, n)
        if run < max(index.n, least_run):
            continue
        lo = max(0, min(d for _, d in hits) - len(item))
        hi = min(len(w), max(d for _, d in hits) + len(item) + index.n)
        score = 0.0
        step = 4 * len(item) + 64
        for a in range(lo, hi, step):  # long stretches in overlapping pieces
            score = max(score, smith_waterman(item, w[a : min(hi, a + step + 2 * len(item))]))
        if score // 2 < least_words:
            continue
        out.append((item_id, run, score / (2.0 * len(item)), int(score // 2), len(item)))
    return out


def _item_blocks(items: DataFrame, item_id: Column, text: Column, max_mb: int):
    """The items in blocks of at most ``max_mb`` of text, by hash; one block if they are few."""
    rows = items.select(item_id.cast("long").alias("i"), text.alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // (max_mb << 20)))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        yield [(r.i, words(r.t)) for r in part.orderBy("i").toLocalIterator()]


def align(
    docs: DataFrame,
    doc_id: Column,
    text: Column,
    items: DataFrame,
    item_id: Column,
    item_text: Column,
    run: int = RUN,
    n: int = NGRAM,
    max_items_mb: int = 16,
    least_words: int | None = None,
    least_run: int = 0,
) -> DataFrame:
    """(item_id, doc_id, longest_run, score, matched, item_words) for every document and item
    that share a seed; ``score`` is the alignment's share of a perfect one.

    Pairs are left out whose alignment matches fewer than ``least_words`` (``LEAST`` if not
    given; 0 reports all), or whose longest run, known before aligning, is below ``least_run``.
    """
    import numpy as np

    least_words = LEAST if least_words is None else least_words
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(doc_id.alias("doc_id"), text.alias("text")).where("text is not null and text <> ''")
    src = spread(src, "doc_id")
    kind = src.schema["doc_id"].dataType.simpleString()
    parts = []
    for block in _item_blocks(items, item_id, item_text, max_items_mb):
        index = spark.sparkContext.broadcast(Index(block, n))
        counted = src.select("text").mapInArrow(_counter(index), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        # at most one row per n-gram of the block
        counts = np.zeros(len(index.value.keys), np.int64)
        for r in counted.toLocalIterator():
            counts[r.gram] = r.n
        seeds = spark.sparkContext.broadcast(index.value.choose(counts, run))
        parts.append(src.mapInArrow(_comparer(index, seeds, least_words, least_run), _OUT.format(doc=kind)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counter(index):
    def go(batches):
        import numpy as np
        import pyarrow as pa

        total: dict[int, int] = {}
        x = index.value
        for b in batches:
            found = [np.unique(g) for s in b.column(0).to_pylist() for _, g in [x.hits(x.numbers(s))] if len(g)]
            if found:
                for g, c in zip(*(a.tolist() for a in np.unique(np.concatenate(found), return_counts=True))):
                    total[g] = total.get(g, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    return go


def _comparer(index, seeds, least_words, least_run):
    def go(batches):
        import pyarrow as pa

        for b in batches:
            at, rows = [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                for r in compare(index.value, seeds.value, s, least_words, least_run):
                    at.append(i)
                    rows.append(r)
            if rows:
                item, run, score, matched, size = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.int64()), b.column(0).take(pa.array(at, pa.int64())), pa.array(run, pa.int32()), pa.array(score, pa.float64()), pa.array(matched, pa.int32()), pa.array(size, pa.int32())],
                    names=["item_id", "doc_id", "longest_run", "score", "matched", "item_words"],
                )

    return go


def leaks(aligned: DataFrame, run: int = RUN) -> DataFrame:
    """(item_id, doc_id): at least ``run`` consecutive words in common."""
    return aligned.where(F.col("longest_run") >= run).select("item_id", "doc_id")


