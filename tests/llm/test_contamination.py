import random
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import contamination as C

WORDS = [f"w{i}" for i in range(40)] + ["The", "élan", "12"]


def corpus(seed=1, n=300):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([5, 13, 20, 40])))) for i in range(12)]
    items += [(90, items[3][1]), (91, None), (92, ""), (93, "one two")]
    docs = []
    for k in range(n):
        w = [r.choice(WORDS) for _ in range(r.randint(0, 60))]
        if r.random() < 0.6:
            src = (r.choice(items[:12])[1] or "").split()
            a = r.randrange(len(src))
            piece = src[a : a + r.randint(5, 30)]
            if r.random() < 0.4 and len(piece) > 3:
                piece[len(piece) // 2] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() if r.random() < 0.1 else x for x in piece]
        docs.append((k, r.choice([" ", "\n+ ", "_-_"]).join(w)))
    return items, docs + [(900, None), (901, ""), (902, items[4][1] * 1 + ". " + items[4][1])]


def brute(items, docs, run=13):
    split = lambda t: [x.lower() for x in re.findall(r"[^\W_]+", t or "")]
    grams = lambda w: {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    g = {i: grams(split(t)) for i, t in items}
    return {(i, d) for d, t in docs for dg in [grams(split(t))] for i, x in g.items() if x & dg}


def frames(spark, items, docs):
    return spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string").repartition(5), spark.createDataFrame(items, "item_id long, text string")


def find(spark, items, docs, **kw):
    d, i = frames(spark, items, docs)
    return C.align(d, F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("text"), **kw)


def test_against_brute_force(spark):
    items, docs = corpus()
    got = {tuple(r) for r in C.leaks(find(spark, items, docs)).collect()}
    assert got == brute(items, docs) and len(got) > 10


def test_item_blocks_give_the_same(spark, monkeypatch):
    items, docs = corpus(2, 60)
    blocks = [[(i, C.words(t)) for i, t in items if t][k::3] for k in range(3)]
    monkeypatch.setattr(C, "_item_blocks", lambda *a: iter(blocks))
    assert {tuple(r) for r in C.leaks(find(spark, items, docs)).collect()} == brute(items, docs)


def test_edited_copies_are_scored(spark):
    src = [f"a{i}" for i in range(40)]
    edited = [*src]
    for k in (9, 19, 29):
        edited[k] = "other"
    got = {r.doc_id: r for r in find(spark, [(1, " ".join(src))], [(1, " ".join(src)), (2, " ".join(edited)), (3, " ".join(src[:8]))]).collect()}
    assert got[1].score == 1.0 and got[1].longest_run == 40
    assert got[2].longest_run == 10 and 0.85 < got[2].score < 1
    assert 3 not in got  # eight words are no passage


def test_short_runs_are_aligned_and_scored(spark):
    src = [f"a{i}" for i in range(40)]
    cut = [x for i, x in enumerate(src) if i < 7 or i % 4]  # one run of seven words, else of three
    items, docs = [(1, " ".join(src))], [(2, " ".join(cut)), (3, " ".join(src[:8])), (4, " ".join(src[:3]))]
    assert {r.doc_id for r in find(spark, items, docs).collect()} == {2}
    got = {r.doc_id: r for r in find(spark, items, docs, least_words=0).collect()}
    assert set(got) == {2, 3} and got[2].longest_run == 8 and got[2].score > 0.6
    assert got[3].score == 0.2 and got[3].matched == 8


def edited(words, share, r):
    out = []
    for w in words:
        k = r.random()
        out += [w] if k >= share else [f"z{r.randint(0, 99)}"] if k < share / 2 else [] if k < 0.75 * share else [w, "more"]
    return out


def test_recall_of_edited_copies(spark):
    """Of every hundred words 5, 10 or 20 are replaced, dropped or put in; or every fifth is another."""
    r = random.Random(7)
    vocab = [f"v{i}" for i in range(600)]
    items = [(i, [r.choice(vocab) for _ in range(r.choice([26, 40, 60, 85]))]) for i in range(60)]
    docs, owner = [], {}
    for i, w in items:
        for share in (0.05, 0.1, 0.2, "every fifth"):
            copy = [f"z{k}" if k % 5 == 4 else x for k, x in enumerate(w)] if share == "every fifth" else edited(w, share, r)
            owner[len(docs)] = (i, share)
            docs.append((len(docs), " ".join([r.choice(vocab) for _ in range(30)] + copy + [r.choice(vocab) for _ in range(30)])))
    got = {(x.doc_id, x.item_id) for x in find(spark, [(i, " ".join(w)) for i, w in items], docs).where("score >= 0.3").collect()}
    for share in (0.05, 0.1, 0.2, "every fifth"):
        mine = [(d, i) for d, (i, s) in owner.items() if s == share]
        assert sum(x in got for x in mine) >= 0.95 * len(mine)
    assert len(got) <= 1.05 * len(docs)  # and hardly anything else


def test_smith_waterman_of_a_long_item():
    a = np.arange(1, 2001)
    assert C.smith_waterman(a, np.concatenate([a[:900], [0], a[901:]])) == 2 * 1999 - 1


def test_smith_waterman_against_the_plain_recurrence():
    r = np.random.default_rng(4)
    for _ in range(60):
        a, b = r.integers(0, 5, r.integers(1, 14)), r.integers(0, 5, r.integers(1, 14))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s = 2.0 if a[i - 1] == b[j - 1] and a[i - 1] else -1.0
                h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert C.smith_waterman(a, b) == h.max()


def test_empty(spark):
    assert find(spark, [(1, "a")], []).count() == 0
    d, i = frames(spark, [(1, "a b")], [(1, "a b")])
    assert C.align(d, F.col("doc_id"), F.col("text"), i.limit(0), F.col("item_id"), F.col("text")).count() == 0


def test_very_long_document(spark):
    item = " ".join(f"q{i}" for i in range(30))
    doc = "filler q1 q2 q3 q4 q5 " * 30_000 + item + " filler" * 30_000
    assert {tuple(r) for r in C.leaks(find(spark, [(7, item)], [(1, doc)])).collect()} == {(7, 1)}
