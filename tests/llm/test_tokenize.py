import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import tokenize as K


@pytest.fixture(scope="module")
def tok():
    return K.tokenizer()


@pytest.fixture(scope="module")
def other():
    """The same vocabulary in another library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


_piece = st.sampled_from(["a", "'ll", "'", "l", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "!", "...", "\u00a0", "\u3000", "<|endoftext|>", "x" * 40, "🚧", "e\u0301"])


@settings(max_examples=400, deadline=None)
@given(st.lists(_piece, max_size=60).map("".join), st.integers(1, 17))
def test_the_tree_gives_the_ids_of_the_whole(text, leaf):
    t = K.tokenizer()
    assert t.encode(text, leaf).tolist() == t.leaf(text).tolist()
    assert t.decode(t.encode(text, leaf).tolist()) == text


def test_against_another_library(tok, other, spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.text]
    for s in [*texts, "<|endoftext|> 's 'S don't", "\r\n \r\n", "a" * 5000]:
        assert tok.encode(s, 64).tolist() == other(s)


def test_very_long_texts(tok):
    r = random.Random(5)
    for s in ("x" * 200_000, " " * 100_000, "word " * 60_000, "".join(r.choice("ab \n'é1.") for _ in range(150_000))):
        assert tok.encode(s).tolist() == tok.leaf(s).tolist()


def test_column_and_round_trip(spark):
    rows = [(1, "hello world", "k"), (2, "", "k"), (3, None, "k"), (4, "<|endoftext|>", "k"), (5, "é" * 3, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = K.encode_column(df, F.col("doc_id"), F.col("text"))
    ids = {r.k: r.ids for r in got.collect()}
    assert ids[1] == [31373, 995] and ids[2] == [] and ids[3] == [] and 50256 not in ids[4]
    back = {r.k: r.text for r in K.decode_column(got, F.col("k"), F.col("ids")).collect()}
    assert back == {1: "hello world", 2: "", 3: "", 4: "<|endoftext|>", 5: "ééé"}
    assert K.encode_column(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0
