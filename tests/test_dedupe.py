import json
import uuid

import pytest

from ledgerloom.operators import dedupe as D

SCHEMA = "rec_id long, received_at timestamp, uuid string, requestId string, message struct<id:string,content:string>, node string, cls int, wide string"
A, B, C = (str(uuid.UUID(int=i)) for i in (1, 2, 3))


def rows(*xs):
    import datetime

    t = datetime.datetime(2026, 1, 1)
    return [(i, t, u, r, (m, c) if m or c else None, "n", 1, f"w{i}") for i, (u, r, m, c) in enumerate(xs)]


CASES = rows(
    (A, "r", "m", '{"a":1,"b":[2]}'),  # 0
    (A.upper(), None, None, None),  # 1 same uuid
    (None, "r", "m", '{ "b": [2], "a": 1.0 }'),  # 2 equal content as JSON
    (B, "r", "m", '{"a":1,"b":[2]}'),  # 3 another uuid, joined through 2
    (C, "r", "m", '{"a":2}'),  # 4 another block of the message
    (None, "r", None, '{"a":1}'),  # 5 no identity
    (None, "r", None, '{"a":1}'),  # 6 no identity either
    (None, "q", "k", None),  # 7
    (None, "q", "k", "null"),  # 8 null content is JSON null
    (None, "q", "z", "not json"),  # 9
    (None, "q", "z", "not json"),  # 10
)


def test_pairs(spark):
    got = {tuple(r) for r in D.copy_pairs(spark.createDataFrame(CASES, SCHEMA)).collect()}
    want = {(a, b) for g in ((0, 1, 2, 3), (7, 8), (9, 10)) for a in g for b in g if a < b}
    assert got == want


def test_two_uuids_alone_are_no_copies(spark):
    got = D.copy_pairs(spark.createDataFrame(rows((A, "r", "m", "{}"), (B, "r", "m", "{}")), SCHEMA)).collect()
    assert got == []


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_one_copy_stays(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(CASES, SCHEMA).repartition(3).write.parquet(path)
    kept = D.deduplicate(spark, path, ["received_at", "rec_id"])
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.rec_id for r in kept.collect()) == [0, 4, 5, 6, 7, 9]


def test_hot_class(spark, tmp_path):
    xs = rows(*[(A, None, None, None)] * 400, *[(str(uuid.UUID(int=i + 9)), None, None, None) for i in range(300)])
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(xs, SCHEMA).write.parquet(path)
    assert D.deduplicate(spark, path, ["rec_id"]).count() == 301
    assert D.copy_pairs(spark.read.parquet(path)).count() == 400 * 399 // 2


def test_columns_with_clashing_names(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    df = spark.createDataFrame(CASES, SCHEMA)
    for c in ("_file", "_row", "_bits", "__keepf", "file", "bucket", "ukey", "tkey", "component", "w"):
        df = df.selectExpr("*", f"'x' AS `{c}`")
    df.write.parquet(path)
    kept = D.deduplicate(spark, path, ["node", "cls", "rec_id"])
    assert kept.columns == df.columns and sorted(r.rec_id for r in kept.collect()) == [0, 4, 5, 6, 7, 9]
    assert D.copy_pairs(spark.read.parquet(path)).count() == 8


def test_empty(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert D.deduplicate(spark, path, ["rec_id"]).count() == 0
    assert D.copy_pairs(spark.read.parquet(path)).count() == 0


def test_json_value(spark):
    same = [('{"a":1,"b":2}', '{"b": 2.0, "a": 1}'), ('"\\u0041"', '"A"'), ("[1, 2]", "[1,2]")]
    differ = [('{"a":1}', '{"a":"1"}'), ("[1,2]", "[2,1]"), ("1", "true")]
    df = spark.createDataFrame(same + differ, "a string, b string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(D.json_value(F.col("a")) == D.json_value(F.col("b"))).collect()]
    assert got == [True] * 3 + [False] * 3 and json.loads("[1]") == [1]
