from pyspark.sql import functions as F

from ledgerloom import runtime
from ledgerloom.functions.ids import uuid_key, uuid_text


def test_small_scans_are_spread_and_others_left(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(1000).coalesce(1).write.parquet(path)
    scan = spark.read.parquet(path)
    wide = runtime.spread(scan, "id")
    assert wide.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and wide.count() == 1000
    shuffled = scan.groupBy("id").count()
    assert runtime.spread(shuffled, "id") is shuffled
    many = spark.range(0, 100, 1, 9)
    assert runtime.spread(many, "id") is many


def test_staged_tables_keep_rows_and_types(spark):
    df = spark.createDataFrame([(1, bytearray(b"x"), [None, "a"]), (None, None, None)], "a long, b binary, c array<string>")
    s = runtime.stage(df, "t")
    assert s.schema == df.schema and s.count() == 2
    assert runtime.stage(df.limit(0), "t").count() == 0


def test_uuid_keys(spark):
    u = "f511cb80-0baf-4d7b-a734-1327aca02560"
    rows = [(u,), (u.upper(),), ("{" + u + "}",), ("urn:uuid:" + u,), (" " + u.replace("-", "") + "\n",), ("not one",), (" not one ",), ("",), ("  ",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(uuid_key(F.col("t")).alias("k")).select("k", uuid_text(F.col("k")).alias("t")).collect()
    assert [r.t for r in got] == [u] * 5 + ["not one"] * 2 + [None] * 3
    assert len({bytes(r.k) for r in got if r.k}) == 2
