"""Every registered query against its SQL on the smallest tables, and on empty ones."""

import collections
import glob
import os

import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(None if r[i] is None else str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = rows(df.columns, df.collect())
    r = duck.execute(SQL[name])
    want = rows([c[0] for c in r.description], r.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in r.description)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


@pytest.fixture(scope="module")
def empty(spark, small, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for f in glob.glob(f"{small}/*.parquet"):
        spark.read.parquet(f).limit(0).write.parquet(str(out / os.path.basename(f)))
    return str(out)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.endswith("_found") or n in ("p8_ids", "q24_payloads", "q10_retention_plan", "q12_chain")))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["session", "hash", "payload_bytes"]
