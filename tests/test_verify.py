import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.canon import canonical, digest
from ledgerloom.operators import verify as V
from ledgerloom.sources import files


def payload(**kw):
    f = {"kind": "file.read", "key": "a", "scope": "external", "at": {"entry": 0, "ts": None}, "attrs": {"reads": 1}, "evidence": [{"line": 1, "sha256": "sha256:" + "a" * 64}], "snippet": "", "unbacked": False}
    n = {"facts": 1, "by_kind": {"file.read": 1}, "external_path_count": 1, "coverage_ppm": 5, "source_entries": 1, "source_tool_calls": 1, "unmapped_tool_calls": 0}
    return {"facts": [f | kw.pop("fact", {})], "counters": n, "git": None, "plan": None, "path_base": "cwd", "version": 1} | kw


def test_payload_faults(spark):
    good = payload()
    cases = [
        (good, None), (payload(version=2), "version"), (payload(extra=1), "fields"), (payload(fact={"kind": "x"}), "kind"), (payload(fact={"scope": "x"}), "scope"), (payload(fact={"attrs": {}}), "attrs"),
        (payload(fact={"at": {"entry": -1}}), "entry"), (payload(fact={"scope": "cwd"}), "counters"), (payload(fact={"evidence": [{"line": 0, "sha256": "x"}]}), "evidence"),
    ]
    rows = [(i, json.dumps(p), digest(canonical(p))) for i, (p, _) in enumerate(cases)] + [(90, json.dumps(good), "sha256:" + "0" * 64), (91, "{", None)]
    got = {r.i: r.reason for r in V.payload_faults(spark.createDataFrame(rows, "i int, payload string, hash string")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)} | {90: "hash", 91: "json"}


def test_session_is_never_guessed(spark):
    one = spark.createDataFrame([("f", "s")], "session string, session_id string")
    assert V.require_session(one, "s").count() == 1
    for bad in (one.limit(0), one.union(spark.createDataFrame([("g", "t")], one.schema))):
        with pytest.raises(V.Refused):
            V.require_session(bad, "s")


def test_binding_and_fixtures(spark):
    ev = spark.createDataFrame([("s", "f", 1, "h"), ("s", "f", 2, "x"), ("s", "g", 9, "h")], "session string, fact string, line int, sha256 string")
    lines = spark.createDataFrame([("s", 1, "h"), ("s", 2, "g"), ("s", 9, "h")], "session string, line int, sha256 string")
    prefix = spark.createDataFrame([("s", 5)], "session string, lines int")
    assert V.binding(ev, lines, prefix).first()[:] == ("s", 2, 1, 1)
    shapes = V.shape_set(spark.createDataFrame([("s", "record:user"), ("s", "record:odd"), ("s", "record:user")], "session string, token string")).withColumn("sha256", F.lit("h"))
    rec = spark.createDataFrame([("s", "h", ["record:user", "record:odd"]), ("t", "h", [])], "session string, sha256 string, shapes array<string>")
    got = {r.session: (r.hash_ok, r.shapes_ok, r.undeclared) for r in V.fixture_faults(shapes, rec).collect()}
    assert got == {"s": (True, True, ["record:odd"]), "t": (False, False, [])}


def test_reports_and_text(spark):
    d = spark.createDataFrame([("s", i, c, "x") for i, c in enumerate(["b", "a", "zz", "a"])], "session string, line int, code string, detail string")
    assert [(r.code, r.line) for r in V.report(d, ["a", "b"], 3).collect()] == [("a", 1), ("a", 3), ("b", 0)]
    t = spark.createDataFrame([("## x\nStatus: degraded: schema-drift, unavailable:store\nFacts: 1", '{"errors":[{"cause":"Red-Fox"},{"cause":"b"}],"note":"Hi!"}')], "p string, a string")
    r = t.select(V.status_tokens(F.col("p")), V.field_text(F.col("a"), "errors.cause"), V.field_text(F.col("a"), "note")).first()
    assert r[0] == ["schema-drift", "unavailable:store"] and r[1].split(" ")[:2] == ["red", "fox"] and r[2] == "hi"
    p = spark.createDataFrame([("g", 1, "red fox"), ("g", 2, "The red fox ran"), ("g", 3, "red foxes"), ("h", 4, "red fox")], "group string, id int, phrase string")
    assert {tuple(x) for x in V.collisions(p).collect()} == {("g", 1, 2), ("g", 1, 3)}


def test_files_and_patches(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_text("hello")
    (tmp_path / "a" / "y.bin").write_bytes(b"\x00")
    (tmp_path / "a" / ".git" / "z").write_text("no")
    t = files.read_tree(spark, str(tmp_path / "a"))
    assert {(r.path.rpartition("/")[2], r.is_binary) for r in t.collect()} == {("x.txt", False), ("y.bin", True)}
    c = files.checksums(t)
    assert {r.state for r in files.compare_checksums(c, c).collect()} == {"same"}
    patch = "commit 1\n\ndiff --git a/f.py b/f.py\n@@ -1,3 +10,4 @@ def f\n ctx\n-old\n+new\n+two\n\\ No newline\n@@ -50 +60 @@\n+last\ndiff --git a/g b/g\n+not in a hunk\n"
    df = spark.createDataFrame([(1, patch), (2, None), (3, "")], "doc_id int, text string")
    got = [tuple(r) for r in files.added_lines(df, F.col("doc_id"), F.col("text")).collect()]
    assert got == [(1, "f.py", 11, "new"), (1, "f.py", 12, "two"), (1, "f.py", 60, "last")]
