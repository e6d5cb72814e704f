"""Snapshots from writing to pruning, and the smaller rules around them."""

import datetime
import json

from pyspark.sql import functions as F

from ledgerloom.functions.canon import canonical, digest
from ledgerloom.operators import lifecycle as L
from ledgerloom.operators import scan, store, verify
from ledgerloom.sources import hooks
from ledgerloom.streaming import guard

H = lambda c: "sha256:" + c * 64
S = "id string, session_id string, hash string, previous_hash string, created_at string, facts long, pinned boolean, degraded array<string>"


def snap(session, c, prev, at, pinned=False, degraded=("ok",), facts=1):
    return (f"{at}|{H(c)}", session, H(c), H(prev) if prev else None, at, facts, pinned, list(degraded))


def at(day):
    return f"2026-01-{day:02d}T00:00:00Z"


def test_write_pin_prune(spark, tmp_path):
    root = str(tmp_path / "store")
    twin = snap("s", "a", None, at(1))
    other = ("x", "s", "sha256:" + "a" * 12 + "b" * 52, None, at(1), 1, False, ["ok"])
    other = (f"{at(1)}|{other[2]}", *other[1:])
    rows = [twin, twin, snap("s", "b", "a", at(2)), snap("s", "c", "b", at(9)), snap("../s", "d", None, at(1)), snap("t", "e", None, at(8))]
    refused = L.write_snapshots(spark, spark.createDataFrame(rows, S), root).collect()
    assert [(r.session_id, r.reason) for r in refused] == [("../s", "session")]
    again = L.write_snapshots(spark, spark.createDataFrame([twin, other], S), root).collect()
    assert [(r.hash, r.reason) for r in again] == [(other[2], "name-taken")]
    assert L.manifest(spark, root).count() == 4
    L.pin(spark, root, "s", H("a"), True, at(9))
    assert [(r.hash, r.reason) for r in L.prune(spark, root, at(10)).collect()] == [(H("b"), "retention:age")]
    assert L.prune(spark, root, at(10)).count() == 0
    L.pin(spark, root, "s", H("a"), False, at(10))
    assert [r.hash for r in L.prune(spark, root, at(10)).collect()] == [H("a")]
    assert [(r.session_id, r.hash) for r in L.manifest(spark, root).collect()] == [("s", H("c")), ("t", H("e"))]


def test_payloads_are_checked_and_enveloped(spark, tmp_path):
    f = {"kind": "file.read", "key": "a", "scope": "cwd", "at": {"entry": 0, "ts": None}, "attrs": {"reads": 1}, "evidence": [], "snippet": "", "unbacked": False}
    n = {"facts": 1, "by_kind": {"file.read": 1}, "external_path_count": 0, "coverage_ppm": 5, "source_entries": 1, "source_tool_calls": 1, "unmapped_tool_calls": 0}
    text = canonical({"facts": [f], "counters": n, "git": None, "plan": None, "path_base": "cwd", "version": 1})
    p = spark.createDataFrame([("f", digest(text), text), ("g", H("0"), text)], "session string, hash string, payload string")
    who = spark.createDataFrame([("f", "s1", "/w", "2"), ("g", "s2", "/w", None)], "session string, session_id string, cwd string, version string")
    lines = spark.createDataFrame([("f", 1, bytearray(b"abc\n")), ("f", 2, bytearray(b"d"))], "session string, line int, raw binary")
    e = L.envelope(p, who, lines, at(1))
    row = e.where("session_id = 's1'").first()
    assert (row.transcript_lines, row.transcript_bytes, row.facts, row.degraded, row.adapter_version) == (2, 5, 1, ["ok"], "2")
    refused = L.write_snapshots(spark, e, str(tmp_path / "s")).collect()
    assert [(r.session_id, r.reason) for r in refused] == [("s2", "payload-hash")]


def test_restore_and_exit(spark):
    s = spark.createDataFrame([snap("s", "a", None, at(1)), snap("s", "b", "a", at(2), degraded=("schema-drift",)), snap("bad", "a", "b", at(1)), snap("bad", "b", "a", at(2))], S)
    facts = [("s", H("a"), "k", "x", 5, "old", False), ("s", H("b"), "k", "x", 3, "new", False), ("s", H("a"), "k", "y", 1, "z", False), ("bad", H("a"), "k", "x", 1, "q", False)]
    merged, states = L.restore(s, spark.createDataFrame(facts, "session string, hash string, kind string, key string, runs int, text string, unbacked boolean"), ["runs"], ["text"], ["budget-exceeded"])
    assert {(r.session, r.key): (r.runs, r.text, r.unbacked) for r in merged.collect()} == {("s", "x"): (5, "new", False), ("s", "y"): (1, "z", True)}
    assert [r.degraded for r in states.collect()] == [["budget-exceeded", "ok", "provenance-broken", "schema-drift"]]
    got = spark.createDataFrame([(True, ["ok"]), (True, ["ok", "schema-drift"]), (False, ["schema-drift"]), (True, None)], "a boolean, b array<string>").select(L.exit_code(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [0, 4, 3, 0]
    c = spark.createDataFrame([("s", "f", "backed"), ("s", "g", "unbacked"), ("t", "f", "backed")], "session string, fact string, state string")
    assert {r.session: (r.backed, r.unbacked, r.whole) for r in store.provenance_counts(c).collect()} == {"s": (1, 1, False), "t": (1, 0, True)}


def test_locks(spark):
    rows = [(None, None, None), ("h", "never", False), ("other", at(1), False), ("h", at(1), True), ("h", at(1), False), ("h", "2026-01-01T23:59:50Z", False)]
    df = spark.createDataFrame(rows, "host string, started string, alive boolean")
    got = df.select(L.lock_state(F.col("host"), F.col("started"), F.col("alive"), F.lit("h"), F.lit("2026-01-02T00:00:00Z")).alias("x")).collect()
    assert [r.x for r in got] == ["free", "unreadable", "respect", "respect", "stale", "respect"]


def test_hook_text_never_fails(spark):
    rows = [(json.dumps({"session_id": "s", "hook_event_name": "PreCompact", "source": 5}),), ("{broken",), ("[1]",), (None,)]
    df = spark.createDataFrame(rows, "t string").withColumn("r", F.lit(datetime.datetime(2026, 1, 1)))
    got = [(r.session_id, r.hook_event_name, r.source) for r in hooks.parse_hooks(df, F.col("t"), F.col("r")).collect()]
    assert got == [("s", "PreCompact", None)] + [(None, None, None)] * 3
    a = spark.createDataFrame([("deliver", "p"), ("deliver", None), ("suppress", "p")], "a string, p string").select(hooks.answer(F.col("a"), F.col("p")).alias("x")).collect()
    assert json.loads(a[0].x)["hookSpecificOutput"]["additionalContext"] == "p" and [r.x for r in a[1:]] == ["{}", "{}"]


def test_stream_takes_a_hot_session_in_order(spark, tmp_path):
    """More rows of one session in a batch than one Arrow chunk holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        t = spark.range(2000).selectExpr("'s' session_id", "timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, 0, 2000 - id) sampled_at", "if(id < 1000, 900L, 10L) used_tokens", "1000L context_limit_tokens", "if(id < 1000, 2L, 1L) epoch")
        t.coalesce(1).write.parquet(str(tmp_path / "in"))
        q = guard.stream_guardrail(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("hot").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.table("hot").collect()
        assert len(rows) == 1 and rows[0].sampled_at == datetime.datetime(2026, 1, 1, 0, 16, 41)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_identity_and_file_rules(spark):
    rules = scan.identity_rules("joe", "mill.example")
    text = "see /home/joe/x, joe wrote\nmail joe@x\nssh a@mill.example\nmill:/srv and a mill stands\njoes@x"
    df = spark.createDataFrame([(1, text)], "doc_id int, t string")
    got = scan.ordered_findings(scan.findings(df, "doc_id", F.col("t"), rules), "doc_id").collect()
    assert [(r.line, r.rule) for r in got] == [(1, "local-user-name"), (2, "local-user-name"), (3, "local-host-name"), (4, "local-host-label")]
    assert "local-host-label" not in scan.identity_rules("joe", "abc.example") and scan.identity_rules("", "") == {}
    f = spark.createDataFrame([("a", "x /home/joe/ y a.b@c.org"), ("b", None), ("c", "plain")], "path string, t string")
    assert sorted(r.label for r in scan.file_findings(f, "path", F.col("t")).collect()) == ["Linux home path", "email address"]
    places = {r.i: r.place for r in scan.seeded_order(spark.range(20).selectExpr("id i", "'g' g"), "arm", F.col("i"), ["g"]).collect()}
    assert sorted(places.values()) == list(range(1, 21))


def test_answers_and_phrases(spark):
    df = spark.createDataFrame([('{"a":[{"b":"x [y]"},{"b":{"c":1}},5],"d":"He said \\"no\\""}',), ("broken",)], "t string")
    r = df.select(verify.field_text(F.col("t"), "a.b").alias("x"), verify.field_text(F.col("t"), "d").alias("d")).collect()
    assert r[0].x == "x y c 1" and r[0].d == "he said no" and r[1].x == ""
    p = spark.createDataFrame([("g", 1, "red fox"), ("g", 2, "the scared fox runs"), ("g", 3, "fox"), ("h", 4, "fox")], "group string, id int, phrase string")
    assert {(r.id, r.other) for r in verify.collisions(p).collect()} == {(1, 2), (3, 1), (3, 2)}
