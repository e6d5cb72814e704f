"""Scalar rules, the extraction pipeline on known inputs, and its independence of layout."""

import hashlib
import json

import pytest

from ledgerloom.functions import canon, text
from ledgerloom.functions.paths import Roots, Unrepresentable, resolve
from ledgerloom.operators import extract as X
from ledgerloom.operators import mapper as M
from ledgerloom.operators import pack as P
from ledgerloom.plans import vectors
from ledgerloom.sources.definition import Registry, load_directory, usage_capability, validate
from ledgerloom.sources.lines import line_counts, read_lines, split_lines

R = Roots("/workspace/repo/work", "/workspace/repo")


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("src/a.ts", ("work/src/a.ts", "repo")),
        ("/workspace/repo/x/../y.ts", ("y.ts", "repo")),
        ("../z", ("z", "repo")),
        ("/outside/private/report.md", ("88148e1718a9:report.md", "external")),
        ("https://Host.example/a?q#f", ("https:/a?q#f", "uri")),
        ("SSH://h/p", ("ssh:/p", "uri")),
        ("file:///workspace/repo/k", ("k", "repo")),
        ("file:///C:/other/k", (hashlib.sha256(b"file:///C:/other").hexdigest()[:12] + ":k", "external")),
        ("C:\\x\\y.txt", (hashlib.sha256(b"C:\\x").hexdigest()[:12] + ":y.txt", "external")),
    ],
)
def test_path_keys(path, want):
    assert R.key_of(path) == want


def test_path_edges():
    for bad in ("/workspace/repo", ".", "..", "file:"):
        with pytest.raises(Unrepresentable):
            Roots("/workspace/repo").key_of(bad) if bad != ".." else R.key_of(bad)
    assert resolve("/a/./b/../../..") == "/" and resolve("a/../../b") == "../b" and resolve("C:\\a\\..") == "C:"
    granted = Roots("/w", None, [("/data", "granted"), ("/w", "granted")])
    assert granted.key_of("/data/f") == ("f", "granted") and granted.key_of("f") == ("f", "cwd")


def test_text_rules():
    assert text.without_paths("see /workspace/repo/a.ts, and 'b c'", R) == "see a.ts, and 'b c'"
    assert text.without_paths("open '/workspace/repo/a b.ts' now", R) == "open 'a b.ts' now"
    assert text.without_paths("src/a.ts is relative", R) == "src/a.ts is relative"
    assert text.without_paths("host:/etc/x", R) is None
    assert text.without_paths("user@host:/workspace/repo/f", R) == "f"
    assert text.without_paths("ENOENT:/workspace/repo/f", R) == "f"
    assert text.without_paths("cd /workspace/repo", R) is None
    assert text.command_key(" npm \t test \x1b[31mred\x1b[0m ", R) == "npm test red"
    assert text.command_key("   ", R) is None
    long = text.command_key("word " * 300, R)
    assert long.endswith("word…") and len(long) <= 512
    assert text.error_signature("ENOENT: no such file '/x/y' line 12:34 0xdeadbeef99", R).startswith("not_found:ENOENT: no such file \"…\" line N:N <hex>")
    assert text.error_signature("unknown", R) == "unknown:unknown"
    assert text.first_sentence("We must  go.\nThen 1.5 stays") == "We must go."
    assert text.decision("We MUST do it", R, ["we will", "must"]) == ("We MUST do it", "must")
    assert text.decision("mustard", R, ["must"]) == ("mustard", "must")
    assert text.error_class("  Access denied!") == "permission"


def test_canonical():
    assert canon.canonical({"b": [1, True, None], "a": "é"}) == '{"a":"é","b":[1,true,null]}'
    for bad in ({"a": 1.5}, {"\u00e9": 1, "e\u0301": 2}):
        with pytest.raises(TypeError):
            canon.canonical(bad)


def test_split_lines():
    assert split_lines(b"a\r\nb\n\nc") == [b"a\r\n", b"b\n", b"\n", b"c"]
    assert split_lines(b"") == [] and split_lines(b"\x0b\n") == [b"\x0b\n"]


@pytest.mark.parametrize(("parts", "flip"), [(1, False), (8, True)])
def test_known_hashes_for_any_layout(spark, parts, flip):
    got = {r.session: r.hash for r in vectors.payloads(spark, parts, flip).collect()}
    assert got == {n: h for n, (_, h) in vectors.VECTORS.items()}


def test_session_without_events(spark):
    config = spark.createDataFrame([("a", "/w", None, "cwd", []), ("b", "/w", None, "cwd", [])], X.CONFIG)
    lines = spark.createDataFrame([], "session string, line long, sha256 string")
    none = spark.createDataFrame([], "session string, entry long")
    rows = X.Extraction(none, config).payloads(lines, degraded=[]).collect()
    assert len(rows) == 2 and all("Status: degraded: extraction-empty" in r.pack for r in rows)


RECORDS = [
    {"type": "user", "sessionId": "s", "cwd": "/w", "timestamp": "t0", "message": {"content": "We must keep it. Really."}},
    {"type": "assistant", "timestamp": "t1", "message": {"content": [{"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "make"}}, {"type": "tool_use", "id": "c2", "name": "Read", "input": {"file_path": "a.py"}}, {"type": "tool_use", "id": "c2", "name": "Read", "input": {"file_path": "b.py"}}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "is_error": True, "content": "timeout\nafter 30"}, {"type": "tool_result", "tool_use_id": "nobody", "content": "x"}]}},
    {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "c3", "name": "Bash", "input": {"command": " make "}}, {"type": "tool_use", "id": "c4", "name": "Odd", "input": {}}, {"type": "tool_use", "id": "c5", "name": "TaskCreate", "input": {"subject": "do it"}}]}},
    {"type": "user", "toolUseResult": {"task": {"id": "7"}}, "message": {"content": [{"type": "tool_result", "tool_use_id": "c3"}, {"type": "tool_result", "tool_use_id": "c5", "content": "ok"}]}},
    {"type": "user", "isCompactSummary": True, "message": {"content": "We must not become a fact."}},
    {"type": "system", "subtype": "compact_boundary"},
    {"type": "brand-new"},
    {"type": "mode"},
]


def test_from_files_to_facts(spark, tmp_path):
    raw = "".join(json.dumps(r) + "\n" for r in RECORDS).encode() + b"\xff\n{oops\n[1]"
    (tmp_path / "s.jsonl").write_bytes(raw)
    lines = read_lines(spark, str(tmp_path))
    assert line_counts(lines).first().lines == len(RECORDS) + 3
    m = M.Mapped(M.parts_of_lines(lines))
    diag = {(r.line, r.code, r.detail) for r in m.diagnostics().collect()}
    assert diag == {
        (2, "tool-input-shape", "duplicate-call-id"),
        (2, "tool-call-without-result", "Read"),
        (3, "tool-result-without-call", "result"),
        (5, "tool-result-not-text", "content"),
        (4, "tool-call-without-result", "Odd"),
        (7, "conversational-content-not-text", "system"),
        (8, "unknown-record-type", "brand-new"),
        (10, "invalid-utf8", "utf8"),
        (11, "malformed-json", "json"),
        (12, "unknown-record-type", "<other>"),
    }
    assert m.identity().select("session_id", "cwd").first()[:] == ("s", "/w")
    assert [(r.tool, r.calls) for r in m.histogram().collect()] == [("Odd", 1)]
    cfg = m.identity().selectExpr("session", "cwd", "cast(null as string) repo_root", "'cwd' path_base", "cast(array() as array<struct<root:string,scope:string>>) roots")
    x = X.Extraction(m.events(), cfg)
    facts = {(r.kind, r.key): r for r in x.facts.collect()}
    assert set(facts) == {
        ("decision.stated", "We must keep it."),
        ("cmd.failed", "make"),
        ("cmd.run", "make"),
        ("error.raised", "timeout:timeout after N"),
        ("error.fixed", "timeout:timeout after N"),
        ("todo.state", "item:7"),
    }
    assert facts["error.fixed", "timeout:timeout after N"].lines == [4, 5]
    n = x.counters.first()
    assert (n.source_tool_calls, n.unmapped_tool_calls, n.coverage_ppm, n.source_entries) == (5, 1, 800000, 7)
    p = x.payloads(lines, max_bytes=420, degraded=[]).first()
    assert len(p.pack.encode()) <= 420 and "elided" in p.pack and canon.digest(p.payload) == p.hash


def fact(kind, key, entry, snippet="s"):
    return {"kind": kind, "key": key, "at": {"entry": entry, "ts": None}, "attrs": {"runs": 1}, "evidence": [{"line": 3, "sha256": "h"}], "snippet": snippet, "unbacked": False}


def test_pack_fills_behind_a_large_fact():
    n = dict.fromkeys(("facts", "external_path_count", "unmapped_tool_calls", "coverage_ppm", "source_entries", "source_tool_calls"), 3)
    facts = sorted([fact("cmd.run", "big", 9, "x" * 900), fact("cmd.run", "a", 1), fact("file.read", "b_c", 0)], key=P.display_key)
    h = "sha256:" + "a" * 64
    full = P.pack(facts, h, n, 10_000)
    assert "elided" not in full and "`b\\_c`" in full and full.count("\n\n") == 1
    small = P.pack(facts, h, n, 500)
    assert "big" not in small and "`a`" in small and "elided 1 fact to fit 500" in small and len(small.encode()) <= 500
    for size in range(150, 700, 7):
        try:
            assert len(P.pack(facts, h, n, size).encode()) <= size
        except ValueError:
            assert size < 260
    assert "line 3" in P.pack(facts, h, n, 10_000, evidence=True)
    assert P.status(["ok"]) == "ok" and P.status(["unavailable:store", "schema-drift"]) == "degraded: schema-drift, unavailable:store"


def definition(**kw):
    said = "docs:https://example.org/x"
    return {
        "schema_version": 1, "adapter": "generic", "display_name": "One", "last_verified_version": "1", "verified_at": "2026-01-01", "evidence": {"tools": said},
        "config_paths": {"user_settings": "~/a", "project_settings": ["b"], "config_dir_env": None, "transcript_directory": "~/c"}, "version_probe": {"command": "one", "args": []},
        "hooks": [{"event": "Start", "matcher": None, "output": None, "evidence": said}], "event_map": [{"hook": "Start", "match": ["x"], "action": "restore", "injects": True, "registered": False, "evidence": said}],
        "transcript": {"format": "jsonl", "records": {"conversational": ["session", "note", "tool_call", "tool_result"], "non_conversational": ["b"]}},
        "tools": {"exact": {"Write": "file.modified", "Bash": "command", "Read": "file.read"}, "prefixes": [{"prefix": "p_", "kind": "ignored"}]}, "decision_cues": ["we must"],
        "fixtures": [{"path": "x.jsonl", "sha256": "sha256:" + "0" * 64, "shape": ["record:a"]}],
    } | kw


def test_definitions(tmp_path):
    assert validate(definition()) == []
    bad = definition(adapter=["generic"], tools={"exact": {"T\x00": ["x"]}, "prefixes": [3]}, fixtures=[], hooks=[{"event": 1, "evidence": "hearsay"}], context_watermark={"supported": "yes", "evidence": "docs:x"})
    assert [p.partition(":")[0] for p in validate(bad)] == ["adapter", "hooks[0].event", "hooks[0].evidence", "tools.exact.T", "tools.prefixes[0]", "fixtures", "context_watermark.supported"]
    assert validate([]) == ["root: expected an object"] and len(validate({})) == 14
    (tmp_path / "a.json").write_text(json.dumps(definition()))
    (tmp_path / "b.json").write_text(json.dumps(definition()))
    (tmp_path / "c.json").write_text("{")
    (tmp_path / "d.json").write_text(json.dumps(bad))
    found, failed = load_directory(str(tmp_path))
    assert list(found) == ["generic"] and [n for n, _ in failed] == ["b.json", "c.json", "d.json"]
    assert found["generic"].shapes() == ["record:b", "record:note", "record:session", "record:tool_call", "record:tool_result"]
    r = Registry(str(tmp_path))
    assert r.get("generic") and r.get("codex") is None and r.degraded() == ["schema-drift"] and Registry(str(tmp_path / "none")).degraded() == ["schema-drift"]
    assert not usage_capability("generic", r.get("generic"))["supported"] and usage_capability("codex", None)["evidence"] is None


FLAT = [
    {"type": "session", "id": "s", "cwd": "/w/repo"}, {"type": "note", "text": "We must keep it small."}, {"type": "tool_call", "id": "1", "name": "Write", "path": "a/b.md"}, {"type": "tool_result", "for": "1", "ok": True},
    {"type": "tool_call", "id": "2", "name": "Bash", "command": "make"}, {"type": "tool_result", "for": "2", "ok": False, "error": "ENOENT here"}, {"type": "tool_call", "id": "3", "name": "Read", "path": "/w/repo"}, {"type": "tool_result", "for": "3", "ok": True},
]


def test_another_adapter_through_the_same_engine(spark, tmp_path):
    from ledgerloom.operators import adapter
    from ledgerloom.sources.definition import parse

    d, problems = parse(definition())
    assert not problems
    (tmp_path / "good.jsonl").write_text("\n".join(map(json.dumps, FLAT)))
    (tmp_path / "lost.jsonl").write_text("\n".join(map(json.dumps, FLAT[1:4])))
    (tmp_path / "odd.jsonl").write_text("\n".join(map(json.dumps, [*FLAT[:1], {"type": "brand_new"}])) + "\n\n")
    lines = read_lines(spark, str(tmp_path))
    r = adapter.run(lines, d, M.MAPPERS["flat"])
    name = lambda s: s.rpartition("/")[2]
    assert {name(x.session): x.degraded for x in r.health.collect()} == {"good.jsonl": ["schema-drift"], "odd.jsonl": ["extraction-empty", "schema-drift"]}
    assert [(name(x.session), x.reason) for x in r.refused.collect()] == [("lost.jsonl", "missing-session-cwd")]
    assert {(name(x.session), x.token) for x in r.drift.collect()} == {("odd.jsonl", "record:brand_new")}
    assert [(name(x.session), x.line, x.detail) for x in r.diagnostics.where("detail = 'file-path'").collect()] == [("good.jsonl", 7, "file-path")]
    kinds = sorted(x.kind for x in r.extraction.facts.collect() if name(x.session) == "good.jsonl")
    assert kinds == ["cmd.failed", "decision.stated", "error.raised", "file.modified"]
    shown = {name(x.session): x.pack for x in adapter.preview(r, lines, 4096, max_facts=1).collect()}
    assert "elided 3 facts" in shown["good.jsonl"] and "line 2" in shown["good.jsonl"]
