"""Payload bytes, their hash, and the budgeted pack, in one ordered pass over a session's facts.

A session's merged facts are as many as its distinct keys, not its events; they arrive sorted
and one session at a time is held.  Adding a fact costs its line and, where its section is not the one
of the fact selected before, a heading; a fact that does not fit is passed over and later ones
may still fit.
"""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions.canon import canonical, digest

_MARKS = re.compile(r"[\\`*_\[\]#|]")


def plain(v: str) -> str:
    s = "".join("\ufffd" if ord(c) < 32 or 127 <= ord(c) <= 159 or c in "\u2028\u2029" else c for c in unicodedata.normalize("NFC", v))
    return re.sub(r"[\t ]+", " ", s).strip()


def escaped(v: str) -> str:
    return _MARKS.sub(lambda m: "\\" + m[0], plain(v))


def shown(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, list):
        return ", ".join(map(shown, v))
    return escaped(v) if isinstance(v, str) else str(v)


def fact_line(f: dict, evidence: bool = False) -> str:
    attrs = " ".join(f"{escaped(k)}={shown(f['attrs'][k])}" for k in sorted(f["attrs"]))
    cited = ", ".join(f"line {e['line']}" for e in f["evidence"]) if evidence else ""
    tail = " — ".join(x for x in (attrs, escaped(f["snippet"]), cited, "unbacked" if f["unbacked"] else "") if x)
    return f"- **{escaped(f['kind'])}** `{escaped(f['key'])}`" + (f": {tail}" if tail else "")


def status(degraded) -> str:
    family = lambda s: s if s.startswith(("unavailable:", "untrusted:")) else f"degraded: {s}"
    return ", ".join(sorted({family(s) for s in degraded if s != "ok"})) or "ok"


def header(payload_hash: str, counters: dict, degraded, brand: str) -> list[str]:
    n = counters
    return [
        f"## {brand} context [{brand}:{payload_hash[7:19]}]",
        *([] if degraded is None else [f"Status: {status(degraded)}"]),
        f"Facts: {n['facts']} | external: {n['external_path_count']} | unmapped: {n['unmapped_tool_calls']} | coverage: {n['coverage_ppm']} ppm",
        f"Source entries: {n['source_entries']} | tool calls: {n['source_tool_calls']}",
    ]


def notice(n: int, size: int, brand: str) -> str:
    return f"> [{brand}] elided {n} fact{'' if n == 1 else 's'} to fit {size} UTF-8 bytes."


def _octets(s: str) -> int:
    return len(s.encode())


def least_bytes(head: list[str], total: int, brand: str) -> int:
    """The smallest budget a pack of ``total`` facts can be rendered in."""
    base = sum(_octets(x) + 1 for x in head)
    size = base
    while total and (need := base + _octets(notice(total, size, brand)) + 1) > size:
        size = need
    return size


def pack(facts, payload_hash: str, counters: dict, max_bytes: int, degraded=None, brand: str = "ledgerloom", max_facts: int | None = None, evidence: bool = False) -> str:
    """The pack of facts in display order (an iterable of fact dictionaries)."""
    facts = list(facts)
    head = header(payload_hash, counters, degraded, brand)
    if least_bytes(head, len(facts), brand) > max_bytes and (not facts or sum(_octets(x) + 1 for x in head) + _octets(notice(len(facts), max_bytes, brand)) + 1 > max_bytes):
        raise ValueError("the budget cannot hold the header and the notice")
    size = sum(_octets(x) + 1 for x in head)
    body: list[str] = []
    section, taken = None, 0
    for f in facts[: max_facts if max_facts is not None else len(facts)]:
        line, p = fact_line(f, evidence), fixed.PRIORITY[f["kind"]]
        title = f"### {fixed.TITLES.get(p, 'Facts')}"
        add = _octets(line) + 1 + (_octets(title) + 1 + (1 if section is not None else 0) if p != section else 0)
        left = len(facts) - taken - 1
        # a section ends with a blank line, which stays only before the notice
        if size + add + (1 + _octets(notice(left, max_bytes, brand)) + 1 if left else 0) <= max_bytes:
            if p != section:
                body += ([""] if section is not None else []) + [title]
            body.append(line)
            size += add
            section, taken = p, taken + 1
    if not taken and facts and (max_facts is None or max_facts > 0) and "budget-exceeded" not in (degraded or []):
        worse = [*(degraded or []), "budget-exceeded"]
        if least_bytes(header(payload_hash, counters, worse, brand), len(facts), brand) <= max_bytes:
            return pack(facts, payload_hash, counters, max_bytes, worse, brand, max_facts, evidence)
    out = head + body
    if taken < len(facts):
        out += ([""] if body else []) + [notice(len(facts) - taken, max_bytes, brand)]
    return "\n".join(out) + "\n"


def display_key(f: dict):
    return fixed.PRIORITY[f["kind"]], -f["at"]["entry"], f["key"], f["kind"], f["snippet"]


_COUNTERS = ("facts", "external_path_count", "source_entries", "source_tool_calls", "unmapped_tool_calls", "coverage_ppm")


def fact_rows(x, lines: DataFrame) -> DataFrame:
    """Merged facts with the hashes of their evidence lines and their canonical place."""
    from ledgerloom.operators.extract import ATTRS, priority

    named = x.facts.withColumn("rank", priority(F.col("kind")))
    # the lines of at most five places a fact, not the transcript, meet the hashes
    cited = named.select("session", "kind", "key", F.explode("lines").alias("line")).join(lines.select("session", "line", "sha256"), ["session", "line"])
    ev = cited.groupBy("session", "kind", "key").agg(F.array_sort(F.collect_list(F.struct("line", "sha256"))).alias("evidence"))
    return named.join(ev, ["session", "kind", "key"], "left").select("session", "rank", "kind", "key", "scope", "entry", "ts", "snippet", "unbacked", "evidence", *ATTRS)


def render(x, lines: DataFrame, max_bytes: int, degraded, brand: str, max_facts, evidence: bool) -> DataFrame:
    from ledgerloom.operators.extract import ATTRS

    facts = fact_rows(x, lines)
    cols = facts.columns[1:]
    # one leading row a session brings its counters and state, its facts follow in order
    zero = x.config.join(x.counters, "session", "left").join(x.states(), "session", "left")
    lead = zero.select("session", F.lit(-1).alias("rank"), F.to_json(F.struct("path_base", "by_kind", *_COUNTERS), {"ignoreNullFields": "false"}).alias("lead"), "git", "plan")
    body = facts.select("session", "rank", *[c for c in cols if c != "rank"])
    both = lead.unionByName(body, allowMissingColumns=True).select("session", "rank", "lead", "git", "plan", *[c for c in cols if c != "rank"])
    ready = both.repartition("session").sortWithinPartitions("session", "rank", "kind", "key", "entry")

    def fact(r: dict) -> dict:
        f = {"kind": r["kind"], "key": r["key"], "at": {"entry": r["entry"], "ts": r["ts"]}, "attrs": {a: r[a] for a in ATTRS if r[a] is not None}}
        f |= {"evidence": r["evidence"] or [], "snippet": r["snippet"], "unbacked": r["unbacked"]}
        return f | ({"scope": r["scope"]} if r["scope"] is not None else {})

    def run(batches):
        import pyarrow as pa

        def close(session, lead, git, plan, facts):
            n = json.loads(lead)
            counts = {k: n[k] or 0 for k in _COUNTERS} | {"by_kind": n["by_kind"] or {}}
            g = json.loads(git) if git else None
            if g:
                g = {k: g[k] for k in ("head", "branch", "dirty", "status_hash")} | {"diff_stat": {k: g[k] for k in ("files", "added", "removed")}}
            p = {"facts": facts, "counters": counts, "git": g, "plan": json.loads(plan) if plan else None, "path_base": n["path_base"], "version": 1}
            text = canonical(p)
            h = digest(text)
            empty = [] if counts["source_entries"] else ["extraction-empty"]
            health = None if degraded is None else [*degraded, *empty]
            try:
                shown_pack = pack(sorted(facts, key=display_key), h, counts, max_bytes, health, brand, max_facts, evidence)
            except ValueError:
                shown_pack = None
            return session, h, len(text.encode()), text, shown_pack

        def out(rows):
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["session", "hash", "payload_bytes", "payload", "pack"])

        cur, facts, done = None, [], []
        for b in batches:
            for r in b.to_pylist():
                if r["rank"] == -1:
                    if cur:
                        done.append(close(*cur, facts))
                        if len(done) >= 500:
                            yield out(done)
                            done = []
                    cur, facts = (r["session"], r["lead"], r["git"], r["plan"]), []
                elif cur and r["session"] == cur[0]:
                    facts.append(fact(r))
        if cur:
            done.append(close(*cur, facts))
        if done:
            yield out(done)

    return ready.mapInArrow(run, "session string, hash string, payload_bytes long, payload string, pack string")
