"""From records to events: recognise, shred, pair calls with results, report what is odd.

One pass turns each record into flat parts (a call, a result, a statement, a diagnostic);
everything that relates parts to each other is relational: first-wins per id, the equi-join
of calls and results, the anti-joins of both sides, the identity of a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.runtime import ship_package, spread, stage
from ledgerloom.sources.definition import Definition

PARTS = (
    "session string, line long, pos int, what string, ts string, id string, name string, path string, command string, intent string, "
    "subject string, status string, item long, is_error boolean, text string, code string, detail string, sid string, cwd string, version string, recognised boolean"
)
_NAMES = [f.split()[0] for f in PARTS.split(", ")]


def _string(v):
    return v if isinstance(v, str) else None


def _token(v: str) -> str:
    import re

    return v if re.fullmatch(r"[A-Za-z0-9_-]{1,64}", v) else "<other>"


def _item(v) -> int | None:
    import re

    s = str(v) if isinstance(v, int) and not isinstance(v, bool) else _string(v)
    return int(s) if s is not None and re.fullmatch(r"[0-9]{1,15}", s) else None


def _result_text(block: dict) -> str | None:
    c = block.get("content")
    if isinstance(c, str):
        return c
    if not isinstance(c, list):
        return None
    texts = [x.get("text") if isinstance(x, dict) else None for x in c]
    return "\n".join(texts) if all(isinstance(t, str) for t in texts) else None


def shred_record(rec, d: Definition):
    """The parts of one parsed record as dictionaries; ``rec`` may be anything."""
    odd = lambda code, detail: {"what": "odd", "code": code, "detail": detail}
    if not isinstance(rec, dict) or not isinstance(rec.get("type"), str):
        return [odd("unknown-record-type", "<other>")]
    kind, message = rec["type"], rec.get("message")
    who = {k: _string(rec.get(v)) for k, v in (("sid", "sessionId"), ("cwd", "cwd"), ("version", "version"))}
    ts = _string(rec.get("timestamp"))
    is_boundary = kind == "system" and rec.get("subtype") == "compact_boundary"
    is_summary = kind in ("user", "assistant") and rec.get("isCompactSummary") is True
    if is_boundary or is_summary:
        shaped = isinstance(rec.get("compactMetadata"), dict) if is_boundary else isinstance(message, dict) and "content" in message
        part = {"what": "record", "recognised": False}
        return [part | who] if shaped else [part, odd("conversational-content-not-text", kind)]
    if kind in d.non_conversational:
        return []
    if kind not in d.conversational:
        return [odd("unknown-record-type", _token(kind))]
    if not isinstance(message, dict):
        return [{"what": "record", "recognised": False} | who, odd("conversational-content-not-text", kind)]
    content, user = message.get("content"), kind == "user"
    out: list[dict] = []
    known = 0
    if isinstance(content, str):
        if user and content.strip():
            out.append({"what": "statement", "ts": ts, "text": content})
    for b in content if isinstance(content, list) else ():
        t = _string(b.get("type")) if isinstance(b, dict) else None
        if not isinstance(b, dict):
            out.append(odd("unknown-content-block", "<other>"))
        elif t == "tool_use":
            cid, name = _string(b.get("id")), _string(b.get("name"))
            if cid is None or name is None:
                out.append(odd("tool-input-shape", "tool_use"))
                continue
            known += 1
            i = b.get("input") if isinstance(b.get("input"), dict) else {}
            out.append(
                {"what": "call", "ts": ts, "id": cid, "name": name, "path": _string(i.get("file_path")), "command": _string(i.get("command")), "intent": _string(i.get("description"))}
                | {"subject": _string(i.get("subject")), "status": _string(i.get("status")), "item": _item(i.get("taskId"))}
            )
        elif t == "tool_result":
            rid = _string(b.get("tool_use_id"))
            if rid is None:
                out.append(odd("unknown-content-block", "tool_result"))
                continue
            known += 1
            text = _result_text(b)
            if text is None:
                out.append(odd("tool-result-not-text", "content"))
            extra = rec.get("toolUseResult")
            task = extra.get("task") if isinstance(extra, dict) else None
            out.append({"what": "result", "id": rid, "is_error": b.get("is_error") is True, "text": text or "", "item": _item(task.get("id")) if isinstance(task, dict) else None})
        elif t in ("text", "thinking", "redacted_thinking"):
            known += 1
            if t == "text" and user and isinstance(b.get("text"), str) and b["text"].strip():
                out.append({"what": "statement", "ts": ts, "text": b["text"]})
        else:
            out.append(odd("unknown-content-block", _token(t or "")))
    return [{"what": "record", "recognised": known > 0} | who, *out]


def shred_flat(rec, d: Definition):
    """As ``shred_record``, for transcripts whose calls and results are records of their own:
    ``session`` (id, cwd), ``note`` (text), ``tool_call`` (id, name, path, command) and
    ``tool_result`` (for, ok, error)."""
    kind = rec.get("type") if isinstance(rec, dict) else None
    if not isinstance(kind, str) or kind not in d.conversational:
        return [] if kind in d.non_conversational else [{"what": "odd", "code": "unknown-record-type", "detail": _token(kind) if isinstance(kind, str) else "<other>"}]
    text = {k: _string(v) for k, v in rec.items()}
    out = [{"what": "record", "recognised": True, "sid": text.get("id") if kind == "session" else None, "cwd": text.get("cwd")}]
    if kind == "note" and (text.get("text") or "").strip():
        out.append({"what": "statement", "text": text["text"]})
    elif kind == "tool_call" and text.get("id") is not None and text.get("name") is not None:
        out.append({"what": "call"} | {k: text.get(k) for k in ("id", "name", "path", "command")})
    elif kind == "tool_result" and text.get("for") is not None:
        out.append({"what": "result", "id": text["for"], "is_error": rec.get("ok") is False, "text": text.get("error") or ""})
    elif kind.startswith("tool_"):
        out.append({"what": "odd", "code": "tool-input-shape", "detail": kind})
    return out


#: the record shapes there are mappers for
MAPPERS = {"agent": shred_record, "flat": shred_flat}


def _emit(rows: list[tuple]):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in PARTS.split(", ")]
    fix = lambda s: s if s.isascii() else s.encode("utf-8", "replace").decode()
    cols = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array([fix(x) if isinstance(x, str) else x for x in c], t) for c, t in zip(cols, types)], names=_NAMES)


def _rows(session, line, rec, d, shred=shred_record):
    for pos, p in enumerate(shred(rec, d)):
        yield tuple([session, line, pos, *[p.get(n) for n in _NAMES[3:]]])


def parts_of_lines(lines: DataFrame, d: Definition = Definition(), shred=shred_record) -> DataFrame:
    """Parts of physical lines (session, line, raw); ``shred`` knows the shape of the records."""
    ship_package(lines.sparkSession)

    def run(batches):
        import json

        for b in batches:
            rows = []
            for session, line, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                odd = None
                try:
                    text = raw.decode("utf-8-sig")
                    rec = json.loads(text)
                except UnicodeDecodeError:
                    odd = ("invalid-utf8", "utf8")
                except (ValueError, RecursionError):
                    odd = ("malformed-json", "json")
                if odd:
                    p = {"session": session, "line": line, "pos": 0, "what": "odd", "code": odd[0], "detail": odd[1]}
                    rows.append(tuple(p.get(n) for n in _NAMES))
                else:
                    rows += _rows(session, line, rec, d, shred)
            yield _emit(rows)

    return lines.select("session", "line", "raw").mapInArrow(run, PARTS)


def parts_of_table(df: DataFrame, session: Column, line: Column, d: Definition = Definition()) -> DataFrame:
    """Parts of a table of records whose ``message.content`` and ``toolUseResult`` are JSON text."""
    ship_package(df.sparkSession)
    c = F.col
    src = df.where(session.isNotNull()).select(
        session.alias("session"), line.cast("long").alias("line"), c("type"), c("subtype"), c("sessionId"), c("cwd"), c("version"), c("timestamp"), c("isCompactSummary"),
        c("compactMetadata").isNotNull().alias("meta"), c("message").isNotNull().alias("has_message"), c("message.content").alias("content"), c("toolUseResult"),
    )

    def run(batches):
        import json

        def whole(s):
            try:
                return None if s is None else json.loads(s)
            except (ValueError, RecursionError):
                return s

        for b in batches:
            rows = []
            for s, n, kind, sub, sid, cwd, ver, ts, summary, meta, has, content, result in zip(*(col.to_pylist() for col in b.columns)):
                rec = {"type": kind, "subtype": sub, "sessionId": sid, "cwd": cwd, "version": ver, "timestamp": ts, "isCompactSummary": summary}
                rec |= {"compactMetadata": {} if meta else None, "message": {"content": whole(content)} if has else None, "toolUseResult": whole(result)}
                rows += _rows(s, n, rec, d)
            yield _emit(rows)

    return spread(src, "line").mapInArrow(run, PARTS)


def kind_column(name: Column, d: Definition) -> Column:
    """The declared kind of a tool: exact, else the first prefix that fits, else null."""
    exact = F.create_map(*[F.lit(x) for kv in d.tools.items() for x in kv]) if d.tools else None
    by_prefix = [F.when(F.startswith(name, F.lit(p)), F.lit(k)) for p, k in d.prefixes]
    return F.coalesce(*([F.try_element_at(exact, name)] if exact is not None else []), *by_prefix, F.lit(None).cast("string"))


class Mapped:
    """The relations of a set of transcripts, over parts that are staged once."""

    def __init__(self, parts: DataFrame, d: Definition = Definition()):
        self.d = d
        self.parts = stage(parts, "parts")
        first = Window.partitionBy("session", "id").orderBy("line", "pos")
        ranked = lambda what: self.parts.where(F.col("what") == what).withColumn("rn", F.row_number().over(first))
        calls, results = ranked("call"), ranked("result")
        self.calls, self.results = calls.where("rn = 1").drop("rn"), results.where("rn = 1").drop("rn")
        self._repeated = [(calls, "duplicate-call-id"), (results, "duplicate-result-id")]

    def paired(self) -> DataFrame:
        """Every call with its result, if there is one."""
        r = self.results.select("session", "id", F.col("line").alias("result_line"), F.col("is_error").alias("failed"), F.col("text").alias("result_text"), F.col("item").alias("result_item"), F.lit(True).alias("observed"))
        return self.calls.join(r, ["session", "id"], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))

    def unanswered(self) -> DataFrame:
        return self.calls.join(self.results, ["session", "id"], "left_anti")

    def orphans(self) -> DataFrame:
        return self.results.join(self.calls, ["session", "id"], "left_anti")

    def identity(self) -> DataFrame:
        """(session, session_id, cwd, version): each the first that any recognised record gives."""
        at = F.struct("line", "pos")
        pick = lambda n: F.min_by(n, F.when(F.col(n).isNotNull(), at)).alias({"sid": "session_id"}.get(n, n))
        return self.parts.where("what = 'record'").groupBy("session").agg(pick("sid"), pick("cwd"), pick("version"))

    def counters(self) -> DataFrame:
        w = F.col("what")
        return self.parts.groupBy("session").agg(
            F.count_if(w == "record").alias("records"),
            F.count_if((w == "record") & F.coalesce("recognised", F.lit(False))).alias("conversation_records"),
            F.count_distinct(F.when(w == "call", F.col("id"))).alias("tool_calls"),
            F.count_distinct(F.when(w == "result", F.col("id"))).alias("tool_results"),
        )

    def histogram(self) -> DataFrame:
        """(session, tool, calls) of the calls of undeclared tools."""
        name = F.regexp_replace("name", "[\\x00-\\x1f\\x7f]", "")
        shown = F.when(F.length(name) == 0, "<unnamed>").otherwise(F.substring(name, 1, 64))
        return self.calls.where(kind_column(F.col("name"), self.d).isNull()).groupBy("session", shown.alias("tool")).agg(F.count("*").alias("calls"))

    def events(self) -> DataFrame:
        """Tool, statement and todo events in the shape ``extract`` takes."""
        c = F.col
        p = self.paired()
        message = F.trim(F.regexp_replace("result_text", "[\\x00-\\x1f\\x7f]+", " "))
        failed = F.coalesce(c("failed"), F.lit(False))
        base = [c("session"), (c("line") - 1).alias("entry"), c("line"), c("pos").alias("block"), c("ts")]
        tool = p.select(
            *base, F.lit(0).alias("sub"), F.lit("tool").alias("type"), "name", "path", "command", "intent", failed.alias("is_error"),
            F.when(failed & (F.length(message) > 0), message).alias("error"), "observed", c("result_line").alias("source_line"),
        )
        done = F.when(c("status") == "completed", "done").when(c("status").isin("pending", "in_progress"), "open")
        create = (c("name") == "TaskCreate") & c("subject").isNotNull() & c("result_item").isNotNull()
        update = (c("name") == "TaskUpdate") & c("item").isNotNull() & done.isNotNull()
        todo = p.where("observed").where(create | update).select(
            *base, F.lit(1).alias("sub"), F.lit("todo").alias("type"), F.when(create, c("subject")).otherwise(c("status")).alias("text"),
            F.when(create, "open").otherwise(done).alias("state"), F.when(create, c("result_item")).otherwise(c("item")).alias("item"), c("result_line").alias("source_line"),
        )
        said = self.parts.where("what = 'statement'").select(*base, F.lit(0).alias("sub"), F.lit("user").alias("type"), "text")
        return tool.unionByName(todo, allowMissingColumns=True).unionByName(said, allowMissingColumns=True)

    def diagnostics(self) -> DataFrame:
        """(session, line, code, detail) of everything that was not as declared."""
        c, say = F.col, lambda df, code, detail: df.select("session", "line", F.lit(code).alias("code"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
        from ledgerloom.functions.text import safe_token

        out = self.parts.where("what = 'odd'").select("session", "line", "code", "detail")
        for df, detail in self._repeated:
            out = out.union(say(df.where("rn > 1"), "tool-input-shape", detail))
        calls, paired = self.calls, self.paired().where("observed")
        created, updated = paired.where("name = 'TaskCreate'"), paired.where("name = 'TaskUpdate'")
        whole = c("status").isNotNull() & c("item").isNotNull()
        known = c("status").isin("completed", "pending", "in_progress")
        for df, code, detail in (
            (self.unanswered(), "tool-call-without-result", safe_token(c("name"))),
            (self.orphans(), "tool-result-without-call", "result"),
            (calls.where("name = 'Bash' and command is null"), "tool-input-shape", "bash-command"),
            (calls.where("name in ('Read', 'Write', 'Edit') and path is null"), "tool-input-shape", "file-path"),
            (created.where("subject is null"), "tool-input-shape", "task-subject"),
            (created.where("subject is not null and result_item is null"), "task-result-shape", "task-create"),
            (updated.where(~whole), "tool-input-shape", "task-update"),
            (updated.where(whole & ~known), "task-status-unknown", safe_token(c("status"))),
        ):
            out = out.union(say(df, code, detail))
        return out


def shape_tokens(types: Column) -> Column:
    """``record:<type>`` of a record type; null stands for a record without one."""
    return F.when(types.rlike("^[A-Za-z0-9_-]{1,64}$"), F.concat(F.lit("record:"), types)).otherwise("record:<other>")


def line_shapes(lines: DataFrame) -> DataFrame:
    """(session, line, token) of physical lines; blank ones have no shape."""
    v = F.try_parse_json(F.try_validate_utf8(F.col("raw").cast("string")))
    t = F.try_variant_get(v, "$.type", "string")
    return lines.where(F.octet_length(F.btrim(F.col("raw").cast("string"), F.lit(" \t\r\n"))) > 0).select("session", "line", F.coalesce(shape_tokens(t), F.lit("record:<other>")).alias("token"))


def undeclared_shapes(tokens: DataFrame, d: Definition = Definition(), most: int = 8) -> DataFrame:
    """(session, token, first_line) of ``tokens(session, line, token)`` that are not declared:
    the ``most`` that were seen first in each session."""
    seen = tokens.where(~F.col("token").isin(d.shapes())).groupBy("session", "token").agg(F.min("line").alias("first_line"))
    w = Window.partitionBy("session").orderBy("first_line", "token")
    return seen.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")
