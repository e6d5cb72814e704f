"""Rows that fail to parse, set apart with the reason while the valid ones load (problem 7).

Lines are taken in blocks.  A block is accepted as a whole by one bulk parse: a JSON block
as one array with an unforgeable separator between the lines, a CSV block by one run of a
record pattern that must consume it entirely.  A block that fails is bisected until single
bad lines are left, and only those are diagnosed strictly, character by character.

Defined results: a null line is ``syntax``; so is an empty ``.jsonl`` line, while an empty CSV
line has one field and is ``columns``; a line break outside quotes belongs to its CSV field;
repeated JSON keys are legal and the last one counts; files with other endings than ``.csv``
are read as JSON lines.
"""

from __future__ import annotations

import json
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame

from ledgerloom.functions.deepjson import dumps, loads
from ledgerloom.runtime import ship_package, spread

# fixed values of the line format
TYPES = (
    "user assistant system attachment queue-operation mode permission-mode last-prompt custom-title ai-title "
    "file-history-snapshot file-history-delta summary compact-boundary"
).split()
ROLES = ("user", "assistant", "system", "")
FIELDS = ("uuid", "sessionId", "timestamp", "type", "role", "content")
BLOCK = 64

_UUID = r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
_TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{3})?Z"
_uuid, _time = re.compile(_UUID), re.compile(_TIME)
_TYPESET = frozenset(TYPES)

# one valid CSV record and its end mark; possessive, so that a failure costs one pass
_END = "\x1e"


def _field(p: str) -> str:
    return f'(?:"({p})"|({p}))'


_record = re.compile(
    ",".join(_field(p) for p in (_UUID, _UUID, _TIME, "|".join(map(re.escape, TYPES)), "user|assistant|system|"))
    + f',(?:"((?:[^"{_END}]|"")*+)"|([^",{_END}]*+)){_END}'
)


def real_time(s) -> bool:
    if not isinstance(s, str) or not _time.fullmatch(s):
        return False
    try:
        datetime(int(s[:4]), int(s[5:7]), int(s[8:10]), int(s[11:13]), int(s[14:16]), int(s[17:19]))
    except ValueError:
        return False
    return True


def split_csv(line: str) -> list[str] | None:
    """The fields of one record, or None where RFC 4180 quoting is broken."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            value, i = [], i + 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None  # never closed
                value.append(line[i:j])
                if line.startswith('""', j):
                    value.append('"')
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < n and line[i] != ",":
                return None  # something follows the closing quote
            fields.append("".join(value))
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None
            fields.append(line[i:j])
            i = j
        if i >= n:
            return fields
        i += 1  # the comma


def _values_ok(uuid, session, time, kind) -> bool:
    return (
        isinstance(uuid, str)
        and isinstance(session, str)
        and isinstance(kind, str)
        and _uuid.fullmatch(uuid) is not None
        and _uuid.fullmatch(session) is not None
        and kind in _TYPESET
        and real_time(time)
    )


def _text(v) -> str | None:
    if v is None or isinstance(v, str):
        s = v
    else:
        s = dumps(v, compact=True)
    return s if s is None or s.isascii() else s.encode("utf-8", "replace").decode()


def diagnose_csv(line: str):
    """(reason, None) or (None, row)."""
    f = split_csv(line)
    if f is None:
        return "syntax", None
    if len(f) != 6:
        return "columns", None
    if not _values_ok(*f[:4]) or f[4] not in ROLES:
        return "value", None
    return None, tuple(f)


def _shape_json(v):
    if not isinstance(v, dict) or not all(k in v for k in ("uuid", "sessionId", "timestamp", "type", "message")):
        return "columns", None
    m = v["message"]
    if not isinstance(m, dict) or "content" not in m:
        return "columns", None
    c = m["content"]
    if not _values_ok(v["uuid"], v["sessionId"], v["timestamp"], v["type"]):
        return "value", None
    if not (isinstance(c, str) or isinstance(c, list) and all(isinstance(x, dict) for x in c)):
        return "value", None
    return None, (v["uuid"], v["sessionId"], v["timestamp"], v["type"], _text(m.get("role")), _text(c))


def diagnose_json(line: str):
    try:
        v = loads(line, strict=True)
    except ValueError:
        return "syntax", None
    return _shape_json(v)


def parse_csv_block(lines: list[str]) -> list[tuple] | None:
    """All rows of the block, or None if any line is not certainly valid."""
    text = _END.join(lines) + _END
    if text.count(_END) != len(lines):
        return None
    rows, at = [], 0
    for m in _record.finditer(text):
        if m.start() != at:
            return None
        at = m.end()
        g = m.groups()
        if not real_time(g[4] or g[5]):
            return None
        content = g[10].replace('""', '"') if g[10] is not None else g[11]
        rows.append((g[0] or g[1], g[2] or g[3], g[4] or g[5], g[6] or g[7], g[8] or g[9] or "", content))
    return rows if at == len(text) and len(rows) == len(lines) else None


def parse_json_block(lines: list[str]) -> list[tuple] | None:
    """One parse of all lines as an array with a separator that no line can hold: the
    values between the separators are the lines' values, one each, or the block fails."""
    mark = "\x01--line--"
    while any(mark in x for x in lines):
        mark += "-"
    quoted = json.dumps(mark)
    if any(quoted[1:-1] in x for x in lines):
        return None
    try:
        v = loads("[" + f"\n,{quoted},\n".join(lines) + "\n]", strict=True)
    except ValueError:
        return None
    if len(v) != 2 * len(lines) - 1 or any(x != mark for x in v[1::2]):
        return None
    rows = []
    for x in v[::2]:
        bad, row = _shape_json(x)
        if bad:
            return None
        rows.append(row)
    return rows


def bisect(lines: list[str], block, strict) -> list[tuple]:
    """[(reason, row)] for each line: bulk where a block passes, halves where it fails."""
    if len(lines) > 1:
        if (rows := block(lines)) is not None:
            return [(None, r) for r in rows]
        h = len(lines) // 2
        return bisect(lines[:h], block, strict) + bisect(lines[h:], block, strict)
    return [strict(lines[0])] if lines else []


def _load(batches):
    import pyarrow as pa

    for b in batches:
        names, raws = b.column(1).to_pylist(), b.column(2).to_pylist()
        out: list = [None] * len(raws)
        kinds: dict = {True: [], False: []}
        for i, (f, r) in enumerate(zip(names, raws)):
            if r is None:
                out[i] = ("syntax", None)
            else:
                kinds[(f or "").lower().endswith(".csv")].append(i)
        for csv, idx in kinds.items():
            block, strict = (parse_csv_block, diagnose_csv) if csv else (parse_json_block, diagnose_json)
            for k in range(0, len(idx), BLOCK):
                part = idx[k : k + BLOCK]
                for i, r in zip(part, bisect([raws[i] for i in part], block, strict)):
                    out[i] = r
        rows = [r or (None,) * 6 for _, r in out]
        cols = zip(*rows) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([x for x, _ in out], pa.string()), *[pa.array(c, pa.string()) for c in cols]],
            names=["line_id", "reason", *FIELDS],
        )


def load_lines(df: DataFrame, line_id: Column, file_name: Column, raw: Column) -> DataFrame:
    """(line_id, reason, uuid, sessionId, timestamp, type, role, content): the reason is null
    for a valid line and the fields are null for an invalid one."""
    ship_package(df.sparkSession)
    src = df.select(line_id.cast("long").alias("line_id"), file_name.alias("f"), raw.alias("r"))
    return spread(src, "line_id").mapInArrow(_load, "line_id long, reason string, " + ", ".join(f"{c} string" for c in FIELDS))


def rejected(loaded: DataFrame) -> DataFrame:
    return loaded.where("reason is not null").select("line_id", "reason")


def accepted(loaded: DataFrame) -> DataFrame:
    return loaded.where("reason is null").drop("reason")
