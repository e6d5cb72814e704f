"""Deeply nested records to flat related tables by Merkle identities (problem 2).

One pass parses each JSON text, canonicalises its objects bottom-up (a nested object stands
in its parent's text as ``#<hash>``) and names each by the hash of that text.  An object is
stored once under its hash; every occurrence is a bridge row with its record, place, parent
hash and ordinal, so identical subtrees cost one row of body however often they occur.
Parsing and walking keep their own stacks, so no depth ends a task or loses a part, and a
row names its place within its parent only, so deep records stay as large as their text.

Defined results: text that is no JSON counts as a string and has no parts; numbers that are
equal are identical (1 = 1.0); an element that is no object gets a bridge row with kind
``''``; a null trigger or type gives kind ``''``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import ship_package, spread, stage

SCHEMA = (
    "rec_id long, part string, pos long, sub_pos long, path string, depth int, ordinal int, "
    "at int, parent_at int, parent binary, hash binary, body string, kind string, item_id string"
)
#: a task forgets which bodies it has stored after this many (repeats are merged later anyway)
_SEEN = 200_000
#: characters of a place within its parent; of a longer one the end is shown, its ordinal tells it apart
_STEP = 1_000


def _shred(batches):
    import json
    from hashlib import blake2b
    from json.encoder import encode_basestring as enc

    import pyarrow as pa

    from ledgerloom.functions.deepjson import dumps, loads

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 4, pa.binary(), pa.binary(), pa.string(), pa.string(), pa.string()]
    PARENT_AT, PARENT, HASH = (names.index(n) for n in ("parent_at", "parent", "hash"))
    rows: list[list] = []
    seen: set = set()

    class Ref(str):
        """The mark of an object that has its rows already."""

    def clean(s: str) -> str:
        return s if s.isascii() else s.encode("utf-8", "replace").decode()

    def text(v) -> str:
        if v is None:
            return ""
        return clean(v if isinstance(v, str) else dumps(v, sort_keys=True))

    def scalar(v) -> str:
        if isinstance(v, Ref):
            return v
        if isinstance(v, str):
            return enc(v)
        if v is None:
            return "null"
        if v is True:
            return "true"
        if v is False:
            return "false"
        if isinstance(v, float) and v == v and abs(v) < 2**53 and v == int(v):
            return str(int(v))
        return repr(v)

    def entries(v):
        return iter([(k, v[k]) for k in sorted(v)]) if isinstance(v, dict) else iter(enumerate(v))

    def visit(root, path: str, ordinal: int, depth: int, kids: tuple = ()) -> int:
        """Appends the rows of ``root`` and its inner objects; returns the row number of ``root``,
        whose further children are the rows ``kids``."""
        # a frame: value, what is left of it, its texts so far, the rows of its children, its place
        owner = [root, entries(root) if isinstance(root, (dict, list)) else iter(()), [], list(kids), path, ordinal]
        stack, owners = [owner], [owner]
        while True:
            frame = stack[-1]
            v, rest, parts = frame[0], frame[1], frame[2]
            is_object = isinstance(v, dict)
            for k, x in rest:
                if is_object:
                    parts.append(enc(k) + ":")
                if isinstance(x, (dict, list)):
                    step = k if is_object else f"{'' if frame is owners[-1] else frame[4]}[{k}]"
                    if len(step) > _STEP:
                        step = "…" + step[1 - _STEP :]
                    child = [x, entries(x), [], [], step, 0]
                    if isinstance(x, dict):
                        child[5] = len(owners[-1][3])
                        owners[-1][3].append(-1)  # its row number comes when it is done
                        owners.append(child)
                    stack.append(child)
                    break
                parts.append(scalar(x) + ",")
            else:
                stack.pop()
                if is_object:
                    body = "{" + "".join(parts).removesuffix(",") + "}"
                elif isinstance(v, list):
                    body = "[" + "".join(parts).removesuffix(",") + "]"
                else:
                    body = scalar(v)
                if frame is owners[-1]:
                    owners.pop()
                    n = close(frame, body, depth + len(owners))
                    if not stack:
                        return n
                    owners[-1][3][frame[5]] = n
                    body = "#" + rows[n][HASH].hex()
                stack[-1][2].append(body + ",")

    def close(frame, body: str, depth: int) -> int:
        nonlocal at
        v, kids, path, ordinal = frame[0], frame[3], frame[4], frame[5]
        kind = item = ""
        if isinstance(v, dict):
            kind = text(v.get("type"))
            item = text(v.get("id")) or text(v.get("tool_use_id"))
        h = blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for k in kids:
            rows[k][PARENT], rows[k][PARENT_AT] = h, at
        new = h not in seen
        if new:
            seen.add(h)
            body = clean(body)
        rows.append([rec, part, pos, sub, clean(path), depth, ordinal, at, None, None, h, body if new else None, kind if new else None, item if new else None])
        at += 1
        return len(rows) - 1

    def whole(s):
        try:
            return loads(s)
        except ValueError:
            return ""

    def emit():
        b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        rows.clear()
        if len(seen) > _SEEN:
            seen.clear()
        return b

    at = 0
    for b in batches:
        for rec, content, result, meta in zip(*(b.column(i).to_pylist() for i in range(4))):
            at = 0
            if content is not None and (v := whole(content)) and not isinstance(v, str):
                part = "content"
                for pos, block in enumerate(v if isinstance(v, list) else [v] if isinstance(v, dict) else ()):
                    inner = block.get("content") if isinstance(block, dict) else None
                    if isinstance(inner, list):
                        # the elements of a block's own content array are parts of their own
                        kids = []
                        for sub, x in enumerate(inner):
                            kids.append(visit(x, f"content[{sub}]", sub, 1))
                        sub = -1
                        visit({**block, "content": [Ref("#" + rows[k][HASH].hex()) for k in kids]}, "", pos, 0, tuple(kids))
                    else:
                        sub = -1
                        visit(block, "", pos, 0)
            if result is not None and result.lstrip()[:1] == "{" and isinstance(v := whole(result), dict):
                part, pos, sub = "result", -1, -1
                visit(v, "", 0, 0)
            if meta is not None:
                part, pos, sub = "compact", -1, -1
                m = json.loads(meta)
                visit({**m, "type": m.get("trigger")}, "", 0, 0)
            if len(rows) >= 20_000:
                yield emit()
    if rows:
        yield emit()


def shred(df: DataFrame, row_id: Column, content: Column, result: Column, meta: Column) -> tuple[DataFrame, DataFrame]:
    """(objects, bridge).

    objects: ``hash, kind, item_id, body``, one row per distinct object.
    bridge: ``rec_id, part, pos, sub_pos, path, depth, ordinal, at, parent_at, parent, hash``,
    one row per occurrence.  ``at`` numbers the occurrences of a record, ``parent_at`` is that
    of the object around it, ``path`` leads there from that object and ``ordinal`` counts the
    objects in it.  Depth 0 is a block, result or compaction record, an inner element of a
    block's content has depth 1 and ``sub_pos`` >= 0.
    """
    ship_package(df.sparkSession)
    src = df.select(row_id.alias("rec_id"), content.alias("content"), result.alias("result"), F.to_json(meta, {"ignoreNullFields": "false"}).alias("meta"))
    src = src.where("content is not null or result is not null or meta is not null")
    all_rows = stage(spread(src, "rec_id").mapInArrow(_shred, SCHEMA), "p2-shred")
    objects = all_rows.where("body is not null").groupBy("hash").agg(F.min("kind").alias("kind"), F.min("item_id").alias("item_id"), F.min("body").alias("body"))
    bridge = all_rows.select("rec_id", "part", "pos", "sub_pos", "path", "depth", "ordinal", "at", "parent_at", "parent", "hash")
    return objects, bridge


def parts(objects: DataFrame, bridge: DataFrame) -> DataFrame:
    """(rec_id, part, pos, sub_pos, kind, item_id) of the blocks, inner blocks, results and
    compaction records: the bridge rows of these levels with the object they point to."""
    level = (F.col("depth") == 0) | ((F.col("sub_pos") >= 0) & (F.col("depth") == 1))
    at = bridge.where(level).select("rec_id", "part", "pos", "sub_pos", "hash")
    named = objects.select("hash", "kind", "item_id")
    block = (F.col("part") == "content") & (F.col("sub_pos") == -1)
    return at.join(named, "hash").select("rec_id", "part", "pos", "sub_pos", "kind", F.when(block, F.col("item_id")).otherwise("").alias("item_id"))


def rebuild(objects: DataFrame, bridge: DataFrame) -> DataFrame:
    """(rec_id, part, pos, sub_pos, path, depth, ordinal, at, parent_at, kind, body) of every occurrence, each body with
    ``#<hash>`` marks where the bridge holds its children."""
    return bridge.join(objects, "hash").select("rec_id", "part", "pos", "sub_pos", "path", "depth", "ordinal", "at", "parent_at", "kind", "body")
