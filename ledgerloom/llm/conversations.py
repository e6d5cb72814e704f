"""Rebuilding conversations from message rows (problem 4).

Messages (one copy of each) are range-partitioned by conversation and time, so that a
conversation of any size is spread over as many tasks as its rows need.  Within its stretch
of a conversation a task orders the reply graph by Kahn's algorithm with a heap on
(time, row): a reply waits for the message it answers as long as that is not later in time,
ties included.  Links that go against time are left out of the order; nodes that are left over
stand on or below a cycle of equal times and follow in (time, row) order.  As links to an
earlier stretch are satisfied before it begins, the stretches joined in time order are the
order of the whole.  Cycles are looked for apart from that, with every reply link of the
conversation whatever its times, by the components and colouring of problem 1.  Each stretch also leaves a summary of a few values, and the checks that
span stretches (unanswered messages, who speaks first) run on those.

Defined results: rows without a session are dropped; a time that cannot be read falls back
to the time of arrival; a missing role is the row's type; of equal tool ids the earliest use
and the earliest result are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.ids import uuid_key
from ledgerloom.operators import hierarchy
from ledgerloom.runtime import ship_package, stage

_PARSED = (
    "session string, ts long, rec_id long, role string, node binary, parent binary, has_text boolean, has_result boolean, "
    "compact boolean, uses array<string>, results array<string>"
)
_ORDERED = (
    "session string, stretch string, start_ts long, start_rec long, idx long, rec_id long, ts long, role string, "
    "n long, first_role string, first_event string, last_event string, inner boolean"
)


def micros(c: Column, fallback: Column) -> Column:
    """Microseconds since 1970 of a time written as ISO text (with Z, an offset or nothing,
    which is UTC) or as a number of seconds or milliseconds."""
    t = F.trim(c)
    zoned = F.when(t.rlike(r"(?i)(z|[+-][0-9]{2}:?[0-9]{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    digits = t.rlike(r"^[0-9]{9,17}$")
    number = F.when(digits, F.try_to_number(t, F.lit("9" * 17))).cast("long")
    scaled = F.when(F.length(t) <= 11, number * 1000000).when(F.length(t) <= 14, number * 1000).otherwise(number)
    iso = F.unix_micros(F.when(~digits, zoned).try_cast("timestamp"))
    return F.coalesce(F.when(digits, scaled), iso, F.unix_micros(fallback.cast("timestamp")))


def _parse(batches):
    import json

    import pyarrow as pa

    names = [f.split()[0] for f in _PARSED.split(", ")]

    def blank(s) -> bool:
        return not isinstance(s, str) or not s.strip()

    for b in batches:
        keep, text, result, uses, results = [], [], [], [], []
        for i, c in enumerate(b.column(7).to_pylist()):
            if not c:
                continue
            try:
                v = json.loads(c)
            except (ValueError, RecursionError):
                continue
            has_text, u, r, any_result = False, [], [], False
            if isinstance(v, str):
                has_text = not blank(v)
            for x in v if isinstance(v, list) else [v] if isinstance(v, dict) else ():
                if not isinstance(x, dict):
                    continue
                kind = x.get("type")
                if kind == "text":
                    has_text = has_text or not blank(x.get("text"))
                elif kind == "tool_use":
                    u.append(x.get("id") if isinstance(x.get("id"), str) else "")
                elif kind == "tool_result":
                    any_result = True
                    r.append(x.get("tool_use_id") if isinstance(x.get("tool_use_id"), str) else "")
            if has_text or u or any_result:
                keep.append(i)
                text.append(has_text)
                result.append(any_result)
                uses.append(u)
                results.append(r)
        at = pa.array(keep, pa.int64())
        head = [b.column(i).take(at) for i in range(6)]
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [*head, pa.array(text, pa.bool_()), pa.array(result, pa.bool_()), b.column(6).take(at), pa.array(uses, strings), pa.array(results, strings)],
            names=names,
        )


def messages(df: DataFrame) -> DataFrame:
    """The messages among the rows of a (deduplicated) transcript, parsed and narrow."""
    ship_package(df.sparkSession)
    c = F.col
    speaks = c("sessionId").isNotNull() & c("type").isin("user", "assistant") & ~F.coalesce(c("isSidechain"), F.lit(False))
    role = F.coalesce(F.when(c("message.role").isin("user", "assistant"), c("message.role")), c("type"))
    src = df.where(speaks).select(
        c("sessionId").alias("session"),
        micros(c("timestamp"), c("received_at")).alias("ts"),
        c("rec_id"),
        role.alias("role"),
        uuid_key(c("uuid")).alias("node"),
        F.coalesce(uuid_key(c("parentUuid")), uuid_key(c("logicalParentUuid"))).alias("parent"),
        F.coalesce(c("isCompactSummary"), F.lit(False)).alias("compact"),
        c("message.content").alias("content"),
    )
    return src.mapInArrow(_parse, _PARSED)


def kahn(rows: list[tuple]) -> tuple[list[int], set[int]]:
    """Order of rows ``(ts, rec_id, node, parent)``, sorted by (ts, rec_id): parents first, else
    by time.  Returns the order and the row numbers left over on cycles."""
    import heapq

    at = {}
    for i, r in enumerate(rows):
        if r[2] is not None:
            at.setdefault(r[2], i)
    waits, kids = [0] * len(rows), {}
    for i, (ts, _, _, parent) in enumerate(rows):
        p = at.get(parent) if parent is not None else None
        if p is not None and rows[p][0] <= ts:  # links against time are faulty
            waits[i] = 1
            kids.setdefault(p, []).append(i)
    heap = [i for i, w in enumerate(waits) if not w]  # row numbers are in (ts, rec_id) order
    heapq.heapify(heap)
    order = []
    while heap:
        i = heapq.heappop(heap)
        order.append(i)
        for k in kids.get(i, ()):
            waits[k] -= 1
            if not waits[k]:
                heapq.heappush(heap, k)
    left = {i for i, w in enumerate(waits) if w}
    if left:
        place = {i: k for k, i in enumerate(order)}
        order = sorted(order + list(left), key=lambda i: (rows[i][0], place.get(i, len(place)), i))
    return order, left


def _order(batches):
    import pyarrow as pa
    from pyspark import TaskContext

    task = TaskContext.get()
    part = f"{task.partitionId() if task else 0}"
    names = [f.split()[0] for f in _ORDERED.split(", ")]
    types = [pa.string(), pa.string(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    out: list[list] = [[] for _ in names]

    def close(session, rows):
        order, _ = kahn([(r[1], r[2], r[4], r[5]) for r in rows])
        last = first = None
        inner = False
        for i in order:
            r = rows[i]
            if r[3] == "assistant":
                event = "answer" if r[6] else None
            else:
                event = "ask" if r[6] and not r[7] and not r[8] else None
            if event:
                inner = inner or (event == last == "ask")
                first = first or event
                last = event
        for k, i in enumerate(order):
            r = rows[i]
            whole = (len(rows), rows[order[0]][3], first, last, inner) if k == 0 else (None,) * 5
            for c, v in zip(out, (session, part, rows[0][1], rows[0][2], k, r[2], r[1], r[3], *whole)):
                c.append(v)

    def emit():
        b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
        for c in out:
            c.clear()
        return b

    session, rows = None, []
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(9))):
            if r[0] != session and rows:
                close(session, rows)
                rows = []
                if len(out[0]) > 20_000:
                    yield emit()
            session = r[0]
            rows.append(r)
    if rows:
        close(session, rows)
    if out[0]:
        yield emit()


def ordered(msgs: DataFrame) -> DataFrame:
    """Every message with its stretch and place in it; the first row of a stretch carries the
    stretch's summary (n, first_role, first_event, last_event, inner)."""
    narrow = msgs.select("session", "ts", "rec_id", "role", "node", "parent", "has_text", "has_result", "compact")
    cut = narrow.repartitionByRange("session", "ts").sortWithinPartitions("session", "ts", "rec_id")
    return cut.mapInArrow(_order, _ORDERED)


def _stretches(placed: DataFrame) -> DataFrame:
    return placed.where("idx = 0").select("session", "stretch", "start_ts", "start_rec", "n", "first_role", "first_event", "last_event", "inner")


def faults(sessions: DataFrame, msgs: DataFrame, placed: DataFrame) -> DataFrame:
    """(session_id, reason): why conversations must be dropped."""
    s = _stretches(placed)
    empty = sessions.select("session").distinct().join(s.select("session").distinct(), "session", "left_anti").withColumn("reason", F.lit("empty"))
    starts = s.groupBy("session").agg(F.min_by("first_role", F.struct("start_ts", "start_rec")).alias("role")).where("role = 'assistant'").select("session")
    uses = msgs.select("session", F.explode("uses").alias("id"), F.col("ts").alias("use_ts"), F.lit(None).cast("long").alias("result_ts"))
    results = msgs.select("session", F.explode("results").alias("id"), F.lit(None).cast("long").alias("use_ts"), F.col("ts").alias("result_ts"))
    pairs = uses.union(results).groupBy("session", "id").agg(F.min("use_ts").alias("u"), F.min("result_ts").alias("r"))
    unpaired = pairs.where("u is null or r is null or r <= u").select("session")
    broken = starts.union(unpaired).distinct().withColumn("reason", F.lit("broken"))
    # a few rows per conversation: one for each task that held a part of it
    spoken = s.where("last_event is not null")
    w = Window.partitionBy("session").orderBy("start_ts", "start_rec")
    open_ask = (F.lag("last_event").over(w) == "ask") & (F.col("first_event") == "ask")
    at_end = F.lead("last_event").over(w).isNull() & (F.col("last_event") == "ask")
    silent = spoken.select("session", F.coalesce(open_ask | at_end | F.col("inner"), F.col("inner") | at_end).alias("bad")).where("bad")
    no_reply = silent.select("session").distinct().withColumn("reason", F.lit("no_reply"))
    return empty.union(broken).union(no_reply).select(F.col("session").alias("session_id"), "reason")


def prepare(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, messages, placed messages) of a transcript with one copy of each record."""
    msgs = stage(messages(df), "p4-messages")
    placed = stage(ordered(msgs), "p4-placed")
    return df.where("sessionId is not null").select(F.col("sessionId").alias("session")), msgs, placed


def reply_cycles(msgs: DataFrame) -> DataFrame:
    """(rec_id) of the messages on a cycle of reply links within their session."""

    def key(c: str) -> Column:  # a node is a message of one session, named by 128 bits to shuffle less
        return F.md5(F.concat(F.hex(c), F.lit("|"), F.col("session")))

    links = stage(msgs.where("node is not null").select("rec_id", "ts", key("node").alias("node"), key("parent").alias("parent")), "p4-links")
    h = hierarchy.resolve_hierarchy(links, "node", ["parent"], ["ts", "rec_id"])
    rings = h.where("kind = 'cycle'").select(F.lower(F.hex("node")).alias("node"))
    return links.join(rings, "node", "left_semi").select("rec_id")


def conversations(sessions: DataFrame, msgs: DataFrame, placed: DataFrame) -> DataFrame:
    """(session_id, position, role, rec_id, ts, on_cycle) of the conversations worth keeping."""
    bad = stage(faults(sessions, msgs, placed).select(F.col("session_id").alias("session")).distinct(), "p4-bad")
    cycles = reply_cycles(msgs.join(bad, "session", "left_anti")).withColumn("on_cycle", F.lit(True))
    w = Window.partitionBy("session").orderBy("start_ts", "start_rec").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _stretches(placed).select("session", "stretch", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    kept = placed.join(bad, "session", "left_anti").join(offsets, ["session", "stretch"]).join(cycles, "rec_id", "left")
    return kept.select(F.col("session").alias("session_id"), (F.col("offset") + F.col("idx")).alias("position"), "role", "rec_id", "ts", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
