import datetime
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversations as C

S = (
    "rec_id long, received_at timestamp_ntz, type string, uuid string, parentUuid string, logicalParentUuid string, sessionId string, timestamp string, isSidechain boolean, "
    "isCompactSummary boolean, message struct<role:string,content:string>, session string, ts int"
)
T0 = datetime.datetime(2026, 1, 1)


def row(i, session, kind, content, minute, parent=None, side=False, compact=None, role=True, stamp=None):
    t = T0 + datetime.timedelta(minutes=minute)
    u = lambda k: None if k is None else str(uuid.UUID(int=k + 1))
    c = content if content is None or isinstance(content, str) and content[:1] in '["{' else json.dumps(content)
    return (i, T0, kind, u(i), u(parent), None, session, stamp or t.isoformat() + "Z", side, compact, (kind if role else None, c), "clash", 1)


def use(i):
    return [{"type": "tool_use", "id": i}]


def res(i):
    return [{"type": "tool_result", "tool_use_id": i, "content": "x"}]


def tell(spark, rows):
    df = spark.createDataFrame(rows, S).repartition(3)
    return C.prepare(df)


ROWS = [
    # ok: asked, tools, answered
    row(0, "ok", "user", "hi", 0), row(1, "ok", "assistant", use("a"), 1, 0), row(2, "ok", "user", res("a"), 2, 1), row(3, "ok", "assistant", "done", 3, 2, role=False),
    # nothing that counts
    row(10, "empty", "assistant", [{"type": "thinking", "thinking": "x"}], 0), row(11, "empty", "user", "  ", 1), row(12, "empty", "system", "hi", 1), row(13, "empty", "user", "hi", 1, side=True),
    # first is the assistant
    row(20, "first", "assistant", "hello", 0), row(21, "first", "user", "hi", 1), row(22, "first", "assistant", "yes", 2),
    # a use without a result
    row(30, "open", "user", "hi", 0), row(31, "open", "assistant", [*use("a"), {"type": "text", "text": "t"}], 1),
    # a result without a use
    row(40, "lost", "user", "hi", 0), row(41, "lost", "user", res("z"), 1), row(42, "lost", "assistant", "yes", 2),
    # a result no later than its use
    row(50, "tie", "user", "hi", 0), row(51, "tie", "assistant", [*use("a"), {"type": "text", "text": "t"}], 1), row(52, "tie", "user", res("a"), 1),
    # asked twice before an answer
    row(60, "twice", "user", "hi", 0), row(61, "twice", "user", "there?", 1), row(62, "twice", "assistant", "yes", 2),
    # never answered; a tool result is no answer
    row(70, "end", "user", "hi", 0), row(71, "end", "assistant", use("a"), 1), row(72, "end", "user", res("a"), 2),
    # a compaction summary asks nothing, an ISO time with an offset and milliseconds order right
    row(80, "mix", "user", "sum", 0, compact=True), row(81, "mix", "user", "hi", 9, stamp="2026-01-01T05:31:00+05:30"), row(82, "mix", "assistant", "yes", 9, stamp=str(int((T0 - datetime.datetime(1970, 1, 1)).total_seconds() + 120) * 1000)),
    # no session, unreadable content
    row(90, None, "user", "hi", 0), row(91, "odd", "user", "{broken", 0),
]
WANT = {("empty", "empty"), ("first", "broken"), ("open", "broken"), ("lost", "broken"), ("tie", "broken"), ("twice", "no_reply"), ("end", "no_reply"), ("odd", "empty")}


def test_reasons(spark):
    assert {tuple(r) for r in C.faults(*tell(spark, ROWS)).collect()} == WANT


def test_order_and_roles(spark):
    rows = C.conversations(*tell(spark, ROWS)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.session_id, r.position)):
        by.setdefault(r.session_id, []).append((r.position, r.rec_id, r.role))
    assert by == {"ok": [(0, 0, "user"), (1, 1, "assistant"), (2, 2, "user"), (3, 3, "assistant")], "mix": [(0, 80, "user"), (1, 81, "user"), (2, 82, "assistant")]}


def test_ties_follow_the_links_and_cycles_are_left_over():
    u = lambda i: bytes([i])
    rows = [(5, 1, u(1), u(3)), (5, 2, u(2), None), (5, 3, u(3), u(2)), (6, 4, u(4), u(9))]
    order, left = C.kahn(rows)
    assert [rows[i][1] for i in order] == [2, 3, 1, 4] and not left
    order, left = C.kahn([(5, 1, u(1), u(2)), (5, 2, u(2), u(1)), (4, 0, u(0), u(0)), (7, 7, u(7), u(1))][::1])
    assert left == {0, 1, 2, 3}
    order, left = C.kahn([(1, 1, u(1), u(2)), (2, 2, u(2), u(1))])  # the link against time is left out
    assert order == [0, 1] and not left


def test_reply_cycles_of_any_times_are_marked(spark):
    ring = [row(0, "ring", "user", "hi", 0, 2), row(1, "ring", "assistant", "yes", 1, 0), row(2, "ring", "user", "so?", 2, 1), row(3, "ring", "assistant", "so", 3, 2)]
    self_link = [row(10, "self", "user", "hi", 0, 10), row(11, "self", "assistant", "yes", 1, 10)]
    across = [row(20, "a", "user", "hi", 0, 31), row(21, "a", "assistant", "yes", 1, 20), row(30, "b", "user", "hi", 0, 21), row(31, "b", "assistant", "yes", 1, 30)]
    # from end to end of a conversation that many tasks share
    hot = [row(i, "hot", "assistant" if i % 2 else "user", "t", i, 1299 if i == 100 else i - 1 if i > 100 else None) for i in range(100, 1300)]
    got = {r.rec_id: r.on_cycle for r in C.conversations(*tell(spark, ring + self_link + across + hot)).collect()}
    assert {i for i, on in got.items() if on} == {0, 1, 2, 10, *range(100, 1300)}
    assert len(got) == 4 + 2 + 4 + 1200


def brute(rows):
    out, per = set(), {}
    for r in rows:
        per.setdefault(r[6], []).append(r)
    for s, rs in per.items():
        m = []
        for r in sorted(rs, key=lambda r: (r[7], r[0])):
            v = json.loads(r[10][1])
            blocks = v if isinstance(v, list) else [{"type": "text", "text": v}]
            m.append((r[7], r[2], any(b["type"] == "text" and b["text"].strip() for b in blocks), [b["id"] for b in blocks if b["type"] == "tool_use"], [b["tool_use_id"] for b in blocks if b["type"] == "tool_result"]))
        us, rs_ = {}, {}
        for t, _, _, u, r in m:
            for i in u:
                us.setdefault(i, t)
            for i in r:
                rs_.setdefault(i, t)
        if m[0][1] == "assistant" or set(us) != set(rs_) or any(rs_[i] <= us[i] for i in us):
            out.add((s, "broken"))
        asked = False
        for _, kind, text, _, r in m:
            if kind == "user" and text and not r:
                if asked:
                    out.add((s, "no_reply"))
                asked = True
            elif kind == "assistant" and text:
                asked = False
        if asked:
            out.add((s, "no_reply"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_a_hot_conversation_over_many_tasks(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(900):
        s = "hot" if i % 3 else f"s{i % 60}"
        k = r.random()
        c = "hi" if k < 0.5 else use(f"t{i}") if k < 0.7 else res(f"t{max(0, i - r.randint(1, 9))}") if k < 0.75 else "more"
        rows.append(row(i, s, "user" if i % 2 or k > 0.97 else "assistant", c, i, parent=max(0, i - 3)))
    assert {tuple(x) for x in C.faults(*tell(spark, rows)).collect()} == brute(rows)


def test_one_message_split_sessions_and_empty(spark):
    assert C.faults(*tell(spark, [])).count() == 0
    df = spark.createDataFrame([(None, None), ("1767225600", None), ("2026-01-01T00:00:00", None), ("junk", T0)], "t string, r timestamp_ntz")
    got = [x[0] for x in df.select(C.micros(F.col("t"), F.col("r"))).collect()]
    assert got == [None, 1767225600000000, 1767225600000000, 1767225600000000]


def test_left_over_messages_cost_no_more_than_others():
    """A long stretch with one message that is its own parent, in about the time of one without."""
    import time

    rows = [(i // 3, i, b"%d" % i, b"%d" % (i - 1) if i % 5 else None) for i in range(60_000)]
    rows[777] = (rows[777][0], 777, b"777", b"777")
    start = time.process_time()
    order, left = C.kahn(rows)
    assert 777 in left and sorted(order) == list(range(60_000)) and time.process_time() - start < 5
