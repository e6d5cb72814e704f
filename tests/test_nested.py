import json

from pyspark.sql import functions as F

from ledgerloom.operators import nested as N

SCHEMA = "rec_id long, content string, toolUseResult string, meta struct<trigger:string,preTokens:long>, hash string, kind int"


def shred(spark, rows):
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], SCHEMA)
    c = F.col
    return N.shred(df, c("rec_id"), c("content"), c("toolUseResult"), c("meta"))


ROWS = [
    (1, '[{"type":"text","text":"a"},{"type":"tool_use","id":"c1","input":{"q":{"x":1},"l":[{"y":2},{"y":2}]}}]', None, None),
    (2, '{"type":"tool_result","tool_use_id":"c1","content":[{"type":"text","id":"no"},{"type":"image"},"s",null]}', '{"type":"create","n":{"m":1}}', None),
    (3, '"just a string"', '"a string"', ("auto", 5)),
    (4, "null", None, (None, None)),
    (5, "not json", "{broken", None),
    (6, None, None, None),
    (7, '[{"text":"a","type":"text"}, 5, null]', '{"no":"type"}', None),
    (8, "[]", "[1]", None),
]


def test_parts(spark):
    got = {tuple(r) for r in N.parts(*shred(spark, ROWS)).collect()}
    assert got == {
        (1, "content", 0, -1, "text", ""),
        (1, "content", 1, -1, "tool_use", "c1"),
        (2, "content", 0, -1, "tool_result", "c1"),
        (2, "content", 0, 0, "text", ""),
        (2, "content", 0, 1, "image", ""),
        (2, "content", 0, 2, "", ""),
        (2, "content", 0, 3, "", ""),
        (2, "result", -1, -1, "create", ""),
        (3, "compact", -1, -1, "auto", ""),
        (4, "compact", -1, -1, "", ""),
        (7, "content", 0, -1, "text", ""),
        (7, "content", 1, -1, "", ""),
        (7, "content", 2, -1, "", ""),
        (7, "result", -1, -1, "", ""),
    }


def test_identical_objects_are_stored_once(spark):
    objects, bridge = shred(spark, ROWS)
    bodies = [r.body for r in objects.collect()]
    assert len(bodies) == len(set(bodies))
    places = {}
    for r in bridge.collect():
        places.setdefault(bytes(r.hash), []).append((r.rec_id, r.path))
    text = next(r.hash for r in objects.collect() if r.body == '{"text":"a","type":"text"}')
    assert sorted(places[bytes(text)]) == [(1, ""), (7, "")]  # key order does not matter
    y = next(r.hash for r in objects.collect() if r.body == '{"y":2}')
    assert sorted(places[bytes(y)]) == [(1, "l[0]"), (1, "l[1]")]


def test_children_know_their_parents(spark):
    objects, bridge = shred(spark, ROWS[:2])
    body = {bytes(r.hash): r.body for r in objects.collect()}
    rows = bridge.collect()
    for r in rows:
        if r.parent is not None:
            assert "#" + bytes(r.hash).hex() in body[bytes(r.parent)]
        else:
            assert r.depth == 0


DEEP = 100_000


def test_deep_and_odd_values(spark):
    odd = json.dumps([{"type": "\ud800", "id": 7, "k\ud801": {"a": 1.0}}])
    rows = [
        (1, "[" * DEEP + "]" * DEEP, None, None),
        (2, odd, None, None),
        (3, '[{"type":"text","x":' + '{"a":' * 600 + "1" + "}" * 600 + "}]", None, None),
        (4, '[{"type":"tool_use","id":"t","input":' + '{"a":[' * DEEP + "1" + "]}" * DEEP + "},5]", '{"type":"r","n":' + "9" * 6000 + "}", None),
    ]
    objects, bridge = shred(spark, rows)
    got = {tuple(r) for r in N.parts(objects, bridge).collect()}
    assert got == {
        (1, "content", 0, -1, "", ""),
        (2, "content", 0, -1, "?", "7"),
        (3, "content", 0, -1, "text", ""),
        (4, "content", 0, -1, "tool_use", "t"),
        (4, "content", 1, -1, "", ""),
        (4, "result", -1, -1, "r", ""),
    }
    depths = {r.rec_id: r.d for r in bridge.groupBy("rec_id").agg(F.max("depth").alias("d")).collect()}
    assert depths == {1: 0, 2: 1, 3: 600, 4: DEEP}


def test_every_occurrence_leads_to_its_parent(spark):
    rows = [(1, '[{"a":{"b":{}},"c":[{"b":{}},[{}]],"content":[{"x":{}},{"x":{}}]}]', '{"q":{"b":{}}}', None)]
    _, bridge = shred(spark, rows)
    at = {(r.part == "content", r.at): r for r in bridge.collect()}
    way = lambda r: (way(at[r.part == "content", r.parent_at]) if r.parent_at is not None else []) + [r.path]
    got = sorted(".".join(w for w in way(r) if w) for r in at.values())
    assert got == sorted(["", "", "a", "a.b", "c[0]", "c[0].b", "c[1][0]", "content[0]", "content[0].x", "content[1]", "content[1].x", "q", "q.b"])
    for r in at.values():
        if r.parent_at is not None:
            assert at[r.part == "content", r.parent_at].hash == r.parent


def test_empty(spark):
    assert N.parts(*shred(spark, [])).count() == 0


def test_repeats_keep_every_occurrence(spark):
    rows = [(i, '[{"type":"text","text":"ok"}]', None, None) for i in range(500)]
    objects, bridge = shred(spark, rows)
    assert objects.count() == 1 and N.parts(objects, bridge).count() == 500
    assert N.rebuild(objects, bridge).count() == 500
