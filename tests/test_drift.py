import json

from pyspark.sql import functions as F

from ledgerloom.operators import drift as D


def bodies(*recs):
    return [json.dumps(r) for r in recs]


def rec(v, t="user", **kw):
    return {"type": t, "version": v, **kw}


DATA = bodies(
    rec("1.9.0", a="x", gone=1, keep={"in": 1, "leaf_id": "q"}, opt=None),
    rec("1.9.0", a="x", keep={"in": 2, "leaf_id": "q"}),
    rec("1.10.1", a=5, keep={"in": 2, "leafId": "q"}, born=True, opt=None),
    rec("1.10.1", a=None, keep={"in": None, "leafId": "q"}, born=False),
    rec("2.0.0", a=5, keep=[1], born=False, opt="now"),
    rec("1.9.0", "attachment", attachment={"type": "file", "path": "p", "n": 1}),
    rec("1.10.1", "attachment", attachment={"type": "file", "filePath": "p", "count": 1}),
    rec("2.0.0", "mode", mode="m"),
) + ["[1]", "broken", '{"type":1}', None]


def frame(spark, rows=DATA):
    return spark.createDataFrame([(i, b, "clash") for i, b in enumerate(rows)], "file_id int, body string, version string")


def test_report(spark):
    got = {tuple(r) for r in D.report(frame(spark), F.col("body")).collect()}
    assert got == {
        ("user", "a", "retyped", "1.10.1", ""),
        ("user", "gone", "removed", "1.10.1", ""),
        ("user", "born", "added", "1.10.1", ""),
        ("user", "keep.leaf_id", "renamed", "1.10.1", "keep.leafId"),
        ("user", "keep", "retyped", "2.0.0", ""),
        ("user", "opt", "added", "2.0.0", ""),
        ("attachment/file", "attachment.path", "renamed", "1.10.1", "attachment.filePath"),
        ("attachment/file", "attachment.n", "renamed", "1.10.1", "attachment.count"),
        ("attachment/file", "", "type_removed", "2.0.0", ""),
        ("mode", "", "type_added", "2.0.0", ""),
    }


def test_several_candidates_are_told_apart():
    old = {"user_name": "string", "user_mail": "string", "lines": "number"}
    new = {"userName": "string", "userMail": "string", "lines": "number"}
    got = D.select_renames(old, new, ["user_mail", "user_name"], ["userMail", "userName"])
    assert got == {"user_name": "userName", "user_mail": "userMail"}
    # nesting speaks where names do not
    old = {"m": "object", "m.alpha": "number", "m.t": "number", "beta": "number"}
    new = {"m": "object", "m.one": "number", "m.t": "number", "two": "number"}
    assert D.select_renames(old, new, ["beta", "m.alpha"], ["m.one", "two"]) == {"m.alpha": "m.one", "beta": "two"}


def test_flooding_converges_and_prefers_equal_names():
    s = {"a": "string", "b": "object", "b.c": "number"}
    sim = D.flood(s, s)
    assert max(sim.values()) == 1.0 and sim["b.c", "b.c"] >= sim.get(("b.c", "a"), 0)


def united(spark, recs):
    return [r.asDict() for r in D.unify(frame(spark, recs), F.col("body"), ["file_id"]).orderBy("file_id").collect()]


def test_one_table_keeps_every_value(spark):
    t = D.unify(frame(spark), F.col("body"), ["file_id"])
    types = dict(t.dtypes)
    assert types["a"] == "bigint" and types["keep.in"] == "bigint" and types["born"] == "boolean" and types["keep"] == "string"
    assert "keep.leaf_id" not in types and "attachment.path" not in types and "version_2" not in types
    r = [x.asDict() for x in t.orderBy("file_id").collect()]
    assert len(r) == len(DATA)
    assert r[0]["keep.leafId"] == r[2]["keep.leafId"] == "q" and r[0]["misfits"] == '{"a":"x"}' and r[0]["a"] is None and r[2]["a"] == 5
    assert r[5]["attachment.filePath"] == "p" and r[5]["attachment.count"] == 1 and r[4]["keep"] == "[1]" and r[3]["a"] is None
    assert r[9]["record_type"] is None and r[9]["misfits"] == '{"":"broken"}' and r[11]["misfits"] is None


def test_renamed_objects_take_their_fields_along(spark):
    r = united(spark, bodies(rec("1.0", a={"x": 1, "y": "s"}), rec("2.0", b={"x": 2, "y": "t"}), rec("3.0", b={"x": 3, "z": "t"})))
    assert [x["b.x"] for x in r] == [1, 2, 3] and [x["b.z"] for x in r] == ["s", "t", "t"] and not {"a.x", "b.y"} & r[0].keys()


def test_a_name_that_is_used_again_is_another_field(spark):
    r = united(spark, bodies(rec("1.0", n=1), rec("2.0", m=2), rec("3.0", m=3, n=30), rec("3.0", m=4, n=None)))
    assert [(x["m"], x["n"]) for x in r] == [(1, None), (2, None), (3, 30), (4, None)]
    r = united(spark, bodies(rec("1.0", a=1), rec("2.0", b=2), rec("3.0", a=3)))
    assert [x["a"] for x in r] == [1, 2, 3] and "b" not in r[0]


def test_types_that_part_and_names_that_clash(spark):
    r = united(spark, bodies(rec("1.0", w=1, File_ID="x", s=1), rec("2.0", w=1.5, File_ID="y", s="t"), rec("2.0", "mode", w=7)))
    assert [x["w"] for x in r] == [1.0, 1.5, 7.0] and [x["File_ID_2"] for x in r] == ["x", "y", None] and [x["s"] for x in r] == ["1", "t", None]


def test_flooding_decides_between_several():
    old = {"user_name": "string", "colour": "string"}
    new = {"username": "string", "zzqx": "string"}
    got = D.select_renames(old, new, ["colour", "user_name"], ["username", "zzqx"])
    assert got["user_name"] == "username"
    # a field that goes beside one that is much more alike is no rename
    assert D.select_renames({"user_name": "string", "user_nam_b": "string"}, {"userName": "string"}, ["user_nam_b", "user_name"], ["userName"]) == {"user_name": "userName"}


def test_objects_used_as_maps_have_no_fields(spark, monkeypatch):
    monkeypatch.setattr(D, "MAP_KEYS", 50)
    recs = bodies(*[rec(f"{1 + i // 40}.0", files={f"path/{i}-{k}": {"n": k} for k in range(3)}, x=i) for i in range(80)])
    assert D.report(frame(spark, recs), F.col("body")).collect() == []
    t = D.unify(frame(spark, recs), F.col("body"), ["file_id"])
    assert set(t.columns) == {"file_id", "record_type", "version", "files", "type", "x", "misfits"}
    assert json.loads(t.where("file_id = 3").first().files) == {f"path/3-{k}": {"n": k} for k in range(3)}


def test_deep_records_and_many_fields(spark):
    deep = '{"type":"user","version":"1.0","d":' + '{"a":' * 50_000 + "1" + "}" * 50_000 + "}"
    assert D.report(frame(spark, [deep, *bodies(rec("2.0", d={}))]), F.col("body")).count() >= 0
    old = {f"m{i}.field_{i}": "number" for i in range(2000)}
    new = {f"m{i}.Field{i}": "number" for i in range(2000)} | {f"m{i}": "object" for i in range(2000)}
    old |= {f"m{i}": "object" for i in range(2000)}
    got = D.select_renames(old, new, sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys()))
    assert sum(got.get(f"m{i}.field_{i}") == f"m{i}.Field{i}" for i in range(2000)) > 1990


def test_unreadable_and_empty(spark):
    assert {r.file_id for r in D.unreadable(D.unify(frame(spark), F.col("body"), ["file_id"])).collect()} == {8, 9, 10, 11}
    assert D.report(frame(spark, []), F.col("body")).count() == 0
    assert D.unify(frame(spark, []), F.col("body"), ["file_id"]).count() == 0


def test_versions_order_by_number():
    assert sorted(["2.0.9", "1.10.1", "2.0.12", "1.9.0"], key=D.version_key) == ["1.9.0", "1.10.1", "2.0.9", "2.0.12"]


def wide(n, **kw):
    return {f"k{i}": i for i in range(n)} | kw


WIDE = bodies(
    rec("1.0", o=wide(1500, inner={"x": 1}, gone="s")),
    rec("2.0", o={k: v for k, v in wide(1500, inner={"x": 1}, k9="x", fresh=True, here={"z": 1}).items() if k not in ("k7", "k11")}),
)


def test_objects_of_many_fields_are_reported_as_by_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    frame(spark, WIDE).write.parquet(str(tmp_path / "transcript_files.parquet"))
    got = {tuple(r) for r in entry.queries()["p5_found"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW transcript_files AS SELECT * FROM '{tmp_path}/transcript_files.parquet/*.parquet'")
    assert len(got) == 6 and got == set(con.execute(entry.oracle_sql()["p5_found"]).fetchall())


def test_objects_of_many_fields_are_columns(spark, monkeypatch):
    monkeypatch.setattr(D, "CELLS", 5_000)  # a few rows a batch
    r = united(spark, WIDE * 5)
    assert len(r) == 10 and [x["o.k8"] for x in r] == [8] * 10 and [x["o.k7"] for x in r] == [7, None] * 5
    assert [x["o.fresh"] for x in r] == [None, True] * 5 and [x["o.inner.x"] for x in r] == [1] * 10 and len(r[0]) == 5 + 1504


def test_names_that_many_fields_share_still_bring_them_together():
    frames = {f"{s}{i}": "object" for s in "mn" for i in range(60)}
    gone, come = ([f"{s}{i}.total" for i in range(60)] for s in "mn")
    got = D.select_renames(frames | dict.fromkeys(gone, "number"), frames | dict.fromkeys(come, "number"), sorted(gone), sorted(come))
    assert sorted(got) == sorted(gone) and sorted(got.values()) == sorted(come)


def plain_flooding(old, new, rounds=100, eps=1e-6):
    """Pair by pair: (scores, fields that go and are in none that goes, the same of those that come)."""
    up, leaf = (lambda p: p.rpartition(".")[0]), (lambda p: p.rpartition(".")[2])
    a, b = {"": "object", **old}, {"": "object", **new}
    gone, come = a.keys() - b.keys(), b.keys() - a.keys()
    tops = [x for x in gone if up(x) not in gone], [y for y in come if up(y) not in come]
    start = {(x, x): 1.0 for x in a if b.get(x) == a[x]}
    todo = [(x, y) for x in tops[0] for y in tops[1]]
    while todo:
        x, y = todo.pop()
        if a[x] == b[y] and (up(x) == up(y) or D._grams(leaf(x)) & D._grams(leaf(y))):
            start[x, y] = D.name_similarity(leaf(x), leaf(y))
            todo += [(k, m) for k in gone if up(k) == x for m in come if up(m) == y]
    over = {p: (up(p[0]), up(p[1])) for p in start if p[0] and (up(p[0]), up(p[1])) in start}
    kids = {p: [q for q, o in over.items() if o == p] for p in start}
    sim = start
    for _ in range(rounds):
        nxt = {p: s + sim[p] + sum(sim[q] for q in kids[p]) / max(1, len(kids[p])) + (sim[over[p]] / len(kids[over[p]]) if p in over else 0) for p, s in start.items()}
        top = max(nxt.values())
        nxt = {p: v / top for p, v in nxt.items()}
        delta, sim = sum((nxt[p] - sim[p]) ** 2 for p in start), nxt
        if delta < eps:
            break
    return {p: s for p, s in sim.items() if p[0] == p[1] or p[0] in tops[0] and p[1] in tops[1]}


def plain_renames(sim, old, new, gone, come):
    pairs = [(s, x, y) for (x, y), s in sim.items() if x in gone and y in come]
    best = lambda k, v: max(p[0] for p in pairs if p[k] == v)
    out = {}
    for s, x, y in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if x not in out and y not in out.values() and s >= D.RELATIVE * max(best(1, x), best(2, y)):
            out[x] = y
    return out


def test_flooding_by_classes_equals_flooding_by_pairs():
    import random

    names, kinds = ["user", "userName", "user_id", "id", "idx", "total", "zz"], ["string", "number", "object", "object"]
    several = 0
    for seed in range(60):
        rnd = random.Random(seed)

        def schema():
            out, todo = {}, [("", 0)]
            while todo:
                p, depth = todo.pop()
                for n in rnd.sample(names, rnd.randint(2, 5)):
                    q = f"{p}.{n}" if p else n
                    out[q] = rnd.choice(kinds if depth < 3 else kinds[:2])
                    if out[q] == "object":
                        todo.append((q, depth + 1))
            return out

        old, new = schema(), schema()
        want, got = plain_flooding(old, new), D.flood(old, new)
        assert want.keys() == got.keys() and all(abs(want[p] - got[p]) < 1e-9 for p in want)
        gone, come = (sorted(p for p in s.keys() - o.keys() if not any(q not in o or old[q] != new[q] for q in D._above(p))) for s, o in ((old, new), (new, old)))
        by_type = [[sum(s[p] == t for p in of) for s, of in ((old, gone), (new, come))] for t in set(kinds)]
        if gone and come and [1, 1] not in by_type:
            several += 1
            assert D.select_renames(old, new, gone, come) == plain_renames(got, old, new, gone, come)
    assert several > 10


def test_thousands_of_keys_that_change_at_once():
    old = {"files": "object"} | {f"files.src/{i}-a": "object" for i in range(1500)} | {f"files.src/{i}-a.n": "number" for i in range(1500)}
    new = {"files": "object"} | {f"files.src/{i}-b": "object" for i in range(1500)} | {f"files.src/{i}-b.n": "number" for i in range(1500)}
    gone, come = ([p for p in sorted(s) if p.endswith(e)] for s, e in ((old, "-a"), (new, "-b")))
    got = D.select_renames(old, new, gone, come)
    assert len(got) == 1500 and got["files.src/1234-a"] == "files.src/1234-b"


def test_renames_hold_for_what_is_inside_and_for_earlier_versions():
    names = D.Names([("t", "a", "2.0", "b"), ("t", "b.x", "3.0", "b.y"), ("t", "b", "4.0", "c")], ["1.0", "2.0", "3.0", "4.0"])
    assert [names.latest("t", v, "a.x.k") for v in ("1.0", "2.0")] == ["c.y.k", "a.x.k"]
    assert [names.latest("t", v, "b.x") for v in ("2.0", "3.0", "4.0")] == ["c.y", "c.x", "b.x"] and names.latest("u", "1.0", "a") == "a"


def test_changes_at_any_depth(spark):
    def deep(levels, **kw):
        return '{"d":' * levels + json.dumps(kw) + "}" * levels

    def record(version, levels, **kw):
        return '{"type":"user","version":"%s","o":%s}' % (version, deep(levels, **kw))

    for levels in (498, 499, 500, 501, 1200):
        at = "o" + ".d" * levels
        recs = [record("1.0", levels, a="x", n=1, same={"in": 1}), record("2.0", levels, b="x", n=True, same={"in": 1}, more=[1])]
        got = {tuple(r) for r in D.report(frame(spark, recs), F.col("body")).collect()}
        assert got == {("user", f"{at}.a", "renamed", "2.0", f"{at}.b"), ("user", f"{at}.n", "retyped", "2.0", ""), ("user", f"{at}.more", "added", "2.0", "")}
    # what is inside a field that goes is not reported, and the objects are told apart by what is inside
    recs = ['{"type":"user","version":"1.0","xx":%s,"yy":%s}' % (deep(600, a=1), deep(700, q="s")), '{"type":"user","version":"2.0","xxa":%s,"yya":%s}' % (deep(600, a=1), deep(700, q="s"))]
    assert {(r.field, r.change, r.new_field) for r in D.report(frame(spark, recs), F.col("body")).collect()} == {("xx", "renamed", "xxa"), ("yy", "renamed", "yya")}
    r = united(spark, [record("1.0", 600, a="x"), record("2.0", 600, b="x")])
    assert [json.loads(x["misfits"]) for x in r] == [{"o" + ".d" * 499: deep(101, **{k: "x"}).replace(" ", "")} for k in "ab"] and len(r[0]) == 5
