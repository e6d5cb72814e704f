import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import deepjson
from ledgerloom.operators import rejects as R

U = "f511cb80-0baf-4d7b-a734-1327aca02560"
T = "2026-01-08T14:54:38.886Z"


def j(**kw):
    return json.dumps({"uuid": U, "sessionId": U, "timestamp": T, "type": "user", "message": {"role": "user", "content": "hi"}} | kw)


JSON = [
    (j(), None),
    (j(message={"content": [{"a": 1}]}), None),
    (j() + j(), "syntax"),
    (j()[:-1], "syntax"),
    ("", "syntax"),
    ("  " + j() + " \n", None),
    ("[1]", "columns"),
    ("12", "columns"),
    ("NaN", "syntax"),
    (j().replace('"hi"', "NaN"), "syntax"),
    (j(message="x"), "columns"),
    (j(message={"role": "user"}), "columns"),
    (j(uuid=U.upper()), "value"),
    (j(uuid=5), "value"),
    (j(timestamp="2026-02-30T00:00:00Z"), "value"),
    (j(timestamp="2024-02-29T00:00:00Z"), None),
    (j(timestamp="2026-01-08T14:54:38.88Z"), "value"),
    (j(type="User"), "value"),
    (j(message={"content": ["a"]}), "value"),
    (j(message={"content": None}), "value"),
    (j(message={"content": {}}), "value"),
    (j().replace('"hi"', '"a\tb"'), "syntax"),
    (j().replace('"hi"', '[{"n":' + "9" * 6000 + "}]"), None),
    (j().replace('"hi"', "'hi'"), "syntax"),
    ("[" * 200_000, "syntax"),
    ("[" * 200_000 + "]" * 200_000, "columns"),
    (j().replace('"hi"', '[{"n":' + '{"a":[' * 100_000 + "]}" * 100_000 + "}]"), None),
    (j(type="User").replace('"hi"', '[{"n":' + "[" * 30_000 + "]" * 30_000 + "}]"), "value"),
    (j().replace('"hi"', '[{"n":' + "[" * 30_000 + "]" * 29_999 + "}]"), "syntax"),
    (None, "syntax"),
    ("﻿" + j(), "syntax"),
]
CSV = [
    (f"{U},{U},{T},user,user,hi", None),
    (f'"{U}","{U}","{T}","user","","say ""x"", then\n{{a: [1, 2"', None),
    (f"{U},{U},{T},user,,", None),
    (f'{U},{U},{T},user,user,say "x"', "syntax"),
    (f'{U},{U},{T},user,user,"open', "syntax"),
    (f'{U},{U},{T},user,user,"a"b', "syntax"),
    (f"{U};{U};{T};user;user;hi", "columns"),
    (f"{U},{U},{T},user,user,a, b", "columns"),
    ("", "columns"),
    (f"{U},{U},{T},user,boss,hi", "value"),
    (f"{U},{U},yesterday,user,user,hi", "value"),
    (f"{U}\x1e,{U},{T},user,user,hi", "value"),
    (f"{U},{U},{T},user,user,hi\x1ethere", None),
    (None, "syntax"),
]


def test_reasons_and_values(spark):
    rows = [(i, "a.jsonl", r) for i, (r, _) in enumerate(JSON)] + [(100 + i, "b.csv", r) for i, (r, _) in enumerate(CSV)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "line_id long, file_name string, raw string, reason string")
    loaded = R.load_lines(df, F.col("line_id"), F.col("file_name"), F.col("raw"))
    got = {r.line_id: r.reason for r in loaded.collect()}
    want = {i: e for i, (_, e) in enumerate(JSON)} | {100 + i: e for i, (_, e) in enumerate(CSV)}
    assert got == want
    ok = {r.line_id: r for r in R.accepted(loaded).collect()}
    assert ok[101].content == 'say "x", then\n{a: [1, 2' and ok[101].role == ""
    assert json.loads(ok[1].content) == [{"a": 1}]
    assert {r.line_id for r in R.rejected(loaded).collect()} == {i for i, e in want.items() if e}


def test_empty(spark):
    df = spark.createDataFrame([], "line_id long, file_name string, raw string")
    assert R.load_lines(df, F.col("line_id"), F.col("file_name"), F.col("raw")).count() == 0


def test_lines_cannot_lend_each_other_brackets():
    """Lines that are wrong alone but right together must not pass as a block."""
    a, b, c = '{"x":[{"q":1}', '{"z":2}]}', '{"a":1},{"b":2}'
    assert R.parse_json_block([a, b, c]) is None
    assert [x for x, _ in R.bisect([a, b, c], R.parse_json_block, R.diagnose_json)] == ["syntax"] * 3
    half = [f'{U},{U},{T},user,user,"a', f'b",{U}']
    assert R.parse_csv_block(half) is None


_piece = st.sampled_from(['"', '""', ",", "\n", "a", "b,c", U, T, "user", "", " ", "\x1e"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(_piece, max_size=14).map("".join), max_size=12))
def test_csv_blocks_agree_with_single_lines(lines):
    lines = [*lines, f"{U},{U},{T},user,user,ok"]
    assert R.bisect(lines, R.parse_csv_block, R.diagnose_csv) == [R.diagnose_csv(x) for x in lines]


_json = st.sampled_from(["{", "}", "[", "]", ",", ":", '"a"', "1", "null", j(), "\n", " ", '"', "-0", "01", "1e5", "true", "NaN"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(_json, max_size=8).map("".join), max_size=10))
def test_json_blocks_agree_with_single_lines(lines):
    lines = [*lines, j()]
    assert R.bisect(lines, R.parse_json_block, R.diagnose_json) == [R.diagnose_json(x) for x in lines]
    for x in lines:  # the parser for very deep values accepts the same language
        try:
            deepjson.loads_deep(x)
        except ValueError:
            assert R.diagnose_json(x)[0] == "syntax"
        else:
            assert R.diagnose_json(x)[0] != "syntax"


_FIELD = re.compile(r'"(?:[^"]|"")*"|[^",]*')


@settings(max_examples=300, deadline=None)
@given(st.lists(_piece, max_size=12).map("".join))
def test_csv_split_against_a_pattern(line):
    whole = re.fullmatch(rf'(?:{_FIELD.pattern})(?:,(?:{_FIELD.pattern}))*', line)
    got = R.split_csv(line)
    assert (got is None) == (whole is None)
