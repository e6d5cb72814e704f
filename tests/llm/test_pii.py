import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import pii as P
from ledgerloom.llm import pii_train as T
from ledgerloom.llm.boosting import fit, probability

NAMES = {"corvin": "given", "marsh": "surname", "mark": "given", "grant": "given", "iris": "given", "fuller": "surname", "kellvane": "surname"}


WORDS = P.word_list()


def kinds(text, path=False):
    return {k for _, _, k, _ in P.score([(text, path)], NAMES, P.models(), WORDS)[0]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("contact: corvin.marsh@mail.ostavik.test", {"email"}),
        ("write to c.marsh [at] stenmark.example.net if it fails", {"email"}),
        ("call +1 (555) 010-8065 now", {"phone"}),
        ("reach them at 555-0135 after six", {"phone"}),
        ("verified with SSN 932-59-4225", {"idnum"}),
        ("the form shows passport no. X63108251", {"idnum"}),
        ("address: 137 Orchard Street Apt 18B\nBrackley Hythe, ZZ 35012", {"address"}),
        ("invoice goes to PO Box 1343, Tannhausen", {"address"}),
        ("ship it to Tannergasse 8, 80878 Vallorne", {"address"}),
        ("ask Corvin Kellvane to look at it", {"name"}),
        ("Dr. Marsh signed it off.", {"name"}),
        ("owner is KELLVANE, Corvin", {"name"}),
        ("my colleague Rusmel Varyorandir asked for it", {"name"}),
        ("cc corvin kellvane", {"name"}),
        ("Ports 5550-5562 to 5599 belong to the hollow.", set()),
        ("Part no. 4434-761-8 is in the sensor. Checksum 1651 3426 7911 differs.", set()),
        ("Mark the dialog done and grant access to June Release.", set()),
        ("Iris Table keeps the brisk validator on host iris-17.", set()),
        ("Use decorator @panel from package dialog@4.13.0.", set()),
        ("The epoch is 1797196415. Run 2026-12-22-2494 left a shard at 192.0.2.237.", set()),
        ("", set()),
        ("   ", set()),
    ],
)
def test_texts(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/home/corvin.marsh/relay", {"name"}),
        ("C:\\Users\\Corvin Marsh\\src", {"name"}),
        ("/data/mail/corvin.marsh@stenmark.example.net/x", {"email"}),
        ("/dialer/+1-555-010-4721/meadow", {"phone"}),
        ("/cases/952-29-3090/ember", {"idnum"}),
        ("/srv/checkout/iris-table", set()),
        ("/Users/Shared/heron-table", set()),
    ],
)
def test_paths(path, want):
    assert kinds(path, True) == want


@pytest.mark.parametrize(
    ("text", "path"),
    [("lives at 221B Baker Street", False), ("deliver to 12b Orchard Street, Lowford", False), ("office at 7 Östra Way", False), ("POSTFACH 1234", False), ("/data/mail/137 Orchard Street/x", True)],
)
def test_every_address_is_proposed(text, path):
    assert "address" in {k for _, _, k in P.candidates(text, path, NAMES)}


def test_addresses_with_lettered_numbers_and_in_paths():
    assert kinds("lives at 221B Baker Street") == {"address"} and kinds("deliver to 12b Orchard Street, Lowford") == {"address"}
    assert kinds("office at 7 Östra Way") == {"address"} and "address" in kinds("/data/mail/137 Orchard Street/x", True)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("My name is Priya Natarajan", {"name"}),
        ("Meeting with Juan Carlos Rodríguez", {"name"}),
        ("Kind regards\nThomas Müller", {"name"}),
        ("call 07700 900123", {"phone"}),
        ("phone 030 1234567", {"phone"}),
        ("the form shows tax id 51 805 507 313 31 of 66 checks pass", {"idnum"}),
        ("tax id 62 482 447 731 call 555-0180 now", {"idnum", "phone"}),
        ("221B Baker Street, London NW1 6XE", {"address"}),
        ("Unter den Linden 77, 10117 Berlin", {"address"}),
        ("Please ask Amber Cache", set()),
        ("Microsoft Office is slow", set()),
        ("version 10.15.7 of macOS on 2024-05-01 12:30:45", set()),
        ("id 550e8400-e29b-41d4-a716-446655440000", set()),
    ],
)
def test_ordinary_text_with_names_outside_the_lexicon(text, want):
    assert kinds(text) == want


def test_held_out_sentences_and_names():
    """Carriers and names that training never saw."""
    for kind, (recall, precision) in T.measure(P.models(), 2000).items():
        assert recall >= 0.9 and precision >= 0.85, (kind, recall, precision)


def test_redaction_keeps_the_rest():
    t = "Fix a. write to c.marsh@x.example if it fails; call 555-0135, ask Corvin Kellvane to look at it"
    assert P.redact(t, P.score([(t, False)], NAMES, P.models(), WORDS)[0]) == "Fix a. write to [EMAIL] if it fails; call [PHONE], ask [NAME] to look at it"


def test_a_name_ends_before_the_next_sentence():
    t = "owner is KELLVANE, Corvin Export the shard"
    assert P.redact(t, P.score([(t, False)], NAMES, P.models(), WORDS)[0]) == "owner is [NAME] Export the shard"


ROWS = [
    (1, "/home/corvin.marsh/x", json.dumps("call 555-0135 now"), "c"),
    (2, None, json.dumps([{"type": "text", "text": "ok"}, {"type": "tool_result", "content": [{"type": "text", "text": "SSN 932-59-4225"}, {"type": "image"}, 5]}, None, {"type": "text", "text": 7}]), "c"),
    (3, None, None, "c"),
    (4, "", "not json, call 555-0135 now", "c"),
    (5, "/srv/x", "null", "c"),
    (6, None, json.dumps({"type": "tool_result", "content": "contact: a.b@c.example"}), "c"),
    (6, None, json.dumps({"type": "tool_result", "content": "contact: a.b@c.example"}), "c"),
    (7, None, json.dumps("call 555-0135 now. " + "plain words here. " * 40_000 + "SSN 932-59-4225"), "c"),
]


def test_columns(spark):
    df = spark.createDataFrame(ROWS, "rec_id long, cwd string, content string, kind string")
    lex = spark.createDataFrame([("Corvin", "given"), ("Marsh", "surname"), (None, "given")], "token string, kind string")
    c = F.col
    got = sorted(tuple(r) for r in P.find(df, c("rec_id"), c("cwd"), c("content"), lex).collect())
    assert got == [(1, "content", "phone"), (1, "cwd", "name"), (2, "result", "idnum"), (4, "content", "phone"), (6, "result", "email"), (6, "result", "email"), (7, "content", "idnum"), (7, "content", "phone")]
    red = {r.rec_id: r for r in P.redacted(df, c("rec_id"), c("cwd"), c("content"), lex).collect()}
    assert len(red) == 7 and red[1].cwd == "/home/[NAME]/x" and json.loads(red[1].content) == "call [PHONE] now"
    assert json.loads(red[2].content)[1]["content"][0]["text"] == "SSN [ID]" and red[3].content is None and red[5].content == "null"
    assert P.find(df.limit(0), c("rec_id"), c("cwd"), c("content"), lex).count() == 0


def test_boosting_learns_and_is_calibrated():
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = fit(x, y, trees=40, depth=3)
    p = probability(m, r.normal(size=(10, 5)))
    assert m["held_out_f1"] > 0.95 and ((p > 0) & (p < 1)).all()
    assert json.loads(json.dumps(m)) == m
