"""Registered queries of the text operators, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.llm import contamination, conversations, garble, pii, tokenize
from ledgerloom.operators.dedupe import deduplicate
from ledgerloom.plans.problems import _COPIES, _KEY
from ledgerloom.runtime import read


def _pii(spark, d, f):
    t = read(spark, d, "transcript")
    return f(t, F.col("rec_id"), F.col("cwd"), F.col("message.content"), read(spark, d, "name_lexicon"))


def p3_found(spark, d):
    return _pii(spark, d, pii.find)


def p3_redacted(spark, d):
    return _pii(spark, d, pii.redacted)


def _conversations(spark, d):
    return conversations.prepare(deduplicate(spark, f"{d}/transcript.parquet", ["received_at", "rec_id"]))


def p4_found(spark, d):
    return conversations.faults(*_conversations(spark, d))


def p4_conversations(spark, d):
    return conversations.conversations(*_conversations(spark, d))


def p8_ids(spark, d):
    docs = read(spark, d, "documents")
    return tokenize.encode_column(docs, F.col("doc_id"), F.col("text")).select(F.col("k").alias("doc_id"), "ids")


def _aligned(spark, d, **kw):
    docs, items = read(spark, d, "documents"), read(spark, d, "eval_items")
    return contamination.align(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"), **kw)


def p9_found(spark, d):
    return contamination.leaks(_aligned(spark, d, least_run=contamination.RUN))


def p9_aligned(spark, d):
    return _aligned(spark, d, least_words=0)


def _restored(spark, d):
    return garble.restore_column(read(spark, d, "documents"), F.col("doc_id"), F.col("text"))


def p10_found(spark, d):
    return _restored(spark, d).select(F.col("k").alias("doc_id"))


def p10_restored(spark, d):
    return _restored(spark, d).select(F.col("k").alias("doc_id"), "found", "restored")


QUERIES = {f.__name__: f for f in (p3_found, p3_redacted, p4_found, p4_conversations, p8_ids, p9_found, p9_aligned, p10_found, p10_restored)}
_GRAMS = """SELECT DISTINCT {id} AS id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT {id}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL),
  range(1, greatest(1, len(w)::BIGINT - 11)) AS r(i)"""
_MESSAGES = (
    _COPIES
    + """, w AS (SELECT * FROM transcript a WHERE NOT EXISTS (SELECT 1 FROM r JOIN transcript o ON o.rec_id = r.y WHERE r.x = a.rec_id AND (o.received_at < a.received_at OR o.received_at = a.received_at AND o.rec_id < a.rec_id))),
p AS (SELECT sessionId AS s, rec_id, CASE WHEN message.role IN ('user', 'assistant') THEN message.role ELSE type END AS role, coalesce(isCompactSummary, false) AS compact, message.content::JSON AS c,
  coalesce(CASE WHEN regexp_full_match(timestamp, '[0-9]{13}') THEN timestamp::BIGINT * 1000 ELSE epoch_us(timestamp::TIMESTAMPTZ) END, epoch_us(received_at)) AS ts
  FROM w WHERE sessionId IS NOT NULL AND type IN ('user', 'assistant') AND NOT coalesce(isSidechain, false) AND message.content IS NOT NULL),
a AS (SELECT *, CASE json_type(c) WHEN 'ARRAY' THEN c WHEN 'OBJECT' THEN json_array(c) WHEN 'VARCHAR' THEN json_array(json_object('type', 'text', 'text', c->>'$')) END AS l FROM p),
x AS (SELECT s, rec_id, ts, b->>'$.type' AS kind, coalesce(b->>'$.type' = 'text' AND regexp_matches(b->>'$.text', '\\S'), false) AS txt, b->>'$.id' AS id, b->>'$.tool_use_id' AS rid
  FROM (SELECT s, rec_id, ts, json_extract(l, '$[' || i || ']') AS b FROM a, range(json_array_length(l)::BIGINT) AS q(i) WHERE l IS NOT NULL)),
m AS (SELECT p.s, p.rec_id, p.ts, p.role, p.compact, bool_or(txt) AS txt, bool_or(kind = 'tool_result') AS res FROM p JOIN x USING (rec_id) GROUP BY ALL HAVING bool_or(txt OR kind IN ('tool_use', 'tool_result'))),
v AS (SELECT s, ts, rec_id, CASE WHEN role = 'assistant' THEN 'answer' ELSE 'ask' END AS event FROM m WHERE txt AND (role = 'assistant' OR NOT res AND NOT compact)),
n AS (SELECT s, event, lead(event) OVER (PARTITION BY s ORDER BY ts, rec_id) AS nxt FROM v),
i AS (SELECT s, id, min(u) AS u, min(t) AS t FROM (SELECT s, id, ts AS u, NULL::BIGINT AS t FROM x WHERE kind = 'tool_use' UNION ALL SELECT s, rid, NULL, ts FROM x WHERE kind = 'tool_result') GROUP BY ALL)"""
)
_DROPPED = """SELECT DISTINCT sessionId AS session_id, 'empty' AS reason FROM transcript WHERE sessionId IS NOT NULL AND sessionId NOT IN (SELECT s FROM m)
UNION SELECT s, 'broken' FROM (SELECT s, arg_min(role, (ts, rec_id)) AS first FROM m GROUP BY s) WHERE first = 'assistant'
UNION SELECT s, 'broken' FROM i WHERE u IS NULL OR t IS NULL OR t <= u
UNION SELECT s, 'no_reply' FROM n WHERE event = 'ask' AND coalesce(nxt, 'ask') = 'ask'"""
SQL: dict[str, str] = {
    "p4_found": _MESSAGES + _DROPPED,
    # messages of one instant stand in the order of their rows, as no reply link here says otherwise
    "p4_conversations": f"""{_MESSAGES},
bad AS ({_DROPPED}),
g AS (SELECT m.s, m.rec_id, m.ts, m.role, {_KEY.format("lower(nullif(trim(o.uuid), ''))")} AS u, coalesce({_KEY.format("lower(nullif(trim(o.parentUuid), ''))")}, {_KEY.format("lower(nullif(trim(o.logicalParentUuid), ''))")}) AS p
  FROM m JOIN transcript o USING (rec_id) WHERE m.s NOT IN (SELECT session_id FROM bad)),
lk AS (SELECT c.s, c.u, c.p FROM g c JOIN g d ON d.s = c.s AND d.u = c.p),
wk AS (SELECT s, u AS start, p AS cur FROM lk UNION SELECT wk.s, wk.start, lk.p FROM wk JOIN lk ON lk.s = wk.s AND lk.u = wk.cur)
SELECT g.s AS session_id, row_number() OVER (PARTITION BY g.s ORDER BY g.ts, g.rec_id) - 1 AS position, g.role, g.rec_id, g.ts, EXISTS (SELECT 1 FROM wk WHERE wk.s = g.s AND wk.start = g.u AND wk.cur = g.u) AS on_cycle FROM g""",
    "p9_found": "WITH d AS (" + _GRAMS.format(id="doc_id", table="documents") + "), e AS (" + _GRAMS.format(id="item_id", table="eval_items") + ") SELECT DISTINCT e.id AS item_id, d.id AS doc_id FROM e JOIN d ON d.g = e.g",
}
