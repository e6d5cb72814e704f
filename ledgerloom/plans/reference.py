"""Registered queries of the transcript engine's own operators, with equal SQL where SQL can
say them.  A session is ``sessionId``, a line is ``rec_id``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions import canon, text
from ledgerloom.operators import extract, mapper, scan, store, usage
from ledgerloom.operators.ordered import running_sum_before
from ledgerloom.plans import vectors
from ledgerloom.runtime import read
from ledgerloom.sources.definition import Definition
from ledgerloom.sources.lines import explode_lines

NOW = "2026-01-12T00:00:00Z"
_D = Definition()
_LIST = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def _mapped(spark, d) -> mapper.Mapped:
    return mapper.Mapped(mapper.parts_of_table(read(spark, d, "transcript"), F.col("sessionId"), F.col("rec_id")))


def _config(m: mapper.Mapped):
    roots = F.array().cast("array<struct<root:string,scope:string>>")
    return m.identity().select("session", "cwd", F.lit(None).cast("string").alias("repo_root"), F.lit("cwd").alias("path_base"), roots.alias("roots"))


def _extraction(spark, d, kinds=None) -> extract.Extraction:
    m = _mapped(spark, d)
    return extract.Extraction(m.events(), _config(m), kinds=kinds)


def _record_lines(spark, d):
    """The records of the table as lines: hashed over what they carry."""
    t = read(spark, d, "transcript").where("sessionId is not null")
    raw = F.to_json(F.struct("type", "uuid", "timestamp", "message", "toolUseResult"))
    return t.select(F.col("sessionId").alias("session"), F.col("rec_id").alias("line"), canon.digest_column(raw).alias("sha256"))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# the blocks of all records that the mapper looks into, and first-wins calls and results
_BLOCKS = """
WITH arrays AS (SELECT sessionId AS session, rec_id, type, message.content AS c FROM transcript
  WHERE sessionId IS NOT NULL AND type IN ('user', 'assistant', 'system') AND NOT coalesce(isCompactSummary, false)
    AND message.content IS NOT NULL AND json_type(message.content) = 'ARRAY'),
blocks AS (SELECT session, rec_id, type, i, json_extract(c, '$[' || i || ']') AS b FROM arrays, range(json_array_length(c)::BIGINT) AS r(i)),
calls AS (SELECT * FROM (SELECT session, rec_id, b->>'$.id' AS id, b->>'$.name' AS name, b->>'$.input.file_path' AS path,
    row_number() OVER (PARTITION BY session, b->>'$.id' ORDER BY rec_id, i) AS rn FROM blocks
    WHERE b->>'$.type' = 'tool_use' AND b->>'$.id' IS NOT NULL AND b->>'$.name' IS NOT NULL) WHERE rn = 1),
results AS (SELECT * FROM (SELECT session, rec_id, b->>'$.tool_use_id' AS id, coalesce(b->>'$.is_error', 'false') = 'true' AS failed, b AS block,
    row_number() OVER (PARTITION BY session, b->>'$.tool_use_id' ORDER BY rec_id, i) AS rn FROM blocks
    WHERE b->>'$.type' = 'tool_result' AND b->>'$.tool_use_id' IS NOT NULL) WHERE rn = 1)
"""
_KIND = (
    "CASE "
    + " ".join(f"WHEN name = '{n}' THEN '{k}'" for n, k in fixed.TOOL_KINDS.items())
    + " "
    + " ".join(f"WHEN starts_with(name, '{p}') THEN '{k}'" for p, k in fixed.TOOL_PREFIXES)
    + " END"
)


@query(
    f"""SELECT type, class, count(*) AS n FROM (SELECT type, CASE
  WHEN type = 'system' AND subtype = 'compact_boundary' THEN CASE WHEN compactMetadata IS NOT NULL THEN 'compaction' ELSE 'drift' END
  WHEN type IN ('user', 'assistant') AND coalesce(isCompactSummary, false) THEN CASE WHEN message IS NOT NULL THEN 'compaction' ELSE 'drift' END
  WHEN type IN ({_LIST(fixed.CONVERSATIONAL)}) THEN 'conversational' WHEN type IN ({_LIST(fixed.NON_CONVERSATIONAL)}) THEN 'other' ELSE 'drift' END AS class
FROM transcript) GROUP BY ALL"""
)
def q01_record_vocabulary(spark, d):
    c = F.col
    t = read(spark, d, "transcript").select("type", "subtype", "isCompactSummary", c("compactMetadata").isNotNull().alias("meta"), c("message").isNotNull().alias("said"))
    cls = (
        F.when((c("type") == "system") & (c("subtype") == "compact_boundary"), F.when(c("meta"), "compaction").otherwise("drift"))
        .when(c("type").isin("user", "assistant") & F.coalesce("isCompactSummary", F.lit(False)), F.when(c("said"), "compaction").otherwise("drift"))
        .when(c("type").isin(*fixed.CONVERSATIONAL), "conversational")
        .when(c("type").isin(*fixed.NON_CONVERSATIONAL), "other")
        .otherwise("drift")
    )
    return t.groupBy("type", cls.alias("class")).agg(F.count("*").alias("n"))


@query(_BLOCKS + f"SELECT name, coalesce({_KIND}, 'undeclared') AS kind, count(*) AS calls, count(DISTINCT session) AS sessions FROM calls GROUP BY ALL")
def q02_tool_histogram(spark, d):
    calls = _mapped(spark, d).calls
    kind = F.coalesce(mapper.kind_column(F.col("name"), _D), F.lit("undeclared"))
    return calls.groupBy("name", kind.alias("kind")).agg(F.count("*").alias("calls"), F.count_distinct("session").alias("sessions"))


@query(
    _BLOCKS
    + """SELECT session, count(*) FILTER (side = 'both') AS paired, count(*) FILTER (side = 'call') AS unanswered, count(*) FILTER (side = 'result') AS orphans,
  count(*) FILTER (failed) AS failures FROM (SELECT coalesce(c.session, r.session) AS session, CASE WHEN r.id IS NULL THEN 'call' WHEN c.id IS NULL THEN 'result' ELSE 'both' END AS side,
  coalesce(r.failed, false) AS failed FROM calls c FULL JOIN results r ON c.session = r.session AND c.id = r.id) GROUP BY session"""
)
def q03_pairing(spark, d):
    m = _mapped(spark, d)
    p = m.paired().select("session", F.when(F.col("observed"), "both").otherwise("call").alias("side"), F.coalesce("failed", F.lit(False)).alias("failed"))
    both = p.unionByName(m.orphans().select("session", F.lit("result").alias("side"), F.col("is_error").alias("failed")))
    s = F.col("side")
    return both.groupBy("session").agg(F.count_if(s == "both").alias("paired"), F.count_if(s == "call").alias("unanswered"), F.count_if(s == "result").alias("orphans"), F.count_if("failed").alias("failures"))


@query(
    _BLOCKS
    + f"""SELECT session, count(*) AS source_tool_calls, count(*) FILTER (kind IS NULL) AS unmapped_tool_calls,
  ((count(*) - count(*) FILTER (kind IS NULL)) * 1000000 // count(*))::BIGINT AS coverage_ppm FROM (SELECT session, {_KIND} AS kind FROM calls) GROUP BY session"""
)
def q04_coverage(spark, d):
    calls = _mapped(spark, d).calls.select("session", mapper.kind_column(F.col("name"), _D).isNull().alias("odd"))
    n = calls.groupBy("session").agg(F.count("*").alias("source_tool_calls"), F.count_if("odd").alias("unmapped_tool_calls"))
    return n.withColumn("coverage_ppm", canon.ppm(F.col("source_tool_calls") - F.col("unmapped_tool_calls"), F.col("source_tool_calls")))


@query(
    _BLOCKS
    + """, said AS (SELECT session, rec_id, b->>'$.text' AS t FROM blocks WHERE type = 'user' AND b->>'$.type' = 'text'
  UNION ALL SELECT sessionId, rec_id, message.content->>'$' FROM transcript WHERE sessionId IS NOT NULL AND type = 'user' AND NOT coalesce(isCompactSummary, false)
    AND message.content IS NOT NULL AND json_type(message.content) = 'VARCHAR'),
stated AS (SELECT session, rec_id, substring(trim(regexp_replace(regexp_extract(t, '(?s)^(.*?(?:[.!?](?:\\s|$)|$))', 1), '[\\t\\r\\n ]+', ' ', 'g')), 1, 200) AS statement FROM said WHERE t IS NOT NULL AND trim(t) <> '')
SELECT session, statement, min(rec_id) - 1 AS entry, min(cue) AS cue FROM (SELECT *, CASE """
    + " ".join(f"WHEN contains(lower(statement), '{c.replace(chr(39), chr(39) * 2)}') THEN '{c.replace(chr(39), chr(39) * 2)}'" for c in fixed.CUES)
    + " END AS cue FROM stated) WHERE cue IS NOT NULL GROUP BY session, statement"
)
def q05_decisions(spark, d):
    f = _extraction(spark, d, ("decision.stated",)).facts
    return f.select("session", F.col("key").alias("statement"), "entry", "cue")


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS user_id, event_id, props->>'$.k' AS command, event_type = 'error' AS failed, CASE WHEN value < 10 THEN 'low' WHEN value < 25 THEN 'mid' ELSE 'high' END AS signature FROM events),
s AS (SELECT *, coalesce(sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, command ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e)
SELECT w.user_id, w.command, w.event_id AS fixed_at, f.signature FROM (SELECT DISTINCT user_id, command, seg, signature FROM s WHERE failed) f
JOIN s w ON w.user_id = f.user_id AND w.command = f.command AND w.seg = f.seg AND NOT w.failed"""
)
def q06_error_fix(spark, d):
    c, zero = F.col, F.lit(0)
    sig = F.when(c("value") < 10, "low").when(c("value") < 25, "mid").otherwise("high")
    e = read(spark, d, "events").select(
        c("user_id").cast("string").alias("session"), c("event_id").alias("entry"), (c("event_id") + 1).alias("line"), zero.alias("block"), zero.alias("sub"), F.lit(None).cast("string").alias("ts"),
        F.lit(None).cast("long").alias("source_line"), F.get_json_object("props", "$.k").alias("command_key"), sig.alias("signature"), (c("event_type") == "error").alias("is_error"),
    )
    fixes = extract.fixes(e, c("is_error"))
    return fixes.select(c("session").alias("user_id"), c("fixed_by").alias("command"), c("entry").alias("fixed_at"), c("key").alias("signature"))


@query(
    """SELECT user_id::VARCHAR AS session, props->>'$.k' AS key, count(*)::BIGINT AS runs, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tools, min(event_id) AS entry,
  arg_max(event_type, event_id) AS last_class, arg_min(event_type || ':' || event_id, event_id) AS snippet FROM events GROUP BY ALL"""
)
def q07_merge_facts(spark, d):
    c = F.col
    e = read(spark, d, "events").select(c("user_id").cast("string").alias("session"), c("event_id").alias("entry"), c("event_type"), F.get_json_object("props", "$.k").alias("k"))
    n = e.withColumn("line", c("entry") + 1).withColumn("ts", F.lit(None).cast("string")).withColumn("source_line", F.lit(None).cast("long"))
    one = extract.fact(F.lit(True), "cmd.run", c("k"), F.concat_ws(":", "event_type", "entry"), runs=F.lit(1).cast("long"), tools=c("event_type"), **{"class": c("event_type")})
    return extract.merge(extract.facts_of(n, [one])).select("session", "key", "runs", F.array_join("tools", ",").alias("tools"), "entry", c("class").alias("last_class"), "snippet")


@query(
    _BLOCKS
    + f"""SELECT session, kind, key, path AS snippet_path, n AS uses, entry FROM (SELECT c.session, {_KIND} AS kind, c.path AS key, c.path, count(*) AS n, min(c.rec_id) - 1 AS entry
FROM calls c JOIN results r ON c.session = r.session AND c.id = r.id WHERE c.path IS NOT NULL GROUP BY ALL) WHERE kind IN ('file.read', 'file.modified')"""
)
def q08_file_facts(spark, d):
    f = _extraction(spark, d, ("file.read", "file.modified")).facts.where("scope = 'cwd'")
    return f.select("session", "kind", "key", F.col("key").alias("snippet_path"), F.coalesce("edits", "reads").alias("uses"), "entry")


@query(
    """SELECT repo_name, doc_id, running::BIGINT AS bytes_before FROM (SELECT repo_name, doc_id, octet_length(encode(coalesce(text, ''))) AS size,
  coalesce(sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY repo_name ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running FROM documents) WHERE running + size <= 16384"""
)
def q09_pack_prefix(spark, d):
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    t = read(spark, d, "documents").select("repo_name", "doc_id", size.alias("size"))
    run = running_sum_before(t, ["repo_name"], ["doc_id"], "size", "bytes_before")
    return run.where(F.col("bytes_before") + F.col("size") <= fixed.PACK_BYTES).select("repo_name", "doc_id", "bytes_before")


@query(
    f"""WITH r AS (SELECT *, created_at::TIMESTAMP AS born, count(*) OVER w AS total, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) = 1 AS newest FROM manifest_snapshots WINDOW w AS (PARTITION BY session_id)),
c AS (SELECT *, NOT newest AND NOT coalesce(pinned, false) AS cand, NOT newest AND NOT coalesce(pinned, false) AND epoch_ms('{NOW}'::TIMESTAMP) - epoch_ms(born) > 259200000 AS aged FROM r),
n AS (SELECT *, sum(aged::INT) OVER (PARTITION BY session_id) AS aged_n, sum((cand AND NOT aged)::INT) OVER (PARTITION BY session_id ORDER BY created_at, id) AS rk FROM c)
SELECT session_id, id, hash, CASE WHEN aged THEN 'retention:age' ELSE 'retention:count' END AS reason FROM n WHERE aged OR (cand AND rk <= total - aged_n - 15)"""
)
def q10_retention_plan(spark, d):
    return store.retention_plan(read(spark, d, "manifest_snapshots"), NOW)


@query(
    """WITH t AS (SELECT DISTINCT session_id, sampled_at, used_tokens, context_limit_tokens, epoch FROM usage_telemetry WHERE used_tokens > 0 AND context_limit_tokens > 0 AND used_tokens <= context_limit_tokens AND epoch IS NOT NULL),
n AS (SELECT *, used_tokens * 1000000 // context_limit_tokens AS ppm, (epoch <> coalesce(lag(epoch) OVER w, 0))::INT AS new FROM t WINDOW w AS (PARTITION BY session_id ORDER BY sampled_at, used_tokens, context_limit_tokens, epoch)),
r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY sampled_at, used_tokens, context_limit_tokens, epoch) AS run FROM n)
SELECT session_id, sampled_at, epoch, ppm::BIGINT AS ppm FROM (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY sampled_at, used_tokens, context_limit_tokens, epoch) AS rn FROM r WHERE ppm >= 400000) WHERE rn = 1"""
)
def q11_guardrail(spark, d):
    t = read(spark, d, "usage_telemetry").distinct()
    fired = usage.guardrail(t, ["sampled_at", "used_tokens", "context_limit_tokens", "epoch"], threshold=400_000)  # the tables here hold no use above the default
    return fired.select("session_id", "sampled_at", "epoch", "ppm")


@query(
    """WITH RECURSIVE per AS (SELECT session_id, count(*) = count(DISTINCT hash) AND count(*) FILTER (previous_hash IS NULL) = 1 AND count(DISTINCT previous_hash) = count(*) - 1 AS one FROM manifest_snapshots GROUP BY 1),
walk AS (SELECT session_id, hash, 0 AS depth FROM manifest_snapshots WHERE previous_hash IS NULL
  UNION ALL SELECT m.session_id, m.hash, w.depth + 1 FROM manifest_snapshots m JOIN walk w ON m.session_id = w.session_id AND m.previous_hash = w.hash),
bad AS (SELECT DISTINCT session_id FROM manifest_snapshots m WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.session_id = m.session_id AND w.hash = m.hash))
SELECT m.session_id, m.hash, CASE WHEN one AND b.session_id IS NULL THEN w.depth::BIGINT END AS position, CASE WHEN one AND b.session_id IS NULL THEN 'whole' ELSE 'corrupt' END AS state
FROM manifest_snapshots m JOIN per USING (session_id) LEFT JOIN walk w ON w.session_id = m.session_id AND w.hash = m.hash LEFT JOIN bad b ON b.session_id = m.session_id"""
)
def q12_chain(spark, d):
    return store.chain(read(spark, d, "manifest_snapshots"))


@query(
    """WITH f AS (SELECT user_id, event_type, props->>'$.k' AS key, date_trunc('month', ts) AS m, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL),
p AS (SELECT *, dense_rank() OVER (ORDER BY m) AS pos FROM f), newest AS (SELECT user_id, max(pos) AS newest FROM p GROUP BY 1)
SELECT p.user_id::VARCHAR AS session, event_type AS kind, key, max(n)::BIGINT AS runs, arg_max(last, pos) AS last_event, max(pos) < any_value(newest) AS unbacked FROM p JOIN newest USING (user_id) GROUP BY p.user_id, event_type, key"""
)
def q13_chain_merge(spark, d):
    c = F.col
    e = read(spark, d, "events").select(c("user_id").cast("string").alias("session"), c("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("key"), F.date_trunc("month", "ts").alias("position"), "event_id")
    f = e.groupBy("session", "kind", "key", "position").agg(F.count("*").alias("runs"), F.max("event_id").alias("last_event")).withColumn("unbacked", F.lit(False))
    return store.merge_chain(f, ["runs"], ["last_event"])


_UUID = "lower(replace(replace(replace(replace(trim(uuid), '{', ''), '}', ''), '-', ''), 'urn:uuid:', ''))"


@query(
    f"""WITH t AS (SELECT {_UUID} AS session, received_at, rec_id, sha256(coalesce(message.content, '')) AS h FROM transcript WHERE uuid IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY received_at, rec_id) AS rn FROM t)
SELECT a.session, CASE WHEN bool_or(coalesce(a.h = b.h, false)) THEN 'backed' WHEN bool_or(b.h IS NOT NULL) THEN 'drifted' ELSE 'unbacked' END AS state
FROM r a LEFT JOIN r b ON a.session = b.session AND b.rn > 1 WHERE a.rn = 1 GROUP BY a.session"""
)
def q14_provenance(spark, d):
    """Is the first delivery of a record backed by a later one?"""
    from ledgerloom.functions.ids import uuid_key

    c = F.col
    t = read(spark, d, "transcript").where("uuid is not null").select(F.lower(F.hex(uuid_key(c("uuid")))).alias("session"), F.struct("received_at", "rec_id").alias("at"), F.sha2(F.coalesce("message.content", F.lit("")), 256).alias("sha256"))
    first = t.groupBy("session").agg(F.min_by(F.struct("at", "sha256"), "at").alias("f"))
    evidence = first.select("session", F.lit("record").alias("fact"), F.lit(1).alias("line"), c("f.sha256").alias("sha256"))
    later = t.join(first.select("session", c("f.at").alias("first_at")), "session").where("at > first_at").select("session", F.lit(1).alias("line"), "sha256")
    return store.provenance(evidence, later).select("session", "state")


@query(
    """SELECT doc_id, line, 'sha256:' || sha256(raw) AS sha256 FROM (SELECT doc_id, i AS line, l || CASE WHEN i < n THEN chr(10) ELSE '' END AS raw FROM
  (SELECT doc_id, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), unnest(ls) WITH ORDINALITY AS u(l, i)) WHERE raw <> ''"""
)
def q15_line_hash(spark, d):
    t = read(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("session"), F.col("text").cast("binary").alias("content"))
    return explode_lines(t).select(F.col("session").cast("long").alias("doc_id"), "line", "sha256")


@query(
    f"""SELECT session, token, first_line FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY first_line, token) AS rn FROM (SELECT user_id::VARCHAR AS session, 'record:' || event_type AS token, min(event_id) AS first_line
FROM events WHERE 'record:' || event_type NOT IN ({_LIST(Definition().shapes())}) GROUP BY ALL)) WHERE rn <= 8"""
)
def q16_undeclared_shapes(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("line"), mapper.shape_tokens(F.col("event_type")).alias("token"))
    return mapper.undeclared_shapes(e)


def _re2(rule: str, rules: dict[str, str] = scan.RULES) -> str:
    p = rules[rule].replace(scan._A, "(?:^|[^A-Za-z0-9_])").replace(scan._Z, "(?:$|[^A-Za-z0-9_])")
    return p.replace("'", "''")


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL) "
    + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM l WHERE regexp_matches(t, '{_re2(r)}') HAVING count(*) > 0" for r in scan.RULES)
)
def q17_privacy_scan(spark, d):
    f = scan.findings(read(spark, d, "documents"), "doc_id", F.col("text"))
    return f.groupBy("rule").agg(F.count("*").alias("lines"), F.count_distinct("doc_id").alias("docs"))


@query(
    _BLOCKS
    + """SELECT class, count(*) AS n FROM (SELECT CASE """
    + " ".join(f"WHEN starts_with(t, '{s}') THEN '{name}'" for name, starts in fixed.ERROR_CLASSES for s in starts)
    + """ ELSE 'unknown' END AS class FROM (SELECT lower(trim(CASE json_type(block, '$.content') WHEN 'VARCHAR' THEN block->>'$.content'
  WHEN 'ARRAY' THEN CASE WHEN len(block->>'$.content[*].text') = json_array_length(block, '$.content') THEN array_to_string(block->>'$.content[*].text', chr(10)) ELSE '' END ELSE '' END)) AS t
  FROM results WHERE failed)) GROUP BY class"""
)
def q18_error_classes(spark, d):
    r = _mapped(spark, d).results.where("is_error")
    return r.groupBy(text.error_class_column(F.col("text")).alias("class")).agg(F.count("*").alias("n"))


@query(
    """SELECT sessionId AS session, arg_min(cwd, rec_id) FILTER (cwd IS NOT NULL) AS cwd, arg_min(version, rec_id) FILTER (version IS NOT NULL) AS version
FROM transcript WHERE sessionId IS NOT NULL AND type IN ('user', 'assistant', 'system') AND (coalesce(subtype, '') <> 'compact_boundary' OR type <> 'system' OR compactMetadata IS NOT NULL)
  AND (NOT coalesce(isCompactSummary, false) OR type = 'system' OR message IS NOT NULL) GROUP BY 1"""
)
def q19_session_identity(spark, d):
    return _mapped(spark, d).identity().select("session", "cwd", "version")


@query(
    """WITH a AS (SELECT session_id, hash, id FROM manifest_snapshots WHERE created_at >= '2026-01-06T00:00:00Z'),
b AS (SELECT session_id, hash, coalesce(pinned, false) AS pinned FROM manifest_snapshots WHERE created_at < '2026-01-10T00:00:00Z')
SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.hash, b.hash) AS hash, a.id, coalesce(b.pinned, false) AS pinned,
  CASE WHEN a.hash IS NULL THEN 'gone' WHEN b.hash IS NULL THEN 'added' ELSE 'kept' END AS state FROM a FULL JOIN b ON a.session_id = b.session_id AND a.hash = b.hash"""
)
def q20_reconcile(spark, d):
    m = store.index_of(read(spark, d, "manifest_snapshots"))
    return store.reconcile(m.where("created_at >= '2026-01-06T00:00:00Z'"), m.where("created_at < '2026-01-10T00:00:00Z'"))


@query(
    """SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('arm:' || p_partkey::VARCHAR))::INT AS place FROM part"""
)
def q21_seeded_order(spark, d):
    return scan.seeded_order(read(spark, d, "part").select("p_brand", "p_partkey"), "arm", F.col("p_partkey"), ["p_brand"])


@query(
    """WITH r AS (SELECT *, CASE WHEN hook_event_name = 'PreCompact' THEN 1 WHEN hook_event_name = 'SessionStart' AND source IN ('compact', 'resume') THEN 0 END AS p FROM hook_input WHERE session_id IS NOT NULL)
SELECT hook_id, session_id, CASE WHEN p = 1 THEN 'checkpoint' WHEN source = 'resume' OR last = 1 THEN 'deliver' ELSE 'suppress' END AS action FROM
  (SELECT *, lag(p) OVER (PARTITION BY session_id ORDER BY received_at, hook_id) AS last FROM r WHERE p IS NOT NULL)
UNION ALL SELECT hook_id, session_id, 'none' FROM r WHERE p IS NULL"""
)
def q22_hook_actions(spark, d):
    return usage.hook_actions(read(spark, d, "hook_input"), ["received_at", "hook_id"]).select("hook_id", "session_id", "action")


@query(
    """SELECT session_id, array_to_string(list_sort(list_distinct(flatten(list(degraded)))), ',') AS degraded, max(created_at) AS newest, count(*) AS snapshots FROM manifest_snapshots GROUP BY 1"""
)
def q23_degraded_union(spark, d):
    s = read(spark, d, "manifest_snapshots")
    n = s.groupBy("session_id").agg(F.max("created_at").alias("newest"), F.count("*").alias("snapshots"))
    return store.degraded_union(s).join(n, "session_id").select("session_id", F.array_join("degraded", ",").alias("degraded"), "newest", "snapshots")


@query()
def q24_payloads(spark, d):
    """The whole engine: every session's payload hash and size."""
    x = _extraction(spark, d)
    return x.payloads(_record_lines(spark, d)).select("session", "hash", "payload_bytes")


@query()
def q25_packs(spark, d):
    """Every session's facts as a pack within the byte budget."""
    x = _extraction(spark, d)
    p = x.payloads(_record_lines(spark, d), degraded=[])
    return p.select("session", F.octet_length("pack").alias("pack_bytes"), "pack")


_SAFE = "CASE WHEN regexp_full_match({0}, '[A-Za-z0-9_-]{{1,64}}') THEN {0} ELSE '<other>' END"
_STR = "CASE WHEN json_type(b, '$.{0}') = 'VARCHAR' THEN b->>'$.{0}' END"


@query(
    _BLOCKS
    + f""", t AS (SELECT *, type = 'system' AND coalesce(subtype, '') = 'compact_boundary' AS edge, type IN ('user', 'assistant') AND coalesce(isCompactSummary, false) AS summary FROM transcript WHERE sessionId IS NOT NULL),
ac AS (SELECT session, rec_id, i, b, {_STR.format("id")} AS id, {_STR.format("name")} AS name, {_STR.format("input.command")} AS command, {_STR.format("input.file_path")} AS path, {_STR.format("input.subject")} AS subject, {_STR.format("input.status")} AS status,
  CASE WHEN regexp_full_match(b->>'$.input.taskId', '[0-9]{{1,15}}') THEN b->>'$.input.taskId' END AS item FROM blocks WHERE b->>'$.type' = 'tool_use' AND json_type(b, '$.id') = 'VARCHAR' AND json_type(b, '$.name') = 'VARCHAR'),
fc AS (SELECT *, row_number() OVER (PARTITION BY session, id ORDER BY rec_id, i) AS rn FROM ac),
fr AS (SELECT x.session, x.rec_id, x.b->>'$.tool_use_id' AS id, row_number() OVER (PARTITION BY x.session, x.b->>'$.tool_use_id' ORDER BY x.rec_id, x.i) AS rn,
  CASE WHEN regexp_full_match(o.toolUseResult::JSON->>'$.task.id', '[0-9]{{1,15}}') THEN o.toolUseResult::JSON->>'$.task.id' END AS item FROM blocks x JOIN transcript o USING (rec_id) WHERE x.b->>'$.type' = 'tool_result' AND json_type(x.b, '$.tool_use_id') = 'VARCHAR'),
pc AS (SELECT c.*, r.id IS NOT NULL AS observed, r.item AS made FROM fc c LEFT JOIN fr r ON r.session = c.session AND r.id = c.id AND r.rn = 1 WHERE c.rn = 1),
odd AS (SELECT sessionId AS session, 'conversational-content-not-text' AS code, type AS detail FROM t WHERE edge AND compactMetadata IS NULL OR NOT edge AND type IN ('user', 'assistant', 'system') AND message IS NULL
  UNION ALL SELECT sessionId, 'unknown-record-type', {_SAFE.format("type")} FROM t WHERE NOT edge AND NOT summary AND type NOT IN ({_LIST((*fixed.CONVERSATIONAL, *fixed.NON_CONVERSATIONAL))})
  UNION ALL SELECT session, 'unknown-content-block', CASE WHEN json_type(b) = 'OBJECT' AND json_type(b, '$.type') = 'VARCHAR' THEN {_SAFE.format("(b->>'$.type')")} ELSE '<other>' END FROM blocks
    WHERE json_type(b) <> 'OBJECT' OR coalesce(b->>'$.type', '') NOT IN ('tool_use', 'tool_result', 'text', 'thinking', 'redacted_thinking') OR b->>'$.type' = 'tool_result' AND coalesce(json_type(b, '$.tool_use_id'), '') <> 'VARCHAR'
  UNION ALL SELECT session, 'tool-input-shape', 'tool_use' FROM blocks WHERE b->>'$.type' = 'tool_use' AND (coalesce(json_type(b, '$.id'), '') <> 'VARCHAR' OR coalesce(json_type(b, '$.name'), '') <> 'VARCHAR')
  UNION ALL SELECT session, 'tool-result-not-text', 'content' FROM blocks WHERE b->>'$.type' = 'tool_result' AND json_type(b, '$.tool_use_id') = 'VARCHAR' AND NOT coalesce(json_type(b, '$.content') = 'VARCHAR'
    OR json_type(b, '$.content') = 'ARRAY' AND len(list_filter(json_type(b, '$.content[*].text'), lambda y: y = 'VARCHAR')) = json_array_length(b, '$.content'), false)
  UNION ALL SELECT session, 'tool-input-shape', 'duplicate-call-id' FROM fc WHERE rn > 1 UNION ALL SELECT session, 'tool-input-shape', 'duplicate-result-id' FROM fr WHERE rn > 1
  UNION ALL SELECT session, 'tool-call-without-result', {_SAFE.format("name")} FROM pc WHERE NOT observed
  UNION ALL SELECT session, 'tool-result-without-call', 'result' FROM fr WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM fc WHERE fc.session = fr.session AND fc.id = fr.id)
  UNION ALL SELECT session, 'tool-input-shape', 'bash-command' FROM pc WHERE name = 'Bash' AND command IS NULL
  UNION ALL SELECT session, 'tool-input-shape', 'file-path' FROM pc WHERE name IN ('Read', 'Write', 'Edit') AND path IS NULL
  UNION ALL SELECT session, 'tool-input-shape', 'task-subject' FROM pc WHERE name = 'TaskCreate' AND observed AND subject IS NULL
  UNION ALL SELECT session, 'task-result-shape', 'task-create' FROM pc WHERE name = 'TaskCreate' AND observed AND subject IS NOT NULL AND made IS NULL
  UNION ALL SELECT session, 'tool-input-shape', 'task-update' FROM pc WHERE name = 'TaskUpdate' AND observed AND (status IS NULL OR item IS NULL)
  UNION ALL SELECT session, 'task-status-unknown', {_SAFE.format("status")} FROM pc WHERE name = 'TaskUpdate' AND observed AND status IS NOT NULL AND item IS NOT NULL AND status NOT IN ('completed', 'pending', 'in_progress'))
SELECT code, detail, count(*) AS n, count(DISTINCT session) AS sessions FROM odd GROUP BY ALL"""
)
def q26_diagnostics(spark, d):
    return _mapped(spark, d).diagnostics().groupBy("code", "detail").agg(F.count("*").alias("n"), F.count_distinct("session").alias("sessions"))


@query(
    "WITH RECURSIVE" + SQL["q12_chain"].removeprefix("WITH RECURSIVE").replace("SELECT m.session_id, m.hash, CASE", ", chain AS (SELECT m.session_id, m.hash, CASE", 1)
    + """) SELECT m.session_id, count(*) AS usable, count(*) FILTER (NOT regexp_full_match(m.hash, 'sha256:[0-9a-f]{64}') OR strftime(created_at::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') <> created_at OR m.id <> created_at || '|' || m.hash OR facts < 0) AS quarantined, max(created_at) AS newest, arg_max(m.hash, created_at || m.id) AS newest_hash, min(c.state) AS chain,
  array_to_string(list_sort(list_distinct(flatten(list(degraded)))), ',') AS degraded, min(c.state) = 'whole' AS healthy, CASE WHEN min(c.state) <> 'whole' THEN 3 WHEN len(list_filter(flatten(list(degraded)), lambda x: x <> 'ok')) > 0 THEN 4 ELSE 0 END AS exit_code FROM manifest_snapshots m JOIN chain c ON m.session_id = c.session_id AND m.hash = c.hash GROUP BY m.session_id"""
)
def q27_doctor(spark, d):
    s = store.doctor(read(spark, d, "manifest_snapshots"))
    return s.withColumn("degraded", F.array_join("degraded", ","))


@query()
def q28_facts(spark, d):
    """All merged facts, in canonical order columns."""
    f = _extraction(spark, d).facts
    return f.select("session", "kind", "key", "scope", "entry", "ts", "snippet", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"), *extract._SUMS)


@query(
    """WITH l AS (SELECT doc_id, i, rtrim(l, chr(13)) AS t, l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(ls) WITH ORDINALITY AS u(l, i)),
m AS (SELECT *, starts_with(t, 'diff --git ') AS head, regexp_matches(l, '^@@ -[0-9]+(,[0-9]+)? \\+[0-9]+(,[0-9]+)? @@') AS hunk, starts_with(l, chr(92)) AS mark FROM l),
b AS (SELECT *, head OR hunk OR NOT (mark OR starts_with(l, '+') OR starts_with(l, ' ') OR starts_with(l, '-')) AS edge FROM m),
g AS (SELECT *, sum(edge::INT) OVER w AS part, max(CASE WHEN head THEN i END) OVER w AS file_at FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT *, bool_or(hunk) OVER (PARTITION BY doc_id, part) AS in_hunk, max(CASE WHEN hunk THEN regexp_extract(l, '\\+([0-9]+)', 1)::BIGINT END) OVER (PARTITION BY doc_id, part) AS start,
  sum((NOT edge AND NOT mark AND NOT starts_with(l, '-'))::INT) OVER (PARTITION BY doc_id, part ORDER BY i) AS n FROM g)
SELECT h.doc_id, regexp_extract(f.t, '.* b/(.*)$', 1) AS file, (start + n - 1)::BIGINT AS line, h.l[2:] AS text FROM h LEFT JOIN l f ON f.doc_id = h.doc_id AND f.i = h.file_at
WHERE in_hunk AND NOT edge AND starts_with(h.l, '+')"""
)
def q29_patch_lines(spark, d):
    """The lines that the commits of the corpus add."""
    from ledgerloom.sources.files import added_lines

    return added_lines(read(spark, d, "documents"), F.col("doc_id"), F.col("text")).select(F.col("k").alias("doc_id"), "file", "line", "text")


@query(
    """WITH f AS (SELECT file_id, min(body->>'$.version') AS version, array_to_string(list_sort(list_distinct(list('record:' || (body->>'$.type')))), ',') AS shapes, count(*) AS lines FROM transcript_files GROUP BY file_id)
SELECT * FROM f"""
)
def q30_shape_sets(spark, d):
    """The set of record shapes in each file."""
    from ledgerloom.operators.verify import shape_set

    c = F.col
    t = read(spark, d, "transcript_files").select(c("file_id").alias("session"), F.get_json_object("body", "$.type").alias("type"), F.get_json_object("body", "$.version").alias("version"))
    sets = shape_set(t.select("session", mapper.shape_tokens(c("type")).alias("token")))
    n = t.groupBy("session").agg(F.min("version").alias("version"), F.count("*").alias("lines"))
    return sets.join(n, "session").select(c("session").alias("file_id"), "version", F.array_join("shapes", ",").alias("shapes"), "lines")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{h}')" for n, (_, h) in vectors.VECTORS.items()) + ") AS v(name, hash)")
def q31_known_payloads(spark, d):
    """Normalised events whose payload hashes are known, through the whole engine."""
    return vectors.payloads(spark).select(F.col("session").alias("name"), "hash")


@query(SQL["q14_provenance"].replace("SELECT a.session, CASE", "SELECT session, count(*) FILTER (state = 'backed') AS backed, count(*) FILTER (state = 'drifted') AS drifted, count(*) FILTER (state = 'unbacked') AS unbacked, bool_and(state = 'backed') AS whole FROM (SELECT a.session, CASE") + ") GROUP BY session")
def q32_provenance_counts(spark, d):
    """Facts by how their evidence stands, per session."""
    return store.provenance_counts(q14_provenance(spark, d))


@query("SELECT repo_name AS path, label FROM (SELECT repo_name, label, bool_or(hit) AS hit FROM (" + " UNION ALL ".join(f"SELECT repo_name, '{n}' AS label, regexp_matches(text, '{_re2(n, scan.FILE_RULES)}') AS hit FROM documents WHERE text IS NOT NULL" for n in scan.FILE_RULES) + ") GROUP BY ALL) WHERE hit")
def q33_file_scan(spark, d):
    """Repositories whose documents break a rule of publication."""
    return scan.file_findings(read(spark, d, "documents"), "repo_name", F.col("text")).distinct()
