"""Registered queries of the general training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import dedupe, drift, hierarchy, nested, rejects
from ledgerloom.runtime import read

PARENTS = ["parentUuid", "logicalParentUuid"]
ORDER = ["received_at", "rec_id"]


def _forest(spark: SparkSession, d: str, with_path: bool = False) -> DataFrame:
    return hierarchy.resolve_hierarchy(read(spark, d, "transcript"), "uuid", PARENTS, ORDER, with_path)


def p1_found(spark, d):
    return hierarchy.faulty_links(_forest(spark, d))


def p1_tree(spark, d):
    # a component's name is whichever of its nodes the contraction ends at; all else is fixed
    return hierarchy.tree_table(_forest(spark, d, with_path=True)).drop("component")


def p6_found(spark, d):
    return dedupe.copy_pairs(read(spark, d, "transcript"), order=ORDER[:1])


def p6_deduplicated(spark, d):
    whole = dedupe.deduplicate(spark, f"{d}/transcript.parquet", ORDER)
    return whole.select(*[F.col(c).alias(n) for n, c in _KEPT.items()])


# every column that stays, structs taken apart
_KEPT = {c: c for c in "rec_id batch_id received_at type subtype uuid parentUuid logicalParentUuid sessionId requestId cwd version gitBranch timestamp isSidechain isCompactSummary toolUseResult".split()}
_KEPT |= {f"compact_{c}": f"compactMetadata.{c}" for c in "trigger preTokens postTokens durationMs".split()}
_KEPT |= {f"message_{c}": f"message.{c}" for c in "id role model stop_reason content".split()} | {f"attachment_{c}": f"attachment.{c}" for c in ("type", "text")}


def _shred(spark, d):
    c = F.col
    return nested.shred(read(spark, d, "transcript"), c("rec_id"), c("message.content"), c("toolUseResult"), c("compactMetadata"))


def p2_found(spark, d):
    return nested.parts(*_shred(spark, d))


def p2_objects(spark, d):
    objects, _ = _shred(spark, d)
    return objects.select(F.lower(F.hex("hash")).alias("object_id"), "kind", "item_id", "body")


def p2_bridge(spark, d):
    _, bridge = _shred(spark, d)
    ids = [F.lower(F.hex(k)).alias(n) for k, n in (("parent", "parent_id"), ("hash", "object_id"))]
    return bridge.select("rec_id", "part", "pos", "sub_pos", "path", "depth", "ordinal", "at", "parent_at", *ids)


def p5_found(spark, d):
    return drift.report(read(spark, d, "transcript_files"), F.col("body"))


def p5_unified(spark, d):
    return drift.unify(read(spark, d, "transcript_files"), F.col("body"), ["file_id", "line_no"])


def _lines(spark, d):
    return rejects.load_lines(read(spark, d, "transcript_raw"), F.col("line_id"), F.col("file_name"), F.col("raw"))


def p7_found(spark, d):
    return rejects.rejected(_lines(spark, d))


def p7_loaded(spark, d):
    return rejects.accepted(_lines(spark, d))


# the united table of the tables here, whose renames and types are written out: column, where it
# stands in the records (the later name first), and its SQL type if it is not text
_COLUMNS = [
    *((f, [f], "") for f in ("content", "entrypoint", "gitBranch", "message.content", "message.id", "message.model", "message.role", "mode", "operation", "permissionMode", "permissionMode.value")),
    *((f, [f], "") for f in ("promptId", "requestId", "requestId.value", "sessionId", "slug", "subtype", "summary", "timestamp", "turns", "type", "uuid")),
    *((f"attachment.{f}", [f"attachment.{f}"], "") for f in ("displayed", "range.value", "skills", "text", "tools", "tools.value", "type")),
    *((f, [f], "BIGINT") for f in ("costMs", "effort", "level", "message.usage.cache_tokens", "message.usage.output_tokens", "permissionMode.weight", "priority", "requestId.weight")),
    *((f"attachment.{f}", [f"attachment.{f}"], "BIGINT") for f in ("count", "lines", "range.weight", "ratio", "tools.weight", "used")),
    *((f, [f], "BOOLEAN") for f in ("isMeta", "isVisible")),
    ("attachment.context_limit_tokens", ["attachment.context_limit_tokens", "attachment.limit"], "BIGINT"),
    ("attachment.filePath", ["attachment.filePath", "attachment.path"], ""),
    ("duration_ms", ["duration_ms", "durationMs"], ""),
    ("git_branch", ["git_branch"], ""),
    ("leaf_id", ["leaf_id", "leafUuid"], ""),
    ("message.usage.inputTokens", ["message.usage.inputTokens", "message.usage.input_tokens"], "BIGINT"),
    ("user_kind", ["user_kind", "userType"], ""),
]


def _column_sql(name: str, places: list[str], kind: str) -> str:
    # the user's branch alone was renamed; an object's own columns hold what is in it
    texts = [f"CASE WHEN json_type(b, '$.{p}') <> 'OBJECT' THEN b->>'$.{p}' END" for p in places]
    text = f"coalesce({', '.join(texts)})" if len(texts) > 1 else texts[0]
    if name == "gitBranch":
        text = "CASE WHEN t <> 'user' THEN b->>'$.gitBranch' END"
    if name == "git_branch":
        text = "CASE WHEN t = 'user' THEN coalesce(b->>'$.git_branch', b->>'$.gitBranch') END"
    return f"TRY_CAST({text} AS {kind}) AS \"{name}\"" if kind else f'{text} AS "{name}"'


QUERIES = {f.__name__: f for f in (p1_found, p1_tree, p2_found, p2_objects, p2_bridge, p5_found, p5_unified, p6_found, p6_deduplicated, p7_found, p7_loaded)}
_KEY = "lower(replace(replace(replace(replace(replace(trim({0}), '{{', ''), '}}', ''), '-', ''), ' ', ''), 'urn:uuid:', ''))"
_NODES = f"""WITH RECURSIVE t AS (SELECT CASE WHEN trim(uuid) <> '' THEN {_KEY.format("lower(uuid)")} END AS u,
  CASE WHEN trim(parentUuid) <> '' THEN {_KEY.format("lower(parentUuid)")} WHEN trim(logicalParentUuid) <> '' THEN {_KEY.format("lower(logicalParentUuid)")} END AS p, received_at, rec_id FROM transcript),
n AS (SELECT u, p FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY received_at, rec_id) AS rn FROM t WHERE u IS NOT NULL) WHERE rn = 1)"""
_TEXT = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21)"

# rows with their identities, the links between copies, and everything a row is linked to
_COPIES = f"""WITH RECURSIVE t AS (SELECT rec_id, CASE WHEN trim(uuid) <> '' THEN {_KEY.format("lower(uuid)")} END AS u, CASE WHEN message.id IS NOT NULL AND requestId IS NOT NULL THEN
  message.id || chr(1) || requestId || chr(1) || coalesce((SELECT string_agg(j.fullkey || '=' || coalesce(j.atom::VARCHAR, j.type), chr(2) ORDER BY j.fullkey) FROM json_tree(message.content::JSON) j), 'null') END AS k FROM transcript),
e AS (SELECT a.rec_id AS x, b.rec_id AS y FROM t a JOIN t b ON a.u = b.u AND a.rec_id <> b.rec_id
  UNION SELECT a.rec_id, b.rec_id FROM t a JOIN t b ON a.k = b.k AND a.rec_id <> b.rec_id WHERE a.u IS NULL OR b.u IS NULL),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)"""

_CELL = '("(?:[^"]|"")*"|[^",]*)'
_ROW = ",".join([_CELL] * 6)


def _unquoted(i: int) -> str:
    f = f"regexp_extract(raw, '(?s)^{_ROW}$', {i})"
    return f"CASE WHEN starts_with({f}, chr(34)) THEN replace({f}[2:-2], chr(34) || chr(34), chr(34)) ELSE {f} END"


def _values(u: str, s: str, t: str, k: str) -> str:
    when = "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{3})?Z"
    ids = " AND ".join(f"regexp_full_match({x}, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}')" for x in (u, s))
    return f"{ids} AND regexp_full_match({t}, '{when}') AND TRY_CAST({t} AS TIMESTAMP) IS NOT NULL AND {k} IN ({', '.join(map(repr, rejects.TYPES))})"


# DuckDB's parser also takes commas before a closing bracket and NaN, which are looked for outside strings
_LINES = f"""WITH r AS (SELECT line_id, raw, ends_with(lower(file_name), '.csv') AS csv FROM transcript_raw),
k AS (SELECT line_id, regexp_full_match(raw, '(?s){_CELL}(?:,{_CELL})*') AS whole, regexp_full_match(raw, '(?s){_ROW}') AS six, {", ".join(f"{_unquoted(i)} AS f{i}" for i in range(1, 7))} FROM r WHERE csv AND raw IS NOT NULL),
j AS (SELECT line_id, CASE WHEN json_valid(raw) AND NOT regexp_matches(regexp_replace(raw, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g'), ',\\s*[}}\\]]|NaN|Inf|inf|nan') THEN raw::JSON END AS o FROM r WHERE NOT csv AND raw IS NOT NULL),
h AS (SELECT *, coalesce(json_type(o) = 'OBJECT' AND {" AND ".join(f"json_exists(o, '$.{k}')" for k in ("uuid", "sessionId", "timestamp", "type", "message"))} AND json_type(o, '$.message') = 'OBJECT' AND json_exists(o, '$.message.content'), false) AS keys FROM j)"""
SQL: dict[str, str] = {
    "p1_found": f"""{_NODES},
walk AS (SELECT u AS start, p AS cur FROM n WHERE p IN (SELECT u FROM n) UNION SELECT w.start, n.p FROM walk w JOIN n ON n.u = w.cur WHERE n.p IN (SELECT u FROM n)),
ring AS (SELECT DISTINCT start FROM walk WHERE start = cur)
SELECT {_TEXT.format("n.u")} AS uuid, CASE WHEN n.u IN (SELECT start FROM ring) THEN 'cycle' WHEN n.u IN (SELECT start FROM walk WHERE cur IN (SELECT start FROM ring)) THEN 'under_cycle' ELSE 'dangling' END AS kind
FROM n WHERE n.u IN (SELECT start FROM ring) OR n.u IN (SELECT start FROM walk WHERE cur IN (SELECT start FROM ring)) OR (n.p IS NOT NULL AND n.p NOT IN (SELECT u FROM n))""",
    "p2_found": """WITH c AS (SELECT rec_id, CASE json_type(message.content) WHEN 'ARRAY' THEN message.content::JSON WHEN 'OBJECT' THEN json_array(message.content::JSON) END AS a FROM transcript WHERE message.content IS NOT NULL),
b AS (SELECT rec_id, i AS pos, json_extract(a, '$[' || i || ']') AS b FROM c, range(json_array_length(a)::BIGINT) AS r(i) WHERE a IS NOT NULL),
e AS (SELECT rec_id, pos, i AS sub_pos, json_extract(b, '$.content[' || i || ']') AS x FROM b, range(json_array_length(b, '$.content')::BIGINT) AS r(i) WHERE json_type(b, '$.content') = 'ARRAY')
SELECT rec_id, 'content' AS part, pos, -1::BIGINT AS sub_pos, coalesce(b->>'$.type', '') AS kind, coalesce(b->>'$.id', b->>'$.tool_use_id', '') AS item_id FROM b
UNION ALL SELECT rec_id, 'content', pos, sub_pos, coalesce(x->>'$.type', ''), '' FROM e
UNION ALL SELECT rec_id, 'result', -1, -1, coalesce(toolUseResult->>'$.type', ''), '' FROM transcript WHERE toolUseResult IS NOT NULL AND json_type(toolUseResult) = 'OBJECT'
UNION ALL SELECT rec_id, 'compact', -1, -1, coalesce(compactMetadata.trigger, ''), '' FROM transcript WHERE compactMetadata IS NOT NULL""",
    # a component holds the trees below one missing parent, or one tree, or one ring and what hangs on it
    "p1_tree": f"""{_NODES},
l AS (SELECT n.u, n.p, CASE WHEN n.p IN (SELECT u FROM n) THEN n.p END AS up FROM n),
walk AS (SELECT u AS start, up AS cur FROM l WHERE up IS NOT NULL UNION SELECT w.start, l.up FROM walk w JOIN l ON l.u = w.cur WHERE l.up IS NOT NULL),
ring AS (SELECT start AS u, min(cur) AS head FROM walk WHERE start IN (SELECT start FROM walk WHERE start = cur) GROUP BY start),
f AS (SELECT l.u, l.p, l.up, CASE WHEN ring.head = l.u THEN NULL ELSE l.up END AS above, ring.u IS NOT NULL AS ringed FROM l LEFT JOIN ring ON ring.u = l.u),
tr AS (SELECT u, u AS root, 0 AS depth, {_TEXT.format("u")} AS path, ringed AS circled, coalesce(CASE WHEN NOT ringed THEN p END, u) AS comp FROM f WHERE above IS NULL
  UNION ALL SELECT f.u, tr.root, tr.depth + 1, tr.path || '/' || {_TEXT.format("f.u")}, tr.circled, tr.comp FROM f JOIN tr ON f.above = tr.u),
below AS (SELECT a AS node, count(*) - 1 AS n FROM (SELECT unnest(string_split(path, '/')) AS a FROM tr) GROUP BY a)
SELECT {_TEXT.format("f.u")} AS uuid, {_TEXT.format("f.p")} AS parent_uuid, {_TEXT.format("tr.root")} AS root_uuid, tr.depth::BIGINT AS depth,
  CASE WHEN f.ringed THEN 'cycle' WHEN tr.circled THEN 'under_cycle' WHEN f.p IS NULL THEN 'root' WHEN f.up IS NULL THEN 'dangling' ELSE 'node' END AS kind, below.n AS descendants,
  row_number() OVER (PARTITION BY tr.comp ORDER BY tr.path) - 1 AS pre, row_number() OVER (PARTITION BY tr.comp ORDER BY tr.path) - 1 + below.n AS last, tr.path
FROM f JOIN tr ON tr.u = f.u JOIN below ON below.node = {_TEXT.format("f.u")}""",
    "p6_deduplicated": f"""{_COPIES} SELECT {", ".join(f"a.{c} AS {n}" for n, c in _KEPT.items())} FROM transcript a
WHERE NOT EXISTS (SELECT 1 FROM r JOIN transcript o ON o.rec_id = r.y WHERE r.x = a.rec_id AND (o.received_at < a.received_at OR o.received_at = a.received_at AND o.rec_id < a.rec_id))""",
    "p6_found": f"""{_COPIES} SELECT x AS rec_id_1, y AS rec_id_2 FROM r WHERE x < y""",
    # renames where one field goes and one of its type comes, as in these tables; the operator also tells several apart
    "p5_found": """WITH f AS (SELECT body::JSON AS b, body->>'$.version' AS v, CASE WHEN body->>'$.type' = 'attachment' THEN 'attachment/' || (body->>'$.attachment.type') ELSE body->>'$.type' END AS t FROM transcript_files),
n AS (SELECT v, row_number() OVER (ORDER BY list_transform(string_split(v, '.'), lambda x: x::INT)) AS k FROM (SELECT DISTINCT v FROM f)),
y AS (SELECT DISTINCT t, k FROM f JOIN n USING (v)),
s AS (SELECT DISTINCT t, k, substr(j.fullkey, 3) AS p, CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS jt
  FROM f JOIN n USING (v), json_tree(f.b) j WHERE j.fullkey <> '$' AND NOT contains(j.fullkey, '[') AND j.type <> 'NULL'),
o AS (SELECT s.t, s.k + 1 AS k, p, jt FROM s), dd AS (SELECT a.t, a.k FROM y a JOIN y b ON a.t = b.t AND b.k = a.k - 1),
gone AS (SELECT o.t, o.k, o.p, o.jt FROM o JOIN dd USING (t, k) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.t = o.t AND s.k = o.k AND s.p = o.p)),
come AS (SELECT s.t, s.k, s.p, s.jt FROM s JOIN dd USING (t, k) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.t = s.t AND o.k = s.k AND o.p = s.p)),
turn AS (SELECT DISTINCT s.t, s.k, s.p FROM s JOIN dd USING (t, k) JOIN o ON o.t = s.t AND o.k = s.k AND o.p = s.p WHERE NOT EXISTS (SELECT 1 FROM o q WHERE q.t = s.t AND q.k = s.k AND q.p = s.p AND EXISTS (SELECT 1 FROM s z WHERE z.t = q.t AND z.k = q.k AND z.p = q.p AND z.jt = q.jt))),
moved AS (SELECT t, k, p FROM gone UNION SELECT t, k, p FROM come UNION SELECT t, k, p FROM turn),
g AS (SELECT * FROM gone x WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.t = x.t AND m.k = x.k AND starts_with(x.p, m.p || '.'))),
c AS (SELECT * FROM come x WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.t = x.t AND m.k = x.k AND starts_with(x.p, m.p || '.'))),
ren AS (SELECT g.t, g.k, g.p, c.p AS q FROM g JOIN c ON g.t = c.t AND g.k = c.k AND g.jt = c.jt),
ch AS (SELECT t, k, p, 'renamed' AS c, q FROM ren
  UNION ALL SELECT t, k, p, 'removed', '' FROM g WHERE (t, k, p) NOT IN (SELECT (t, k, p) FROM ren)
  UNION ALL SELECT t, k, p, 'added', '' FROM c WHERE (t, k, p) NOT IN (SELECT (t, k, q) FROM ren)
  UNION ALL SELECT t, k, p, 'retyped', '' FROM turn x WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.t = x.t AND m.k = x.k AND starts_with(x.p, m.p || '.'))
  UNION ALL SELECT t, k, '', 'type_added', '' FROM y a WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM y b WHERE b.t = a.t AND b.k = a.k - 1)
  UNION ALL SELECT t, k + 1, '', 'type_removed', '' FROM y a WHERE k < (SELECT max(k) FROM n) AND NOT EXISTS (SELECT 1 FROM y b WHERE b.t = a.t AND b.k = a.k + 1))
SELECT t AS record_type, p AS field, c AS change, n.v AS version, q AS new_field FROM ch JOIN n USING (k)""",
    "p5_unified": f"""SELECT file_id, line_no, t AS record_type, b->>'$.version' AS version, {", ".join(_column_sql(*c) for c in _COLUMNS)},
  CASE WHEN json_type(b, '$.level') = 'VARCHAR' AND TRY_CAST(b->>'$.level' AS BIGINT) IS NULL THEN '{{"level":' || (b->'$.level')::VARCHAR || '}}' END AS misfits
FROM (SELECT file_id, line_no, body::JSON AS b, CASE WHEN body->>'$.type' = 'attachment' THEN 'attachment/' || (body->>'$.attachment.type') ELSE body->>'$.type' END AS t FROM transcript_files)""",
    "p7_found": f"""{_LINES},
x AS (SELECT line_id, CASE WHEN NOT whole THEN 'syntax' WHEN NOT six THEN 'columns' WHEN NOT ({_values("f1", "f2", "f3", "f4")} AND f5 IN ('user', 'assistant', 'system', '')) THEN 'value' END AS reason FROM k
UNION ALL SELECT line_id, CASE WHEN o IS NULL THEN 'syntax' WHEN NOT keys THEN 'columns' WHEN NOT coalesce({" AND ".join(f"json_type(o, '$.{k}') = 'VARCHAR'" for k in ("uuid", "sessionId", "timestamp", "type"))} AND {_values(*[f"(o->>'$.{k}')" for k in ("uuid", "sessionId", "timestamp", "type")])}
  AND (json_type(o, '$.message.content') = 'VARCHAR' OR json_type(o, '$.message.content') = 'ARRAY' AND len(list_filter(json_type(o, '$.message.content[*]'), lambda y: y <> 'OBJECT')) = 0), false) THEN 'value' END FROM h
UNION ALL SELECT line_id, 'syntax' FROM r WHERE raw IS NULL) SELECT line_id, reason FROM x WHERE reason IS NOT NULL""",
    "p7_loaded": f"""{_LINES},
bad AS ({{found}})
SELECT line_id, f1 AS uuid, f2 AS sessionId, f3 AS timestamp, f4 AS type, f5 AS role, f6 AS content FROM k WHERE line_id NOT IN (SELECT line_id FROM bad)
UNION ALL SELECT line_id, o->>'$.uuid', o->>'$.sessionId', o->>'$.timestamp', o->>'$.type', o->>'$.message.role', o->>'$.message.content' FROM h WHERE line_id NOT IN (SELECT line_id FROM bad)""",
}
SQL["p7_loaded"] = SQL["p7_loaded"].replace("{found}", SQL["p7_found"].partition("keys FROM j),")[2].replace("x AS (", "WITH x AS (", 1))
