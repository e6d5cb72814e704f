"""Checks on what was produced: payloads, bindings, declared shapes, phrases and reports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions.canon import canonical, digest, ppm
from ledgerloom.functions.text import score_text
from ledgerloom.sources.definition import Definition

_HASH = "^sha256:[0-9a-f]{64}$"
_NEEDED = {
    "cmd.run": ("runs", "failed"), "cmd.failed": ("runs", "last_error_class"), "error.raised": ("count", "class"), "error.fixed": ("count", "fixed_by"), "file.modified": ("edits", "tools"),
    "file.read": ("reads",), "decision.stated": ("cue",), "todo.state": ("text",), "plan.state": ("todos", "done"),
}


class Refused(ValueError):
    """A request that must not be answered by guessing."""


def payload_fault(text: str, claimed: str | None = None) -> str | None:
    """The first reason why a payload cannot be used, or None."""
    try:
        p = json.loads(text)
    except ValueError:
        return "json"
    if not isinstance(p, dict) or set(p) != {"facts", "counters", "git", "plan", "path_base", "version"}:
        return "fields"
    if p["version"] != 1 or p["path_base"] not in ("repo", "cwd"):
        return "version"
    by: dict[str, int] = {}
    for f in p["facts"]:
        if f.get("kind") not in fixed.PRIORITY or not isinstance(f.get("key"), str):
            return "kind"
        if f.get("scope") not in (None, *fixed.SCOPES):
            return "scope"
        if not isinstance(f.get("at", {}).get("entry"), int) or f["at"]["entry"] < 0:
            return "entry"
        ev = f.get("evidence", [])
        if len(ev) > fixed.EVIDENCE or any(e["line"] < 1 or len(e["sha256"]) != 71 for e in ev):
            return "evidence"
        if any(a not in f.get("attrs", {}) for a in _NEEDED.get(f["kind"], ())):
            return "attrs"
        by[f["kind"]] = by.get(f["kind"], 0) + 1
    n = p["counters"]
    external = sum(f.get("scope") == "external" for f in p["facts"])
    if n["facts"] != len(p["facts"]) or n["by_kind"] != by or n["external_path_count"] != external or not 0 <= n["coverage_ppm"] <= 1_000_000:
        return "counters"
    try:
        if claimed is not None and digest(canonical(p)) != claimed:
            return "hash"
    except TypeError:
        return "numbers"
    return None


def payload_faults(df: DataFrame) -> DataFrame:
    """Adds ``reason`` to payload rows (payload, hash); null where they can be used."""
    from ledgerloom.runtime import ship_package

    ship_package(df.sparkSession)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["reason string"])
    names = df.columns

    def run(batches):
        import pyarrow as pa

        from ledgerloom.operators.verify import payload_fault

        for b in batches:
            pairs = zip(b.column(names.index("payload")).to_pylist(), b.column(names.index("hash")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([payload_fault(p or "", h) for p, h in pairs], pa.string())], names=[*names, "reason"])

    return df.mapInArrow(run, schema)


def require_session(identity: DataFrame, expected: str) -> DataFrame:
    """``identity(session, session_id, ...)`` of exactly the session asked for, or ``Refused``."""
    rows = identity.select("session_id").distinct().limit(2).collect()
    if [r.session_id for r in rows] != [expected]:
        raise Refused(f"the transcript is not of session {expected}")
    return identity


def binding(evidence: DataFrame, lines: DataFrame, prefix: DataFrame) -> DataFrame:
    """Evidence (session, fact, line, sha256) that lies inside a session's first ``lines``
    (``prefix(session, lines)``), against its lines: required, matched and outside, per session."""
    e = evidence.join(prefix, "session").join(lines.select("session", "line", F.col("sha256").alias("now")), ["session", "line"], "left")
    inside = F.col("line") <= F.col("lines")
    return e.groupBy("session").agg(
        F.count_if(inside).alias("required"), F.count_if(inside & F.coalesce(F.col("sha256") == F.col("now"), F.lit(False))).alias("matched"), F.count_if(~inside).alias("outside")
    )


def shape_set(tokens: DataFrame) -> DataFrame:
    """(session, shapes): the sorted set of shape tokens of each session."""
    return tokens.groupBy("session").agg(F.array_sort(F.collect_set("token")).alias("shapes"))


def fixture_faults(shapes: DataFrame, recorded: DataFrame, d: Definition = Definition()) -> DataFrame:
    """Recorded fixtures (session, sha256, shapes) against what they are now (session, sha256,
    shapes): (session, hash_ok, shapes_ok, undeclared)."""
    now = shapes.select("session", F.col("sha256").alias("h"), F.col("shapes").alias("s"))
    declared = F.array(*map(F.lit, d.shapes()))
    same = F.coalesce(F.col("s") == F.array_sort("shapes"), F.lit(False))
    return recorded.join(now, "session", "left").select("session", F.coalesce(F.col("h") == F.col("sha256"), F.lit(False)).alias("hash_ok"), same.alias("shapes_ok"), F.array_except("shapes", declared).alias("undeclared"))


def report(diagnostics: DataFrame, ranks: list[str], most: int = 20) -> DataFrame:
    """The first ``most`` diagnostics of a report: by the rank of their code, then by line."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ranks)), F.col("code")), F.lit(0))
    place = F.when(rank == 0, len(ranks) + 1).otherwise(rank)
    return diagnostics.withColumn("rank", place).orderBy("rank", "line", "code", "detail").limit(most)


def status_tokens(pack: Column) -> Column:
    """The states named in a rendered pack's status line."""
    line = F.regexp_extract(pack, r"(?m)^Status: (.*)$", 1)
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(line, ", "), lambda x: F.regexp_replace(x, "^degraded: ", "")))


def field_text(answer: Column, path: str) -> Column:
    """The text at a dotted path of a JSON answer, over arrays of objects, made comparable: the
    strings as they are, anything else as JSON, with blanks between."""

    @F.pandas_udf("string")
    def walk(texts: pd.Series) -> pd.Series:
        def one(s):
            try:
                values = [json.loads(s)]
            except (TypeError, ValueError, RecursionError):
                return ""
            for step in path.split("."):
                inner = [x for v in values for x in (v if isinstance(v, list) else [v])]
                values = [x[step] for x in inner if isinstance(x, dict) and step in x]
            return " ".join(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in values)

        return texts.map(one)

    return score_text(walk(answer))


def collisions(phrases: DataFrame) -> DataFrame:
    """Phrases (group, id, phrase) that another of their group contains as text: (group, id, other).

    Not all pairs of a group meet: a phrase looks for the others that hold the trigram of its
    own (or what it has of one) that fewest phrases hold.
    """
    p = phrases.select("group", "id", score_text(F.col("phrase")).alias("t")).where("t <> ''")
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - n + 1, F.lit(1))), lambda i: F.substring(F.col("t"), i, F.lit(n)))
    held = p.select("group", F.col("id").alias("other"), F.col("t").alias("u"), F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("w"))
    common = held.groupBy("group", "w").agg(F.count("*").alias("n"))
    own = p.select("group", "id", "t", F.explode(F.array_distinct(grams(3))).alias("w")).join(common, ["group", "w"])
    rarest = own.groupBy("group", "id", "t").agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    hit = (F.col("id") != F.col("other")) & F.contains("u", F.col("t"))
    return rarest.join(held, ["group", "w"]).where(hit).select("group", "id", "other").distinct()


def category_scores(scored: DataFrame) -> DataFrame:
    """Per answer and category: half points, atoms, exact ones and recall."""
    n = scored.groupBy("answer", "category").agg(F.sum("half_points").alias("half_points"), F.count("*").alias("total"), F.count_if(F.col("outcome") == "exact").alias("exact"))
    return n.withColumn("recall_ppm", ppm(F.col("half_points"), 2 * F.col("total")))
