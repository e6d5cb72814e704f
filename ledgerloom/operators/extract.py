"""From events to facts, merged facts and payloads.

``normalise`` is the only Python step on events (text and path keys, Arrow batches); the kind
lookup, error-to-fix matching, merging, counting and ordering are relational.  Nothing
depends on partitioning, task order, locale or time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom import fixed
from ledgerloom.operators.mapper import kind_column
from ledgerloom.operators.ordered import running_sum_before
from ledgerloom.runtime import ship_package, stage
from ledgerloom.sources.definition import Definition

#: an event as ``extract`` takes it; absent columns are null
EVENT = (
    "session string, entry long, line long, block int, sub int, type string, ts string, name string, path string, command string, intent string, is_error boolean, "
    "error string, observed boolean, source_line long, text string, state string, item long, todos long, done long, items array<string>, head string, branch string, "
    "dirty boolean, status_hash string, files long, added long, removed long"
)
CONFIG = "session string, cwd string, repo_root string, path_base string, roots array<struct<root:string,scope:string>>"
_KEYS = "command_key string, signature string, error_text string, tool string, intent_key string, path_key string, scope string, statement string, cue string, clean string, clean_items array<string>"
_SUMS = ("runs", "edits", "reads", "count")
_LATEST = {
    "text": "string", "class": "string", "cue": "string", "failed": "boolean", "fixed_by": "string", "last_error_class": "string", "todos": "long", "done": "long", "dirty": "boolean",
    "status_hash": "string", "files": "long", "added": "long", "removed": "long",
}
ATTRS = sorted([*_SUMS, "tools", *_LATEST])
ORDER = ["entry", "line", "block", "sub"]


def complete(events: DataFrame) -> DataFrame:
    """``events`` with all columns of ``EVENT``, the missing ones null."""
    have = set(events.columns)
    cols = [(f.split(" ", 1)) for f in EVENT.split(", ")]
    return events.select(*[(F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in cols])


def normalise(events: DataFrame, config: DataFrame, cues: tuple[str, ...] = fixed.CUES) -> DataFrame:
    """Adds the keys of ``_KEYS``: what the event's texts and paths are compared by."""
    ship_package(events.sparkSession)
    fields = [f.name for f in events.schema]
    src = events.join(config.select("session", "cwd", "repo_root", "roots"), "session", "left").select(*fields, F.coalesce("cwd", F.lit("")).alias("cwd"), "repo_root", "roots")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema] + [_KEYS])

    def run(batches):
        import unicodedata

        import pyarrow as pa

        from ledgerloom.functions import text as T
        from ledgerloom.functions.paths import Roots, Unrepresentable

        at = {n: i for i, n in enumerate([*fields, "cwd", "repo_root", "roots"])}
        needed = ["type", "kind", "name", "path", "command", "intent", "is_error", "error", "text", "items", "head", "branch", "status_hash", "cwd", "repo_root", "roots"]
        known: dict = {}
        names = [f.split()[0] for f in _KEYS.split(", ")]
        for b in batches:
            rows = []
            for typ, kind, name, path, command, intent, is_error, error, said, items, head, branch, status, cwd, repo, given in zip(*(b.column(at[n]).to_pylist() for n in needed)):
                who = (cwd, repo, tuple((r["root"], r["scope"]) for r in given or ()))
                roots = known.get(who)
                if roots is None:
                    if len(known) > 5_000:
                        known.clear()
                    roots = known[who] = Roots(*who)
                r = dict.fromkeys(names)
                if typ == "tool" and kind:
                    r["tool"] = T.without_paths(name or "", roots)
                    r["intent_key"] = None if intent is None else T.command_key(intent, roots) or ""
                    if kind in ("command", "cmd.run", "cmd.failed"):
                        r["command_key"] = T.command_key(command or "", roots)
                        r["signature"] = T.error_signature("unknown" if error is None else error, roots)
                        r["error_text"] = T.without_paths(error or "", roots)
                    elif path is not None:
                        try:
                            r["path_key"], r["scope"] = roots.key_of(path)
                        except Unrepresentable:
                            pass
                elif typ == "user" and said is not None:
                    hit = T.decision(said, roots, cues)
                    if hit:
                        r["statement"], r["cue"] = hit
                elif typ == "todo":
                    r["clean"] = T.without_paths(said or "", roots)
                elif typ == "plan":
                    r["clean_items"] = [x for x in (T.without_paths(i, roots) for i in items or ()) if x is not None]
                elif typ == "git":
                    r["clean_items"] = [T.without_paths(x or "", roots) or "" for x in (head, branch, status)]
                rows.append(tuple(unicodedata.normalize("NFC", v) if isinstance(v, str) and not v.isascii() else v for v in r.values()))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            types = [pa.list_(pa.string()) if "array" in f else pa.string() for f in _KEYS.split(", ")]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(fields)], *[pa.array(c, t) for c, t in zip(cols, types)]], names=[*fields, *names])

    return src.mapInArrow(run, schema)


def fact(when, kind, key, snippet, scope=None, **attrs):
    """A fact as a struct column, null where ``when`` does not hold."""
    null = lambda t: F.lit(None).cast(t)
    wide = [(attrs[a] if a in attrs else null("string" if a == "tools" else _LATEST.get(a, "long"))).alias("tool_name" if a == "tools" else a) for a in ATTRS]
    head = [(F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), key.alias("key"), (scope if scope is not None else null("string")).alias("scope"), snippet.alias("snippet")]
    return F.when(when, F.struct(*head, *wide))


def facts_of(n: DataFrame, facts: list) -> DataFrame:
    """The facts of each event, one row each, from one pass over the events."""
    lines = F.array_sort(F.array_distinct(F.array_compact(F.array("line", "source_line"))))
    rows = n.select("session", "entry", "ts", "line", lines.alias("lines"), F.explode(F.array_compact(F.array(*facts))).alias("f"))
    wide = ["tool_name" if a == "tools" else a for a in ATTRS]
    return rows.select("session", "f.kind", "f.key", "f.scope", "entry", "ts", "line", "lines", "f.snippet", F.lit(False).alias("unbacked"), *[f"f.{a}" for a in wide])


def raw_facts(n: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The facts of normalised events, one row each, not merged; only of ``kinds`` if given, and
    then nothing is computed for others."""
    c, one, kind = F.col, F.lit(1).cast("long"), F.col("kind")
    tool = (c("type") == "tool") & kind.isNotNull() & F.coalesce("observed", F.lit(True))
    ran = tool & kind.isin("command", "cmd.run", "cmd.failed") & c("command_key").isNotNull()
    failed = F.coalesce("is_error", F.lit(False))
    cls = F.substring_index("signature", ":", 1)
    shown = F.coalesce("intent_key", F.concat(F.coalesce("tool", F.lit("")), F.lit(" "), c("command_key")))
    files = ("file.modified", "file.read", "file.created", "file.deleted")
    touched = tool & kind.isin(*files) & c("path_key").isNotNull() & c("tool").isNotNull()
    other = tool & ~kind.isin("command", "cmd.run", "cmd.failed", "ignored", "todo", *files) & c("tool").isNotNull()
    todo = F.when(c("item").isNull(), c("state")).otherwise(F.concat(F.lit("item:"), c("item").cast("string")))
    git, part = c("type") == "git", lambda i: F.try_element_at("clean_items", F.lit(i))
    facts = [
        (["cmd.failed"], fact(ran & failed, "cmd.failed", c("command_key"), shown, runs=one, last_error_class=cls)),
        (["cmd.run"], fact(ran & ~failed, "cmd.run", c("command_key"), shown, runs=one, failed=F.lit(False))),
        (["error.raised"], fact(ran & failed & c("error_text").isNotNull(), "error.raised", c("signature"), c("error_text"), count=one, **{"class": cls})),
        (files, fact(
            touched, kind, c("path_key"), F.concat_ws(" ", "tool", "path_key"), c("scope"),
            edits=F.when(kind == "file.modified", one), tools=F.when(kind == "file.modified", c("tool")), reads=F.when(kind == "file.read", one),
        )),
        (fixed.PRIORITY, fact(other, kind, c("tool"), F.coalesce("intent_key", "tool"))),
        (["decision.stated"], fact(c("statement").isNotNull(), "decision.stated", c("statement"), c("statement"), cue=c("cue"))),
        (["todo.state"], fact((c("type") == "todo") & c("clean").isNotNull(), "todo.state", todo, c("clean"), text=c("clean"))),
        (["plan.state"], fact(c("type") == "plan", "plan.state", F.lit("plan"), F.array_join("clean_items", ", "), todos=c("todos"), done=c("done"))),
        (["git.state"], fact(git, "git.state", F.lit("head"), part(1))),
        (["git.state"], fact(git, "git.state", F.lit("status"), part(2), dirty=c("dirty"), status_hash=part(3))),
        (["git.state"], fact(git, "git.state", F.lit("diff"), F.concat(c("files").cast("string"), F.lit(" files")), files=c("files"), added=c("added"), removed=c("removed"))),
    ]
    wanted = lambda ks: kinds is None or any(k in kinds for k in ks)
    out = facts_of(n, [f for ks, f in facts if wanted(ks)])
    if kinds is not None:
        out = out.where(c("kind").isin(*kinds))
    return out.union(fixes(n.where(ran), failed)) if wanted(["error.fixed"]) else out


def fixes(run: DataFrame, failed) -> DataFrame:
    """A success of a command fixes every error of it since the success before."""
    c, one = F.col, F.lit(1).cast("long")
    narrow = run.select("session", *ORDER, "ts", "source_line", "command_key", "signature", F.when(failed, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("_ok"))
    seg = running_sum_before(narrow, ["session", "command_key"], ORDER, "_ok", "seg")
    errors = seg.where("_ok = 0").select("session", "command_key", "seg", c("signature").alias("fixed")).distinct()
    wins = seg.where("_ok = 1").join(errors, ["session", "command_key", "seg"])
    return facts_of(wins, [fact(F.lit(True), "error.fixed", c("fixed"), F.concat(F.lit("fixed by "), c("command_key")), count=one, fixed_by=c("command_key"))])


def merge(facts: DataFrame) -> DataFrame:
    """One row per (session, kind, key): sums, unions, the latest and the earliest values, and
    the first five evidence lines.  Every aggregate combines before the shuffle."""
    c = F.col
    tie = F.to_json(F.struct(F.struct(*[c(a if a != "tools" else "tool_name").alias(a) for a in ATTRS]).alias("attrs"), c("lines").alias("evidence"), c("key"), c("scope"), c("snippet"), c("unbacked")))
    keyed = facts.withColumn("ord", F.struct("entry", F.array_min("lines").alias("l"), tie.alias("t")))
    latest = [F.max_by(a, F.when(c(a).isNotNull(), c("ord"))).alias(a) for a in _LATEST]
    merged = keyed.groupBy("session", "kind", "key").agg(
        *[F.sum(a).alias(a) for a in _SUMS],
        F.array_sort(F.collect_set("tool_name")).alias("tools"),
        *latest,
        F.min_by(F.struct("entry", "ts", "scope"), c("ord")).alias("first"),
        F.min_by("snippet", F.when(c("snippet") != "", c("ord"))).alias("snippet"),
        F.bool_or("unbacked").alias("unbacked"),
    )
    lines = facts.select("session", "kind", "key", F.explode("lines").alias("line")).distinct()
    w = Window.partitionBy("session", "kind", "key").orderBy("line")  # limited before the shuffle
    top = lines.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= fixed.EVIDENCE)
    evidence = top.groupBy("session", "kind", "key").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return merged.join(evidence, ["session", "kind", "key"]).select(
        "session", "kind", "key", c("first.scope").alias("scope"), c("first.entry").alias("entry"), c("first.ts").alias("ts"), F.coalesce("snippet", F.lit("")).alias("snippet"),
        "unbacked", "lines", *_SUMS, F.when(F.size("tools") > 0, c("tools")).alias("tools"), *_LATEST,
    )


def priority(kind) -> F.Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.PRIORITY.items() for x in kv]), kind)


def counters(n: DataFrame, facts: DataFrame) -> DataFrame:
    """Per session: facts, external paths, events, calls, undeclared calls and coverage."""
    from ledgerloom.functions.canon import ppm

    tool = F.col("type") == "tool"
    seen = n.groupBy("session").agg(
        F.count("*").alias("source_entries"), F.count_if(tool).alias("source_tool_calls"), F.count_if(tool & F.col("kind").isNull()).alias("unmapped_tool_calls")
    )
    kinds = facts.groupBy("session", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("scope") == "external").alias("x"))
    by = kinds.groupBy("session").agg(F.sum("n").alias("facts"), F.sum("x").alias("external_path_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))
    out = seen.join(by, "session", "left")
    whole = F.col("source_tool_calls")
    return out.select(
        "session", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("external_path_count", F.lit(0)).alias("external_path_count"), "by_kind", "source_entries", "source_tool_calls",
        "unmapped_tool_calls", ppm(whole - F.col("unmapped_tool_calls"), whole).alias("coverage_ppm"),
    )


class Extraction:
    """The facts (of ``kinds``, or all), counters and payloads of a set of sessions."""

    def __init__(self, events: DataFrame, config: DataFrame, d: Definition = Definition(), cues: tuple[str, ...] | None = None, kinds: tuple[str, ...] | None = None):
        e = complete(events)
        kinded = e.withColumn("kind", F.when(F.col("type") == "tool", kind_column(F.col("name"), d)))
        self.config = config
        self.events = stage(normalise(kinded, config, tuple(cues if cues is not None else d.cues)), "events")
        self.facts = stage(merge(stage(raw_facts(self.events, kinds), "raw-facts")), "facts")
        self.counters = counters(self.events, self.facts)

    def refused_paths(self) -> DataFrame:
        """(session, line, code, detail) of tool paths that have no key (the root itself)."""
        touched = F.col("kind").isin("file.modified", "file.read", "file.created", "file.deleted") & F.col("path").isNotNull() & F.col("path_key").isNull()
        return self.events.where(touched).select("session", "line", F.lit("tool-input-shape").alias("code"), F.lit("file-path").alias("detail"))

    def states(self) -> DataFrame:
        """(session, git, plan): the last of each, or null."""
        at, c = F.struct(*ORDER), F.col
        git = F.struct(F.element_at("clean_items", 1).alias("head"), F.element_at("clean_items", 2).alias("branch"), "dirty", F.element_at("clean_items", 3).alias("status_hash"), "files", "added", "removed")
        plan = F.struct("todos", "done", c("clean_items").alias("items"))
        return self.events.groupBy("session").agg(
            F.max_by(F.to_json(git), F.when(c("type") == "git", at)).alias("git"), F.max_by(F.to_json(plan), F.when(c("type") == "plan", at)).alias("plan")
        )

    def payloads(self, lines: DataFrame, max_bytes: int = fixed.PACK_BYTES, degraded: list[str] | None = None, brand: str = "ledgerloom", max_facts: int | None = None, evidence: bool = False) -> DataFrame:
        """(session, hash, payload_bytes, payload, pack) of every session in ``config``; lines
        (session, line, sha256) back the evidence."""
        from ledgerloom.operators.pack import render

        return render(self, lines, max_bytes, degraded, brand, max_facts, evidence)
