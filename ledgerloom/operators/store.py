"""Snapshots of sessions: validation, index, chains, merging, provenance, retention, health.

A snapshot is a row ``(id, session_id, hash, previous_hash, created_at, facts, pinned,
degraded)``; its payload may stand beside it.  Refusal, quarantine and degradation are kept
apart: bad arguments raise, bad rows become rows of a side table with the reason, and health
is a column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.operators.hierarchy import resolve_hierarchy
from ledgerloom.operators.ordered import running_sum_before

_HASH = "^sha256:[0-9a-f]{64}$"
_INSTANT = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
SESSION_ID = "^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


def instant(c: Column) -> Column:
    """The time of a canonical instant, null where it does not survive the round trip."""
    t = F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    return F.when(c.rlike(_INSTANT) & (F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'") == c), t)


def fault(s: DataFrame) -> Column:
    """The first reason why a snapshot row cannot be used, or null."""
    c = F.col
    return F.coalesce(
        F.when(c("session_id").isNull() | ~c("session_id").rlike(SESSION_ID), "session"),
        F.when(c("hash").isNull() | ~c("hash").rlike(_HASH), "hash"),
        F.when(c("previous_hash").isNotNull() & ~c("previous_hash").rlike(_HASH), "previous-hash"),
        F.when(instant(c("created_at")).isNull(), "created-at"),
        F.when(c("id") != F.concat_ws("|", "created_at", "hash"), "id"),
        F.when(c("facts").isNull() | (c("facts") < 0), "facts"),
        F.when(c("degraded").isNotNull() & ~F.forall("degraded", lambda x: x.isin(*fixed.DEGRADED)), "degraded"),
    )


def split_usable(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantined rows with ``reason``)."""
    marked = s.withColumn("reason", fault(s))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def find(s: DataFrame, query: str) -> DataFrame:
    """Snapshots by id, hash or the hash's first twelve digits."""
    return s.where((F.col("id") == query) | (F.col("hash") == query) | (F.substring("hash", 8, 12) == query))


def index_of(s: DataFrame) -> DataFrame:
    return s.select("session_id", "id", "hash", "created_at", "facts", F.coalesce("pinned", F.lit(False)).alias("pinned"), "degraded")


def reconcile(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """Index rows after a rebuild, with ``state``: kept, added or gone; pins carry over by hash."""
    a = derived.select("session_id", "hash", "id", F.lit(True).alias("here"))
    b = stored.select("session_id", "hash", F.col("pinned").alias("was_pinned"), F.lit(True).alias("listed"))
    j = a.join(b, ["session_id", "hash"], "full")
    state = F.when(F.col("here").isNull(), "gone").when(F.col("listed").isNull(), "added").otherwise("kept")
    return j.select("session_id", "hash", "id", F.coalesce("was_pinned", F.lit(False)).alias("pinned"), state.alias("state"))


def chain(s: DataFrame) -> DataFrame:
    """(session_id, hash, position, state): the place of each snapshot in its session's chain.

    ``whole`` chains have one start, no gap, no fork and no repeated hash; all rows of a
    session that breaks this are ``corrupt``, as none of them may be merged.
    """
    link = lambda h: F.when(F.col(h).isNotNull(), F.concat_ws("/", "session_id", h))
    rows = s.select(link("hash").alias("node"), link("previous_hash").alias("parent"), "created_at")
    from ledgerloom.functions.ids import uuid_key

    tree = resolve_hierarchy(rows, "node", ["parent"], ["created_at"]).select("node", "depth", "kind")
    per = s.groupBy("session_id").agg(F.count("*").alias("n"), F.count_distinct("hash").alias("hashes"), F.count_if(F.col("previous_hash").isNull()).alias("starts"), F.count_distinct("previous_hash").alias("befores"))
    one = (F.col("n") == F.col("hashes")) & (F.col("starts") == 1) & (F.col("befores") == F.col("n") - 1)
    joined = s.select("session_id", "hash", uuid_key(link("hash")).alias("node")).join(tree, "node").join(per.select("session_id", one.alias("one")), "session_id")
    bad = joined.where(~F.col("kind").isin("root", "node")).select("session_id").distinct().withColumn("broken", F.lit(True))
    whole = F.col("one") & F.col("broken").isNull()
    return joined.join(bad, "session_id", "left").select("session_id", "hash", F.when(whole, F.col("depth")).alias("position"), F.when(whole, "whole").otherwise("corrupt").alias("state"))


def merge_chain(facts: DataFrame, numeric: list[str], other: list[str]) -> DataFrame:
    """Facts of a chain's checkpoints, ``(session, position, kind, key, *numeric, *other,
    unbacked)``, to one per identity: what is no number from the latest checkpoint that has
    the fact, numbers as the maximum over all, unbacked where the newest lacks it."""
    newest = facts.groupBy("session").agg(F.max("position").alias("newest"))
    agg = facts.groupBy("session", "kind", "key").agg(
        F.max("position").alias("position"), *[F.max(n).alias(n) for n in numeric], F.max_by(F.struct("unbacked", *other), "position").alias("l")
    )
    gone = F.col("position") < F.col("newest")
    return agg.join(newest, "session").select("session", "kind", "key", *numeric, *[F.col(f"l.{o}").alias(o) for o in other], (F.col("l.unbacked") | gone).alias("unbacked"))


def provenance(evidence: DataFrame, lines: DataFrame) -> DataFrame:
    """``evidence(session, fact, line, sha256)`` against ``lines(session, line, sha256)``:
    (session, fact, state), backed if any line has its hash, drifted if lines exist but none
    has, unbacked otherwise."""
    now = lines.select("session", "line", F.col("sha256").alias("now"))
    j = evidence.join(now, ["session", "line"], "left")
    state = F.when(F.bool_or(F.coalesce(F.col("sha256") == F.col("now"), F.lit(False))), "backed").when(F.bool_or(F.col("now").isNotNull()), "drifted").otherwise("unbacked")
    return j.groupBy("session", "fact").agg(state.alias("state"))


def provenance_counts(states: DataFrame) -> DataFrame:
    """Per session: facts that are backed, drifted and unbacked, and whether all are backed."""
    n = [F.count_if(F.col("state") == x).alias(x) for x in ("backed", "drifted", "unbacked")]
    return states.groupBy("session").agg(*n, F.bool_and(F.col("state") == "backed").alias("whole"))


def retention_plan(s: DataFrame, now: str, keep: int = fixed.KEEP_SNAPSHOTS, keep_ms: int = fixed.KEEP_MS) -> DataFrame:
    """(session_id, id, hash, reason): what to prune.  The newest and the pinned are exempt;
    what is older than ``keep_ms`` goes first, then the oldest until ``keep`` remain."""
    if not re.match(_INSTANT, now):
        raise ValueError("now must be an instant such as 2026-01-01T00:00:00Z")
    at = F.unix_millis(instant(F.col("created_at")))
    end = F.unix_millis(F.to_timestamp(F.lit(now), "yyyy-MM-dd'T'HH:mm:ssX"))
    place = F.struct("created_at", "id")
    per = s.groupBy("session_id").agg(F.count("*").alias("total"), F.max(place).alias("newest"))
    r = s.join(per, "session_id")
    cand = ~F.coalesce("pinned", F.lit(False)) & (place != F.col("newest"))
    r = r.select("session_id", "id", "hash", "created_at", "total", cand.alias("cand"), (cand & (end - at > keep_ms)).alias("aged"))
    aged = r.groupBy("session_id").agg(F.count_if("aged").alias("aged_n"))
    counted = running_sum_before(r.withColumn("one", (F.col("cand") & ~F.col("aged")).cast("long")), ["session_id"], ["created_at", "id"], "one", "before")
    by_count = F.col("cand") & ~F.col("aged") & (F.col("before") + 1 <= F.col("total") - F.col("aged_n") - keep)
    reason = F.when(F.col("aged"), "retention:age").when(by_count, "retention:count")
    return counted.join(aged, "session_id").select("session_id", "id", "hash", reason.alias("reason")).where("reason is not null")


def degraded_union(s: DataFrame, merged: DataFrame | None = None, extra: list[str] = ()) -> DataFrame:
    """(session_id, degraded): the union of the states of a session's snapshots, sorted; with
    ``provenance-broken`` where a merged fact (session, unbacked) is unbacked, and the states
    of ``extra`` for all."""
    states = s.select("session_id", F.explode(F.coalesce("degraded", F.array(F.lit("ok")))).alias("d"))
    if merged is not None:
        states = states.union(merged.where("unbacked").select("session", F.lit("provenance-broken")))
    for e in extra:
        states = states.union(s.select("session_id", F.lit(e)).distinct())
    return states.groupBy("session_id").agg(F.array_sort(F.collect_set("d")).alias("degraded"))


def doctor(s: DataFrame) -> DataFrame:
    """One health row a session: usable, quarantined, newest, chain and states."""
    good, bad = split_usable(s)
    n = good.groupBy("session_id").agg(F.count("*").alias("usable"), F.max("created_at").alias("newest"), F.max_by("hash", F.struct("created_at", "id")).alias("newest_hash"))
    q = bad.groupBy("session_id").agg(F.count("*").alias("quarantined"))
    state = chain(good).groupBy("session_id").agg(F.min("state").alias("chain"))
    out = n.join(q, "session_id", "full").join(state, "session_id", "left").join(degraded_union(good), "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    healthy = (F.coalesce("quarantined", F.lit(0)) == 0) & (F.coalesce("chain", F.lit("corrupt")) == "whole")
    return out.select("session_id", zero("usable"), zero("quarantined"), "newest", "newest_hash", F.coalesce("chain", F.lit("corrupt")).alias("chain"), "degraded", healthy.alias("healthy"), F.when(~healthy, 3).when(F.exists("degraded", lambda x: x != "ok"), 4).otherwise(0).alias("exit_code"))


#: folders of a stored table; a session's rows are in one of them
BUCKETS = 64


def append_new(spark: SparkSession, new: DataFrame, path: str) -> int:
    """Checkpoint sink: appends the rows whose (session_id, hash) is not stored yet; idempotent."""
    from pyspark.errors import AnalysisException

    bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")
    rows = new.dropDuplicates(["session_id", "hash"]).withColumn("bucket", bucket)
    try:
        # only the buckets that the batch has rows for are read, and of them two columns
        here = [r.bucket for r in rows.select("bucket").distinct().collect()]
        have = spark.read.parquet(path).where(F.col("bucket").isin(here)).select("session_id", "hash")
        rows = rows.join(have, ["session_id", "hash"], "left_anti")
    except AnalysisException:
        pass  # the first write
    from ledgerloom.runtime import stage

    fresh = stage(rows, "append")
    n = fresh.count()
    if n:
        fresh.write.mode("append").partitionBy("bucket").parquet(path)
    return n


def inject(existing: str, pack: str, brand: str = "ledgerloom") -> str:
    """``pack`` in place of the marked block of ``existing``, or behind it; repeatable."""
    start, end = f"<!-- {brand}:start -->", f"<!-- {brand}:end -->"
    block = f"{start}\n{pack.rstrip(chr(10))}\n{end}"
    a = existing.find(start)
    b = existing.find(end, a + len(start)) if a >= 0 else -1
    if b >= 0:
        return existing[:a] + block + existing[b + len(end) :]
    return f"{existing.rstrip(chr(10))}\n\n{block}\n" if existing.strip() else block + "\n"
