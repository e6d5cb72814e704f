"""The life of stored snapshots: envelopes, writing with refusals, pins, pruning with a log, restoring.

A store is a folder of three append-only Parquet tables: ``snapshots``, ``pins`` and ``pruned``.
What is live follows from them, so that every write is one atomic commit of new files, repeated
writes change nothing, and no reader ever sees half of a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.operators import store
from ledgerloom.operators.verify import payload_faults
from ledgerloom.runtime import stage

#: what a command's exit says
OK, FAILED, USAGE, INTEGRITY, DEGRADED = 0, 1, 2, 3, 4
EXTRACTOR = "1"
CANONICALIZATION = 3
STORE_SCHEMA = "1"


def envelope(payloads: DataFrame, identity: DataFrame, lines: DataFrame, created_at: str, adapter: str = "generic") -> DataFrame:
    """Snapshot rows of ``payloads(session, hash, payload)``: the payload beside its envelope, which
    is not part of the hash.  ``identity`` gives each session's id, cwd and version."""
    size = lines.groupBy("session").agg(F.count("*").alias("transcript_lines"), F.sum(F.octet_length("raw")).alias("transcript_bytes"))
    p = payloads.join(identity.select("session", "session_id", "cwd", "version"), "session").join(size, "session", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    empty = F.get_json_object("payload", "$.counters.source_entries").cast("long") == 0
    return p.select(
        "session_id", F.concat_ws("|", F.lit(created_at), "hash").alias("id"), "hash", F.lit(None).cast("string").alias("previous_hash"), F.lit(created_at).alias("created_at"),
        F.get_json_object("payload", "$.counters.facts").cast("long").alias("facts"), F.lit(False).alias("pinned"),
        F.when(empty, F.array(F.lit("extraction-empty"))).otherwise(F.array(F.lit("ok"))).alias("degraded"),
        F.lit(STORE_SCHEMA).alias("schema_version"), F.lit(CANONICALIZATION).alias("canonicalization"), F.lit(EXTRACTOR).alias("extractor_version"), F.lit(adapter).alias("adapter"),
        F.col("version").alias("adapter_version"), F.col("session").alias("transcript_path"), zero("transcript_bytes"), zero("transcript_lines"), F.col("cwd").alias("store_cwd"),
        F.lit(0).cast("long").alias("duration_ms"), "payload",
    )


def file_name(created_at: Column, digest: Column) -> Column:
    return F.concat_ws("-", created_at, F.substring(digest, 8, 12))


def write_snapshots(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """Appends the sound snapshots that are not stored yet; returns (session_id, hash, reason) of
    those refused: a fault of the row, a fault of its payload, or another snapshot's name."""
    marked = payload_faults(rows) if "payload" in rows.columns else rows.withColumn("reason", F.lit(None).cast("string"))
    marked = marked.withColumn("reason", F.coalesce(store.fault(marked), F.when(F.col("reason").isNotNull(), F.concat(F.lit("payload-"), "reason"))))
    name = file_name(F.col("created_at"), F.col("hash"))
    marked = marked.withColumn("name", name)
    taken = _table(spark, f"{root}/snapshots", "session_id string, hash string, created_at string").select("session_id", F.col("hash").alias("other"), file_name(F.col("created_at"), F.col("hash")).alias("name"))
    among = marked.where("reason is null").select("session_id", "name", F.col("hash").alias("other"))
    first = among.union(taken.select("session_id", "name", "other")).groupBy("session_id", "name").agg(F.min("other").alias("other"))
    clash = taken.groupBy("session_id", "name").agg(F.min("other").alias("stored"))
    j = marked.join(clash, ["session_id", "name"], "left").join(first, ["session_id", "name"], "left")
    owner = F.coalesce("stored", "other")
    j = stage(j.withColumn("reason", F.coalesce("reason", F.when(owner != F.col("hash"), "name-taken"))), "snapshots-in")
    store.append_new(spark, j.where("reason is null").select(*rows.columns), f"{root}/snapshots")
    return j.where("reason is not null").select("session_id", "hash", "reason")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``; an empty one where nothing was written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


_PIN = "session_id string, hash string, pinned boolean, at string"
_PRUNED = "session_id string, id string, hash string, reason string, at string"


def pin(spark: SparkSession, root: str, session_id: str, digest: str, pinned: bool, at: str) -> None:
    spark.createDataFrame([(session_id, digest, pinned, at)], _PIN).write.mode("append").parquet(f"{root}/pins")


def live(spark: SparkSession, root: str) -> DataFrame:
    """The snapshots that were not pruned, each with its last pin."""
    s = _table(spark, f"{root}/snapshots", "id string, session_id string, hash string, previous_hash string, created_at string, facts long, pinned boolean, degraded array<string>")
    pins = _table(spark, f"{root}/pins", _PIN).groupBy("session_id", "hash").agg(F.max_by("pinned", "at").alias("_pin"))
    gone = _table(spark, f"{root}/pruned", _PRUNED).select("session_id", "hash").distinct()
    left = s.join(gone, ["session_id", "hash"], "left_anti").join(pins, ["session_id", "hash"], "left")
    return left.withColumn("pinned", F.coalesce("_pin", "pinned", F.lit(False))).drop("_pin", "bucket")


def prune(spark: SparkSession, root: str, now: str, keep: int = fixed.KEEP_SNAPSHOTS, keep_ms: int = fixed.KEEP_MS) -> DataFrame:
    """Prunes by the retention plan; returns what went, as the log now has it."""
    plan = stage(store.retention_plan(live(spark, root), now, keep, keep_ms).withColumn("at", F.lit(now)), "prune")
    plan.write.mode("append").parquet(f"{root}/pruned")
    return plan


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The index of what is live, oldest first in each session."""
    return store.index_of(live(spark, root)).orderBy("session_id", "created_at", "id")


def restore(s: DataFrame, facts: DataFrame, numeric: list[str], other: list[str], extra: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(merged facts, states) of the whole chains among ``s``: the facts of a session's checkpoints
    merged in order, and the union of all states, with ``provenance-broken`` where a fact is
    unbacked.  Sessions whose chain is corrupt are left out, as they may not be merged."""
    place = store.chain(s).where("state = 'whole'").select(F.col("session_id").alias("session"), "hash", "position")
    merged = store.merge_chain(facts.drop("position").join(place, ["session", "hash"]).drop("hash"), numeric, other)
    whole = s.join(place.select(F.col("session").alias("session_id"), "hash"), ["session_id", "hash"], "left_semi")
    return merged, store.degraded_union(whole, merged, extra)


def exit_code(sound: Column, states: Column) -> Column:
    """Integrity comes before degradation."""
    worse = F.exists(F.coalesce(states, F.array().cast("array<string>")), lambda x: x != "ok")
    return F.when(~sound, INTEGRITY).when(worse, DEGRADED).otherwise(OK)


def lock_state(holder_host: Column, started_at: Column, alive: Column, host: Column, now: Column, stale_ms: int = 30_000) -> Column:
    """What a writer does about a lock: ``free``, ``unreadable`` (break it), ``respect`` (another
    host's, a young or a living holder's) or ``stale`` (break it)."""
    at = store.instant(started_at)
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(at)
    return (
        F.when(holder_host.isNull() & started_at.isNull(), "free")
        .when(holder_host.isNull() | at.isNull(), "unreadable")
        .when((holder_host != host) | (age <= stale_ms) | F.coalesce(alive, F.lit(True)), "respect")
        .otherwise("stale")
    )
