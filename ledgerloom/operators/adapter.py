"""One adapter from transcript lines to payloads, health and coverage.

Which record shape a transcript has is the mapper's business: a function from one parsed record
and the definition to parts (``mapper.shred_record`` is the one of the agent's JSON lines).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import extract, mapper
from ledgerloom.sources.definition import Definition


def config_of(identity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(config, refused): the extraction inputs of the sessions whose working folder is known,
    and (session, reason) of the others, whose paths could only be guessed."""
    roots = F.array().cast("array<struct<root:string,scope:string>>")
    known = F.coalesce(F.col("cwd"), F.lit("")) != ""
    config = identity.where(known).select("session", "cwd", F.lit(None).cast("string").alias("repo_root"), F.lit("cwd").alias("path_base"), roots.alias("roots"))
    return config, identity.where(~known).select("session", F.lit("missing-session-cwd").alias("reason"))


@dataclass
class Run:
    """What one adapter makes of a set of transcripts."""

    extraction: extract.Extraction
    payloads: DataFrame
    health: DataFrame
    drift: DataFrame
    diagnostics: DataFrame
    histogram: DataFrame
    refused: DataFrame


def run(lines: DataFrame, d: Definition = Definition(), shred=mapper.shred_record, max_bytes: int | None = None) -> Run:
    """Drives an adapter over physical lines (session, line, raw, sha256).

    ``health`` is (session, degraded): ``schema-drift`` for an undeclared shape or any diagnostic,
    ``extraction-empty`` where nothing was extracted, sorted.
    """
    from ledgerloom.fixed import PACK_BYTES

    m = mapper.Mapped(mapper.parts_of_lines(lines, d, shred), d)
    config, refused = config_of(m.identity())
    x = extract.Extraction(m.events(), config, d)
    drift = mapper.undeclared_shapes(mapper.line_shapes(lines), d)
    odd = m.diagnostics().unionByName(x.refused_paths())
    counted = config.select("session").join(x.counters.select("session", "source_entries"), "session", "left")
    states = odd.select("session", F.lit("schema-drift").alias("s")).union(drift.select("session", F.lit("schema-drift"))).union(
        counted.where(F.coalesce("source_entries", F.lit(0)) == 0).select("session", F.lit("extraction-empty"))
    )
    found = states.groupBy("session").agg(F.array_sort(F.collect_set("s")).alias("degraded"))
    health = config.select("session").join(found, "session", "left").select("session", F.coalesce("degraded", F.array().cast("array<string>")).alias("degraded"))
    return Run(x, x.payloads(lines, max_bytes or PACK_BYTES), health, drift, odd, m.histogram(), refused)


def preview(r: Run, lines: DataFrame, max_bytes: int, max_facts: int | None = None, evidence: bool = True) -> DataFrame:
    """(session, hash, pack): what a checkpoint would hold, rendered and not stored."""
    return r.extraction.payloads(lines, max_bytes, [], max_facts=max_facts, evidence=evidence).select("session", "hash", "pack")
