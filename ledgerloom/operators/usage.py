"""Context usage: readings in parts per million and the once-per-epoch guardrail, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions.canon import ppm
from ledgerloom.operators.ordered import running_sum_before, value_before


def usage_ppm(used: Column, limit: Column) -> Column:
    """Null unless both are positive and the use is within the limit."""
    return F.when((used > 0) & (limit > 0) & (used <= limit), ppm(used, limit))


def guardrail(t: DataFrame, order: list[str], threshold: int = fixed.USAGE_PPM) -> DataFrame:
    """The rows of ``t(session_id, epoch, used_tokens, context_limit_tokens, *order)`` at which the
    guardrail fires: the first in each unbroken run of an epoch with enough use.

    Readings that are not valid are left out first; ``order`` must be unique in a session.
    """
    r = t.withColumn("ppm", usage_ppm(F.col("used_tokens"), F.col("context_limit_tokens"))).where("ppm is not null and epoch is not null")
    p = value_before(r, ["session_id"], order, "epoch", "_before")
    p = p.withColumn("_new", (F.col("epoch") != F.coalesce("_before", F.lit(0))).cast("long"))
    run = running_sum_before(p, ["session_id"], order, "_new", "_runs").withColumn("run", F.col("_runs") + F.col("_new"))
    hot = run.where(F.col("ppm") >= threshold)
    cols = [c for c in t.columns]
    first = hot.groupBy("session_id", "run").agg(F.min_by(F.struct(*cols, "ppm"), F.struct(*order)).alias("f"))
    return first.select("f.*")


def hook_actions(h: DataFrame, order: list[str]) -> DataFrame:
    """What each hook of a session leads to: ``checkpoint``, ``deliver``, ``suppress`` or ``none``.

    A compaction opens a new epoch with a pending delivery; a start after compaction delivers
    what is pending and is suppressed otherwise; a resume always delivers.
    """
    pre = F.col("hook_event_name") == "PreCompact"
    start = (F.col("hook_event_name") == "SessionStart") & F.col("source").isin("compact", "resume")
    acts = h.where("session_id is not null").withColumn("_pre", F.when(pre, 1).when(start, 0))
    relevant, rest = acts.where("_pre is not null"), acts.where("_pre is null")
    seen = value_before(relevant, ["session_id"], order, "_pre", "_last")
    action = F.when(F.col("_pre") == 1, "checkpoint").when(F.col("source") == "resume", "deliver").when(F.col("_last") == 1, "deliver").otherwise("suppress")
    return seen.select(*h.columns, action.alias("action")).unionByName(rest.select(*h.columns, F.lit("none").alias("action")))
