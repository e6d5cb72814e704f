"""Hook input as rows: JSON that cannot be read is an empty object, and never stops a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELDS = ("session_id", "transcript_path", "hook_event_name", "source")


def parse_hooks(df: DataFrame, text: Column, received_at: Column) -> DataFrame:
    """(session_id, transcript_path, hook_event_name, source, received_at) of hook input as text,
    batch or stream; a field of another type than text is null."""
    v = F.try_parse_json(text)
    field = lambda n: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING", F.try_variant_get(v, f"$.{n}", "string")).alias(n)
    return df.select(*map(field, _FIELDS), received_at.alias("received_at"))


def answer(action: Column, pack: Column) -> Column:
    """What the host gets back: the pack as additional context where it is to be delivered, and an
    empty object for everything else, a missing pack included (fail open)."""
    told = F.to_json(F.struct(F.struct(F.lit("SessionStart").alias("hookEventName"), pack.alias("additionalContext")).alias("hookSpecificOutput")))
    return F.when((action == "deliver") & pack.isNotNull(), told).otherwise("{}")
