"""The guardrail and hook state as stateful streams, and idempotent checkpoint sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom import fixed


def stream_guardrail(t: DataFrame, threshold: int = fixed.USAGE_PPM) -> DataFrame:
    """Streaming form of ``usage.guardrail``: state per session is (epoch, fired).

    Within a batch, all readings of a session are taken in time order, however many chunks they
    come in; invalid ones leave the state alone.  What one step holds is a session's readings of
    one micro-batch, which the source's rate limit bounds.
    """

    def step(key, pdfs, state):
        import pandas as pd

        epoch, fired = state.get if state.exists else (0, False)
        out = []
        for pdf in [pd.concat(list(pdfs))]:
            for r in pdf.sort_values(["sampled_at", "used_tokens"]).itertuples(index=False):
                used, limit = r.used_tokens, r.context_limit_tokens
                if pd.isna(used) or pd.isna(limit) or pd.isna(r.epoch) or not 0 < used <= limit:
                    continue
                if int(r.epoch) != epoch:
                    epoch, fired = int(r.epoch), False
                reading = int(used) * 1_000_000 // int(limit)
                if reading >= threshold and not fired:
                    fired = True
                    out.append((key[0], r.sampled_at, epoch, reading))
        state.update((epoch, fired))
        yield pd.DataFrame(out, columns=["session_id", "sampled_at", "epoch", "ppm"])

    return t.groupBy("session_id").applyInPandasWithState(
        step, "session_id string, sampled_at timestamp_ntz, epoch long, ppm long", "epoch long, fired boolean", "append", "NoTimeout"
    )


def stream_hooks(h: DataFrame) -> DataFrame:
    """Streaming form of ``usage.hook_actions``: state per session is (epoch, whether a delivery is
    pending); a compaction begins an epoch, of which at most one delivery comes."""

    def step(key, pdfs, state):
        import pandas as pd

        epoch, pending = state.get if state.exists else (0, False)
        out = []
        for pdf in [pd.concat(list(pdfs))]:
            for r in pdf.sort_values(["received_at", "hook_id"]).itertuples(index=False):
                action = "none"
                if r.hook_event_name == "PreCompact":
                    epoch, pending, action = epoch + 1, True, "checkpoint"
                elif r.hook_event_name == "SessionStart" and r.source in ("compact", "resume"):
                    action = "deliver" if pending or r.source == "resume" else "suppress"
                    pending = False
                out.append((r.hook_id, key[0], action))
        state.update((epoch, pending))
        yield pd.DataFrame(out, columns=["hook_id", "session_id", "action"])

    return h.groupBy("session_id").applyInPandasWithState(step, "hook_id long, session_id string, action string", "epoch long, pending boolean", "append", "NoTimeout")


def checkpoint_sink(path: str):
    """A ``foreachBatch`` function that appends only snapshots not stored yet, so that a batch
    that is run again after a failure changes nothing."""

    def write(batch: DataFrame, _epoch: int) -> None:
        from ledgerloom.operators.store import append_new

        append_new(batch.sparkSession, batch, path)

    return write
