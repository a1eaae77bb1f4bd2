"""Keyed state for rules that depend on what was accepted before.

Within one trigger the rows of a key are put in time order; their number is
bounded by the source's rows per trigger. State is bounded too: accepted times
within the longest window, or the last anchor. It expires with the watermark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from agoradesk.functions.columns import micros
from agoradesk.operators.limits import DUPLICATE_SECONDS, MESSAGE_LIMITS

LATENESS = "10 minutes"


def _prepared(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).withColumn("_at", micros(F.col(ts)))


def sliding_limit_stream(
    stream: DataFrame, key: str, ts: str, event_id: str, limits: tuple[tuple[int, int], ...] = MESSAGE_LIMITS, lateness: str = LATENESS
) -> DataFrame:
    """(key, event_id, accepted) with the same rule as the batch operator."""
    longest = max(s for s, _ in limits) * 1_000_000

    def admit(group: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values(["_at", event_id])
        verdicts = []
        for at in rows["_at"]:
            kept = [k for k in kept if k >= at - longest]
            ok = all(sum(k >= at - s * 1_000_000 for k in kept) < n for s, n in limits)
            verdicts.append(ok)
            if ok:
                kept.append(int(at))
        state.update((kept,))
        state.setTimeoutTimestamp(max(int(rows["_at"].max() + longest) // 1_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: rows[key], event_id: rows[event_id], "accepted": verdicts})

    types = dict(stream.dtypes)
    return _prepared(stream, ts, lateness).groupBy(key).applyInPandasWithState(
        admit, f"{key} {types[key]}, {event_id} {types[event_id]}, accepted boolean", "kept array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


def duplicate_stream(
    stream: DataFrame, keys: list[str], ts: str, event_id: str, seconds: int = DUPLICATE_SECONDS, lateness: str = LATENESS
) -> DataFrame:
    """(keys, event_id, kept_id): repeats within the gap point at the event they repeat."""
    gap = seconds * 1_000_000

    def collapse(group: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, kept = state.get if state.exists else (None, None)
        rows = pd.concat(batches).sort_values(["_at", event_id])
        out = []
        for at, eid in zip(rows["_at"], rows[event_id]):
            if anchor is None or anchor < at - gap:
                anchor, kept = int(at), str(eid)
            out.append(kept)
        state.update((anchor, kept))
        state.setTimeoutTimestamp(max((anchor + gap) // 1_000, state.getCurrentWatermarkMs() + 1))
        yield rows[[*keys, event_id]].assign(kept_id=out)

    types = dict(stream.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, event_id]) + ", kept_id string"
    return _prepared(stream, ts, lateness).groupBy(*keys).applyInPandasWithState(
        collapse, schema, "anchor bigint, kept string", "append", GroupStateTimeout.EventTimeTimeout
    )
