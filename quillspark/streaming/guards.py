"""The same guards on streams: state per key in a stateful processor.

Times are event times with a watermark of the guard's window; late rows are
dropped.  That is this engine's choice: a batch has no arrival time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.guards import BLOCK_AT, DUPLICATE_TTL, LOOP_GAP, WARN_AT


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")


def duplicate_stream(events: DataFrame, ttl: float = DUPLICATE_TTL) -> DataFrame:
    """(session, call, event_id, duplicate) for a stream of (session, call, event_id, ts)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = _ordered(frames)
        seconds = rows["ts"].astype("datetime64[us]").astype("int64") / 1e6
        hits = []
        for now in seconds:
            hits.append(last is not None and now - last < ttl)
            last = now
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + int(ttl * 1000) + 1)
        yield pd.DataFrame({"session": key[0], "call": key[1], "event_id": rows["event_id"].to_numpy(), "duplicate": hits})

    watched = events.withWatermark("ts", f"{int(ttl)} seconds")
    return watched.groupBy("session", "call").applyInPandasWithState(step, "session long, call string, event_id long, duplicate boolean", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def loop_stream(events: DataFrame, gap: float = LOOP_GAP, warn_at: int = WARN_AT, block_at: int = BLOCK_AT) -> DataFrame:
    """(session, file, event_id, edits, action) for a stream of (session, file, event_id, ts)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n = state.get if state.exists else (None, 0)
        rows = _ordered(frames)
        counts = []
        for now in rows["ts"].astype("datetime64[us]").astype("int64") / 1e6:
            n = 1 if last is None or now - last > gap else n + 1
            counts.append(n)
            last = now
        state.update((last, n))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + int(gap * 1000) + 1)
        actions = ["block" if c >= block_at else "warn" if c == warn_at else "pass" for c in counts]
        yield pd.DataFrame({"session": key[0], "file": key[1], "event_id": rows["event_id"].to_numpy(), "edits": counts, "action": actions})

    watched = events.withWatermark("ts", f"{int(gap)} seconds")
    return watched.groupBy("session", "file").applyInPandasWithState(step, "session long, file string, event_id long, edits long, action string", "last double, n long", "append", GroupStateTimeout.EventTimeTimeout)
