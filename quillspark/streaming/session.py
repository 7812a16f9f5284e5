"""The state of tool events on streams: the batch transition, kept per session as typed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle, TimerValues

from ..operators.session import STATE, ToolState, with_outcome
from .profile import SessionTimer, newest_ms, typed_state

#: A session without events for so long is dropped from the state.
IDLE_HOURS = 24


class ToolStates(SessionTimer):
    """Each list of the state is a list state, so that a batch writes the lists it changed; their caps bound them."""

    def __init__(self, purge_s: int):
        self.purge_s = purge_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.changes = handle.getValueState("changes", "n long")
        self.lists = {name: handle.getListState(name, "item string") for name in ToolState().lists}

    def clear(self) -> None:
        super().clear()
        self.changes.clear()
        for state in self.lists.values():
            state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        tool = ToolState()
        tool.changes = self.changes.get()[0] if self.changes.exists() else 0
        tool.lists = {name: [item for (item,) in state.get()] for name, state in self.lists.items()}
        before = {name: list(items) for name, items in tool.lists.items()}
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for e in frame.itertuples(index=False):
            tool.step(e)
        self.changes.update((tool.changes,))
        for name, items in tool.lists.items():
            if items and items != before[name]:
                self.lists[name].put([(item,) for item in items])
            elif not items and before[name]:
                self.lists[name].clear()
        self.touch(newest_ms(frame), timerValues)
        yield pd.DataFrame([{"session": key[0], **tool.lists, "changes": tool.changes}])


def tool_state_stream(events: DataFrame, idle_hours: int = IDLE_HOURS) -> DataFrame:
    """STATE of each session with new events, after these, for a stream of (session, seq, ts, tool, command, path, output).

    Events of a session are taken in order of seq within a batch, and batches
    in their order.  Lists are capped, so a session's state stays small; it
    goes when the watermark has passed its last event by idle_hours.  Write
    with output mode update; typed_state is set for the Spark session.
    """
    typed_state(events.sparkSession)
    cols = ["session", "seq", "ts", "tool", "path", "failure", "success", "outcome", "signatures", "approach", "fact", "summary"]
    watched = with_outcome(events.withWatermark("ts", f"{idle_hours} hours")).select(*cols)
    out = T._parse_datatype_string(STATE)
    return watched.groupBy("session").transformWithStateInPandas(ToolStates(idle_hours * 3600), outputStructType=out, outputMode="Update", timeMode="EventTime")
