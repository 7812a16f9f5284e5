"""Live session profiles: the batch profile, repeated calls, heaviest turns and advice, kept per session as typed state.

Per session the state holds a value (sums and counters), maps (calls by tool,
calls by tool and signature, edits by file) and two lists of at most k entries:
the most repeated calls and the heaviest turns.  Counts only grow, so an entry
that is not touched in a batch can't enter a list, and the lists are kept exact
by looking at the touched entries alone.  A batch reads and writes one map entry
per distinct call in it; a task holds a session's rows of one batch and k
entries, whatever the session's length.  Maps live in the state store.

An event-time timer purges a session when the watermark has passed its last
event by PURGE_S.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.guards import recommendations

#: Seconds after its last event at which a session's state goes.
PURGE_S = 86_400
#: Entries of a list; edits of one file that make a loop.
TOP, LOOP_AT = 10, 3
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_SUMS = ("input", "output", "cache_read", "cache_write")
_COUNTS = ("calls", "tools", *_SUMS, "repeated_calls", "loops", "oversized")
_REPEATED = "n long, tool string, signature string"
_HEAVY = "total long, event_id long"


def typed_state(spark: SparkSession) -> None:
    """Queries that start in this session from now on keep state in RocksDB, which typed state needs; those with a checkpoint keep the store they began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class SessionTimer(StatefulProcessor):
    """A processor whose state of a key goes `purge_s` seconds of event time after the key's last event."""

    purge_s = PURGE_S

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def touch(self, newest_ms: int, times: TimerValues, known: bool = True) -> None:
        """Puts the key's timer off; one timer a key, none yet of a key that is not known."""
        last = self.last.get() if known else None
        newest = max(newest_ms, last[0] if last else newest_ms)
        self.last.update((newest,))
        due = newest + self.purge_s * 1000
        for old in list(self.handle.listTimers()) if known else []:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(due, times.getCurrentWatermarkInMs() + 1))

    def clear(self) -> None:
        self.last.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        return iter([])

    def close(self) -> None:
        pass


def newest_ms(rows: pd.DataFrame) -> int:
    return int(rows["ts"].astype("datetime64[ms]").astype("int64").max())


def kept_top(entries: list[tuple], touched: list[tuple], order, same, k: int) -> list[tuple]:
    """The k first of the entries and the touched ones by `order`; a touched one takes the place of the `same` entry before it."""
    names = {same(t) for t in touched}
    return sorted([e for e in entries if same(e) not in names] + touched, key=order)[:k]


class SessionProfile(SessionTimer):
    def __init__(self, top: int = TOP, loop_at: int = LOOP_AT, purge_s: int = PURGE_S):
        self.top, self.loop_at, self.purge_s = top, loop_at, purge_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.totals = handle.getValueState("totals", ", ".join(f"{c} long" for c in _COUNTS))
        self.tools = handle.getMapState("tools", "tool string", "n long")
        self.calls = handle.getMapState("calls", "tool string, signature string", "n long")
        self.edits = handle.getMapState("edits", "file string", "n long")
        self.repeated = handle.getListState("repeated", _REPEATED)
        self.heavy = handle.getListState("heavy", _HEAVY)

    def clear(self) -> None:
        super().clear()
        for state in (self.totals, self.tools, self.calls, self.edits, self.repeated, self.heavy):
            state.clear()

    @staticmethod
    def _grown(state, counts: dict[tuple, int], known: bool) -> list[tuple[tuple, int, int]]:
        """(key, count before, count now) of the keys of a batch, with the counts put back; a session that is not known has none before."""
        out = []
        for key, n in counts.items():
            found = state.getValue(key) if known else None
            before = found[0] if found else 0
            state.updateValue(key, (before + n,))
            out.append((key, before, before + n))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found = self.totals.get()
        known = found is not None
        total = dict(zip(_COUNTS, found if known else (0,) * len(_COUNTS), strict=True))
        tools: Counter[tuple] = Counter()
        calls: Counter[tuple] = Counter()
        edits: Counter[tuple] = Counter()
        heavy = [tuple(e) for e in self.heavy.get()] if known else []
        newest = 0
        for frame in rows:
            total["calls"] += len(frame)
            total["oversized"] += int(frame["oversized"].fillna(False).sum())
            for c in _SUMS:
                total[c] += int(frame[c].fillna(0).sum())
            for counts, columns in ((tools, ["tool"]), (calls, ["tool", "signature"]), (edits, ["edited"])):
                counts.update(name for name in zip(*(frame[c].tolist() for c in columns), strict=True) if not any(map(pd.isna, name)))
            size = (frame["input"].fillna(0) + frame["output"].fillna(0)).astype("int64")
            heavy = nsmallest(self.top, [*heavy, *zip(size.tolist(), frame["event_id"].tolist(), strict=True)], key=lambda e: (-e[0], e[1]))
            newest = max(newest, newest_ms(frame))
        total["tools"] += sum(before == 0 for _, before, _ in self._grown(self.tools, tools, known))
        total["loops"] += sum(before < self.loop_at <= now for _, before, now in self._grown(self.edits, edits, known))
        grown = self._grown(self.calls, calls, known)
        total["repeated_calls"] += sum(before < 2 <= now for _, before, now in grown)
        often = [(now, *name) for name, _, now in grown if now > 1]
        repeated = kept_top([tuple(e) for e in self.repeated.get()] if known else [], often, lambda e: (-e[0], e[1], e[2]), lambda e: e[1:], self.top)
        self.totals.update(tuple(total[c] for c in _COUNTS))
        if heavy:
            self.heavy.put(heavy)
        if repeated:
            self.repeated.put(repeated)
        self.touch(newest, timerValues, known)
        named = lambda entries, names: [dict(zip(names, e, strict=True)) for e in entries]
        yield pd.DataFrame([{"session": key[0], **total, "repeated": named(repeated, ("n", "tool", "signature")), "heaviest": named(heavy, ("total", "event_id"))}])


def with_advice(profiles: DataFrame) -> DataFrame:
    """Profiles with billable tokens, cache ratio and the advice that applies."""
    p = profiles.withColumn("billable", F.col("input") + F.col("output") + F.col("cache_write"))
    p = p.withColumn("cache_ratio", F.col("cache_read") / F.greatest(F.lit(1), F.col("input") + F.col("cache_read")))
    return p.withColumn("advice", recommendations(p, F.col("loops"), F.col("repeated_calls"), F.col("oversized")))


def profile_stream(calls: DataFrame, top: int = TOP, loop_at: int = LOOP_AT, purge_s: int = PURGE_S, delay: str = "1 hour") -> DataFrame:
    """Each session with new calls, after these: sums and counters, the `top` most repeated calls and heaviest turns, and advice.

    calls: (session, ts, event_id, tool, signature, edited, oversized, input,
    output, cache_read, cache_write); edited names the file that a call edits,
    else null.  A null tool or signature, or a null edited, counts in sums
    only; null numbers are 0; ties go to the smaller tool, signature and event.
    Rows later than `delay` behind the newest are dropped.  Write with output
    mode update; typed_state is set for the Spark session.
    """
    typed_state(calls.sparkSession)
    watched = calls.withWatermark("ts", delay).select("session", "ts", "event_id", "tool", "signature", "edited", "oversized", *_SUMS)
    out = T.StructType([T.StructField("session", watched.schema["session"].dataType), *[T.StructField(c, T.LongType()) for c in _COUNTS]])
    out = out.add("repeated", T._parse_datatype_string(f"array<struct<{_as_struct(_REPEATED)}>>")).add("heaviest", T._parse_datatype_string(f"array<struct<{_as_struct(_HEAVY)}>>"))
    found = watched.groupBy("session").transformWithStateInPandas(SessionProfile(top, loop_at, purge_s), outputStructType=out, outputMode="Update", timeMode="EventTime")
    return with_advice(found)


def _as_struct(fields: str) -> str:
    return ", ".join(":".join(f.split()) for f in fields.split(","))
