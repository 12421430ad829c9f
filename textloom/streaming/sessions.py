"""Streaming forms of the rate limiter and of conversation memory, on transformWithState.

State is bounded: at most ``limit`` admitted times, or the last ``n`` messages, a session. Where the stream has an event time ``ts`` it also ends: an
event-time timer drops a session's calls once the watermark is a window past its last one (they would count for nothing, so results are the same), and its
messages once it has been ``idle`` for that long. A stream without ``ts`` keeps a session's state. Both need the RocksDB state store
(``state_store``) and go on from their checkpoint after a restart. Late data: events more than ``WATERMARK`` behind are dropped; within a batch a session's events are taken in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textloom import config

S = config.SETTINGS
WATERMARK = "2 minutes"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Ending(StatefulProcessor):
    """A session's state, dropped by a timer ``idle_ms`` after its last row in event time; never if that is None."""

    columns: tuple = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def renew(self, ts) -> None:
        """One timer a session, after the latest of its rows."""
        if self.idle_ms is not None:
            due = int(ts.max().timestamp() * 1000) + self.idle_ms + 1
            known = list(self.handle.listTimers())
            for t in known:
                if t < due:
                    self.handle.deleteTimer(t)
            if not known or max(known) < due:
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        self.state.clear()
        yield pd.DataFrame({c: [] for c in self.columns})

    def close(self) -> None:
        pass


class _Limiter(_Ending):
    columns = ("session", "event_id", "limited")

    def __init__(self, window_us: int, limit: int, reset: str | None, idle_ms: int | None):
        self.window_us, self.limit, self.reset, self.idle_ms = window_us, limit, reset, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.hits = self.state = handle.getValueState("hits", "hits array<bigint>")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        events = pd.concat(list(rows)).sort_values(["us", "event_id"])
        hits = list(self.hits.get()[0]) if self.hits.exists() else []
        out = []
        for us, event, kind in zip(events["us"], events["event_id"], events["kind"], strict=True):
            hits = [h for h in hits if us - h <= self.window_us]
            ok = len(hits) < self.limit
            if ok:
                hits.append(int(us))
            out.append((key[0], int(event), not ok))
            if self.reset is not None and kind == self.reset:
                hits = []
        self.hits.update((hits,))
        self.renew(events.get("ts"))
        yield pd.DataFrame(out, columns=list(self.columns))


def rate_limited(events: DataFrame, window_us: int = 60_000_000, limit: int = S.rate_limit_per_minute, reset: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """(session, event_id, limited) from a stream of (session bigint, us bigint, event_id bigint, kind string[, ts timestamp])."""
    timed = "ts" in events.columns
    if timed:
        events = events.withWatermark("ts", watermark)
    by = _Limiter(window_us, limit, reset, -(-window_us // 1000) if timed else None)
    return events.groupBy("session").transformWithStateInPandas(by, "session bigint, event_id bigint, limited boolean", "append", "eventTime" if timed else "none")


class _Memory(_Ending):
    columns = ("session", "history")

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = self.state = handle.getValueState("last", "lines array<string>")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        said = pd.concat(list(rows)).sort_values("turn")
        lines = list(self.last.get()[0]) if self.last.exists() else []
        for role, text in zip(said["role"], said["text"], strict=True):
            lines = [] if role == "reset" else [*lines, f"{(role or '').upper()}: {text or ''}"][-self.n :]
        self.last.update((lines,))
        self.renew(said.get("ts"))
        yield pd.DataFrame({"session": [key[0]], "history": ["\n".join(lines)]})


def conversation_memory(messages: DataFrame, n: int = S.conversation_memory_turns, idle_seconds: int = 86_400, watermark: str = WATERMARK) -> DataFrame:
    """(session, history): the last n messages after each batch, from a stream of (session bigint, turn bigint, role string, text string[, ts timestamp]); role ``reset`` clears.

    With ``ts`` a session that has said nothing for ``idle_seconds`` is forgotten.
    """
    timed = "ts" in messages.columns
    if timed:
        messages = messages.withWatermark("ts", watermark)
    by = _Memory(n, idle_seconds * 1000 if timed else None)
    return messages.groupBy("session").transformWithStateInPandas(by, "session bigint, history string", "update", "eventTime" if timed else "none")
