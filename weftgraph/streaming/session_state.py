"""Conversation windows as state with timers: value and list state a session,
dropped after a time without a turn, and reloaded from the log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StringType, StructType

from weftgraph.streaming.memory import SCHEMA, Limits, Window, _row

OUTPUT = f"{SCHEMA}, expired boolean"
#: Built without a session, as workers have none.
OLDER = StructType().add("owner", "string").add("tail", ArrayType(StringType())).add("heads", ArrayType(StringType())).add("dropped", "integer").add("older_turns", "integer")
RECENT = StructType().add("run_id", "string").add("query", "string").add("answer", "string").add("full_query", "string").add("full_answer", "string")
TURN = "session_id string, owner string, run_id string, seq long, query string, answer string, at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionWindows(StatefulProcessor):
    """One window a session.  Its recent turns are a list state, what is older a
    value state, both of a bounded size; a timer ends it ``idle_ms`` after its
    last turn, by the watermark or by the clock.  By the clock, the state has
    that time to live as well."""

    def __init__(self, limits: Limits, idle_ms: int, by_event: bool):
        self.limits, self.idle_ms, self.by_event = limits, idle_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        live = None if self.by_event else self.idle_ms
        self.older = handle.getValueState("older", OLDER, live)
        self.recent = handle.getListState("recent", RECENT, live)

    def _load(self) -> tuple[str | None, Window]:
        if not self.older.exists():
            return None, Window()
        owner, tail, heads, dropped, older_turns = self.older.get()
        recent = [{"run_id": r[0], "query": r[1], "answer": r[2], "full": [r[3], r[4]]} for r in self.recent.get()]
        return owner, Window(recent, list(tail), list(heads), dropped, older_turns)

    def _fold(self, key: tuple, rows: pd.DataFrame, times: object) -> Window:
        """Adds turns in the order of ``seq``, keeps the state, and sets the timer."""
        owner, window = self._load()
        for r in rows.sort_values(["seq", "run_id"]).itertuples():
            own = r.owner if isinstance(r.owner, str) else None
            if owner is not None and own != owner:
                raise ValueError(f"session {key[0]} belongs to another owner")
            owner = own
            window.add(r.run_id, r.query or "", r.answer or "", self.limits)
        self.older.update((owner, window.tail, window.heads, window.dropped, window.older_turns))
        self.recent.put([(t["run_id"], t["query"], t["answer"], *t["full"]) for t in window.recent])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = int(rows["at"].max().timestamp() * 1000) if self.by_event else times.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.idle_ms)
        return window

    def _out(self, key: tuple, window: Window, expired: bool) -> pd.DataFrame:
        return pd.DataFrame([_row(key[0], window, self.limits) | {"expired": expired}])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        yield self._out(key, self._fold(key, pd.concat(list(rows)), timerValues), False)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self._fold(key, initialState, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.older.clear()
        self.recent.clear()
        yield self._out(key, Window(), True)

    def close(self) -> None:
        pass


def _shaped(turns: DataFrame) -> DataFrame:
    return turns.select(*[(F.col(f.name) if f.name in turns.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in StructType.fromDDL(TURN)])


def window_states(turns: DataFrame, idle_ms: int, limits: Limits = Limits(), log: DataFrame | None = None, late: str | None = None) -> DataFrame:
    """The window of each session that a micro-batch touches: ``SCHEMA`` and expired.

    ``turns``: session_id, run_id, seq, query, answer, and ``owner`` and ``at`` (a
    timestamp) if there are.  A session that has no turn for ``idle_ms`` is
    forgotten, with a last row that says so and has nothing else.  Time is that
    of ``at`` if ``late`` gives how late a turn may be, else the clock's.

    ``log`` holds the turns of the sessions so far (as ``build_turns`` gives them,
    a batch table): a new query begins with their windows, so one that was
    forgotten, or whose state is lost, comes back as it was; a session's history
    may also come as rows of the stream, stamped as its new turn is (earlier ones
    would be late), as runs that the window has are ignored.  A session whose turns name two owners fails the
    query, as no window may cross owners.

    The session must use the state store of ``PROVIDER``.
    """
    by_event = late is not None
    stream = _shaped(turns).withWatermark("at", late) if by_event else _shaped(turns)
    begin = None if log is None else _shaped(log).groupBy("session_id")
    processor = SessionWindows(limits, idle_ms, by_event)
    return stream.groupBy("session_id").transformWithStateInPandas(processor, StructType.fromDDL(OUTPUT), "Update", "EventTime" if by_event else "ProcessingTime", begin)
