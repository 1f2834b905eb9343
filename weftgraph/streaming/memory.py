"""Conversation windows with a token budget, in batch and as a stream.

One fold (``Window``) serves both; a window is no frame of SQL, as what leaves
it depends on a running budget.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftgraph.functions import tokens

TAIL_LINES = 3
HEAD_WORDS = 12


@dataclass(frozen=True)
class Limits:
    max_turns: int = 8
    max_tokens: int = 512
    history_tokens: int = 1500


@dataclass
class Window:
    """Recent turns in full, older lines as a tail and condensed heads."""

    recent: list[dict] = field(default_factory=list)
    tail: list[str] = field(default_factory=list)
    heads: list[str] = field(default_factory=list)
    dropped: int = 0
    older_turns: int = 0

    def _size(self) -> int:
        return sum(tokens.count(t["query"]) + tokens.count(t["answer"]) for t in self.recent)

    def _older_line(self, line: str, limits: Limits) -> None:
        self.tail.append(line)
        if len(self.tail) > TAIL_LINES:
            words = (oldest := self.tail.pop(0)).split()
            self.heads.append(oldest if len(words) <= HEAD_WORDS else " ".join(words[:HEAD_WORDS]) + " …")
        while self.heads and sum(map(tokens.count, self.heads)) > limits.history_tokens:
            self.heads.pop(0)
            self.dropped += 1

    def _retire(self, limits: Limits) -> None:
        turn = self.recent.pop(0)
        self.older_turns += 1
        for role, text in (("User", turn["full"][0]), ("Assistant", turn["full"][1])):
            for line in text.split("\n"):
                if line.strip():
                    self._older_line(f"{role}: {line.strip()}", limits)

    def add(self, run_id: str, query: str, answer: str, limits: Limits) -> bool:
        """Takes a turn; blank answers and runs in the window are ignored."""
        if not answer.strip() or any(t["run_id"] == run_id for t in self.recent):
            return False
        self.recent.append({"run_id": run_id, "query": query, "answer": answer, "full": [query, answer]})
        while len(self.recent) > limits.max_turns or (len(self.recent) > 1 and self._size() > limits.max_tokens):
            self._retire(limits)
        if self._size() > limits.max_tokens:
            only = self.recent[0]
            only["query"] = tokens.cap(only["full"][0], limits.max_tokens)
            only["answer"] = tokens.cap(only["full"][1], limits.max_tokens - tokens.count(only["query"]))
        return True

    def summary(self, limits: Limits) -> str:
        """Older lines within the budget: heads that fit, newest first, and the
        tail; a mark says how many lines are left out."""
        cost = lambda line: tokens.count(line) + 1
        tail = [tokens.cap(x, limits.history_tokens // 4) for x in self.tail]
        total = len(self.heads) + self.dropped
        free = limits.history_tokens - sum(map(cost, tail))

        def fitting(budget: int) -> int:
            used = taken = 0
            for head in reversed(self.heads):
                used += cost(head)
                if used > budget:
                    break
                taken += 1
            return taken

        if not total and not tail:
            return ""
        if not self.dropped and fitting(free) == len(self.heads):
            return "\n".join([*self.heads, *tail])
        mark = "[{} earlier lines condensed out]".format
        taken = fitting(free - cost(mark(total)))
        first = [mark(total - taken)] if total > taken else []
        return "\n".join([*first, *self.heads[len(self.heads) - taken :], *tail])


def _row(session: str, window: Window, limits: Limits) -> dict:
    return {"session_id": session, "kept": len(window.recent), "older": window.older_turns, "messages": 2 * len(window.recent), "tokens": window._size(), "first_run": window.recent[0]["run_id"] if window.recent else None, "summary": window.summary(limits)}


SCHEMA = "session_id string, kept int, older int, messages int, tokens int, first_run string, summary string"
ARROW = pa.schema([(x.split()[0], pa.int32() if x.endswith(" int") else pa.string()) for x in SCHEMA.split(", ")])


def windows(turns: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The window of each session after all its turns (by ``seq``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted turns stream through; only the window of one session is held.
        now, window = None, None
        for part in batches:
            done = []
            for row in part.to_pylist():
                if window is None or row["session_id"] != now:
                    if window is not None:
                        done.append(_row(now, window, limits))
                    now, window = row["session_id"], Window()
                window.add(row["run_id"], row["query"] or "", row["answer"] or "", limits)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=ARROW)
        if window is not None:
            yield pa.RecordBatch.from_pylist([_row(now, window, limits)], schema=ARROW)

    rows = turns.select("session_id", "run_id", "seq", "query", "answer")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "seq", "run_id").mapInArrow(run, SCHEMA)


def window_stream(turns: DataFrame, limits: Limits = Limits(), idle: str | None = None) -> DataFrame:
    """The same of a stream of turns: each micro-batch updates its sessions.

    State is the window as JSON, of a bounded size.  With ``idle`` (such as
    ``10 minutes``) a session that long without a turn is forgotten.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = Window(**json.loads(state.get[0])) if state.exists else Window()
        rows = pd.concat(list(batches))
        for r in rows.sort_values(["seq", "run_id"]).itertuples():
            window.add(r.run_id, r.query or "", r.answer or "", limits)
        state.update((json.dumps(asdict(window)),))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame([_row(key[0], window, limits)])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return turns.select("session_id", "run_id", "seq", "query", "answer").groupBy("session_id").applyInPandasWithState(update, SCHEMA, "window string", "update", timeout)


def memory_stats(folded: DataFrame, recalls: DataFrame | None = None) -> DataFrame:
    """Sums over windows, and the counters of recall calls if a table of them is
    given: ``others`` (turns of other runs) and ``items`` (what was found)."""
    out = folded.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("kept"), F.lit(0)).alias("turns"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    if recalls is None:
        return out
    hit = (F.col("others") > 0) & (F.col("items") > 0)
    counted = recalls.agg(F.count("*").alias("recall_calls"), F.count_if(hit).alias("recall_hits"), F.count_if(~hit).alias("recall_empty"))
    return out.crossJoin(counted)  # one row each
