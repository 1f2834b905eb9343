"""Caches with an age limit: one for results held by the driver, and the replay
of a log of cache operations as windows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Age limit in milliseconds and most entries, by use.
CONFIGS = {"default": (1_800_000, 1000), "community": (3_600_000, 500), "search": (1_800_000, 1000), "path": (900_000, 200), "answer": (86_400_000, 2000)}


class TtlCache:
    """Values by key; one older than ``ttl`` milliseconds is gone.

    A full cache gives up its oldest entry before it takes another, also where
    the key is known already; entries made at this very instant stay.
    """

    def __init__(self, use: str = "default", clock: Callable[[], float] = lambda: time.time() * 1000):
        self.ttl, self.most = CONFIGS[use]
        self.clock = clock
        self.clear()

    def clear(self) -> None:
        self.entries: dict[str, tuple[float, object]] = {}
        self.hits = self.misses = 0

    def get(self, key: str) -> object | None:
        at, value = self.entries.get(key, (None, None))
        if at is not None and self.clock() - at <= self.ttl:
            self.hits += 1
            return value
        self.entries.pop(key, None)
        self.misses += 1
        return None

    def set(self, key: str, value: object) -> None:
        now = self.clock()
        # Entries lie in the order in which they were set.
        oldest = next(iter(self.entries), None)
        if len(self.entries) >= self.most and self.entries[oldest][0] < now:
            del self.entries[oldest]
        self.entries.pop(key, None)
        self.entries[key] = (now, value)

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}


def replay(operations: DataFrame, ttl: int) -> DataFrame:
    """(key, at, ord, hit) of each ``get`` in a log of operations.

    ``operations``: key, at (milliseconds), ord (order at the same time), op
    (``get``, ``set`` or ``delete``).  A get is a hit if the key's last change
    before it is a set that is at most ``ttl`` old.  Keys are replayed apart, so
    no limit on the number of entries applies.
    """
    before = W.partitionBy("key").orderBy("at", "ord").rowsBetween(W.unboundedPreceding, -1)
    change = F.when(F.col("op") != "get", F.struct("op", "at"))
    last = F.last(change, ignorenulls=True).over(before)
    hit = (last["op"] == "set") & (F.col("at") - last["at"] <= ttl)
    return operations.withColumn("hit", F.coalesce(hit, F.lit(False))).where("op = 'get'").select("key", "at", "ord", "hit")
