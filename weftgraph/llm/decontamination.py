"""Benchmark decontamination by SimHash windows of each item's size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import slices, string_of
from weftgraph.llm.shingles import words_of

#: Items and their text bytes in one index; more items take more passes.
INDEX_ITEMS = 4000
INDEX_BYTES = 32 << 20


class HammingIndex:
    """Fingerprints of 64 bits, found within a radius without exception.

    The bits are cut into blocks.  Of two fingerprints at most ``radius`` bits
    apart, some block differs in at most ``radius // blocks`` bits; each
    fingerprint is therefore listed, block by block, under all values that
    close to its own.  A query reads the list of each of its block values and
    keeps what is within the radius as a whole.
    """

    def __init__(self, prints: np.ndarray, radius: int, blocks: int = 5):
        self.prints, self.radius = prints, radius
        edges = [64 * b // blocks for b in range(blocks + 1)]
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            width = hi - lo
            flips = np.array([sum(1 << i for i in bits) for k in range(radius // blocks + 1) for bits in combinations(range(width), k)], dtype=np.int64)
            own = ((prints >> np.uint64(lo)) & np.uint64((1 << width) - 1)).astype(np.int64)
            values = (own[:, None] ^ flips).ravel()
            items = np.repeat(np.arange(len(prints)), len(flips))
            order = np.argsort(values, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << width))])
            self.blocks.append((lo, width, starts, items[order].astype(np.int32)))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) numbers of all pairs within the radius."""
        found = []
        for lo, width, starts, items in self.blocks:
            value = ((queries >> np.uint64(lo)) & np.uint64((1 << width) - 1)).astype(np.int64)
            n = starts[value + 1] - starts[value]
            q = np.repeat(np.arange(len(queries)), n)
            ends = np.cumsum(n)
            at = np.arange(n.sum()) + np.repeat(starts[value] - (ends - n), n)
            f = items[at]
            close = np.bitwise_count(queries[q] ^ self.prints[f]) <= self.radius
            found.append(q[close] * np.int64(len(self.prints)) + f[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


def window_prints(shingles: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of ``size`` shingles; one that stands in it twice
    weighs twice.  A bit is set where more weight has it set than not."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    total = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0)])
    return np.packbits(2 * (total[size:] - total[:-size]) > size, axis=1).view(np.uint64).ravel()


@dataclass
class Items:
    """Benchmark items of one index."""

    ids: list
    sizes: np.ndarray  # words
    shingles: list[tuple[np.ndarray, np.ndarray]]  # distinct ones and their weights
    vocabulary: dict[int, np.ndarray]  # by size: sorted distinct shingles
    members: np.ndarray  # sorted distinct shingles of all
    of_size: dict[int, np.ndarray]  # by size: which members its items have
    index: HammingIndex
    width: int

    @classmethod
    def of(cls, ids: list, texts: list[str | None], width: int, radius: int) -> Items:
        words = words_of(pa.array(texts, type=pa.large_string()))
        flat, ends = words.windows(width)
        sizes = np.diff(words.bounds)
        keep = np.flatnonzero(sizes > 0)
        lists = [flat[ends[i] : ends[i + 1]] for i in keep]
        prints = np.array([window_prints(x, len(x))[0] for x in lists], dtype=np.uint64)
        sizes = sizes[keep]
        by_size: dict[int, np.ndarray] = {}
        for size in np.unique(sizes).tolist():
            by_size[size] = np.unique(np.concatenate([x for x, n in zip(lists, sizes, strict=True) if n == size]))
        members = np.unique(np.concatenate(lists)) if lists else np.empty(0, dtype=np.uint64)
        return cls([ids[i] for i in keep], sizes, [np.unique(x, return_counts=True) for x in lists], by_size, members, {n: np.isin(members, x) for n, x in by_size.items()}, HammingIndex(prints, radius), width)

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard: least over greatest weights, summed."""
        own, weight = self.shingles[item]
        other, more = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(own, other), len(own) - 1)
        both = np.minimum(weight[at], more)[own[at] == other].sum()
        return float(both / (weight.sum() + len(window) - both))


def _runs(starts: np.ndarray, most: int = 8192) -> Iterator[tuple[int, int]]:
    """Runs of consecutive numbers as [from, to), none longer than ``most``."""
    if not len(starts):
        return
    breaks = np.flatnonzero(np.diff(starts) > 1) + 1
    for part in np.split(starts, breaks):
        for lo in range(int(part[0]), int(part[-1]) + 1, most):
            yield lo, min(lo + most, int(part[-1]) + 1)


def _leaks_of(words: np.ndarray, shingles: np.ndarray, items: Items, threshold: float) -> dict[int, tuple[float, int, int]]:
    """item -> (similarity, distance, first word) of its best window here.

    A window can only reach the threshold if it shares a shingle with an item
    of its size, so windows without one are not fingerprinted.
    """
    best: dict[int, tuple[float, int, int]] = {}
    at = np.minimum(np.searchsorted(items.members, shingles), len(items.members) - 1)
    member = np.flatnonzero(items.members[at] == shingles)
    at = at[member]
    for size, vocabulary in items.vocabulary.items():
        if size < items.width:
            from weftgraph.llm.shingles import Words

            local, _ = Words(words, np.array([0, len(words)])).windows(size, exact=True)
            count, hit = 1, np.flatnonzero(np.isin(local, vocabulary))
        else:
            local, count = shingles, size - items.width + 1
            hit = member[items.of_size[size][at]]
        last = len(local) - count
        if not len(hit) or last < 0:
            continue
        open_ = np.zeros(last + 2, dtype=np.int64)
        np.add.at(open_, np.clip(hit - count + 1, 0, last + 1), 1)
        np.add.at(open_, np.clip(hit + 1, 0, last + 1), -1)
        starts = np.flatnonzero(np.cumsum(open_[:-1]) > 0)
        for lo, hi in _runs(starts):
            prints = window_prints(local[lo : hi + count - 1], count)
            q, f = items.index.near(prints)
            same = items.sizes[f] == size
            for i, item in zip(q[same].tolist(), f[same].tolist(), strict=True):
                similar = items.similarity(item, local[lo + i : lo + i + count])
                if similar >= threshold:
                    found = (similar, -int(np.bitwise_count(prints[i] ^ items.index.prints[item])), -(lo + i))
                    best[item] = max(best.get(item, found), found)
    # To an item of more words the document as a whole is the one window; of
    # words fewer than a shingle's it shares none.
    longer = (items.sizes > len(words)) & (len(shingles) >= threshold * (items.sizes - items.width + 1))
    if len(member) and longer.any():
        prints = window_prints(shingles, len(shingles))
        for item in items.index.near(prints)[1].tolist():
            similar = items.similarity(item, shingles) if longer[item] else 0.0
            if longer[item] and similar >= threshold:
                best[item] = (similar, -int(np.bitwise_count(prints[0] ^ items.index.prints[item])), 0)
    return {k: (s, -d, -w) for k, (s, d, w) in best.items()}


def _leaks_in(column: pa.Array, items: Items, threshold: float) -> Iterator[tuple[int, dict[int, tuple[float, int, int]]]]:
    words = words_of(column)
    flat, ends = words.windows(items.width, exact=True)
    # One look-up for all: by the upper bits first, then exactly.
    table = np.zeros(1 << 20, dtype=bool)
    table[(items.members >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(flat >> np.uint64(44)).astype(np.int64)])
    hits = maybe[np.isin(flat[maybe], items.members)]
    docs = set((np.searchsorted(ends, hits, side="right") - 1).tolist())
    if any(size < items.width for size in items.vocabulary):
        docs = set(range(len(column)))
    for d in sorted(docs):
        leaks = _leaks_of(words.hashes[words.bounds[d] : words.bounds[d + 1]], flat[ends[d] : ends[d + 1]], items, threshold)
        if leaks:
            yield d, leaks


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> Iterator[Items]:
    """Indexes of a bounded number of items and bytes each, however large the
    benchmark is; each goes to the workers with its own pass."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(id_col), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).orderBy(id_col)
    for item, text in rows.toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += len(text)
        if len(ids) >= INDEX_ITEMS or size >= INDEX_BYTES:
            yield Items.of(ids, texts, width, radius)
            ids, texts, size = [], [], 0
    if ids:
        yield Items.of(ids, texts, width, radius)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, width: int = 5, radius: int = 19, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Items that documents hold: doc_id, item_id, similarity, distance, start.

    An item of n words is held if some window of n words (of a document with
    fewer words, the whole of it) has a fingerprint at most ``radius`` bits from the item's and a weighted shingle similarity of
    ``threshold`` or more.  ``radius`` is where two texts of that similarity
    have their expected distance (11 of 64 bits) plus nearly three deviations.
    The best window is given: by similarity, then distance, then place (in
    words).  Narrow: documents are not shuffled.

    Null and empty texts hold nothing, null and empty items are held by none;
    items of fewer words than a shingle are compared as wholes.  Each row of
    ``docs`` is searched by itself; of equal items each is given.  No items or
    no documents give no rows.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = f"doc_id {kind}, item_id {item_kind}, similarity double, distance int, start long"

    def search(items: Items) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(items)  # of a bounded size

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = held.value
            for part in slices(batches, "text"):
                ids, rows = string_of(part, "doc_id"), []
                for d, leaks in _leaks_in(string_of(part, "text"), items, threshold):
                    rows += [(d, items.ids[i], *found) for i, found in leaks.items()]
                if rows:
                    d, i, s, h, w = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array(i), pa.array(s), pa.array(h, type=pa.int32()), pa.array(w, type=pa.int64())], ["doc_id", "item_id", "similarity", "distance", "start"])

        return picked.mapInArrow(run, ddl)

    out = None
    for items in _indexes(benchmark, item_col, item_text_col, width, radius):
        if items.ids:
            out = search(items) if out is None else out.union(search(items))
    return out if out is not None else docs.sparkSession.createDataFrame([], ddl)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, width: int = 5, radius: int = 19, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    schema = docs.schema
    for items in _indexes(benchmark, "item_id", "text", width, radius):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col):
                clean = np.ones(part.num_rows, dtype=bool)
                clean[[d for d, _ in _leaks_in(string_of(part, text_col), held.value, threshold)]] = False
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
