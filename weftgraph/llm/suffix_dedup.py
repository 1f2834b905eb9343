"""Removal of passages that earlier documents have, by a sparse suffix array.

A passage is a string of ``LENGTH`` bytes; its window is its place in a text.
Only suffixes at minimisers are sorted: in each window, the suffix whose
``HEAD`` leading bytes have the least hash.  Equal windows have their minimiser
at the same place, so no match is missed; consecutive windows mostly share one.
An *entry* is a minimiser with the consecutive windows that have it.  Its *row*
holds the bytes themselves: those of the suffix, then those in front of it from
the nearest on, zero beyond the entry's windows.

1. A suffix whose head stands in one document only matches nothing and needs no
   sorting.  Tasks exchange digests of heads (a head that a task has seen in two
   documents only once), so equal heads always meet; digests decide nothing else.
2. Rows of the others are range-partitioned by all their bytes, at splitters
   sampled from them.  Of equal rows a task sends the first document's only.
   Each bucket sorts its rows by multikey quicksort, eight bytes a key, once by
   the suffixes and once by the bytes in front, and takes the common prefixes
   of neighbours.  Two rows share the window that starts ``j`` bytes in front of
   the suffix if they lie in one run of suffixes with ``50 - j`` bytes in common
   and in one run of fronts with ``j`` bytes in common.
3. A run that has as many bytes in common with one of its bucket's splitters may
   go on beyond it.  Its windows, once each with the least document that the
   bucket has, are compared across boundaries in a second exchange, by window.
   So even one suffix in a third of all documents is split over buckets.
4. Verdicts go back to the documents as spans, which are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import SLICE_BYTES, bucketed, dropped_after, release, slices, string_of, written
from weftgraph.llm.segments import column_bytes
from weftgraph.llm.shingles import _VALUES, _powers, mixed

LENGTH = 50
HEAD = 16
_SPAN = LENGTH - HEAD  # a window starts at most so far before its minimiser
#: A row is LENGTH bytes and six zeros, _SPAN bytes and six zeros: twelve keys of eight bytes.
_FRONT, ROW = 56, 96
_BLOCK_BITS = 21
_MASK = np.uint64((1 << _BLOCK_BITS) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: Rows that one bucket sorts; larger corpora take larger buckets.
BUCKET_ROWS = (1 << 18, 1 << 21)
#: Rows that splitters are chosen from, at most (20 MB on the driver).  They only
#: balance the buckets.
SAMPLE = 200_000
#: Entries that a task combines and sends at once.
SENT = 400_000
#: Documents in a row whose verdicts travel together: 2 ** 12.
_GROUP_BITS = 12
#: Bits of a uid that number a document in its partition.
_ROW_BITS = 33
#: Bytes of text whose heads one task compares, about.
PART_BYTES = 8 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


class Entries:
    """Entries of the texts of a slice, as arrays."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        parts, windows, step = [], max(len(data) - LENGTH + 1, 0), 1 << (_BLOCK_BITS - 1)
        for at in range(0, windows, step):
            # An entry belongs to the block of its first window, whole: cut at
            # a block's edge, it would depend on where a text lies in a slice.
            block = self._block(data, offsets, max(at - 1, 0), min(at + step + _SPAN, windows))
            own = (block[3] >= at) & (block[3] < at + step)
            parts.append(tuple(c[own] for c in block))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        #: Digests of head and windows, minimiser, first and last window start.
        self.head, self.whole, self.place, self.first, self.last = cols
        self.doc = np.searchsorted(offsets, self.first, side="right") - 1
        self.data, self.offsets, self._around = data, offsets, None

    @staticmethod
    def _block(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        part = data[lo : hi + LENGTH - 1]
        n = len(part)
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUES[part] * power[:n], out=sums[1:])
        heads = mixed((sums[HEAD:] - sums[:-HEAD]) * inverse[: n - HEAD + 1])
        # Hash above, place below: the least has the least hash, and is leftmost.
        low = (heads & ~_MASK) | np.arange(len(heads), dtype=np.uint64)
        width = 1
        while width < _SPAN + 1:
            step = min(width, _SPAN + 1 - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        valid = np.ones(hi - lo, dtype=bool)
        a, b = np.searchsorted(offsets, [lo, hi + LENGTH])
        for end in offsets[max(a, 1) : b].tolist():
            valid[max(0, end - LENGTH + 1 - lo) : max(0, end - lo)] = False
        start = np.flatnonzero(valid)
        place = (low[start] & _MASK).astype(np.int64)
        if not len(start):
            return tuple(np.empty(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))
        first, last, place = start[new], start[np.append(new[1:], len(start)) - 1], place[new]
        whole = (sums[last + LENGTH] - sums[first]) * inverse[first] + (place - first).astype(np.uint64) * _A + (last - first).astype(np.uint64) * _B
        return heads[place], mixed(whole), place + lo, first + lo, last + lo

    def own_place(self) -> np.ndarray:
        """Places counted from the start of each text."""
        return (self.place - self.offsets[self.doc]).astype(np.uint32)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The rows of some entries, (n, ROW) bytes."""
        if self._around is None:
            padded = np.concatenate([np.zeros(_SPAN, dtype=np.uint8), self.data, np.zeros(LENGTH, dtype=np.uint8)])
            self._around = np.lib.stride_tricks.sliding_window_view(padded, _SPAN + LENGTH)
        around = self._around[self.place[at]]
        out = np.zeros((len(at), ROW), dtype=np.uint8)
        behind, front = self.last[at] + LENGTH - self.place[at], self.place[at] - self.first[at]
        out[:, :LENGTH] = around[:, _SPAN:] * (np.arange(LENGTH) < behind[:, None])
        out[:, _FRONT : _FRONT + _SPAN] = around[:, _SPAN - 1 :: -1] * (np.arange(_SPAN) < front[:, None])
        return out


def suffix_order(rows: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Order of rows by their bytes from ``start`` to ``stop``.

    Multikey quicksort with keys of eight bytes: all rows are sorted by the
    first, and only inside runs of equal ones by the next.
    """
    keys = rows[:, start:stop].view(">u8")
    first = keys[:, 0].astype(np.uint64)
    order = np.argsort(first)
    same = first[order][1:] == first[order][:-1]
    for k in range(1, keys.shape[1]):
        inside = np.zeros(len(order), dtype=bool)
        inside[1:] |= same
        inside[:-1] |= same
        at = np.flatnonzero(inside)
        if not len(at):
            break
        run = np.cumsum(~np.append(False, same))[at]
        own = keys[order[at], k].astype(np.uint64)
        by = np.lexsort((own, run))
        order[at] = order[at][by]
        own, equal = own[by], np.zeros(len(order), dtype=bool)
        equal[at[1:]] = own[1:] == own[:-1]
        same &= equal[1:]
    return order


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes each row of ``a`` has in common with ``b``'s."""
    out = np.empty(len(a), dtype=np.int8)
    for lo in range(0, len(a), 1 << 17):  # bounds the mask
        differ = a[lo : lo + (1 << 17)] != (b if b.ndim == 1 else b[lo : lo + (1 << 17)])
        out[lo : lo + (1 << 17)] = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return out


class SortedRows:
    """Rows sorted by suffixes and by fronts, with neighbours' common prefixes."""

    def __init__(self, rows: np.ndarray):
        self.sides = []
        for start, size, stop in ((0, LENGTH, _FRONT), (_FRONT, _SPAN, ROW)):
            order = suffix_order(rows, start, stop)
            own = np.ascontiguousarray(rows[order, start : start + size])
            common = common_prefix(own[1:], own[:-1]) if len(own) else np.empty(0, dtype=np.int8)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            edge = np.concatenate([[-1], common, [-1]]).astype(np.int8)
            self.sides.append((rank, common, np.maximum(edge[1:], edge[:-1])[rank] if len(order) else common))

    def shared(self, j: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``among`` that may share their window at distance ``j`` with
        another, run of each): equal runs mean equal windows."""
        (rank, common, best), (rank_f, common_f, best_f) = self.sides
        pick = np.flatnonzero(among & (best >= LENGTH - j) & (best_f >= j))
        if not len(pick):
            return pick, pick
        run = np.append(0, np.cumsum(common < LENGTH - j))[rank[pick]]
        front = np.append(0, np.cumsum(common_f < j))[rank_f[pick]]
        return pick, run * (len(rank) + 1) + front


def later_ones(run: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which rows have a greater id than the least of their run."""
    if not len(run):
        return np.empty(0, dtype=bool)
    order = np.argsort(run)
    new = np.flatnonzero(np.append(True, run[order][1:] != run[order][:-1]))
    least = np.repeat(np.minimum.reduceat(ids[order], new), np.diff(np.append(new, len(run))))
    out = np.empty(len(run), dtype=bool)
    out[order] = ids[order] > least
    return out


def _zipped(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unzipped(data: bytes, size: int, kind: str = "u1") -> np.ndarray:
    if not size:
        return np.empty(0, dtype=kind)
    return np.frombuffer(pa.decompress(data, decompressed_size=size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind)


_PACKED = "at long, kind binary, n long, rows binary, spans binary, ids binary, uids binary, places binary, masks binary"
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    types = {"at": pa.int64(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, type=types.get(x, pa.binary())) for c, x in zip(cols, _NAMES, strict=True)], _NAMES)


def _by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows with one ``at``; they come sorted by it."""
    now, held = None, []
    for part in batches:
        for row in part.to_pylist():
            if row["at"] != now and held:
                yield now, held
                held = []
            now = row["at"]
            held.append(row)
    if held:
        yield now, held


def _parted(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places that have it) for each distinct key."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
        yield int(key[order[a]]), order[a:b]


def _verdict_rows(kind: bytes, uid: np.ndarray, place: np.ndarray, mask: np.ndarray) -> list[tuple]:
    """For the documents: kind ``m``, windows that go as bits by distance from
    the suffix; kind ``a``, an entry that has the verdict of an equal one."""
    return [(g, kind, len(at), None, None, None, _zipped(uid[at]), _zipped(place[at]), _zipped(mask[at])) for g, at in _parted(uid >> _GROUP_BITS)]


def _heads(texts: DataFrame, parts: int) -> DataFrame:
    """Digests of heads by bucket (kind ``h``), and entries that are asked for
    since the task has their head in several documents (kind ``k``)."""

    def send(entries: Entries, at: np.ndarray, uid: np.ndarray) -> list[tuple]:
        # Hashed anew: a minimiser has the least hash of a window, so most heads would
        # fall into the first buckets.
        head = mixed(entries.head[at]) >> np.uint64(24)
        by = np.lexsort((entries.doc[at], head))
        order, head = at[by], head[by]
        doc, place = entries.doc[order], entries.own_place()[order]
        new = np.append(True, head[1:] != head[:-1])
        start = np.flatnonzero(new)
        many = doc[np.append(start[1:], len(head)) - 1] != doc[start]
        single = ~many[np.cumsum(new) - 1]
        out = _asked_rows(uid[doc[~single]], place[~single])
        # Of the others, a document's first entry and the rest of them; of these, one without a document.
        for flag, pick in ((b"1", np.flatnonzero(single)), (b"2", start[many])):
            for b, k in _parted((head[pick] >> np.uint64(20)).astype(np.int64) * parts >> 20):
                k = pick[k]
                digest = head[k].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                out.append((b, b"h", len(k), _zipped(digest), flag, None, None if flag == b"2" else _zipped(uid[doc[k]]), None if flag == b"2" else _zipped(place[k]), None))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            entries, uid = Entries(*column_bytes(string_of(part, "text"))), string_of(part, "uid").to_numpy()
            for lo in range(0, len(entries.place), SENT):
                yield _packed(send(entries, np.arange(lo, min(lo + SENT, len(entries.place))), uid))

    return texts.where("id is not null and text is not null").select("uid", "text").mapInArrow(run, _PACKED)


def _asked_rows(uid: np.ndarray, place: np.ndarray) -> list[tuple]:
    return [(g, b"k", len(at), None, None, None, _zipped(uid[at]), _zipped(place[at]), None) for g, at in _parted(uid >> _GROUP_BITS)]


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries whose head has come from several tasks or documents."""
    for _, held in _by_key(batches):
        others = [tuple(r.values()) for r in held if r["kind"] != b"h"]
        if others:
            yield _packed(others)
        own = sorted((r for r in held if r["kind"] == b"h"), key=lambda r: r["spans"])
        held.clear()
        single = [r for r in own if r["spans"] == b"1"]
        if not single:
            continue
        head = np.zeros((sum(r["n"] for r in own), 8), dtype=np.uint8)
        head[:, :5] = np.concatenate([_unzipped(r["rows"], r["n"] * 5) for r in own]).reshape(-1, 5)
        head = head.view("<u8").ravel()
        uid, place = (np.concatenate([_unzipped(r[c], r["n"], t) for r in single]) for c, t in (("uids", "<i8"), ("places", "<u4")))
        own.clear()
        order = np.argsort(head)
        new = np.flatnonzero(np.append(True, head[order][1:] != head[order][:-1]))
        # Rows without a document have a number of their own, less than any.
        who = np.concatenate([uid, -1 - np.arange(len(head) - len(uid))])[order]
        several = np.maximum.reduceat(who, new) != np.minimum.reduceat(who, new)
        pick = np.zeros(len(head), dtype=bool)
        pick[order] = np.repeat(several, np.diff(np.append(new, len(head))))
        pick = pick[: len(uid)]
        yield _packed(_asked_rows(uid[pick], place[pick]))


def _asks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, asks): places of the entries that are asked for, in order."""
    for _, held in _by_key(batches):
        uid, place = (np.concatenate([_unzipped(r[c], r["n"], t) for r in held]) for c, t in (("uids", "<i8"), ("places", "<u4")))
        held.clear()
        order = np.lexsort((place, uid))
        uid, place = uid[order], place[order]
        cuts = np.append(np.flatnonzero(np.append(True, uid[1:] != uid[:-1])), len(uid))
        yield pa.RecordBatch.from_arrays([pa.array(uid[cuts[:-1]]), pa.array([place[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], type=pa.binary())], ["uid", "asks"])


def _asked(entries: Entries, asks: list[bytes]) -> np.ndarray:
    """The entries of a slice that are asked for."""
    place = np.frombuffer(b"".join(asks), dtype=np.uint32)
    wanted = np.repeat(np.arange(len(asks), dtype=np.int64), [len(a) // 4 for a in asks]) << 32 | place
    own = entries.doc.astype(np.int64) << 32 | entries.own_place()
    at = np.minimum(np.searchsorted(wanted, own), max(len(wanted) - 1, 0))
    return np.flatnonzero(wanted[at] == own) if len(wanted) else np.empty(0, dtype=np.int64)


def _splitters(asked: DataFrame, buckets: int, docs: int, rows: int) -> np.ndarray:
    """Rows that cut a sample of the rows that are asked for into equal parts."""
    share = min(1.0, max(1000, 32 * buckets) / max(docs, 1))
    stride = int(rows * share / SAMPLE) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            entries = Entries(*column_bytes(string_of(part, "text")))
            own = entries.rows(_asked(entries, string_of(part, "asks").to_pylist())[::stride])
            yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()])], ["rows"])

    picked = asked.where(F.pmod(F.xxhash64("uid"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    found = b"".join(r[0] for r in picked.select("text", "asks").mapInArrow(run, "rows binary").collect())
    sample = np.sort(np.frombuffer(found, dtype=f"S{ROW}"))
    return np.unique(sample[np.arange(1, buckets) * len(sample) // buckets]) if len(sample) else sample


def _sent(asked: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Rows by bucket (kind ``s``), and verdicts that a task found by itself."""
    held = asked.sparkSession.sparkContext.broadcast(splitters)

    def send(entries: Entries, at: np.ndarray, uid: np.ndarray, id_: np.ndarray) -> list[tuple]:
        doc, rows = entries.doc[at], entries.rows(at)
        place = entries.own_place()[at]
        spans = np.column_stack([entries.place[at] - entries.last[at], entries.place[at] - entries.first[at]]).astype(np.uint8)
        # Equal rows: digests find them, bytes decide.
        order = np.lexsort((place, doc, id_[doc], entries.whole[at]))
        digest = entries.whole[at][order]
        alike = np.flatnonzero(digest[1:] == digest[:-1]) + 1
        a, b = order[alike], order[alike - 1]
        new = np.ones(len(order), dtype=bool)
        new[alike] = (rows[a] != rows[b]).any(axis=1) | (spans[a] != spans[b]).any(axis=1)
        run = np.cumsum(new) - 1
        least = id_[doc[order[new]]][run]
        mine = id_[doc[order]] == least
        again = ~new & np.append(False, doc[order[1:]] == doc[order[:-1]])
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))  # the document's first of them
        out, later, twice, keep = [], order[~mine], order[mine & again], order[mine & ~again]
        bits = (np.uint64(2) << spans[:, 1].astype(np.uint64)) - (np.uint64(1) << spans[:, 0].astype(np.uint64))
        out += _verdict_rows(b"m", uid[doc[later]], place[later], bits[later])
        out += _verdict_rows(b"a", uid[doc[twice]], place[twice], place[order[lead[mine & again]]].astype(np.uint64))
        keep = keep[np.argsort(rows[keep, :8].view(">u8").ravel())]
        bucket = np.searchsorted(held.value, rows[keep].view(f"S{ROW}").ravel(), side="right") if len(held.value) else np.zeros(len(keep), dtype=np.int64)
        for b, k in _parted(bucket):
            k = keep[k]
            out.append((b, b"s", len(k), _zipped(rows[k]), _zipped(spans[k]), _zipped(id_[doc[k]]), _zipped(uid[doc[k]]), _zipped(place[k]), None))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            entries = Entries(*column_bytes(string_of(part, "text")))
            uid, id_ = string_of(part, "uid").to_numpy(), string_of(part, "id").to_numpy()
            at = _asked(entries, string_of(part, "asks").to_pylist())
            for lo in range(0, len(at), SENT):
                yield _packed(send(entries, at[lo : lo + SENT], uid, id_))

    return asked.select("uid", "id", "text", "asks").mapInArrow(run, _PACKED)


def _judge(splitters: np.ndarray, parts: int):
    """Sorts buckets.  Rows: verdicts, and open windows (kind ``o``) by window."""
    power, _ = _powers(LENGTH)

    def open_windows(rows: np.ndarray, ids: np.ndarray, uid: np.ndarray, place: np.ndarray, found: list[tuple[int, np.ndarray]]) -> list[tuple]:
        out = []
        for j, at in found:
            window = np.concatenate([rows[at, _FRONT : _FRONT + j][:, ::-1], rows[at, : LENGTH - j]], axis=1)
            key = (mixed((_VALUES[window] * power[:LENGTH]).sum(axis=1)) % np.uint64(parts)).astype(np.int64)
            for k, own in _parted(key):
                where = at[own]
                out.append((k, b"o", len(own), _zipped(window[own]), _zipped(np.full(len(own), j, dtype=np.uint8)), _zipped(ids[where]), _zipped(uid[where]), _zipped(place[where]), None))
        return out

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_key(batches):
            own = [r for r in held if r["kind"] == b"s"]
            others = [tuple(r.values()) for r in held if r["kind"] != b"s"]
            if others:
                yield _packed(others)
            held.clear()
            if not own:
                continue
            rows = np.concatenate([_unzipped(r["rows"], r["n"] * ROW) for r in own]).reshape(-1, ROW)
            spans = np.concatenate([_unzipped(r["spans"], r["n"] * 2) for r in own]).reshape(-1, 2).astype(np.int8)
            ids, uid, place = (np.concatenate([_unzipped(r[c], r["n"], t) for r in own]) for c, t in (("ids", "<i8"), ("uids", "<i8"), ("places", "<u4")))
            own.clear()
            beyond = np.full(len(rows), -1, dtype=np.int8)
            for k in (bucket - 1, bucket):
                if 0 <= k < len(splitters):
                    edge = np.frombuffer(splitters[k].ljust(ROW, b"\0"), dtype=np.uint8)[:LENGTH]
                    beyond = np.maximum(beyond, common_prefix(rows[:, :LENGTH], edge))
            ordered, masks, found = SortedRows(rows), np.zeros(len(rows), dtype=np.uint64), []
            for j in range(_SPAN + 1):
                has = (spans[:, 0] <= j) & (j <= spans[:, 1])
                pick, run = ordered.shared(j, has)
                later = pick[later_ones(run, ids[pick])]
                masks[later] |= np.uint64(1) << np.uint64(j)
                left = has & (beyond >= LENGTH - j)
                left[later] = False
                if left.any():
                    found.append((j, np.flatnonzero(left)))
            some = masks > 0
            yield _packed(_verdict_rows(b"m", uid[some], place[some], masks[some]))
            yield _packed(open_windows(rows, ids, uid, place, found))

    return judge


def _across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares open windows of several buckets; rows are verdicts."""
    for _, held in _by_key(batches):
        windows = np.zeros((sum(r["n"] for r in held), _FRONT), dtype=np.uint8)
        windows[:, :LENGTH] = np.concatenate([_unzipped(r["rows"], r["n"] * LENGTH) for r in held]).reshape(-1, LENGTH)
        j, ids, uid, place = (np.concatenate([_unzipped(r[c], r["n"], t) for r in held]) for c, t in (("spans", "u1"), ("ids", "<i8"), ("uids", "<i8"), ("places", "<u4")))
        held.clear()
        order = suffix_order(windows, 0, _FRONT)
        run = np.empty(len(order), dtype=np.int64)
        run[order] = np.cumsum(np.append(False, (windows[order[1:]] != windows[order[:-1]]).any(axis=1)))
        later = later_ones(run, ids)
        yield _packed(_verdict_rows(b"m", uid[later], place[later], np.uint64(1) << j[later].astype(np.uint64)))


def _intervals(place: np.ndarray, mask: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, stop) of the bytes that windows cover: one row a run of bits."""
    out = []
    while len(mask):
        low = mask & (~mask + np.uint64(1))
        first = np.log2(low.astype(np.float64)).astype(np.int64)  # exact: a power of two
        rest = ~(mask >> first.astype(np.uint64))
        many = np.log2((rest & (~rest + np.uint64(1))).astype(np.float64)).astype(np.int64)
        out.append((owner, place - (first + many - 1), place - first + LENGTH))
        mask = mask & ~(((np.uint64(1) << many.astype(np.uint64)) - np.uint64(1)) << first.astype(np.uint64))
        more = mask > 0
        place, mask, owner = place[more], mask[more], owner[more]
    if not out:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, spans): maximal runs of removed bytes of each document."""
    for _, held in _by_key(batches):
        tables = {}
        for kind in (b"m", b"a"):
            own = [r for r in held if r["kind"] == kind]
            tables[kind] = [np.concatenate([_unzipped(r[c], r["n"], t) for r in own] or [np.empty(0, dtype=t)]) for c, t in (("uids", "<i8"), ("places", "<u4"), ("masks", "<u8"))]
        held.clear()
        uid, place, mask = tables[b"m"]
        if not len(uid):
            continue
        who, owner = np.unique(uid, return_inverse=True)
        key = owner.astype(np.int64) << 32 | place
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        key, mask = key[order][new], np.bitwise_or.reduceat(mask[order], new)
        uid, place, lead = tables[b"a"]
        known = np.minimum(np.searchsorted(who, uid), len(who) - 1)
        wanted = known << 32 | lead.astype(np.int64)
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        hit = (who[known] == uid) & (key[at] == wanted)
        key, mask = np.concatenate([key, known[hit] << 32 | place[hit]]), np.concatenate([mask, mask[at[hit]]])
        owner, start, stop = _intervals(key & 0xFFFFFFFF, mask, key >> 32)
        order = np.lexsort((start, owner))
        owner, start, stop = owner[order], start[order], stop[order]
        reach = np.maximum.accumulate((owner << 33) + stop)  # of earlier owners it is less
        new = np.append(True, (owner << 33)[1:] + start[1:] > reach[:-1])
        at = np.flatnonzero(new)
        pairs = np.column_stack([start[at], (reach - (owner << 33))[np.append(at[1:], len(owner)) - 1]])
        cuts = np.searchsorted(owner[at], np.arange(len(who) + 1))
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array([pairs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], type=pa.binary())], ["uid", "spans"])


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python gets a slice at once inside.  Spark's own limit is eight times as
    much, which the executor's JVM holds as well, for each task."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def parts_for(size: int, partitions: int) -> int:
    """Parts of a table with ``size`` bytes of text: however few partitions it
    comes in, a part doesn't grow with it."""
    return max(8, 3 * partitions, -(-size // PART_BYTES))


def dealt(rows: DataFrame, parts: int, groups: int = 1) -> DataFrame:
    """Rows by ``at``, in its order.

    ``at`` is a bucket's number or that of a group of documents: its partition
    above, its place among the partition's groups, ``groups`` at most, below.
    Both are dealt in turn, since by hash some tasks would get several keys and
    many none.
    """
    bits = _ROW_BITS - _GROUP_BITS
    number = F.shiftright("at", bits) * F.lit(groups) + F.col("at").bitwiseAND(F.lit((1 << bits) - 1))
    return rows.repartitionById(parts, F.pmod(number, F.lit(parts)).cast("int")).sortWithinPartitions("at")


class _Verdicts:
    """The written texts, and the spans of each that go."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        kind = docs.schema[id_col].dataType
        if not isinstance(kind, T.IntegralType):
            raise TypeError(f"{id_col} is {kind.simpleString()}; ids must be whole numbers")
        spark = docs.sparkSession
        self.uid = next(n for n in ("uid", "uid_", "uid__", "uid___") if n not in docs.columns)
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        sized = docs.select(row.alias("row"), F.octet_length(F.col(text_col).cast("string")).alias("size"))
        size, last = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("row"), F.lit(0))).first()
        parts, groups = parts_for(size, docs.rdd.getNumPartitions()), (last >> _GROUP_BITS) + 1
        # Written by hash of uid, so that no later join moves texts.
        self.texts = bucketed(docs.withColumn(self.uid, F.monotonically_increasing_id()), "texts", parts, self.uid, compression="zstd")
        release(spark)
        slim = self.texts.select(F.col(self.uid).alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        shared = dealt(_heads(slim, parts), parts, groups).mapInArrow(_shared, _PACKED)
        asks = written(dealt(shared, parts, groups).mapInArrow(_asks, "uid long, asks binary"), "asks")
        del shared
        release(spark)
        docs_, rows = asks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("asks")), F.lit(0)) / 4).first()
        buckets = int(rows // np.clip(rows // 20_000, *BUCKET_ROWS)) + 1
        asked = slim.join(asks, "uid")
        splitters = _splitters(asked, buckets, docs_, int(rows))
        sent = dealt(_sent(asked, splitters), buckets, groups)
        judged = written(sent.mapInArrow(_judge(splitters, buckets), _PACKED), "judged")
        del sent, asked
        release(spark)
        crossed = dealt(judged.where(F.col("kind") == F.lit(b"o")), buckets).mapInArrow(_across, _PACKED)
        verdicts = judged.where(F.col("kind") != F.lit(b"o")).union(crossed)
        self.spans = written(dealt(verdicts, parts, groups).mapInArrow(_spans, "uid long, spans binary"), "spans")
        del crossed, verdicts
        release(spark)

    def joined(self, spans: str) -> DataFrame:
        return self.texts.join(self.spans.select(F.col("uid").alias(self.uid), F.col("spans").alias(spans)), self.uid, "left")



def _spans_of(spans: list[bytes | None], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop) of all spans of a slice, as places in it."""
    size = np.array([len(s or b"") // 16 for s in spans], dtype=np.int64)
    pairs = np.frombuffer(b"".join(s or b"" for s in spans), dtype=np.int64).reshape(-1, 2)
    owner = np.repeat(np.arange(len(spans)), size)
    return owner, pairs[:, 0] + offsets[owner], pairs[:, 1] + offsets[owner]


def _gone(start: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
    edges = np.zeros(size + 1, dtype=np.int8)
    np.add.at(edges, start, 1)
    np.add.at(edges, stop, -1)
    return np.cumsum(edges[:size], dtype=np.int8) > 0


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``.

    A byte is removed if a string of 50 bytes covers it that also starts in a
    document with a smaller id.  Strings are judged on the input, and matches
    don't cross documents.  Null texts are empty; texts of fewer than 50 bytes
    keep all; rows of one id don't remove each other's bytes; a row with a null
    id neither loses bytes nor takes any.  An empty table gives no rows.  Ids
    must be of an integral type: others raise a TypeError before any work.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    with small_batches(docs.sparkSession), dropped_after(docs.sparkSession):
        verdicts = _Verdicts(docs.select(id_col, text_col), id_col, text_col)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                data, offsets = column_bytes(string_of(part, "text"))
                owner, start, stop = _spans_of(string_of(part, "spans").to_pylist(), offsets)
                n = len(offsets) - 1
                removed = np.bincount(owner, stop - start, minlength=n).astype(np.int64)
                gone, sha = _gone(start, stop, len(data)), []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    sha.append(hashlib.sha256(np.ascontiguousarray(data[a:b][~gone[a:b]] if removed[i] else data[a:b])).hexdigest())
                cols = [pa.array(np.diff(offsets).astype(np.int64)), pa.array(removed), pa.array(np.bincount(owner, minlength=n).astype(np.int64)), pa.array(sha)]
                yield pa.RecordBatch.from_arrays([string_of(part, "id"), *cols], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        picked = verdicts.joined("spans").select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), "spans")
        out = picked.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        return written(out.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256"), "kept", keep=True, compression="zstd")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated passages cut out of their texts.

    A character goes if all its bytes are removed, so texts stay valid.  The
    other columns are kept (``size_col`` is counted anew if it is there); no row
    is dropped, and a text that nothing is left of is empty.  Ids must be of an
    integral type; rows with a null id stay as they are.
    """
    columns = docs.columns
    spans = next(n for n in ("spans", "spans_", "spans__") if n not in columns)
    with small_batches(docs.sparkSession), dropped_after(docs.sparkSession):
        verdicts = _Verdicts(docs, id_col, text_col)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Some 35 bytes of arrays for a byte of text.
            for part in slices(batches, text_col, SLICE_BYTES // 4):
                column = string_of(part, text_col)
                data, offsets = column_bytes(column)
                owner, start, stop = _spans_of(string_of(part, spans).to_pylist(), offsets)
                gone = _gone(start, stop, len(data))
                # A character that isn't wholly removed stays whole.
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                if len(lead) and len(owner):
                    gone = np.repeat(np.minimum.reduceat(gone, lead), np.diff(np.append(lead, len(data))))
                texts = column.to_pylist()
                sizes = string_of(part, size_col).to_pylist() if size_col in columns else None
                for i in np.unique(owner).tolist():
                    own = slice(offsets[i], offsets[i + 1])
                    texts[i] = data[own][~gone[own]].tobytes().decode("utf-8")
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                out = [pa.array(texts, type=column.type) if c == text_col else pa.array(sizes, type=string_of(part, c).type) if c == size_col else string_of(part, c) for c in columns]
                yield pa.RecordBatch.from_arrays(out, columns)

        return written(verdicts.joined(spans).select(*columns, spans).mapInArrow(run, T.StructType([docs.schema[c] for c in columns])), "kept", keep=True, compression="zstd")
