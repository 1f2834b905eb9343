"""N-gram Jaccard join: size-aware, heavy and light sets apart.

After Deng, Tao and Li, "Overlap Set Similarity Joins with Theoretical
Guarantees" (2018), with a Jaccard threshold t in place of a fixed overlap:

* All sets order their shingles alike: rare ones first (by a sketch of document
  frequencies over the whole corpus, which only has to be the same for all),
  then by hash.  Two sets that reach t share a shingle among the first
  ``n - ceil(t n) + 1`` of each, and two of the first ``n - ceil(t n) + 2``.
* Small sets enumerate the subsets of two of that longer prefix as keys.
* Large sets scan inverted lists: the lists of single shingles of the shorter
  prefix, which hold the large sets, and those small ones that are close
  enough in size to be linked with a large one.
* The boundary between small and large is where the estimated cost of both
  parts, over all sets, is least.

Keys travel as packed arrays, one row a task and bucket.  A list is not
expanded into pairs: its members are referred to the smallest of them.  All
sets referred to one are compared there twice.  First their bitmaps, a bit for
each hash slot that a shingle falls into: slots of one set that the other hasn't
are shingles that it hasn't, which bounds the overlap from above and leaves few
sets whose texts have to travel.  Then the texts of these, by exact overlap
counts, until those not yet counted lie in one component.  No link between
different sets is lost and none is made that isn't exact.  Equal sets are one
class from the start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import release, slices, string_of, written
from weftgraph.llm.components import connected_components
from weftgraph.llm.shingles import mixed, words_of

#: Counters of the frequency sketch; its size doesn't depend on the corpus.  A
#: task's own counts stop at 255, which still is frequent; only the order of
#: shingles depends on them, not what is found.
SKETCH_BITS = 22
_SKETCH_ROWS = 256
#: Keys in one bucket, on average, and bytes of sets that one comparison holds.
BUCKET_KEYS = 500_000
GROUP_BYTES = 48 << 20
#: Largest boundary that is considered.
MOST_SMALL = 256
_PROBES = 8


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    flat, ends = words_of(column).windows(width)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        x = np.sort(flat[a:b])
        if b - a > 1:
            keep = np.empty(b - a, dtype=bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        out.append(x)
    return out


def _signature(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _bitmap(shingles: np.ndarray) -> bytes:
    """Four slots a shingle or more, a power of two; the slot is the upper bits."""
    width = max(6, int(4 * len(shingles) - 1).bit_length())
    out = np.zeros(1 << width, dtype=bool)
    out[(shingles >> np.uint64(64 - width)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


class Threshold:
    """Jaccard of ``num / den`` or more, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, n):
        """Least overlap of a set of ``n`` with any set that it is linked with."""
        return -(-self.num * n // self.den)

    def overlap_larger(self, n):
        """The same with a set that isn't smaller."""
        return -(-2 * self.num * n // (self.den + self.num))

    def linked(self, both, n, m):
        return self.den * both >= self.num * (n + m - both)


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """A row a document (size, signature, a few shingles), and this task's part
    of the frequency sketch as rows with a ``block``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "a", "b", "bits", "block", "payload"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        id_type = pa.int64()
        for part in slices(batches, "text", 4 << 20):
            id_type = string_of(part, "doc_id").type
            sets = _sets(string_of(part, "text"), width)
            n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            if n.sum():
                sketch += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
            sign = np.frombuffer(b"".join(map(_signature, sets)), dtype=np.int64).reshape(-1, 2)
            probes = pa.array([x[:_PROBES].tobytes() for x in sets], type=pa.binary())
            yield pa.RecordBatch.from_arrays([string_of(part, "doc_id"), pa.array(n), pa.array(sign[:, 0].copy()), pa.array(sign[:, 1].copy()), pa.array([_bitmap(x) if len(x) > 1 else None for x in sets], type=pa.binary()), pa.nulls(len(n), pa.int32()), probes], names)
        if sketch.any():
            rows = np.minimum(sketch, 255).astype(np.uint8).reshape(_SKETCH_ROWS, -1)
            used = np.flatnonzero(rows.any(axis=1))
            none = [pa.nulls(len(used), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(used.astype(np.int32)), pa.array([rows[i].tobytes() for i in used], type=pa.binary())], names)

    return docs.mapInArrow(run, f"doc_id {kind}, n long, a long, b long, bits binary, block int, payload binary")


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for part in batches:
        for block, payload in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if block not in total:
                total[block] = np.zeros(len(payload), dtype=np.uint32)
            total[block] += np.frombuffer(payload, dtype=np.uint8)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int32()), pa.array([x.tobytes() for x in total.values()], type=pa.binary())], ["block", "payload"])


def _sketch(profiles: DataFrame) -> np.ndarray:
    """Counts over all tasks, summed by block."""
    rows = profiles.where("block is not null").select("block", "payload")
    out = np.zeros((_SKETCH_ROWS, (1 << SKETCH_BITS) // _SKETCH_ROWS), dtype=np.uint32)
    for block, payload in rows.repartition("block").mapInArrow(_summed, "block int, payload binary").toLocalIterator():
        out[block] = np.frombuffer(payload, dtype=np.uint32)  # 16 MB in all, whatever the corpus
    return out.ravel()


def _frequency_classes(sketch: np.ndarray) -> np.ndarray:
    """0 for what is as rare as chance lets a counter be, then by powers of two."""
    mean = sketch.mean()
    beyond = np.maximum(sketch - mean, 0) / (4 * np.sqrt(mean) + 1)
    return np.floor(np.log2(1 + beyond)).astype(np.uint8)


def _boundary(profiles: DataFrame, sketch: np.ndarray, t: Threshold) -> int:
    """Largest size for which enumerating subsets of two costs less in all."""
    held = profiles.sparkSession.sparkContext.broadcast(sketch)
    noise = float(sketch.mean())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, reads = np.zeros(MOST_SMALL + 1), np.zeros(MOST_SMALL + 1)
        for part in batches:
            n = np.minimum(string_of(part, "n").to_numpy(), MOST_SMALL)
            for size, probes in zip(n.tolist(), string_of(part, "payload").to_pylist(), strict=True):
                if size:
                    at = np.frombuffer(probes, dtype=np.uint64) >> np.uint64(64 - SKETCH_BITS)
                    count[size] += 1
                    # The prefix holds the rarest quarter.
                    rare = np.sort(held.value[at.astype(np.int64)])[: max(1, len(at) // 4)]
                    reads[size] += np.maximum(rare - noise, 1.0).mean()
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(reads[used])], ["n", "c", "r"])

    per_size = profiles.where("block is null").select("n", "payload").mapInArrow(run, "n int, c double, r double").groupBy("n").agg(F.sum("c"), F.sum("r"))
    count, reads = np.zeros(MOST_SMALL + 1), np.zeros(MOST_SMALL + 1)
    for n, c, r in per_size.collect():  # at most MOST_SMALL rows
        count[n], reads[n] = c, r
    n = np.arange(MOST_SMALL + 1)
    short = n - t.overlap(n) + 1
    enumerate_, scan, bridge = count * (short + 1) * short / 2, (count + reads) * short, count * short
    best, cost = 2, np.inf
    for x in range(2, MOST_SMALL):
        near = n[(n <= x) & (n >= t.overlap(x + 1))]
        now = enumerate_[: x + 1].sum() + scan[x + 1 :].sum() + bridge[near].sum()
        if now < cost:
            best, cost = x, now
    return best


def _keys_of(x: np.ndarray, classes: np.ndarray, t: Threshold, small: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, flags) of one set.  Flags: 1 for a single shingle of the prefix in
    which a smaller partner's stands, 2 for a subset, 4 for a large set."""
    n = len(x)
    if n < 2:  # linked with equal sets only
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint8)
    order = (classes[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (x >> np.uint64(6))
    length = n - t.overlap(n) + 1
    first = np.sort(order)[: length + 1]
    single = mixed(first[:length])
    flags = np.zeros(length, dtype=np.uint8)
    flags[: n - t.overlap_larger(n) + 1] = 1
    if n > small:
        return single, flags | 4
    i, j = np.triu_indices(len(first), 1)
    pairs = mixed(first[i] * np.uint64(0x9E3779B97F4A7C15) + first[j])
    if n < t.overlap(small + 1):
        return pairs, np.full(len(pairs), 2, dtype=np.uint8)
    return np.concatenate([single, pairs]), np.concatenate([flags, np.full(len(pairs), 2, dtype=np.uint8)])


def _lists(docs: DataFrame, width: int, t: Threshold, classes: np.ndarray, small: int, buckets: int) -> DataFrame:
    """Packed keys by bucket: a row has keys and members of one task's sets."""
    held = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        ids: list[int] = []
        sizes: list[int] = []
        signs: list[bytes] = []
        keys: list[np.ndarray] = []
        flags: list[np.ndarray] = []
        held_keys = 0

        def out() -> pa.RecordBatch:
            key, flag = np.concatenate(keys), np.concatenate(flags)
            member = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            id_, n, sign = np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64), np.frombuffer(b"".join(signs), dtype=np.int64)[::2]
            rows = []
            for b in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[b] : cuts[b + 1]]
                who, local = np.unique(member[own], return_inverse=True)
                table = np.stack([id_[who], n[who], sign[who]])
                low = (key[own] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                rows.append((int(b), low.tobytes(), local.astype(np.uint32).tobytes(), flag[own].tobytes(), table.tobytes()))
            for x in (seen, ids, sizes, signs, keys, flags):
                x.clear()
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type=pa.int32()), *(pa.array(c, type=pa.binary()) for c in cols[1:])], ["bucket", "keys", "members", "flags", "sets"])

        for part in slices(batches, "text", 4 << 20):
            for doc, x in zip(string_of(part, "doc_id").to_pylist(), _sets(string_of(part, "text"), width), strict=True):
                if len(x) < 2:
                    continue
                sign = _signature(x)
                if (at := seen.setdefault(sign, len(ids))) < len(ids):
                    ids[at] = min(ids[at], doc)
                    continue
                key, flag = _keys_of(x, held.value, t, small)
                ids.append(doc)
                sizes.append(len(x))
                signs.append(sign)
                keys.append(key)
                flags.append(flag)
                held_keys += len(key)
            if held_keys > 4_000_000:
                yield out()
                held_keys = 0
        if ids:
            yield out()

    return docs.mapInArrow(run, "bucket int, keys binary, members binary, flags binary, sets binary")


def _referrals(bucket: list[tuple[bytes, bytes, bytes, bytes]], t: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hub, member, member's size) of the lists of one bucket."""
    key, member, flag, tables, base = [], [], [], [], 0
    for k, m, f, s in bucket:
        low = np.zeros((len(k) // 5, 8), dtype=np.uint8)
        low[:, :5] = np.frombuffer(k, dtype=np.uint8).reshape(-1, 5)
        key.append(low.view("<u8").ravel())
        table = np.frombuffer(s, dtype=np.int64).reshape(3, -1)
        member.append(np.frombuffer(m, dtype=np.uint32).astype(np.int64) + base)
        flag.append(np.frombuffer(f, dtype=np.uint8))
        tables.append(table)
        base += table.shape[1]
    key, member, flag, table = np.concatenate(key), np.concatenate(member), np.concatenate(flag), np.concatenate(tables, axis=1)
    # Copies of a set in several tasks are one: the least id of them stands for all.
    order = np.lexsort((table[0], table[2]))
    new = np.append(True, (np.diff(table[2][order]) != 0) | (np.diff(table[1][order]) != 0))
    ids, sizes = table[0][order][new], table[1][order][new]
    who = np.empty(base, dtype=np.int64)
    who[order] = np.cumsum(new) - 1
    member = who[member]
    # Keys that only one set has are gone at once; most are.
    kind = (flag & 2).astype(np.uint64) << np.uint64(62)
    code = key | kind
    order = np.lexsort((member, code))
    code, member, flag = code[order], member[order], flag[order]
    new = np.append(True, (code[1:] != code[:-1]) | (member[1:] != member[:-1]))
    code, member, flag = code[new], member[new], flag[new]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    stop = np.append(first[1:], len(code))
    many = stop - first > 1
    first, stop = first[many], stop[many]
    empty = np.empty(0, dtype=np.int64)
    if not len(first):
        return empty, empty, empty
    # With starts and ends in turn, every other result is that of a list.
    turns = np.column_stack([first, stop]).ravel()
    either = np.bitwise_or.reduceat(np.append(flag, np.uint8(0)), turns)[::2]
    use = ((either & 2) > 0) | ((either & 5) == 5)
    hubs, members = [], []
    for a, b in zip(first[use].tolist(), stop[use].tolist(), strict=True):
        who = member[a:b]
        n = sizes[who]
        if t.overlap(int(n.max())) <= n.min():
            groups = [who]
        else:
            # Partners are at most one factor 1/t apart: neighbouring classes of
            # that factor meet, class by class.
            level = np.floor(np.log(n) / np.log(t.den / t.num) + 1e-9).astype(np.int64)
            groups = [who[(level == c) | (level == c + 1)] for c in np.unique(level).tolist()]
        for g in groups:
            if len(g) > 1:
                hub = g[np.argmin(ids[g])]
                hubs.append(np.full(len(g), hub))
                members.append(g)
    if not hubs:
        return empty, empty, empty
    pairs = np.unique(np.concatenate(hubs) * np.int64(len(ids)) + np.concatenate(members))
    hub, member = pairs // len(ids), pairs % len(ids)
    return ids[hub], ids[member], sizes[member]


def _refer(lists: DataFrame, t: Threshold, buckets: int) -> DataFrame:
    """(hub, doc_id, n), distinct.

    A pair is found in as many buckets as it shares shingles in; the buckets'
    findings travel packed, dealt by pair, and meet once.
    """
    names = ["part", "hubs", "docs", "sizes"]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            hub, doc, n = _referrals(held, t)
            if not len(hub):
                return
            part = (mixed(mixed(hub.view(np.uint64)) ^ doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cuts))
            cols = [[x[order[cuts[p] : cuts[p + 1]]].tobytes() for p in used] for x in (hub, doc, n)]
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(c, type=pa.binary()) for c in cols)], names)

        for part in batches:
            for bucket, *row in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                if bucket != now and held:
                    yield from out()
                    held = []
                now = bucket
                held.append(tuple(row))
        if held:
            yield from out()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            hub, doc, n = (np.concatenate([np.frombuffer(r[k], dtype=np.int64) for r in held]) for k in range(3))
            order = np.lexsort((doc, hub))
            hub, doc, n = hub[order], doc[order], n[order]
            new = np.append(True, (hub[1:] != hub[:-1]) | (doc[1:] != doc[:-1]))
            return pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (hub, doc, n)], ["hub", "doc_id", "n"])

        for part in batches:
            for number, *row in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if number != now and held:
                    yield out()
                    held = []
                now = number
                held.append(tuple(row))
        if held:
            yield out()

    dealt = lists.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(find, "part int, hubs binary, docs binary, sizes binary")
    return found.repartition(buckets, "part").sortWithinPartitions("part").mapInArrow(merge, "hub long, doc_id long, n long")


class _Forest:
    """Components of a group that is too small to distribute."""

    def __init__(self, k: int):
        self.parent = np.arange(k)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = self.root(i), self.root(j)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def roots(self, items: np.ndarray) -> np.ndarray:
        return np.array([self.root(i) for i in items.tolist()], dtype=np.int64)

    def complete(self, first: int, partners) -> np.ndarray:
        """Joins all partners, and returns each item's root.

        ``partners(i)`` gives all partners of ``i``, which costs a pass over the
        group.  It is asked until those that it hasn't been asked for lie in one
        component: any partners that are still apart would have been found from
        the one that was asked.
        """
        k = len(self.parent)
        asked = np.zeros(k, dtype=bool)
        self.join(first, partners(first))
        asked[first] = True
        while len(left := np.flatnonzero(~asked)):
            kinds, where, many = np.unique(self.roots(left), return_inverse=True, return_counts=True)
            if len(kinds) == 1:
                break
            apart = left[where != np.argmax(many)]
            for i in apart[: max(1, len(apart) // 8)].tolist():
                self.join(i, partners(i))
                asked[i] = True
        return self.roots(np.arange(k))


def _possible(ids: np.ndarray, sizes: np.ndarray, bits: list[bytes], t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(least id of its component, id) of those with a possible partner."""
    k = len(ids)
    levels: dict[int, np.ndarray] = {}  # bitmaps folded to each length
    lengths = np.array([len(b) for b in bits])
    most = int(lengths.max())
    wide = np.zeros((k, most), dtype=np.uint8)
    for i, b in enumerate(bits):
        wide[i, : len(b)] = np.frombuffer(b, dtype=np.uint8)
    # Longest first: a fold joins neighbouring slots.
    now, length = wide, most
    while length >= 8:
        levels[length] = now.view(np.uint64)
        if length == lengths.min():
            break
        flags = np.unpackbits(now, axis=1).reshape(k, -1, 2).any(axis=2)
        shorter = np.packbits(flags, axis=1)
        small = lengths <= length // 2
        shorter[small] = now[small, : length // 2]
        now, length = np.ascontiguousarray(shorter), length // 2

    def partners(i: int) -> np.ndarray:
        near = np.flatnonzero((t.overlap(np.maximum(sizes, sizes[i])) <= np.minimum(sizes, sizes[i])))
        out = []
        for length in np.unique(np.minimum(lengths[near], lengths[i])).tolist():
            at = near[np.minimum(lengths[near], lengths[i]) == length]
            table = levels[length]
            mine = table[i]
            both = np.minimum(sizes[i] - np.bitwise_count(mine & ~table[at]).sum(axis=1, dtype=np.int64), sizes[at] - np.bitwise_count(table[at] & ~mine).sum(axis=1, dtype=np.int64))
            out.append(at[t.linked(both, sizes[i], sizes[at])])
        return np.concatenate(out)

    roots = _Forest(k).complete(int(np.argmin(ids)), partners)
    many = np.bincount(roots, minlength=k)[roots] > 1
    least = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(least, roots, ids)
    return least[roots][many], ids[many]


def _links_in(ids: np.ndarray, sets: list[np.ndarray], t: Threshold) -> Iterator[tuple[int, int]]:
    """Links that join all linked sets of a group: (id, least id joined).

    A set is counted by the postings of its shingles: that gives its overlap
    with every other one.
    """
    k = len(ids)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=k)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(k), sizes)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    starts = np.append(np.flatnonzero(new), len(flat))
    term = np.empty(len(flat), dtype=np.int64)
    term[order] = np.cumsum(new) - 1
    posting = owner[order]
    lengths = np.diff(starts)
    at = np.concatenate([[0], np.cumsum(sizes)])

    def partners(i: int) -> np.ndarray:
        terms = term[at[i] : at[i + 1]]
        terms = terms[lengths[terms] > 1]
        n = lengths[terms]
        ends = np.cumsum(n)
        if not len(ends):
            return np.empty(0, dtype=np.int64)
        both = np.bincount(posting[np.arange(ends[-1]) + np.repeat(starts[terms] - (ends - n), n)], minlength=k)
        return np.flatnonzero(t.linked(both, sizes[i], sizes))

    roots = _Forest(k).complete(int(np.argmin(ids)), partners)
    least = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(least, roots, ids)
    for i in range(k):
        if least[roots[i]] != ids[i]:
            yield int(ids[i]), int(least[roots[i]])


def _cells(referred: DataFrame, bytes_each: float) -> DataFrame:
    """(hub, cell, doc_id): a group with more sets than one task should hold is
    cut into blocks; each pair of blocks meets in a cell of its own."""
    sums = referred.groupBy("hub").agg((F.floor(F.sum("n") * bytes_each / GROUP_BYTES) + 1).cast("int").alias("blocks"))
    cells = referred.join(sums, "hub").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("own")) * F.col("blocks") + F.greatest(o, F.col("own")))
    return cells.select("hub", F.explode(cell).alias("cell"), "doc_id")


def _grouped(batches: Iterable[pa.RecordBatch], extra: int) -> Iterator[list[tuple]]:
    """Rows with equal hub and cell, as they come sorted."""
    now, held = None, []
    for part in batches:
        for hub, cell, *row in zip(*(part.column(i).to_pylist() for i in range(2 + extra)), strict=True):
            if (hub, cell) != now and held:
                yield held
                held = []
            now = (hub, cell)
            held.append(tuple(row))
    if held:
        yield held


def _thinned(rows: DataFrame, referred: DataFrame, t: Threshold) -> DataFrame:
    """(hub, doc_id, n) of those sets that bitmaps leave a possible partner."""
    bits = rows.where("bits is not null").select("doc_id", "n", "bits").join(_cells(referred, 1.0).hint("merge"), "doc_id")
    dealt = bits.repartition("hub", "cell").sortWithinPartitions("hub", "cell", "doc_id").select("hub", "cell", "doc_id", "n", "bits")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _grouped(batches, 3):
            if len(held) > 1:
                ids, n, bitmaps = zip(*held, strict=True)
                hub, doc = _possible(np.array(ids), np.array(n), list(bitmaps), t)
                sizes = dict(zip(ids, n, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(hub), pa.array(doc), pa.array([sizes[i] for i in doc.tolist()], type=pa.int64())], ["hub", "doc_id", "n"])

    return dealt.mapInArrow(run, "hub long, doc_id long, n long").distinct()


def _verify(docs: DataFrame, referred: DataFrame, width: int, t: Threshold) -> DataFrame:
    """(a, b): exact links, from the texts of those that were referred."""
    # What was referred grows with the corpus: it isn't broadcast at any size.
    texts = docs.select("doc_id", "text").join(_cells(referred, 8.0).hint("merge"), "doc_id")
    dealt = texts.repartition("hub", "cell").sortWithinPartitions("hub", "cell", "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def out() -> pa.RecordBatch:
            links = list(_links_in(np.array(ids), sets, t))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], type=pa.int64()) for k in (0, 1)], ["a", "b"])

        for part in slices(batches, "text", 4 << 20):
            keys = zip(string_of(part, "hub").to_pylist(), string_of(part, "cell").to_pylist(), strict=True)
            for key, doc, x in zip(keys, string_of(part, "doc_id").to_pylist(), _sets(string_of(part, "text"), width), strict=True):
                if key != now:
                    if len(ids) > 1:
                        yield out()
                    now, ids, sets = key, [], []
                ids.append(doc)
                sets.append(x)
        if len(ids) > 1:
            yield out()

    return dealt.select("hub", "cell", "doc_id", "text").mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``.

    ``n_shingles`` is the number of distinct shingles; ``component_id`` the
    smallest id among all documents that links lead to.  Documents with equal
    sets are linked; one without words has size 0 and only itself.  Null texts
    count as empty; a row with a null id is never linked and has a null
    component.  Rows of one id are one document to links.  An empty table gives
    no rows.  Ids are whole numbers.
    """
    t = Threshold(num, den)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profiles = written(_profiles(picked, width), "profiles", compression="zstd")
    rows = profiles.where("block is null").select("doc_id", "n", "a", "b", "bits")
    known = picked.where("doc_id is not null and text is not null")
    sketch = _sketch(profiles)
    small = _boundary(profiles, sketch, t)
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = int(max(8, total * (1 - num / den) // BUCKET_KEYS + 1))
    referred = written(_refer(_lists(known, width, t, _frequency_classes(sketch), small, buckets), t, buckets), "referred")
    release(docs.sparkSession)
    possible = written(_thinned(rows, referred, t), "possible")
    release(docs.sparkSession)
    groups = connected_components(_verify(known, possible, width, t))
    classes = rows.where("n > 0 and doc_id is not null").groupBy("a", "b").agg(F.min("doc_id").alias("least"))
    named = classes.join(groups, classes["least"] == groups["node"], "left").select("a", "b", F.coalesce("component", "least").alias("component_id"))
    full = rows.where("n > 0 and doc_id is not null").join(named, ["a", "b"]).select("doc_id", "n", "component_id")
    bare = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.union(bare).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, unchanged."""
    found = jaccard_components(docs, width, num, den)
    others = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)
