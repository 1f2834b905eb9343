"""Near duplicates by SimHash: vantage-point trees over fingerprints.

Two fingerprints of 64 bits that differ in three at most differ in one at most
in their upper or in their lower half.  So there is a tree over each half,
searched at radius one: distances of 32 random bits lie within a few of 16, and
at the radius of three that whole fingerprints would need, a boundary would be
near to more than half of all.  What a tree brings together is compared whole.

A tree's inner nodes hold a vantage point and a distance; what is no farther
goes inside.  The upper levels are fitted on a sample and their leaves are the
shards; every fingerprint has its home in one shard of each tree, and asks every
other one that the triangle inequality doesn't exclude.  Within a shard the tree
goes on over all that is there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import dropped_after, slices, string_of, written
from weftgraph.llm.components import connected_components

WIDTH, BITS, SEED = 3, 3, 42
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 15
#: Fingerprints that a shard is meant to hold, and the sample of each shard that
#: its place in the tree is fitted on; a sample has at most so many rows in all.
SHARD_ROWS, SHARD_SAMPLE, SAMPLE = 8192, 32, 1 << 17
#: Rows at home in one cell, and rows that ask there, at most: a shard with more is split.
HOME_ROWS, ASKING_ROWS = 1 << 15, 1 << 17
#: Rows of a shard that are compared without another vantage point.
LEAF_ROWS = 256
#: Fingerprints that are compared at once.
PAIRS = 1 << 20


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each window of words, joined by spaces; of the whole sequence if
    it has fewer.  A-Z are lower-cased, words are split at 0x20 and 0x09-0x0D."""
    words = text.lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    stops = np.cumsum(size) - 1
    starts = stops - size + 1
    spans = zip(starts.tolist(), stops[width - 1 :].tolist(), strict=False)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(words) - width + 1)


def majorities(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A fingerprint for each run ``hashes[bounds[i]:bounds[i + 1]]``: the bits set
    in over half of it; zero for an empty run."""
    counts = np.zeros((len(bounds) - 1, 64), dtype=np.int64)
    for lo in range(0, len(hashes), BLOCK):
        part = hashes[lo : lo + BLOCK].astype("<u8", copy=False)
        # Each of eight lanes adds eight one-byte counters; at most 255 rows fit.
        lanes = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        inside = bounds[(bounds >= lo) & (bounds < lo + len(part))] - lo
        starts = np.unique(np.concatenate([inside, np.arange(0, len(part), 255)]))
        sums = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(-1, 64)
        np.add.at(counts, np.searchsorted(bounds, lo + starts, side="right") - 1, sums)
    set_bits = 2 * counts > np.diff(bounds)[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): 64-bit fingerprints of whole texts as signed longs; a text
    that is null or has no words has zero."""
    kind = docs.schema[id_col].dataType
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            found = [shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in string_of(part, "text").cast(pa.large_binary())]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
            fp = majorities(np.concatenate(found), bounds)
            yield pa.RecordBatch.from_arrays([string_of(part, "doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return picked.mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def half(fp: np.ndarray, tree: int) -> np.ndarray:
    """The bits that tree 0 or 1 looks at."""
    return (fp >> np.uint64(32 * tree)).astype(np.uint32)


@dataclass
class Tree:
    """Upper levels of a vantage-point tree: node ``i`` has the children ``2 i``
    (inside) and ``2 i + 1``; the leaves of the last level are the shards."""

    depth: int
    points: np.ndarray
    radii: np.ndarray

    def routes(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, at home) of each value: one home, and the shards it asks.

        A pair within ``reach`` whose homes part at a node differs there by
        ``reach`` in distance at most; the one inside asks outside, so each
        pair meets once.  A value that asks goes on wherever such a partner may
        be.
        """
        row, node, home = np.arange(len(values)), np.ones(len(values), dtype=np.int64), np.ones(len(values), dtype=bool)
        for _ in range(self.depth):
            away = np.bitwise_count(values[row] ^ self.points[node]).astype(np.int64)
            radius = self.radii[node]
            inward = np.where(home, away <= radius, away <= radius + reach)
            outward = np.where(home, away > radius, away > radius - reach)
            asks = home & ~outward & (away > radius - reach)
            row, node, home = np.concatenate([row[inward], row[outward], row[asks]]), np.concatenate([2 * node[inward], 2 * node[outward] + 1, 2 * node[asks] + 1]), np.concatenate([home[inward], home[outward], np.zeros(asks.sum(), dtype=bool)])
        return row, node - (1 << self.depth), home


def vantage(values: np.ndarray) -> tuple[np.uint32, int]:
    """Of a few of the values the one whose distances spread most, and their median."""
    best = (-1.0, values[0], 0)
    for at in np.linspace(0, len(values) - 1, min(len(values), 6)).astype(int):
        away = np.bitwise_count(values ^ values[at])
        if (spread := float(away.std())) > best[0]:
            best = (spread, values[at], int(np.sort(away)[(len(away) - 1) // 2]))
    return best[1], best[2]


def fit(sample: np.ndarray, depth: int) -> Tree:
    """A tree of ``depth`` levels; where the sample has run out, all goes inside."""
    points, radii = np.zeros(1 << depth, dtype=np.uint32), np.full(1 << depth, 64, dtype=np.int64)
    parts = {1: sample}
    for node in range(1, 1 << depth):
        own = parts.pop(node, sample[:0])
        if len(own) > 1:
            points[node], radii[node] = vantage(own)
            inside = np.bitwise_count(own ^ points[node]) <= radii[node]
            parts[2 * node], parts[2 * node + 1] = own[inside], own[~inside]
    return Tree(depth, points, radii)


def near_pairs(fps: np.ndarray, home: np.ndarray, asking: np.ndarray, tree: int, bits: int = BITS, reach: int = BITS // 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of ``home``, of ``asking``) of fingerprints within ``bits``:
    vantage points split the home rows on, and those that ask go to each side
    that may hold a partner."""
    values = half(fps, tree)
    stack = [(home, asking)]
    while stack:
        here, there = stack.pop()
        if not len(here) or not len(there):
            continue
        if len(here) > LEAF_ROWS:
            point, radius = vantage(values[here[:: max(1, len(here) // 1024)]])
            away, asked = np.bitwise_count(values[here] ^ point), np.bitwise_count(values[there] ^ point).astype(np.int64)
            inside = away <= radius
            near, far = there[asked <= radius + reach], there[asked > radius - reach]
            n = int(inside.sum())
            if n * len(near) + (len(here) - n) * len(far) < 0.9 * len(here) * len(there):
                stack += [(here[inside], near), (here[~inside], far)]
                continue
        for i in range(0, len(here), 1024):
            rows = here[i : i + 1024]
            step = PAIRS // len(rows)
            for j in range(0, len(there), step):
                cols = there[j : j + step]
                x, y = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[cols][None, :]) <= bits)
                yield rows[x], cols[y]


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (a flat forest: each entry names its root, the least index) with
    the components of each ``a[i]`` and ``b[i]`` made one."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def cell_links(fps: np.ndarray, role: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell, at most one a fingerprint: each to the root of the
    component that it has here.  ``role``: 1 at home, 2 asking, 3 both."""
    every, at = np.unique(fps, return_inverse=True)
    roles = np.zeros(len(every), dtype=np.int8)
    np.bitwise_or.at(roles, at, role)
    parent = np.arange(len(every))
    for a, b in near_pairs(every, np.flatnonzero(roles & 1), np.flatnonzero(roles & 2), tree):
        parent = joined(parent, a, b)
    moved = np.flatnonzero(parent != np.arange(len(every)))
    return every[moved], every[parent[moved]]


def _mixed(fp: np.ndarray, factor: int) -> np.ndarray:
    return (fp * np.uint64(factor)) >> np.uint64(40)


def cells_of(fps: np.ndarray, trees: list[Tree], splits: dict[int, tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """(fp, shard, block, chunk, role) of each row that a cell gets.

    A shard whose ``splits`` are (b, c) has b blocks of home rows and c chunks
    of rows that ask; each block meets each chunk, so what is at home is sent to
    its block's c cells, and what asks (the home rows too) to its chunk's b ones.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for number, tree in enumerate(trees):
        row, leaf, home = tree.routes(half(fps, number), BITS // 2)
        shard, fp = leaf + (number << tree.depth), fps[row]
        large = np.isin(shard, np.fromiter(splits, dtype=np.int64, count=len(splits)))
        zero = np.zeros(len(shard), dtype=np.int64)
        out.append((fp[~large], shard[~large], zero[~large], zero[~large], np.where(home, 3, 2)[~large]))
        for s in np.unique(shard[large]):
            (b, c), own = splits[int(s)], shard == s
            f, h = fp[own], home[own]
            block, chunk = (_mixed(f, 0x9E3779B97F4A7C15) % np.uint64(b)).astype(np.int64), (_mixed(f, 0xC2B2AE3D27D4EB4F) % np.uint64(c)).astype(np.int64)
            n = int(h.sum())
            out.append((np.repeat(f[h], c), np.full(n * c, s), np.repeat(block[h], c), np.tile(np.arange(c), n), np.full(n * c, 1)))
            out.append((np.repeat(f, b), np.full(len(f) * b, s), np.tile(np.arange(b), len(f)), np.repeat(chunk, b), np.full(len(f) * b, 2)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def links(points: DataFrame) -> DataFrame:
    """(a, b): links between fingerprints (column ``fp``, distinct) that give the
    components of all pairs within three bits."""
    spark = points.sparkSession
    n = points.count()
    depth = max(0, min((n // SHARD_ROWS).bit_length(), (SAMPLE // 8).bit_length() - 1))
    sample = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, SHARD_SAMPLE << depth)).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    trees = [fit(half(sample, t), depth) for t in (0, 1)]

    def routed(splits: dict[int, tuple[int, int]]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                for at in range(0, part.num_rows, 4096):
                    fps = part.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                    fp, shard, block, chunk, role = cells_of(fps, trees, splits)
                    columns = [pa.array(fp.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (shard, block, chunk, role))]
                    yield pa.RecordBatch.from_arrays(columns, ["fp", "shard", "block", "chunk", "role"])

        return points.select("fp").mapInArrow(run, "fp long, shard int, block int, chunk int, role int")

    # One row a shard, of which there are 2 ** 15 at most.
    sizes = routed({}).groupBy("shard").agg(F.count_if(F.col("role") == 3).alias("home"), F.count("*").alias("rows")).collect()
    wanted = {r["shard"]: (-(-r["home"] // HOME_ROWS) or 1, -(-r["rows"] // ASKING_ROWS)) for r in sizes}
    splits = {s: x for s, x in wanted.items() if x != (1, 1)}
    cells = sum(b * c for b, c in wanted.values())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by cell; one cell is held at a time.
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = cell_links(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), now[0] >> depth)
                held.clear()
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for part in batches:
            if not part.num_rows:
                continue
            fp, *key, role = (c.to_numpy() for c in part.columns)
            key = np.column_stack(key)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(fp)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if now != (own := tuple(key[lo].tolist())):
                    yield from done()
                    now = own
                held.append((fp[lo:hi].view(np.uint64), role[lo:hi].astype(np.int8)))
        yield from done()

    parts = max(1, min(cells, max(int(spark.conf.get("spark.sql.shuffle.partitions")), cells // 4)))
    dealt = routed(splits).repartition(parts, "shard", "block", "chunk").sortWithinPartitions("shard", "block", "chunk")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): SimHash fingerprints (16 hexadecimal
    digits) and components of those that differ in three bits at most.

    ``component_id`` is the smallest id that is reachable, the own one included.
    Texts without words, null ones too, have the fingerprint zero and are linked
    like any other.  A null id keeps its row and names no component; one of null
    ids alone is null.  Repeated rows stay; an empty table gives no rows.

    Equal fingerprints are merged before the search, so copies cost nothing
    there.  A dense cluster of different fingerprints, which no vantage point can
    part, is one shard and is compared in cells, each of a bounded size.
    """
    spark = docs.sparkSession
    with dropped_after(spark):
        every = written(fingerprints(docs, id_col, text_col), "fingerprints")
        points = written(every.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
        linked = connected_components(links(points)).withColumnRenamed("node", "fp")
        firsts = linked.join(points, "fp").groupBy("component").agg(F.min("first").alias("least"))
        ids = points.join(linked.join(firsts, "component").select("fp", "least"), "fp", "left").select("fp", F.least("first", "least").alias("component_id"))
        shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
        return written(every.join(ids, "fp").select(F.col("doc_id").alias(id_col), shown.alias("fingerprint"), "component_id"), "near-duplicates", keep=True)
