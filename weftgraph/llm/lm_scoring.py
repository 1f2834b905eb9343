"""Language-model scoring by cross-entropy difference.

After Moore and Lewis, "Intelligent Selection of Language Model Training Data"
(2010): two bigram models, of target documents and of the whole corpus, of one
order, one smoothing and one vocabulary, which is open: every word of the corpus
has counts of its own.  A document's score is its mean loss an event under the
target model less that under the background model; the lower, the more it is
like the target.

Counts live in a distributed table and are never gathered in one place.  A task
numbers the distinct n-grams of a *chunk* of texts and asks for their counts by
bucket of their hash, each once; buckets add up and answer; the chunk scores its
documents with the answers.  No bucket sees an n-gram more than once a chunk, so
frequent ones are no hot keys, and the texts themselves are not shuffled.

The models are matched: background counts are scaled to the target's size, so
both are smoothed alike.  A document is scored without its own counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import dropped_after, release, slices, string_of, written
from weftgraph.llm.shingles import Words, mixed, words_of

#: Text bytes of the n-grams that one bucket counts; larger corpora take larger ones.
BUCKET_BYTES = (4 << 20, 64 << 20)
#: Text bytes of a chunk; a worker holds about forty times as many.
CHUNK_BYTES = 3 << 20
#: Hash classes of target ids that texts are thinned by before the exact join:
#: a broadcast table of at most so many numbers.
CLASSES = 1 << 20

#: Bits of a key.  One of them tells words from pairs of words, so 55 bits of hash
#: tell words apart, and pairs: of 2 ** 44 distinct ones, as 100 TB may have, about
#: one in two thousand meets another and shares its count.
KEY_BITS = 56

_EDGE = np.uint64(0x5851F42D4C957F2C)  # in front of and behind each document
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

_SCHEMA = "kind string, at long, bucket long, n long, keys binary, target binary, counts binary, ids binary, sizes binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"kind": pa.string()} | dict.fromkeys(("at", "bucket", "n"), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], type=kinds.get(c, pa.binary())) for c in _NAMES], _NAMES)


def _zipped(values: np.ndarray, kind: str) -> bytes:
    """Bytes by place in the number, which compress well for sorted ones."""
    planes = values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unzipped(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8) if n else np.empty(0, dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return _zipped(np.diff(keys, prepend=np.uint64(0)), "<u8")


def _keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unzipped(data, n, "<u8"), dtype=np.uint64)


class Events:
    """The events of some documents: each word after the one before, the first
    one and the end after the edge.  Documents without words have none."""

    def __init__(self, stream: np.ndarray, words: np.ndarray, sizes: np.ndarray):
        #: Number of each event's word, the words' keys in order, events by document.
        self.stream, self.words, self.sizes = stream, words, sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        before = np.empty_like(stream)
        before[1:] = stream[:-1]  # a document's last event is the edge, so the next one's first follows it
        if len(stream):
            before[0] = stream[sizes[sizes > 0][0] - 1]
        self.before = before
        pair = self.cut(mixed(words[before] * _FACTOR + words[stream])) | np.uint64(1)
        self.pairs, self.pair = np.unique(pair, return_inverse=True)

    @staticmethod
    def cut(hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - KEY_BITS) & ~np.uint64(1)

    @classmethod
    def of(cls, found: Words) -> Events:
        n = np.diff(found.bounds)
        full = np.flatnonzero(n > 0)
        stream = cls.cut(np.insert(found.hashes, found.bounds[full + 1], _EDGE))
        words, numbers = np.unique(stream, return_inverse=True)
        return cls(numbers, words, n + (n > 0))

    def keys(self) -> np.ndarray:
        """Keys of all words (even) and pairs (odd), in order."""
        return np.sort(np.concatenate([self.words, self.pairs]))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys), dtype=np.uint32)
        out[np.searchsorted(keys, self.words)] = np.bincount(self.stream, minlength=len(self.words))
        out[np.searchsorted(keys, self.pairs)] = np.bincount(self.pair, minlength=len(self.pairs))
        return out

    def within(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each event's word, the one before and the pair occur in its
        document.  A document's words and those before them are the same."""

        def often(numbers: np.ndarray) -> np.ndarray:
            out = np.ones(len(numbers), dtype=np.int64)
            again = np.flatnonzero(np.bincount(numbers)[numbers] > 1) if len(numbers) else numbers
            code = self.doc[again] * np.int64(len(self.words) + len(self.pairs)) + numbers[again]
            _, at, many = np.unique(code, return_inverse=True, return_counts=True)
            out[again] = many[at]
            return out

        word = often(self.stream)
        before = np.append(1, word)[: len(word)]
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = 1  # the edge
        return word, before, often(self.pair)


def losses(events: Events, keys: np.ndarray, counts: np.ndarray, total: int, scale: float, types: int, own: tuple[np.ndarray, ...] | None, prior: float, added: float) -> np.ndarray:
    """Bits of each event: -log2 of (c(h, w) + prior q(w)) / (c(h) + prior), with
    q(w) = (c(w) + added) / (N + added types).  Counts are multiplied by
    ``scale``; before, those in ``own`` (of the event's document) are taken off."""
    of = counts.astype(np.float64)
    word, pair = of[np.searchsorted(keys, events.words)], of[np.searchsorted(keys, events.pairs)]
    w, h, p, n = word[events.stream], word[events.before], pair[events.pair], np.float64(total)
    if own is not None:
        # Below 0 only for documents that the counts don't hold, whose figure nobody takes.
        w, h, p, n = (np.maximum(x - y, 0) for x, y in zip((w, h, p, n), (*own, events.sizes[events.doc]), strict=True))
    q = (scale * w + added) / (scale * n + added * types)
    return -np.log2((scale * p + prior * q) / (scale * h + prior))


def _ids(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _asks(events: Events, buckets: int, chunk: int | None) -> list[dict]:
    """What a chunk counts and asks for, by bucket.  Without a chunk's number
    the counts are the target's, and nothing is asked for."""
    keys = events.keys()
    counts = events.counts(keys)
    bucket = (keys >> np.uint64(KEY_BITS - 32)).astype(np.int64) * buckets >> 32
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[b], cuts[b + 1])
        out.append({"kind": "t" if chunk is None else "a", "at": chunk, "bucket": b, "n": cuts[b + 1] - cuts[b], "keys": _steps(keys[own]), "counts": _zipped(counts[own], "<u4")})
    return out


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers of words, by chunk (kind ``o``)."""
    number = TaskContext.get().partitionId() << 32
    for part in slices(batches, "text", CHUNK_BYTES):
        events = Events.of(words_of(string_of(part, "text")))
        own = {"kind": "o", "at": number, "n": len(events.words), "keys": _steps(events.words), "counts": _zipped(events.stream, "<u4"), "ids": _ids(string_of(part, "doc_id")), "sizes": _zipped(events.sizes, "<u4")}
        yield _batch([own | {"bucket": len(events.stream)}])
        number += 1


def _events(own: dict) -> Events:
    sizes = _unzipped(own["sizes"], _count(own["ids"]), "<u4").astype(np.int64)
    return Events(_unzipped(own["counts"], own["bucket"], "<u4").astype(np.int64), _keys(own["keys"], own["n"]), sizes)


def _asked(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for own in part.to_pylist():
                yield _batch(_asks(_events(own), buckets, own["at"]))

    return run


def _targets(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CHUNK_BYTES):
            yield _batch(_asks(Events.of(words_of(string_of(part, "text"))), buckets, None))

    return run


def _answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up each bucket.  Rows: answers by chunk (kind ``r``), and a bucket's
    number of words and of events of both models (kind ``v``)."""

    def answered(bucket: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
        size = np.array([r["n"] for r in held])
        keys = np.concatenate([_keys(r["keys"], r["n"]) for r in held])
        counts = np.concatenate([_unzipped(r["counts"], r["n"], "<u4") for r in held])
        is_target = np.repeat([r["kind"] == "t" for r in held], size)
        distinct, at = np.unique(keys, return_inverse=True)
        sums = np.stack([np.bincount(at, np.where(is_target, counts, 0), len(distinct)), np.bincount(at, np.where(is_target, 0, counts), len(distinct))]).astype(np.int64)
        words = distinct % 2 == 0
        totals = np.array([words.sum(), *sums[:, words].sum(axis=1)], dtype=np.int64)
        yield _batch([{"kind": "v", "bucket": bucket, "n": 3, "counts": totals.tobytes()}])
        start = np.append(0, np.cumsum(size))
        for i, r in enumerate(held):
            if r["kind"] == "a":
                own = sums[:, at[start[i] : start[i + 1]]]
                yield _batch([{"kind": "r", "at": r["at"], "bucket": bucket, "n": r["n"], "target": _zipped(own[0], "<u8"), "counts": _zipped(own[1], "<u8")}])

    now, held = None, []
    for part in batches:
        for row in part.to_pylist():
            if row["bucket"] != now and held:
                yield from answered(now, held)
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        yield from answered(now, held)


def _scored(types: int, target: int, background: int, prior: float, added: float):
    scale = min(1.0, target / background) if background else 1.0
    names = ["doc_id", "n_tokens", "target_loss", "own_target_loss", "background_loss"]

    def scored(own: dict, answers: list[dict]) -> pa.RecordBatch:
        events = _events(own)
        keys, mine, sizes = events.keys(), events.within(), events.sizes
        found = [np.concatenate([_unzipped(r[c], r["n"], "<u8") for r in answers] or [np.empty(0)]) for c in ("target", "counts")]
        many = np.maximum(sizes, 1)
        mean = lambda x: pa.array(np.bincount(events.doc, x, len(sizes)) / many)
        wanted = ((found[0], target, 1.0, None), (found[0], target, 1.0, mine), (found[1], background, scale, mine))
        means = [mean(losses(events, keys, counts, total, by, types, less, prior, added)) for counts, total, by, less in wanted]
        with pa.ipc.open_stream(own["ids"]) as ids:
            column = ids.read_all().column(0).combine_chunks()
        return pa.RecordBatch.from_arrays([column, pa.array(np.maximum(sizes - 1, 0)), *means], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, answers = None, []
        for part in batches:
            for row in part.to_pylist():
                if row["kind"] == "o":
                    if own is not None:
                        yield scored(own, answers)
                    own, answers = row, []
                else:
                    answers.append(row)
        if own is not None:
            yield scored(own, answers)

    return run


def _count(ids: bytes) -> int:
    with pa.ipc.open_stream(ids) as found:
        return found.read_all().num_rows


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", prior: float = 50.0, added: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of each row.

    The target are documents with label 1, the background is all.  Losses are
    bits an event (the words and the end); ``score`` is the target's less the
    background's.  Each row is scored by counts that are not its own, so copies
    count for one another.  Words, and pairs of words, are told apart by
    hashes of ``KEY_BITS`` bits.

    Null and empty texts have 0 tokens and 0 for all figures.  Null labels count
    as none; labels that repeat count once; repeated rows are counted and scored
    each; a row with a null id belongs to no target.  Without any label 1 both
    models are uniform and scores 0.  An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = labels.where(F.col(label_col) == 1).select(F.col("doc_id").cast(kind).alias("doc_id")).where("doc_id is not null").distinct()
    group = F.pmod(F.xxhash64("doc_id"), F.lit(CLASSES)).cast("int").alias("group")
    with dropped_after(docs.sparkSession):
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        buckets = size // int(np.clip(size // 20_000, *BUCKET_BYTES)) + 1
        chunks = written(texts.mapInArrow(_chunks, _SCHEMA), "chunks")
        # Thinned by a table of bounded size first, so that few texts are shuffled.
        thin = texts.withColumn("group", group).join(F.broadcast(wanted.select(group).distinct()), "group", "left_semi")
        target_texts = thin.join(wanted, "doc_id", "left_semi").select("text")
        asked = chunks.mapInArrow(_asked(buckets), _SCHEMA).union(target_texts.mapInArrow(_targets(buckets), _SCHEMA))
        answers = written(asked.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(_answers, _SCHEMA), "answers")
        totals = np.zeros(3, dtype=np.int64)
        for row in answers.where("kind = 'v'").select("counts").toLocalIterator():  # 24 bytes a bucket
            totals += np.frombuffer(row["counts"], dtype=np.int64)
        types, target, background = (int(x) for x in totals)
        del asked, target_texts, thin
        release(docs.sparkSession)
        parts = max(8, int(size // (8 << 20)) + 1)
        dealt = chunks.union(answers.where("kind = 'r'")).repartition(parts, "at").sortWithinPartitions("at", "kind", "bucket")
        out = dealt.mapInArrow(_scored(max(types, 1), target, background, prior, added), f"doc_id {kind}, n_tokens long, target_loss double, own_target_loss double, background_loss double")
        marked = out.join(wanted.withColumn("is_target", F.lit(True)), "doc_id", "left")
        loss = F.when(F.col("is_target"), F.col("own_target_loss")).otherwise(F.col("target_loss"))
        result = marked.select(F.col("doc_id").alias(id_col), "n_tokens", loss.alias("target_loss"), "background_loss", (loss - F.col("background_loss")).alias("score"))
        return written(result, "scores", keep=True)
