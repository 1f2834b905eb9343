"""Token counts by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import slices, string_of
from weftgraph.llm.segments import SegmentTokenizer, column_bytes, document_bounds, tokenizer_of

#: Longer documents are encoded in overlapping chunks.
CHUNK_BYTES = 1 << 16
OVERLAP_BYTES = 512
#: Tokens on either side of a splice that both chunks must have alike.
AGREE = 4


def _character_start(data: np.ndarray, at: int) -> int:
    """The first byte of the UTF-8 character that holds byte ``at``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


class _Chunk:
    """The library's ids of ``data[lo:hi]``, and the bytes from which and to
    which each token goes in the document."""

    def __init__(self, tokenizer: SegmentTokenizer, data: np.ndarray, lo: int, hi: int):
        part = data[lo:hi]
        coded = tokenizer.library.encode(part.tobytes().decode("utf-8"), add_special_tokens=False)
        self.ids = np.array(coded.ids, dtype=np.uint32)
        # The library counts characters.
        byte = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part)) + lo
        spans = byte[np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)]
        self.starts, self.ends = spans[:, 0], spans[:, 1]
        self.lo, self.hi, self.cuts = lo, hi, tokenizer.cuts(part) + lo

    def at(self, place: int) -> int | None:
        """Number of the first token behind ``place``, if that is a boundary."""
        k = int(np.searchsorted(self.ends, place, side="right"))
        return k if k == len(self.ids) or self.starts[k] >= place else None


def aligned(left: _Chunk, right: _Chunk, place: int, start: int, agree: int = AGREE) -> bool:
    """Whether two chunks may be spliced at ``place``: a boundary in both, around
    which ``agree`` tokens on either side are the same, by id and by offsets.

    ``start`` is where the left chunk's own ids begin; in front of it, and where
    the document ends, fewer tokens suffice.
    """
    a, b = left.at(place), right.at(place)
    if a is None or b is None:
        return False
    before = agree if right.lo > start else min(agree, b)
    behind = agree if left.hi < right.hi else min(agree, len(left.ids) - a)
    if a < before or b < before or len(left.ids) - a < behind or len(right.ids) - b < behind:
        return False
    x, y = slice(a - before, a + behind), slice(b - before, b + behind)
    return all(np.array_equal(getattr(left, c)[x], getattr(right, c)[y]) for c in ("ids", "starts", "ends"))


def encode_huge(tokenizer: SegmentTokenizer, data: np.ndarray, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> Iterator[np.ndarray]:
    """Ids of one document, in parts, from chunks that overlap.

    A chunk may start or end inside a token, so its outer ids mean nothing.
    Neighbours are spliced at the last place of their overlap that is a proven
    boundary of the whole document's tokenisation (see ``segments``) and around
    which both chunks' tokens agree (``aligned``).  If there is none, the overlap
    is doubled and the next chunk encoded again; once it reaches back to the last
    splice, one chunk of twice the size takes the place of both.  A tokenizer
    without proven boundaries thus encodes the document whole.
    """
    start = lo = 0
    hi = len(data) if not tokenizer.kind else _character_start(data, min(len(data), chunk))
    left = _Chunk(tokenizer, data, lo, hi)
    while hi < len(data):
        wide = overlap
        while True:
            lo_next = _character_start(data, max(start, hi - wide))
            hi_next = _character_start(data, min(len(data), hi + chunk))
            right = _Chunk(tokenizer, data, lo_next, hi_next)
            common = np.intersect1d(left.cuts[left.cuts > max(start, lo_next)], right.cuts)
            at = next((int(x) for x in common[::-1] if aligned(left, right, int(x), start)), None)
            if at is not None:
                yield left.ids[left.at(start) : left.at(at)]
                start, left, hi = at, right, hi_next
                break
            if lo_next <= start:
                hi = _character_start(data, min(len(data), start + 2 * (hi_next - start)))
                left = _Chunk(tokenizer, data, start, hi)
                break
            wide *= 2
    yield left.ids[left.at(start) :]


def document_tokens(tokenizer: SegmentTokenizer, column: pa.Array, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text of a column.

    Texts beyond a chunk go through ``encode_huge``; all others through the
    tokenizer's memo of segments.
    """
    data, offsets = column_bytes(column)
    n_bytes = np.diff(offsets)
    n_tokens = np.zeros(len(n_bytes), dtype=np.int64)
    huge = n_bytes > chunk
    for i in np.flatnonzero(huge):
        n_tokens[i] = sum(len(x) for x in encode_huge(tokenizer, data[offsets[i] : offsets[i + 1]], chunk, overlap))
    at = 0
    for stop in [*np.flatnonzero(huge), len(n_bytes)]:  # runs of others
        if stop > at:
            part = data[offsets[at] : offsets[stop]]
            bounds, first = document_bounds(tokenizer, part, offsets[at : stop + 1] - offsets[at])
            total = np.concatenate([[0], np.cumsum(tokenizer.counts(part, bounds))])
            n_tokens[at:stop] = total[first[1:]] - total[first[:-1]]
        at = stop + 1
    return n_bytes, n_tokens


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Narrow: one pass over the scan's partitions, no shuffle.  Null texts count
    as empty (0 tokens, not over the limit); null ids and repeated rows are
    kept as they are; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        for part in slices(batches, "text"):
            n_bytes, n_tokens = document_tokens(tokenizer, string_of(part, "text"), chunk_bytes, overlap_bytes)
            yield pa.RecordBatch.from_arrays([string_of(part, "id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = picked.mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
