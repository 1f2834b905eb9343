"""Sum-of-squares packing of documents into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import slices, string_of
from weftgraph.llm.token_files import encoded_ids

#: A piece: document, start in it, its ids, tokens of the whole document.
Piece = tuple[object, int, np.ndarray, int]


class SumOfSquares:
    """Online packing by the sum-of-squares rule.

    ``level[h]`` counts the open windows that hold ``h`` tokens.  An item of
    size ``s`` goes to the level (0: a new window) for which the sum of the
    squares of all levels is least afterwards; full windows leave the array.
    Ties go to the fullest window.
    """

    def __init__(self, size: int):
        self.size = size
        self.level = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts a piece (shorter than a window); returns the window if full."""
        s, level = len(piece[2]), self.level
        held = np.flatnonzero(level[1 : self.size - s + 1]) + 1
        to = held + s
        # Change of the sum: 2 (N[h + s] - N[h]) + 2, or 1 - 2 N[h] if that fills it.
        change = np.where(to == self.size, 1 - 2 * level[held], 2 * (level[to] - level[held]) + 2)
        best, at = 2 * level[s] + 1, 0
        if len(held):
            i = len(held) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= best:
                at = int(held[i])
        if at:
            window = self.open[at].pop()
            level[at] -= 1
        else:
            window = []
        window.append(piece)
        if at + s == self.size:
            return window
        level[at + s] += 1
        self.open.setdefault(at + s, []).append(window)
        return None

    def close(self) -> Iterator[list[Piece]]:
        """The open windows, made full: tokens of the emptiest are cut off and
        fill the fullest.  What is left at the end, less than one window, is cut
        into windows whose lengths are powers of two, which need no padding."""
        left = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open.clear()
        self.level[:] = 0
        front, back = 0, len(left) - 1
        while front <= back:
            window = left[front]
            gap = self.size - sum(len(p[2]) for p in window)
            while gap and back > front:
                doc, start, ids, n = left[back].pop()
                keep = max(0, len(ids) - gap)
                window.append((doc, start + keep, ids[keep:], n))
                gap -= len(ids) - keep
                if keep:
                    left[back].append((doc, start, ids[:keep], n))
                elif not left[back]:
                    back -= 1
            if gap:
                yield from self._halves(window)
            else:
                yield window
            front += 1

    @staticmethod
    def _halves(window: list[Piece]) -> Iterator[list[Piece]]:
        """One window as windows of powers of two, the largest first."""
        rest = window[::-1]
        total = sum(len(p[2]) for p in window)
        for bit in range(total.bit_length() - 1, -1, -1):
            want, part = total & 1 << bit, []
            while want:
                doc, start, ids, n = rest.pop()
                part.append((doc, start, ids[:want], n))
                if len(ids) > want:
                    rest.append((doc, start + want, ids[want:], n))
                want -= min(want, len(ids))
            if part:
                yield part


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length, padding.  Whole windows are cut from a long document first;
    its rest is placed by ``SumOfSquares``.  Each partition of the scan packs
    its own documents online, in one pass and with no shuffle; a task holds the
    open windows only, of which the rule keeps few.  A sequence's id has the
    partition in its upper bits, so a task that runs again gives the same ones.
    A sequence is padded to ``size`` unless its length is a power of two; as
    the last tokens of a partition are cut to such lengths, none is padded.

    Null texts are empty and have the end id alone; null ids and repeated rows
    are packed like any others; an empty table has no pieces.
    """
    kind = docs.schema[id_col].dataType
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "padding"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        packer = SumOfSquares(size)
        id_type = None

        def put(window: list[Piece]) -> None:
            nonlocal number
            at, total = 0, sum(len(p[2]) for p in window)
            padding = 0 if total & (total - 1) == 0 else size - total
            for doc, start, ids, n in window:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), n, number, at, total, padding))
                at += len(ids)
            number += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type=id_type), *(pa.array(c, type=pa.int64()) for c in cols[1:])], names)

        for part in slices(batches, "text"):
            id_type = string_of(part, "doc_id").type
            ids, at = encoded_ids(string_of(part, "text"), tokenizer_path, end_id)
            for i, doc in enumerate(string_of(part, "doc_id").to_pylist()):
                own = ids[at[i] : at[i + 1]]
                n = len(own)
                whole = n - n % size
                for start in range(0, whole, size):
                    put([(doc, start, own[start : start + size], n)])
                if n > whole and (full := packer.place((doc, whole, own[whole:].copy(), n))):
                    put(full)
            if rows:
                yield out()
        for window in packer.close():
            put(window)
        if rows:
            yield out()

    ddl = f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:])
    return picked.mapInArrow(run, ddl).withColumnRenamed("doc_id", id_col)
