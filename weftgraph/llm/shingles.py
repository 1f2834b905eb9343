"""Words and word shingles of a column of texts, as arrays of hashes.

A-Z are lower-cased; words are runs of bytes other than space and 0x09-0x0D.
A document's shingles are its windows of ``width`` words; one with fewer words
has its whole sequence as its one shingle, one without words has none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from weftgraph.llm.segments import column_bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


#: Odd factors by the place of a word in its window.
_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


@dataclass
class Words:
    """Hashes of all words in a row, and where each document's begin."""

    hashes: np.ndarray
    bounds: np.ndarray

    def windows(self, width: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of windows in a row, bounds of each document's).

        ``exact``: a document with fewer words has no window.
        """
        words, bounds = self.hashes, self.bounds
        n = np.diff(bounds)
        total = len(words)
        sums = np.zeros(max(total - width + 1, 0), dtype=np.uint64)
        for k in range(width):
            sums += words[k : k + len(sums)] * _FACTORS[k]
        sums = mixed(sums + np.uint64(width))
        counts = np.maximum(n - width + 1, 0)
        short = np.flatnonzero((n > 0) & (n < width)) if not exact else np.empty(0, dtype=np.int64)
        counts[short] = 1
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(ends[-1], dtype=np.int64) + np.repeat(bounds[:-1] - ends[:-1], counts)
        if len(short):
            out = np.empty(ends[-1], dtype=np.uint64)
            whole = np.repeat(n >= width, counts)
            out[whole] = sums[at[whole]]
            for d in short:
                part = words[bounds[d] : bounds[d + 1]]
                out[ends[d]] = mixed(np.array([(part * _FACTORS[: len(part)]).sum() + np.uint64(len(part))], dtype=np.uint64))[0]
            return out, ends
        return sums[at], ends


#: Bytes whose words are hashed at once (or up to the end of a longer word).
BLOCK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_VALUES = mixed(np.arange(1000, 1256, dtype=np.uint64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.ones(1, dtype=np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            tables.append(out)
        _POWERS[:] = tables
    return _POWERS[0], _POWERS[1]


def _hashes(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``data[first:stop]``: a polynomial of the bytes'
    random values, from differences of running sums, and the length."""
    if not len(first):
        return np.empty(0, dtype=np.uint64)
    origin = int(first[0])
    part = data[origin : int(stop[-1])]
    power, inverse = _powers(len(part) + 1)
    sums = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[part] * power[: len(part)], out=sums[1:])
    value = (sums[stop - origin] - sums[first - origin]) * inverse[first - origin]
    return mixed(value + (stop - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(column: pa.Array) -> Words:
    """The words of each text; a null text has none."""
    data, offsets = column_bytes(column)
    size = np.diff(offsets)
    black = ~_WHITE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    stop = first.copy()
    first[1:-1] |= ~black[:-1]
    first[:-1] &= black
    first[-1] = False
    stop[1:-1] |= ~black[1:]
    stop[1:] &= black
    stop[0] = False
    first, stop = np.flatnonzero(first), np.flatnonzero(stop)
    bounds = np.searchsorted(first, offsets)
    data = _LOWER[data]
    out, at = [], 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(stop, first[at] + BLOCK_BYTES, side="right")))
        out.append(_hashes(data, first[at:to], stop[at:to]))
        at = to
    return Words(np.concatenate(out) if out else np.empty(0, dtype=np.uint64), bounds)
