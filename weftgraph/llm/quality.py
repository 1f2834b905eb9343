"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import slices, string_of, written
from weftgraph.llm.segments import column_bytes

#: Labelled rows that a model is fitted on at most: those with the least hash
#: of their id.  This bounds what the driver holds (about 5 MB).
TRAIN_ROWS = 40_000

FEATURES = (
    "log_bytes", "upper_share", "digit_share", "symbol_share", "mark_share", "bang_share", "run_share", "word_bytes",
    "distinct_share", "line_share", "white_share", "high_share", "pipe_share",
)

_KINDS = np.zeros(256, dtype=np.int64)  # 0: other
for _code, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*@^~+=<>{}[]\\_`", b".,;:?'\"()-/", b"!", b"\n", b" \t\r\x0b\x0c", b"|"), start=1):
    _KINDS[list(_bytes)] = _code
_KINDS[0x80:] = 10
_WHITE = (_KINDS == 7) | (_KINDS == 8)
_MARKED = (_KINDS == 4) | (_KINDS == 6)


def text_features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; nulls are empty, and an empty
    text has zeros."""
    data, offsets = column_bytes(column)
    n, size = len(column), np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    count = np.bincount(row * 11 + _KINDS[data], minlength=11 * n).reshape(n, 11).astype(np.float64)

    def sums(flags: np.ndarray) -> np.ndarray:
        return np.bincount(row[flags], minlength=n).astype(np.float64)

    same = np.zeros(len(data), dtype=bool)
    same[1:] = (data[1:] == data[:-1]) & _MARKED[data[1:]]
    starts = ~_WHITE[data]
    begins = np.zeros(len(data), dtype=bool)
    begins[offsets[:-1][size > 0]] = True
    inner = ~begins
    inner[1:] &= ~_WHITE[data[:-1]]
    inner[:1] = False
    first = np.flatnonzero(starts & ~inner)
    words = np.bincount(row[first], minlength=n).astype(np.float64)
    distinct = np.zeros(n)
    if len(first):
        # Words with the white space behind them, coded; white space varies little.
        bounds = np.append(first, len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.sort(row[first] * len(coded.dictionary) + code)
        new = np.append(True, pairs[1:] != pairs[:-1])
        distinct = np.bincount((pairs // len(coded.dictionary))[new], minlength=n).astype(np.float64)
    every = np.maximum(size, 1)
    letters = count[:, 1] + count[:, 2]
    return np.column_stack([
        np.log1p(size), count[:, 1] / (letters + 1), count[:, 3] / every, count[:, 4] / every, count[:, 5] / every, count[:, 6] / every, sums(same) / every,
        (size - count[:, 7] - count[:, 8]) / np.maximum(words, 1), distinct / np.maximum(words, 1), count[:, 7] / every, (count[:, 7] + count[:, 8]) / every, count[:, 10] / every, count[:, 9] / every,
    ])


def _leaves(gradient: np.ndarray, weight: np.ndarray, most: int, least: float) -> np.ndarray:
    """A shallow tree over ordered bins: each bin's Newton step in its leaf."""
    g, w = np.append(0, np.cumsum(gradient)), np.append(0, np.cumsum(weight))
    cuts = [0, len(gradient)]

    def gain(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, 0
        at = np.arange(lo + 1, hi)
        gl, wl, gr, wr = g[at] - g[lo], w[at] - w[lo], g[hi] - g[at], w[hi] - w[at]
        found = gl**2 / (wl + 1) + gr**2 / (wr + 1) - (g[hi] - g[lo]) ** 2 / (w[hi] - w[lo] + 1)
        found[(wl < least) | (wr < least)] = 0
        best = int(np.argmax(found))
        return float(found[best]), int(at[best])

    while len(cuts) <= most:
        value, at = max(gain(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        if value <= 1e-12:
            break
        cuts = sorted([*cuts, at])
    out = np.empty(len(gradient))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1)
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """The best cut of a table of bins into four, with its gain."""
    g = np.pad(gradient.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    w = np.pad(weight.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def four(t: np.ndarray) -> list[np.ndarray]:
        inner = t[1:-1, 1:-1]
        return [inner, t[1:-1, -1:] - inner, t[-1:, 1:-1] - inner, t[-1, -1] - t[1:-1, -1:] - t[-1:, 1:-1] + inner]

    gs, ws = four(g), four(w)
    gain = sum(a**2 / (b + 1) for a, b in zip(gs, ws, strict=True))
    gain = np.where(np.minimum.reduce(ws) >= least, gain, 0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = [a[i, j] / (b[i, j] + 1) for a, b in zip(gs, ws, strict=True)]
    out = np.empty_like(gradient)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return float(gain[i, j]), out if gain[i, j] > 0 else np.zeros_like(gradient)


@dataclass
class AdditiveModel:
    """Lookup tables by bin: one for each feature, and for each pair chosen."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: int = 8

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def _coarse(self, bins: np.ndarray, j: int) -> np.ndarray:
        return bins * self.coarse // (len(self.edges[j]) + 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of one table entry a feature and a pair."""
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for t, i in zip(self.tables, b, strict=True):
            out += t[i]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self._coarse(b[i], i), self._coarse(b[j], j)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_model(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, bins: int = 64, leaves: int = 3, n_pairs: int = 6, least: float = 2.0) -> AdditiveModel:
    """Cyclic boosting: each round gives every feature in turn one shallow tree
    on the loss gradient, added to that feature's table; then the pairs whose
    best four-way cut of what is left gains most are boosted alike.

    With one class only, or no rows, the model is a constant.
    """
    model = AdditiveModel()
    d = x.shape[1] if x.ndim == 2 else len(FEATURES)
    for j in range(d):
        cut = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)
        model.edges.append(cut)
        model.tables.append(np.zeros(len(cut) + 1))
    p = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(p / (1 - p)))
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    f = np.full(len(y), model.base)
    for _ in range(rounds):
        for j in range(d):
            q = 1 / (1 + np.exp(-f))
            n = len(model.tables[j])
            step = rate * _leaves(np.bincount(b[j], y - q, n), np.bincount(b[j], q * (1 - q), n), leaves, least)
            model.tables[j] += step
            f += step[b[j]]
    k = model.coarse
    c = [model._coarse(b[j], j) for j in range(d)]

    def cells(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(c[i] * k + c[j], values, k * k).reshape(k, k)

    q = 1 / (1 + np.exp(-f))
    gains = [(_quadrants(cells(i, j, y - q), cells(i, j, q * (1 - q)), least)[0], i, j) for i in range(d) for j in range(i)]
    for gain, i, j in sorted(gains, reverse=True)[:n_pairs]:
        if gain > 0:
            model.pairs.append((i, j))
            model.pair_tables.append(np.zeros((k, k)))
    for _ in range(rounds // 4):
        for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True):
            q = 1 / (1 + np.exp(-f))
            step = rate * _quadrants(cells(i, j, y - q), cells(i, j, q * (1 - q)), least)[1]
            t += step
            f += step[c[i], c[j]]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of training: crc32 of its id mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features) for every row; narrow."""
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            x = text_features(string_of(part, "text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([string_of(part, "doc_id"), lists], ["doc_id", "features"])

    return picked.mapInArrow(run, f"doc_id {kind}, features array<double>")


def train(features: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fits on labelled rows that aren't held out; at most ``rows`` of them,
    those with the least hash of the id.  Null labels and ids are left out;
    repeated labels count as often as they stand there.  The order of rows
    doesn't matter: the fitted sample is sorted."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    sample = features.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("doc_id", "y", "features").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows).toArrow()
    y = sample.column("y").to_numpy().astype(np.float64)
    x = np.array(sample.column("features").to_pylist(), dtype=np.float64).reshape(len(y), len(FEATURES))
    return fit_model(x, y)


def score_features(features: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of a feature table."""
    kind = features.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = string_of(part, "features").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([string_of(part, "doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return features.mapInArrow(run, f"doc_id {kind}, score double, predicted int").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores every document by a model of its own labelled rows.

    The features of all texts are computed once and written; labels meet them
    there, not the texts.  Scores see nothing but the features of the text.
    Null texts are scored as empty ones; repeated rows get a row each; an empty
    table gives no rows.
    """
    features = written(feature_table(docs), "quality")
    return score_features(features, train(features, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, unchanged.

    The second pass scores rows where they are read, so no text is shuffled.
    """
    model = train(written(feature_table(docs), "quality"), labels)
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            good = model.score(text_features(string_of(part, "text"))) >= threshold
            yield part.filter(pa.array(good))

    return docs.mapInArrow(run, schema)
