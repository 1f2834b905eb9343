"""Nearest rows of many queries: products of blocks in tasks, exact scores of what remains."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import vectors as V

#: Scores that are held at once, and pairs that one task scores.
BLOCK_SCORES, TASK_PAIRS = 2_000_000, 100_000_000
#: How far a product of blocks may lie below the exact score: far more than it
#: does for 2^17 numbers a vector.
SLACK = 1e-9
#: Squared lengths between which products neither overflow nor lose digits.
LEAST, MOST = 1e-200, 1e200


def usable(vector: Column, length: int) -> Column:
    """Whether a vector has this length, finite numbers only and a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == length) & finite & V.dot(vector, vector).between(LEAST, MOST), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, length)


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of ``a`` and ``b``, added one after the other as
    ``vectors.dot`` does: the same numbers to the last bit."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def least_ids(ids: pa.Array, x: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that have ``k`` equal vectors of lesser id: all queries
    score equal vectors alike, so these are never among the ``k`` nearest."""
    _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    place = np.empty(len(x), dtype=np.int64)
    place[pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(x))
    order = np.lexsort((place, group))
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    within = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
    return np.sort(order[within < k])


def near(rows: DataFrame, query_ids: pa.Array, asked_kind: str, queries: np.ndarray, k: int, probed: Callable[[], np.ndarray] | None = None) -> DataFrame:
    """(query_id, id, score): the ``k`` nearest rows of each task for each query,
    and some more; all vectors are ``usable``.

    ``rows``: id, vector and, with ``probed``, list.  ``probed`` gives for each
    query which lists it reads.  A task holds the ``k`` best products of each
    query so far, and scores exactly what comes up to them.
    """
    length = queries.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = np.sqrt(summed(queries, queries))
        units = queries / norms[:, None]
        best = np.full((len(queries), k), -np.inf)
        reads = probed() if probed else None
        for part in batches:
            if not part.num_rows:
                continue
            x = matrix(part.column(1), length)
            kept = least_ids(part.column(0), x, k)
            x, ids = x[kept], part.column(0).take(pa.array(kept))
            sizes = np.sqrt(summed(x, x))
            home = np.asarray(part.column(2))[kept] if reads is not None else np.zeros(len(x), dtype=np.int64)
            for one in np.unique(home):
                asked = np.arange(len(queries)) if reads is None else np.flatnonzero(reads[:, one])
                mine = np.flatnonzero(home == one)
                step = max(1, BLOCK_SCORES // max(1, len(asked)))
                for at in range(0, len(mine) if len(asked) else 0, step):
                    block = mine[at : at + step]
                    score = units[asked] @ (x[block] / sizes[block, None]).T
                    better = np.flatnonzero(score.max(axis=1) > best[asked].min(axis=1))
                    best[asked[better]] = np.partition(np.hstack([best[asked[better]], score[better]]), len(block), axis=1)[:, len(block) :]
                    q, r = np.nonzero(score >= (best[asked].min(axis=1) - SLACK)[:, None])
                    q, r = asked[q], block[r]
                    if len(q):
                        exact = summed(x[r], queries[q]) / (sizes[r] * norms[q])
                        yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), ids.take(pa.array(r)), pa.array(exact)], ["query_id", "id", "score"])

    return rows.mapInArrow(run, f"query_id {asked_kind}, id {rows.schema['id'].dataType.simpleString()}, score double")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
