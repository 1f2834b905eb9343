"""A deterministic embedder, for tests and as the shape of a real one.

A text's words are hashed to signed places of a vector (the hashing trick); an
embedder that calls a model would be an Arrow UDF of the same signature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def hash_vector(text: str, size: int) -> list[float]:
    out = np.zeros(size)
    for word in text.lower().split():
        code = zlib.crc32(word.encode())
        out[code % size] += 1 if code >> 16 & 1 else -1
    length = np.linalg.norm(out)
    return (out / length if length else out).astype(np.float32).tolist()


def hashing_embedder(size: int = 64):
    """text -> vector of ``size`` floats of length 1 (0 for no words)."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda s: None if s is None else hash_vector(s, size))

    return embed
