"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftgraph.session import shared_folder

#: Bytes of text that a worker turns into arrays at once.
SLICE_BYTES = 8 << 20


#: What the operators under way will remove at their end, by nesting.
_OPEN: list[list[Callable[[], None]]] = []


@contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Removes what ``written`` wrote inside, whether the work ends or fails,
    but for tables that it was told to keep."""
    _OPEN.append([])
    try:
        yield
    finally:
        for remove in _OPEN.pop():
            remove()
        release(spark)


def later(remove: Callable[[], None]) -> None:
    """Has ``dropped_after`` call this at its end, if there is one."""
    if _OPEN:
        _OPEN[-1].append(remove)


def written(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """``df`` as a table written to the shared folder: computed once, and safe
    from lost executors.  ``keep``: it outlasts ``dropped_after``, as a result
    that is read later must."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    if _OPEN and not keep:
        _OPEN[-1].append(lambda: drop_folder(spark, path))
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, parts: int, column: str, **options: str) -> DataFrame:
    """As ``written``, as a table of ``parts`` buckets by hash of ``column``:
    joins on it don't move its rows.  ``dropped_after`` drops the table too."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    table = f"{name}_{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1] += [lambda: spark.sql(f"drop table if exists {table}"), lambda: drop_folder(spark, path)]
    df.repartition(parts, column).write.bucketBy(parts, column).options(path=path, **options).saveAsTable(table)
    return spark.table(table)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``most`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        if text.buffers()[1] is None:
            yield batch
            continue
        wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64 if wide else np.int32, count=text.offset + len(text) + 1)[text.offset :].astype(np.int64)
        at = 0
        while at < len(text):
            to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
            to = min(max(to, at + 1), len(text))
            yield batch.slice(at, to - at)
            at = to


def string_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()
