"""Token ids as Parquet list columns."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import slices, string_of
from weftgraph.llm.segments import column_bytes, document_bounds, tokenizer_of

#: Bytes of row groups and of pages.
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10


def encoded_ids(column: pa.Array, tokenizer_path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, bounds of each text's); ``end_id`` is put
    after every text."""
    tokenizer = tokenizer_of(tokenizer_path)
    data, offsets = column_bytes(column)
    bounds, first = document_bounds(tokenizer, data, offsets)
    ids, sizes = tokenizer.ids(data, bounds)
    at = np.concatenate([[0], np.cumsum(sizes)])[first]
    if end_id is not None:
        ids = np.insert(ids, at[1:], end_id)
        at = at + np.arange(len(at))
    return ids.astype(np.uint32), at


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Writes ids in ascending order of ``id_col`` as Parquet.

    Columns: ``part`` (files in ascending order of id), ``doc_id``, ``offset``
    (ids before it in its part), ``n_tokens``, ``ids`` (list<int>).  Texts are
    dealt by ranges of the id, before they are encoded: a text is smaller than
    its ids.  Row groups and pages are small and have page indexes, so that
    reads by id, or of counts alone, skip nearly all bytes.  Ids are few and
    wide: dictionary pages pack them to 16 bits; counts and offsets are
    delta-encoded (format version 2).

    Null texts are empty, null ids come first, repeated rows are all written
    (ties in the order of the text's hash); an empty table gives files
    without rows.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if files is None:
        files = max(2, 2 * docs.rdd.getNumPartitions())
    dealt = picked.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for piece in slices(batches, "text"):
            ids, at = encoded_ids(string_of(piece, "text"), tokenizer_path, end_id)
            n = len(at) - 1
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, dtype=np.int32)), string_of(piece, "doc_id"), pa.array(before + at[:-1]), pa.array(np.diff(at).astype(np.int64)), lists], ["part", "doc_id", "offset", "n_tokens", "ids"])
            before += int(at[-1])

    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": "2000",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
    }
    out = dealt.mapInArrow(run, f"part int, doc_id {kind}, offset long, n_tokens long, ids array<int>")
    out.write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files with ``start``: ids of all documents before each.

    The base of each part is the sum of the parts before it; that table has a
    row for each file, of which there are as many as the writer was told.
    """
    rows = spark.read.parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row a file; a file is one task's output.
    totals = sorted((r["part"], r["total"]) for r in sums.collect())
    bases, base = [], 0
    for part, total in totals:
        bases.append((part, base))
        base += total
    base_rows = spark.createDataFrame(bases, "part int, base long")
    return rows.join(F.broadcast(base_rows), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from lists that were read back."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = string_of(batch, "ids")
            ends = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([string_of(batch, "doc_id"), string_of(batch, "start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, type=pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
