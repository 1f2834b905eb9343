"""Stored tables that batches are merged onto, a few buckets at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import merge_edges, upsert_nodes

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """Parquet files partitioned by a hash of the key, below ``path``.

    A merge reads the buckets that its batch touches, stages what they shall be,
    names that complete by a rename, and then overwrites just those partitions.
    An end before the name leaves the table as it was; after it, the next use
    overwrites again from what is staged, which gives the same however often it
    is done.  One writer at a time.  Keys are spread by hash, so buckets are even
    whatever the keys are; ``buckets`` must stay what it was for a stored table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, list(key), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, folder: str) -> bool:
        return self._fs.exists(self._path(folder))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.hash(*self.key), F.lit(self.buckets)))

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or its rows of some buckets: others aren't listed or read."""
        self._finish()
        if not self._exists(f"{self.path}/rows"):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/rows")
        return (rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))).drop("bucket")

    def merge(self, batch: DataFrame, apply: Merge) -> list[int]:
        """The table's rows with the batch's merged in by ``apply(rows, batch)``;
        gives the buckets that were written.  Rows of the batch with a null in
        the key are left out.  An ``apply`` under which a batch that is merged
        twice gives what it gives once makes the whole safe to run again."""
        named = batch.where(" and ".join(f"{k} is not null" for k in self.key))
        touched = sorted(r[0] for r in self._bucketed(named).select("bucket").distinct().collect())  # one a bucket
        if touched:
            self._stage(self._bucketed(apply(self.read(touched), named)))
            self._finish()
        return touched

    def _stage(self, rows: DataFrame) -> None:
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.parquet(staged)
        if not self._fs.rename(self._path(staged), self._path(f"{self.path}/_ready")):
            raise OSError(f"{self.path}: a merge is under way")

    def _finish(self) -> None:
        """Overwrites the partitions that a complete merge has staged, if any."""
        if self._exists(f"{self.path}/_ready"):
            rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/_ready")
            self._overwrite(rows)
            self._fs.delete(self._path(f"{self.path}/_ready"), True)

    def _overwrite(self, rows: DataFrame) -> None:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")


def merge_nodes(table: KeyedTable, batch: DataFrame) -> list[int]:
    """Nodes of a batch onto a stored table, see ``upsert_nodes``."""
    return table.merge(batch, lambda rows, new: upsert_nodes(rows, new, table.key[0]))


def merge_stored_edges(table: KeyedTable, batch: DataFrame, nodes: DataFrame, props: list[str]) -> list[int]:
    """Edges of a batch onto a stored table (key: src, dst, type), see
    ``merge_edges``; ``nodes``: the ids that exist.  Stored edges stay."""

    def apply(rows: DataFrame, new: DataFrame) -> DataFrame:
        known = nodes.select("id").union(rows.select("src")).union(rows.select(F.col("dst")))
        stored = rows.select("src", "dst", "type", *props, F.lit(None).cast("long").alias("ord"))
        return merge_edges(stored, new.select("src", "dst", "type", *props, "ord"), known, props).select(rows.columns)

    return table.merge(batch, apply)
