"""Connected components as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import drop_folder, later, shared_folder


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node of an edge.

    Alternates large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014) until the edges are stars that
    no step changes; that takes about the logarithm of the longest path.  Each
    round is written to the shared folder, so lineage stays short and a lost
    executor costs one round.  Minima are combined before they are shuffled;
    a node with very many edges meets its one-row minimum in a join that
    adaptive execution can split.

    Edges with a null end and loops are ignored (a node that has nothing but a
    loop is its own component and is not returned); repeated edges are merged;
    no edges give no rows.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark, path = None, None
    while True:
        to = shared_folder(spark, "components")
        now.write.parquet(to)
        kept = spark.read.schema(now.schema).parquet(to)
        found = kept.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if path:
            drop_folder(spark, path)
        path = to
        later(lambda at=to: drop_folder(spark, at))
        if not found["n"]:
            return kept.select(F.col("u").alias("node"), F.col("v").alias("component"))
        if mark == found:
            break
        mark = found
        # Large star: the larger neighbours of each node go to the smallest one.
        both = kept.union(kept.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the smaller neighbours and the node itself go to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.union(low).distinct()
    roots = kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
