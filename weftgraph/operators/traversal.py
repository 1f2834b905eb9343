"""Traversals: level-synchronous joins of a frontier with the edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.session import shared_base

#: Tables of visited nodes that a search keeps apart.
SEEN_TABLES = 16


def numbered(rows: DataFrame, groups: list[str], order: list[Column | str], column: str) -> DataFrame:
    """Rows with their number in their group, from 0, by ``order``.

    Ranges of the order are numbered apart, and the numbers of rows in a group's
    earlier ranges are added, from a table of one row a range and group, so a
    group may be of any size.  Rows that ``order`` doesn't tell apart stay in one
    range, in any order.  The ranges are kept, so both readings see the same.
    """
    ranged = kept(rows.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy(*groups, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = ranged.withColumn("_at", F.row_number().over(W.partitionBy(*groups, "_range").orderBy(*order)) - 1)
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*groups, "_range")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    both = inside.alias("i").join(sizes.alias("s"), cond)
    return both.select(*[F.col(f"i.{c}") for c in rows.columns], (F.col("_at") + F.col("_before")).alias(column))


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a loop: written to the checkpoint folder, so that a
    lost executor costs one round."""
    shared_base(df.sparkSession)
    return df.checkpoint()


def breadth_first(seeds: DataFrame, edges: DataFrame, depth: int, keep_path: bool = True) -> DataFrame:
    """Nodes within ``depth`` steps of the seeds: id, depth, queue place, path.

    ``seeds``: id, ord; ``edges``: src, dst, type, ord.  A node belongs to its
    first discoverer, by place in the queue and then by order of edges, as in a
    queue with a visited set that starts with all seeds.
    """
    start = seeds.groupBy("id").agg(F.min("ord").alias("ord"))
    level = start.select("id", F.lit(0).alias("depth"), F.array(F.col("ord").cast("long")).alias("place"), F.array("id").alias("path"), F.lit("seed").alias("relationship"))
    found = level
    steps = edges.select("src", F.col("dst").alias("to"), "type", F.col("ord").cast("long").alias("ord"))
    for step in range(1, depth + 1):
        out = level.select(F.col("id").alias("src"), "place", "path").join(steps, "src").select(F.col("to").alias("id"), F.concat("place", F.array("ord")).alias("place"), "path", F.col("type").alias("relationship"))
        new = out.join(found.select("id"), "id", "left_anti")
        first = new.groupBy("id").agg(F.min_by(F.struct("place", "path", "relationship"), F.struct("place", "relationship")).alias("f"))
        level = first.select("id", F.lit(step).alias("depth"), "f.place", F.concat("f.path", F.array("id")).alias("path"), "f.relationship")
        if step < depth:
            level = kept(level)  # read by the next step and by the result
        found = found.union(level)
    return found if keep_path else found.drop("path")


def traverse_references(seeds: DataFrame, edges: DataFrame, articles: DataFrame, depth: int = 2, most: int = 20) -> DataFrame:
    """Seeds and what they cite, in queue order, ``most`` rows that exist."""
    reached = breadth_first(seeds, edges.where(F.col("type") == "REFERENCES"), depth)
    return reached.join(articles.select("id"), "id", "left_semi").orderBy("depth", "place", "id").limit(most)


def shortest_path(edges: DataFrame, start: object, goal: object, most: int = 1000) -> DataFrame:
    """One shortest path as (step, id): along references, then to the next
    article, then to the one before.  No rows if there is none; one if the ends
    are the same.  ``most`` bounds the rounds, and so a path's nodes."""
    spark = edges.sparkSession
    kinds = F.create_map(F.lit("REFERENCES"), F.lit(0), F.lit("NEXT_ARTICLE"), F.lit(1))
    forth = edges.where(F.col("type").isin("REFERENCES", "NEXT_ARTICLE")).select("src", "dst", kinds[F.col("type")].alias("rank"), "ord")
    back = edges.where(F.col("type") == "NEXT_ARTICLE").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(2).alias("rank"), "ord")
    steps = forth.union(back)
    id_type = edges.schema["src"].dataType
    level = spark.createDataFrame([(start,)], "id string").select(F.col("id").cast(id_type), F.array(F.col("id").cast(id_type)).alias("path"), F.array(F.lit(0).cast("long")).alias("place"))
    seen = [level.select("id")]
    for step in range(1, most + 1):
        hit = level.where(F.col("id") == F.lit(goal)).select("path").first()
        if hit:
            return spark.createDataFrame([(i, x) for i, x in enumerate(hit["path"])], f"step int, id {id_type.simpleString()}")
        if step == most:
            break
        out = level.select(F.col("id").alias("src"), "path", "place").join(steps, "src").select(F.col("dst").alias("id"), "path", F.concat("place", F.array(F.col("rank").cast("long"), F.col("ord").cast("long"))).alias("place"))
        new = out.join(reduce(DataFrame.union, seen), "id", "left_anti").groupBy("id").agg(F.min_by(F.struct("path", "place"), "place").alias("f"))
        level = kept(new.select("id", F.concat("f.path", F.array("id")).alias("path"), "f.place"))
        if level.isEmpty():
            break
        # Each round adds its own table; they are written anew as one now and then.
        seen.append(level.select("id"))
        if len(seen) > SEEN_TABLES:
            seen = [kept(reduce(DataFrame.union, seen))]
    return spark.createDataFrame([], f"step int, id {id_type.simpleString()}")


def find_paths(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """As a breadth-first search over all types, with a weight of 1 / depth."""
    return breadth_first(seeds, edges, hops).where("depth > 0").withColumn("weight", F.try_divide(F.lit(1.0), F.col("depth")))


def neighbours(edges: DataFrame, articles: DataFrame, center: object) -> DataFrame:
    return edges.where(F.col("src") == F.lit(center)).select(F.col("dst").alias("id"), "type").join(articles, "id").distinct()


def referencing(edges: DataFrame, article: object) -> DataFrame:
    """Sources of REFERENCED_BY edges into an article.  Those edges lead from the
    cited to the citing one, so these are the articles that it cites."""
    return edges.where((F.col("type") == "REFERENCED_BY") & (F.col("dst") == F.lit(article))).select(F.col("src").alias("id"))


def reference_contexts(edges: DataFrame, article: object) -> DataFrame:
    return edges.where((F.col("type") == "REFERENCES") & (F.col("dst") == F.lit(article))).select("src", "context", "reference_text")


def first_parents(edges: DataFrame) -> DataFrame:
    """Source of the first incoming edge of each node, of any type."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.min_by("src", F.struct("ord", "src")).alias("parent"))


def layer_depths(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Depth of each node: seeds 0, others 1 + the greatest depth of a parent.

    Passes are bounded by the number of nodes plus one, which ends cycles;
    nodes that seeds don't lead to have depth 0.
    """
    rounds = nodes.count() + 1
    start = seeds.select("id").distinct().withColumn("seed", F.lit(True))
    now = kept(nodes.select("id").distinct().join(start, "id", "left").select("id", F.coalesce("seed", F.lit(False)).alias("seed"), F.when(F.col("seed"), 0).cast("int").alias("depth")))
    for _ in range(rounds):
        deep = now.where("depth is not null").select(F.col("id").alias("src"), F.col("depth").alias("d"))
        best = edges.select("src", "dst").join(deep, "src").groupBy(F.col("dst").alias("id")).agg((F.max("d") + 1).alias("next"))
        step = kept(now.join(best, "id", "left").select("id", "seed", F.when(F.col("seed"), F.lit(0)).otherwise(F.coalesce("next", "depth")).alias("depth")))
        same = step.join(now.select("id", F.col("depth").alias("was")), "id").where("not (depth <=> was)").isEmpty()
        now = step
        if same:
            break
    return now.select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def layer_rows(layers: DataFrame, edges: DataFrame, order: str) -> DataFrame:
    """Row of each node in its layer: by the mean row of its parents in the
    layer above, then by ``order``.  A loop over depths."""
    deepest = layers.agg(F.max("depth")).first()[0]
    done = kept(numbered(layers.where("depth = 0"), ["depth"], [order], "row"))
    for depth in range(1, (deepest or 0) + 1):
        above = done.select(F.col("id").alias("src"), F.col("row").alias("up"))
        mean = edges.select("src", "dst").join(above, "src").groupBy(F.col("dst").alias("id")).agg(F.avg("up").alias("mean"))
        ranked = layers.where(F.col("depth") == depth).join(mean, "id", "left").select(*layers.columns, "mean")
        placed = numbered(ranked, ["depth"], [F.col("mean").asc_nulls_last(), F.col(order)], "row").drop("mean")
        done = done.unionByName(kept(placed))
    return done
