"""Paths of a pattern: edges of some types, between two numbers of hops."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.traversal import kept

#: Spark's limits of a recursion: rounds by default, and the setting of its rows.
ROUNDS, ROW_LIMIT = 100, "spark.sql.cteRecursionRowLimit"

_PATHS = """
WITH RECURSIVE paths(start, node, hops, path, types, used) MAX RECURSION LEVEL {rounds} AS (
  SELECT id, id, 0, array(id), cast(array() AS array<string>), {none} FROM {{starts}}
  UNION ALL
  SELECT p.start, e.dst, p.hops + 1, concat(p.path, array(e.dst)), concat(p.types, array(e.type)), concat(p.used, array(e.edge))
  FROM paths p JOIN {{steps}} e ON e.src = p.node
  WHERE p.hops < {high} AND NOT array_contains(p.used, e.edge)
)
SELECT start, node AS goal, hops, path, types FROM paths WHERE hops >= {low}
"""


@contextmanager
def without_row_limit(spark: SparkSession) -> Iterator[None]:
    """Recursions of any number of rows, for as long as this lasts."""
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(ROW_LIMIT, before)


def match_paths(edges: DataFrame, types: Sequence[str], low: int = 1, high: int = 3, starts: DataFrame | None = None, goals: DataFrame | None = None) -> DataFrame:
    """(start, goal, hops, path, types): all paths of ``low`` to ``high`` edges of
    any of the ``types``, each edge from its source to its target.

    ``edges``: src, dst, type, and ``ord`` if there is one; ``starts`` and
    ``goals``: id, where paths may begin (else at any source) and must end.  A
    path uses an edge once at most, so cycles end by themselves, and a node may
    come again; rows that are equal in src, dst, type and ord are one edge, and
    edges with a null end or type are none.  ``low`` 0 gives each start itself.
    No edges, types or starts give no rows (but for the starts of ``low`` 0).

    This is one recursive query.  Each round joins the paths that may still grow
    with the edges of the types, so what it costs grows with the number of paths:
    ``starts`` is what keeps that low, as the recursion begins there.  The result
    is computed at once and kept, which also cuts its lineage.
    """
    if not 0 <= low <= high:
        raise ValueError(f"no number of hops is from {low} to {high}")
    spark = edges.sparkSession
    place = F.col("ord").cast("string") if "ord" in edges.columns else F.lit(None).cast("string")
    typed = edges.where(F.col("type").isin(*types) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst", "type", place.alias("ord")).distinct()
    steps = typed.withColumn("edge", F.struct("src", "dst", "type", "ord"))
    first = typed.select(F.col("src").alias("id")) if starts is None else starts.select("id").where("id is not null")
    none = f"cast(array() AS array<{steps.schema['edge'].dataType.simpleString()}>)"
    query = _PATHS.format(rounds=max(ROUNDS, high + 1), none=none, high=int(high), low=int(low))
    with without_row_limit(spark):
        found = spark.sql(query, starts=first.distinct(), steps=steps)
        if goals is not None:
            found = found.join(goals.select(F.col("id").alias("goal")).distinct(), "goal", "left_semi")
        return kept(found.select("start", "goal", "hops", "path", "types"))


def ancestors(edges: DataFrame, nodes: DataFrame, articles: DataFrame, hops: int = 3) -> DataFrame:
    """(id, label, name, hops): the parts, chapters and so on that articles belong
    to, by the shortest path of ``BELONGS_TO_…`` edges; of several names at one
    distance the least.  ``nodes``: id, label, name; ``articles``: id."""
    types = ["BELONGS_TO_SUBSECTION", "BELONGS_TO_SECTION", "BELONGS_TO_CHAPTER", "BELONGS_TO_PART"]
    found = match_paths(edges, types, 1, hops, starts=articles)
    named = found.join(nodes.select(F.col("id").alias("goal"), "label", "name"), "goal")
    best = named.groupBy(F.col("start").alias("id"), "label").agg(F.min(F.struct("hops", "name")).alias("best"))
    return best.select("id", "label", F.col("best.name").alias("name"), F.col("best.hops").alias("hops"))
