"""A store of nodes, edges and vectors that grows by files of articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import graph, parsing
from weftgraph.sources import corpus

MANIFEST = "manifest.json"


class StoreLocked(RuntimeError):
    """The store has a manifest: its index is sealed."""


class ProgressAhead(RuntimeError):
    """Progress names ids that the store doesn't have."""


def resumed(rows: DataFrame, stored: DataFrame, progress: DataFrame) -> DataFrame:
    """Rows (kind, id, …) that are yet to be stored.

    ``stored`` and ``progress`` hold (kind, id).  If progress names what isn't
    stored the work can't be taken up again, and nothing is written.
    """
    missing = progress.select("kind", "id").join(stored.select("kind", "id"), ["kind", "id"], "left_anti")
    counted = missing.agg(F.count("*").alias("n"), F.min(F.struct("kind", "id")).alias("first")).first()
    if counted["n"]:
        raise ProgressAhead(f"progress lists {counted['n']} ids that the store does not contain (first: {counted['first']['id']})")
    return rows.join(stored.select("kind", "id").distinct(), ["kind", "id"], "left_anti").select(rows.columns)


def persist(rows: DataFrame, store: str) -> None:
    """Appends rows (kind, id, …) that the store lacks, then their progress.

    Rows first: a job that is lost between the two finds its rows stored when it
    is run again, and adds their progress only.
    """
    spark = rows.sparkSession
    at, done = f"{store}/vectors", f"{store}/progress"
    known = _table(spark, at, rows)
    corpus.append(resumed(rows, known, _table(spark, done, rows.select("kind", "id"))), at)
    listed = _table(spark, done, rows.select("kind", "id"))
    corpus.append(rows.select("kind", "id").join(listed, ["kind", "id"], "left_anti"), done)


def _table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stored table; an empty one of the same columns if there is none."""
    return spark.read.schema(like.schema).parquet(path) if corpus.exists(spark, path) else spark.createDataFrame([], like.schema)


def upload(spark: SparkSession, store: str, name: str, text: str, embed: Callable[[Column], Column]) -> DataFrame:
    """Adds a file of articles (JSON) to a store; returns the store's statistics
    as ``graph_stats`` gives them.

    A store with a manifest refuses (``StoreLocked``) before anything is
    written.  The file is saved below ``files``; articles, clauses and edges that the store
    hasn't got are added, so the same upload twice changes nothing.
    """
    if corpus.exists(spark, f"{store}/{MANIFEST}"):
        raise StoreLocked(store)
    path = f"{store}/files/{name}"
    corpus.replace_file(spark, path, text)
    content = parsing.normalized_content(F.to_json("content"))
    articles = corpus.scan_file(spark, path).where("article_number is not null")
    articles = parsing.last_of_each(articles.select(F.concat(F.lit("article_"), "article_number").alias("id"), F.col("article_number").alias("number"), "title", content.alias("text"), F.monotonically_increasing_id().alias("ord")), "id", "ord")
    clauses = parsing.split_clauses(articles, "id", "text").select("article_id", F.concat("article_id", F.lit("_clause_"), "number").alias("id"), "number", "place", "text")
    clauses = parsing.last_of_each(clauses, "id", "place")
    none = F.lit(None).cast("string")
    nodes = articles.select("id", F.lit("Article").alias("label"), none.alias("name"), "title").unionByName(clauses.select("id", F.lit("Clause").alias("label"), none.alias("name"), none.alias("title")))
    old = _table(spark, f"{store}/nodes", nodes)
    corpus.append(graph.pending(nodes, old), f"{store}/nodes")
    all_nodes = spark.read.schema(nodes.schema).parquet(f"{store}/nodes")
    existing = all_nodes.where("label = 'Article'").select("id", F.regexp_extract("id", "([0-9]+)$", 1).cast("long").alias("number"))
    ends = ("src", "dst", "type")
    edges = clauses.select(F.col("article_id").alias("src"), F.col("id").alias("dst"), F.lit("HAS_CLAUSE").alias("type"))
    edges = edges.unionByName(graph.reference_edges(articles, "id", T.article_references(F.col("text")), "text", existing).select(*ends))
    edges = edges.unionByName(graph.next_edges(articles.withColumn("parent", none), "id", "number", "parent").select(*ends)).distinct()
    corpus.append(edges.join(_table(spark, f"{store}/edges", edges), list(ends), "left_anti"), f"{store}/edges")
    documents = parsing.embedding_documents(articles, clauses.withColumn("title", F.lit("")), spark.createDataFrame([], "id string, title string, summary string, findings string"))
    template = T.render_template(F.coalesce("title", F.lit("")), F.col("content"))
    persist(documents.select("kind", "id", embed(template).alias("vector")), store)
    return graph.graph_stats(all_nodes, spark.read.schema(edges.schema).parquet(f"{store}/edges"))
