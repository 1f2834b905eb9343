"""Hybrid retrieval as one composition of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import search, traversal


def hybrid_local(articles: DataFrame, article_vectors: DataFrame, clause_vectors: DataFrame, edges: DataFrame, vector: list[float], query: str, k: int = 3, seeds: int = 5) -> DataFrame:
    """Rows of a bundle (section, id, score, depth): seed articles by vectors,
    then what seeds by keywords cite, then concepts of the seeds' keywords.

    Without a vector hit, articles that the query itself names are the seeds.
    """
    hits = search.merged_hits(search.vector_top_k(article_vectors, vector, 100).select("id", "score"), search.vector_top_k(clause_vectors, vector, 100).select("id", "score"), 100)
    found = search.seed_articles(hits.withColumn("title", F.lit("")), articles, k)
    named = articles.where(F.array_contains(search.article_ids_in(F.lit(query)), F.col("number"))).select(F.col("id").alias("article_id"), F.lit(1.0).alias("score"))
    none = found.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    first = found.select("article_id", "score").union(named.crossJoin(F.broadcast(none)).select("article_id", "score"))  # one row at most
    start = search.keyword_search(articles, query, F.concat_ws(" ", "title", "text"), "number", seeds, least=3).select("id", F.col("number").alias("ord"))
    walked = traversal.traverse_references(start, edges, articles)
    words = articles.join(first.select(F.col("article_id").alias("id"), F.col("score")), "id").select("id", F.col("number").alias("rank"), T.keywords(F.col("title"), F.col("text")).alias("keywords"))
    none_depth = F.lit(None).cast("int")
    return (
        first.select(F.lit("seed").alias("section"), F.col("article_id").alias("id"), "score", none_depth.alias("depth"))
        .union(walked.select(F.lit("path"), "id", F.lit(None).cast("double"), "depth"))
        .union(search.concepts(words).select(F.lit("concept"), "id", F.lit(None).cast("double"), none_depth))
    )


def hybrid_global(reports: DataFrame, vector: list[float], k: int = 3) -> DataFrame:
    """The nearest reports, their findings by lines."""
    top = search.vector_top_k(reports, vector, k)
    return top.select("id", "title", "score", F.split("findings", "\n").alias("findings"))


def consult(query: str, local: DataFrame, global_: DataFrame) -> DataFrame:
    """The routed result; a global one without reports falls back to local."""
    spark = local.sparkSession
    route = spark.range(1).select(T.route_query(F.lit(query)).alias("r")).first()["r"]
    return global_ if route == "global" and not global_.isEmpty() else local
