"""The tables of the driver in the shapes that the operators take.

Each shape is given twice: as a DataFrame, and as SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Regions as parts, nations as chapters, customers as articles, suppliers as
    communities."""
    region, nation, customer, supplier = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier"))
    none = F.lit(None).cast("string")
    return (
        region.select(F.concat(F.lit("part_"), "r_regionkey").alias("id"), F.lit("Part").alias("label"), F.col("r_name").alias("name"), none.alias("title"))
        .union(nation.select(F.concat(F.lit("chapter_p"), "n_regionkey", F.lit("_c"), "n_nationkey"), F.lit("Chapter"), "n_name", none))
        .union(customer.select(F.concat(F.lit("article_"), "c_custkey"), F.lit("Article"), none, "c_name"))
        .union(supplier.select(F.concat(F.lit("community_"), "s_suppkey"), F.lit("Community"), F.lit(""), none))
    )


NODES = """nodes AS (
  SELECT 'part_' || r_regionkey AS id, 'Part' AS label, r_name AS name, NULL::VARCHAR AS title FROM region
  UNION ALL SELECT 'chapter_p' || n_regionkey || '_c' || n_nationkey, 'Chapter', n_name, NULL FROM nation
  UNION ALL SELECT 'article_' || c_custkey, 'Article', NULL, c_name FROM customer
  UNION ALL SELECT 'community_' || s_suppkey, 'Community', '', NULL FROM supplier)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """References between the customers of consecutive orders, and the hierarchy."""
    nation, customer, orders = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    chapter = F.concat(F.lit("chapter_p"), "n_regionkey", F.lit("_c"), "n_nationkey")
    article = lambda c: F.concat(F.lit("article_"), c)
    a, b = orders.select("o_orderkey", "o_custkey"), orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("to"))
    refs = a.join(b, "o_orderkey").select(article("o_custkey").alias("src"), article("to").alias("dst"), F.lit("REFERENCES").alias("type"), F.col("o_orderkey").cast("long").alias("ord"), F.when(F.col("o_orderkey") % 3 == 0, 2.0).alias("weight"))
    none = F.lit(None).cast("double")
    has = nation.select(F.concat(F.lit("part_"), "n_regionkey"), chapter, F.lit("HAS_CHAPTER"), F.col("n_nationkey").cast("long"), none)
    belongs = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(article("c_custkey"), chapter, F.lit("BELONGS_TO_CHAPTER"), F.col("c_custkey").cast("long"), none)
    nxt = customer.select("c_custkey").join(customer.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_custkey").alias("to")), "c_custkey").select(article("c_custkey"), article("to"), F.lit("NEXT_ARTICLE"), F.col("c_custkey").cast("long"), none)
    return refs.union(has).union(belongs).union(nxt)


EDGES = """edges AS (
  SELECT 'article_' || a.o_custkey AS src, 'article_' || b.o_custkey AS dst, 'REFERENCES' AS type, a.o_orderkey::BIGINT AS ord,
         CASE WHEN a.o_orderkey % 3 = 0 THEN 2.0::DOUBLE END AS weight
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1
  UNION ALL SELECT 'part_' || n_regionkey, 'chapter_p' || n_regionkey || '_c' || n_nationkey, 'HAS_CHAPTER', n_nationkey, NULL FROM nation
  UNION ALL SELECT 'article_' || c_custkey, 'chapter_p' || n_regionkey || '_c' || n_nationkey, 'BELONGS_TO_CHAPTER', c_custkey, NULL
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'article_' || a.c_custkey, 'article_' || b.c_custkey, 'NEXT_ARTICLE', a.c_custkey, NULL
    FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1)"""
GRAPH = f"WITH {NODES}, {EDGES}"


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as articles: source as part, language as chapter."""
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.lit("article_"), "doc_id").alias("id"), F.col("doc_id").alias("number"), F.element_at(F.split("text", "\n"), 1).alias("title"), "text", F.col("source").alias("part"), F.col("lang").alias("chapter"))


ARTICLES = """articles AS (
  SELECT 'article_' || doc_id AS id, doc_id AS number, string_split(text, chr(10))[1] AS title, text, source AS part, lang AS chapter FROM documents)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as session logs: a first record of the session's own, then
    the turns; a user's turn opens a run, a system's is a step.  Some of the
    assistant's are errors, some answers aren't ok, some first queries are blank."""
    talk = table(spark, d, "conversations")
    failed = (F.col("conv_id") + F.col("turn")) % 7 == 3
    kind = F.when(F.col("role") == "user", "query").when(F.col("role") == "assistant", F.when(failed, "error").otherwise("answer")).otherwise("step")
    run = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(W.partitionBy("conv_id").orderBy("turn"))
    at = lambda seq: F.concat(F.lit("2026-01-01T00:00:"), F.lpad(F.pmod(seq, F.lit(60)).cast("string"), 2, "0"), F.lit(".000Z"))
    seq = F.col("turn").cast("long") + 2
    session = F.concat(F.lit("conv_"), "conv_id").alias("session_id")
    blank = (F.col("role") == "user") & (F.col("turn") < 2) & (F.col("conv_id") % 4 == 1)
    none = F.lit(None).cast("string")
    ok = F.when(kind == "answer", F.col("turn") % 5 != 1)
    trace = F.when(kind == "answer", F.concat(F.lit("trace_"), "turn"))
    turns = talk.select(session, F.concat(F.lit("run_"), run).alias("run_id"), seq.alias("seq"), at(seq).alias("created_at"), kind.alias("kind"), F.when(blank, " \n ").otherwise(F.col("text")).alias("content"), ok.alias("ok"), trace.alias("trace_id"))
    first = talk.select("conv_id").distinct().select(session, none, F.lit(1).cast("long"), at(F.lit(1)), F.lit("session_created"), F.lit(""), F.lit(None).cast("boolean"), none)
    return turns.union(first)


RECORDS = """records AS (
  SELECT *, CASE WHEN kind = 'answer' THEN (seq - 2) % 5 <> 1 END AS ok, CASE WHEN kind = 'answer' THEN 'trace_' || (seq - 2) END AS trace_id FROM (
  SELECT 'conv_' || conv_id AS session_id, 'run_' || sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run_id, turn::BIGINT + 2 AS seq,
         '2026-01-01T00:00:' || lpad(CAST((turn + 2) % 60 AS VARCHAR), 2, '0') || '.000Z' AS created_at,
         CASE role WHEN 'user' THEN 'query' WHEN 'assistant' THEN CASE WHEN (conv_id + turn) % 7 = 3 THEN 'error' ELSE 'answer' END ELSE 'step' END AS kind,
         CASE WHEN role = 'user' AND turn < 2 AND conv_id % 4 = 1 THEN ' ' || chr(10) || ' ' ELSE text END AS content
  FROM conversations
  UNION ALL SELECT DISTINCT 'conv_' || conv_id, NULL, 1, '2026-01-01T00:00:01.000Z', 'session_created', '' FROM conversations))"""


def vectors(spark: SparkSession, d: str, prefix: str = "article_") -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.concat(F.lit(prefix), "vec_id").alias("id"), F.col("vec_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def query_vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    """The vector of one row: what a user's query would be embedded as."""
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
