"""Queries of search and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import lexicons as L
from weftgraph.functions import text as T
from weftgraph.functions import vectors as V
from weftgraph.operators import search
from weftgraph.plans import bundle
from weftgraph.plans import standins as S
from weftgraph.plans.catalog_text import LAWS, LAWS_SCHEMA, LAWS_SQL, fixture, with_documents
from weftgraph.plans.registry import query, values

Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("vec_topk", f"SELECT 'article_' || vec_id AS id, {S.COSINE} AS score FROM embeddings e, {Q0} ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, id LIMIT 10")
def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.vector_top_k(S.vectors(spark, d), S.query_vector(spark, d, 0), 10).select("id", "score"), "score")


@query("vec_topk_50", f"SELECT 'article_' || vec_id AS id, {S.COSINE} AS score FROM embeddings e, {Q0} ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, id LIMIT 50")
def vec_topk_50(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.vector_top_k(S.vectors(spark, d), S.query_vector(spark, d, 0), 50).select("id", "score"), "score")


@query("vec_topk_filtered", f"SELECT 'article_' || vec_id AS id, {S.COSINE} AS score FROM embeddings e, {Q0} WHERE label = 1 ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, id LIMIT 10")
def vec_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = search.vector_top_k(S.vectors(spark, d), S.query_vector(spark, d, 0), 10, equal={"label": 1, "id": None})
    return _rounded(found.select("id", "score"), "score")


@query("vec_topk_batch", f"""SELECT query_id, id, round(s, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id)::INTEGER AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")  # fmt: skip
def vec_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    rows = S.vectors(spark, d)
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    return _rounded(search.vector_top_k_batch(rows, queries, 10, id_col="vec_id"), "score")


@query("vector_lookup", "SELECT 'article_' || vec_id AS id, label::BIGINT AS label, len(embedding)::INTEGER AS n FROM embeddings WHERE vec_id = 7")
def vector_lookup(spark: SparkSession, d: str) -> DataFrame:
    return S.vectors(spark, d).where("vec_id = 7").select("id", "label", F.size("vector").alias("n")).limit(1)


SPLIT = f"""hits AS (SELECT CASE WHEN label % 2 = 0 THEN 'article_' || vec_id ELSE 'article_' || (vec_id // 2) || '_clause_' || (vec_id % 5) END AS id, label % 2 AS t,
  list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) * CASE WHEN vec_id % 7 = 0 THEN 100 ELSE 1 END AS score FROM embeddings e, {Q0}),
  arts AS (SELECT * FROM hits WHERE t = 0 ORDER BY score DESC, id LIMIT 60), clauses AS (SELECT * FROM hits WHERE t = 1 ORDER BY score DESC, id LIMIT 60),
  merged AS (SELECT id, CASE WHEN t = 0 THEN 'article' ELSE 'clause' END AS type, s AS score, row_number() OVER (ORDER BY s DESC, t, id) AS rank FROM (SELECT *, CASE WHEN score > 1 THEN least(1.0, score / 100) ELSE score END AS s FROM (SELECT * FROM arts UNION ALL SELECT * FROM clauses)) ORDER BY s DESC, t, id LIMIT 60)"""


def _split_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = S.vectors(spark, d)
    clause = F.concat(F.lit("article_"), F.floor(F.col("vec_id") / 2), F.lit("_clause_"), F.col("vec_id") % 5)
    q = search.literal_vector(S.query_vector(spark, d, 0))
    hits = v.select(F.when(F.col("label") % 2 == 0, F.col("id")).otherwise(clause).alias("id"), (F.col("label") % 2).alias("t"), (V.cosine(F.col("vector"), q) * F.when(F.col("vec_id") % 7 == 0, 100).otherwise(1)).alias("score"))
    top = lambda t: hits.where(F.col("t") == t).orderBy(F.desc("score"), "id").limit(60).select("id", "score")
    return top(0), top(1)


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return search.merged_hits(*_split_hits(spark, d), 60)


@query("vec_merge", f"WITH {SPLIT} SELECT id, type, round(score, 6) AS score, rank::INTEGER AS rank FROM merged")
def vec_merge(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_merged(spark, d).select("id", "type", "score", "rank"), "score")


@query("seed_articles", f"""WITH {SPLIT}, {S.ARTICLES}, o AS (SELECT *, 'article_' || regexp_extract(id, 'article_([0-9]+)', 1) AS a FROM merged),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY rank) AS r FROM o) WHERE r = 1 ORDER BY rank LIMIT 10)
  SELECT a AS article_id, f.id AS matched_entity_id, round(CASE WHEN score = 0 THEN 1.0 ELSE score END, 6) AS score, coalesce(x.part, 'N/A') AS part FROM f LEFT JOIN articles x ON x.id = a""")  # fmt: skip
def seed_articles(spark: SparkSession, d: str) -> DataFrame:
    hits = _merged(spark, d).withColumn("title", F.lit("untitled"))
    return _rounded(search.seed_articles(hits, S.articles(spark, d), 10).select("article_id", "matched_entity_id", "score", "part"), "score")


@query("seed_clauses", f"WITH {SPLIT} SELECT id, string_split(id, '_clause_')[1] AS article_id, regexp_extract(id, '_clause_([0-9]+)', 1)::BIGINT AS clause_number FROM merged WHERE contains(id, '_clause_') ORDER BY rank LIMIT 10")
def seed_clauses(spark: SparkSession, d: str) -> DataFrame:
    return search.seed_clauses(_merged(spark, d), 10).select("id", "article_id", "clause_number")


@query("vec_debug", "SELECT vec_id, distance FROM (SELECT vec_id, coalesce(CASE WHEN vec_id % 3 > 0 THEN (vec_id % 11)::DOUBLE END, 0) AS distance, label % 2 AS t FROM embeddings) ORDER BY distance, t, vec_id LIMIT 30")
def vec_debug(spark: SparkSession, d: str) -> DataFrame:
    rows = S.vectors(spark, d).select("vec_id", F.when(F.col("vec_id") % 3 > 0, (F.col("vec_id") % 11).cast("double")).alias("distance"), F.col("vec_id").alias("ord"), (F.col("label") % 2).alias("p"))
    return search.by_distance(rows.where("p = 0").drop("p"), rows.where("p = 1").drop("p"), 30).select("vec_id", "distance")


@query("vec_score", "SELECT vec_id, 1 - (vec_id % 11) / 11.0::DOUBLE AS score FROM embeddings")
def vec_score(spark: SparkSession, d: str) -> DataFrame:
    return S.vectors(spark, d).select("vec_id", search.score_of_distance((F.col("vec_id") % 11) / F.lit(11.0)).alias("score"))


@query("vec_validate", "SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'length' END AS problem FROM embeddings")
def vec_validate(spark: SparkSession, d: str) -> DataFrame:
    return S.vectors(spark, d).select("vec_id", V.problem(F.col("vector"), 64).alias("problem"))


@query("l2_normalize", "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.vectors(spark, d).select("vec_id", V.l2_normalized(F.col("vector"))[0].alias("first")), "first")


KW = "the idiot with the tion worthless of"


def _score(least: int) -> str:
    return " + ".join(f"CASE WHEN contains(lower(x), '{w}') THEN 1 ELSE 0 END" for w in T.query_tokens(KW, least))


@query("kw_search", f"WITH {S.ARTICLES} SELECT id, score::BIGINT AS score FROM (SELECT id, number, {_score(2)} AS score FROM (SELECT *, text AS x FROM articles)) WHERE score > 0 ORDER BY score DESC, number LIMIT 50")
def kw_search(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword_search(S.articles(spark, d), KW, F.col("text"), "number", 50).select("id", "score")


@query("kw_seeds", f"WITH {S.ARTICLES} SELECT id, score::BIGINT AS score FROM (SELECT id, number, {_score(3)} AS score FROM (SELECT *, title || ' ' || text AS x FROM articles)) WHERE score > 0 ORDER BY score DESC, number LIMIT 5")
def kw_seeds(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword_search(S.articles(spark, d), KW, F.concat_ws(" ", "title", "text"), "number", 5, least=3).select("id", "score")


FOLD = "lower(strip_accents(replace(replace({}, 'đ', 'd'), 'Đ', 'D')))"
TOKENS = "[w for w in regexp_split_to_array({}, '[^\\p{{L}}\\p{{N}}]+') if length(w) > 1 AND NOT list_contains(" + str(list(L.FOLDED_STOPS)) + ", w)]"


def _bm25_sql(items: str) -> str:
    return f"""d AS (SELECT doc_id AS id, {TOKENS.format(FOLD.format("text"))} AS tokens FROM documents), n AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM d),
  q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS.format(FOLD.format("text"))})) AS term FROM {items}),
  tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(tokens) AS len, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  scores AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), n GROUP BY 1, 2)"""


def _bm25(spark: SparkSession, d: str, items: DataFrame) -> DataFrame:
    docs = S.table(spark, d, "documents").select("doc_id", search.bm25_tokens(T.folded("text")).alias("tokens"))
    queries = items.select(F.col("item_id").alias("query_id"), search.bm25_tokens(T.folded("text")).alias("tokens"))
    return search.bm25(docs, queries, "doc_id")


@query("bm25", f"WITH {_bm25_sql('benchmark WHERE item_id % 10 = 0')} SELECT query_id, id, round(score, 6) AS score FROM scores")
def bm25(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_bm25(spark, d, S.table(spark, d, "benchmark").where("item_id % 10 = 0")), "score")


@query("bm25_ranking", f"WITH {_bm25_sql('benchmark')} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM scores QUALIFY rank <= 10")
def bm25_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The best documents of every benchmark item."""
    return search.ranked(_bm25(spark, d, S.table(spark, d, "benchmark")), 10).select("query_id", "id", "rank")


@query("concepts", f"""WITH t AS (SELECT id, row_number() OVER (ORDER BY length(text) DESC, id) AS rank, title, text FROM (SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, text FROM documents ORDER BY length(text) DESC, doc_id LIMIT 10)
    UNION ALL SELECT -id, -id, title, text FROM (VALUES {values(LAWS)}) v(id, title, text)), k AS (SELECT * FROM (VALUES {values((i, w) for i, w in enumerate(L.LEGAL_TERMS))}) v(i, w)),
  x AS (SELECT rank, w, row_number() OVER (PARTITION BY id ORDER BY k.i) - 1 AS i FROM t JOIN k ON contains(lower(title || ' ' || text), w)), f AS (SELECT w, min(rank * 100 + i) AS place FROM x GROUP BY w ORDER BY place, w LIMIT 10)
  SELECT 'concept_' || replace(w, ' ', '_') AS id, w AS name, CASE WHEN contains(w, 'người') OR contains(w, 'cá nhân') THEN 'person' WHEN contains(w, 'tài sản') OR contains(w, 'sở hữu') THEN 'property'
    WHEN contains(w, 'hợp đồng') THEN 'contract' WHEN contains(w, 'thừa kế') THEN 'inheritance' WHEN contains(w, 'bồi thường') OR contains(w, 'thiệt hại') THEN 'tort' ELSE 'other' END AS category, (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM t) AS source_articles FROM f""")  # fmt: skip
def concepts(spark: SparkSession, d: str) -> DataFrame:
    """Of the ten longest documents and the written laws, which rank in front."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("id"), F.split("text", "\n", 2)[0].alias("title"), "text").orderBy(F.desc(F.length("text")), "id").limit(10)
    ranked = docs.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.length("text")), "id")).cast("long"))
    laws = fixture(spark, LAWS, LAWS_SCHEMA).select((-F.col("id")).alias("id"), "title", "text", (-F.col("id")).alias("rank"))
    rows = ranked.unionByName(laws).select("id", "rank", T.keywords(F.col("title"), F.col("text")).alias("keywords"))
    return search.concepts(rows).select("id", "name", "category", "source_articles")


@query("concept_relevance", "WITH w AS (SELECT doc_id AS id, unnest(range(len(string_split(string_split(text, chr(10))[1], ' ')))) AS i FROM documents) SELECT id, i::INTEGER AS i, round(1 - 0.1 * i, 6)::DOUBLE AS relevance FROM w")
def concept_relevance(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split(F.split("text", "\n", 2)[0], " ").alias("names"))
    return _rounded(search.concept_relevance(rows, "names").select("id", "i", "relevance"), "relevance")


@query("entity_tags", f"{LAWS_SQL} SELECT id::BIGINT AS id, type, keyword, c::DOUBLE AS confidence FROM t JOIN (VALUES {values((k, c, w) for k, c, ws in L.ENTITY_KEYWORDS for w in ws)}) v(type, c, keyword) ON contains(lower(text), keyword)")
def entity_tags(spark: SparkSession, d: str) -> DataFrame:
    return search.entity_tags(with_documents(spark, d, LAWS, LAWS_SCHEMA), "id", F.col("text"))


@query("suggestions", f"SELECT ord::BIGINT AS ord, text FROM (SELECT * FROM (VALUES {values(enumerate(L.SUGGESTIONS))}) v(ord, text) UNION ALL SELECT 1000 + item_id, text FROM benchmark) t WHERE contains(lower(text), 'tài sản') ORDER BY ord LIMIT 5")
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, list(enumerate(L.SUGGESTIONS)), "ord long, text string").union(S.table(spark, d, "benchmark").select((F.col("item_id") + 1000).cast("long"), "text"))
    return search.suggestions(rows, "text", "tài sản")


@query("linked_articles", f"{S.GRAPH} SELECT dst AS id, min(ord)::BIGINT AS ord FROM edges WHERE type = 'REFERENCES' AND src IN ('article_1', 'article_2', 'article_4') AND dst NOT IN ('article_1', 'article_2') GROUP BY dst ORDER BY 2, 1 LIMIT 8")
def linked_articles(spark: SparkSession, d: str) -> DataFrame:
    paths = S.edges(spark, d).where("type = 'REFERENCES' and src in ('article_1', 'article_2', 'article_4')").select(F.col("dst").alias("id"), "ord")
    return search.linked_articles(paths, spark.createDataFrame([("article_1",), ("article_2",)], "id string"))


@query("observation_graph", """WITH n AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem), shown AS (SELECT p_partkey FROM part WHERE p_size % 2 = 0)
  SELECT DISTINCT src, dst FROM n WHERE src IN (SELECT * FROM shown) AND dst IN (SELECT * FROM shown)""")  # fmt: skip
def observation_graph(spark: SparkSession, d: str) -> DataFrame:
    """Orders as paths over their parts, of which those of an even size are shown."""
    lines = S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("path"))
    return search.observation_edges(lines.select("path"), S.table(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("id")))


@query("get_article", f"WITH {S.ARTICLES} SELECT id, part FROM articles WHERE number = 25")
def get_article(spark: SparkSession, d: str) -> DataFrame:
    return S.articles(spark, d).where("number = 25").select("id", "part").limit(1)


@query("community_context", "SELECT c_custkey, n_name AS chapter_name, r_name AS part_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def community_context(spark: SparkSession, d: str) -> DataFrame:
    a = S.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("section_id"))
    n = S.table(spark, d, "nation")
    sections = n.select(F.col("n_nationkey").alias("section_id"), F.col("n_nationkey").alias("chapter_id"))
    chapters = n.select(F.col("n_nationkey").alias("chapter_id"), F.col("n_name").alias("chapter_name"), F.col("n_regionkey").alias("part_id"))
    parts = S.table(spark, d, "region").select(F.col("r_regionkey").alias("part_id"), F.col("r_name").alias("part_name"))
    return search.community_context(a, sections, chapters, parts).select("c_custkey", "chapter_name", "part_name")


_SAID = "CASE doc_id % 4 WHEN 0 THEN 'Phần thứ nhất > Chương II: x' || chr(10) || 'Tiểu mục 3' WHEN 1 THEN 'CHƯƠNG V tài sản' || chr(10) || text ELSE text END"
_FIND = "nullif(regexp_extract({}, '(?i){}\\s+([^>\\n\\r]+)', 1), '')".format


@query("community_contexts", f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'doc_' ELSE 'article_' END || doc_id AS article_id, doc_id % 5 AS level, CASE WHEN doc_id % 5 < 4 THEN doc_id % 5 ELSE 1 END AS lvl, {_SAID} AS said, doc_id % 10 <> 9 AND doc_id % 7 > 0 AND (doc_id % 5 < 4 OR doc_id % 2 = 0) AS ok, doc_id % 3 = 0 AS mapped, lang, source FROM documents),
  f AS (SELECT *, {_FIND("said", "phần")} AS p, {_FIND("said", "chương")} AS c, {_FIND("said", "mục")} AS s, {_FIND("said", "tiểu mục")} AS b FROM r)
  SELECT article_id, level::INTEGER AS level, CASE WHEN NOT ok THEN '' WHEN mapped THEN CASE WHEN lvl = 0 THEN lang ELSE '' END ELSE coalesce(p, 'QUY ĐỊNH CHUNG') END AS part, CASE WHEN NOT ok THEN '' WHEN mapped THEN CASE WHEN lvl = 1 THEN lang ELSE '' END ELSE coalesce(c, 'NHỮNG QUY ĐỊNH CHUNG') END AS chapter,
    CASE WHEN ok AND NOT mapped THEN s END AS section, CASE WHEN ok AND NOT mapped THEN b END AS subsection, CASE WHEN NOT ok THEN 0 WHEN mapped THEN doc_id % 4 ELSE 1 END::INTEGER AS articles, CASE WHEN NOT ok THEN '' WHEN mapped THEN 'sum' ELSE left(said, 1000) END AS principles,
    CASE WHEN NOT ok THEN '' WHEN mapped THEN lang || ' > ' || coalesce(source, '') ELSE concat_ws(' > ', p, c, s, b) END AS path FROM f""")  # fmt: skip
def community_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as articles, each asked for at some level, with answers of both kinds."""
    k = F.col("doc_id")
    docs = S.table(spark, d, "documents")
    wrong = F.when(k % 10 == 9, F.concat(F.lit("doc_"), k)).otherwise(F.concat(F.lit("article_"), k))
    said = F.when(k % 4 == 0, "Phần thứ nhất > Chương II: x\nTiểu mục 3").when(k % 4 == 1, F.concat(F.lit("CHƯƠNG V tài sản\n"), "text")).otherwise(F.col("text"))
    ids = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < k % 4), lambda i: i.cast("string"))
    first = F.struct(F.lit("c").alias("id"), F.col("lang").alias("title"), F.lit("sum").alias("summary"), ids.alias("entity_ids"))
    second = F.struct(F.lit("d").alias("id"), F.col("source").alias("title"), F.lit("").alias("summary"), ids.alias("entity_ids"))
    communities = F.when(k % 3 == 0, F.array(first, second))
    level = F.when(k % 5 < 4, k % 5).when(k % 2 == 0, 1).otherwise(3)  # of some that ask for level 4 there is an answer at level 1
    answers = docs.select(wrong.alias("article_id"), level.alias("level"), said.alias("response"), communities.alias("communities"))
    found = search.community_contexts(docs.select(wrong.alias("article_id"), (k % 5).cast("int").alias("level")), docs.where("doc_id % 7 > 0").select(wrong.alias("id")), answers)
    return found.select("article_id", "level", *[F.col(f"context.{x}.name").alias(x) for x in ("part", "chapter", "section", "subsection")], F.col("context.article_count").alias("articles"), F.col("context.principles").alias("principles"), F.col("context.hierarchical_context").alias("path"))


@query("hybrid_local")
def hybrid_local(spark: SparkSession, d: str) -> DataFrame:
    v = S.vectors(spark, d)
    clauses = v.where("label % 2 = 1").withColumn("id", F.concat("id", F.lit("_clause_1")))
    return bundle.hybrid_local(S.articles(spark, d), v.where("label % 2 = 0"), clauses, S.edges(spark, d), S.query_vector(spark, d, 0), KW)


@query("hybrid_global", f"SELECT 'report_' || vec_id AS id, {S.COSINE} AS score, 2 AS findings FROM embeddings e, {Q0} ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, id LIMIT 3")
def hybrid_global(spark: SparkSession, d: str) -> DataFrame:
    reports = S.vectors(spark, d, "report_").withColumns({"title": F.lit("t"), "findings": F.lit("a\nb")})
    return _rounded(bundle.hybrid_global(reports, S.query_vector(spark, d, 0)).select("id", "score", F.size("findings").alias("findings")), "score")
