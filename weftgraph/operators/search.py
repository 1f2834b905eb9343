"""Search and retrieval: vectors, keywords, BM25 and seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import lexicons as L
from weftgraph.functions import text as T
from weftgraph.functions import vectors as V
from weftgraph.operators import nearest


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def vector_top_k(rows: DataFrame, query: list[float], k: int, id_col: str = "id", vector: str = "vector", equal: dict[str, object] | None = None) -> DataFrame:
    """The ``k`` rows of greatest cosine, ties by id; null values of ``equal``
    filter nothing.  Exact: each task keeps its own ``k``."""
    for column, value in (equal or {}).items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows.withColumn("score", V.cosine(F.col(vector), literal_vector(query))).orderBy(F.desc("score"), id_col).limit(k)


def vector_top_k_batch(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector: str = "vector", most_queries: int = 10_000) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` nearest rows of each query.

    ``queries`` (query_id, query) are a stated set: blocks of ``most_queries``
    of them, each small enough to send to every task, meet all rows as products
    of matrices; rows that come up to the ``k`` best of a task so far are scored
    as ``vectors.cosine`` does.  Each task ranks its rows for each query first
    (WindowGroupLimit), so ``k`` rows a query and task are shuffled.  Vectors
    without direction, of other lengths or not finite meet row by row.
    """
    named = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    length = asked.agg(F.max(F.size("query"))).first()[0] or 0
    row_ok, query_ok = nearest.usable(F.col("vector"), length), nearest.usable(F.col("query"), length)
    total, odd_queries = asked.agg(F.count("*"), F.count_if(~query_ok)).first()
    size, odd_rows = named.agg(F.count("*"), F.count_if(~row_ok)).first()
    usual = asked.where(query_ok)
    kind = asked.schema["query_id"].dataType.simpleString()
    blocks = max(1, -(-total // most_queries))
    pairs = lambda some, part: some.join(F.broadcast(part), F.lit(True)).select("query_id", "id", V.cosine(F.col("vector"), F.col("query")).alias("score"))
    # Equal vectors score alike, so of those that are odd the least ids will do.
    odd = named.where(~row_ok).withColumn("_r", F.row_number().over(W.partitionBy("vector").orderBy("id"))).where(F.col("_r") <= k).drop("_r")
    out = [asked.select("query_id").join(named.select("id"), F.lit(False)).withColumn("score", F.lit(None).cast("double"))]
    for b in range(blocks):
        part = usual.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else usual
        held = part.toArrow()  # ``most_queries`` or about as many
        if held.num_rows:
            tasks = -(-size * held.num_rows // nearest.TASK_PAIRS)
            dealt = named.where(row_ok).repartition(tasks) if tasks > 1 else named.where(row_ok)
            out.append(nearest.near(dealt, held.column("query_id").combine_chunks(), kind, nearest.matrix(held.column("query"), length), k))
            if odd_rows:
                out.append(pairs(odd, part))
    if odd_queries:
        out.append(pairs(named, asked.where(~query_ok)))
    return nearest.ranked(reduce(DataFrame.union, out[1:] or out), k)


def merged_hits(articles: DataFrame, clauses: DataFrame, limit: int) -> DataFrame:
    """Hits of both kinds (id, score), scores above 1 taken as percentages; the
    best ``limit`` with a rank."""
    both = articles.select(F.lit("article").alias("type"), F.lit(0).alias("t"), "id", "score").unionByName(clauses.select(F.lit("clause").alias("type"), F.lit(1).alias("t"), "id", "score"))
    score = F.coalesce("score", F.lit(0.0))
    best = both.withColumn("score", F.when(score > 1, F.least(F.lit(1.0), score / 100)).otherwise(score)).orderBy(F.desc("score"), "t", "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "t", "id"))).drop("t")  # ``limit`` rows


def article_of(entity: Column) -> Column:
    """Article id inside an entity id, or null."""
    found = F.regexp_extract(entity, r"(?i)article_([0-9]+)", 1)
    return F.when(found != "", F.concat(F.lit("article_"), found))


def seed_articles(hits: DataFrame, articles: DataFrame, limit: int) -> DataFrame:
    """First (best) hit of each article, with the article's data.

    ``hits``: id, score, rank, title; ``articles``: id, title, part.  Stored
    titles and parts win unless they are empty or ``N/A``; a score of 0 or none
    is 1.  Ranking comes before the join.
    """
    own = hits.withColumn("article_id", article_of(F.col("id"))).where("article_id is not null")
    first = own.withColumn("_r", F.row_number().over(W.partitionBy("article_id").orderBy("rank"))).where("_r = 1").orderBy("rank").limit(limit)
    stored = articles.select(F.col("id").alias("article_id"), F.col("title").alias("_title"), F.col("part").alias("_part"))
    good = lambda c: F.when(~F.col(c).isin("", "N/A"), F.col(c))
    score = F.when(F.col("score").isNull() | (F.col("score") == 0), F.lit(1.0)).otherwise(F.col("score"))
    return first.join(stored, "article_id", "left").select("article_id", F.col("id").alias("matched_entity_id"), score.alias("score"), F.coalesce(good("_title"), "title").alias("title"), F.coalesce(good("_part"), F.lit("N/A")).alias("part"), "rank")


def seed_clauses(hits: DataFrame, limit: int) -> DataFrame:
    """The first clause hits; the number is the id's, else 1."""
    number = F.coalesce(F.nullif(F.regexp_extract("id", r"_clause_([0-9]+)", 1), F.lit("")).cast("long"), F.lit(1).cast("long"))
    return hits.where(F.contains("id", F.lit("_clause_"))).orderBy("rank").limit(limit).select("id", F.split("id", "_clause_")[0].alias("article_id"), number.alias("clause_number"), "score")


def by_distance(articles: DataFrame, clauses: DataFrame, limit: int) -> DataFrame:
    """Both kinds (id, distance, ord) by distance; none counts as 0."""
    both = articles.withColumn("t", F.lit(0)).unionByName(clauses.withColumn("t", F.lit(1)))
    return both.withColumn("distance", F.coalesce("distance", F.lit(0.0))).orderBy("distance", "t", "ord").limit(limit).drop("t")


def score_of_distance(distance: Column) -> Column:
    return 1 - distance


def keyword_search(rows: DataFrame, query: str, text: Column, order: str, limit: int, least: int = 2) -> DataFrame:
    """Rows that contain words of the query, by how many; ties by ``order``."""
    score = T.keyword_score(text, T.query_tokens(query, least))
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), order).limit(limit)


def bm25_tokens(folded: Column) -> Column:
    """Tokens of folded text: letters and digits, two or more, no stop words."""
    words = F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    return F.filter(words, lambda w: ~w.isin(*L.FOLDED_STOPS))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of every document that shares a term with a query.

    ``docs``: id and ``tokens`` (the title's twice); ``queries``: query_id and
    ``tokens``.  Only terms of the queries are counted beyond document lengths:
    they are a stated set, which bounds the join's small side.  Null tokens are
    none.  Each document also gives one row with an empty term, for the number of documents and their
    mean length, so that all figures come from one shuffle of one scan.
    """
    nothing = F.filter(F.array(F.lit("")), lambda x: F.length(x) > 0)  # without nulls, unlike a cast
    tokens = F.coalesce("tokens", nothing)
    sized = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"), F.size(tokens).alias("len"))
    wanted = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    terms = wanted.select("term").distinct().withColumn("asked", F.lit(True))
    own = F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term")
    found = sized.select("id", "len", own).join(terms, "term", "left").where("asked or term = ''")
    # ``whole`` is no key and ``tf`` is read by all, so that the three share the shuffle.
    counted = found.groupBy("id", "len", "term").agg(F.count("*").alias("tf"), F.bool_or(F.col("term") == "").alias("whole"))
    totals = counted.where("whole").agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("len")) / F.sum("tf")).alias("mean"))
    tf = counted.where("not whole")
    df = tf.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))
    weighted = tf.join(df, "term").crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return weighted.withColumn("s", part).join(wanted, "term").groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def ranked(scores: DataFrame, k: int, id_col: str = "id", digits: int = 9) -> DataFrame:
    """The ``k`` best of each query with their ``rank`` from 1; ties (scores
    equal to ``digits`` places) by id.  Tasks keep their own ``k`` a query first
    (WindowGroupLimit), so no query's scores are gathered in one place."""
    best = W.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), id_col)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def concepts(articles: DataFrame, most: int = 10) -> DataFrame:
    """Keywords of ranked articles in order of first mention: the first ten.

    ``articles``: id, rank, keywords.  ``source_articles`` are all of them.
    """
    all_ids = articles.agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("source_articles"))
    words = articles.select("rank", F.posexplode("keywords").alias("i", "name"))
    firsts = words.groupBy("name").agg(F.min(F.struct("rank", "i")).alias("at")).orderBy("at", "name").limit(most)
    return firsts.select(T.concept_id(F.col("name")).alias("id"), "name", T.concept_category(F.col("name")).alias("category"), "at").crossJoin(F.broadcast(all_ids)).select("id", "name", "category", "source_articles", "at.rank", "at.i")


def article_ids_in(text: Column) -> Column:
    """Distinct numbers after "Điều", case as it is."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"Điều\s+([0-9]+)"), 1), lambda x: x.cast("long")))


def linked_articles(paths: DataFrame, seeds: DataFrame, most: int = 8) -> DataFrame:
    """Path hits (id, ord) that aren't seeds, once each, the first ``most``."""
    return paths.join(seeds.select("id"), "id", "left_anti").groupBy("id").agg(F.min("ord").alias("ord")).orderBy("ord", "id").limit(most)


def linked_reports(reports: DataFrame | None, most: int = 3) -> DataFrame | None:
    """The first reports of a search (id, rank), once each; none if it failed."""
    if reports is None:
        return None
    return reports.groupBy("id").agg(F.min("rank").alias("rank")).orderBy("rank", "id").limit(most)


def observation_edges(paths: DataFrame, shown: DataFrame) -> DataFrame:
    """Distinct consecutive pairs of paths, both ends of which are shown."""
    pair = F.explode(F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("src"), F.slice("path", 2, F.size("path")).alias("dst"))).alias("e")
    edges = paths.where(F.size("path") > 1).select(pair).select("e.src", "e.dst").distinct()
    ids = shown.select("id").distinct()
    return edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select("src", "dst")


def entity_tags(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, type, keyword, confidence) for each keyword that a text contains."""
    entries = [F.struct(F.lit(t).alias("type"), F.lit(w).alias("keyword"), F.lit(c).alias("confidence")) for t, c, words in L.ENTITY_KEYWORDS for w in words]
    lower = F.lower(text)
    found = F.filter(F.array(*entries), lambda e: F.contains(lower, e["keyword"]))
    return rows.select(F.col(id_col).alias("id"), F.explode(found).alias("e")).select("id", "e.*")


def concept_relevance(items: DataFrame, column: str) -> DataFrame:
    return items.select("*", F.posexplode(column).alias("i", "name")).withColumn("relevance", 1 - 0.1 * F.col("i"))


def suggestions(rows: DataFrame, text: str, query: str | None, limit: int = 5, order: str = "ord") -> DataFrame:
    found = rows if not query else rows.where(F.contains(F.lower(F.col(text)), F.lit(query.lower())))
    return found.orderBy(order).limit(limit)


def community_context(articles: DataFrame, sections: DataFrame, chapters: DataFrame, parts: DataFrame) -> DataFrame:
    """Names of the levels above each article, by joins of the hierarchy."""
    return articles.join(sections, "section_id", "left").join(chapters, "chapter_id", "left").join(parts, "part_id", "left")


# Names of levels where a text has none, and lengths of excerpts.
DEFAULT_PART, DEFAULT_CHAPTER = "QUY ĐỊNH CHUNG", "NHỮNG QUY ĐỊNH CHUNG"
SUMMARY_CHARS, PRINCIPLES_CHARS = 500, 1000
LEVEL_NAMES = (("part", "Phần"), ("chapter", "Chương"), ("section", "Mục"), ("subsection", "Tiểu mục"))

_PART = "struct<id:string,name:string,part_number:int,chapter_count:int,article_count:int>"
_CHAPTER = "struct<id:string,name:string,chapter_roman:string,part_id:string,article_count:int,section_count:int,summary:string>"
_LOWER = "struct<id:string,name:string,number:int,parent_id:string,article_count:int>"
CONTEXT = f"struct<part:{_PART},chapter:{_CHAPTER},section:{_LOWER},subsection:{_LOWER},article_count:int,principles:string,hierarchical_context:string>"


def _context(part: Column, chapter: Column, section: Column, subsection: Column, count: Column, principles: Column, path: Column) -> Column:
    named = {"part": part, "chapter": chapter, "section": section, "subsection": subsection, "article_count": count, "principles": principles, "hierarchical_context": path}
    return F.struct(*[c.alias(name) for name, c in named.items()]).cast(CONTEXT)


def _part(id: Column, name: Column, number: int, chapters: int, count: Column) -> Column:
    return F.struct(id, name, F.lit(number), F.lit(chapters), count).cast(_PART)


def _chapter(id: Column, name: Column, roman: str, part: str, count: Column, summary: Column) -> Column:
    return F.struct(id, name, F.lit(roman), F.lit(part), count, F.lit(0), summary).cast(_CHAPTER)


def empty_context() -> Column:
    """The context of an article that isn't known."""
    none, zero = F.lit(""), F.lit(0)
    return _context(_part(none, none, 0, 0, zero), _chapter(none, none, "", "", zero, none), F.lit(None), F.lit(None), zero, none, none)


def mapped_context(communities: Column, level: Column) -> Column:
    """The context from an answer's communities (id, title, summary, entity_ids):
    the first is the part at level 0 and the chapter at level 1; at deeper levels
    both stay empty.  The path has all titles."""
    first = F.get(communities, F.lit(0))
    none, zero = F.lit(""), F.lit(0)
    count = F.coalesce(F.size(first["entity_ids"]), zero)
    count = F.greatest(count, zero)
    part = F.when(level == 0, _part(first["id"], first["title"], 1, 0, count)).otherwise(_part(none, none, 0, 0, zero))
    chapter = F.when(level == 1, _chapter(first["id"], first["title"], "", "", count, first["summary"])).otherwise(_chapter(none, none, "", "", zero, none))
    path = F.array_join(F.transform(communities, lambda c: F.coalesce(c["title"], F.lit(""))), " > ")
    return _context(part, chapter, F.lit(None), F.lit(None), count, F.coalesce(first["summary"], none), path)


def extracted_context(response: Column) -> Column:
    """The context from an answer's text: what follows the first mention of each
    level, up to a line's end or a ``>``.  A part or chapter that isn't named has
    the usual name, a section or subsection is null; the path has those that are
    named.  As "mục" ends "tiểu mục", a section is also found there."""
    text = F.coalesce(response, F.lit(""))
    found = {name: F.nullif(F.regexp_extract(text, rf"(?iu){word}\s+([^>\n\r]+)", 1), F.lit("")) for name, word in LEVEL_NAMES}
    one = F.lit(1)
    part = _part(F.lit("part_1"), F.coalesce(found["part"], F.lit(DEFAULT_PART)), 1, 1, one)
    chapter = _chapter(F.lit("chapter_1"), F.coalesce(found["chapter"], F.lit(DEFAULT_CHAPTER)), "I", "part_1", one, F.substring(text, 1, SUMMARY_CHARS))
    low = lambda name, above: F.when(found[name].isNotNull(), F.struct(F.lit(f"{name}_1"), found[name], one, F.lit(above), one).cast(_LOWER))
    path = F.array_join(F.filter(F.array(*found.values()), lambda x: x.isNotNull()), " > ")
    return _context(part, chapter, low("section", "chapter_1"), low("subsection", "section_1"), one, F.substring(text, 1, PRINCIPLES_CHARS), path)


def community_contexts(requests: DataFrame, articles: DataFrame, answers: DataFrame) -> DataFrame:
    """(article_id, level, context) of each request.

    ``requests``: article_id, level; ``articles``: id; ``answers``: article_id,
    level, response, communities.  A level that isn't 0 to 3 counts as 1.  An id
    that is none, an unknown article, and one without an answer have the empty
    context; an answer's communities come before its text.
    """
    level = F.when(T.valid_level(F.col("level")), F.col("level")).otherwise(1).cast("int")
    asked = requests.select("article_id", F.col("level").alias("asked"), level.alias("level"))
    known = articles.select(F.col("id").alias("article_id"), F.lit(True).alias("known")).distinct()
    found = asked.join(known, "article_id", "left").join(answers.select("article_id", F.col("level").cast("int").alias("level"), "response", "communities", F.lit(True).alias("answered")), ["article_id", "level"], "left")
    usable = T.valid_article_id(F.col("article_id")) & F.coalesce("known", F.lit(False)) & F.coalesce("answered", F.lit(False))
    context = F.when(~usable, empty_context()).when(F.size("communities") > 0, mapped_context(F.col("communities"), F.col("level"))).otherwise(extracted_context(F.col("response")))
    return found.select("article_id", F.col("asked").alias("level"), context.alias("context"))
