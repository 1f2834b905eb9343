"""Reads of the graph: look-ups, joins, grids and sub-graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.traversal import numbered


def nodes_of(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.col("label") == label)


def node(nodes: DataFrame, node_id: object, label: str | None = None, key: str = "id") -> DataFrame:
    """The node with an id (and label, if one is given); one row at most."""
    found = nodes.where(F.col(key) == F.lit(node_id))
    return (found.where(F.col("label") == label) if label else found).limit(1)


def outgoing(edges: DataFrame, src: object, kind: str | None = None) -> DataFrame:
    found = edges.where(F.col("src") == F.lit(src))
    return (found.where(F.col("type") == kind) if kind else found).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def incoming(edges: DataFrame, dst: object, kind: str | None = None) -> DataFrame:
    found = edges.where(F.col("dst") == F.lit(dst))
    return (found.where(F.col("type") == kind) if kind else found).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def full_articles(articles: DataFrame, clauses: DataFrame, points: DataFrame, chapters: DataFrame, parts: DataFrame) -> DataFrame:
    """Articles with nested clauses and points, and the names above them.

    Points are gathered by clause and clauses by article before the parents are
    joined, so no product of them arises.
    """
    by_clause = points.groupBy("clause_id").agg(F.sort_array(F.collect_list(F.struct("letter", "text"))).alias("points"))
    full = clauses.join(by_clause, "clause_id", "left")
    by_article = full.groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("number", "clause_id", "text", F.coalesce("points", F.array().cast("array<struct<letter:string,text:string>>")).alias("points")))).alias("clauses"))
    out = articles.join(by_article, "article_id", "left").join(chapters, "chapter_id", "left").join(parts, "part_id", "left")
    blank = lambda c, name: F.when(F.col(c).isNull() | F.col(c).isin("", "N/A"), F.col(name)).otherwise(F.col(c)).alias(c)
    return out.select("article_id", "title", blank("chapter", "chapter_name"), blank("part", "part_name"), "clauses")


def related(nodes: DataFrame, edges: DataFrame, article: object) -> DataFrame:
    """What an article cites and what cites it; unknown ends are dropped."""
    cites = edges.where((F.col("type") == "REFERENCES") & (F.col("src") == F.lit(article))).select(F.lit("references").alias("relation"), F.col("dst").alias("id"))
    cited = edges.where((F.col("type") == "REFERENCES") & (F.col("dst") == F.lit(article))).select(F.lit("referenced_by").alias("relation"), F.col("src").alias("id"))
    return cites.union(cited).join(nodes, "id")


def relation_grid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with names and labels of both ends; without a node, the id and
    ``Unknown``."""
    named = nodes.select("id", F.coalesce(F.nullif("name", F.lit("")), F.nullif("title", F.lit("")), "id").alias("name"), "label")
    out = edges
    for end in ("src", "dst"):
        out = out.join(named.toDF(end, f"{end}_name", f"{end}_label"), end, "left")
        out = out.withColumns({f"{end}_name": F.coalesce(f"{end}_name", end), f"{end}_label": F.coalesce(f"{end}_label", F.lit("Unknown"))})
    return out.select(*edges.columns, "src_name", "src_label", "dst_name", "dst_label")


def graph_data(edges: DataFrame, order: list[str]) -> DataFrame:
    """Edges other than REFERENCES with ids ``type_i``, i counted in each type."""
    found = numbered(edges.where(F.col("type") != "REFERENCES"), ["type"], order, "_i")
    return found.select(F.concat_ws("_", "type", F.col("_i").cast("string")).alias("id"), "src", "dst", "type")


def visible(edges: DataFrame, shown: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Edges of shown types between shown nodes."""
    ids = shown.select("id").distinct()
    return edges.where(F.col("type").isin(*kinds)).join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select(edges.columns)


def ego_graph(nodes: DataFrame, edges: DataFrame, center: object) -> DataFrame:
    """Nodes on edges that touch ``center``, and itself if it exists."""
    touching = edges.where((F.col("src") == F.lit(center)) | (F.col("dst") == F.lit(center)))
    ids = touching.select(F.explode(F.array("src", "dst")).alias("id")).union(nodes.where(F.col("id") == F.lit(center)).select("id")).distinct()
    alive = nodes.where(F.col("id") == F.lit(center)).select(F.lit(1).alias("_there")).limit(1)
    return nodes.join(ids, "id", "left_semi").crossJoin(F.broadcast(alive)).drop("_there")  # one row at most


def random_article(articles: DataFrame, edges: DataFrame, chapter: str, seed: int = 0) -> DataFrame:
    """An article of a chapter whose id holds a text; hash order for a seed."""
    inside = edges.where(F.startswith("type", F.lit("BELONGS_TO")) & F.contains("dst", F.lit(chapter))).select(F.col("src").alias("id"))
    return articles.join(inside, "id", "left_semi").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(1)


def chunk_grid(articles: DataFrame, clauses: DataFrame) -> DataFrame:
    """Articles and clauses as one grid; a clause without its article has the
    title ``N/A``.  Articles come first by number, then clauses."""
    none = F.lit(None).cast("long")
    top = articles.select("article_id", "number", none.alias("clause_number"), "title", F.lit("article").alias("kind"), "text")
    low = clauses.join(articles.select("article_id", "title"), "article_id", "left").select("article_id", none.alias("number"), F.col("number").alias("clause_number"), F.coalesce("title", F.lit("N/A")).alias("title"), F.lit("clause").alias("kind"), "text")
    return top.unionByName(low)


def chunk_order() -> list[Column]:
    return [F.col("kind"), F.col("number"), F.col("article_id"), F.col("clause_number")]


def search_filter(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which some column contains the text, in any case; a blank text
    filters nothing."""
    if not text.strip():
        return rows
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    return rows.where(found)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page by a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def paged(rows: DataFrame, order: list[Column | str], size: int) -> DataFrame:
    """All rows with their ``page`` from 1 and ``place`` in it from 0, by a total
    order: what fetching page after page gives.  Rows are numbered in ranges, so
    no task sorts all of them."""
    placed = numbered(rows, [], order, "_n")
    return placed.select(*rows.columns, (F.floor(F.col("_n") / size) + 1).cast("long").alias("page"), (F.col("_n") % size).cast("long").alias("place"))


def page_info(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("pages"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends at each node; a loop counts twice, nodes without edges 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def counts_of(rows: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Rows by value, for the known values only, zeros included."""
    names = rows.sparkSession.createDataFrame([(k,) for k in known], f"{column} string")
    return names.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def most_linked(edges: DataFrame, end: str, kind: str, top: int = 5) -> DataFrame:
    found = edges.where(F.col("type") == kind).groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "id").limit(top)


def covered_chunks(edges: DataFrame, clauses: DataFrame, community: object) -> DataFrame:
    out = edges.where((F.col("type") == "COVERS_CLAUSE") & (F.col("src") == F.lit(community))).select(F.col("dst").alias("clause_id"))
    return out.join(clauses, "clause_id")


def active_communities(communities: DataFrame, runs: DataFrame) -> DataFrame:
    """Communities of the scope's latest run, and those without a run; all of
    them where a scope has no run."""
    latest = runs.groupBy("scope").agg(F.max_by("run_id", F.struct("activated_at", "run_id")).alias("active"))
    joined = communities.join(latest, "scope", "left")
    return joined.where("active is null or run_id is null or run_id = '' or run_id = active").select(communities.columns)


def collated(rows: DataFrame, columns: list[str], locale: str = "vi") -> DataFrame:
    """Text columns typed with a locale's collation: whatever sorts, pages, groups
    or joins them after this follows it, without being told again."""
    return rows.withColumns({c: F.collate(F.col(c), locale) for c in columns})


def relation_page(relations: DataFrame, labels: DataFrame, number: int, size: int, locale: str = "vi") -> DataFrame:
    """A page of relations (src, dst, type) by type and then by the label of the
    source, both in a locale's order; equal ones by src and dst.  ``labels``: id,
    label; a source without one has its id."""
    named = relations.join(labels.select(F.col("id").alias("src"), "label"), "src", "left").select("src", "dst", "type", F.coalesce("label", "src").alias("label"))
    return page(collated(named, ["type", "label"], locale), ["type", "label", "src", "dst"], number, size)
