"""Graph construction: edges derived with joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.traversal import numbered
from weftgraph.session import dealt

# Edge types and the labels of their ends.
EDGE_LABELS = (
    ("HAS_CHAPTER", "Part", "Chapter"), ("HAS_SECTION", "Chapter", "Section"), ("HAS_SUBSECTION", "Section", "Subsection"),
    ("BELONGS_TO_SUBSECTION", "Article", "Subsection"), ("BELONGS_TO_SECTION", "Article", "Section"), ("BELONGS_TO_CHAPTER", "Article", "Chapter"),
    ("HAS_CLAUSE", "Article", "Clause"), ("HAS_POINT", "Clause", "ClausePoint"), ("REFERENCES", "Article", "Article"),
    ("REFERENCED_BY", "Article", "Article"), ("NEXT_ARTICLE", "Article", "Article"),
)
COUNTED_LABELS = ("Part", "Chapter", "Section", "Subsection", "Article", "Clause", "ClausePoint", "Community")


def containment_edges(children: DataFrame, parent: str, child: str, position: str, kind: str) -> DataFrame:
    """parent -> child with a 1-based ``ord`` by first appearance, ties by child.
    Children are numbered in ranges, so a parent may have any number of them."""
    firsts = children.groupBy(F.col(parent).alias("src"), F.col(child).alias("dst")).agg(F.min(position).alias("_at"))
    placed = numbered(firsts, ["src"], ["_at", "dst"], "_n")
    return placed.select("src", "dst", F.lit(kind).alias("type"), (F.col("_n") + 1).cast("long").alias("ord"))


def belongs_edges(articles: DataFrame, article: str, parent: str, parent_kind: str) -> DataFrame:
    """article -> parent.  A part as parent is written as a subsection edge, as
    the reference behaviour has it, with the true level beside it."""
    kind = F.col(parent_kind)
    name = F.when(kind == "chapter", "BELONGS_TO_CHAPTER").when(kind == "section", "BELONGS_TO_SECTION").otherwise("BELONGS_TO_SUBSECTION")
    return articles.where(F.col(parent).isNotNull()).select(F.col(article).alias("src"), F.col(parent).alias("dst"), name.alias("type"), kind.alias("level"))


def upward_edges(children: DataFrame, child: str, parent: str, kind: str) -> DataFrame:
    return children.where(F.col(parent).isNotNull()).select(F.col(child).alias("src"), F.col(parent).alias("dst"), F.lit(kind).alias("type")).distinct()


def nested_edges(owners: DataFrame, owner: str, items: Column, kind: str) -> DataFrame:
    """owner -> each item of an array, ``ord`` being its place from 1."""
    return owners.select(F.col(owner).alias("src"), F.posexplode(items).alias("_i", "dst")).select("src", "dst", F.lit(kind).alias("type"), (F.col("_i") + 1).cast("long").alias("ord"))


def next_edges(articles: DataFrame, article: str, number: str, parent: str, width: int = 100_000) -> DataFrame:
    """Each article -> the next by number; ``same_context``: equal parents.

    Numbers are cut into ranges that are sorted apart; the last of each range
    meets the first of the next one in a table of one row a range.
    """
    rows = articles.select(F.col(article).alias("id"), F.col(number).cast("long").alias("n"), F.col(parent).alias("p")).withColumn("r", F.floor(F.col("n") / width))
    inside = W.partitionBy("r").orderBy("n", "id")
    linked = rows.withColumns({"to": F.lead("id").over(inside), "to_p": F.lead("p").over(inside), "more": F.lead("n").over(inside).isNotNull()})
    heads = rows.groupBy("r").agg(F.min_by(F.struct("id", "p"), F.struct("n", "id")).alias("h"))
    steps = heads.withColumn("next", F.lead("h").over(W.orderBy("r"))).select("r", "next")  # one row a range
    ends = linked.where(~F.col("more")).join(steps, "r").where("next is not null").select("id", "p", F.col("next.id").alias("to"), F.col("next.p").alias("to_p"))
    both = linked.where("more").select("id", "p", "to", "to_p").union(ends)
    return both.select(F.col("id").alias("src"), F.col("to").alias("dst"), F.lit("NEXT_ARTICLE").alias("type"), F.coalesce(F.col("p").eqNullSafe(F.col("to_p")), F.lit(False)).alias("same_context"))


def reference_edges(articles: DataFrame, article: str, numbers: Column, content: str, existing: DataFrame) -> DataFrame:
    """REFERENCES to those numbers that exist, and the reverse edges.

    ``existing``: id, number.  Self references are kept.
    """
    wanted = articles.select(F.col(article).alias("src"), F.substring(content, 1, 100).alias("context"), F.explode(numbers).alias("n"))
    found = wanted.join(existing.select(F.col("id").alias("dst"), F.col("number").alias("n")), "n")
    forth = found.select("src", "dst", F.lit("REFERENCES").alias("type"), "context", F.concat(F.lit("Điều "), F.col("n")).alias("reference_text"), F.lit(1.0).alias("strength"))
    none = F.lit(None)
    back = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("REFERENCED_BY").alias("type"), none.cast("string").alias("context"), none.cast("string").alias("reference_text"), none.cast("double").alias("strength"))
    return forth.union(back)


def community_edges(reports: DataFrame) -> DataFrame:
    return reports.where("level = 1 and parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"))


def article_community_edges(articles: DataFrame, sections: DataFrame, subsections: DataFrame, known: DataFrame) -> DataFrame:
    """article -> the community of its chapter; only ids in ``known``, which
    holds communities and chapters alike."""
    up = articles.join(subsections.select(F.col("id").alias("parent_id"), F.col("section_id").alias("sub_section")), "parent_id", "left")
    up = up.withColumn("section_id", F.coalesce("sub_section", F.when(F.col("parent_kind") == "section", F.col("parent_id"))))
    up = up.join(sections.select(F.col("id").alias("section_id"), "chapter_id"), "section_id", "left")
    up = up.withColumn("dst", F.coalesce("chapter_id", F.when(F.col("parent_kind") == "chapter", F.col("parent_id"))))
    return up.join(known.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("id").alias("src"), "dst", F.lit("BELONGS_TO_COMMUNITY").alias("type"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, n): nodes by label, and edges by type between their declared labels
    (``edge:`` before the type); zeros are kept."""
    spark = nodes.sparkSession
    labels = spark.createDataFrame([(x,) for x in COUNTED_LABELS], "key string")
    counted = nodes.groupBy(F.col("label").alias("key")).agg(F.count("*").alias("c"))
    per_label = labels.join(counted, "key", "left")
    rules = spark.createDataFrame(list(EDGE_LABELS), "type string, src_label string, dst_label string")
    typed = edges.select("src", "dst", "type").join(F.broadcast(rules), "type")  # eleven rows
    ends = nodes.select("id", "label")
    typed = typed.join(ends.toDF("src", "src_label"), ["src", "src_label"], "left_semi").join(ends.toDF("dst", "dst_label"), ["dst", "dst_label"], "left_semi")
    per_type = rules.select("type").join(typed.groupBy("type").agg(F.count("*").alias("c")), "type", "left").select(F.concat(F.lit("edge:"), "type").alias("key"), "c")
    return per_label.union(per_type).select("key", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def graph_totals(stats: DataFrame, stored_nodes: int = 0, stored_edges: int = 0) -> DataFrame:
    """Sums over stats; a stored total of 0 is computed anew."""
    edge = F.startswith("key", F.lit("edge:"))
    total = lambda stored, pick: F.lit(stored).cast("long") if stored else F.coalesce(F.sum(F.when(pick, F.col("n"))), F.lit(0)).cast("long")
    return stats.agg(F.sum("n").alias("_"), total(stored_nodes, ~edge).alias("nodes"), total(stored_edges, edge).alias("edges")).select("nodes", "edges")


def entity_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected reference graph between known nodes, without loops; of several
    edges between two nodes the first (by ``ord``) stays, as it is directed."""
    known = nodes.select("id").distinct()
    kept = edges.where("src <> dst").join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi")
    first = F.min_by(F.struct("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight")), F.struct("ord", "src", "dst")).alias("e")
    return kept.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(first).select("e.src", "e.dst", "e.weight")


def upsert_nodes(stored: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """New nodes are added; of known ones, columns of the batch that aren't null
    take the place of the stored ones.  Where a batch has a key several times,
    its rows are applied in the order of its column ``ord`` (ties by value)."""
    others = [c for c in stored.columns if c != key]
    old = stored.select(F.col(key), F.struct(*others).alias("old"))
    at = F.col("ord") if "ord" in batch.columns else F.lit(0)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(at, F.col(c)))).alias(c) for c in others]
    new = batch.groupBy(key).agg(*last).select(F.col(key), F.struct(*others).alias("new"))
    return old.join(new, key, "full_outer").select(key, *[F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in others])


#: Far ends of edges that are sent to every task at most.
FEW_ENDS = 100_000


def merge_edges(stored: DataFrame, batch: DataFrame, nodes: DataFrame, props: list[str]) -> DataFrame:
    """One edge for each pair and type: properties of the later ones win, where
    they aren't null.  Edges without a type or with an unknown end are skipped.

    Edges are dealt to tasks by their number.  Distinct far ends are looked up
    first: many edges may lead to a few nodes, and up to ``FEW_ENDS`` of them are
    sent to every task, so that no task gets all edges of one.
    """
    known = nodes.select("id").where("id is not null").distinct()
    rows = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1))).where("type is not null and src is not null and dst is not null")
    number = rows.count()
    ends = rows.select("dst").distinct().join(known.toDF("dst"), "dst", "left_semi")
    few = ends.limit(FEW_ENDS + 1).count() <= FEW_ENDS
    kept = rows.join(F.broadcast(ends) if few else dealt(ends, number, "dst"), "dst", "left_semi")
    order = F.struct("_new", "ord")
    latest = [F.max_by(F.col(p), F.when(F.col(p).isNotNull(), order)).alias(p) for p in props]
    # An inner join with distinct ids: a semi join would be moved in front of the dealing.
    near = dealt(kept, number, "src").join(dealt(known.toDF("src"), number, "src"), "src")
    return near.groupBy("src", "dst", "type").agg(*latest)


def insertable_edges(batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a batch whose ends exist with the labels that their type asks
    for; of an unknown type any labels will do.  ``nodes``: id, label.  Edges with
    a null end or type are left out, repeated ones stay, as an insert adds."""
    ends = nodes.select("id", "label").distinct()
    labelled = edge_end_labels(batch if "level" in batch.columns else batch.withColumn("level", F.lit(None).cast("string"))).where("type is not null")
    fits = lambda side: F.col(f"{side}_label").isNull() | (F.col(f"{side}_label") == F.col("l"))
    both = labelled.join(ends.toDF("s", "l"), (F.col("src") == F.col("s")) & fits("from"), "left_semi").join(ends.toDF("t", "l"), (F.col("dst") == F.col("t")) & fits("to"), "left_semi")
    return both.select(batch.columns)


def edge_end_labels(edges: DataFrame) -> DataFrame:
    """Labels of an edge's ends by its type; BELONGS_TO by its level."""
    types = F.create_map(*[x for t, a, b in EDGE_LABELS for x in (F.lit(t), F.struct(F.lit(a).alias("from_label"), F.lit(b).alias("to_label")))])
    level = F.initcap(F.coalesce("level", F.lit("chapter")))
    ends = F.when(F.col("type") == "BELONGS_TO", F.struct(F.lit("Article").alias("from_label"), level.alias("to_label"))).otherwise(F.try_element_at(types, F.col("type")))
    return edges.withColumn("_e", ends).select(*edges.columns, F.col("_e.from_label").alias("from_label"), F.col("_e.to_label").alias("to_label"))


def pending(rows: DataFrame, stored_ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id isn't stored yet, for an idempotent, resumable append."""
    return rows.join(stored_ids.select(key).distinct(), key, "left_anti").select(rows.columns)


def replace_reports(stored: DataFrame, batch: DataFrame, key: str = "community_id") -> DataFrame:
    """Stored reports without those that the batch has anew, and the batch."""
    return stored.join(batch.select(key).distinct(), key, "left_anti").select(stored.columns).unionByName(batch)
