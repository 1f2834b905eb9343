"""Corpus parsing: hierarchy, clauses, points and texts for embedding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import lexicons as L
from weftgraph.functions import text as T
from weftgraph.operators.traversal import kept

UNSORTED_CHAPTER = "Chương chưa phân loại"


def normalized_content(content: Column) -> Column:
    """JSON content as text: a string as it is, an array's items or an object's
    values by lines, anything else empty."""
    value = F.try_parse_json(content)
    kind = F.schema_of_variant(value)
    items = F.array_join(F.try_variant_get(value, "$", "array<string>"), "\n")
    values = F.array_join(F.map_values(F.try_variant_get(value, "$", "map<string,string>")), "\n")
    return F.coalesce(F.when(F.startswith(kind, F.lit("ARRAY")), items).when(F.startswith(kind, F.lit("OBJECT")), values).when(kind == "STRING", F.try_variant_get(value, "$", "string")), F.lit(""))


def _carried(rows: DataFrame, ordinal: str, groups: list[str], values: dict[str, Column], before: bool = False) -> DataFrame:
    """Adds the last value that isn't null up to each row (``before``: in front
    of it).  Ranges are filled apart; what earlier ones end with comes from a
    table of one row a range and group."""
    inside = W.partitionBy(*groups, "_range").orderBy(ordinal).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    earlier = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.groupBy(*groups, "_range").agg(*[F.max_by(c, F.when(c.isNotNull(), F.col(ordinal))).alias(f"_last_{n}") for n, c in values.items()])
    ends = ends.select(*groups, "_range", *[F.last(f"_last_{n}", ignorenulls=True).over(earlier).alias(f"_last_{n}") for n in values])
    own = rows.withColumns({n: F.last(c, ignorenulls=True).over(inside) for n, c in values.items()})
    same = reduce(Column.__and__, [F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*groups, "_range")])
    return own.alias("i").join(ends.alias("s"), same, "left").select(*[F.col(f"i.{c}") for c in rows.columns], *[F.coalesce(f"i.{n}", f"s._last_{n}").alias(n) for n in values])


def fill_down(articles: DataFrame, ordinal: str, group: list[str] | None = None) -> DataFrame:
    """Carries part, chapter, section and subsection down the articles.

    ``part`` and ``chapter`` are cleaned names or null; ``section`` and
    ``subsection`` are null where a row hasn't the key, and may be empty.  A new
    part resets the chapter and, like a new chapter, section and subsection; a
    row's own values count after the reset.  ``group`` splits the corpus into
    documents that are filled apart.  Ranges of the order are filled apart and
    joined at their ends, so neither the corpus nor a group is one task.
    ``ordinal`` is a column without ties or nulls.
    """
    keys = group or []
    at = F.col(ordinal)
    rows = kept(articles.repartitionByRange(*keys, ordinal).withColumn("_range", F.spark_partition_id()))
    rows = _carried(rows, ordinal, keys, {"part_name": F.col("part")})
    rows = _carried(rows, ordinal, keys, {"_part_before": F.col("part")}, before=True)
    new_part = ~F.col("part_name").eqNullSafe(F.col("_part_before"))
    placed = lambda c: F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("name")))
    rows = _carried(rows, ordinal, keys, {"_from_part": F.when(new_part, at), "_chapter": placed("chapter")})
    since = lambda item, start: F.when(F.col(start).isNull() | (F.col(f"{item}.at") >= F.col(start)), F.col(f"{item}.name"))
    rows = rows.withColumn("chapter_name", F.coalesce(since("_chapter", "_from_part"), F.when(F.col("part_name").isNotNull(), F.lit(UNSORTED_CHAPTER))))
    rows = _carried(rows, ordinal, keys, {"_chapter_before": F.struct("chapter_name")}, before=True)
    new_chapter = (at == F.col("_from_part")) | ~F.col("chapter_name").eqNullSafe(F.col("_chapter_before.chapter_name"))
    rows = _carried(rows, ordinal, keys, {"_from_chapter": F.when(new_chapter, at), "_section": placed("section"), "_subsection": placed("subsection")})
    names = {f"{c}_name": F.coalesce(since(f"_{c}", "_from_chapter"), F.lit("")) for c in ("section", "subsection")}
    return rows.select(*articles.columns, "part_name", "chapter_name", *[c.alias(n) for n, c in names.items()])


def hierarchy_counts(rows: DataFrame, levels: list[str]) -> DataFrame:
    """(level, id, articles, children): rows below each id of each level, and
    distinct ids one level down."""
    out = None
    for i, level in enumerate(levels):
        child = F.countDistinct(levels[i + 1]) if i + 1 < len(levels) else F.lit(0)
        one = rows.where(F.col(level).isNotNull()).groupBy(F.col(level).cast("string").alias("id")).agg(F.count("*").alias("articles"), child.cast("long").alias("children")).withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out


def article_parent(subsection: Column, section: Column, chapter: Column, part: Column) -> Column:
    """struct<kind, id> of the deepest level that is there."""
    pick = lambda kind, c: F.when(c.isNotNull(), F.struct(F.lit(kind).alias("kind"), c.alias("id")))
    return F.coalesce(pick("subsection", subsection), pick("section", section), pick("chapter", chapter), pick("part", part))


def last_of_each(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key, at the place of its first."""
    w = W.partitionBy(key)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc(ordinal)))).withColumn("first_at", F.min(ordinal).over(w))
    return ranked.where("_r = 1").drop("_r")


def hierarchical_path(part: Column, chapter: Column, section: Column, subsection: Column) -> Column:
    """Ids of a row's own levels, joined by slashes."""
    there = lambda c: c.isNotNull() & (c != "")
    p = F.when(there(part), T.part_number(part)).otherwise(0).cast("string")
    c = F.coalesce(T.chapter_number(chapter), F.lit(0)).cast("string")
    chapter_id = F.concat(F.lit("chapter_p"), p, F.lit("_c"), c)
    section_id = F.concat(F.lit("section_"), chapter_id, F.lit("_s"), F.coalesce(T.section_number(section), F.lit(0)).cast("string"))
    sub_id = F.concat(F.lit("subsection_"), section_id, F.lit("_ss"), T.section_number(subsection, "tiểu mục").cast("string"))
    return F.concat_ws("/", F.when(there(part), F.concat(F.lit("part_"), p)), F.when(there(chapter), chapter_id), F.when(there(section), section_id), F.when(there(subsection), sub_id))


def hierarchy_values(rows: DataFrame, levels: list[str]) -> DataFrame:
    """(level, value), distinct."""
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).cast("string").alias("value")) for x in levels])).alias("v")
    return rows.select(pairs).select("v.level", "v.value").where("value is not null and value <> ''").distinct()


def split_clauses(rows: DataFrame, article: str, text: str) -> DataFrame:
    """(article_id, place, number, text): a clause for each line that starts with
    a number and a dot.  What stands before the first belongs to it, with a line
    break between; without any there is one clause, number 1.  A number too long
    for a bigint counts as 1."""
    # A look-ahead split keeps each marker with its clause; element 0 may be a preamble.
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), r"(?m)(?=^[0-9]+\.\s+)")
    pieces = F.filter(pieces, lambda p, i: (i > 0) | (F.trim(p) != ""))
    marked = lambda p: F.regexp_like(p, F.lit(r"^[0-9]+\.\s"))
    trim = lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")
    lead = ~marked(F.element_at(pieces, 1))
    merged = F.when(F.size(pieces) == 0, F.array(F.lit(""))).when(lead & (F.size(pieces) > 1), F.concat(F.array(F.concat(trim(pieces[0]), F.lit("\n"), trim(pieces[1]))), F.slice(pieces, 3, F.size(pieces)))).otherwise(pieces)
    numbers = F.when(F.size(pieces) == 0, F.array(F.lit("1"))).otherwise(F.transform(F.filter(pieces, marked), lambda p: F.regexp_extract(p, r"^([0-9]+)\.", 1)))
    out = rows.select(F.col(article).alias("article_id"), merged.alias("m"), numbers.alias("n"))
    out = out.select("article_id", F.posexplode("m").alias("place", "text"), "n")
    number = F.coalesce(F.try_element_at("n", F.col("place") + 1).try_cast("long"), F.lit(1).cast("long"))
    return out.select("article_id", (F.col("place") + 1).cast("long").alias("place"), number.alias("number"), trim(F.col("text")).alias("text"))


def split_points(rows: DataFrame, clause: str, text: str) -> DataFrame:
    """(clause_id, place, letter, text): lines of the form ``a) …``."""
    pattern = F.lit(rf"(?imu)^([{L.POINT_LETTERS}])\)\s+(.+)$")
    both = F.arrays_zip(F.regexp_extract_all(F.col(text), pattern, 1).alias("letter"), F.regexp_extract_all(F.col(text), pattern, 2).alias("text"))
    return rows.select(F.col(clause).alias("clause_id"), F.posexplode(both).alias("place", "p")).select("clause_id", (F.col("place") + 1).cast("long").alias("place"), F.lower("p.letter").alias("letter"), F.trim("p.text").alias("text"))


def embedding_documents(articles: DataFrame, clauses: DataFrame, reports: DataFrame) -> DataFrame:
    """Articles, clauses and reports as (kind_order, kind, id, title, content)."""
    parts = (
        articles.select(F.lit(0).alias("kind_order"), F.lit("article").alias("kind"), "id", "title", F.col("text").alias("content")),
        clauses.select(F.lit(1).alias("kind_order"), F.lit("clause").alias("kind"), "id", "title", F.concat(F.lit("Khoản "), F.col("number"), F.lit(": "), F.col("text")).alias("content")),
        reports.select(F.lit(2).alias("kind_order"), F.lit("report").alias("kind"), "id", "title", F.concat("summary", F.lit("\n"), "findings").alias("content")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lite_sample(articles: DataFrame, order: str, clause_count: str, most_articles: int = 200, most_clauses: int = 200) -> DataFrame:
    """The first articles, and of each how many clauses fit the total."""
    first = articles.orderBy(order).limit(most_articles)  # bounded, so one task may order it
    before = F.coalesce(F.sum(clause_count).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("clauses_taken", F.greatest(F.lit(0), F.least(F.col(clause_count), F.lit(most_clauses) - before)).cast("long"))
