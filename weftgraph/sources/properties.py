"""Properties of nodes as VARIANT columns, and their fields read with a type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Properties that hold lists or objects, and their types here.
FIELDS = {
    "clauses": "array<struct<id:string,number:bigint,text:string>>", "points": "array<struct<id:string,letter:string,text:string>>", "keywords": "array<string>", "metadata": "map<string,string>",
    "name_variants": "array<string>", "source_articles": "array<string>", "source_clauses": "array<string>", "related_concepts": "array<string>",
}


def without_nulls(props: Column) -> Column:
    """An object without its properties that are null; null for anything else."""
    fields = F.map_filter(F.try_variant_get(props, "$", "map<string,variant>"), lambda k, v: ~F.coalesce(F.is_variant_null(v), F.lit(True)))
    return F.when(F.startswith(F.schema_of_variant(props), F.lit("OBJECT")), F.to_variant_object(fields))


def packed(nodes: DataFrame, json: str, into: str = "props") -> DataFrame:
    """Nodes with a column of JSON objects as VARIANT, null properties left out.

    What isn't an object (broken JSON, a list, a bare value) has null properties
    and stands in ``<into>_raw`` as it came, so that nothing is lost; else that
    column is null.  A null or empty text has no properties and nothing raw.
    """
    text = F.nullif(F.col(json), F.lit(""))
    props = without_nulls(F.try_parse_json(text))
    kept = [F.col(c) for c in nodes.columns if c not in (json, into, f"{into}_raw")]
    return nodes.select(*kept, props.alias(into), text.alias("_text")).select(*kept, into, F.when(F.col(into).isNull(), F.col("_text")).alias(f"{into}_raw"))


def packed_columns(nodes: DataFrame, keep: list[str], into: str = "props") -> DataFrame:
    """Nodes with all columns but ``keep`` packed into one VARIANT, nulls left out."""
    rest = [c for c in nodes.columns if c not in keep]
    return nodes.select(*keep, without_nulls(F.to_variant_object(F.struct(*rest))).alias(into))


def _empty(kind: str) -> Column:
    if kind.startswith("array"):
        return F.array().cast(kind)
    return F.create_map().cast(kind) if kind.startswith("map") else F.lit(None).cast(kind)


def typed(props: Column, name: str, kind: str) -> Column:
    """A field by its type: null if it isn't there.  A list or object that is
    stored as JSON text is parsed; if that, or what is stored, doesn't fit, the
    field is the empty list or map.  A plain value that doesn't fit is null."""
    there = F.try_variant_get(props, f"$.{name}", "variant")
    if not kind.startswith(("array", "map", "struct")):
        return F.try_variant_get(props, f"$.{name}", kind)
    parsed = F.try_parse_json(F.when(F.schema_of_variant(there) == "STRING", F.try_variant_get(there, "$", "string")))
    return F.when(there.isNull(), None).otherwise(F.coalesce(F.try_variant_get(there, "$", kind), F.try_variant_get(parsed, "$", kind), _empty(kind)))


def shredded(nodes: DataFrame, fields: dict[str, str] = FIELDS, props: str = "props") -> DataFrame:
    """Nodes with a typed column for each of ``fields`` (see ``typed``) in the
    place of the properties; a scan reads the VARIANT once for all of them."""
    kept = [c for c in nodes.columns if c != props and c not in fields]
    return nodes.select(*kept, *[typed(F.col(props), name, kind).alias(name) for name, kind in fields.items()])
