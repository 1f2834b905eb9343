"""Sources and sinks of a corpus: JSON documents, reports and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLES = (
    "article_number bigint, title string, content variant, metadata struct<part:string,chapter:string,section:string,subsection:string>, "
    "clauses variant, keywords array<string>, `references` variant"
)
_FIELDS = "article_number:bigint, title:string, content:variant, metadata:struct<part:string,chapter:string,section:string,subsection:string>, clauses:variant, keywords:array<string>, `references`:variant"
REPORTS = "id string, community_id string, level bigint, title string, summary string, findings array<string>, rating double, parent_id string"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return files is not None and len(files) > 0


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """Articles of one JSON file (an array of objects); one that isn't JSON, or an
    item that doesn't fit, fails the read."""
    return spark.read.schema(ARTICLES).option("multiLine", True).option("mode", "FAILFAST").json(path)


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of all JSON files of a folder but the reports'.

    Files that hold one object instead of an array are left out.  A file that
    isn't JSON fails the read.
    """
    name = F.element_at(F.split("path", "/"), -1)
    heads = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).where(name != "community_reports.json")
    text = F.decode(F.col("content"), "UTF-8")
    value = F.parse_json(text)  # fails on anything else
    items = heads.where(F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))).select(F.explode(F.from_json(text, f"array<struct<{_FIELDS}>>", {"mode": "FAILFAST"})).alias("a"))
    return items.select("a.*").where("article_number is not null")


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports of a file; a missing one has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], REPORTS)
    return spark.read.schema(REPORTS).option("multiLine", True).json(path).where("id is not null")


def export_reports(reports: DataFrame) -> DataFrame:
    """What of the stored reports is exported, by level and id."""
    return reports.select("id", "level", "title", "summary", "findings", "rating", "parent_id").orderBy("level", "id")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def clear(rows: DataFrame, path: str) -> None:
    """Leaves the table without rows, with its schema."""
    rows.limit(0).write.mode("overwrite").parquet(path)


def vector_length(rows: DataFrame, column: str) -> int | None:
    """Length of the vectors of a table; null if it has none."""
    first = rows.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).first()
    return first["n"] if first else None


def table_catalog(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """(table, column, type, vector_length) of the tables in a folder: files or
    folders whose name ends in ``suffix``.  A column of floating-point lists has
    the length of its first vector, any other null."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))
    rows = []
    for name in (n for n in names if n.endswith(suffix)):
        table = spark.read.parquet(f"{folder.rstrip('/')}/{name}")
        for field in table.schema:
            kind = field.dataType.simpleString()
            rows.append((name.removesuffix(suffix), field.name, kind, vector_length(table, field.name) if kind in ("array<float>", "array<double>") else None))
    return spark.createDataFrame(rows, "table string, column string, type string, vector_length int")


def file_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file (such as a manifest) beside ``path`` and renames it,
    so that readers see the old one or the new one whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, new = hadoop.Path(path), hadoop.Path(f"{path}.new")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(new, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
        out.hsync()
    finally:
        out.close()
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files = hadoop.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(system.makeQualified(new), system.makeQualified(at), options)
