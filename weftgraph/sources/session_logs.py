"""Session logs and event streams as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "session_id string, run_id string, seq bigint, created_at string, kind string, step_kind string, tool string, content string, ok boolean, "
    "trace_id string, prev_hash string, row_hash string"
)


def scan_log_strict(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-lines logs, one file a session.

    A file that is empty, ends inside a line, has bad JSON, a record without a
    required field, or one of another session fails the query with its place.
    """
    # Readers make no row of an empty file, so these are looked for in the listing.
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    if empty := [f.getPath().getName() for f in listed if f.isFile() and not f.getLen()]:
        raise ValueError(f"{empty[0]}: empty")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    whole = F.when(~F.endswith("text", F.lit("\n")), F.raise_error(F.concat("file", F.lit(": unfinished last line")))).otherwise(F.col("text"))
    lines = files.select("file", F.posexplode(F.split(F.rtrim(whole, F.lit("\n")), "\n")).alias("line", "json"))
    parsed = lines.withColumn("r", F.from_json("json", RECORD, {"mode": "PERMISSIVE"}))
    place = F.concat_ws(":", "file", (F.col("line") + 1).cast("string"))
    bad = F.col("r").isNull() | F.col("r.session_id").isNull() | F.col("r.seq").isNull() | F.col("r.kind").isNull()
    foreign = F.col("r.session_id") != F.regexp_replace("file", r"\.jsonl$", "")
    checked = F.when(bad, F.raise_error(F.concat(place, F.lit(": no record")))).when(foreign, F.raise_error(F.concat(place, F.lit(": another session")))).otherwise(F.col("r"))
    return parsed.select(checked.alias("r"), "json").select("r.*", F.col("json").alias("line"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows; a session that stands in it twice fails the query."""
    rows = spark.read.option("multiLine", True).json(path)
    twice = rows.groupBy("session_id").agg(F.count("*").alias("n")).where("n > 1").select("session_id")
    checked = rows.join(twice.withColumn("_twice", F.lit(True)), "session_id", "left")
    return checked.where(F.when(F.col("_twice"), F.raise_error(F.concat(F.lit("repeated session "), "session_id"))).otherwise(F.lit(True))).drop("_twice")


# Events of a stream.
EVENTS = ("session", "step", "token", "reset", "done", "error")


def parse_events(streams: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, i, event, data) of server-sent event texts: blocks between blank
    lines; several data lines are joined; comments are skipped; an unknown event
    fails the query."""
    blocks = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n+"), lambda b: F.trim(b) != "")
    rows = streams.select(F.col(id_col).alias("id"), F.posexplode(blocks).alias("i", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: ~F.startswith(x, F.lit(":")))
    values = lambda name: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(name + ":"))), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    event = F.element_at(values("event"), -1)
    known = F.when(event.isin(*EVENTS), event).otherwise(F.raise_error(F.concat(F.lit("unknown event "), event)))
    return rows.where(F.size(values("event")) > 0).select("id", "i", known.alias("event"), F.array_join(values("data"), "\n").alias("data"))


def export_session(records: DataFrame, session: str) -> DataFrame:
    return records.where(F.col("session_id") == session).orderBy("seq").select(F.to_json(F.struct("*")).alias("value"))
