"""Session logs by their lines: a Python data source that splits files by bytes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType

from weftgraph.functions.privacy import canonical_json, row_hash
from weftgraph.operators.sessions import GENESIS, KINDS

#: Bytes of a log that are read as one range, and of one read.
SPLIT_BYTES, READ_BYTES = 64 << 20, 1 << 20
#: Bytes that one task reads in short ranges, and what opening a range counts as.
TASK_BYTES, OPEN_BYTES = 32 << 20, 128 << 10
#: Rows of a batch at most.
MOST_ROWS = 10_000
SCHEMA = "file string, split int, key string, place long, offset long, text binary, torn boolean"
ARROW = pa.schema([("file", pa.string()), ("split", pa.int32()), ("key", pa.string()), ("place", pa.int64()), ("offset", pa.int64()), ("text", pa.binary()), ("torn", pa.bool_())])


class Splits(InputPartition):
    """Ranges of files that one task reads: (path, name, number, first, stop) each,
    for the lines that start in ``first`` up to ``stop``."""

    def __init__(self, ranges: list[tuple[str, str, int, int, int]]):
        self.ranges = ranges


class LineReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, split_bytes: int, keyed: bool):
        self.path, self.suffix, self.split_bytes, self.keyed = path, suffix, split_bytes, keyed

    def partitions(self) -> list[InputPartition]:
        """Ranges of files, several a task where they are short, so that many small
        files aren't as many tasks.  An empty file has a range as well, so that it
        is seen; it gives one row with no text."""
        files, root = pafs.FileSystem.from_uri(self.path)
        found = files.get_file_info(pafs.FileSelector(root, recursive=True))
        out: list[InputPartition] = []
        held: list[tuple[str, str, int, int, int]] = []
        size = 0
        for info in sorted((f for f in found if f.type == pafs.FileType.File and f.path.endswith(self.suffix)), key=lambda f: f.path):
            name = info.path[len(root) :].lstrip("/")
            for i, at in enumerate(range(0, max(info.size, 1), self.split_bytes)):
                stop = min(at + self.split_bytes, info.size)
                if held and size + OPEN_BYTES + stop - at > TASK_BYTES:
                    out.append(Splits(held))
                    held, size = [], 0
                held.append((f"{self.path.rstrip('/')}/{name}", name, i, at, stop))
                size += OPEN_BYTES + stop - at
        return [*out, Splits(held)] if held else out

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for row in (row for part in partition.ranges for row in self._lines(*part)):
            rows.append(row)
            size += len(row[5] or b"")
            if size >= READ_BYTES or len(rows) == MOST_ROWS:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _lines(self, uri: str, file: str, number: int, first: int, stop: int) -> Iterator[tuple]:
        """The lines that start in a range; a line may end beyond it.  Whether one
        starts at its first byte is told by the byte in front."""
        if stop == 0:
            yield file, number, None, 0, 0, None, True
            return
        places: dict[str | None, int] = {}

        def row(offset: int, line: bytes, torn: bool) -> tuple:
            key = None
            if self.keyed:
                name, tab, rest = line.partition(b"\t")
                key, line = (name.decode(errors="replace"), rest) if tab else ("", line)
            place = places[key] = places.get(key, -1) + 1
            return file, number, key, place, offset, line, torn

        files, path = pafs.FileSystem.from_uri(uri)
        with files.open_input_file(path) as stream:
            # ``held`` has the file's bytes from ``base``; those in front of ``at`` are done.
            base = at = max(first - 1, 0)
            stream.seek(at)
            held, skip = b"", first > 0
            while skip or at < stop:
                end = held.find(b"\n", at - base)
                if end < 0:
                    held, base = held[at - base :], at
                    more = stream.read(max(len(held), min(READ_BYTES, stop - first + 1)))
                    if more:
                        held += more
                        continue
                    if held and not skip:
                        yield row(at, held, True)
                    break
                if not skip:
                    yield row(at, held[at - base : end], False)
                skip, at = False, base + end + 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class SessionLogSource(DataSource):
    """``spark.read.format("session_log").load(folder)``: a row a line of all files
    below that end in option ``suffix``, split by option ``splitBytes``.

    file, split and place (of the line in its split), offset of its first byte,
    text without its end as bytes, and torn: the last line, if nothing ends it.
    With option ``keyed``, a line begins with a key and a tab: key has the first,
    text what follows, and place counts the key's lines.  A line without a tab has
    an empty key.
    """

    @classmethod
    def name(cls) -> str:
        return "session_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return LineReader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("splitbytes", SPLIT_BYTES)), self.options.get("keyed", "false") == "true")


def read_log_lines(spark: SparkSession, path: str, suffix: str = ".jsonl", split_bytes: int = SPLIT_BYTES, keyed: bool = False) -> DataFrame:
    """(file, session_id, line, text, torn): lines of session logs, numbered from 1
    in their file, or in their session's lines of a file that is ``keyed``.

    Splits count their own lines; the sums of earlier splits are added from a table
    of one row a split and session, so a log of any length is many tasks.  A
    session is the file's name without suffix, or the value of its folder
    ``session_id=…``; keyed files hold many sessions, whose name and a tab begin
    each line, and all lines of a session.  An empty file is one torn line of no
    text.
    """
    spark.dataSource.register(SessionLogSource)
    rows = spark.read.format("session_log").option("suffix", suffix).option("splitBytes", split_bytes).option("keyed", str(keyed).lower()).load(path)
    folder = F.regexp_extract("file", r"(?:^|/)session_id=([^/]+)/", 1)
    session = F.coalesce("key", F.when(folder != "", folder).otherwise(F.regexp_extract("file", r"([^/]*?)\.[^./]*$", 1)))
    rows = rows.withColumn("session_id", session)
    # One row a split of a session in a file: as many as its bytes over those of a split.
    sizes = rows.groupBy("file", "session_id", "split").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("file", "session_id").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("file", "session_id", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(before, ["file", "session_id", "split"]).select("file", "session_id", (F.col("before") + F.col("place") + 1).alias("line"), "text", "torn")


def _judged(text: bytes | None) -> tuple[str | None, int | None, str | None, str | None, bool]:
    """(session, seq, prev_hash, row_hash, sound) of one line: sound is a record
    in canonical form whose hash is that of its link and the rest."""
    try:
        line = bytes(text).decode() if text is not None else ""
        record = json.loads(line)
        session, seq, kind, prev, own = (record[k] for k in ("session_id", "seq", "kind", "prev_hash", "row_hash"))
        fields = isinstance(session, str) and isinstance(seq, int) and not isinstance(seq, bool) and kind in KINDS and isinstance(prev, str) and isinstance(own, str) and isinstance(record["content"], str)
        body = {k: v for k, v in record.items() if k != "row_hash"}
        sound = fields and canonical_json(record) == line and row_hash(prev, canonical_json(body)) == own
        return (session, seq, prev, own, sound) if fields else (None, None, None, None, False)
    except (ValueError, KeyError, TypeError, AttributeError, UnicodeError):
        return None, None, None, None, False


@pandas_udf(StructType().add("session_id", "string").add("seq", "long").add("prev_hash", "string").add("row_hash", "string").add("sound", "boolean"))
def judged(text: pd.Series) -> pd.DataFrame:
    rows = [_judged(x) for x in text]
    out = pd.DataFrame(rows, columns=["session_id", "seq", "prev_hash", "row_hash", "sound"])
    return out.astype({"seq": "Int64"})


def verify_lines(lines: DataFrame) -> DataFrame:
    """(session_id, good, first_bad) of logs as ``read_log_lines`` gives them: how
    many lines from the start are whole, and the first that isn't.

    A line is bad if it is torn, no record, another session's, not in its place
    (``seq``), not in canonical form, doesn't link to the line in front, or if
    its hash isn't that of its content.  Each line meets the one in front in a
    join by place, so a long log is no single task.
    """
    parsed = lines.select("file", F.col("session_id").alias("owner"), "line", "torn", judged("text").alias("r"))
    own = parsed.select("file", "owner", "line", "torn", "r.*")
    front = own.select("file", "owner", (F.col("line") + 1).alias("line"), F.col("row_hash").alias("front"))
    both = own.join(front, ["file", "owner", "line"], "left")
    link = F.when(F.col("line") == 1, F.lit(GENESIS)).otherwise(F.col("front"))
    whole = ~F.col("torn") & F.col("sound") & (F.col("session_id") == F.col("owner")) & (F.col("seq") == F.col("line")) & F.col("prev_hash").eqNullSafe(link)
    found = both.groupBy("file", F.col("owner").alias("session_id")).agg(F.count_if(~F.col("torn")).alias("n"), F.min(F.when(~F.coalesce(whole, F.lit(False)), F.col("line"))).alias("first_bad"))
    return found.select("session_id", F.coalesce(F.col("first_bad") - 1, "n").alias("good"), "first_bad")
