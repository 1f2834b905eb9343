"""A store of session logs: numbered commits, sealed records and an index.

Below its folder a store has ``log/<version>.json`` (one small file a commit),
``data/<token>`` (the records of one batch, sealed) and ``index/<version>`` (the
rows of the sessions that the batch touched).  An append goes through these
steps:

1. the batch is judged against the index; a bad record fails it here,
2. its records are sealed onto the chains of their sessions and staged,
3. the commit is made: a finished file gets the next number by a rename that
   fails if another writer has taken it, in which case all starts again,
4. the sessions' rows of the index are rewritten.

What isn't named by a commit doesn't exist, so an end between any two steps
leaves the batch out, or in whole.  After the commit and before the index, the
log is ahead of its index: then the store refuses to open until ``recover`` has
built the index from the log.  A store object that met an error while writing
refuses all further use, as what it remembers may differ from what is stored.

The folder must be on a file system whose renames are atomic.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.functions.privacy import canonical_json, row_hash
from weftgraph.operators.sessions import GENESIS, KINDS, fold_sessions

RECORD = "session_id string, run_id string, seq long, created_at string, kind string, content string, ok boolean, trace_id string"
SEALED = f"{RECORD}, prev_hash string, row_hash string, line string, owner string"
INDEX = "session_id string, owner string, created_at string, last_active_at string, title string, turns long, tokens long, record_count long, hidden boolean, last_row_hash string, version long"
#: Fields that every record has, null or not; code points of a content at most.
ALWAYS = ("session_id", "run_id", "seq", "created_at", "kind", "content")
MOST_CHARS = 32_000
#: Commits after which the index is written whole again, and tries of a commit.
WHOLE_EVERY, TRIES = 16, 20


class StoreError(RuntimeError):
    """The store can't be used, or a batch can't be appended."""


class Conflict(StoreError):
    """Another writer has made the commit of that number."""


def sealed(records: DataFrame) -> DataFrame:
    """Records with prev_hash, row_hash and line: the canonical JSON that a log
    holds.  ``start_hash`` is the hash that a session's first record links to;
    ``owner`` stays as it is.

    Rows of a session stream through in order, and only the last hash is held.
    """
    names = StructType.fromDDL(RECORD).names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), GENESIS
        for part in batches:
            links, hashes, lines = [], [], []
            for row, start in zip(part.select(names).to_pylist(), part.column("start_hash").to_pylist(), strict=True):
                if row["session_id"] != now:
                    now, last = row["session_id"], start
                body = {k: v for k, v in row.items() if v is not None or k in ALWAYS} | {"prev_hash": last}
                links.append(last)
                last = row_hash(last, canonical_json(body))
                hashes.append(last)
                lines.append(canonical_json(body | {"row_hash": last}))
            columns = [part.column(n) for n in names] + [pa.array(x, type=pa.string()) for x in (links, hashes, lines)] + [part.column("owner")]
            yield pa.RecordBatch.from_arrays(columns, [*names, "prev_hash", "row_hash", "line", "owner"])

    rows = records.select(*names, "owner", "start_hash").repartition("session_id").sortWithinPartitions("session_id", "seq")
    return rows.mapInArrow(run, SEALED)


def append_violations(batch: DataFrame, index: DataFrame, stored: DataFrame) -> DataFrame:
    """(session_id, seq, rule) for each record of a batch that its log may not get.

    A session's state is its row of the index, and of its stored records only
    the runs that the batch names are looked up.
    """
    known = index.select("session_id", F.col("record_count").alias("base"), F.col("hidden").alias("gone"))
    rows = batch.select("session_id", "run_id", "seq", "kind", "content", "created_at", "ok").join(known, "session_id", "left")
    asked, closed = F.col("kind") == "query", F.col("kind").isin("answer", "error")
    runs = stored.select("session_id", "run_id", "kind").where(asked | closed).join(batch.select("session_id", "run_id").where("run_id is not null").distinct(), ["session_id", "run_id"], "left_semi")
    rows = rows.join(runs.groupBy("session_id", "run_id").agg(F.count_if(asked).alias("asked"), F.count_if(closed).alias("closed")), ["session_id", "run_id"], "left")
    session = W.partitionBy("session_id").orderBy("seq")
    before, run = session.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("session_id", "run_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    count = lambda cond, over: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)).over(over), F.lit(0))
    rows = rows.withColumns({"place": F.coalesce("base", F.lit(0)) + F.row_number().over(session), "was_asked": F.coalesce("asked", F.lit(0)) + count(asked, run), "was_closed": F.coalesce("closed", F.lit(0)) + count(closed, run), "deleted": count(F.col("kind") == "deleted", before)})
    kind = F.col("kind")
    rules = {
        "missing_field": F.col("session_id").isNull() | F.col("seq").isNull() | kind.isNull() | F.col("content").isNull() | F.col("created_at").isNull() | ((kind == "answer") & F.col("ok").isNull()),
        "unknown_kind": ~kind.isin(*KINDS), "too_long": F.length("content") > MOST_CHARS, "after_deleted": F.coalesce("gone", F.lit(False)) | (F.col("deleted") > 0), "seq_gap": F.col("seq") != F.col("place"),
        "created_not_first": (kind == "session_created") & (F.col("place") > 1), "first_not_created": (kind != "session_created") & (F.col("place") == 1), "repeated_query": asked & (F.col("run_id").isNull() | (F.col("was_asked") > 0)),
        "without_query": kind.isin("step", "answer", "error", "llm_call") & (F.col("run_id").isNull() | (F.col("was_asked") == 0) | (F.col("was_closed") > 0)),
    }
    found = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())
    return rows.select("session_id", "seq", F.explode(found).alias("rule"))


class SessionStore:
    """Appends to, and reads of, the store below ``root``.

    ``app`` names a writer; its batches have rising numbers, and one that the log
    has already is not appended again.  ``patience``: seconds that an append waits
    for the index of another writer's commit.
    """

    def __init__(self, spark: SparkSession, root: str, app: str = "writer", patience: float = 60):
        self.spark, self.root, self.app, self.patience = spark, root.rstrip("/"), app, patience
        self.failure: Exception | None = None
        self.commits: list[dict] | None = None
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        at = self._path(self.root)
        self._fs = at.getFileSystem(self._conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(at).toUri(), self._conf)

    # Files.

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _rename(self, source: str, target: str) -> None:
        """Moves a finished file or folder to its name, unless that is taken."""
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        to = self._path(f"{self.root}/{target}")
        self._fs.mkdirs(to.getParent())
        if self._fs.exists(to):
            raise Conflict(f"{target} exists")
        try:
            self._files.rename(self._path(f"{self.root}/{source}"), to, options)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(f"{target} exists") from e
            raise

    # State.

    def _refresh(self) -> None:
        """Reads the commits that aren't known yet; their numbers have no gap."""
        known = self.commits or []
        names = [n for n in self._names("log") if n.endswith(".json")]
        wanted = [f"{i + 1:020d}.json" for i in range(len(names))]
        if names != wanted:
            raise StoreError(f"{self.root}/log: commits are missing; found {names[:3]} and so on")
        self.commits = known + [self._read(f"log/{n}") for n in names[len(known) :]]

    def _behind(self) -> list[dict]:
        """Commits without an index."""
        have = set(self._names("index"))
        return [c for c in self.commits or [] if f"{c['version']:020d}" not in have]

    def _settle(self, patience: float) -> None:
        """Reads the commits; each must have its index before the patience ends."""
        until = time.monotonic() + patience
        self._refresh()
        while behind := self._behind():
            if time.monotonic() >= until:
                raise StoreError(f"{self.root}: commits {[c['version'] for c in behind[:3]]} have no index; recover() builds it from the log")
            time.sleep(0.2)
            self._refresh()

    def open(self) -> SessionStore:
        """Makes the store usable; refuses one whose log is ahead of its index."""
        try:
            self._settle(0)
        except StoreError:
            self.commits = None
            raise
        return self

    def _usable(self) -> None:
        if self.failure is not None:
            raise StoreError(f"{self.root}: refused since a write failed: {self.failure}")
        if self.commits is None:
            raise StoreError(f"{self.root}: open() must come first")

    @contextmanager
    def _writing(self) -> Iterator[None]:
        """An error inside makes this object refuse further use."""
        try:
            yield
        except Exception as e:
            self.failure = e
            raise

    @property
    def version(self) -> int:
        self._usable()
        return len(self.commits)

    def records(self, version: int | None = None) -> DataFrame:
        """All sealed records up to a commit."""
        self._usable()
        return self._records(self.commits[:version])

    def _records(self, commits: list[dict]) -> DataFrame:
        paths = [f"{self.root}/{c['data']}" for c in commits]
        return self.spark.read.schema(SEALED).parquet(*paths) if paths else self.spark.createDataFrame([], SEALED)

    def index(self, version: int | None = None) -> DataFrame:
        """One row a session as of a commit: the latest that was written of it."""
        self._usable()
        return self._index(self.version if version is None else version)

    def _index(self, version: int) -> DataFrame:
        whole = version - version % WHOLE_EVERY
        paths = [f"{self.root}/index/{v:020d}" for v in range(max(whole, 1), version + 1)]
        if not paths:
            return self.spark.createDataFrame([], INDEX)
        names = StructType.fromDDL(INDEX).names
        rows = self.spark.read.schema(INDEX).parquet(*paths)
        return rows.groupBy("session_id").agg(F.max_by(F.struct(*names[1:]), "version").alias("x")).select("session_id", "x.*")

    # Writing.

    def append(self, batch: DataFrame, batch_id: int | None = None, owner: str = "") -> int:
        """Appends records (columns as ``RECORD``; those that are missing are null,
        and a missing ``owner`` is that of the call); gives the version with them.

        All or none: a bad record fails the batch and changes nothing.  With a
        ``batch_id``, a batch that is committed already changes nothing either.
        An empty batch makes no commit.
        """
        self._usable()
        for _ in range(TRIES):
            self._settle(self.patience)
            if batch_id is not None and self.commits and batch_id <= self.commits[-1]["batches"].get(self.app, -1):
                return next(c["version"] for c in self.commits if c["batches"].get(self.app, -1) >= batch_id)
            rows = self._judged(batch, owner)
            if rows.isEmpty():
                return self.version
            with self._writing():
                data = self._stage(rows)
                try:
                    commit = self._commit(data, batch_id)
                except Conflict:
                    continue
                self._write_index(commit)
                return commit["version"]
        raise StoreError(f"{self.root}: {TRIES} other writers came first")

    def _judged(self, batch: DataFrame, owner: str) -> DataFrame:
        own = F.col("owner") if "owner" in batch.columns else F.lit(owner)
        named = [(F.col(f.name) if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(RECORD)]
        rows = batch.select(*named, own.alias("owner"))
        bad = append_violations(rows, self._index(self.version), self._records(self.commits)).orderBy("session_id", "seq", "rule").limit(3).collect()
        if bad:
            raise StoreError("; ".join(f"{r['session_id']}:{r['seq']}: {r['rule']}" for r in bad))
        return rows

    def _stage(self, rows: DataFrame) -> str:
        """Seals a batch and writes it where no commit names it yet."""
        last = self._index(self.version).select("session_id", "last_row_hash")
        chained = rows.join(last, "session_id", "left").withColumn("start_hash", F.coalesce("last_row_hash", F.lit(GENESIS)))
        data = f"data/{uuid.uuid4().hex}"
        sealed(chained).write.parquet(f"{self.root}/{data}")
        return data

    def _commit(self, data: str, batch_id: int | None) -> dict:
        """The next commit, by a rename that one writer of a number can make."""
        batches = dict(self.commits[-1]["batches"]) if self.commits else {}
        if batch_id is not None:
            batches[self.app] = batch_id
        commit = {"version": self.version + 1, "data": data, "app": self.app, "batches": batches}
        name = f"staging/{uuid.uuid4().hex}.json"
        stream = self._fs.create(self._path(f"{self.root}/{name}"))
        try:
            stream.write(json.dumps(commit).encode())
        finally:
            stream.close()
        self._rename(name, f"log/{commit['version']:020d}.json")
        self.commits.append(commit)
        return commit

    def _write_index(self, commit: dict) -> None:
        """The index rows of a commit's sessions: their last ones and what the
        records add; now and then all sessions' rows, so that few are read."""
        version = commit["version"]
        records = self._records([commit])
        ends = records.groupBy("session_id").agg(F.min_by("created_at", "seq").alias("created_at"), F.max_by("row_hash", "seq").alias("last_row_hash"), F.max("owner").alias("owner"))
        new = fold_sessions(records).join(ends, "session_id")
        both = new.alias("n").join(self._index(version - 1).alias("o"), "session_id", "full_outer" if version % WHOLE_EVERY == 0 else "left")
        n, o = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"o.{c}"))
        zero = F.lit(0)
        merged = both.select(
            "session_id", F.coalesce(o("owner"), n("owner")).alias("owner"), F.coalesce(o("created_at"), n("created_at")).alias("created_at"), F.coalesce(n("last_active_at"), o("last_active_at")).alias("last_active_at"),
            F.when(F.coalesce(o("title"), F.lit("")) != "", o("title")).otherwise(n("title")).alias("title"), *[(F.coalesce(n(c), zero) + F.coalesce(o(c), zero)).cast("long").alias(c) for c in ("turns", "tokens", "record_count")],
            (F.coalesce(n("hidden"), F.lit(False)) | F.coalesce(o("hidden"), F.lit(False))).alias("hidden"), F.coalesce(n("last_row_hash"), o("last_row_hash")).alias("last_row_hash"), F.lit(version).cast("long").alias("version"),
        )
        name = f"staging/{uuid.uuid4().hex}"
        merged.write.parquet(f"{self.root}/{name}")
        self._rename(name, f"index/{version:020d}")

    def recover(self) -> SessionStore:
        """Builds the index of commits that have none, in their order, from the
        log; then the store is open.  For a store that no writer is at work on."""
        self._refresh()
        with self._writing():
            for commit in self._behind():
                self._write_index(commit)
        return self

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a batch that Spark runs again changes nothing."""

        def put(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, batch_id)

        return put

    def unnamed(self) -> list[str]:
        """Data folders that no commit names: what ended writers left behind, and
        what a writer at work has staged."""
        self._usable()
        named = {c["data"] for c in self.commits}
        return [f"data/{n}" for n in self._names("data") if f"data/{n}" not in named]
