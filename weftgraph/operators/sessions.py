"""Session logs: folds, queries and integrity checks as windows and joins."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import text as T

# Kinds of records.
KINDS = ("session_created", "query", "step", "answer", "error", "deleted", "llm_call")
GENESIS = "0" * 64


def title_of(query: Column, most: int = 80) -> Column:
    """NFC, white space as single spaces; 80 code points, the last an ellipsis."""
    text = F.trim(F.regexp_replace(T.nfc(query), r"(?U)\s+", " "))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def fold_sessions(records: DataFrame) -> DataFrame:
    """One row a session: records, activity of the last one, title of the first
    query that has any, turns (answers and errors), tokens of queries and
    answers, and whether hidden."""
    kind = F.col("kind")
    titled = records.withColumn("_title", F.when(kind == "query", title_of(F.coalesce("content", F.lit("")))))
    return titled.groupBy("session_id").agg(
        F.count("*").alias("record_count"),
        F.max_by("created_at", "seq").alias("last_active_at"),
        F.coalesce(F.min_by("_title", F.when(F.col("_title") != "", F.col("seq"))), F.lit("")).alias("title"),
        F.sum(F.when(kind.isin("answer", "error"), 1).otherwise(0)).alias("turns"),
        F.sum(F.when(kind.isin("query", "answer"), T.count_tokens(F.col("content"))).otherwise(0)).alias("tokens"),
        F.max(F.coalesce(kind == "deleted", F.lit(False))).alias("hidden"),
    )


def build_turns(records: DataFrame) -> DataFrame:
    """Completed runs: (session_id, run_id, seq, query, answer, steps, created_at,
    ok, trace_id).

    A query is a turn once its run has an answer or an error.  A failed run has
    an empty answer and isn't ok, so what its error says never enters a window
    or a recall; an answered one is as ok as its record says, and an answer that
    doesn't say fails the query.  The trace is the answer's, else the error's.
    Columns ``ok``, ``created_at`` and ``trace_id`` may be missing from the
    records: then an answer is ok, and the others are null.
    """
    none = F.lit(None).cast("string")
    has = set(records.columns)
    field = lambda name: F.col(name).cast("string") if name in has else none
    at = lambda k: F.when(F.col("kind") == k, F.col("seq"))
    ok = F.coalesce("ok", F.raise_error(F.concat_ws(" ", F.lit("answer without ok:"), "session_id", F.col("seq").cast("string"))).cast("boolean")) if "ok" in has else F.lit(True)
    runs = records.where("run_id is not null").groupBy("session_id", "run_id").agg(
        F.min(at("query")).alias("seq"),
        F.min_by(F.struct("content", field("created_at").alias("created_at")), at("query")).alias("asked"),
        F.max_by(F.struct("content", F.when(F.col("kind") == "answer", ok).alias("ok"), field("trace_id").alias("trace_id")), at("answer")).alias("answered"),
        F.max_by(F.struct(field("trace_id").alias("trace_id")), at("error")).alias("failed"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "step", F.struct("seq", "content")))), lambda s: s["content"]).alias("steps"),
    )
    done = runs.where("asked is not null and (answered is not null or failed is not null)")
    return done.select(
        "session_id", "run_id", "seq", F.col("asked.content").alias("query"), F.when(F.col("answered").isNotNull(), F.col("answered.content")).otherwise(F.lit("")).alias("answer"), "steps", F.col("asked.created_at").alias("created_at"),
        F.coalesce("answered.ok", F.lit(False)).alias("ok"), F.when(F.col("answered").isNotNull(), F.col("answered.trace_id")).otherwise(F.col("failed.trace_id")).alias("trace_id"),
    )


def store_counts(folded: DataFrame) -> DataFrame:
    return folded.agg(
        F.coalesce(F.sum(F.when(~F.col("hidden"), 1).otherwise(0)), F.lit(0)).alias("live"),
        F.coalesce(F.sum(F.when(F.col("hidden"), 1).otherwise(0)), F.lit(0)).alias("hidden"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"),
    )


def session_list(folded: DataFrame, owner: str | None = None, login: bool = False) -> DataFrame:
    """Live sessions, newest first.  An owner without any sees all of them if no
    login is required."""
    live = folded.where(~F.col("hidden"))
    order = [F.desc("last_active_at"), F.col("session_id")]
    if owner is None:
        return live.orderBy(*order)
    own = live.where(F.col("owner") == owner)
    if login:
        return own.orderBy(*order)
    none = own.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("_none"))
    return own.unionByName(live.crossJoin(F.broadcast(none)).drop("_none")).orderBy(*order)  # one row at most


def match_records(records: DataFrame, text: str | None = None, session: str | None = None, kind: str | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Records by text (NFC, any case), session and kind; ``scope`` holds the
    session_ids that the asking owner has, see ``owned_sessions``."""
    found = records if scope is None else records.join(scope.select("session_id").distinct(), "session_id", "left_semi")
    if session:
        found = found.where(F.col("session_id") == session)
    if kind:
        found = found.where(F.col("kind") == kind)
    if text and text.strip():
        found = found.where(F.contains(F.lower(T.nfc(F.col("content"))), F.lit(unicodedata.normalize("NFC", text).lower())))
    return found


def owned_sessions(folded: DataFrame, owner: str) -> DataFrame:
    """Sessions of an owner that aren't hidden."""
    return folded.where((F.col("owner") == owner) & ~F.col("hidden")).select("session_id")


def trace_order() -> list[Column]:
    return [F.desc("created_at"), F.asc("session_id"), F.desc("seq")]


def kind_counts(records: DataFrame, text: str | None = None, session: str | None = None) -> DataFrame:
    """Records by kind under the other filters, in one pass; zeros included."""
    names = records.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    found = match_records(records, text, session).groupBy("kind").agg(F.count("*").alias("n"))
    return names.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def verify_chain(records: DataFrame, body: str = "body") -> DataFrame:
    """(session_id, good, first_bad): how many records from the start are whole,
    and the line, from 1, of the first that isn't.

    A record is whole if its number is its line, its link is the hash of the
    one before, and its hash is that of link and body.  No fold is needed: links
    are compared by ``lag``.
    """
    w = W.partitionBy("session_id").orderBy("seq", "row_hash")
    place = F.row_number().over(w)
    link = F.coalesce(F.lag("row_hash").over(w), F.lit(GENESIS))
    checked = records.select("session_id", place.alias("place"), ((F.col("seq") == place) & (F.col("prev_hash") == link) & (F.col("row_hash") == F.sha2(F.concat("prev_hash", body), 256))).alias("ok"))
    out = checked.groupBy("session_id").agg(F.count("*").alias("n"), F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col("place"))).alias("first_bad"))
    return out.select("session_id", F.coalesce(F.col("first_bad") - 1, "n").cast("long").alias("good"), F.col("first_bad").cast("long").alias("first_bad"))


def log_violations(records: DataFrame) -> DataFrame:
    """(session_id, seq, rule) for each record that a log may not have.

    Numbers count from 1; the first record, and no other, is session_created;
    each links to the hash of the one before (where the table has the hashes); a
    query opens a run that is new; steps, answers, errors and calls need an open
    one; nothing follows deleted.  Each record is judged after all in front of it.
    """
    w = W.partitionBy("session_id").orderBy("seq")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    run = W.partitionBy("session_id", "run_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    count = lambda cond, over: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)).over(over), F.lit(0))
    kind = F.col("kind")
    asked, closed = count(kind == "query", run), count(kind.isin("answer", "error"), run)
    rules = (
        ("after_deleted", count(kind == "deleted", before) > 0),
        ("seq_gap", F.col("seq") != F.row_number().over(w)),
        ("created_not_first", (kind == "session_created") & (F.row_number().over(w) > 1)),
        ("first_not_created", (kind != "session_created") & (F.row_number().over(w) == 1)),
        ("repeated_query", (kind == "query") & (F.col("run_id").isNull() | (asked > 0))),
        ("without_query", kind.isin("step", "answer", "error", "llm_call") & (F.col("run_id").isNull() | (asked == 0) | (closed > 0))),
    )
    if {"prev_hash", "row_hash"} <= set(records.columns):
        rules += (("broken_link", ~F.col("prev_hash").eqNullSafe(F.coalesce(F.lag("row_hash").over(w), F.lit(GENESIS)))),)
    flagged = records.select("session_id", "seq", *[F.coalesce(c, F.lit(False)).alias(name) for name, c in rules])
    found = F.filter(F.array(*[F.when(F.col(name), F.lit(name)) for name, _ in rules]), lambda x: x.isNotNull())
    return flagged.select("session_id", "seq", F.explode(found).alias("rule"))


def live_sessions(records: DataFrame) -> DataFrame:
    return records.groupBy("session_id").agg(F.max(F.when(F.col("kind") == "deleted", 1).otherwise(0)).alias("gone")).where("gone = 0").select("session_id")


def index_problems(index: DataFrame, folded: DataFrame, fields: list[str]) -> DataFrame:
    """(session_id, problem): logs without an index row, rows without a log, and
    fields that differ."""
    both = index.select("session_id", F.struct(*fields).alias("i")).join(folded.select("session_id", F.struct(*fields).alias("f")), "session_id", "full_outer")
    differs = F.filter(F.array(*[F.when(~F.col(f"i.{x}").eqNullSafe(F.col(f"f.{x}")), F.lit(f"field:{x}")) for x in fields]), lambda x: x.isNotNull())
    found = F.when(F.col("i").isNull(), F.array(F.lit("not indexed"))).when(F.col("f").isNull(), F.array(F.lit("no log"))).otherwise(differs)
    return both.select("session_id", F.explode(found).alias("problem"))


def recall(turns: DataFrame, key: str, run_id: str | None = None, most: int = 3) -> DataFrame:
    """(session_id, run_id, kind, content, score, rank): what each session
    recalls for ``key``, ``most`` items of the queries and of the answers that
    aren't blank.  The current run is left out.

    A key that names the first question gets the earliest queries, one that
    names the conversation the latest; any other the items that share most key
    terms with it, ties to the newest, queries before answers.
    """
    rows = turns if run_id is None else turns.where(F.col("run_id") != run_id)
    key = unicodedata.normalize("NFC", key)
    items = F.array(F.struct(F.lit("query").alias("kind"), F.col("query").alias("content")), F.struct(F.lit("answer").alias("kind"), F.col("answer").alias("content")))
    filled = F.filter(items, lambda x: (x["kind"] == "query") | (F.length(F.trim(F.coalesce(x["content"], F.lit("")))) > 0))
    asked = rows.select("session_id", "run_id", "seq", F.posexplode(filled).alias("place", "item")).select("session_id", "run_id", "seq", "place", "item.*")
    first, recent = T.is_first_key(F.lit(key)), T.is_recent_key(F.lit(key))
    topical = ~(first | recent)
    score = F.when(topical, F.size(F.array_intersect(T.key_terms(F.col("content")), T.key_terms(F.lit(key))))).otherwise(0)
    found = asked.withColumn("score", score).where(F.when(topical, F.col("score") > 0).otherwise(F.col("kind") == "query"))
    order = [F.desc("score"), F.when(first, F.col("seq")).otherwise(-F.col("seq")), F.col("place")]
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("session_id").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("session_id", "run_id", "kind", "content", "score", "rank")


def run_fold(steps: DataFrame) -> DataFrame:
    """State of each run after its steps (in order of ``seq``).

    Messages, citations, seeds and reports are joined; recalled items and tokens
    are added up, and tokens count as reported if any step reports them; the
    number of tool calls and the answer are the last step's that has them.
    ``steps`` has session_id, run_id, seq, content and those of the other columns
    that apply: citations, seeds, reports (arrays), recalled, input_tokens,
    output_tokens, tool_calls, answer.
    """
    has = set(steps.columns)

    def listed(column: str):
        return F.transform(F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("seq", F.col(column).alias("x"))))), lambda s: s["x"])

    out = [F.array_join(listed("content"), "\n").alias("messages")]
    out += [F.flatten(listed(c)).alias(c) for c in ("citations", "seeds", "reports") if c in has]
    out += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("recalled", "input_tokens", "output_tokens") if c in has]
    if "input_tokens" in has:
        out.append((F.count("input_tokens") > 0).alias("usage_seen"))
    last = {"tool_calls": F.lit(0), "answer": F.lit("")}
    out += [F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))), none).alias(c) for c, none in last.items() if c in has]
    return steps.groupBy("session_id", "run_id").agg(*out)
