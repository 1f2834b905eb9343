"""Queries of session logs and conversation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import lexicons as L
from weftgraph.operators import caching, evaluation, reads, sessions, tool_functions
from weftgraph.plans import standins as S
from weftgraph.plans.registry import query
from weftgraph.sources import session_logs
from weftgraph.streaming import hash_chain, memory

REC = f"WITH {S.RECORDS}"
TOK = "greatest(len([w for w in regexp_split_to_array(content, '\\s+') if w <> '']), ceil(length(content) / 4.0))::BIGINT"
FLAT = "trim(regexp_replace(nfc_normalize(content), '\\s+', ' ', 'g'))"
TITLE = "CASE WHEN length(q) > 80 THEN substring(q, 1, 79) || '…' ELSE q END"
FOLD = f"""{REC}, folded AS (SELECT session_id, count(*)::BIGINT AS record_count, max_by(created_at, seq) AS last_active_at, (count(*) FILTER (WHERE kind IN ('answer', 'error')))::BIGINT AS turns,
  coalesce(sum({TOK}) FILTER (WHERE kind IN ('query', 'answer')), 0)::BIGINT AS tokens, coalesce(min_by({FLAT}, seq) FILTER (WHERE kind = 'query' AND {FLAT} <> ''), '') AS q FROM records GROUP BY session_id)"""


@query("session_fold", f"{FOLD} SELECT session_id, record_count, last_active_at, turns, tokens, {TITLE} AS title FROM folded")
def session_fold(spark: SparkSession, d: str) -> DataFrame:
    return sessions.fold_sessions(S.records(spark, d)).select("session_id", "record_count", "last_active_at", "turns", "tokens", "title")


RUNS = """runs AS (SELECT session_id, run_id, min(seq) FILTER (WHERE kind = 'query') AS seq, min_by(content, seq) FILTER (WHERE kind = 'query') AS query, min_by(created_at, seq) FILTER (WHERE kind = 'query') AS created_at,
  max_by(content, seq) FILTER (WHERE kind = 'answer') AS answered, coalesce(answered, '') AS answer, bool_or(ok) FILTER (WHERE kind = 'answer') AS fine, max(trace_id) AS trace_id,
  count(*) FILTER (WHERE kind IN ('answer', 'error')) AS ends FROM records GROUP BY 1, 2), t AS (SELECT * FROM runs WHERE query IS NOT NULL AND ends > 0)"""


@query("turns", f"{REC}, {RUNS} SELECT session_id, run_id, seq, query, answer, created_at, coalesce(fine, false) AS ok, trace_id FROM t")
def turns(spark: SparkSession, d: str) -> DataFrame:
    return sessions.build_turns(S.records(spark, d)).drop("steps")


@query("store_counts", f"{REC} SELECT count(DISTINCT session_id)::BIGINT AS live, 0::BIGINT AS hidden, count(*)::BIGINT AS records FROM records")
def store_counts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.store_counts(sessions.fold_sessions(S.records(spark, d)))


@query("session_totals", f"{FOLD} SELECT count(*)::BIGINT AS active, sum(turns)::BIGINT AS turns, sum(record_count)::BIGINT AS records FROM folded")
def session_totals(spark: SparkSession, d: str) -> DataFrame:
    return sessions.fold_sessions(S.records(spark, d)).where("not hidden").agg(F.count("*").alias("active"), F.sum("turns").alias("turns"), F.sum("record_count").alias("records"))


@query("session_list", f"{FOLD} SELECT session_id, turns FROM folded")
def session_list(spark: SparkSession, d: str) -> DataFrame:
    folded = sessions.fold_sessions(S.records(spark, d)).withColumn("owner", F.lit("someone"))
    return sessions.session_list(folded, owner="nobody").select("session_id", "turns")


@query("trace_page", f"{REC} SELECT session_id, seq, kind FROM records WHERE session_id NOT LIKE '%7' AND contains(lower(nfc_normalize(content)), 'the') ORDER BY created_at DESC, session_id, seq DESC LIMIT 20 OFFSET 20")
def trace_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of what one owner may see; sessions that end in 7 are another's."""
    records = S.records(spark, d)
    folded = sessions.fold_sessions(records).withColumn("owner", F.when(F.endswith("session_id", F.lit("7")), "other").otherwise("own"))
    found = sessions.match_records(records, text="THE", scope=sessions.owned_sessions(folded, "own"))
    return reads.page(found, sessions.trace_order(), 2, 20).select("session_id", "seq", "kind")


@query("mean_rating", "SELECT p_brand, round(sum(coalesce(CASE WHEN p_size % 3 > 0 THEN p_retailprice END, 0)) / count(*), 6) AS rating FROM part GROUP BY p_brand")
def mean_rating(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "part").withColumn("rating", F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice")))
    return rows.groupBy("p_brand").agg(F.round(evaluation.mean_rating("rating"), 6).alias("rating"))


@query("kind_counts", f"{REC} SELECT k AS kind, count(seq)::BIGINT AS n FROM (SELECT unnest({list(sessions.KINDS)}) AS k) LEFT JOIN (SELECT * FROM records WHERE contains(lower(content), 'the')) ON kind = k GROUP BY k")
def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.kind_counts(S.records(spark, d), text="the")


@query("hash_chain_seal")
def hash_chain_seal(spark: SparkSession, d: str) -> DataFrame:
    return hash_chain.seal(S.records(spark, d).withColumn("body", F.to_json(F.struct("content", "kind"))))


CHAIN = """c AS (SELECT conv_id, turn::BIGINT AS seq, text AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS place FROM conversations)"""


@query("chain_verify", f"WITH {CHAIN} SELECT 'conv_' || conv_id AS session_id, count(*)::BIGINT + 1 AS good, NULL::BIGINT AS first_bad FROM c WHERE conv_id % 2 = 0 GROUP BY conv_id UNION ALL SELECT 'conv_' || conv_id, 1::BIGINT, min(place)::BIGINT FROM c WHERE conv_id % 2 = 1 GROUP BY conv_id")
def chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """Sealed logs of which every other one has its second record changed."""
    sealed = hash_chain.seal(S.records(spark, d).withColumn("body", F.col("content")))
    odd = F.element_at(F.split("session_id", "_"), 2).cast("long") % 2 == 1
    changed = sealed.withColumn("body", F.when(odd & (F.col("seq") == 2), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return sessions.verify_chain(changed)


@query("log_violations", f"""{REC}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i,
    coalesce(sum(CASE WHEN kind = 'query' THEN 1 ELSE 0 END) OVER b, 0) AS asked, coalesce(sum(CASE WHEN kind IN ('answer', 'error') THEN 1 ELSE 0 END) OVER b, 0) AS closed FROM records
    WINDOW b AS (PARTITION BY session_id, run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT session_id, seq, 'seq_gap' AS rule FROM r WHERE seq <> i UNION ALL SELECT session_id, seq, 'first_not_created' FROM r WHERE i = 1 AND kind <> 'session_created'
  UNION ALL SELECT session_id, seq, 'created_not_first' FROM r WHERE i > 1 AND kind = 'session_created'
  UNION ALL SELECT session_id, seq, 'repeated_query' FROM r WHERE kind = 'query' AND asked > 0 UNION ALL SELECT session_id, seq, 'without_query' FROM r WHERE kind IN ('step', 'answer', 'error') AND (asked = 0 OR closed > 0)""")  # fmt: skip
def log_violations(spark: SparkSession, d: str) -> DataFrame:
    return sessions.log_violations(S.records(spark, d))


@query("live_sessions", f"{REC} SELECT session_id FROM records GROUP BY session_id HAVING count(*) FILTER (WHERE kind = 'step') = 0")
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.live_sessions(S.records(spark, d).withColumn("kind", F.when(F.col("kind") == "step", "deleted").otherwise(F.col("kind"))))


@query("index_consistency", f"{FOLD} SELECT session_id, 'field:turns' AS problem FROM folded WHERE turns % 2 = 1 AND record_count % 5 > 0 UNION ALL SELECT session_id, 'not indexed' FROM folded WHERE record_count % 5 = 0 UNION ALL SELECT 'ghost', 'no log'")
def index_consistency(spark: SparkSession, d: str) -> DataFrame:
    folded = sessions.fold_sessions(S.records(spark, d))
    index = folded.where("record_count % 5 > 0").withColumn("turns", F.col("turns") - F.col("turns") % 2).select("session_id", "record_count", "turns")
    ghost = spark.createDataFrame([("ghost", 1, 1)], "session_id string, record_count long, turns long")
    return sessions.index_problems(index.union(ghost), folded, ["record_count", "turns"])


KEY = "the thing with and worthless idiot there"
_TERMS = [w for w in dict.fromkeys(KEY.split()) if w not in L.KEY_TERM_STOPS]
ITEMS = f"""{REC}, {RUNS},
  items AS (SELECT session_id, run_id, seq, 0 AS place, 'query' AS kind, query AS content FROM t UNION ALL SELECT session_id, run_id, seq, 1, 'answer', answer FROM t WHERE length(trim(answer)) > 0)"""
_RECALLED = "SELECT session_id, run_id, kind, score::INTEGER AS score, r::INTEGER AS rank FROM {} WHERE r <= 3"


@query("recall", f"""{ITEMS}, s AS (SELECT *, len(list_intersect(list_distinct(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+')), {_TERMS})) AS score FROM items),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, seq DESC, place) AS r FROM s WHERE score > 0) {_RECALLED.format("ranked")}""")  # fmt: skip
def recall(spark: SparkSession, d: str) -> DataFrame:
    return sessions.recall(sessions.build_turns(S.records(spark, d)), KEY).drop("content")


def _edge(order: str) -> str:
    return f"{ITEMS}, ranked AS (SELECT *, 0 AS score, row_number() OVER (PARTITION BY session_id ORDER BY seq {order}) AS r FROM items WHERE kind = 'query' AND run_id <> 'run_1') {_RECALLED.format('ranked')}"


@query("recall_first", _edge(""))
def recall_first(spark: SparkSession, d: str) -> DataFrame:
    return sessions.recall(sessions.build_turns(S.records(spark, d)), "Câu hỏi đầu tiên là gì?", run_id="run_1").drop("content")


@query("recall_recent", _edge("DESC"))
def recall_recent(spark: SparkSession, d: str) -> DataFrame:
    return sessions.recall(sessions.build_turns(S.records(spark, d)), "what did we talk about earlier?", run_id="run_1").drop("content")


@query("run_fold", f"""{REC} SELECT session_id, run_id, sha256(string_agg(content, chr(10) ORDER BY seq)) AS messages, array_to_string(flatten(array_agg([seq, seq * 2] ORDER BY seq)), ',') AS citations,
  sum(seq)::BIGINT AS recalled, sum(CASE WHEN kind = 'answer' THEN length(content) ELSE 0 END)::BIGINT AS input_tokens, (count(*) FILTER (WHERE kind = 'answer') > 0) AS usage_seen,
  coalesce(max_by(seq, seq), 0)::BIGINT AS tool_calls, coalesce(max_by(kind, seq) FILTER (WHERE kind <> 'query'), '') AS answer FROM records GROUP BY 1, 2""")  # fmt: skip
def run_fold(spark: SparkSession, d: str) -> DataFrame:
    steps = S.records(spark, d).withColumns({
        "citations": F.array("seq", F.col("seq") * 2), "recalled": F.col("seq"), "input_tokens": F.when(F.col("kind") == "answer", F.length("content")).cast("long"),
        "tool_calls": F.col("seq"), "answer": F.when(F.col("kind") != "query", F.col("kind")),
    })
    return sessions.run_fold(steps).withColumns({"messages": F.sha2("messages", 256), "citations": F.array_join(F.col("citations").cast("array<string>"), ",")})


@query("memory_window")
def memory_window(spark: SparkSession, d: str) -> DataFrame:
    return memory.windows(sessions.build_turns(S.records(spark, d)))


@query("memory_stats")
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sums over all windows, and the counters of one recall a session."""
    turns = sessions.build_turns(S.records(spark, d))
    found = sessions.recall(turns, KEY).groupBy("session_id").agg(F.count("*").alias("items"))
    recalls = turns.groupBy("session_id").agg(F.count("*").alias("others")).join(found, "session_id", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    return memory.memory_stats(memory.windows(turns), recalls)


@query("session_export", f"{REC} SELECT seq, kind, content FROM records WHERE session_id = 'conv_3'")
def session_export(spark: SparkSession, d: str) -> DataFrame:
    lines = session_logs.export_session(S.records(spark, d), "conv_3")
    return lines.select(F.from_json("value", "seq long, kind string, content string").alias("r")).select("r.*")


@query("sse_parse", "SELECT conv_id AS id, turn::INTEGER AS i, 'token' AS event, role || chr(10) || turn AS data FROM conversations WHERE turn < 1000")
def sse_parse(spark: SparkSession, d: str) -> DataFrame:
    """Event streams made of conversations, and read again."""
    talk = S.table(spark, d, "conversations")
    block = F.concat(F.lit(": note\nevent: token\ndata: "), "role", F.lit("\ndata: "), "turn", F.lit("\n\n"))
    streams = talk.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "").alias("text"), F.min("turn").alias("t0"))
    return session_logs.parse_events(streams, "conv_id", F.col("text")).join(streams.select(F.col("conv_id").alias("id"), "t0"), "id").select("id", (F.col("i") + F.col("t0")).cast("int").alias("i"), "event", "data")


@query("latest_activity", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_activity(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latest(S.table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "event_type")


@query("avg_op_time", "SELECT round(coalesce(avg(value), 0), 6) AS mean_ms FROM events WHERE event_type = 'click' AND user_id % 2 = 0")
def avg_op_time(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("duration"), (F.col("user_id") % 2 == 0).alias("success"))
    return evaluation.mean_duration(e, "click").select(F.round("mean_ms", 6).alias("mean_ms"))


@query("cache_stats", "SELECT count(*) FILTER (WHERE user_id % 3 = 0)::BIGINT AS hits, count(*) FILTER (WHERE user_id % 3 > 0)::BIGINT AS misses, round(count(*) FILTER (WHERE user_id % 3 = 0) / count(*)::DOUBLE, 6) AS hit_rate FROM events")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select((F.col("user_id") % 3 == 0).alias("hit"))
    return evaluation.cache_stats(e).withColumn("hit_rate", F.round("hit_rate", 6))


@query("cache_replay", """WITH o AS (SELECT user_id AS key, epoch_ms(ts) AS ms, event_id AS ord, CASE WHEN event_id % 5 = 0 THEN 'set' WHEN event_id % 11 = 0 THEN 'delete' ELSE 'get' END AS op FROM events),
  c AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN {'op': op, 'ms': ms} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM o)
  SELECT key, ord, coalesce(was.op = 'set' AND ms - was.ms <= 86400000, false) AS hit FROM c WHERE op = 'get'""")  # fmt: skip
def cache_replay(spark: SparkSession, d: str) -> DataFrame:
    """Events as operations of a cache by user, whose entries live for a day."""
    op = F.when(F.col("event_id") % 5 == 0, "set").when(F.col("event_id") % 11 == 0, "delete").otherwise("get")
    events = S.table(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("ord"), op.alias("op"))
    return caching.replay(events, caching.CONFIGS["answer"][0]).drop("at")


@query("tool_calls", """WITH c AS (SELECT conv_id AS run_id, turn::BIGINT AS seq, ['get_article', 'search', 'other'][(conv_id + turn) % 3 + 1] AS tool, turn % 5 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
  SELECT run_id, seq, tool, CASE WHEN place > 4 THEN 'over budget' WHEN tool = 'other' THEN 'unknown tool' WHEN k = 0 OR k = 1 AND tool = 'search' THEN 'invalid arguments' END AS refusal FROM c""")  # fmt: skip
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Turns as tool calls, judged by a table function of SQL."""
    tool_functions.register(spark)
    k = F.col("turn") % 5
    args = F.when(k == 0, "no json").when(k == 1, '{"id": "a"}').otherwise('{"id": "a", "query": "q"}')
    tool = F.get(F.array(F.lit("get_article"), F.lit("search"), F.lit("other")), ((F.col("conv_id") + F.col("turn")) % 3).cast("int"))
    calls = S.table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").cast("long").alias("seq"), tool.alias("tool"), args.alias("args"))
    required = '{"get_article": ["id"], "search": ["query"]}'
    return spark.sql("SELECT run_id, seq, tool, refusal FROM judge_calls(TABLE({calls}), 4, :required)", args={"required": required}, calls=calls)
