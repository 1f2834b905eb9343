"""Queries of evaluation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import lexicons as L
from weftgraph.functions import text as T
from weftgraph.operators import dataset_rules
from weftgraph.operators import evaluation as E
from weftgraph.plans import standins as S
from weftgraph.plans.registry import query, values
from weftgraph.session import dealt

LABELLED = "x AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang)"


def _by_lang(spark: SparkSession, d: str) -> DataFrame:
    joined = S.table(spark, d, "labels").join(S.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("k"))


@query("rate", f"WITH {LABELLED} SELECT lang, round(k / n::DOUBLE, 6) AS rate FROM x")
def rate(spark: SparkSession, d: str) -> DataFrame:
    return _by_lang(spark, d).select("lang", F.round(E.rate(F.col("k"), F.col("n")), 6).alias("rate"))


def _wilson(bound: str) -> str:
    sign = "-" if bound == "low" else "+"
    inner = f"((k / n::DOUBLE) + 3.8416 / (2 * n) {sign} 1.96 * sqrt((k / n::DOUBLE) * (1 - k / n::DOUBLE) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)"
    return f"round({'greatest(0.0' if bound == 'low' else 'least(1.0'}, {inner}), 6) AS {bound}"


@query("wilson", f"WITH {LABELLED} SELECT lang, {_wilson('low')}, {_wilson('high')} FROM x")
def wilson(spark: SparkSession, d: str) -> DataFrame:
    low, high = E.wilson(F.col("k"), F.col("n"))
    return _by_lang(spark, d).select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("percentile_nr", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentile_nr(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "events").groupBy("event_type").agg(E.nearest_rank("value", 0.5).alias("p50"), E.nearest_rank("value", 0.95).alias("p95"))


@query("rule_of_three", f"WITH {LABELLED} SELECT lang, round(3.0 / n, 6)::DOUBLE AS bound FROM x")
def rule_of_three(spark: SparkSession, d: str) -> DataFrame:
    return _by_lang(spark, d).select("lang", F.round(E.rule_of_three(F.col("n")), 6).alias("bound"))


RANKED = """r AS (SELECT o_custkey, array_agg(p ORDER BY f, p) AS ranked FROM (SELECT o_custkey, l_partkey AS p, min(l_orderkey * 10 + l_linenumber) AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1),
  g AS (SELECT o_custkey, list_distinct(array_agg(l_partkey)) AS gold FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_returnflag"), "o_orderkey")
    first = rows.groupBy("o_custkey", "l_partkey").agg(F.min(F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("f"))
    ranked = first.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "l_partkey"))), lambda x: x["l_partkey"]).alias("ranked"))
    return ranked.join(rows.where("l_returnflag = 'R'").groupBy("o_custkey").agg(F.collect_set("l_partkey").alias("gold")), "o_custkey")


@query("recall_at_k", f"WITH {RANKED} SELECT o_custkey, round(len(list_intersect(ranked[1:5], gold)) / len(gold)::DOUBLE, 6) AS recall FROM r JOIN g USING (o_custkey)")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("o_custkey", F.round(E.recall_at(F.col("ranked"), F.col("gold"), 5), 6).alias("recall"))


@query("mrr", f"WITH {RANKED} SELECT o_custkey, round(1.0 / list_min([list_position(ranked, x) for x in gold]), 6)::DOUBLE AS rr FROM r JOIN g USING (o_custkey)")
def mrr(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("o_custkey", F.round(E.reciprocal_rank(F.col("ranked"), F.col("gold")), 6).alias("rr"))


@query("ranked_list", """WITH x AS (SELECT l_orderkey AS id, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem WHERE l_linenumber <= 2
    UNION ALL SELECT l_orderkey, l_partkey, 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) FROM lineitem WHERE l_linenumber >= 2),
  f AS (SELECT id, p, min(place) AS place FROM x GROUP BY id, p) SELECT id, string_agg(p::VARCHAR, ',' ORDER BY place) AS ranked FROM f GROUP BY id""")  # fmt: skip
def ranked_list(spark: SparkSession, d: str) -> DataFrame:
    """Of each order the first two parts as seeds, and those from the last to the second as paths."""
    line = F.struct("l_linenumber", "l_partkey")
    orders = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.when(F.col("l_linenumber") <= 2, line))).alias("s"), F.sort_array(F.collect_list(F.when(F.col("l_linenumber") >= 2, line)), False).alias("p"))
    parts = [F.transform(c, lambda x: x["l_partkey"]) for c in ("s", "p")]
    return orders.select("id", F.array_join(E.ranked_list(*parts).cast("array<string>"), ",").alias("ranked"))


@query("citation_recall", """WITH c AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS article FROM lineitem WHERE l_linenumber <= 2), g AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS article FROM lineitem WHERE l_returnflag = 'R')
  SELECT coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN n > 0 THEN round(h / n::DOUBLE, 6) END AS recall FROM (SELECT DISTINCT case_id FROM c) a FULL JOIN (SELECT g.case_id, count(*) AS n, count(c.article) AS h FROM g LEFT JOIN c ON c.case_id = g.case_id AND c.article = g.article GROUP BY 1) b ON a.case_id = b.case_id""")  # fmt: skip
def citation_recall(spark: SparkSession, d: str) -> DataFrame:
    li = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").cast("long").alias("article"), "l_linenumber", "l_returnflag")
    return E.citation_recall(li.where("l_linenumber <= 2"), li.where("l_returnflag = 'R'")).withColumn("recall", F.round("recall", 6))


@query("arm_delta", "WITH m AS (SELECT l_linestatus AS arm, avg(l_quantity) AS mean, count(l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1) SELECT arm, round(mean, 6) AS mean, n, round(mean - (SELECT mean FROM m WHERE arm = 'O'), 6) AS delta FROM m")
def arm_delta(spark: SparkSession, d: str) -> DataFrame:
    out = E.arm_deltas(S.table(spark, d, "lineitem"), "l_linestatus", "l_quantity", "O")
    return out.select("arm", F.round("mean", 6).alias("mean"), "n", F.round("delta", 6).alias("delta"))


@query("kpi_rates", f"""WITH f AS (SELECT 'late' AS kpi, (o_orderstatus = 'F') AS flag FROM orders UNION ALL SELECT 'big', CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice > 150000 END FROM orders),
  x AS (SELECT kpi, count(*) FILTER (WHERE flag)::BIGINT AS k, count(*)::BIGINT AS n FROM f WHERE flag IS NOT NULL GROUP BY kpi) SELECT kpi, k, n, round(k / n::DOUBLE, 6) AS rate, {_wilson("low")}, {_wilson("high")} FROM x""")  # fmt: skip
def kpi_rates(spark: SparkSession, d: str) -> DataFrame:
    o = S.table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("late"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") > 150000).alias("big"))
    out = E.kpi_rates(o, ["late", "big"])
    return out.select("kpi", "k", "n", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


@query("paired_delta", """WITH a AS (SELECT l_orderkey AS case_id, avg(l_discount) AS recall, sum(l_quantity) AS ms FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), b AS (SELECT l_orderkey AS case_id, avg(l_tax) AS recall, max(l_quantity) AS ms FROM lineitem GROUP BY 1)
  SELECT count(*)::BIGINT AS n, round(avg(a.recall), 6) AS agent, round(avg(b.recall), 6) AS legacy, round(avg(a.recall) - avg(b.recall), 6) AS delta, quantile_disc(a.ms, 0.95) AS agent_p95, quantile_disc(b.ms, 0.95) AS legacy_p95 FROM a JOIN b USING (case_id) WHERE case_id % 10 > 0""")  # fmt: skip
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    li = S.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "case_id")
    a = li.where("l_linenumber <= 2").groupBy("case_id").agg(F.avg("l_discount").alias("recall"), F.sum("l_quantity").alias("ms")).withColumn("error", F.lit(False))
    b = li.groupBy("case_id").agg(F.avg("l_tax").alias("recall"), F.max("l_quantity").alias("ms")).withColumn("error", F.col("case_id") % 10 == 0)
    out = E.paired_deltas(a, b)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("agent", "legacy", "delta")], "agent_p95", "legacy_p95")


GATES = [("a", 0.9, ">=", 0.85), ("b", 0.1, "<=", 0.05), ("c", None, ">=", 0.5), ("d", 0.0, "==", 0.0), ("e", 0.7999999999, ">=", 0.8)]


@query("kpi_gate", f"SELECT kpi, CASE WHEN v IS NULL THEN 'NOT MEASURED' WHEN (op = '>=' AND v >= t - 1e-9) OR (op = '<=' AND v <= t + 1e-9) OR (op = '==' AND abs(v - t) <= 1e-9) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT * FROM (VALUES {values(GATES)}) v(kpi, v, op, t) UNION ALL SELECT 'part ' || p_partkey, CASE WHEN p_partkey % 7 > 0 THEN p_size / 10.0 END, ['>=', '<=', '=='][p_partkey % 3 + 1], (p_partkey % 50) / 10.0 FROM part) g")
def kpi_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = S.table(spark, d, "part").select(F.concat(F.lit("part "), k), F.when(k % 7 > 0, F.col("p_size") / 10.0), F.get(F.array(F.lit(">="), F.lit("<="), F.lit("==")), (k % 3).cast("int")), (k % 50) / 10.0)
    rows = spark.createDataFrame(GATES, "kpi string, v double, op string, t double").union(parts)
    return rows.select("kpi", E.gate(F.col("v"), F.col("op"), F.col("t")).alias("verdict"))


@query("cost_estimate", """SELECT count(DISTINCT conv_id)::BIGINT AS cases, count(*)::BIGINT AS turns, count(*) FILTER (WHERE turn % 4 = 0)::BIGINT AS legal_turns, count(*) FILTER (WHERE turn % 4 = 1)::BIGINT AS recall_turns,
  count(*) FILTER (WHERE turn % 4 > 1)::BIGINT AS smalltalk_turns, 12::BIGINT AS legacy_calls, (7000 * sum(CASE turn % 4 WHEN 0 THEN 7 WHEN 1 THEN 2 ELSE 1 END) + 12 * 2500)::BIGINT AS estimated_tokens FROM conversations""")  # fmt: skip
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") % 4
    turns = S.table(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), F.when(k == 0, "legal").when(k == 1, "recall").when(k == 2, "smalltalk").alias("route"))
    return E.cost_estimate(turns, steps=6, legacy_calls=12)


@query("embed_plan", "SELECT lang AS kind, count(*)::BIGINT AS n, ceil(count(*) / 100.0)::BIGINT AS batches, max(length(text))::BIGINT AS max_tokens, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, round(sum(ceil(length(text) / 4.0)) * 0.2 / 1e6, 8) AS usd FROM documents GROUP BY lang")
def embed_plan(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").select(F.col("lang").alias("kind"), T.estimate_input_tokens(F.col("text")).alias("est_tokens"), F.length("text").alias("chars"))
    return E.embedding_plan(docs).withColumn("usd", F.round("usd", 8))


@query("dataset_violations", """WITH g AS (SELECT o_orderkey AS case_id, l_partkey AS article FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
  SELECT 'unknown_article' AS rule, case_id || ':' || article AS subject FROM g WHERE article % 7 = 0
  UNION ALL SELECT 'count', o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 2
  UNION ALL SELECT 'not_contiguous', case_id::VARCHAR FROM g GROUP BY case_id HAVING max(article) - min(article) + 1 <> count(DISTINCT article)""")  # fmt: skip
def dataset_violations(spark: SparkSession, d: str) -> DataFrame:
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("type"))
    gold = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").cast("long").alias("article"))
    items = gold.count()
    # Cases with items and items of cases; null parts are none, as in a collected list.
    o = dealt(o, items, "case_id").join(dealt(gold.select("case_id"), items, "case_id"), "case_id", "left_semi")
    gold = dealt(gold, items, "case_id").join(dealt(o, items, "case_id"), "case_id").select("case_id", "article").where("article is not null")
    corpus = S.table(spark, d, "part").where("p_partkey % 7 > 0").select(F.col("p_partkey").cast("long").alias("article"))
    declared = spark.createDataFrame([], "type string, declared long")
    return E.dataset_violations(o, corpus, declared, gold)


NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
ANSWER = "(CASE WHEN conv_id % 5 > 1 THEN 'Vâng' ELSE text END || CASE WHEN conv_id % 3 > 0 THEN ' Điều ' || (turn % 7) ELSE '' END)"


@query("case_score", f"""WITH c AS (SELECT conv_id, conv_id % 11 AS k, list(text ORDER BY turn) AS queries, count(*) AS n FROM conversations GROUP BY 1), s AS (SELECT *, CASE WHEN k IN (5, 7, 8, 9) THEN n - 1 ELSE 0 END AS scored, conv_id % 10 = 9 AS errored FROM c),
  calls AS (SELECT conv_id, count(*) AS tool_calls, count(*) FILTER (WHERE NOT ((conv_id + turn) % 4 = 0 AND conv_id % 5 = 0 OR (conv_id + turn) % 4 = 1 AND conv_id % 5 = 1)) AS invalid_calls FROM conversations WHERE NOT (conv_id % 10 = 9 AND turn = 1) GROUP BY 1),
  t AS (SELECT s.*, turn, text, tool_calls, invalid_calls, {ANSWER} AS answer, (conv_id + turn) % 4 AS tool, (conv_id + turn) % 7 AS art, conv_id % 7 AS g, CASE conv_id % 4 WHEN 0 THEN queries[1] WHEN 2 THEN text ELSE 'Chưa có  nội dung nào trước đó' END AS content
    FROM s JOIN conversations USING (conv_id) JOIN calls USING (conv_id) WHERE turn = scored),
  f AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN ((art = g)::INT + (art = g + 1)::INT) / 2.0 WHEN conv_id % 4 = 1 THEN (art BETWEEN 3 AND 5 OR turn % 3 = 0)::INT::DOUBLE END AS recall, tool = 1 AS called, {NORM.format("CASE WHEN tool = 1 THEN content ELSE '' END")} AS seen, {NORM.format("answer")} AS a, {NORM.format("queries[1]")} AS q1 FROM t),
  q AS (SELECT DISTINCT {NORM.format("text")} AS q FROM conversations WHERE length(text) >= 12), quoted AS (SELECT DISTINCT conv_id FROM f JOIN q ON contains(a, q) WHERE k = 6),
  r AS (SELECT f.*, regexp_matches(answer, '(?i)điều\\s*[0-9]') AS names_any, (regexp_matches(answer, '(?i)điều\\s*' || g || '([^0-9]|$)')) AS names_g, (regexp_matches(answer, '(?i)điều\\s*' || (g + 1) || '([^0-9]|$)')) AS names_h,
    NOT (called AND contains(seen, 'chưa có nội dung nào trước đó')) OR names_any OR conv_id IN (SELECT conv_id FROM quoted) AS invented,
    contains({NORM.format("content || chr(10) || answer")}, q1) OR contains({NORM.format("content")}, q1) OR contains(a, q1) OR contains({NORM.format("content || chr(10) || answer")}, 'zzz') AS leak FROM f)
  SELECT conv_id AS case_id, list_value({", ".join(f"'{x}'" for x in L.CASE_TYPES)})[k + 1] AS type, errored, CASE WHEN NOT errored THEN recall END AS citation_recall, CASE WHEN NOT errored THEN recall > 0 END AS gold_hit, CASE WHEN NOT errored AND conv_id % 2 = 0 THEN names_g OR names_h END AS answer_cites_gold,
    CASE WHEN NOT errored THEN list_value('get_article', 'recall_session', 'search_legal_articles', 'other')[tool + 1] END AS first_tool, tool_calls, invalid_calls, CASE WHEN NOT errored THEN called END AS recall_called,
    CASE WHEN NOT errored AND k IN (1, 2, 3) THEN tool = 0 END AS tool_choice_ok, CASE WHEN NOT errored AND k < 4 THEN NOT coalesce(recall > 0, false) END AS budget_exhausted,
    CASE WHEN NOT errored THEN CASE k WHEN 5 THEN called AND contains(seen, q1) AND names_g WHEN 6 THEN NOT invented WHEN 7 THEN called AND contains(seen, q1) WHEN 8 THEN coalesce(recall > 0, false) AND NOT called END END AS recall_ok,
    CASE WHEN NOT errored AND k = 6 THEN invented END AS fabricated, CASE WHEN NOT errored AND k = 9 THEN leak END AS isolation_leak, CASE WHEN NOT errored AND k = 9 THEN called END AS isolation_exercised FROM r""")  # fmt: skip
def case_score(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as cases of all types, each turn with one call and what it found."""
    rows = S.table(spark, d, "conversations")
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    pick = lambda items, i: F.get(F.array(*[F.lit(x) for x in items]), i.cast("int"))
    queries = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("queries")
    g = (conv % 7).cast("int")
    cases = rows.groupBy("conv_id").agg(queries).select(
        conv.alias("case_id"), pick(L.CASE_TYPES, conv % 11).alias("type"), "queries", F.when(conv % 2 == 0, F.array(g, g + 1)).alias("gold"),
        F.when(conv % 4 == 1, F.struct(F.lit("I").alias("label"), F.lit(3).alias("first"), F.lit(5).alias("last"))).alias("chapter"),
        F.lit("get_article").alias("expected_first_tool"), F.array(g).alias("answer_names"), F.array(F.lit("zzz")).alias("leaks"), F.lit(0).alias("target_turn"),
    )
    first = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    content = F.when(conv % 4 == 0, F.col("first")).when(conv % 4 == 2, text).otherwise("Chưa có  nội dung nào trước đó")
    cited = F.struct(((conv + turn) % 7).cast("int").alias("article"), F.array(F.when(turn % 3 == 0, "Chương I: x").otherwise("Chương IV")).alias("breadcrumb"))
    arguments = pick(['{"article_number": 3}', '{"key": "x"}', '{"query": ""}', "broken", None], conv % 5)
    tool = pick(["get_article", "recall_session", "search_legal_articles", "other"], (conv + turn) % 4)
    none, nothing = F.lit(None).cast("string"), F.filter(F.array(cited), lambda x: F.lit(False))
    steps = F.array(
        F.struct(F.lit("action").alias("kind"), tool.alias("tool"), arguments.alias("tool_input"), F.lit("").alias("content"), nothing.alias("citations")),
        F.struct(F.lit("observation").alias("kind"), none.alias("tool"), none.alias("tool_input"), content.alias("content"), F.array(cited).alias("citations")),
    )
    answer = F.concat(F.when(conv % 5 > 1, "Vâng").otherwise(text), F.when(conv % 3 > 0, F.concat(F.lit(" Điều "), (turn % 7).cast("string"))).otherwise(""))
    turns = rows.join(first, "conv_id").select(conv.alias("case_id"), "turn", (~((conv % 10 == 9) & (turn == 1))).alias("ok"), answer.alias("answer"), steps.alias("steps"))
    return E.case_scores(cases, turns, max_steps=1)


@query("manifest_compare", "WITH a AS (SELECT max(len(embedding)) AS dim, count(*) AS n FROM embeddings), b AS (SELECT max(len(embedding)) AS dim, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0) SELECT CASE WHEN a.dim IS DISTINCT FROM b.dim THEN 'dim' WHEN a.n <> b.n THEN 'n' END AS mismatch FROM a, b")
def manifest_compare(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of all vectors and that of every other one."""
    e = S.table(spark, d, "embeddings")
    manifest = lambda rows: rows.agg(F.lit("m").alias("model"), F.max(F.size("embedding")).alias("dim"), F.count("*").alias("n"))
    return E.first_mismatch(manifest(e), manifest(e.where("vec_id % 2 = 0")), ["model", "dim", "n"])


@query("fingerprint_diff", """SELECT 'doc_' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'appeared' ELSE 'changed' END AS change FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0""")
def fingerprint_diff(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    docs = S.table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("name"), F.length("text").alias("size"), F.sha2("text", 256).alias("sha256"))
    before = docs.where(~((k % 5 == 0) & (k % 3 > 0)))
    after = docs.where(k % 3 > 0).withColumn("sha256", F.when(k % 7 == 0, "other").otherwise(F.col("sha256")))
    return E.fingerprint_diff(before, after)


_ROUTE = "['legal', 'recall', 'smalltalk', 'other'][(conv_id + turn) % 4 + 1]"
_OF = "conv_id % 12"


@query("dataset_rules", f"""WITH c AS (SELECT conv_id, 'case_' || conv_id AS id, {list(dataset_rules.TYPES)}[{_OF} + 1] AS type, count(*) AS n, list({_ROUTE} ORDER BY turn) AS routes, list(CASE WHEN turn % 5 = 4 THEN '' ELSE ['A', 'B'][turn % 2 + 1] END ORDER BY turn) AS sessions, list(text ORDER BY turn) AS queries,
    CASE WHEN conv_id % 5 > 0 THEN list_distinct([conv_id % 9 * 3, conv_id % 4]) ELSE [] END AS gold, CASE conv_id % 3 WHEN 0 THEN 'get_article' WHEN 1 THEN 'traverse_references' END AS tool, CASE WHEN conv_id % 2 = 0 THEN 0 END AS target, CASE WHEN conv_id % 4 > 1 THEN ['zz'] END AS markers FROM conversations GROUP BY conv_id),
  a AS (SELECT doc_id AS number, CASE WHEN doc_id % 2 = 0 THEN 'Điều ' || doc_id || '. x' ELSE 'x' END AS title, 'Điều ' || (doc_id + 1) AS content FROM documents),
  t AS (SELECT 'case_' || conv_id AS id, {_OF} AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, {_ROUTE} AS route, turn, text FROM conversations)
  SELECT 'invalid_type' AS rule, id AS subject, NULL::INTEGER AS turn FROM c WHERE type IS NULL
  UNION ALL SELECT 'invalid_route', id, i FROM t WHERE k < 11 AND route = 'other' UNION ALL SELECT 'no_session', id, i FROM t WHERE k < 11 AND turn % 5 = 4 UNION ALL SELECT 'query_length', id, i FROM t WHERE k < 11 AND length(text) NOT BETWEEN 1 AND 1000
  UNION ALL SELECT 'unknown_article', id, NULL FROM c WHERE type IS NOT NULL AND EXISTS (SELECT 1 FROM (SELECT unnest(gold) AS x) u WHERE x NOT IN (SELECT number FROM a))
  UNION ALL SELECT 'seed_shape', id, NULL FROM c WHERE type = 'seed' AND NOT (n = 1 AND len(gold) >= 1) UNION ALL SELECT 'two_gold', id, NULL FROM c WHERE type = 'multi_hop' AND len(gold) < 2
  UNION ALL SELECT 'no_reference_edge', id, NULL FROM c WHERE type = 'multi_hop' AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(gold) AS x) u JOIN (SELECT unnest(gold) AS y) v ON y = x + 1 JOIN a ON a.number = x)
  UNION ALL SELECT 'first_tool', id, NULL FROM c WHERE type = 'multi_hop' AND coalesce(tool, '') <> 'traverse_references' OR type = 'explicit_article' AND coalesce(tool, '') <> 'get_article' OR type = 'global'
  UNION ALL SELECT 'one_gold', id, NULL FROM c WHERE type = 'explicit_article' AND len(gold) <> 1 UNION ALL SELECT 'query_names_gold', id, NULL FROM c WHERE type = 'explicit_article'
  UNION ALL SELECT 'corpus_title', id, NULL FROM c WHERE type = 'explicit_article' AND CASE WHEN conv_id % 5 > 0 THEN conv_id % 9 * 3 % 2 ELSE 1 END <> 0 UNION ALL SELECT 'gold_chapter', id, NULL FROM c WHERE type = 'global' UNION ALL SELECT 'no_gold', id, NULL FROM c WHERE type = 'global' AND len(gold) > 0
  UNION ALL SELECT 'small_talk_shape', id, NULL FROM c WHERE type = 'small_talk' AND NOT (len(gold) = 0 AND routes[1] = 'smalltalk') UNION ALL SELECT 'recall_turn', id, NULL FROM c WHERE type = 'recall_basic' AND NOT (n = 2 AND routes[2] = 'recall') OR type = 'recall_fresh' AND NOT (n = 1 AND routes[1] = 'recall') OR type = 'recall_far' AND routes[n] <> 'recall'
  UNION ALL SELECT 'answer_names', id, NULL FROM c WHERE type = 'recall_basic' UNION ALL SELECT 'far_turns', id, NULL FROM c WHERE type = 'recall_far' AND n <> 11 UNION ALL SELECT 'recall_target', id, NULL FROM c WHERE type = 'recall_far' AND target IS NULL
  UNION ALL SELECT 'repeated_query', id, NULL FROM c WHERE type = 'recall_far' AND len(list_distinct(queries)) <> n UNION ALL SELECT 'followup_shape', id, NULL FROM c WHERE type = 'followup_window' AND NOT (n = 2 AND len(gold) >= 2)
  UNION ALL SELECT 'legal_turns', id, NULL FROM c WHERE type = 'followup_window' AND len(list_filter(routes, lambda r: r <> 'legal')) > 0 UNION ALL SELECT 'two_sessions', id, NULL FROM c WHERE type = 'isolation' AND NOT (n = 2 AND sessions[1] = 'A' AND sessions[2] = 'B')
  UNION ALL SELECT 'leak_markers', id, NULL FROM c WHERE type = 'isolation' AND markers IS NULL UNION ALL SELECT 'marker_in_query', id, NULL FROM c WHERE type = 'isolation' AND markers IS NOT NULL AND NOT contains(queries[1], 'zz')
  UNION ALL SELECT 'trigger_shape', id, NULL FROM c WHERE type = 'false_trigger' AND NOT (n = 1 AND routes[1] = 'legal')""")  # fmt: skip
def dataset_rules_broken(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as cases and documents as the corpus, under all rules of cases."""
    k, turn = F.col("conv_id"), F.col("turn")
    one = lambda items, at: F.get(F.array(*[F.lit(x) for x in items]), at.cast("int"))
    route = one([*dataset_rules.ROUTES, "other"], (k + turn) % 4)
    session = F.when(turn % 5 == 4, "").otherwise(one("AB", turn % 2))
    told = F.sort_array(F.collect_list(F.struct("turn", session.alias("session"), F.col("text").alias("query"), route.alias("route"))))
    turns = F.transform(told, lambda t: F.struct(t["session"].alias("session"), t["query"].alias("query"), t["route"].alias("route")))
    gold = F.when(k % 5 > 0, F.array_distinct(F.array(k % 9 * 3, k % 4))).otherwise(F.array()).cast("array<bigint>")
    cases = S.table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select(
        F.concat(F.lit("case_"), k).alias("id"), one(dataset_rules.TYPES, k % 12).alias("type"), "turns", gold.alias("gold"), F.lit(None).cast("struct<label:string,first:bigint,last:bigint>").alias("chapter"),
        F.when(k % 3 == 0, "get_article").when(k % 3 == 1, "traverse_references").alias("first_tool"), F.lit(None).cast("array<bigint>").alias("answer_names"), F.when(k % 2 == 0, 0).alias("recall_target"), F.when(k % 4 > 1, F.array(F.lit("zz"))).alias("leak_markers"),
    )
    n = F.col("doc_id")
    corpus = S.table(spark, d, "documents").select(n.cast("long").alias("number"), F.when(n % 2 == 0, F.concat(F.lit("Điều "), n, F.lit(". x"))).otherwise("x").alias("title"), F.concat(F.lit("Điều "), n + 1).alias("content"), F.lit(None).cast("string").alias("chapter"))
    return dataset_rules.broken_rules(cases, corpus)
