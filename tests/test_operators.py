from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import caching, evaluation, graph, parsing, reads, search, sessions, traversal
from weftgraph.streaming import hash_chain, memory


def test_breadth_first_keeps_the_first_discoverer(spark):
    edges = spark.createDataFrame([("a", "b", "R", 1), ("a", "c", "R", 2), ("b", "d", "R", 3), ("c", "d", "R", 4), ("d", "a", "R", 5), ("d", "e", "R", 6)], "src string, dst string, type string, ord long")
    seeds = spark.createDataFrame([("a", 1)], "id string, ord long")
    found = {r["id"]: (r["depth"], r["path"]) for r in traversal.breadth_first(seeds, edges, 2).collect()}
    assert found == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "c": (1, ["a", "c"]), "d": (2, ["a", "b", "d"])}


def test_shortest_path(spark):
    rows = [("a", "b", "NEXT_ARTICLE", 1), ("b", "c", "REFERENCES", 2), ("d", "c", "NEXT_ARTICLE", 3), ("x", "y", "OTHER", 4)]
    edges = spark.createDataFrame(rows, "src string, dst string, type string, ord long")
    path = lambda a, b: [r["id"] for r in traversal.shortest_path(edges, a, b).orderBy("step").collect()]
    assert path("a", "d") == ["a", "b", "c", "d"]
    assert path("a", "a") == ["a"]
    assert path("x", "y") == []
    assert path("c", "b") == []


def test_layers_end_on_cycles(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string")
    found = {r["id"]: r["depth"] for r in traversal.layer_depths(nodes, edges, nodes.where("id = 'a'")).collect()}
    assert found["a"] == 0 and found["b"] > 0 and found["d"] == 0


def test_layers_of_a_long_chain(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    nodes = spark.createDataFrame([(i,) for i in range(53)], "id long").coalesce(1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(52)], "src long, dst long").coalesce(1)
    found = {r["id"]: r["depth"] for r in traversal.layer_depths(nodes, edges, nodes.where("id = 0")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == {i: i for i in range(53)}


def test_layer_rows(spark):
    layers = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "id string, depth int")
    edges = spark.createDataFrame([("b", "c"), ("a", "d")], "src string, dst string")
    assert {r["id"]: r["row"] for r in traversal.layer_rows(layers, edges, "id").collect()} == {"a": 0, "b": 1, "d": 0, "c": 1}


def test_next_edges_across_ranges(spark):
    rows = spark.createDataFrame([("a", 1, "p"), ("b", 7, "p"), ("c", 25, "q"), ("d", 26, None)], "id string, n long, p string")
    found = {(r["src"], r["dst"], r["same_context"]) for r in graph.next_edges(rows, "id", "n", "p", width=5).collect()}
    assert found == {("a", "b", True), ("b", "c", False), ("c", "d", False)}


def test_full_outer_upsert(spark):
    schema = "id int, a string, b string"
    out = graph.upsert_nodes(spark.createDataFrame([(1, "x", "y"), (2, "z", None)], schema), spark.createDataFrame([(2, None, "n"), (3, "q", None)], schema))
    assert sorted(map(tuple, out.collect())) == [(1, "x", "y"), (2, "z", "n"), (3, "q", None)]


def test_empty_inputs(spark):
    edges = spark.createDataFrame([], "src string, dst string, type string, ord long, weight double")
    nodes = spark.createDataFrame([], "id string, label string, name string, title string")
    assert graph.entity_graph(nodes, edges).count() == 0
    assert reads.ego_graph(nodes, edges, "a").count() == 0
    assert {r["n"] for r in graph.graph_stats(nodes, edges).collect()} == {0}
    assert traversal.breadth_first(nodes.select("id", F.lit(1).alias("ord")), edges, 2).count() == 0


def test_clauses(spark):
    rows = spark.createDataFrame([(1, "Mở đầu.\n1. một\n2. hai"), (2, "không"), (3, None)], "id long, text string")
    found = [tuple(r) for r in parsing.split_clauses(rows, "id", "text").orderBy("article_id", "place").collect()]
    assert found == [(1, 1, 1, "Mở đầu.\n1. một"), (1, 2, 2, "2. hai"), (2, 1, 1, "không"), (3, 1, 1, "")]


def test_seed_of_an_article_is_its_best_hit(spark):
    hits = spark.createDataFrame([("article_1_clause_2", 0.9, 1, ""), ("article_2", 0.8, 2, ""), ("article_1_clause_1", 0.7, 3, ""), ("other", 0.6, 4, "")], "id string, score double, rank int, title string")
    articles = spark.createDataFrame([("article_1", "One", "N/A")], "id string, title string, part string")
    rows = search.seed_articles(hits, articles, 3).orderBy("rank").collect()
    assert [(r["article_id"], r["matched_entity_id"], r["score"], r["title"], r["part"]) for r in rows] == [("article_1", "article_1_clause_2", 0.9, "One", "N/A"), ("article_2", "article_2", 0.8, "", "N/A")]


def test_vector_ties_go_by_id(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in (3, 1, 2)], "id int, vector array<double>")
    assert [r["id"] for r in search.vector_top_k(rows, [2.0, 0.0], 2).collect()] == [1, 2]


def test_batch_top_k_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id int, vector array<double>")
    queries = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    whole = sorted(map(tuple, search.vector_top_k_batch(rows, queries, 3).collect()))
    assert whole == sorted(map(tuple, search.vector_top_k_batch(rows, queries, 3, most_queries=4).collect()))


@pytest.mark.parametrize(("k", "n", "low", "high"), [(5, 10, 0.2366, 0.7634), (0, 30, 0.0, 0.1135)])
def test_wilson(spark, k, n, low, high):
    a, b = evaluation.wilson(F.lit(k), F.lit(n))
    row = spark.range(1).select(F.round(a, 4), F.round(b, 4)).first()
    assert tuple(row) == (low, high)


def test_percentiles(spark):
    r = spark.range(1, 21).agg(evaluation.nearest_rank("id", 0.95).alias("p")).first()
    assert r["p"] == 19
    r = spark.createDataFrame([(x,) for x in (10, 20, 30, 40, 50)], "x int").agg(evaluation.nearest_rank("x", 0.5).alias("p")).first()
    assert r["p"] == 30


def test_chain_finds_every_edit(spark):
    rows = spark.createDataFrame([("s", i, f"body {i}") for i in range(1, 7)], "session_id string, seq long, body string")
    sealed = hash_chain.seal(rows)
    assert tuple(sessions.verify_chain(sealed).first()) == ("s", 6, None)
    for i in range(1, 7):
        changed = sealed.withColumn("body", F.when(F.col("seq") == i, "forged").otherwise(F.col("body")))
        assert tuple(sessions.verify_chain(changed).first()) == ("s", i - 1, i)


def test_log_rules(spark):
    schema = "session_id string, run_id string, seq long, kind string, content string"
    rows = [("s", None, 1, "session_created", ""), ("s", "r", 2, "answer", ""), ("s", "q", 3, "query", ""), ("s", "q", 4, "query", ""), ("s", "q", 6, "deleted", ""), ("s", "q", 7, "step", "")]
    rows += [("t", "r", 1, "query", ""), ("t", None, 2, "query", ""), ("t", "r", 3, "error", ""), ("t", "r", 4, "llm_call", ""), ("t", None, 5, "session_created", "")]
    found = {tuple(r) for r in sessions.log_violations(spark.createDataFrame(rows, schema)).collect()}
    assert found == {
        ("s", 2, "without_query"), ("s", 4, "repeated_query"), ("s", 6, "seq_gap"), ("s", 7, "seq_gap"), ("s", 7, "after_deleted"),
        ("t", 1, "first_not_created"), ("t", 2, "repeated_query"), ("t", 4, "without_query"), ("t", 5, "created_not_first"),
    }


def test_valid_log_has_no_violation(spark):
    kinds = [(None, "session_created"), ("a", "query"), ("a", "llm_call"), ("a", "step"), ("a", "answer"), ("b", "query"), ("b", "error"), (None, "deleted")]
    log = spark.createDataFrame([("s", r, i, k, "x") for i, (r, k) in enumerate(kinds, 1)], "session_id string, run_id string, seq long, kind string, body string")
    sealed = log.drop("body").join(hash_chain.seal(log), ["session_id", "seq"])
    assert sessions.log_violations(sealed).count() == 0
    forged = sealed.withColumn("prev_hash", F.when(F.col("seq") == 3, "f" * 64).otherwise(F.col("prev_hash")))
    assert [tuple(r) for r in sessions.log_violations(forged).collect()] == [("s", 3, "broken_link")]


def test_recall_of_first_recent_and_topical_keys(spark):
    turns = spark.createDataFrame([("s", f"r{i}", i, f"hợp đồng số {i}", "tài sản" if i % 2 else " ") for i in range(5)], "session_id string, run_id string, seq long, query string, answer string")
    names = lambda key, **more: [(r["run_id"], r["kind"]) for r in sessions.recall(turns, key, **more).orderBy("rank").collect()]
    assert names("câu hỏi đầu tiên của tôi", run_id="r0") == [("r1", "query"), ("r2", "query"), ("r3", "query")]
    assert names("lúc nãy tôi nói gì", most=2) == [("r4", "query"), ("r3", "query")]
    assert names("tài sản") == [("r3", "answer"), ("r1", "answer")]
    assert names("ta\u0300i sa\u0309n") == [("r3", "answer"), ("r1", "answer")]


def test_titles_and_matches_are_nfc(spark):
    rows = spark.createDataFrame([("s", "r", 1, "query", "Ta\u0300i  sa\u0309n", "t")], "session_id string, run_id string, seq long, kind string, content string, created_at string")
    assert sessions.fold_sessions(rows).first()["title"] == "Tài sản"
    assert sessions.match_records(rows, text="TÀI").count() == 1


def test_cost_counts_turns(spark):
    turns = spark.createDataFrame([(1, "legal"), (1, "recall"), (2, "other"), (3, None)], "case_id int, route string")
    assert tuple(evaluation.cost_estimate(turns, steps=6, legacy_calls=2).first()) == (3, 4, 1, 1, 2, 2, (7 + 2 + 2) * 7000 + 5000)


def test_window_of_twelve_turns():
    limits = memory.Limits()
    window = memory.Window()
    for i in range(12):
        assert window.add(f"r{i}", f"q{i}", f"a{i}", limits)
    assert not window.add("r11", "q", "a", limits) and not window.add("x", "q", " ", limits)
    assert (len(window.recent), window.older_turns) == (8, 4)
    assert window.tail == ["Assistant: a2", "User: q3", "Assistant: a3"]


def test_window_budgets():
    limits = memory.Limits(max_turns=8, max_tokens=20, history_tokens=40)
    window = memory.Window()
    for i in range(9):
        window.add(f"r{i}", f"question {i} " * 4, "answer " * 9, limits)
        assert window._size() <= 20
    assert memory.tokens.count(window.summary(limits)) <= 40
    assert "earlier lines condensed out" in window.summary(limits)


def test_window_batch_equals_stream(spark, tmp_path):
    rows = [(f"s{i % 3}", f"r{i}", i, f"question {i}", f"answer {i}") for i in range(30)]
    schema = "session_id string, run_id string, seq long, query string, answer string"
    turns = spark.createDataFrame(rows, schema)
    batch = {r["session_id"]: tuple(r) for r in memory.windows(turns).collect()}
    turns.where("seq < 15").coalesce(1).write.parquet(str(tmp_path / "in"))
    turns.where("seq >= 15").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = memory.window_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("update").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {}
    for r in spark.table("windows").collect():
        if r["older"] + r["kept"] >= sum(last.get(r["session_id"], (0, 0, 0))[1:3]):
            last[r["session_id"]] = tuple(r)
    assert last == batch


def test_tool_calls(spark):
    from weftgraph.operators.tools import judged_calls

    rows = [("r", 1, "search", '{"query": "x"}'), ("r", 2, "search", "{}"), ("r", 3, "other", "{}"), ("r", 4, "search", "nothing"), ("r", 5, "search", '{"query": "y"}'), ("q", 1, "search", '{"query": 5}')]
    out = judged_calls(spark.createDataFrame(rows, "run_id string, seq int, tool string, args string"), {"search": ("query",)}, 4)
    found = {(r["run_id"], r["seq"]): r["refusal"] for r in out.collect()}
    assert found == {("r", 1): None, ("r", 2): "invalid arguments", ("r", 3): "unknown tool", ("r", 4): "invalid arguments", ("r", 5): "over budget", ("q", 1): None}


def test_hashing_embedder(spark):
    from weftgraph.functions.embedding import hashing_embedder

    rows = spark.createDataFrame([("a b c",), ("A  b c",), ("",), (None,)], "t string").select(hashing_embedder(16)("t").alias("v")).collect()
    assert rows[0]["v"] == rows[1]["v"] and sum(x * x for x in rows[0]["v"]) == pytest.approx(1)
    assert rows[2]["v"] == [0.0] * 16 and rows[3]["v"] is None


def test_upsert_of_a_key_twice_in_a_batch(spark):
    stored = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, name string, n int")
    batch = spark.createDataFrame([("a", "new", None, 1), ("a", "newer", 5, 2), ("a", None, None, 3), ("c", "z", 7, 1)], "id string, name string, n int, ord int")
    assert sorted(map(tuple, graph.upsert_nodes(stored, batch).collect())) == [("a", "newer", 5), ("b", "y", 2), ("c", "z", 7)]


def test_numbers_of_a_hot_group_across_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.lit(None).cast("string")).when(F.col("id") % 50 == 1, "b").otherwise("a").alias("g"), (5000 - F.col("id")).alias("n"))
    found = traversal.numbered(rows, ["g"], ["n"], "i")
    assert found.columns == ["g", "n", "i"]
    want = {}
    for n in range(1, 5001):
        want.setdefault(None if (5000 - n) % 50 == 0 else "b" if (5000 - n) % 50 == 1 else "a", []).append(n)
    got = {(r["g"], r["n"]): r["i"] for r in found.collect()}
    assert got == {(g, n): i for g, ns in want.items() for i, n in enumerate(ns)}


def test_ranking_ties_go_by_id(spark):
    docs = spark.createDataFrame([(3, ["aa", "bb"]), (1, ["aa", "bb"]), (2, ["aa", "aa"]), (4, ["cc"]), (5, None)], "id long, tokens array<string>")
    queries = spark.createDataFrame([(7, ["aa", "zz", "aa"]), (8, [])], "query_id long, tokens array<string>")
    found = search.ranked(search.bm25(docs, queries, "id"), 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["rank"]) for r in found] == [(7, 2, 1), (7, 1, 2)]


def test_ranking_is_of_every_item(spark, small):
    from weftgraph.plans import catalog_search

    items = {r["item_id"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    assert {r["query_id"] for r in catalog_search.bm25_ranking(spark, small).collect()} == items


def test_case_types(spark):
    step = "struct<kind:string,tool:string,tool_input:string,content:string,citations:array<struct<article:int,breadcrumb:array<string>>>>"
    call = lambda tool, arguments: ("action", tool, arguments, "", None)
    saw = lambda text, *cited: ("observation", None, None, text, [(n, []) for n in cited])
    asked = ["Điều 5 nói gì về tài sản?", "tôi đã hỏi gì?"]
    cases = spark.createDataFrame(
        [
            ("basic", "recall_basic", asked, [], None, None, [5], [], None), ("fresh", "recall_fresh", ["a"], [], None, None, [], [], None), ("made_up", "recall_fresh", ["b"], [], None, None, [], [], None),
            ("leaky", "isolation", ["secret of A", "x"], [], None, None, [], ["Mark"], None), ("failed", "seed", ["q"], [5], None, None, [], [], None), ("missing", "seed", ["q"], [5], None, None, [], [], None),
            ("chapter", "global", ["q"], [], ("V", 10, 20), "get_community_context", [], [], None), ("empty", "small_talk", ["hi"], [], None, None, [], [], None),
        ],
        "case_id string, type string, queries array<string>, gold array<int>, chapter struct<label:string,first:int,last:int>, expected_first_tool string, answer_names array<int>, leaks array<string>, target_turn int",
    )
    fresh = [call("recall_session", '{"key": "all"}'), saw("Chưa có nội dung nào  trước đó.")]
    turns = spark.createDataFrame(
        [
            ("basic", 0, True, "Điều 5", []), ("basic", 1, True, "Bạn hỏi về điều 5", [call("recall_session", '{"key": ""}'), saw("1. điều 5 NÓI gì về tài sản?")]),
            ("fresh", 0, True, "Chưa có câu hỏi nào.", fresh), ("made_up", 0, True, "You  asked about houses", fresh),
            ("leaky", 0, True, "", []), ("leaky", 1, True, "a mark", [call("get_article", '{"article_number": "5"}')]), ("failed", 0, False, None, None),
            ("chapter", 0, True, "x", [call("get_community_context", '{"query": "q"}'), saw("", 15)]), ("empty", 0, True, None, None),
        ],
        f"case_id string, turn int, ok boolean, answer string, steps array<{step}>",
    )
    found = {r["case_id"]: r.asDict() for r in evaluation.case_scores(cases, turns, 1).collect()}
    assert len(found) == 8
    assert found["basic"]["recall_ok"] and found["basic"]["invalid_calls"] == 1
    assert found["fresh"]["recall_ok"] and not found["fresh"]["fabricated"]
    assert found["made_up"]["fabricated"] and not found["made_up"]["recall_ok"]
    assert found["leaky"]["isolation_leak"] and not found["leaky"]["isolation_exercised"] and found["leaky"]["invalid_calls"] == 1
    assert all(found[x]["errored"] and found[x]["gold_hit"] is None for x in ("failed", "missing"))
    assert found["chapter"]["gold_hit"] and found["chapter"]["citation_recall"] == 1 and found["chapter"]["tool_choice_ok"] and not found["chapter"]["budget_exhausted"]
    assert not found["empty"]["errored"] and found["empty"]["recall_ok"] is None


def test_cache_by_age_and_size(spark):
    now = [0]
    cache = caching.TtlCache("path", lambda: now[0])
    cache.most = 2
    for key in "ab":
        now[0] += 1
        cache.set(key, key)
    cache.set("c", "c")
    assert cache.get("a") is None and cache.get("b") == "b" and cache.get("c") == "c"
    now[0] += cache.ttl
    assert cache.get("b") == "b"
    now[0] += 1
    assert cache.get("b") is None and cache.stats() == {"hits": 3, "misses": 2, "hit_rate": 0.6}
    log = [("a", 0, 1, "get"), ("a", 1, 2, "set"), ("a", 11, 3, "get"), ("a", 12, 4, "get"), ("b", 1, 5, "set"), ("b", 2, 6, "delete"), ("b", 3, 7, "get"), (None, 1, 8, "set"), (None, 1, 9, "get")]
    found = caching.replay(spark.createDataFrame(log, "key string, at long, ord int, op string"), 10)
    assert {r["ord"]: r["hit"] for r in found.collect()} == {1: False, 3: True, 4: False, 7: False, 9: True}


def test_fill_down_over_ranges(spark):
    """Against a loop, for a corpus of one group and for several."""
    rng = random.Random(3)
    some = lambda p, values: rng.choice(values) if rng.random() < p else None
    rows = [(i, i // 150, some(0.05, ["P1", "P2"]), some(0.1, ["C1", "C2", "C3"]), some(0.2, ["S1", "S2", ""]), some(0.2, ["T1", ""])) for i in range(600)]
    articles = spark.createDataFrame(rows, "pos long, doc int, part string, chapter string, section string, subsection string").repartition(3)
    for group in (None, ["doc"]):
        wanted, now, doc = {}, [None, None, "", ""], 0
        for pos, d, part, chapter, section, subsection in rows:
            if group and d != doc:
                now, doc = [None, None, "", ""], d
            was = list(now)
            if part is not None and part != now[0]:
                now = [part, None, "", ""]
            name = chapter if chapter is not None else now[1] if now[1] is not None else parsing.UNSORTED_CHAPTER if now[0] else None
            if name != now[1] and not (was[0] == now[0] and was[1] == name):
                now[2] = now[3] = ""
            now[1] = name
            now[2] = section if section is not None else now[2]
            now[3] = subsection if subsection is not None else now[3]
            wanted[pos] = tuple(now)
        out = parsing.fill_down(articles, "pos", group)
        assert out.columns == [*articles.columns, "part_name", "chapter_name", "section_name", "subsection_name"]
        assert {r["pos"]: tuple(r)[-4:] for r in out.collect()} == wanted


def test_relations_in_the_order_of_a_locale(spark):
    names = {"a": "Ấn", "b": "Đà", "c": "An", "d": "Da", "e": "Ăn", "f": "Dz", "g": None}
    relations = spark.createDataFrame([(x, "z", t) for x in names for t in ("ĐI", "an")], "src string, dst string, type string")
    labels = spark.createDataFrame(list(names.items()), "id string, label string")
    rows = [r for n in (1, 2, 3) for r in reads.relation_page(relations, labels, n, 5).collect()]
    assert [(r["type"], r["src"]) for r in rows] == [(t, s) for t in ("an", "ĐI") for s in "cead" + "fbg"]
    out = reads.collated(labels, ["label"])
    assert "collate" in out.schema["label"].dataType.simpleString() and out.orderBy("label").where("label > 'Dy'").count() == 2


def test_children_are_numbered_by_first_appearance(spark):
    rows = [("p", f"c{i % 7}", i) for i in range(40)] + [("q", "x", 3), ("q", "a", 3), (None, "n", 1)]
    found = graph.containment_edges(spark.createDataFrame(rows, "parent string, child string, pos long").repartition(4), "parent", "child", "pos", "HAS").collect()
    assert sorted(((r["src"] or "", r["ord"], r["dst"]) for r in found)) == sorted([("p", i + 1, f"c{i}") for i in range(7)] + [("q", 1, "a"), ("q", 2, "x"), ("", 1, "n")])


def test_quoted_queries_of_long_answers(spark):
    asked = "what is the meaning of this"
    answers = spark.createDataFrame([(1, "x" * 5000 + " " + asked.upper()), (2, "what is the  meaning of that"), (3, asked[:20]), (4, None)], "case_id int, answer string")
    queries = spark.createDataFrame([(asked,), ("short",), (asked,)], "query string")
    assert [r["case_id"] for r in evaluation.quoted_queries(answers, queries).collect()] == [1]


def test_an_article_of_a_chapter_by_seed(spark):
    articles = spark.createDataFrame([(f"a{i}",) for i in range(30)], "id string")
    edges = spark.createDataFrame([(f"a{i}", "chapter_p1_c2" if i % 3 else "chapter_p1_c1", "BELONGS_TO_CHAPTER") for i in range(30)] + [("a0", "chapter_p1_c2", "REFERENCES")], "src string, dst string, type string")
    found = {reads.random_article(articles, edges, "p1_c2", seed).first()["id"] for seed in range(12)}
    assert len(found) > 3 and all(int(x[1:]) % 3 for x in found)
    assert reads.random_article(articles, edges, "p1_c2", 5).first() == reads.random_article(articles, edges, "p1_c2", 5).first()
    assert reads.random_article(articles, edges, "nowhere").count() == 0


def test_references_in_queue_order(spark):
    edges = spark.createDataFrame([("a", "c", "REFERENCES", 1), ("a", "b", "REFERENCES", 2), ("b", "d", "REFERENCES", 1), ("c", "e", "REFERENCES", 9), ("c", "gone", "REFERENCES", 1), ("a", "x", "OTHER", 0), ("e", "f", "REFERENCES", 1)], "src string, dst string, type string, ord long")
    articles = spark.createDataFrame([(x,) for x in "abcdefx"], "id string")
    seeds = spark.createDataFrame([("a", 1)], "id string, ord long")
    rows = traversal.traverse_references(seeds, edges, articles).collect()
    assert [(r["id"], r["depth"], r["path"]) for r in rows] == [("a", 0, ["a"]), ("c", 1, ["a", "c"]), ("b", 1, ["a", "b"]), ("e", 2, ["a", "c", "e"]), ("d", 2, ["a", "b", "d"])]
    assert [r["id"] for r in traversal.traverse_references(seeds, edges, articles, most=2).collect()] == ["a", "c"]


def test_memory_of_failed_runs(spark):
    """An error's text is no answer: it enters neither a window nor a recall."""
    rows = [("s", None, 1, "session_created", "", None), ("s", "r1", 2, "query", "first thing", None), ("s", "r1", 3, "error", "boom secret", None), ("s", "r2", 4, "query", "second thing", None), ("s", "r2", 5, "answer", "fine answer", True), ("s", "r3", 6, "query", "open", None)]
    turns = sessions.build_turns(spark.createDataFrame(rows, "session_id string, run_id string, seq long, kind string, content string, ok boolean"))
    assert sorted((r["run_id"], r["answer"], r["ok"]) for r in turns.collect()) == [("r1", "", False), ("r2", "fine answer", True)]
    window = memory.windows(turns)
    assert [(r["kept"], r["first_run"]) for r in window.collect()] == [(1, "r2")]
    assert sessions.recall(turns, "boom secret").count() == 0
    calls = spark.createDataFrame([(2, 1), (1, 0), (0, 0)], "others int, items int")
    stats = memory.memory_stats(window, calls).first()
    assert (stats["sessions"], stats["turns"], stats["recall_calls"], stats["recall_hits"], stats["recall_empty"]) == (1, 1, 3, 1, 2)
    with pytest.raises(Exception, match="answer without ok"):
        sessions.build_turns(spark.createDataFrame([*rows[:4], ("s", "r2", 5, "answer", "x", None)], "session_id string, run_id string, seq long, kind string, content string, ok boolean")).collect()


def test_contexts_of_articles(spark):
    requests = spark.createDataFrame([("article_1", 1), ("article_1", 9), ("article_2", 0), ("article_3", 1), ("x", 1), ("article_4", 2), (None, None)], "article_id string, level int")
    articles = spark.createDataFrame([("article_1",), ("article_2",), ("article_4",), ("x",)], "id string")
    community = "array<struct<id:string,title:string,summary:string,entity_ids:array<string>>>"
    answers = [("article_1", 1, "nói về chương\tII tài sản\nMục 4: a > b", []), ("article_2", 0, "ignored", [("c", "Phần A", "S", ["e", "f"]), ("d", "Chương B", "", None)]), ("article_4", 2, None, [("c", None, None, None)]), ("article_3", 1, "x", None), ("x", 1, "x", None)]
    out = search.community_contexts(requests, articles, spark.createDataFrame(answers, f"article_id string, level int, response string, communities {community}")).collect()
    got = {(r["article_id"], r["level"]): r["context"] for r in out}
    one = got["article_1", 1]
    assert (one["part"]["name"], one["chapter"]["name"], one["section"]["name"], one["subsection"], one["hierarchical_context"], one["article_count"]) == ("QUY ĐỊNH CHUNG", "II tài sản", "4: a ", None, "II tài sản > 4: a ", 1)
    assert got["article_1", 9] == one and len(out) == 7
    two = got["article_2", 0]
    assert (two["part"]["name"], two["part"]["article_count"], two["chapter"]["name"], two["principles"], two["hierarchical_context"]) == ("Phần A", 2, "", "S", "Phần A > Chương B")
    assert all(got[k]["part"]["name"] == "" and got[k]["article_count"] == 0 for k in (("article_3", 1), ("x", 1), (None, None), ("article_4", 2)))


def test_first_reports(spark):
    reports = spark.createDataFrame([("a", 2), ("b", 1), ("a", 9), ("c", 4), ("d", 3)], "id string, rank int")
    assert [tuple(r) for r in search.linked_reports(reports).collect()] == [("b", 1), ("a", 2), ("d", 3)]
    assert search.linked_reports(None) is None


def test_pages_hold_all_rows(spark):
    rows = spark.createDataFrame([(i * 7919 % 1009, None if i % 50 == 0 else "x") for i in range(1009)], "n int, t string").repartition(5)
    got = sorted((r["page"], r["place"], r["n"]) for r in reads.paged(rows, ["n"], 10).collect())
    assert got == [(i // 10 + 1, i % 10, i) for i in range(1009)]
    assert reads.paged(rows.limit(0), ["n"], 10).count() == 0
