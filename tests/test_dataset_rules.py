"""Each rule of the dataset: a sound case of its type, and one that breaks it alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import dataset_rules as D

CORPUS = [
    (1, "Điều 1. Một", "xem Điều 2 và Điều 30", "Chương I: Quy định chung,"), (2, "Điều 2. Hai", "không", "Chương I: Quy định chung,"), (3, "Ba", "", "Chương II: Tài sản."), (5, "Điều 5. Năm", "", "Chương II: Tài sản."), (6, "Điều 6. Sáu", "Điều 60", "Chương III:"),
]


def turns(*routes, session="A", query="Điều {} là gì"):
    return [(session, query.format(i + 1), r) for i, r in enumerate(routes)]


def case(id, type, turns, gold=(), chapter=None, tool=None, names=None, target=None, markers=None):
    return (id, type, turns, None if gold is None else list(gold), chapter, tool, names, target, markers)


GOOD = {
    "seed": case("seed", "seed", turns("legal"), [1]), "multi_hop": case("multi", "multi_hop", turns("legal"), [1, 2], tool="traverse_references"), "explicit_article": case("explicit", "explicit_article", turns("legal"), [1], tool="get_article"),
    "global": case("global", "global", [("A", "Tóm tắt QUY ĐỊNH CHUNG", "legal")], [], ("I", 1, 2), "get_community_context"), "small_talk": case("small", "small_talk", [("A", "hello", "smalltalk")]), "recall_basic": case("basic", "recall_basic", turns("legal", "recall"), names=[1]),
    "recall_fresh": case("fresh", "recall_fresh", turns("recall")), "recall_far": case("far", "recall_far", turns(*["legal"] * 10, "recall"), target=0), "followup_window": case("follow", "followup_window", turns("legal", "legal"), [1, 2]),
    "isolation": case("iso", "isolation", [("A", "mã bí mật", "legal"), ("B", "gì", "legal")], markers=["bí mật"]), "false_trigger": case("trigger", "false_trigger", turns("legal")),
}


def changed(like, **new):
    names = ["id", "type", "turns", "gold", "chapter", "first_tool", "answer_names", "recall_target", "leak_markers"]
    return tuple((dict(zip(names, GOOD[like], strict=True)) | new)[n] for n in names)


#: (case, the rules that it breaks, and at which turn)
BAD = [
    (changed("seed", id=None), [("no_id", None)]), (changed("seed", type="odd"), [("invalid_type", None)]), (changed("seed", type=None), [("invalid_type", None)]), (changed("seed", turns=[]), [("no_turns", None)]), (changed("seed", turns=None), [("no_turns", None)]),
    (changed("seed", turns=turns("other")), [("invalid_route", 0)]), (changed("recall_basic", turns=[("A", "Điều 1", "legal"), ("A", "", "recall")]), [("query_length", 1)]), (changed("seed", turns=[("A", "x" * 1001, "legal")]), [("query_length", 0)]),
    (changed("seed", turns=[("", "x", "legal")]), [("no_session", 0)]), (changed("seed", turns=[(None, "x", None)]), [("invalid_route", 0), ("no_session", 0)]), (changed("small_talk", gold=None), [("gold_missing", None)]), (changed("seed", gold=[1, 4]), [("unknown_article", None)]),
    (changed("seed", gold=[]), [("seed_shape", None)]), (changed("multi_hop", gold=[1]), [("two_gold", None), ("no_reference_edge", None)]), (changed("multi_hop", gold=[2, 3]), [("no_reference_edge", None)]), (changed("multi_hop", gold=[6, 2]), [("no_reference_edge", None)]),
    (changed("multi_hop", first_tool=None), [("first_tool", None)]), (changed("explicit_article", gold=[1, 2]), [("one_gold", None)]), (changed("explicit_article", turns=turns("legal", query="Điều 12")), [("query_names_gold", None)]),
    (changed("explicit_article", gold=[3], turns=turns("legal", query="Điều 3?")), [("corpus_title", None)]), (changed("explicit_article", first_tool="x"), [("first_tool", None)]), (changed("global", chapter=None), [("gold_chapter", None)]), (changed("global", gold=[1]), [("no_gold", None)]),
    (changed("global", first_tool="x"), [("first_tool", None)]), (changed("global", chapter=("IX", 1, 2)), [("unknown_chapter", None)]), (changed("global", chapter=("I", 1, 3)), [("chapter_span", None)]), (changed("global", chapter=("II", 3, 5), turns=[("A", "tài sản", "legal")]), [("chapter_gap", None)]),
    (changed("global", turns=turns("legal")), [("chapter_title", None)]), (changed("global", chapter=("III", 6, 6)), [("chapter_title", None)]), (changed("small_talk", turns=turns("legal")), [("small_talk_shape", None)]), (changed("recall_basic", turns=turns("legal", "legal")), [("recall_turn", None)]),
    (changed("recall_basic", answer_names=[]), [("answer_names", None)]), (changed("recall_basic", answer_names=[1, 7]), [("query_names_answer", None)]), (changed("recall_fresh", turns=turns("recall", "recall")), [("recall_turn", None)]), (changed("recall_far", turns=turns("legal", "recall")), [("far_turns", None)]),
    (changed("recall_far", turns=turns(*["legal"] * 11)), [("recall_turn", None)]), (changed("recall_far", recall_target=None), [("recall_target", None)]), (changed("recall_far", turns=[*turns(*["legal"] * 9), ("A", "Điều 1 là gì", "legal"), ("A", "x", "recall")]), [("repeated_query", None)]),
    (changed("followup_window", gold=[1]), [("followup_shape", None)]), (changed("followup_window", turns=turns("legal", "recall")), [("legal_turns", None)]), (changed("isolation", turns=[("B", "mã bí mật", "legal"), ("A", "gì", "legal")]), [("two_sessions", None)]),
    (changed("isolation", leak_markers=None), [("leak_markers", None)]), (changed("isolation", leak_markers=["bí mật", "khác"]), [("marker_in_query", None)]), (changed("false_trigger", turns=turns("recall")), [("trigger_shape", None)]),
]


def frames(spark, cases):
    return spark.createDataFrame(cases, D.CASE).withColumn("cited", F.lit("clash")), spark.createDataFrame(CORPUS, "number long, title string, content string, chapter string")


def test_sound_cases(spark):
    assert D.broken_rules(*frames(spark, list(GOOD.values()))).collect() == []


def test_each_rule(spark):
    named = [(f"c{i}" if c[0] else c[0], *c[1:]) for i, (c, _) in enumerate(BAD)]
    got = {}
    for r in D.broken_rules(*frames(spark, named)).collect():
        got.setdefault(r["subject"], []).append((r["rule"], r["turn"]))
    for case_, (_, wanted) in zip(named, BAD, strict=True):
        assert sorted(got.get(case_[0], []), key=str) == sorted(wanted, key=str), case_
    assert {r.id for r in D.RULES} <= {rule for _, rules in BAD for rule, _ in rules}


def test_routes_agree_with_the_recall_rules(spark):
    cases = [changed("recall_fresh", id="a", turns=[("A", "Tôi đã hỏi gì trước đó?", "recall")]), changed("recall_fresh", id="b", turns=[("A", "Điều 5 là gì", "recall")]), changed("false_trigger", id="c", turns=[("A", "Tôi đã hỏi gì trước đó?", "legal")])]
    got = D.broken_routes(frames(spark, cases)[0], T.recall_intent).collect()
    assert sorted(map(tuple, got)) == [("route_intent", "b", 0), ("route_intent", "c", 0)]


def test_totals(spark):
    cases, _ = frames(spark, [GOOD["seed"], GOOD["seed"], GOOD["seed"], GOOD["global"]])
    declared = spark.createDataFrame([("seed", 3), ("small_talk", 1)], "type string, n long")
    got = sorted(map(tuple, D.broken_totals(cases, declared, 5).collect()), key=str)
    assert got == sorted([("duplicate_id", "seed", None)] * 2 + [("count", "global", None), ("count", "small_talk", None), ("total", None, None)], key=str)
    assert D.broken_totals(cases, spark.createDataFrame([("seed", 3), ("global", 1)], "type string, n long"), 4).where("rule <> 'duplicate_id'").count() == 0


def test_gold_as_rows_and_dealt_by_number(spark, monkeypatch):
    from weftgraph import session
    from weftgraph.operators import evaluation

    cases = spark.createDataFrame([(1, "a", [3, 4, 5]), (2, "a", [3, 5, 5]), (2, "b", [9, None])], "case_id long, type string, gold array<long>")
    corpus = spark.createDataFrame([(3,), (4,), (5,), (5,)], "article long")
    declared = spark.createDataFrame([("a", 2)], "type string, declared long")
    wanted = sorted(map(tuple, evaluation.dataset_violations(cases, corpus, declared).collect()), key=str)
    monkeypatch.setattr(session, "TASK_ROWS", 1)
    rows = cases.selectExpr("case_id", "explode(gold) AS article")
    found = evaluation.dataset_violations(cases.drop("gold"), corpus, declared, rows)
    assert sorted(map(tuple, found.collect()), key=str) == wanted
    assert session.dealt(rows, 8, "case_id").rdd.getNumPartitions() == 8


def test_violations_gather_no_case(spark, small):
    from weftgraph.plans import registry

    plan = registry.QUERIES["dataset_violations"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
