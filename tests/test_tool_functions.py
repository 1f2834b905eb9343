"""Tools called from SQL, against the same in DataFrame functions and by hand."""

from __future__ import annotations

import json

import pytest

from weftgraph.operators import tool_functions, tools

REQUIRED = {"get_article": ("id",), "search": ("query", "limit")}
CALLS = [
    ("r1", 1, "get_article", '{"id": "a1"}', "x"), ("r1", 2, "get_article", '{"id": ""}', None), ("r1", 3, "other", "{}", "x"), ("r1", 4, "search", '{"query": "q", "limit": 3}', "x"), ("r2", 1, "search", '{"query": "q"}', "x"),
    ("r2", 2, "search", "no json", "x"), ("r2", 3, "get_article", None, "x"), ("r2", 9, "get_article", '["id"]', "x"), (None, 1, "get_article", '{"id": "b"}', "x"), ("r3", 5, None, "{}", "x"),
]


@pytest.fixture(scope="module")
def calls(spark):
    tool_functions.register(spark)
    df = spark.createDataFrame(CALLS, "run_id string, seq long, tool string, args string, extra string").repartition(3)
    df.createOrReplaceTempView("calls")
    return df


@pytest.mark.parametrize("budget", [3, 100])
def test_calls_from_sql(spark, calls, budget):
    required = json.dumps(REQUIRED)
    got = spark.sql(f"SELECT * FROM judge_calls(TABLE(calls), {budget}, '{required}')")
    assert got.columns == ["run_id", "seq", "tool", "args", "extra", "refusal"]
    wanted = {(r["run_id"], r["seq"]): r["refusal"] for r in tools.judged_calls(calls.where("tool is not null"), REQUIRED, budget).collect()}
    rows = {(r["run_id"], r["seq"]): r["refusal"] for r in got.collect()}
    assert rows.pop(("r3", 5)) == "unknown tool" and rows == wanted
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan  # each run's calls come together


def test_wrong_uses_are_refused(spark, calls):
    for query in ("SELECT * FROM judge_calls(TABLE(SELECT run_id, seq FROM calls), 3, '{}')", "SELECT * FROM judge_calls(TABLE(calls), rand(), '{}')", "SELECT * FROM cited_articles(5)"):
        with pytest.raises(Exception, match="judge_calls takes a table|must be constants|takes a text"):
            spark.sql(query).collect()


def test_lateral_join(spark, calls):
    texts = [(1, "Theo khoản 2, Khoản 3 Điều 5 và điều 7; khoản 1 Điều 5."), (2, None), (3, "không"), (4, "khoản 9")]
    spark.createDataFrame(texts, "id int, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, place, article, clauses FROM texts, LATERAL cited_articles(text) ORDER BY id, place").collect()
    assert [tuple(r) for r in got] == [(1, 0, 5, [2, 3, 1]), (1, 1, 7, [])]
    both = spark.sql("SELECT run_id, article FROM judge_calls(TABLE(calls), 9, '{\"get_article\": [\"id\"]}') c, LATERAL cited_articles(concat('Điều ', c.seq)) WHERE refusal IS NULL").collect()
    assert sorted((r["run_id"] or "", r["article"]) for r in both) == [("", 1), ("r1", 1)]
