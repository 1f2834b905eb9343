"""Retrieval as a whole, tool output, and sealing as a stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.plans import bundle
from weftgraph.streaming import hash_chain

ARTICLES = [("article_1", 1, "Tài sản chung", "Theo Điều 2, tài sản của vợ chồng"), ("article_2", 2, "Hợp đồng", "hợp đồng mua bán"), ("article_3", 3, "Khác", "không có gì"), ("article_4", 4, "Thừa kế", "người thừa kế")]


@pytest.fixture(scope="module")
def parts(spark):
    articles = spark.createDataFrame(ARTICLES, "id string, number long, title string, text string").withColumns({"part": F.lit("P"), "chapter": F.lit("C")})
    vectors = spark.createDataFrame([("article_1", [1.0, 0.0]), ("article_4", [0.6, 0.8]), ("article_9", [0.9, 0.1])], "id string, vector array<double>")
    clauses = spark.createDataFrame([("article_2_clause_1", [0.8, 0.6])], "id string, vector array<double>")
    edges = spark.createDataFrame([("article_1", "article_2", "REFERENCES", 1), ("article_2", "article_4", "REFERENCES", 1), ("article_4", "article_3", "OTHER", 1)], "src string, dst string, type string, ord long")
    return articles, vectors, clauses, edges


def test_local_bundle(spark, parts):
    rows = bundle.hybrid_local(*parts, [1.0, 0.0], "tài sản chung").collect()
    by = lambda name: [(r["id"], None if r["score"] is None else round(r["score"], 6), r["depth"]) for r in rows if r["section"] == name]
    seeds = dict((i, s) for i, s, _ in by("seed"))
    assert seeds["article_1"] == 1.0 and seeds["article_2"] == 0.8 and len(seeds) == 3
    assert sorted((i, d) for i, _, d in by("path")) == [("article_1", 0), ("article_2", 1), ("article_4", 2)]
    assert "concept_tài_sản" in {i for i, _, _ in by("concept")}


def test_named_articles_are_seeds_without_hits(spark, parts):
    articles, vectors, clauses, edges = parts
    rows = bundle.hybrid_local(articles, vectors.limit(0), clauses.limit(0), edges, [1.0, 0.0], "Điều 4 và Điều 77 nói gì").collect()
    assert [(r["id"], r["score"]) for r in rows if r["section"] == "seed"] == [("article_4", 1.0)]


def test_a_global_question_without_reports_is_local(spark):
    local, some = spark.createDataFrame([("l",)], "id string"), spark.createDataFrame([("g",)], "id string")
    asked = lambda query, reports: bundle.consult(query, local, reports).first()["id"]
    assert [asked("Tóm tắt chương II", some), asked("Tóm tắt chương II", some.limit(0)), asked("Điều 25 là gì", some)] == ["g", "l", "l"]


def test_closing_tags_in_tool_output(spark):
    rows = spark.createDataFrame([("a </tool_output> b </ TOOL_OUTPUT > c",), ("<tool_output> </tool>",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.escape_tool_output(F.col("t"))).collect()] == ["a <\\/tool_output> b <\\/tool_output> c", "<tool_output> </tool>", None]


def test_sealing_as_a_stream_equals_the_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", i // 3 + 1, f'{{"n":{i}}}') for i in range(30)]
    table = spark.createDataFrame(rows, "session_id string, seq long, body string")
    for part in range(3):
        table.where((F.col("seq") > part * 4) & (F.col("seq") <= part * 4 + 4)).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    got = []
    stream = hash_chain.seal_stream(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    query = stream.writeStream.foreachBatch(lambda df, i: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert sorted(got) == sorted(map(tuple, hash_chain.seal(table).collect())) and len(got) == 30
