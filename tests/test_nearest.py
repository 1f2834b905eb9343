"""Nearest rows by products of blocks: the ranks and scores that scoring each pair gives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import vectors as V
from weftgraph.operators import nearest, search


def by_pairs(rows, queries, k):
    scored = rows.crossJoin(queries).select("query_id", "id", V.cosine(F.col("vector"), F.col("query")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def plain(df):
    return sorted((r["query_id"], r["rank"], r["id"], str(r["score"])) for r in df.collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ranks_and_scores_to_the_last_bit(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "TASK_PAIRS", 500)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 7)) * 10.0 ** rng.integers(-3, 3, (300, 1))
    x[100:180] = x[7]  # many equal ones
    x[180:200] = 3 * x[8]  # of one direction
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(400, None), (401, [0.0] * 7), (402, [0.0] * 7), (403, [1.0] * 3), (404, [float("nan")] * 7), (405, [float("inf")] + [1.0] * 6), (406, [1e-160] * 7), (407, [None] * 7)]
    table = spark.createDataFrame(rows, "id long, vector array<double>").select(F.col("id").cast(kind), "vector").repartition(4)
    asked = spark.createDataFrame([(i, v) for i, v in rows if i in (0, 7, 8, 9, 150, 190, 400, 401, 403, 404, 406)], "query_id long, query array<double>")
    assert plain(search.vector_top_k_batch(table, asked, 10, most_queries=4)) == plain(by_pairs(table, asked, 10))


def test_few_rows_and_none(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    assert plain(search.vector_top_k_batch(rows, asked, 5)) == plain(by_pairs(rows, asked, 5))
    assert search.vector_top_k_batch(rows, asked.limit(0), 5).count() == search.vector_top_k_batch(rows.limit(0), asked, 5).count() == 0


def test_pairs_are_not_rows_of_the_plan(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "id long, vector array<double>")
    found = search.vector_top_k_batch(rows, rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 2)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
