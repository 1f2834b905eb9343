"""Functions of texts run on few rows at a time, whatever the table's size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import privacy, text, tokens


@pytest.mark.parametrize("function", [text.nfc, text.folded, privacy.redact, privacy.canonical, tokens.cap_tokens(3), tokens.cap_observation(3), lambda c: privacy.masked_json(F.col(c), "masked")])
def test_no_arrow_batches(spark, function):
    rows = spark.createDataFrame([('"É đ a@b.vn"',), (None,)], "t string").select(function("t").alias("t"))
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r["t"] is None for r in rows.collect()] == [False, True]


def test_values(spark):
    rows = spark.createDataFrame([("É Đo gọi 0912345678",)], "t string")
    r = rows.select(text.nfc("t").alias("n"), text.folded("t").alias("f"), privacy.redact("t").alias("r"), tokens.cap_tokens(1)("t").alias("c")).first()
    assert tuple(r) == ("É Đo gọi 0912345678", "e do goi 0912345678", "É Đo gọi [phone]", "É ")
