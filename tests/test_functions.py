from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import privacy, tokens
from weftgraph.functions import text as T
from weftgraph.functions.lexicons import roman_numerals


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "out"), [
    ("Gửi nguyễna@x.vn nhé", "Gửi [email] nhé"),
    ("Gọi 0912 345 678", "Gọi [phone]"),
    ("+84 (0)912-345-678", "[phone]"),
    ("CMND 123456789", "CMND [id]"),
    ("012345678901", "[id]"),
    ("STK 1234-5678-9012", "STK [account]"),
    ("0912 345 678 9", "[account]"),
    ("ngày 01-02-2024", "ngày 01-02-2024"),
    ("2019 2020 2021", "2019 2020 2021"),
    ("1000000000 đồng", "1000000000 đồng"),
    ("số 1234567", "số 1234567"),
])
def test_redaction(text, out):
    assert privacy.redact_text(text) == out


def test_mask_modes():
    value = {"a": "x@y.vn", "b": [1, "z"], "c": True}
    assert privacy.mask(value, "full") == value
    assert privacy.mask(value, "masked") == {"a": "[email]", "b": [1, "z"], "c": True}
    assert privacy.mask(value, "metadata_only") == "[redacted]"
    assert privacy.mask(3, "metadata_only") == 3


def test_canonical_json():
    assert privacy.canonical_json(json.loads('{"b": 1.0, "a": [1e21, 0.5, null, "é"]}')) == '{"a":[1e+21,0.5,null,"é"],"b":1}'
    with pytest.raises(ValueError):
        privacy.canonical_json(float("nan"))


def test_tokens():
    assert tokens.count("") == 0
    assert tokens.count("one two three") == 4
    assert tokens.count("a b c d e f") == 6
    text = "word " * 100
    cut = tokens.cap(text, 10)
    assert tokens.count(cut) <= 10 < tokens.count(text[: len(cut) + 1])
    assert tokens.cap(text, 0) == ""
    assert tokens.observation(text, 20).endswith("[truncated]")


def test_token_columns(spark):
    for text in ("", "one two three", "a\U0001f600 b", "  x  "):
        assert one(spark, T.count_tokens, text) == tokens.count(text)


def test_roman_numerals():
    table = roman_numerals()
    assert len(table) == 40
    assert (table["IV"], table["XXXIX"], table["XL"]) == (4, 39, 40)


@pytest.mark.parametrize(("name", "number"), [("Chương chưa phân loại", 0), ("chương xii", 12), ("Chương 7", 7), ("Phần 1", None), ("Chương LX", 0)])
def test_chapter_number(spark, name, number):
    assert one(spark, T.chapter_number, name) == number


@pytest.mark.parametrize(("name", "number"), [("Phần thứ nhất", 1), ("PHẦN THỨ 3", 3), ("phần 5", 5), ("x", 0), ("", 0), (None, 0)])
def test_part_number(spark, name, number):
    assert one(spark, T.part_number, name) == number


def test_vectors(spark):
    from weftgraph.functions import vectors as V

    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [float("nan"), 1.0])], "a array<double>, z array<double>, n array<double>").select(
        V.l2_normalized(F.col("a")).alias("unit"), V.l2_normalized(F.col("z")).alias("zero"), V.problem(F.col("z"), 2).alias("pz"), V.problem(F.col("n"), 2).alias("pn"),
        V.problem(F.col("a"), 3).alias("pl"), V.problem(F.col("a"), 2).alias("ok"), V.cosine(F.col("a"), F.col("z")).alias("none"),
    ).first()
    assert row.asDict() == {"unit": [0.6, 0.8], "zero": [0.0, 0.0], "pz": "zero", "pn": "not finite", "pl": "length", "ok": None, "none": None}


@pytest.mark.parametrize(("text", "recall"), [
    ("Tôi đã hỏi gì trước đó?", True), ("Bạn nhắc lại giúp", True), ("Câu hỏi đầu tư là gì", False), ("Tôi đã báo cho công ty 30 ngày trước đó.", False), ("do you remember", True), ("first question", True),
])
def test_recall_intent(spark, text, recall):
    assert one(spark, T.recall_intent, text) is recall


def test_headings(spark):
    text = "# A\n1. Pháp luật áp dụng\n---\n```\n**2. Điều kiện**\nplain"
    assert one(spark, T.section_count, text) == 3


def test_rules_of_keys(spark):
    rows = spark.createDataFrame([("article_12", "q", 0.0), ("article_", " \n\u00a0", 1.5), ("xarticle_1", "x" * 1001, 3.0), ("article_1\n", "\U0001f600" * 501, 4.0), (None, None, None), ("article_0", "x" * 1000, -1.0)], "id string, q string, level double")
    got = rows.select(T.valid_article_id(F.col("id")), T.valid_query(F.col("q")), T.valid_level(F.col("level"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False), (False, False, True), (False, False, False), (False, False, False), (True, True, False)]


def test_names_article(spark):
    rows = spark.createDataFrame([("xem Điều 5.",), ("Điều 50",), ("điều  5, khoản 1",), ("không",)], "t string")
    assert [r[0] for r in rows.select(T.names_article(F.col("t"), 5)).collect()] == [True, False, True, False]
