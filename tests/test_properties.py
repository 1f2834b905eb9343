"""Properties: stored and read again; nested, null and broken values."""

from __future__ import annotations

from weftgraph.sources import properties as P

ROWS = [
    ("a", '{"keywords": ["x", "y"], "metadata": {"part": "P", "n": 3}, "title": "T", "none": null, "deep": {"a": [1, {"b": null}]}}'), ("b", '{"keywords": "[\\"x\\"]", "metadata": "{\\"part\\": \\"P\\"}", "clauses": "[{\\"id\\": \\"c\\", \\"number\\": 1, \\"text\\": \\"t\\"}]"}'),
    ("c", '{"keywords": "[broken", "metadata": "no", "clauses": 5, "title": 7}'), ("d", "{broken"), ("e", "[1, 2]"), ("f", None), ("g", ""), ("h", "{}"), ("i", '{"keywords": null, "source_articles": []}'), ("a", '{"title": "again"}'),
]


def test_round_trip(spark, tmp_path):
    packed = P.packed(spark.createDataFrame(ROWS, "id string, json string"), "json")
    packed.write.parquet(f"{tmp_path}/nodes")
    stored = spark.read.parquet(f"{tmp_path}/nodes")
    raw = sorted((r["id"], r["props_raw"]) for r in stored.where("props_raw is not null").collect())
    assert raw == [("d", "{broken"), ("e", "[1, 2]")]
    assert [r["p"] for r in stored.where("id = 'a'").selectExpr("to_json(props) as p").orderBy("p").collect()] == ['{"deep":{"a":[1,{"b":null}]},"keywords":["x","y"],"metadata":{"n":3,"part":"P"},"title":"T"}', '{"title":"again"}']
    got = {(r["id"], r["title"]): r for r in P.shredded(stored, P.FIELDS | {"title": "string"}).collect()}
    a, b, c, h, i = got["a", "T"], got["b", None], got["c", "7"], got["h", None], got["i", None]
    assert (a["keywords"], a["metadata"], a["clauses"]) == (["x", "y"], {"part": "P", "n": "3"}, None)
    assert (b["keywords"], b["metadata"], b["clauses"][0].asDict()) == (["x"], {"part": "P"}, {"id": "c", "number": 1, "text": "t"})
    assert (c["keywords"], c["metadata"], c["clauses"]) == ([], {}, [])
    assert h["keywords"] is None and i["keywords"] is None and i["source_articles"] == []
    assert all(got[x, None]["metadata"] is None for x in "defg") and len(got) == 10


def test_columns(spark):
    rows = spark.createDataFrame([(1, "A", "x", None, [1, 2]), (2, "B", None, 2.5, None)], "id int, label string, name string, score double, numbers array<int>")
    out = P.packed_columns(rows, ["id", "label"]).selectExpr("id", "label", "to_json(props) as p").orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, "A", '{"name":"x","numbers":[1,2]}'), (2, "B", '{"score":2.5}')]
