"""Path patterns against a walk in plain Python."""

from __future__ import annotations

import random

import pytest

from weftgraph.operators import patterns

EDGES = "src string, dst string, type string, ord long"


def brute(edges, types, low, high, starts):
    edges = sorted({e for e in edges if e[2] in types and None not in e[:3]}, key=str)
    out = []

    def walk(start, node, path, kinds, used):
        if low <= len(kinds) <= high:
            out.append((start, node, len(kinds), tuple(path), tuple(kinds)))
        if len(kinds) < high:
            for e in edges:
                if e[0] == node and e not in used:
                    walk(start, e[1], [*path, e[1]], [*kinds, e[2]], {*used, e})

    for s in starts if starts is not None else {e[0] for e in edges}:
        walk(s, s, [s], [], set())
    return sorted(out)


def got(spark, edges, types, low, high, starts=None):
    ids = None if starts is None else spark.createDataFrame([(s,) for s in starts], "id string")
    rows = patterns.match_paths(spark.createDataFrame(edges, EDGES), types, low, high, starts=ids).collect()
    return sorted((r["start"], r["goal"], r["hops"], tuple(r["path"]), tuple(r["types"])) for r in rows)


CASES = {
    "cycle": [("a", "b", "R", 1), ("b", "c", "R", 2), ("c", "a", "R", 3)],
    "diamond": [("a", "b", "R", 1), ("a", "c", "S", 2), ("b", "d", "R", 3), ("c", "d", "R", 4), ("d", "e", "T", 5)],
    "loop": [("a", "a", "R", 1), ("a", "b", "R", 2)],
    "parallel": [("a", "b", "R", 1), ("a", "b", "R", 2), ("a", "b", "R", 2), ("a", "b", "S", 2), ("b", "a", "R", 1)],
    "nulls": [("a", None, "R", 1), (None, "b", "R", 1), ("a", "b", None, 1), ("a", "b", "R", None), ("b", "c", "R", None)],
}


@pytest.mark.parametrize("name", CASES)
def test_patterns(spark, name):
    for types, low, high in ((["R"], 1, 3), (["R", "S"], 0, 4), (["R", "S", "T"], 2, 2), (["none"], 1, 3)):
        assert got(spark, CASES[name], types, low, high) == brute(CASES[name], types, low, high, None)


def test_starts_and_goals(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice("RST"), rng.randrange(3)) for _ in range(22)]
    starts = ["n0", "n3", "nowhere"]
    assert got(spark, edges, ["R", "S"], 0, 4, starts) == brute(edges, ["R", "S"], 0, 4, starts)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    found = patterns.match_paths(spark.createDataFrame(edges, EDGES), ["R", "S"], 1, 3, starts=ids("n0", "n0", None), goals=ids("n5", "n5"))
    assert sorted(r["path"] for r in found.collect()) == sorted(list(x[3]) for x in brute(edges, ["R", "S"], 1, 3, ["n0"]) if x[1] == "n5")


def test_many_paths_and_no_bounds(spark):
    """More rows than Spark's limit of a recursion, which is as it was afterwards."""
    before = spark.conf.get(patterns.ROW_LIMIT)
    spark.conf.set(patterns.ROW_LIMIT, "100")
    try:
        edges = [(f"a{i}", f"a{i + 1}", "R", k) for i in range(4) for k in range(5)]
        found = patterns.match_paths(spark.createDataFrame(edges, EDGES), ["R"], 4, 4)
        assert found.count() == 5**4 and spark.conf.get(patterns.ROW_LIMIT) == "100"
    finally:
        spark.conf.set(patterns.ROW_LIMIT, before)
    for low, high in ((-1, 2), (3, 2)):
        with pytest.raises(ValueError):
            patterns.match_paths(spark.createDataFrame(edges, EDGES), ["R"], low, high)
    assert patterns.match_paths(spark.createDataFrame([], EDGES), ["R"]).count() == 0


def test_ancestors(spark):
    edges = spark.createDataFrame([("x", "s", "BELONGS_TO_SECTION"), ("s", "c", "BELONGS_TO_CHAPTER"), ("c", "p", "BELONGS_TO_PART"), ("x", "c2", "BELONGS_TO_CHAPTER"), ("y", "p", "BELONGS_TO_PART")], "src string, dst string, type string")
    nodes = spark.createDataFrame([("s", "Section", "S"), ("c", "Chapter", "C"), ("c2", "Chapter", "C2"), ("p", "Part", "P")], "id string, label string, name string")
    articles = spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    rows = patterns.ancestors(edges, nodes, articles).collect()
    assert sorted(map(tuple, rows)) == [("x", "Chapter", "C2", 1), ("x", "Part", "P", 3), ("x", "Section", "S", 1), ("y", "Part", "P", 1)]
