"""Merges onto stored tables: touched buckets alone, twice like once, ends between steps."""

from __future__ import annotations

import os

import pytest

from weftgraph.sources.keyed_table import KeyedTable, merge_nodes, merge_stored_edges

NODES = "id string, label string, name string"
EDGES = "src string, dst string, type string, weight double"


def files(path):
    return {f"{os.path.basename(d)}/{f}" for d, _, names in os.walk(f"{path}/rows") for f in names if f.endswith(".parquet")}


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=str)


@pytest.fixture
def nodes(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/nodes", NODES, ["id"], buckets=8)
    assert table.read().count() == 0
    touched = merge_nodes(table, spark.createDataFrame([(f"n{i}", "A", f"name {i}") for i in range(60)], NODES))
    assert touched == list(range(8))
    return table


def test_only_touched_buckets_are_written(spark, nodes, tmp_path):
    before = files(f"{tmp_path}/nodes")
    batch = spark.createDataFrame([("n3", None, "new"), ("n3", "B", None), (None, "x", "y"), ("m1", "C", None)], NODES)
    touched = merge_nodes(nodes, batch)
    after = files(f"{tmp_path}/nodes")
    changed = {f.split("/")[0] for f in before ^ after}
    assert 1 <= len(touched) <= 2 and changed == {f"bucket={b}" for b in touched}
    got = {r["id"]: tuple(r)[1:] for r in nodes.read().collect()}
    assert len(got) == 61 and got["n3"] == ("B", "new") and got["m1"] == ("C", None) and got["n4"] == ("A", "name 4")
    once = rows(nodes)
    assert merge_nodes(nodes, batch) == touched and rows(nodes) == once
    assert merge_nodes(nodes, batch.limit(0)) == [] and rows(nodes) == once
    plan = nodes.read([touched[0]])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1]


@pytest.mark.parametrize("step", ["_stage", "_overwrite", "after"])
def test_ends_between_steps(spark, nodes, monkeypatch, step):
    batch = spark.createDataFrame([(f"n{i}", "Z", None) for i in range(0, 60, 7)] + [("q", "Q", "q")], NODES)
    before, other = rows(nodes), KeyedTable(spark, nodes.path, NODES, ["id"], buckets=8)

    def end(*_):
        raise OSError("gone")

    if step == "after":  # partitions are written, and what was staged is still there
        real = nodes._overwrite
        monkeypatch.setattr(nodes, "_overwrite", lambda r: (real(r), end()))
    else:
        monkeypatch.setattr(nodes, step, end)
    with pytest.raises(OSError):
        merge_nodes(nodes, batch)
    whole = sorted([(i, "Z" if (i, n) in {(f"n{k}", f"name {k}") for k in range(0, 60, 7)} else x, n) for i, x, n in before] + [("q", "Q", "q")], key=str)
    assert rows(other) == (before if step == "_stage" else whole)
    merge_nodes(other, batch)
    assert rows(other) == whole


def test_edges(spark, nodes, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/edges", EDGES, ["src", "dst", "type"], buckets=4)
    batch = lambda *x: spark.createDataFrame(x, f"{EDGES}, ord long")
    first = batch(("n1", "n2", "R", 1.0, 1), ("n1", "n2", "R", 2.0, 2), ("n1", "n2", "R", None, 3), ("n1", "nowhere", "R", 1.0, 4), ("n1", "n3", None, 1.0, 5), ("n4", "n5", "S", None, 6))
    for _ in range(2):
        merge_stored_edges(table, first, nodes.read(), ["weight"])
        assert rows(table) == sorted([("n1", "n2", "R", 2.0), ("n4", "n5", "S", None)], key=str)
    merge_stored_edges(table, batch(("n4", "n5", "S", 7.0, 1), ("n1", "n2", "T", 1.0, 1)), nodes.read(), ["weight"])
    assert rows(table) == sorted([("n1", "n2", "R", 2.0), ("n1", "n2", "T", 1.0), ("n4", "n5", "S", 7.0)], key=str)


def test_edges_of_a_hub_are_not_gathered(spark, monkeypatch):
    """Few far ends are sent to the tasks, more are joined; both give one edge a pair and type."""
    from weftgraph.operators import graph

    schema = "src long, dst long, type string, a long, ord long"
    stored = spark.createDataFrame([(i, 1, "T", i, 0) for i in range(20)], schema)
    batch = spark.createDataFrame([(i, 1, "T", None if i % 2 else -i, i) for i in range(40)] + [(1, 99, "T", 1, 1), (1, 1, None, 1, 1), (None, 1, "T", 1, 1), (1, None, "T", 1, 1)], schema)
    nodes = spark.createDataFrame([(i,) for i in range(30)] + [(3,), (None,)], "id long")
    found = graph.merge_edges(stored, batch, nodes, ["a"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" in plan
    wanted = [(i, 1, "T", -i if i % 2 == 0 else i if i < 20 else None) for i in range(30)]
    assert sorted(map(tuple, found.collect())) == wanted
    monkeypatch.setattr(graph, "FEW_ENDS", 0)
    assert sorted(map(tuple, graph.merge_edges(stored, batch, nodes, ["a"]).collect())) == wanted
