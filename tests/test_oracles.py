"""Every query with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from weftgraph.plans import registry

registry.load_catalogs()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, int | float):
        return round(float(x), 6)
    try:
        return round(float(x), 6) if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    found = duck.execute(registry.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert ordered(rows) == ordered([tuple(plain(r[i]) for i in at) for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).columns


@pytest.mark.parametrize("entered, nodes", [(94, 6), (95, None), (40, None)])
def test_paths_of_over_five_steps_are_none(spark, small, tmp_path, entered, nodes):
    """A chain of articles from 90 on that article 1 enters by its one reference."""
    con = duckdb.connect()
    keep = lambda t, sql: con.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)").execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    for t in ("region", "nation", "supplier"):
        keep(t, f"select * from '{small}/{t}.parquet'")
    keep("customer", f"select * from '{small}/customer.parquet' where c_custkey in (1, 40) or c_custkey >= 90")
    keep("orders", f"select o.* replace (k::BIGINT as o_orderkey, c::BIGINT as o_custkey) from (from '{small}/orders.parquet' limit 1) o, (values (1, 1), (2, {entered})) v(k, c)")
    assert con.execute(registry.SQL["shortest_path"]).fetchall() == [(nodes,)]
    assert [r["nodes"] for r in registry.QUERIES["shortest_path"](spark, str(tmp_path)).collect()] == [nodes]
