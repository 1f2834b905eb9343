"""Registry of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with the DuckDB SQL that it must equal."""

    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


def values(rows: Iterable[tuple]) -> str:
    """Rows as SQL literals, for a VALUES list."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return str(x)

    return ", ".join("(" + ", ".join(map(one, row)) + ")" for row in rows)


def load_catalogs() -> None:
    """Imports the modules that register queries."""
    from weftgraph.plans import catalog_evaluation, catalog_graph, catalog_search, catalog_sessions, catalog_stores, catalog_text  # noqa: F401
