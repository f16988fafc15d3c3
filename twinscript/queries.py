"""Registry: query name -> (callable, DuckDB SQL or None). The driver's entry module only re-exports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator that files a query under its name, with its SQL where SQL can express it."""

    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def core() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries of the core and their SQL."""
    from twinscript.plans import load

    load()
    return QUERIES, ORACLES
