"""All registered queries of the library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and the SQL of the same result where there is one."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def load() -> None:
    """Imports the modules whose queries register themselves."""
    from athenor.plans import author_queries, check_queries, expansion_queries, graph_queries, lookup_queries, pool_queries, score_queries, selection_queries, text_queries, topic_queries  # noqa: F401
