"""Registry of the queries over the driver's tables and of their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# the modules that register queries
from larkspur.plans import access_q, checks_q, content_q, documents_q, events_q, formats_q, graph_q, history_q, lifecycle_q, masking_q, pii_q, privacy_q, records_q, security_q, sources_q, streaming_q  # noqa: E402, F401
