"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: SQL of the series that ``sources.series.events_series`` builds.
SEQ = (
    "seq AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, "
    "least(value, 500) / 500 AS luma, event_type = 'signup' AS flag, event_type AS kind, value FROM events)"
)
#: SQL of the series that ``sources.series.pixels`` builds.
PX = (
    "px AS (SELECT l_orderkey AS row_id, l_linenumber AS line, l_partkey AS p, l_suppkey AS s, "
    "l_partkey % 256 AS r, l_suppkey % 256 AS g, (l_linenumber * 37 + CAST(l_quantity AS BIGINT)) % 256 AS b, "
    "l_orderkey % 256 AS r2, (l_partkey * 7 + l_linenumber) % 256 AS g2, (l_suppkey * 13 + l_partkey) % 256 AS b2 FROM lineitem)"
)


def r4(x: str, digits: int = 4) -> str:
    """SQL that rounds half up."""
    k = 10**digits
    return f"floor(({x}) * {k} + 0.5) / {k}"


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """QUERIES, ORACLES and a decorator that fills them; the function's name is the query's."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
