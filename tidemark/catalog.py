"""The registered queries and their DuckDB counterparts, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import adjust_queries, dataset_queries, memory_queries, pixel_queries, plane_queries, sequence_queries, stream_queries, table_queries, text_queries

FLAGSHIP = "seq_scene_pipeline"

_MODULES = (sequence_queries, pixel_queries, adjust_queries, plane_queries, memory_queries, table_queries, dataset_queries, text_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries outside the optional subpackage."""
    return {name: q for module in _MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Their SQL, where SQL can express them."""
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
