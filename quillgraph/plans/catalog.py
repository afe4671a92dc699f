"""The engine's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import change_queries, context_queries, descent_queries, extra_queries, fact_queries, graph_queries, layout_queries, level_queries, life_queries, linking_queries, more_queries, passage_queries, scope_queries, search_queries, text_queries, walk_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every entity of the document graph."""
    return QUERIES["entity_importance"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
