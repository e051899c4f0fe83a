"""All registered queries of the graph engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import edge_queries, flow_queries, impact_queries, logic_queries, metric_queries, reach_queries, review_queries, search_queries, similarity_queries, stream_queries, subgraph_queries, text_queries, trace_queries, view_queries  # noqa: F401  each module registers its queries
from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["coverage_container"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
