"""All core queries and their oracle SQL, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulary.plans import data_quality, detail_queries, geo_queries, link_queries, publish_queries, report_queries, search_queries, text_queries, tree_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES: list = [search_queries, text_queries, tree_queries, link_queries, geo_queries, publish_queries, report_queries, detail_queries, data_quality]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
