"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import measured_broadcasts, prepare
from . import built_queries, event_queries, page_queries, shape_queries, text_queries, url_queries

MODULES = (url_queries, text_queries, event_queries, page_queries, built_queries, shape_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(measured_broadcasts(prepare(spark)), sf_dir)

        return run

    return {name: ready(query) for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
