"""All registered queries of the retrieval library, by inventory id, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans import flow_queries, more_queries, question_queries, retrieval_queries, table_queries, text_queries, workspace_queries  # noqa: F401  they register themselves
from paperloom.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
