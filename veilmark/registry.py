"""The library's own queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import oracles
from .plans.queries import QUERIES, pii_all_resolved


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal-data spans of documents, overlaps resolved."""
    return pii_all_resolved(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
