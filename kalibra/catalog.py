"""Registry of the library's own queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import documents, formats, labels, relational, retrieval, series, tables  # noqa: F401
from .plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.source_summary(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
