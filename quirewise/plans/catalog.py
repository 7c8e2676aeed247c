"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collaboration_queries, live_queries, scalar_queries, text_queries
from .registry import ORACLE_SQL, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["file_overview"](spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "collaboration_queries", "flagship", "live_queries", "scalar_queries", "text_queries"]
