"""The library's queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import queries as _q


def queries() -> dict:
    return dict(_q.QUERIES)


def oracle_sql() -> dict:
    return dict(_q.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's context: searched, packed into 2000 tokens, cited."""
    return _q.QUERIES["p3_pack"](spark, sf_dir)
