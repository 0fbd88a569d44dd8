"""Registry of the library's own queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heddle.plans import files, scoring, stores, tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.map_distinctiveness(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return scoring.QUERIES | tables.QUERIES | files.QUERIES | stores.QUERIES


def oracle_sql() -> dict[str, str]:
    return scoring.ORACLES | tables.ORACLES | files.ORACLES | stores.ORACLES
