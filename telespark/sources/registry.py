"""Credential registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_registry(spark: SparkSession, path: str | None = None, **jdbc: str) -> DataFrame:
    """A registry from Parquet files, or from a database by JDBC options (url, dbtable, ...)."""
    return spark.read.parquet(path) if path else spark.read.format("jdbc").options(**jdbc).load()
