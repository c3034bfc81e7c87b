"""The greatest few of each group.  Ties are by the other columns, ascending."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, value: str, k: int, by: tuple[str, ...], ties: tuple[str, ...]) -> DataFrame:
    """The ``k`` rows of greatest ``value`` in each group of ``by``, with their rank; rows are cut before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def records_by_service(resources: DataFrame) -> DataFrame:
    from telespark.functions.labels import attr

    return resources.groupBy("signal", attr(F.col("attrs"), "service.name").alias("service")).agg(F.sum("n_records").alias("records"))


def top_services(resources: DataFrame, k: int = 100) -> DataFrame:
    return top_k(records_by_service(resources), "records", k, ("signal",), ("service",))


def last_n(df: DataFrame, n: int, by: tuple[str, ...], order: str) -> DataFrame:
    """The last ``n`` rows of each group: a ring buffer's contents."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
