"""Bounds on cardinality: keys are admitted in the order in which they are first seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERFLOW = "__overflow__"


def admitted(df: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    """The first ``cap`` distinct keys by the least ``order`` of each, ties by key.

    Keys are reduced before they are sorted, and the sort keeps ``cap`` rows a task.
    """
    return df.groupBy(*keys).agg(F.min(order).alias("_first")).orderBy("_first", *keys).limit(cap).select(*keys)


def with_admission(df: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    """Adds admitted.  ``cap`` bounds the rows that are broadcast."""
    first = admitted(df, keys, order, cap)
    renamed = first.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.lit(True).alias("_in"))
    same = [df[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys]
    return df.join(F.broadcast(renamed), same, "left").withColumn("admitted", F.coalesce("_in", F.lit(False))).drop("_in", *(f"_k_{k}" for k in keys))


def fold(df: DataFrame, keys: list[str], name: str, order: str, cap: int) -> DataFrame:
    """Replaces ``name`` by ``__overflow__`` in rows whose key is not among the first ``cap``."""
    folded = F.when(F.col("admitted"), F.col(name)).otherwise(F.lit(OVERFLOW))
    return with_admission(df, keys, order, cap).withColumn(name, folded).drop("admitted")
