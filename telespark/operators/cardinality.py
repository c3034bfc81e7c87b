"""How many values the attributes of metrics take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attr_cardinality(attrs: DataFrame, cap: int = 10_000, approximate: bool = False) -> DataFrame:
    """distinct values (``cap`` at most), observations, their ratio and saturated, by metric_name and attr_key.

    Values are reduced to distinct ones before they are counted; ``approximate`` uses a sketch of constant size.
    """
    by = ["metric_name", "attr_key"]
    if approximate:
        counted = attrs.groupBy(*by).agg(F.approx_count_distinct("attr_value").alias("d"), F.count(F.lit(1)).alias("observations"))
    else:
        counted = attrs.groupBy(*by, "attr_value").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.count("attr_value").alias("d"), F.sum("n").alias("observations"))
    return counted.select(
        *by,
        F.least("d", F.lit(cap).cast("long")).alias("distinct_values"),
        "observations",
        (F.least("d", F.lit(cap)) / F.col("observations")).alias("ratio"),
        (F.col("d") >= cap).alias("saturated"),
    )


def top_attributes(attrs: DataFrame, k: int = 10, cap: int = 10_000) -> DataFrame:
    return attr_cardinality(attrs, cap).orderBy(F.desc("distinct_values"), "metric_name", "attr_key").limit(k)


def sketches(attrs: DataFrame, *by: str, lg_k: int = 12) -> DataFrame:
    """A sketch of the distinct values, and the observations, of each metric_name, attr_key and ``by`` (an hour, a batch).

    Sketches have 2 ** ``lg_k`` cells at most, however many values there are, and unite later (``united``).
    """
    known = attrs.where(F.col("attr_value").isNotNull())
    return known.groupBy("metric_name", "attr_key", *by).agg(F.hll_sketch_agg("attr_value", F.lit(lg_k)).alias("sketch"), F.count(F.lit(1)).alias("observations"))


def united(tables: DataFrame, *by: str) -> DataFrame:
    """estimate and observations of each metric_name, attr_key and ``by`` over all rows of a table of sketches.  The standard
    error of an estimate is about 1.04 / sqrt(2 ** lg_k), 1.6 % by default."""
    sums = tables.groupBy("metric_name", "attr_key", *by).agg(F.hll_union_agg("sketch").alias("_s"), F.sum("observations").alias("observations"))
    return sums.select("metric_name", "attr_key", *by, F.hll_sketch_estimate("_s").alias("estimate"), "observations")
