"""Cost attribution: bytes and records by team and service, their price, and debug logs that nobody needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.functions.labels import attr, safe_label
from telespark.functions.logs import is_debug


def priced(resources: DataFrame) -> DataFrame:
    """The resources that cost something, with team, vertical and service; those without records and bytes are left out."""
    named = (safe_label(attr(F.col("attrs"), k)).alias(c) for c, k in (("team", "team"), ("vertical", "vertical"), ("service", "service.name")))
    return resources.where((F.col("n_records") > 0) | (F.col("resource_bytes") > 0)).select("signal", "n_records", "resource_bytes", *named)


def cost(resources: DataFrame) -> DataFrame:
    """bytes and records by signal, team and vertical."""
    return priced(resources).groupBy("signal", "team", "vertical").agg(F.sum("resource_bytes").alias("bytes"), F.sum("n_records").alias("records"))


def cost_by_service(resources: DataFrame) -> DataFrame:
    """bytes by signal and service, which is never crossed with team."""
    return priced(resources).groupBy("signal", "service").agg(F.sum("resource_bytes").alias("bytes"))


def cost_usd(resources: DataFrame, usd_per_gb: float = 0.50) -> DataFrame:
    """The price of each team's bytes over all signals."""
    return priced(resources).groupBy("team").agg((F.sum("resource_bytes") / 1e9 * usd_per_gb).alias("usd"))


def projected_usd(resources: DataFrame, hours: float, usd_per_gb: float = 0.50, hours_per_month: int = 730) -> DataFrame:
    """usd, and what it comes to in an hour and a month if the bytes were sent in ``hours`` hours, by team."""
    usd = cost_usd(resources, usd_per_gb)
    return usd.select("team", "usd", (F.col("usd") / hours).alias("usd_hour"), (F.col("usd") / hours * hours_per_month).alias("usd_month"))


def debug_waste(logs: DataFrame) -> DataFrame:
    """Log records of trace and debug severities by service."""
    return logs.where(is_debug(F.col("severity_number"))).groupBy(safe_label(F.col("service")).alias("service")).agg(F.count(F.lit(1)).alias("debug_records"))


def snapshot(resources: DataFrame) -> DataFrame:
    """Grand totals, and how many series each metric has."""
    return priced(resources).agg(
        F.sum("resource_bytes").alias("bytes"),
        F.sum("n_records").alias("records"),
        F.count_distinct("signal", "team", "vertical").alias("team_series"),
        F.count_distinct("signal", "service").alias("service_series"),
    )


def top_teams(resources: DataFrame, k: int = 10, usd_per_gb: float = 0.50) -> DataFrame:
    """The ``k`` dearest teams, ties by name, with USD to four decimals."""
    return cost_usd(resources, usd_per_gb).orderBy(F.desc("usd"), "team").limit(k).select("team", F.format_string("%.4f", "usd").alias("usd"))
