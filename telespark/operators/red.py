"""Rate, errors and duration of endpoints, with cumulative latency histograms.

Inputs are spans with service, name, kind, status and duration_ns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark.config import JobConfig
from telespark.functions.labels import UNKNOWN, safe_label
from telespark.functions.spans import ERROR, duration_us, span_kind, status_code
from telespark.operators.guard import OVERFLOW, fold

BOUNDS = JobConfig.latency_bounds


def bound_label(bound: float) -> str:
    return str(int(bound)) if bound == int(bound) else str(bound)


def guarded(spans: DataFrame, cap: int = 2000) -> DataFrame:
    """Spans whose name is kept for the first ``cap`` (service, name) pairs; later pairs fold to ``__overflow__``."""
    named = spans.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit(UNKNOWN)))
    return fold(named, ["service", "name"], "name", "ord", cap)


def _by(*names: str) -> list[Column]:
    return [safe_label(F.col(c)).alias(c) for c in names]


def requests(spans: DataFrame) -> DataFrame:
    kind, status = span_kind(F.col("kind")).alias("kind"), status_code(F.col("status")).alias("status")
    return spans.groupBy(*_by("service", "name"), kind, status).agg(F.count(F.lit(1)).alias("requests"))


def errors(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("status") == ERROR).groupBy(*_by("service", "name")).agg(F.count(F.lit(1)).alias("errors"))


def _counts(spans: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    seconds = F.col("duration_ns") / 1e9
    within = [F.count_if(seconds <= b).alias(f"b{k}") for k, b in enumerate(bounds)]
    return spans.groupBy(*_by("service", "name")).agg(*within, F.count(F.lit(1)).alias("n"))


def buckets(spans: DataFrame, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """service, name, le and cumulative_count: spans of at most ``le`` seconds.  One pass; only sums are unpivoted."""
    pairs = [F.struct(F.lit(bound_label(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("n")))
    rows = _counts(spans, bounds).select("service", "name", F.explode(F.array(*pairs)).alias("p"))
    return rows.select("service", "name", F.col("p.le").alias("le"), F.col("p.n").alias("cumulative_count"))


def count_sum(spans: DataFrame) -> DataFrame:
    """Spans and their summed microseconds, and the mean latency in seconds."""
    out = spans.groupBy(*_by("service", "name")).agg(F.count(F.lit(1)).alias("count"), F.sum(duration_us(F.col("duration_ns"))).alias("sum_us"))
    return out.withColumn("mean_seconds", F.col("sum_us") / 1e6 / F.col("count"))


def endpoints(spans: DataFrame) -> DataFrame:
    """Requests, errors and error percentage by service and name."""
    out = spans.groupBy(*_by("service", "name")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == ERROR).alias("errors"))
    return out.withColumn("error_pct", F.col("errors") * 100.0 / F.col("requests"))


def top_endpoints(spans: DataFrame, k: int = 10) -> DataFrame:
    return endpoints(spans).orderBy(F.desc("requests"), "service", "name").limit(k)


def apdex(spans: DataFrame, bounds: tuple[float, ...] = BOUNDS, t: float = 0.25, tolerable: float = 1.0) -> DataFrame:
    """(spans within t + spans within ``tolerable``) / 2 / all, by service; both are bucket bounds."""
    near, far = F.col(f"b{bounds.index(t)}"), F.col(f"b{bounds.index(tolerable)}")
    totals = _counts(spans, bounds).groupBy("service").agg(F.sum(near).alias("near"), F.sum(far).alias("far"), F.sum("n").alias("n"))
    return totals.select("service", ((F.col("near") + F.col("far")) / 2 / F.col("n")).alias("apdex"))
