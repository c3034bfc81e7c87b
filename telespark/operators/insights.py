"""Who sends what: record counts by service, transport, SDK, cloud, cluster and environment, errors and exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.functions.labels import attr, safe_label
from telespark.functions.spans import ERROR

#: Each label of a breakdown and the resource attribute that it shows.
LABELS = {
    "service_name": "service.name",
    "transport": "otlp.transport",
    "sdk_language": "telemetry.sdk.language",
    "sdk_name": "telemetry.sdk.name",
    "sdk_version": "telemetry.sdk.version",
    "cloud_provider": "cloud.provider",
    "k8s_cluster": "k8s.cluster.name",
    "k8s_namespace": "k8s.namespace.name",
    "environment": "deployment.environment",
}
BREAKDOWNS = {
    "total": (),
    "service": ("service_name",),
    "transport": ("transport",),
    "sdk_language": ("sdk_language",),
    "sdk": ("sdk_name", "sdk_version"),
    "cloud": ("cloud_provider",),
    "k8s": ("k8s_cluster", "k8s_namespace"),
    "environment": ("environment",),
}


def insights(resources: DataFrame) -> DataFrame:
    """breakdown, signal, label1, label2 and records: every breakdown in one pass.

    Resources without records are left out.  Rows are summed on all labels first, so that the grouping sets expand few.
    """
    return breakdowns(by_labels(resources))


def by_labels(resources: DataFrame) -> DataFrame:
    """n, the records of each combination of labels: what a stream keeps as its state."""
    labelled = resources.where(F.col("n_records") > 0).select("signal", "n_records", *(safe_label(attr(F.col("attrs"), k)).alias(c) for c, k in LABELS.items()))
    return labelled.groupBy("signal", *LABELS).agg(F.sum("n_records").alias("n"))


def breakdowns(summed: DataFrame) -> DataFrame:
    """Every breakdown of the sums ``by_labels``."""
    sets = [[F.col("signal"), *map(F.col, cols)] for cols in BREAKDOWNS.values()]
    grouped = summed.groupingSets(sets, F.col("signal"), *map(F.col, LABELS)).agg(F.sum("n").alias("records"), F.grouping_id().alias("gid"))
    # the bits of gid are the absent labels, the last label lowest
    names = list(LABELS)
    name = label1 = label2 = F.lit(None).cast("string")
    for what, cols in BREAKDOWNS.items():
        here = F.col("gid") == sum(1 << (len(names) - 1 - names.index(c)) for c in names if c not in cols)
        name = F.when(here, F.lit(what)).otherwise(name)
        if cols:
            label1 = F.when(here, F.col(cols[0])).otherwise(label1)
        if len(cols) > 1:
            label2 = F.when(here, F.col(cols[1])).otherwise(label2)
    return grouped.select(name.alias("breakdown"), "signal", label1.alias("label1"), label2.alias("label2"), "records")


def span_errors(spans: DataFrame) -> DataFrame:
    """Spans with status error by service."""
    return spans.where(F.col("status") == ERROR).groupBy(safe_label(F.col("service")).alias("service")).agg(F.count(F.lit(1)).alias("errors"))


def span_exceptions(exceptions: DataFrame) -> DataFrame:
    """Exception events, and distinct spans with one, by service and type."""
    by = [safe_label(F.col(c)).alias(c) for c in ("service", "type")]
    return exceptions.groupBy(*by).agg(F.count(F.lit(1)).alias("exceptions"), F.count_distinct("span_id").alias("spans"))
