"""Tail sampling: fold a trace's spans, decide whether to keep it, and what that saves.

Decisions, first match wins: an error, a slow span, the first trace of a service (``rare``, among traces that get this far),
a share of all by the hash of the trace id; the rest is boring and dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.functions.hashing import sampled
from telespark.functions.labels import UNKNOWN

SLOW_NS = 1_000_000_000


def trace_facts(facts: DataFrame, *window: str) -> DataFrame:
    """One row for each trace (and window): spans, bytes, longest span, any error, the last known service, and when decided.

    facts: trace_id, service, duration_ns, error, bytes_est, arrival_ts and a total order ``ord``.
    """
    known = F.when(F.col("service") != UNKNOWN, F.col("ord"))
    return facts.groupBy("trace_id", *window).agg(
        F.count(F.lit(1)).alias("spans"),
        F.sum("bytes_est").alias("bytes"),
        F.max("duration_ns").alias("max_duration_ns"),
        F.bool_or("error").alias("error"),
        F.coalesce(F.max_by("service", known), F.lit(UNKNOWN)).alias("service"),
        F.min("arrival_ts").alias("first_ts"),
    )


def decide(traces: DataFrame, *, slow_ns: int = SLOW_NS, percent: int = 5, max_services: int = 50_000, seen: DataFrame | None = None) -> DataFrame:
    """Adds kept and reason.  Traces are decided in order of first_ts and trace_id; a service is new once, and only the
    first ``max_services`` are.  Services in ``seen`` (service), as many as are bounded elsewhere, aren't new."""
    plain = ~F.col("error") & (F.col("max_duration_ns") <= slow_ns) & (F.col("service") != UNKNOWN)
    rows = traces.withColumn("_plain", plain)
    # one row for each service, of which at most ``max_services`` are broadcast
    first = rows.where("_plain").groupBy(F.col("service").alias("_s")).agg(F.min(F.struct("first_ts", "trace_id")).alias("_f"))
    if seen is not None:
        first = first.join(F.broadcast(seen.select(F.col("service").alias("_s"))), "_s", "left_anti")
    first = first.orderBy("_f.first_ts", "_s").limit(max_services).select("_s", F.col("_f.first_ts").alias("_t"), F.col("_f.trace_id").alias("_id"), F.lit(True).alias("_rare"))
    same = (F.col("service") == F.col("_s")) & (F.col("first_ts") == F.col("_t")) & (F.col("trace_id") == F.col("_id"))
    marked = rows.join(F.broadcast(first), same, "left").withColumn("_rare", F.col("_rare") & F.col("_plain"))
    reason = (
        F.when(F.col("error"), "error")
        .when(F.col("max_duration_ns") > slow_ns, "slow")
        .when(F.coalesce("_rare", F.lit(False)), "rare")
        .when(sampled(F.col("trace_id"), percent), "probabilistic")
        .otherwise("boring")
    )
    return marked.withColumn("reason", reason).withColumn("kept", F.col("reason") != "boring").drop("_plain", "_s", "_t", "_id", "_rare")


def by_reason(decisions: DataFrame) -> DataFrame:
    """traces by decision and reason."""
    return decisions.groupBy(_decision().alias("decision"), "reason").agg(F.count(F.lit(1)).alias("traces"))


def _decision():
    return F.when(F.col("kept"), "keep").otherwise("drop")


def spans_bytes(decisions: DataFrame) -> DataFrame:
    """spans and bytes by decision."""
    return decisions.groupBy(_decision().alias("decision")).agg(F.sum("spans").alias("spans"), F.sum("bytes").alias("bytes"))


def kept_ratio(decisions: DataFrame) -> DataFrame:
    """Kept traces out of all, 0 without traces, and the share of bytes saved."""
    ratio = F.coalesce(F.avg(F.when(F.col("kept"), 1.0).otherwise(0.0)), F.lit(0.0))
    saved = 1 - F.sum(F.when(F.col("kept"), F.col("bytes")).otherwise(0)) / F.nullif(F.sum("bytes"), F.lit(0))
    return decisions.agg(ratio.alias("kept_ratio"), saved.alias("bytes_saved_share"))


def kept_spans(spans: DataFrame, decisions: DataFrame, *window: str) -> DataFrame:
    """The spans of kept traces, for sending on."""
    return spans.join(decisions.where("kept").select("trace_id", *window), ["trace_id", *window], "left_semi")
