"""Envelopes to flat rows, one row for each batch, resource, span, log record, data point or point attribute.

Rows of records have ``ord``, their place in a total order: by batch_id, which a broker's offsets make the order of arrival,
and then by their places inside the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark.functions import labels, logs, spans
from telespark.schema import LEVELS, METRIC_KINDS

_KEPT = ("batch_id", "arrival_ts", "n_bytes")


def points_of(metric: Column) -> Column:
    """The data points of all five kinds of a metric, each with its kind."""
    def of_kind(kind: str) -> Column:
        return F.transform(F.coalesce(metric[kind]["dataPoints"], F.array()), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("p")))

    kinds = [of_kind(k) for k in METRIC_KINDS]
    return F.concat(*kinds)


def n_points(metric: Column) -> Column:
    """How many data points a metric has, without unnesting them."""
    return sum((F.coalesce(F.size(metric[k]["dataPoints"]), F.lit(0)) for k in METRIC_KINDS), F.lit(0))


def _count(resource: Column, signal: str) -> Column:
    _, middle, inner = LEVELS[signal]

    def of_scope(scope: Column) -> Column:
        if signal == "metrics":
            return F.aggregate(F.coalesce(scope[inner], F.array()), F.lit(0).cast("long"), lambda a, m: a + n_points(m))
        return F.coalesce(F.size(scope[inner]), F.lit(0)).cast("long")

    return F.aggregate(F.coalesce(resource[middle], F.array()), F.lit(0).cast("long"), lambda a, s: a + of_scope(s))


def _batch_count(signal: str) -> Column:
    """How many records an envelope holds."""
    resources = F.coalesce(F.col("envelope")[LEVELS[signal][0]], F.array())
    return F.aggregate(resources, F.lit(0).cast("long"), lambda a, r: a + _count(r, signal))


def flatten_batches(envelopes: DataFrame, signal: str) -> DataFrame:
    """signal, batch_id, arrival_ts, n_bytes, malformed, n_records and ord of each envelope; a malformed one has no
    records."""
    n = F.when(F.col("malformed"), F.lit(0).cast("long")).otherwise(_batch_count(signal))
    return envelopes.select("signal", "batch_id", "arrival_ts", "n_bytes", "malformed", n.alias("n_records"), F.col("batch_id").alias("ord"))


def flatten_resources(envelopes: DataFrame, signal: str) -> DataFrame:
    """signal, batch_id, resource_idx, attrs, resource_bytes, n_records and bytes_basis.

    Records are counted in the arrays.  resource_bytes is a resource's size on the wire where the decoder has measured it
    (bytes_basis ``wire``), else that of its JSON text (``json``), which is another basis.
    """
    measured = "resource_bytes" in envelopes.columns
    top = F.posexplode(F.col("envelope")[LEVELS[signal][0]]).alias("resource_idx", "r")
    r = envelopes.select(*_KEPT, *(["resource_bytes"] if measured else []), top)
    size = F.get("resource_bytes", F.col("resource_idx")) if measured else F.octet_length(F.to_json("r")).cast("long")
    return r.select(
        F.lit(signal).alias("signal"),
        "batch_id",
        "resource_idx",
        labels.attr_map(F.col("r.resource.attributes")).alias("attrs"),
        size.alias("resource_bytes"),
        _count(F.col("r"), signal).alias("n_records"),
        F.lit("wire" if measured else "json").alias("bytes_basis"),
    )


def _records(envelopes: DataFrame, signal: str) -> DataFrame:
    """Each innermost record x, with its resource's attributes, its place and how many records its batch has."""
    top, middle, inner = LEVELS[signal]
    kept = [*_KEPT, "n_batch"]
    resources = envelopes.withColumn("n_batch", _batch_count(signal)).select(*kept, F.posexplode(F.col("envelope")[top]).alias("resource_idx", "r"))
    scopes = resources.select(*kept, "resource_idx", labels.attr_map(F.col("r.resource.attributes")).alias("res"), F.posexplode(F.col("r")[middle]).alias("scope_idx", "s"))
    records = scopes.select(*kept, "resource_idx", "res", "scope_idx", F.posexplode(F.col("s")[inner]).alias("idx", "x"))
    return records.withColumn("ord", F.struct("batch_id", "resource_idx", "scope_idx", "idx"))


def _time(*fields: str) -> Column:
    """The first of some fields in nanoseconds that is set, as a timestamp; the time of arrival where none is."""
    found = [F.timestamp_micros(F.expr(f"nullif(try_cast(x.{f} AS BIGINT), 0) div 1000")) for f in fields]
    return F.coalesce(*found, F.col("arrival_ts"))


def flatten_spans(envelopes: DataFrame) -> DataFrame:
    x = F.col("x")
    start, end = (F.expr(f"try_cast(x.{c}TimeUnixNano AS BIGINT)") for c in ("start", "end"))
    events = F.transform(F.coalesce(x["events"], F.array()), lambda e: F.struct(e["name"].alias("name"), e["attributes"].alias("attributes")))
    return _records(envelopes, "traces").select(
        *_KEPT,
        "resource_idx",
        "idx",
        F.coalesce(F.nullif(F.lower(x["traceId"]), F.lit("")), F.lit(labels.UNKNOWN)).alias("trace_id"),
        x["spanId"].alias("span_id"),
        labels.attr(F.col("res"), "service.name").alias("service"),
        F.coalesce(x["name"], F.lit("")).alias("name"),
        F.coalesce(x["kind"], F.lit(0)).alias("kind"),
        F.coalesce(x["status"]["code"], F.lit(0)).alias("status"),
        start.alias("start_ns"),
        end.alias("end_ns"),
        spans.duration_ns(start, end).alias("duration_ns"),
        spans.span_bytes_estimate(F.col("n_bytes"), F.col("n_batch")).alias("bytes_est"),
        spans.is_error(x["status"]["code"], events).alias("error"),
        "ord",
        events.alias("events"),
        labels.attr_map(x["attributes"]).alias("attrs"),
        "res",
    )


def flatten_logs(envelopes: DataFrame) -> DataFrame:
    x = F.col("x")
    number = F.coalesce(x["severityNumber"], F.lit(0))
    return _records(envelopes, "logs").select(
        *_KEPT,
        "resource_idx",
        "idx",
        labels.attr(F.col("res"), "service.name").alias("service"),
        number.alias("severity_number"),
        logs.severity_label(x["severityText"], number).alias("severity"),
        _time("timeUnixNano", "observedTimeUnixNano").alias("ts"),
        labels.body_text(x["body"]).alias("body"),
        F.octet_length(labels.body_text(x["body"])).cast("long").alias("body_bytes"),
        "ord",
        labels.attr_map(x["attributes"]).alias("attrs"),
        "res",
    )


def flatten_points(envelopes: DataFrame) -> DataFrame:
    rows = _records(envelopes, "metrics").select(*_KEPT, "resource_idx", "idx", "res", F.col("x.name").alias("metric_name"), F.explode(points_of(F.col("x"))).alias("q"))
    return rows.select(
        *_KEPT,
        "resource_idx",
        "idx",
        "metric_name",
        F.col("q.kind").alias("metric_type"),
        labels.attr_map(F.col("q.p.attributes"), labels.point_text).alias("attrs"),
        F.coalesce(F.col("q.p.asDouble"), F.expr("try_cast(q.p.asInt AS DOUBLE)")).alias("value"),
        "res",
    )


def point_attrs(points: DataFrame) -> DataFrame:
    """metric_name, attr_key and attr_value of each attribute of each data point."""
    return points.select("metric_name", F.explode("attrs").alias("attr_key", "attr_value"))


def exceptions(spans_df: DataFrame) -> DataFrame:
    """service, span_id and type of each exception event."""
    found = F.filter(F.col("events"), lambda e: e["name"] == "exception")
    return spans_df.select("service", "span_id", F.explode(found).alias("e")).select("service", "span_id", spans.exception_type(F.col("e.attributes")).alias("type"))
