"""Fields of spans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telespark.functions.labels import UNKNOWN, scalar_text

ERROR = 2
#: Names of the span kinds 1 to 5 and of the status codes 1 and 2.
KINDS = ("internal", "server", "client", "producer", "consumer")
STATUSES = ("ok", "error")


def _named(code: Column, names: tuple[str, ...], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), F.nullif(F.greatest(code.cast("int"), F.lit(0)), F.lit(0))), F.lit(other))


def span_kind(code: Column) -> Column:
    return _named(code, KINDS, "unspecified")


def status_code(code: Column) -> Column:
    return _named(code, STATUSES, "unset")


def duration_ns(start: Column, end: Column) -> Column:
    """Nanoseconds between start and end, 0 for a span that ends before it starts."""
    return F.greatest(end - start, F.lit(0).cast("long"))


def duration_us(ns: Column) -> Column:
    """Microseconds by way of seconds, halves rounded up."""
    return F.floor(ns / 1e9 * 1e6 + 0.5).cast("long")


def trace_hex(trace_id: Column) -> Column:
    """Trace id bytes in lower-case hexadecimal, ``unknown`` for none."""
    return F.coalesce(F.nullif(F.lower(F.hex(trace_id)), F.lit("")), F.lit(UNKNOWN))


def is_error(status: Column, events: Column) -> Column:
    """Status error, or an exception event."""
    return (F.coalesce(status, F.lit(0)) == ERROR) | F.coalesce(F.exists(events, lambda e: e["name"] == "exception"), F.lit(False))


def exception_type(attributes: Column) -> Column:
    """The first ``exception.type`` of an event's attributes, ``unknown`` if blank, missing or no scalar."""
    first = F.try_element_at(F.filter(attributes, lambda a: a["key"] == "exception.type"), F.lit(1))
    text = scalar_text(first["value"])
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(UNKNOWN)).otherwise(text)


def span_bytes_estimate(batch_bytes: Column, n_spans: Column) -> Column:
    """A span's share of its batch's bytes, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(batch_bytes / F.greatest(n_spans, F.lit(1))).cast("long"))
