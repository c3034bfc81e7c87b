"""Attribute values and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def scalar_text(v: Column) -> Column:
    """An attribute value as text: strings, integers, booleans and doubles; null for the rest."""
    return F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))


def point_text(v: Column) -> Column:
    """A data point's attribute value as text: scalars and bytes, else empty."""
    return F.coalesce(scalar_text(v), F.when(v["bytesValue"].isNotNull(), F.lit("<bytes>")), F.lit(""))


def body_text(v: Column) -> Column:
    """A log body as text: scalars, ``<bytes>``, lists and maps as JSON, else empty."""
    return F.coalesce(scalar_text(v), F.when(v["bytesValue"].isNotNull(), F.lit("<bytes>")), v["arrayValue"], v["kvlistValue"], F.lit(""))


def attr_map(attributes: Column, text=scalar_text) -> Column:
    """A list of attributes as a map; of several with one key the last counts, and those without text are left out."""
    pairs = F.filter(F.transform(attributes, lambda a: F.named_struct(F.lit("key"), a["key"], F.lit("value"), text(a["value"]))), lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == p["key"]))
    once = F.size(F.array_distinct(F.transform(pairs, lambda p: p["key"]))) == F.size(pairs)  # as good as always
    return F.coalesce(F.map_from_entries(F.when(once, pairs).otherwise(last)), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def attr(attrs: Column, key: str) -> Column:
    """The value of ``key``, or ``unknown`` where it is missing or empty."""
    return F.coalesce(F.nullif(F.try_element_at(attrs, F.lit(key)), F.lit("")), F.lit(UNKNOWN))


def safe_label(c: Column) -> Column:
    """A label value: line ends become spaces, 120 characters at most, ``unknown`` for an empty one."""
    return F.coalesce(F.nullif(F.substring(F.translate(c, "\r\n", "  "), 1, 120), F.lit("")), F.lit(UNKNOWN))


def insert_attr(attrs: Column, key: str, value: str) -> Column:
    """The map with ``key`` set to ``value`` unless it has that key."""
    return F.when(F.map_contains_key(attrs, F.lit(key)), attrs).otherwise(F.map_concat(attrs, F.create_map(F.lit(key), F.lit(value))))


def scrub_attrs(attrs: Column, keys: tuple[str, ...] = ("authorization", "cookie")) -> Column:
    """The map without sensitive keys."""
    return F.map_filter(attrs, lambda k, _: ~k.isin(*keys))


def shown(*labels: Column) -> Column:
    """Several labels as one string for display."""
    return F.concat_ws("|", *labels)
