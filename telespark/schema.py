"""Schemas: the JSON form of the three export envelopes, and the flat tables that every operator runs on."""

from __future__ import annotations

ANY_VALUE = "STRUCT<stringValue: STRING, intValue: STRING, boolValue: BOOLEAN, doubleValue: DOUBLE, bytesValue: STRING, arrayValue: STRING, kvlistValue: STRING>"
ATTRIBUTES = f"ARRAY<STRUCT<key: STRING, value: {ANY_VALUE}>>"
RESOURCE = f"STRUCT<attributes: {ATTRIBUTES}>"
EVENT = f"STRUCT<name: STRING, timeUnixNano: STRING, attributes: {ATTRIBUTES}>"
SPAN = f"STRUCT<traceId: STRING, spanId: STRING, name: STRING, kind: INT, startTimeUnixNano: STRING, endTimeUnixNano: STRING, status: STRUCT<code: INT, message: STRING>, attributes: {ATTRIBUTES}, events: ARRAY<{EVENT}>>"
LOG = f"STRUCT<timeUnixNano: STRING, observedTimeUnixNano: STRING, severityNumber: INT, severityText: STRING, body: {ANY_VALUE}, attributes: {ATTRIBUTES}>"
POINT = f"STRUCT<attributes: {ATTRIBUTES}, startTimeUnixNano: STRING, timeUnixNano: STRING, asInt: STRING, asDouble: DOUBLE>"
POINTS = f"STRUCT<dataPoints: ARRAY<{POINT}>>"
#: The five kinds of metric, each with data points of its own.
METRIC_KINDS = ("gauge", "sum", "histogram", "exponentialHistogram", "summary")
METRIC = f"STRUCT<name: STRING, {', '.join(f'{k}: {POINTS}' for k in METRIC_KINDS)}>"

#: Of each signal: the envelope, and the names of its three levels below the resource.
ENVELOPES = {
    "traces": f"resourceSpans ARRAY<STRUCT<resource: {RESOURCE}, scopeSpans: ARRAY<STRUCT<spans: ARRAY<{SPAN}>>>>>",
    "logs": f"resourceLogs ARRAY<STRUCT<resource: {RESOURCE}, scopeLogs: ARRAY<STRUCT<logRecords: ARRAY<{LOG}>>>>>",
    "metrics": f"resourceMetrics ARRAY<STRUCT<resource: {RESOURCE}, scopeMetrics: ARRAY<STRUCT<metrics: ARRAY<{METRIC}>>>>>",
}
LEVELS = {
    "traces": ("resourceSpans", "scopeSpans", "spans"),
    "logs": ("resourceLogs", "scopeLogs", "logRecords"),
    "metrics": ("resourceMetrics", "scopeMetrics", "metrics"),
}
SAMPLES = "metric STRING, labels MAP<STRING, STRING>, ts TIMESTAMP, value DOUBLE"
