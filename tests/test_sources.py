from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from telespark.operators import flatten, red
from telespark.sources.exposition import parse_exposition, read_exposition, to_exposition
from telespark.sources.otlp_json import decode_json, read_otlp_json
from telespark.sources.otlp_proto import decode_otlp_proto, encode_otlp_proto
from telespark.sources.sinks import as_samples, write_jsonl, write_samples

NOW = datetime.datetime(2024, 1, 1)
BODY = {
    "resourceSpans": [
        {
            "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "old"}}, {"key": "service.name", "value": {"stringValue": "smoke"}}, {"key": "n", "value": {"intValue": "7"}}]},
            "scopeSpans": [{"spans": [{"traceId": "0a" * 16, "spanId": "0b" * 8, "name": "s1", "kind": 1, "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000001000000000", "status": {"code": 1}, "events": [{"name": "exception", "attributes": [{"key": "exception.type", "value": {"stringValue": "Boom"}}]}]}]}],
        }
    ]
}
LOGS = {
    "resourceLogs": [
        {
            "resource": {},
            "scopeLogs": [{"logRecords": [{"severityNumber": n, "severityText": t, "body": b} for n, t, b in [(0, "", {"stringValue": "x"}), (1, "", {"intValue": "5"}), (9, "INFO", {"boolValue": True}), (17, "", {"bytesValue": "AA=="}), (8, "", {"arrayValue": {"values": [{"intValue": "1"}]}}), (5, "", {"doubleValue": 1.5}), (5, "", None)]]}],
        }
    ]
}
METRICS = {
    "resourceMetrics": [
        {"scopeMetrics": [{"metrics": [{"name": "a", "gauge": {"dataPoints": [{"asInt": "3", "attributes": [{"key": "k", "value": {"stringValue": "v"}}]}]}}, {"name": "b", "histogram": {"dataPoints": [{}, {}]}}]}]}
    ]
}


def payloads(spark, *bodies):
    texts = [b if b is None or isinstance(b, str) else json.dumps(b) for b in bodies]
    return spark.createDataFrame([(t, k, NOW) for k, t in enumerate(texts)], "value string, batch_id long, arrival_ts timestamp")


def test_json_spans(spark):
    flat = flatten.flatten_spans(decode_json(payloads(spark, BODY), "traces"))
    r = flat.first()
    assert (r["service"], r["name"], r["kind"], r["status"], r["duration_ns"]) == ("smoke", "s1", 1, 1, 1_000_000_000)
    assert r["res"] == {"service.name": "smoke", "n": "7"}
    got = {x["le"]: x["cumulative_count"] for x in red.buckets(flat).collect()}
    assert got["0.5"] == 0 and got["1"] == got["+Inf"] == 1
    assert flatten.exceptions(flat).first()["type"] == "Boom"
    res = flatten.flatten_resources(decode_json(payloads(spark, BODY), "traces"), "traces").first()
    assert res["n_records"] == 1 and res["resource_bytes"] > 100


def test_malformed_payloads(spark):
    rows = payloads(spark, BODY, "no json", None, "[1]")
    counted = decode_json(rows, "traces")
    assert [r["malformed"] for r in counted.orderBy("batch_id").collect()] == [False, True, True]
    assert decode_json(rows, "traces", "skip").count() == 1
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        decode_json(payloads(spark, "no json"), "traces", "fail").select("envelope").collect()


def test_json_logs_and_metrics(spark):
    logs = flatten.flatten_logs(decode_json(payloads(spark, LOGS), "logs")).orderBy("idx").collect()
    assert [r["severity"] for r in logs] == ["unknown", "1", "INFO", "17", "8", "5", "5"]
    assert [r["body"] for r in logs][:4] == ["x", "5", "true", "<bytes>"] and logs[5]["body"] == "1.5" and logs[6]["body"] == ""
    envelopes = decode_json(payloads(spark, METRICS), "metrics")
    points = flatten.flatten_points(envelopes)
    assert points.groupBy("metric_type").count().orderBy("metric_type").collect() == [("gauge", 1), ("histogram", 2)]
    assert points.where("metric_name = 'a'").first()["value"] == 3.0
    assert flatten.flatten_resources(envelopes, "metrics").first()["n_records"] == 3
    assert flatten.point_attrs(points).collect() == [("a", "k", "v")]


@pytest.mark.parametrize(("signal", "body"), [("traces", BODY), ("logs", {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"severityNumber": 3, "body": {"stringValue": "x"}}]}]}]}), ("metrics", METRICS)])
def test_protobuf_round_trip(spark, signal, body):
    rows = payloads(spark, body)
    flat = {"traces": flatten.flatten_spans, "logs": flatten.flatten_logs, "metrics": flatten.flatten_points}[signal]
    cols = lambda df: df.drop("n_bytes", "arrival_ts", "bytes_est")
    wire = encode_otlp_proto(rows, signal)
    decoded = decode_otlp_proto(wire, signal)
    assert cols(flat(decoded)).collect() == cols(flat(decode_json(rows, signal))).collect()
    r = decoded.join(wire.select("batch_id", F.octet_length("value").alias("w")), "batch_id").first()
    assert 0 < sum(r["resource_bytes"]) < r["w"]
    sized = flatten.flatten_resources(decoded, signal).first()
    assert (sized["resource_bytes"], sized["bytes_basis"]) == (r["resource_bytes"][0], "wire")
    assert flatten.flatten_resources(decode_json(rows, signal), signal).first()["bytes_basis"] == "json"


def test_nested_values_in_protobuf(spark):
    nested = {"kvlistValue": {"values": [{"key": "a", "value": {"arrayValue": {"values": [{"intValue": "1"}, {"bytesValue": "AQI="}]}}}]}}
    body = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "1704067200000000000", "body": nested}, {"body": {"stringValue": ""}}]}]}]}
    rows = payloads(spark, body)
    logs = flatten.flatten_logs(decode_otlp_proto(encode_otlp_proto(rows, "logs"), "logs")).orderBy("idx").collect()
    assert json.loads(logs[0]["body"]) == nested["kvlistValue"] and logs[0]["body_bytes"] == len(logs[0]["body"])
    assert logs[0]["ts"] == NOW and logs[1]["ts"] == NOW and logs[0]["ord"] < logs[1]["ord"]


def test_batches(spark):
    got = {r["batch_id"]: r for r in flatten.flatten_batches(decode_json(payloads(spark, METRICS, "no json", None, {}), "metrics"), "metrics").collect()}
    assert [(k, r["n_records"], r["malformed"]) for k, r in sorted(got.items())] == [(0, 3, False), (1, 0, True), (3, 0, False)]
    assert got[1]["n_bytes"] == 7 and got[0]["ord"] == 0


def test_repeated_keys_in_an_object_are_no_fault(spark):
    text = json.dumps(BODY)[:-1] + ', "x": 1, "x": 2}'
    assert not decode_json(payloads(spark, text), "traces").first()["malformed"]


def test_spans_share_the_bytes_of_their_batch(spark):
    two = json.loads(json.dumps(BODY))
    two["resourceSpans"][0]["scopeSpans"][0]["spans"] *= 3
    envelopes = decode_json(payloads(spark, two), "traces")
    size = envelopes.first()["n_bytes"]
    assert {r["bytes_est"] for r in flatten.flatten_spans(envelopes).collect()} == {size // 3}
    assert flatten.flatten_spans(envelopes).select("error").distinct().collect() == [(True,)]


def test_protobuf_malformed(spark):
    bad = spark.createDataFrame([(b"\xff\xff\xff", 1, NOW)], "value binary, batch_id long, arrival_ts timestamp")
    assert decode_otlp_proto(bad, "traces").first()["malformed"]
    assert decode_otlp_proto(bad, "traces", "skip").count() == 0


def test_exposition(spark, tmp_path):
    text = '# HELP x y\n\nrx_spans{a="b",c="d \\" e"} 150\nup 1e3 1700000000\nmalformed_line\nname notanumber\ninf +Inf\n'
    lines = spark.createDataFrame([(x,) for x in text.split("\n")], "value string")
    got = {r["metric"]: (r["labels"], r["value"]) for r in parse_exposition(lines).collect()}
    assert got == {"rx_spans": ({"a": "b", "c": 'd " e'}, 150.0), "up": ({}, 1000.0), "inf": ({}, float("inf"))}
    (tmp_path / "m.txt").write_text(text)
    assert read_exposition(spark, str(tmp_path)).count() == 3
    df = spark.createDataFrame([("m", {"service.name": 'a"b'}, 2.0), ("n", {}, 1.0)], "metric string, labels map<string,string>, value double")
    assert sorted(r[0] for r in to_exposition(df).collect()) == ['m{service_name="a\\"b"} 2.0', "n 1.0"]


def test_exposition_reads_what_it_writes(spark):
    """Escaped signs, braces and quotes in values, and labels of which there is none or one twice."""
    signs = ['say "x" \\ y', "\\n isn't a line end", "two\nlines", "}", "{a=\"b\"} 5", "\\", "", "ü , =", "\\\\\"\n\\n"]
    rows = [(f"m{k}", {"a": v, "b": "1"}, float(k)) for k, v in enumerate(signs)] + [("none", {}, 1.5)]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, value double")
    got = {r["metric"]: (r["labels"], r["value"]) for r in parse_exposition(to_exposition(df)).collect()}
    assert got == {m: (labels, v) for m, labels, v in rows}
    lines = spark.createDataFrame([('q {a="1"} 5',), ('r{a="1",a="2"} 6 1700000000',), ('s{ a = "x" , b="y",} 7',)], "value string")
    got = {r["metric"]: (r["labels"], r["value"]) for r in parse_exposition(lines).collect()}
    assert got == {"q": ({"a": "1"}, 5.0), "r": ({"a": "2"}, 6.0), "s": ({"a": "x", "b": "y"}, 7.0)}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(BODY) + "\n")
    assert flatten.flatten_spans(read_otlp_json(spark, str(tmp_path / "in"), "traces")).count() == 1
    df = spark.createDataFrame([("s", 3)], "service string, n int")
    samples = as_samples(df, "requests", "n", F.lit(NOW), "service")
    write_samples(samples, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).select("labels", "value").first() == ({"service": "s"}, 3.0)
    write_jsonl(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
