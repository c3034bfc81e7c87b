from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telespark.operators import access, cardinality, insights, logdedup, red, tail, topn, volume
from telespark.operators.anchored import anchored, starts
from telespark.plans import samples as metric

T0 = datetime.datetime(2024, 1, 1)


def at(seconds: float) -> datetime.datetime:
    return T0 + datetime.timedelta(seconds=seconds)


def spans(spark, rows):
    return spark.createDataFrame(rows, "service string, name string, kind int, status int, duration_ns long, ord long")


def test_histogram_of_30_ms(spark):
    found = {r["le"]: r["cumulative_count"] for r in red.buckets(spans(spark, [("s", "n", 1, 1, 30_000_000, 0)])).collect()}
    assert [found[x] for x in ("0.005", "0.01", "0.025")] == [0, 0, 0]
    assert all(found[x] == 1 for x in ("0.05", "0.1", "0.25", "0.5", "1", "2.5", "5", "10", "+Inf"))


def test_quantile_interpolates_and_stops_at_the_last_bound(spark):
    bounds = ["0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1", "2.5", "5", "10", "+Inf"]
    counts = [0, 0, 10, 80, 180, 195, 199, 200, 200, 200, 200, 200]
    df = spark.createDataFrame([("a", b, c) for b, c in zip(bounds, counts)] + [("b", "10", 0), ("b", "+Inf", 4), ("c", "+Inf", 0)], "g string, le string, cumulative_count long")
    got = {r["g"]: r["quantile"] for r in metric.quantile(df, 0.95, ("g",)).collect()}
    assert abs(got["a"] - 0.2) < 1e-9 and got["b"] == 10.0 and got["c"] is None


def test_overflow_of_pairs(spark):
    rows = [("s", f"n{k}", 1, 0, 1, k) for k in range(5)] + [("s", "n4", 1, 0, 1, 9), ("s", "", 1, 0, 1, 10)]
    got = {r["name"]: r["requests"] for r in red.endpoints(red.guarded(spans(spark, rows), 4)).collect()}
    assert got == {"n0": 1, "n1": 1, "n2": 1, "n3": 1, "__overflow__": 3}


def test_red_invariants(spark):
    rows = [("s", f"n{k % 3}", 1, k % 3, k * 7_000_000, k) for k in range(100)]
    df = spans(spark, rows)
    for r in red.buckets(df).groupBy("service", "name").agg(F.array_sort(F.collect_list(F.struct("cumulative_count"))).alias("c"), F.max("cumulative_count").alias("m")).collect():
        assert r["c"][-1][0] == r["m"]
    totals = {r["name"]: r["count"] for r in red.count_sum(df).collect()}
    inf = {r["name"]: r["cumulative_count"] for r in red.buckets(df).where("le = '+Inf'").collect()}
    assert totals == inf


def test_tail_rules(spark):
    rows = [
        ("e", "a", 1, True, 0.0), ("s", "a", 1_000_000_001, False, 1.0), ("r", "a", 1_000_000_000, False, 2.0),
        ("t4", "a", 1, False, 3.0), ("u", "unknown", 1, False, 4.0),
    ]
    df = spark.createDataFrame([(t, s, d, e, 10, at(x), k) for k, (t, s, d, e, x) in enumerate(rows)], "trace_id string, service string, duration_ns long, error boolean, bytes_est long, arrival_ts timestamp, ord long")
    got = {r["trace_id"]: r["reason"] for r in tail.decide(tail.trace_facts(df)).collect()}
    assert got["e"] == "error" and got["s"] == "slow" and got["r"] == "rare"
    # 't4' hashes to 116 * 31 + 52 = 3648 -> 48, 'u' to 117 -> 17
    assert got["t4"] == "boring" and got["u"] == "boring"
    kept = tail.kept_ratio(tail.decide(tail.trace_facts(df))).first()
    assert kept["kept_ratio"] == 0.6 and abs(kept["bytes_saved_share"] - 0.4) < 1e-9


def test_anchored_windows(spark):
    df = spark.createDataFrame([("k", at(s), s) for s in (0, 9, 10, 25, 19)] + [(None, at(3), 3)], "k string, ts timestamp, ord long")
    got = {(r["k"], r["ord"]): (r["window_start"] - T0).total_seconds() for r in anchored(df, "k", "ts", 10_000_000, "ord").collect()}
    assert got == {("k", 0): 0, ("k", 9): 0, ("k", 10): 10, ("k", 19): 10, ("k", 25): 25, (None, 3): 3}


@pytest.mark.parametrize("seed", range(6))
def test_windows_of_a_key_that_is_cut_into_pieces(spark, seed):
    """One key of all rows, and one among others, in more pieces than windows or fewer; equal to one fold of each key."""
    rng = random.Random(seed)
    span, n = [(400, 900), (5_000, 900), (90_000, 300), (30, 500), (1, 200), (2_000, 900)][seed]
    keys = ["hot"] if seed % 2 else ["hot"] * 8 + ["a", "b", None]
    rows = [(rng.choice(keys), rng.randrange(span) * 1000, k) for k in range(n)]
    df = spark.createDataFrame(rows, "k string, us long, ord long").withColumn("ts", F.timestamp_micros("us"))
    out = anchored(df, "k", "ts", 50_000, "ord", pieces=13)
    assert out.columns == ["k", "us", "ord", "ts", "window_start"]
    got = {r["ord"]: r["w"] for r in out.select("ord", F.unix_micros("window_start").alias("w"), F.spark_partition_id().alias("p")).collect()}
    assert out.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 6 or span == 1
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((t, o) for k, t, o in rows if k == key)
        want |= dict(zip((o for _, o in mine), starts(np.array([t for t, _ in mine]), 50_000, None).tolist()))
    assert got == want


def test_floods_leave_out_what_is_not_admitted(spark):
    rows = [("slow query", 0), ("slow query", 0), ("disk full", 1), ("slow query", 3), ("slow query", 12), ("disk full", 13), ("disk full", 14), ("disk full", 15)]
    df = spark.createDataFrame([(k, at(t), f"s{k}", "1", b, len(b)) for k, (b, t) in enumerate(rows)], "ord long, ts timestamp, service string, severity string, body string, body_bytes long")
    assert logdedup.floods(df, 10_000_000, 3).orderBy("service").collect() == [("s3", 1), ("s7", 1)]
    assert logdedup.floods(df, 10_000_000, 3, cap=1).collect() == [("s3", 1)]
    assert logdedup.floods(df, 10_000_000, 2, cap=1).collect() == [("s1", 1)]
    one = logdedup.summary(df, cap=1).first()
    assert (one["records"], one["unique_templates"], one["overflow"], one["bytes_saved"]) == (8, 1, 4, 30)
    assert logdedup.summary(df.limit(0)).first()["dedup_ratio"] == 0.0


def test_templates_of_one_hash_are_one(spark):
    """``Aa`` and ``BB`` have the same hash."""
    df = spark.createDataFrame([(0, at(0), "s", "1", "Aa", 2), (1, at(1), "t", "2", "BB", 2), (2, at(2), "u", "3", None, 0)], "ord long, ts timestamp, service string, severity string, body string, body_bytes long")
    got = {r["sample"]: (r["occurrences"], r["last_service"]) for r in logdedup.template_stats(df).collect()}
    assert got == {"Aa": (2, "t"), "": (1, "u")}
    assert logdedup.floods(df, 10_000_000, 2).collect() == [("t", 1)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=60), st.integers(1, 60), st.integers(1, 59))
def test_starts_equals_a_plain_fold(times, length, cut):
    times = sorted(times)
    want, open_at = [], None
    for t in times:
        if open_at is None or t - open_at >= length:
            open_at = t
        want.append(open_at)
    a = np.array(times, dtype=np.int64)
    head = starts(a[:cut], length, None)
    rest = starts(a[cut:], length, int(head[-1])) if len(a) > cut else a[:0]
    assert [*head.tolist(), *rest.tolist()] == want


def test_monotonic_times(spark):
    df = spark.createDataFrame([(k, ms) for k, ms in enumerate([5, 5, 5, 9, 3, 20])], "ord long, now_ms long")
    for width in (1, 2, 4, 1 << 16):
        assert [r["sample_ms"] for r in volume.monotonic(df, width=width).orderBy("ord").collect()] == [5, 6, 7, 9, 10, 20]


def test_running_totals_over_buckets(spark):
    df = spark.createDataFrame([(k, k % 3 if k % 5 else None, k % 7) for k in range(60)], "ord long, g long, n_records long")
    want, sums = {}, {}
    for r in df.orderBy("ord").collect():
        want[r["ord"]] = sums[r["g"]] = sums.get(r["g"], 0) + r["n_records"]
    for width in (1, 7, 1 << 16):
        assert {r["ord"]: r["total"] for r in volume.running_totals(df, "g", width=width).collect()} == want


def test_label_selectors(spark):
    df = spark.createDataFrame([("lag", {"topic": "otlp-traces"}, 1.0), ("lag", {"topic": "other"}, 2.0), ("lag", {}, 3.0), ("up", {"topic": "otlp-logs"}, 4.0)], "metric string, labels map<string,string>, value double")
    value = lambda x: sorted(r["value"] for r in x.collect())
    assert value(metric.matching(df, "lag", topic="otlp-.*")) == [1.0] and value(metric.matching(df, "lag", topic=".*")) == [1.0, 2.0, 3.0] and value(metric.matching(df, "lag", topic="other|")) == [2.0, 3.0]


def test_kept_spans_go_on_by_window(spark, tmp_path):
    from telespark.sources.sinks import emit_kept

    spans = spark.createDataFrame([("t", 1, "a", at(0)), ("t", 2, "b", at(0)), ("u", 1, "c", at(0))], "trace_id string, window_start int, span_id string, ts timestamp")
    decisions = spark.createDataFrame([("t", 1, True), ("t", 2, False), ("u", 1, False)], "trace_id string, window_start int, kept boolean")
    emit_kept(spans, decisions, str(tmp_path / "k"), "window_start")
    assert [r["span_id"] for r in spark.read.json(str(tmp_path / "k")).collect()] == ["a"]


def test_anchored_keeps_other_columns(spark):
    df = spark.createDataFrame([("k", at(0), 1, 2)], "k string, ts timestamp, window_us int, _t int")
    assert anchored(df, "k", "ts", 10).select("window_us", "_t").first() == (1, 2)


def test_throughput(spark):
    def speed(points):
        df = spark.createDataFrame([(int(t * 1e6), float(v) if v is not None else None, v is None) for t, v in points], "t_us long, value double, failed boolean")
        return [r["per_second"] for r in metric.throughput(df, ()).orderBy("t_us").collect()]

    assert speed([(0, 0), (2, 200), (4, 400)]) == [0, 100, 100]
    assert speed([(0, 1000), (1, 10)])[-1] == 0
    assert speed([(0, 0), (4, 40), (6, 60), (9, 90), (10, 100)])[-1] == 10
    assert speed([(0, 0), (1, None), (2, 50), (3, 60)]) == [0, None, 0, 10]


def test_last_n_and_rates(spark):
    lines = spark.createDataFrame([(k, x) for k, x in enumerate("abcd")], "ord int, line string")
    assert sorted(r["line"] for r in topn.last_n(lines, 3, (), "ord").collect()) == ["b", "c", "d"]
    config = spark.createDataFrame([(True, 10.0, 2), (True, 5.0, 4), (True, 0.0, 1), (False, 9.0, 1), (True, 3.0, 0)], "enabled boolean, rate double, workers int")
    assert [r["target"] for r in access.target_rate(config).collect()] == [20, 20, -1, 0, 3]


def test_top_services(spark):
    rows = [("traces", {"service.name": f"heavy{k:02}"}, 400) for k in range(12)] + [("traces", {"service.name": f"tiny{k:03}"}, 10) for k in range(150)]
    got = topn.top_services(spark.createDataFrame(rows, "signal string, attrs map<string,string>, n_records long")).orderBy("rank").collect()
    assert [r["service"] for r in got] == [f"heavy{k:02}" for k in range(12)] + [f"tiny{k:03}" for k in range(88)]


def test_cardinality(spark):
    rows = [("checkout.latency", "cpf", str(k)) for k in range(200)] + [("checkout.latency", "status", str(k % 3)) for k in range(200)]
    df = spark.createDataFrame(rows, "metric_name string, attr_key string, attr_value string")
    got = {r["attr_key"]: (r["distinct_values"], r["observations"], r["saturated"]) for r in cardinality.attr_cardinality(df, 150).collect()}
    assert got == {"cpf": (150, 200, True), "status": (3, 200, False)}
    near = {r["attr_key"]: r["distinct_values"] for r in cardinality.attr_cardinality(df, approximate=True).collect()}
    assert abs(near["cpf"] - 200) <= 20


def test_insights_breakdowns_all_sum_to_the_total(spark):
    from telespark import views
    from tests.conftest import SF

    sums = {r["breakdown"]: r["n"] for r in insights.insights(views.resources(spark, SF)).groupBy("breakdown").agg(F.sum("records").alias("n")).collect()}
    assert len(sums) == len(insights.BREAKDOWNS) and len(set(sums.values())) == 1


def test_extrapolated_rate(spark):
    df = spark.createDataFrame([("a", at(15 + 10 * k), 10.0 * k) for k in range(4)], "s string, ts timestamp, value double")
    got = metric.rate(df, ("s",), "60 seconds", 60, extrapolate=True).first()["rate"]
    # 30 in 30 s; the start is 1.5 gaps away, so half a gap is added there and at the end
    assert abs(got - 40 / 60) < 1e-9


def test_generator_lines(spark):
    lines = ["2024-01-01 ok", "plain", "2024-01-01 grpc_log x", "2024 no dash", "2023-12-31 channelz/ y"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r[0] for r in access.generator_lines(df).collect()] == ["2024-01-01 ok"]
