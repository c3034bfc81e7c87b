from __future__ import annotations

import datetime
import json
import random
import time
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from telespark.config import JobConfig
from telespark.functions.hashing import sampled
from telespark.queries import streamed_decisions
from telespark.sources.sinks import as_samples
from telespark.streaming import jobs, processors
from tests.conftest import SF
from tests.test_sources import BODY, LOGS, NOW

ONCE = {"availableNow": True}


@pytest.fixture
def states(spark):
    for k, v in jobs.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in jobs.STATE_STORE:
        spark.conf.unset(k)


def test_services_are_new_once_over_a_stream(spark):
    rows = streamed_decisions(spark, SF).cache()
    plain = rows.where("service <> 'unknown' and reason not in ('error', 'slow')")
    per = plain.groupBy("service").agg(F.count_if(F.col("reason") == "rare").alias("n")).collect()
    assert len(per) > 10 and all(r["n"] == 1 for r in per)
    rest = rows.where("reason in ('probabilistic', 'boring')")
    assert rest.where((F.col("reason") == "probabilistic") != sampled(F.col("trace_id"))).isEmpty()
    assert rows.where("kept = (reason = 'boring')").isEmpty() and rows.select("batch").distinct().count() > 1


def stream_of(spark, path, rows, schema):
    """Appends rows to a folder and reads the whole as a stream, a file for each micro-batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_capped_sets_and_forks(spark, tmp_path, states):
    schema = "metric_name string, attr_key string, attr_value string"
    rows = [("m", "k", str(v % 7)) for v in range(30)]
    got = []
    sets = processors.distinct_values(stream_of(spark, tmp_path / "in", rows, schema), cap=5)
    sets.writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert max(r["distinct_values"] for r in got) == 5
    branches = {"count": lambda b: b.agg(F.count(F.lit(1)).alias("n")), "keys": lambda b: b.select("attr_key").distinct()}
    read = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.forked(read, branches, str(tmp_path / "out"), str(tmp_path / "c2"), trigger=ONCE).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "count")).first()["n"] == 30
    assert spark.read.parquet(str(tmp_path / "out" / "keys")).count() == 1


PAYLOADS = "value string, batch_id long, arrival_ts timestamp"


def test_counters_go_on_after_a_restart(spark, tmp_path):
    """Each call is a new start from the checkpoint; counters go on, and no payload counts twice."""
    path, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for turn in (1, 2):
        stream = stream_of(spark, path, [(json.dumps(BODY), turn, NOW), ("no json", 10 + turn, NOW)], PAYLOADS)
        jobs.start("volume", stream, "traces", out, at, wire=False, trigger=ONCE).awaitTermination()
        r = jobs.latest(spark, out).first()
        assert (r["batches"], r["records"], r["malformed"]) == (2 * turn, turn, turn)
    jobs.start("volume", spark.readStream.schema(PAYLOADS).parquet(str(path)), "traces", out, at, wire=False, trigger=ONCE).awaitTermination()
    assert jobs.latest(spark, out).first()["batches"] == 4
    skipped = JobConfig(malformed="skip")
    jobs.start("volume", spark.readStream.schema(PAYLOADS).parquet(str(path)), "traces", f"{out}2", f"{at}2", config=skipped, wire=False, trigger=ONCE).awaitTermination()
    assert jobs.latest(spark, f"{out}2").first()["batches"] == 2, "another job sees the whole stream"


@pytest.mark.parametrize(("job", "signal", "body", "column", "value"), [
    ("insights", "traces", BODY, "records", 1), ("top_services", "traces", BODY, "rank", 1), ("cost", "logs", LOGS, "records", 7), ("cost_usd", "logs", LOGS, "team", "unknown"),
    ("debug_waste", "logs", LOGS, "debug_records", 4), ("red_buckets", "traces", BODY, "service", "smoke"),
])
def test_jobs(spark, tmp_path, job, signal, body, column, value):
    stream = stream_of(spark, tmp_path / "in", [(json.dumps(body), 1, NOW)], PAYLOADS)
    jobs.start(job, stream, signal, str(tmp_path / "out"), str(tmp_path / "state"), wire=False, trigger=ONCE).awaitTermination()
    assert {r[column] for r in jobs.latest(spark, str(tmp_path / "out")).collect()} == {value}


def test_samples_of_a_stream(spark, tmp_path):
    stream = stream_of(spark, tmp_path / "in", [("a", 1), ("a", 2), ("b", 3)], "service string, n long")
    count = lambda df: df.groupBy("service").agg(F.sum("n").alias("n"))
    jobs.sampled(stream, count, lambda df: as_samples(df, "requests", "n", F.lit(NOW), "service"), str(tmp_path / "out"), str(tmp_path / "state"), trigger=ONCE).awaitTermination()
    got = {r["labels"]["service"]: r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 3.0, "b": 3.0}


def spans_of(*names):
    body = json.loads(json.dumps(BODY))
    body["resourceSpans"][0]["scopeSpans"][0]["spans"] = [{"name": n, "kind": 1} for n in names]
    return json.dumps(body)


def test_caps_hold_over_batches_and_restarts(spark, tmp_path):
    config, out, at = JobConfig(max_series=2, max_templates=1), str(tmp_path / "out"), str(tmp_path / "state")
    for batch, names in enumerate([["a", "a", "b"], ["c", "a"], ["b", "d"]]):
        stream = stream_of(spark, tmp_path / "in", [(spans_of(*names), batch, NOW)], PAYLOADS)
        jobs.start_guarded("red", stream, out, at, config=config, wire=False, trigger=ONCE).awaitTermination()
    total = spark.read.parquet(f"{out}/out").groupBy("name").agg(F.sum("requests").alias("n")).collect()
    assert {r["name"]: r["n"] for r in total} == {"a": 3, "b": 2, "__overflow__": 2}
    body = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": {"stringValue": x}} for x in ("disk 1", "disk 2", "net up")]}]}]}
    stream = stream_of(spark, tmp_path / "logs", [(json.dumps(body), 1, NOW)], PAYLOADS)
    jobs.start_guarded("templates", stream, f"{out}2", f"{at}2", config=config, wire=False, trigger=ONCE).awaitTermination()
    assert sorted((r["hash"] is None, r["n"]) for r in spark.read.parquet(f"{out}2/out").collect()) == [(False, 2), (True, 1)]


def ticks(*seconds):
    return [NOW + datetime.timedelta(seconds=s) for s in seconds]


def requests_of(spark, path, rows):
    """rows: (ord, seconds after the start, key, nonce)."""
    out = [(o, ticks(t)[0], k, str(int(ticks(t)[0].replace(tzinfo=datetime.timezone.utc).timestamp())), n, "s") for o, t, k, n in rows]
    return stream_of(spark, path, out, "ord long, ts timestamp, key_id string, sig_ts string, nonce string, sig string").withWatermark("ts", "10 seconds")


def test_requests_are_judged_over_batches_and_restarts(spark, tmp_path, states):
    """A nonce stays taken for its time to live from its taking, however far the watermark is, and a key revoked between two
    micro-batches is turned away in the second."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    keys = str(tmp_path / "keys")
    out, at = str(tmp_path / "out"), str(tmp_path / "state")

    def registry(s):
        return s.read.schema("key_id string, tenant_id string, revoked int").json(keys)

    def judge(rows):
        stream = requests_of(spark, tmp_path / "in", rows)
        jobs.audited(stream, registry, out, at, ttl_s=600, trigger=ONCE).awaitTermination()
        return {r["ord"]: (r["verdict"], r["tenant_id"]) for r in spark.read.parquet(out).collect()}

    n = "n" * 16
    spark.createDataFrame([("k", "t", 0)], "key_id string, tenant_id string, revoked int").write.mode("overwrite").json(keys)
    got = judge([(0, 0, "k", n), (1, 5, "k", n), (2, 300, "x", "m" * 16), (3, 301, None, n), (4, 302, "k", "short")])
    assert got == {0: ("accepted", "t"), 1: ("replay", "t"), 2: ("invalid_key", None), 3: ("missing_header", None), 4: ("bad_nonce", "t")}
    spark.createDataFrame([("k", "t", 1)], "key_id string, tenant_id string, revoked int").write.mode("overwrite").json(keys)
    got = judge([(5, 599, "k", n), (6, 600, "k", n), (7, 700, "k", "p" * 16)])
    assert got[5][0] == "replay" and got[6][0] == "invalid_key" and got[7][0] == "invalid_key", "the nonce is free again after 600 seconds, the key isn't"
    got = judge([(8, 1199, "k", n), (9, 1201, "k", n)])
    assert got[8][0] == "replay" and got[9][0] == "invalid_key"


def logs_of(*records):
    """records: (seconds, severity, body)."""
    made = [{"timeUnixNano": str(int(ticks(t)[0].replace(tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000_000), "severityText": s, "body": {"stringValue": b}} for t, s, b in records]
    return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": made}]}]})


def test_log_templates_over_batches_restarts_and_a_cap(spark, tmp_path):
    out, at, config = str(tmp_path / "out"), str(tmp_path / "state"), JobConfig(max_templates=2)
    batches = [
        [(0, "a", "disk 1"), (1, "b", "disk 2"), (2, "a", "net up")],
        [(9, "a", "disk 3"), (11, "a", "disk 4"), (12, "a", "late one"), (13, "b", "disk 5")],
        [(14, "b", "disk 6"), (15, "a", "net up"), (16, "c", "disk 7"), (17, "a", "late one")],
    ]
    for k, records in enumerate(batches):
        stream = stream_of(spark, tmp_path / "in", [(logs_of(*records), k, NOW)], PAYLOADS)
        jobs.start_logs(stream, out, at, config=config, wire=False, least=3, window_us=10_000_000, threshold=3, trigger=ONCE).awaitTermination()
    series = spark.read.parquet(f"{out}/occurrences").groupBy("severity").agg(F.sum("occurrences").alias("n")).collect()
    # of the seven records of "disk" the third counts for three, under its own severity
    assert {r["severity"]: r["n"] for r in series} == {"a": 4, "b": 2, "c": 1}
    floods = [(r["window_start"] - NOW).total_seconds() for r in spark.read.parquet(f"{out}/floods").orderBy("at").collect()]
    assert floods == [0, 11], "the first window fills up in the second batch, the next one in the third"
    assert {r["batch"]: r["overflow"] for r in spark.read.parquet(f"{out}/overflow").collect()} == {0: 0, 1: 1, 2: 1}


def test_small_tables_of_batches_are_replaced_in_turn(spark, tmp_path):
    slots = jobs.Slots(str(tmp_path / "t"), "k long")
    for batch in range(7):
        before = [r["k"] for r in slots.before(spark, batch).collect()]
        assert before == ([] if batch in (0, 4) else [batch - 1])
        rows = spark.createDataFrame([] if batch == 3 else [(batch,)], "k long")
        slots.write(spark.createDataFrame([(99,)], "k long"), batch)  # a first try that is done again
        slots.write(rows, batch)
    assert len(list((tmp_path / "t").iterdir())) == jobs.SLOTS


def test_traces_close_by_the_clock(spark, tmp_path, states):
    """Ten seconds are two tenths here; no span follows, and there is no watermark."""
    stream = stream_of(spark, tmp_path / "in", [(spans_of("a", "b"), 1, NOW)], PAYLOADS)
    q = jobs.start_tail(stream, str(tmp_path / "out"), str(tmp_path / "state"), length_ms=200, processing=True, wire=False, trigger={"processingTime": "1 second"})
    try:
        for _ in range(120):
            found = list((tmp_path / "out").glob("decisions/batch=*/part-*"))
            if found and spark.read.parquet(str(tmp_path / "out" / "decisions")).count():
                break
            time.sleep(0.5)
    finally:
        q.stop()
    rows = spark.read.parquet(str(tmp_path / "out" / "decisions")).collect()
    assert [(r["trace_id"], r["spans"]) for r in rows] == [("unknown", 2)]


def test_late_rows_and_malformed_payloads_become_samples(spark, tmp_path, states):
    target = str(tmp_path / "samples")
    listener = jobs.JobMetrics(spark, target)
    spark.streams.addListener(listener)
    try:
        for k, t in enumerate((3600, 7200, 0)):  # the last one is two hours late
            stream = stream_of(spark, tmp_path / "in", [(spans_of("a"), k, ticks(t)[0]), ("no json", 10 + k, ticks(t)[0])], PAYLOADS)
            jobs.start_tail(stream, str(tmp_path / "out"), str(tmp_path / "state"), wire=False, trigger=ONCE).awaitTermination()
        for _ in range(60):
            if (tmp_path / "samples").exists():
                sums = {r["metric"] + r["m"]: r["v"] for r in spark.read.parquet(target).groupBy("metric", F.coalesce(F.col("labels")["metric"], F.lit("")).alias("m")).agg(F.sum("value").alias("v")).collect()}
                if sums.get("job_late_rows") and sums.get("job_payloadsmalformed") == 3:
                    break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert sums["job_late_rows"] >= 1 and sums["job_payloadsmalformed"] == 3 and sums["job_payloadspayloads"] == 6


def test_cardinality_of_payloads(spark, tmp_path, states):
    point = lambda v: {"attributes": [{"key": "k", "value": {"stringValue": v}}], "asInt": "1"}
    body = lambda *vs: json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "gauge": {"dataPoints": [point(v) for v in vs]}}]}]}]})
    for k, values in enumerate((("a", "b"), ("b", "c", "d"))):
        stream = stream_of(spark, tmp_path / "in", [(body(*values), k, NOW)], PAYLOADS)
        jobs.start_cardinality(stream, str(tmp_path / "out"), str(tmp_path / "state"), cap=3, wire=False, trigger=ONCE).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.max("distinct_values")).first()[0] == 3


def test_rings_shed_by_age_and_number(spark, tmp_path, states):
    got = []
    for k, part in enumerate(([("s", 1, "a"), ("s", 2, "b"), ("t", 1, "x")], [("s", 3, "c"), ("s", 4, "d")])):
        rows = processors.last_rows(stream_of(spark, tmp_path / "in", part, "source string, ord long, line string"), 3)
        rows.writeStream.outputMode("update").foreachBatch(lambda b, _: got.append(sorted((r["source"], r["back"], r["line"]) for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert got == [[("s", 1, "b"), ("s", 2, "a"), ("t", 1, "x")], [("s", 1, "d"), ("s", 2, "c"), ("s", 3, "b")]]


def test_alerts_are_pending_fire_and_are_resolved(spark, tmp_path, states):
    schema = "type string, step_no long, holds boolean"
    for part in ([("a", 1, True), ("a", 2, True)], [("a", 3, True), ("a", 4, False), ("b", 1, True)], [("a", 6, True), ("b", 3, True), ("a", 7, False)]):
        rows = processors.alerts(stream_of(spark, tmp_path / "in", part, schema), 3)
        jobs.appended(rows, str(tmp_path / "out"), str(tmp_path / "c"), trigger=ONCE).awaitTermination()
    got = sorted((r["type"], r["start"], r["points"], r["state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1, 1, "pending"), ("a", 1, 3, "firing"), ("a", 1, 3, "resolved"), ("a", 6, 1, "pending"), ("b", 1, 1, "pending"), ("b", 3, 1, "pending")]


def test_json_lines_of_a_stream_in_files_of_bounded_length(spark, tmp_path):
    from telespark.sources.sinks import stream_jsonl

    stream = stream_of(spark, tmp_path / "in", [(k, ticks(0)[0]) for k in range(10)], "k long, ts timestamp")
    stream_jsonl(stream, str(tmp_path / "out"), str(tmp_path / "c"), max_rows=4, ts="ts", trigger=ONCE).awaitTermination()
    files = list((tmp_path / "out").glob("day=*/part-*.json"))
    assert len(files) == 3 and sum(len(f.read_text().splitlines()) for f in files) == 10


def test_micro_batches_stay_of_one_size_and_keep_step(spark, monkeypatch):
    from telespark import queries

    monkeypatch.setattr(queries, "TURN", 500)
    rows = spark.range(3000).select(F.col("id").alias("ord"), (F.col("id") % 7).alias("v"))
    ends = queries._turns(rows, F.col("ord"))
    for table, most in ((rows, 800), (rows.where("v = 0"), 120)):
        got = {}
        stream = queries._streamed(spark, table, "turns", "ord", ends)
        put = lambda b, k: got.__setitem__(k, b.agg(F.min("ord"), F.max("ord"), F.count(F.lit(1))).first())  # noqa: E731, B023
        stream.writeStream.foreachBatch(put).option("checkpointLocation", queries.shared_path(spark, "turns-state")).trigger(availableNow=True).start().awaitTermination()
        assert len(got) == len(ends) + 1 == 6 and all(0 < n <= most for _, _, n in got.values()), "two batches of half the table, before"
        assert all(got[k][1] <= ends[k] < got[k + 1][0] for k in range(5))
        assert sum(n for _, _, n in got.values()) == table.count()


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The events twice: those of greater ids have the same times again."""
    d = tmp_path_factory.mktemp("repeated")
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id").cast("long"))
    n = e.agg(F.max("event_id")).first()[0] + 1
    e.unionByName(e.withColumn("event_id", F.col("event_id") + n)).toPandas().to_parquet(d / "events.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    (d / "nation.parquet").symlink_to(f"{SF}/nation.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["stream_tail", "stream_tail_from_envelopes", "stream_flood", "stream_audit"])
def test_streams_go_by_time(spark, repeated, monkeypatch, name):
    """By number, the second half of these rows would be late."""
    from telespark import queries
    from tests.oracle import assert_same

    monkeypatch.setattr(queries, "TURN", 700)
    assert_same(queries.QUERIES[name](spark, repeated), repeated, queries.ORACLE_SQL[name])


def test_states_of_traces_and_nonces_are_rows_of_buckets(spark, tmp_path, states):
    rows = [(f"t{k}", "a", 1, False, 1, k, t) for k in range(2000) for t in ticks(k % 3)]
    schema = "trace_id string, service string, duration_ns long, error boolean, bytes_est long, ord long, arrival_ts timestamp"
    closed = processors.traces(stream_of(spark, tmp_path / "in", rows, schema).withWatermark("arrival_ts", "1 second"))
    q = jobs.appended(closed, str(tmp_path / "out"), str(tmp_path / "c"), trigger=ONCE)
    q.awaitTermination()
    assert max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= 2 * processors.BUCKETS
    # one span much later closes all but its own trace
    late = stream_of(spark, tmp_path / "in", [("end", "a", 1, False, 1, 9999, ticks(3600)[0])], schema).withWatermark("arrival_ts", "1 second")
    jobs.appended(processors.traces(late), str(tmp_path / "out"), str(tmp_path / "c"), trigger=ONCE).awaitTermination()
    got = spark.read.schema(processors.TRACE_COLUMNS).parquet(str(tmp_path / "out"))
    assert got.count() == got.select("trace_id").distinct().count() == 2000 and got.where("spans <> 1 or service <> 'a'").isEmpty()


class _Held:
    """Stands in for a handle and the one value that a processor keeps by it."""

    def __init__(self):
        self.value = None

    def getValueState(self, *_):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


def _flood_count(length_ms, threshold):
    counter = processors.FloodCount(length_ms, threshold)
    counter.init(_Held())
    return counter


def test_a_flood_s_records_are_held_as_numbers():
    counter, n = _flood_count(1000, 3), 200_000
    parts = (range(k, k + 10_000) for k in reversed(range(0, n, 10_000)))
    rows = (pd.DataFrame({"hash": "h", "service": [f"s{k % 5}" for k in p], "arrival_us": [k * 400_000 for k in p], "ord": list(p)}) for p in parts)
    tracemalloc.start()
    try:
        found = sum(len(f) for f in counter.handleInputRows(("h",), rows, None))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == n // 3
    assert most < 120 * n, "rows take more than that"


@pytest.mark.parametrize("wide", [False, True])
def test_floods_of_micro_batches_are_those_of_one_record_after_another(wide):
    dealt = random.Random(5)
    for length_ms, threshold in ((10, 1), (10, 3), (40, 4)):
        counter, held, found, wanted = _flood_count(length_ms, threshold), None, [], []
        for batch in range(12):
            rows = [Row(service=dealt.choice(["a", "b", None]), arrival_us=1000 * (20 * batch + dealt.randrange(-9, 30)), ord=(k % 3, k) if wide else k) for k in dealt.sample(range(40), dealt.randrange(1, 12))]
            frames = (pd.DataFrame([r.asDict() for r in rows[k : k + 4]]) for k in range(0, len(rows), 4))
            found += [tuple(r) for f in counter.handleInputRows(("h",), frames, None) for r in f[["window_start", "service", "at"]].itertuples(index=False)]
            for r in sorted(rows, key=lambda r: (r.arrival_us, r.ord)):
                if held is None or r.arrival_us - held[0] >= length_ms * 1000:
                    held = r.arrival_us, 0
                held = held[0], held[1] + 1
                if held[1] == threshold:
                    wanted.append((held[0], r.service, r.arrival_us))
            assert counter.count.get() == held
        assert [(start.value // 1000, service, at.value // 1000) for start, service, at in found] == wanted and wanted


def test_log_templates_work_out_only_the_tables_that_are_named(spark, tmp_path, monkeypatch):
    from telespark.operators import logdedup

    stream = lambda: spark.readStream.schema(PAYLOADS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for batch in range(2):
        rows = [(json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"severityText": "INFO", "body": {"stringValue": f"t{'ab'[k % 2]} {k}"}}]}]}]}), 10 * batch + k, NOW) for k in range(7)]
        stream_of(spark, tmp_path / "in", rows, PAYLOADS)
    rules = {"wire": False, "least": 3, "window_us": 10_000_000, "threshold": 3, "trigger": ONCE}
    jobs.start_logs(stream(), str(tmp_path / "all"), str(tmp_path / "c0"), **rules).awaitTermination()
    for n, (table, other) in enumerate([("floods", "occurrences_of"), ("occurrences", "flood_events")]):
        with monkeypatch.context() as m:
            m.setattr(logdedup, other, None)
            jobs.start_logs(stream(), str(tmp_path / table), str(tmp_path / f"c{n + 1}"), tables=[table], **rules).awaitTermination()
        read = lambda job: sorted(map(str, spark.read.parquet(str(tmp_path / job / table)).collect()))  # noqa: E731, B023
        assert read(table) == read("all") and read(table)
        assert {f.name for f in (tmp_path / table).iterdir()} == {table, "templates"}
