"""Jobs: batch operators as streaming queries with checkpoints of their own.

What a micro-batch writes goes to a folder named after it and is written whole, so a batch that is run again after a failure
replaces what it left.  State that has to be shared by all keys (known services, admitted keys, open windows of templates)
is a small table that each micro-batch writes anew, in one of a few folders in turn, so nothing piles up.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from telespark.config import JobConfig
from telespark.operators import access, cost, flatten, insights, logdedup, red, tail, topn, volume
from telespark.operators.guard import admitted
from telespark.sources.otlp_json import decode_json
from telespark.sources.otlp_proto import decode_otlp_proto
from telespark.streaming import processors

#: What stateful processors need of the session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
Put = Callable[[DataFrame, int], None]
#: Folders that take turns for what each micro-batch replaces.
SLOTS = 3
#: What ``log_templates`` writes.
LOG_TABLES = ("occurrences", "floods", "overflow")


def _each(stream: DataFrame, put: Put, checkpoint: str, trigger: dict | None, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": JobConfig.trigger})).start()


def counters(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, *, report: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Keeps an operator's counters over all that has come and writes them whole after each micro-batch.

    The operator is a plain aggregation, the same as in batch; its state outlives restarts.  ``report`` is applied to the
    counters before they are written: with a trigger of 60 seconds, a snapshot of the greatest few, for instance.  Readers
    take ``latest``, which names no batch that isn't whole; what a batch has written is replaced three batches later.
    """

    def put(df: DataFrame, batch: int) -> None:
        (report(df) if report else df).write.mode("overwrite").parquet(f"{target}/slot={batch % SLOTS}")
        df.sparkSession.range(1).select(F.lit(batch).cast("long").alias("batch")).coalesce(1).write.mode("append").parquet(f"{target}-done")

    return _each(operator(stream), put, checkpoint, trigger, "complete")


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The counters as the last micro-batch left them."""
    batch = spark.read.schema("batch long").parquet(f"{target}-done").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{target}/slot={batch % SLOTS}")


def appended(stream: DataFrame, target: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream's rows to ``target``, each exactly once."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": JobConfig.trigger})).start()


def sampled(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], to_samples: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Writes the counters as samples (metric, labels, ts, value) after each micro-batch: the series of a dashboard."""
    return _each(operator(stream), lambda df, batch: to_samples(df).write.mode("overwrite").parquet(f"{target}/batch={batch}"), checkpoint, trigger, "complete")


def forked(stream: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]], target: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Reads each micro-batch once and appends what each branch makes of it to a table of its own under ``target``."""

    def put(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for name, branch in branches.items():
                branch(df).write.mode("overwrite").parquet(f"{target}/{name}/batch={batch}")
        finally:
            df.unpersist()

    return _each(stream, put, checkpoint, trigger)


class Slots:
    """A small table that each micro-batch replaces.  A batch that is run again finds it as the batch before left it."""

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path, schema

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """The table as it was before this batch, whose own folder isn't read."""
        if batch == 0 and not self._made(spark):
            self.write(spark.createDataFrame([], self.schema), -1)
        rows = spark.read.schema(f"{self.schema}, _batch long, _row boolean").parquet(*(f"{self.path}/slot={k}" for k in self._made(spark) if k != batch % SLOTS))
        newest = rows.where(F.col("_batch") < batch).agg(F.max("_batch")).first()[0]
        return rows.where((F.col("_batch") == newest) & F.col("_row")).drop("_batch", "_row")

    def write(self, rows: DataFrame, batch: int) -> None:
        mark = rows.sparkSession.createDataFrame([(batch, False)], "_batch long, _row boolean")
        marked = rows.withColumns({"_batch": F.lit(batch).cast("long"), "_row": F.lit(True)}).unionByName(mark, allowMissingColumns=True)
        marked.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/slot={batch % SLOTS}")

    def _made(self, spark: SparkSession) -> list[int]:
        at = [spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/slot={k}/_SUCCESS") for k in range(SLOTS)]
        return [k for k, p in enumerate(at) if p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)]


class Known:
    """Rows that micro-batches have added."""

    def __init__(self, path: str, schema: str):
        self.slots = Slots(path, schema)

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """What the batches before this one have added."""
        return self.slots.before(spark, batch)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Must come once for each batch, after ``before``."""
        self.slots.write(self.before(rows.sparkSession, batch).unionByName(rows), batch)


def guarded(stream: DataFrame, keys: list[str], order: str, cap: int, branch: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Writes ``branch`` of each micro-batch with a column admitted: whether the row's key is among the ``cap`` that came
    first, by batch and then by ``order``.

    The admitted keys are at most ``cap`` rows, which are broadcast; nothing else is remembered of keys.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema if f.name in keys)
    known = Known(f"{target}/keys", schema)

    def put(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            admit(df, batch)
        finally:
            df.unpersist()

    def admit(df: DataFrame, batch: int) -> None:
        before = known.before(df.sparkSession, batch).select(*keys)
        same = lambda x: [df[k].eqNullSafe(x[k]) for k in keys]
        new = admitted(df.join(F.broadcast(before), same(before), "left_anti"), keys, order, max(0, cap - before.count()))
        known.add(new, batch)
        every = known.before(df.sparkSession, batch + 1).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.lit(True).alias("_in"))
        flagged = df.join(F.broadcast(every), [df[k].eqNullSafe(every[f"_k_{k}"]) for k in keys], "left")
        flagged = flagged.withColumn("admitted", F.coalesce("_in", F.lit(False))).drop("_in", *(f"_k_{k}" for k in keys))
        branch(flagged).write.mode("overwrite").parquet(f"{target}/out/batch={batch}")

    return _each(stream, put, checkpoint, trigger)


def decided(traces: DataFrame, target: str, checkpoint: str, *, slow_ns: int = tail.SLOW_NS, percent: int = 5, max_services: int = JobConfig.max_services, trigger: dict | None = None) -> StreamingQuery:
    """Decides closed traces batch by batch and writes them to ``target``/decisions.

    A service is new once over the whole stream: those that were new before are a table of at most ``max_services`` names.
    """
    known = Known(f"{target}/services", "service string")

    def put(df: DataFrame, batch: int) -> None:
        seen = known.before(df.sparkSession, batch)
        decisions = f"{target}/decisions/batch={batch}"
        df.persist()  # read twice, and the keyed state behind it is worked on once
        try:
            tail.decide(df, slow_ns=slow_ns, percent=percent, max_services=max(0, max_services - seen.count()), seen=seen).write.mode("overwrite").parquet(decisions)
        finally:
            df.unpersist()
        found = df.sparkSession.read.parquet(decisions)
        known.add(found.where("reason = 'rare'").select("service").distinct(), batch)

    return _each(traces, put, checkpoint, trigger)


def audited(requests: DataFrame, registry: Callable[[SparkSession], DataFrame], target: str, checkpoint: str, *, skew_s: int = 300, nonce: tuple[int, int] = (16, 128), ttl_s: int = 600, trigger: dict | None = None) -> StreamingQuery:
    """Writes ord, key_id, tenant_id and verdict of each request of a stream (ts, with a watermark, key_id, sig_ts, nonce, sig,
    ord), as ``access.audit`` has them.

    A nonce that is taken stays so for ``ttl_s`` in keyed state.  ``registry`` gives the keys (key_id, tenant_id, revoked)
    anew for each micro-batch, so a key revoked between two of them is turned away in the second.
    """
    rows = requests.withColumn("early", access.early_verdict(skew_s=skew_s, nonce=nonce))
    checked = processors.taken(rows.where(F.col("early").isNull()), ttl_s)
    turned_away = rows.where(F.col("early").isNotNull()).select("ord", F.unix_micros("ts").alias("arrival_us"), "key_id", "early", F.lit(False).alias("replay"))

    def put(df: DataFrame, batch: int) -> None:
        access.judged(df, registry(df.sparkSession)).drop("arrival_us").write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return _each(checked.unionByName(turned_away), put, checkpoint, trigger)


def kept_live(spans: DataFrame, decisions: DataFrame, length: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """The spans of kept windows, from streams of spans (trace_id, arrival_ts) and decisions (trace_id, window_start, kept),
    each with the window it belongs to.

    Both sides have watermarks, and a span belongs to a window that starts at most ``length`` before it, so neither side is
    held for longer than that and ``late``.
    """
    s = spans.withWatermark("arrival_ts", late)
    d = decisions.where("kept").select(F.col("trace_id").alias("_trace"), "window_start").withWatermark("window_start", late)
    inside = (F.col("trace_id") == F.col("_trace")) & (F.col("arrival_ts") >= F.col("window_start")) & (F.col("arrival_ts") < F.col("window_start") + F.expr(f"INTERVAL {length}"))
    return s.join(d, inside).drop("_trace")


def log_templates(logs: DataFrame, target: str, checkpoint: str, *, least: int = 100, window_us: int = 60_000_000, threshold: int = 1000, cap: int = logdedup.CAP, tables: Collection[str] = LOG_TABLES, trigger: dict | None = None) -> StreamingQuery:
    """Occurrences and floods of a stream of flattened log records: ``target``/occurrences has the growth of each series,
    back-filled when a template has its ``least``-th record, ``target``/floods an event for each window that fills up, and
    ``target``/overflow how many records of each batch belong to no admitted template.  Only those of these ``tables`` that
    are named are worked out; a job that is started again has to name the same.

    Each micro-batch is handled by the batch operators, which split hot templates.  What lasts is a table of one row for each
    of the at most ``cap`` admitted templates: how many records it has had, and its last window.  Sessions need
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, so that checkpoints of past batches go.
    """
    held = Slots(f"{target}/templates", "hash string, total long, ts timestamp, n long")

    def put(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        rows = logdedup.fingerprinted(df).select("service", "severity", "ts", "ord", "template", F.xxhash64("template").alias("key")).persist()
        try:
            step(spark, rows, batch)
        finally:
            rows.unpersist()

    def step(spark: SparkSession, rows: DataFrame, batch: int) -> None:
        before = held.before(spark, batch).persist()
        found = logdedup.hashes(rows).persist()  # read by all that follows
        new = found.groupBy("hash").agg(F.min("first_ord").alias("first_ord")).join(F.broadcast(before), "hash", "left_anti")
        new = new.orderBy("first_ord", "hash").limit(max(0, cap - before.count())).select("hash")
        known = before.select("hash").unionByName(new)
        records = rows.join(F.broadcast(found.join(F.broadcast(known), "hash", "left_semi").select("key", "hash")), "key").select("hash", "service", "severity", "ts", "ord").persist()
        total = before.select("hash", "total").unionByName(records.groupBy("hash").agg(F.count(F.lit(1)).alias("total"))).groupBy("hash").agg(F.sum("total").alias("total"))
        last = before.select("hash", "ts", "n").limit(0)
        if "occurrences" in tables:
            logdedup.occurrences_of(records, least, before.select("hash", F.col("total").alias("n"))).write.mode("overwrite").parquet(f"{target}/occurrences/batch={batch}")
        if "floods" in tables:
            floods, last = logdedup.flood_events(records, window_us, threshold, before.where(F.col("ts").isNotNull()).select("hash", "ts", "n"))
            floods.write.mode("overwrite").parquet(f"{target}/floods/batch={batch}")
        if "overflow" in tables:
            dropped = rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(records.agg(F.count(F.lit(1)).alias("m"))).select((F.col("n") - F.col("m")).alias("overflow"))
            dropped.write.mode("overwrite").parquet(f"{target}/overflow/batch={batch}")
        held.write(total.join(last, "hash", "left").select("hash", "total", "ts", "n"), batch)
        for held_back in (records, found, before):
            held_back.unpersist()

    return _each(logs, put, checkpoint, trigger)


class JobMetrics(StreamingQueryListener):
    """Writes what each micro-batch reports of itself to a table of samples (metric, labels, ts, value): the metrics that the
    stream observes (``observed``), and the rows that stateful operators have dropped as late."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        labels = {"job": p.name or str(p.id)}
        found = [(f"job_{name}", {**labels, "metric": metric}, float(v or 0)) for name, r in p.observedMetrics.items() for metric, v in r.asDict().items()]
        found += [("job_late_rows", {**labels, "operator": o.operatorName}, float(o.numRowsDroppedByWatermark)) for o in p.stateOperators]
        if found:
            rows = self.spark.createDataFrame(found, "metric string, labels map<string,string>, value double").withColumn("ts", F.lit(p.timestamp).cast("timestamp"))
            rows.select("metric", "labels", "ts", "value").coalesce(1).write.mode("append").parquet(self.target)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed(envelopes: DataFrame) -> DataFrame:
    """Reports payloads, bytes and malformed payloads of each micro-batch of envelopes, for ``JobMetrics``."""
    return envelopes.observe("payloads", F.count(F.lit(1)).alias("payloads"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"), F.count_if("malformed").alias("malformed"))


#: Counters that a job keeps of a signal: how envelopes are flattened, and the operator and report on the flat rows.
JOBS: dict[str, tuple[Callable, Callable, Callable | None]] = {
    "volume": (flatten.flatten_batches, lambda rows, c: volume.volume(rows), None),
    "insights": (flatten.flatten_resources, lambda rows, c: insights.by_labels(rows), insights.breakdowns),
    "top_services": (flatten.flatten_resources, lambda rows, c: topn.records_by_service(rows), lambda df: topn.top_k(df, "records", 100, ("signal",), ("service",))),
    "cost": (flatten.flatten_resources, lambda rows, c: cost.cost(rows), None),
    "cost_usd": (flatten.flatten_resources, lambda rows, c: cost.cost_usd(rows, c.usd_per_gb), None),
    "debug_waste": (lambda e, _: flatten.flatten_logs(e), lambda rows, c: cost.debug_waste(rows), None),
    "red_buckets": (lambda e, _: flatten.flatten_spans(e), lambda rows, c: red.buckets(rows, c.latency_bounds), None),
}


def start(job: str, payloads: DataFrame, signal: str, target: str, checkpoint: str, *, config: JobConfig = JobConfig(), wire: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Runs one of ``JOBS`` on a stream of payloads (value, batch_id, arrival_ts), in protobuf (``wire``) or JSON.

    Every job has a checkpoint of its own and so sees the whole stream.
    """
    flat, operator, report = JOBS[job]
    envelopes = observed((decode_otlp_proto if wire else decode_json)(payloads, signal, config.malformed))
    return counters(flat(envelopes, signal), lambda rows: operator(rows, config), target, checkpoint, report=report, trigger=trigger or {"processingTime": config.trigger})


def start_guarded(job: str, payloads: DataFrame, target: str, checkpoint: str, *, config: JobConfig = JobConfig(), wire: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Runs ``red`` (endpoints of each batch, names past the cap folded) or ``templates`` (records of each batch by
    template, those past the cap together) on a stream of payloads; a reader sums the batches up."""
    decode = decode_otlp_proto if wire else decode_json
    trigger = trigger or {"processingTime": config.trigger}
    if job == "red":
        spans = flatten.flatten_spans(decode(payloads, "traces", config.malformed)).select("service", "name", "status", "ord")
        fold = lambda df: red.endpoints(df.withColumn("name", F.when(F.col("admitted"), F.col("name")).otherwise(red.OVERFLOW)))
        return guarded(spans, ["service", "name"], "ord", config.max_series, fold, target, checkpoint, trigger=trigger)
    if job == "templates":
        logs = logdedup.templated(flatten.flatten_logs(decode(payloads, "logs", config.malformed))).select("hash", "service", "body_bytes", "ord")
        tally = lambda df: df.groupBy(F.when(F.col("admitted"), F.col("hash")).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.sum("body_bytes").alias("bytes"))
        return guarded(logs, ["hash"], "ord", config.max_templates, tally, target, checkpoint, trigger=trigger)
    raise ValueError(f"no such job: {job}")


def start_tail(payloads: DataFrame, target: str, checkpoint: str, *, config: JobConfig = JobConfig(), length_ms: int = 10_000, processing: bool = False, late: str = "1 minute", wire: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Tail sampling on a stream of payloads: spans are folded into traces, by event time or by the clock (``processing``),
    and decided as they close; ``target``/decisions has the decisions.  Needs ``STATE_STORE``."""
    spans = flatten.flatten_spans(observed((decode_otlp_proto if wire else decode_json)(payloads, "traces", config.malformed)))
    timed = spans if processing else spans.withWatermark("arrival_ts", late)
    return decided(processors.traces(timed, length_ms, processing=processing), target, checkpoint, max_services=config.max_services, trigger=trigger or {"processingTime": config.trigger})


def start_logs(payloads: DataFrame, target: str, checkpoint: str, *, config: JobConfig = JobConfig(), wire: bool = True, tables: Collection[str] = LOG_TABLES, trigger: dict | None = None, **rules: int) -> StreamingQuery:
    """``log_templates`` on a stream of payloads, with its least, window_us and threshold as ``rules``."""
    logs = flatten.flatten_logs(observed((decode_otlp_proto if wire else decode_json)(payloads, "logs", config.malformed)))
    slim = logs.select("service", "severity", "body", "body_bytes", "ts", "ord")
    return log_templates(slim, target, checkpoint, cap=config.max_templates, tables=tables, trigger=trigger or {"processingTime": config.trigger}, **rules)


def start_cardinality(payloads: DataFrame, target: str, checkpoint: str, *, config: JobConfig = JobConfig(), cap: int = 10_000, wire: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Growing distinct counts of the data points' attributes of a stream of payloads, up to ``cap`` for each; a reader takes
    the greatest.  Needs ``STATE_STORE``."""
    points = flatten.flatten_points(observed((decode_otlp_proto if wire else decode_json)(payloads, "metrics", config.malformed)))
    counts = processors.distinct_values(flatten.point_attrs(points), cap)
    return _each(counts, lambda df, batch: df.write.mode("overwrite").parquet(f"{target}/batch={batch}"), checkpoint, trigger or {"processingTime": config.trigger}, "update")
