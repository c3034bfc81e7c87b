"""The given tables as telemetry: the flat tables that the operators run on, derived from ``events`` by fixed rules.

``SQL`` has the same rules in DuckDB's dialect, as named parts of a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.functions.logs import severity_label


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events; times without a zone are UTC, whatever the session's zone is."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    if dict(rows.dtypes)["ts"] == "timestamp_ntz":
        rows = rows.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")))
    return rows


def _id(n: int) -> Column:
    return F.col("event_id") % n


def _service() -> Column:
    return F.when(F.col("user_id") % 50 == 0, "unknown").otherwise(F.concat(F.lit("svc-"), (F.col("user_id") % 20).cast("string")))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(_id(21) == 0, F.lit(" ")).otherwise(F.concat(F.lit("E"), _id(3).cast("string")))
    value = F.struct(kind.alias("stringValue"), *(F.lit(None).cast(t).alias(c) for c, t in (("intValue", "string"), ("boolValue", "boolean"), ("doubleValue", "double"), ("bytesValue", "string"), ("arrayValue", "string"), ("kvlistValue", "string"))))
    event = F.struct(F.lit("exception").alias("name"), F.array(F.struct(F.lit("exception.type").alias("key"), value.alias("value"))).alias("attributes"))
    raised = F.when(_id(14) == 0, 2).when(_id(7) == 0, 1).otherwise(0)
    start = F.unix_micros("ts") * 1000
    took = F.round(F.col("value") * 1e7).cast("long")
    return events(spark, sf_dir).select(
        F.expr("event_id div 50").alias("batch_id"),
        F.md5(F.concat(F.lit("t"), F.expr("event_id div 5").cast("string")).cast("binary")).alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        _service().alias("service"),
        F.col("event_type").alias("name"),
        _id(6).cast("int").alias("kind"),
        F.when(F.col("event_type") == "error", 2).when(_id(3) == 0, 1).otherwise(0).alias("status"),
        start.alias("start_ns"),
        (start + took).alias("end_ns"),
        took.alias("duration_ns"),
        F.slice(F.array(event, event), F.lit(1), raised).alias("events"),
        F.col("ts").alias("arrival_ts"),
        (100 + _id(400)).alias("bytes_est"),
        F.col("event_id").alias("ord"),
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")

    def residue(prefix: str, n: int) -> Column:
        return F.concat(F.lit(prefix), (u % n).cast("string"))

    attrs = {
        "service.name": F.when(u % 50 != 0, residue("svc-", 20)),
        "team": F.when(u % 11 != 0, residue("team-", 7)),
        "vertical": residue("v", 4),
        "otlp.transport": F.when(u % 5 == 0, "http").when(u % 5 < 3, "grpc"),
        "telemetry.sdk.language": F.element_at(F.array(F.lit("java"), F.lit("go"), F.lit("python")), (u % 3 + 1).cast("int")),
        "telemetry.sdk.name": F.when(u % 2 == 0, "otel").otherwise(""),
        "telemetry.sdk.version": residue("1.", 5),
        "cloud.provider": F.when(u % 3 == 0, "aws").when(u % 3 == 1, "gcp"),
        "k8s.cluster.name": residue("c", 2),
        "k8s.namespace.name": residue("n", 6),
        "deployment.environment": F.when(u % 4 == 0, "prod\nline").when(u % 4 < 3, "dev"),
    }
    found = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in attrs.items())), lambda e: e["value"].isNotNull())
    grouped = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("props") + 32).alias("resource_bytes"))
    return grouped.select(
        F.element_at(F.array(F.lit("traces"), F.lit("logs"), F.lit("metrics")), (u % 3 + 1).cast("int")).alias("signal"),
        F.map_from_entries(found).alias("attrs"),
        F.when(u % 37 == 0, 0).otherwise(F.col("n")).cast("long").alias("n_records"),
        "resource_bytes",
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    storm = F.format_string("User %d did %s value %d from 10.0.0.%d", F.col("user_id"), F.col("event_type"), F.round(F.col("value") * 100).cast("long"), F.col("user_id") % 250)
    miss = F.concat(F.lit("cache miss key="), F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 12), F.lit(" 'shard "), _id(4).cast("string"), F.lit("'"))
    body = F.when(_id(10) == 0, miss).otherwise(storm)
    number = F.element_at(F.array(*map(F.lit, (0, 1, 8, 9, 17))), (_id(5) + 1).cast("int"))
    text = F.when(F.col("event_type") == "error", "ERROR").otherwise("")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("ord"),
        "ts",
        _service().alias("service"),
        number.alias("severity_number"),
        severity_label(text, number).alias("severity"),
        body.alias("body"),
        F.octet_length(body).cast("long").alias("body_bytes"),
    )


def point_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user_id"), F.col("user_id").cast("string"), F.lit("region"), _id(5).cast("string"))
    from telespark.operators.flatten import point_attrs as unnest

    return unnest(events(spark, sf_dir).select(F.col("event_type").alias("metric_name"), attrs.alias("attrs")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counters of events by type, which start again every seventh day."""
    from pyspark.sql import Window

    hourly = events(spark, sf_dir).groupBy("event_type", F.expr("unix_seconds(ts) div 3600").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type", F.expr("hour div 168")).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    counter = hourly.withColumn("v", F.sum("n").over(w))
    return counter.select(F.lit("events_total").alias("metric"), F.create_map(F.lit("type"), F.col("event_type")).alias("labels"), F.timestamp_seconds(F.col("hour") * 3600).alias("ts"), F.col("v").cast("double").alias("value"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = events(spark, sf_dir).groupBy(F.expr("event_id div 50").alias("batch_id")).agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.length("props")).alias("n_bytes"), F.max("ts").alias("arrival_ts"))
    b = F.col("batch_id")
    return grouped.select(
        F.element_at(F.array(F.lit("traces"), F.lit("logs"), F.lit("metrics")), (b % 3 + 1).cast("int")).alias("signal"),
        "batch_id",
        (b % 2).alias("subtask"),
        "n_records",
        "n_bytes",
        "arrival_ts",
        (b % 17 == 0).alias("malformed"),
        b.alias("ord"),
        F.expr("unix_millis(arrival_ts) div 36000000 * 36000000").alias("now_ms"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed requests: some without a header, with a bad or old time, a short or repeated nonce, or an unknown key."""
    e = events(spark, sf_dir)
    nonce = F.md5(F.concat(F.lit("n"), F.expr("event_id div 3").cast("string")).cast("binary"))
    stamp = (F.unix_seconds("ts") - F.when(_id(13) == 0, 301).otherwise(_id(300))).cast("string")
    return e.select(
        "ts",
        F.col("event_id").alias("ord"),
        F.when(_id(17) == 0, F.lit(None)).otherwise(F.concat(F.lit("key-"), (F.col("user_id") % 40).cast("string"))).alias("key_id"),
        F.when(_id(19) == 0, F.lit("soon")).otherwise(stamp).alias("sig_ts"),
        F.when(_id(23) == 0, F.substring(nonce, 1, 15)).otherwise(nonce).alias("nonce"),
        F.lit("s").alias("sig"),
    )


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the customers' first nations: every fifth is revoked."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    return n.select(F.concat(F.lit("key-"), k.cast("string")).alias("key_id"), F.col("n_name").alias("tenant_id"), F.when(k % 5 == 0, 1).otherwise(0).alias("revoked"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials: one for each customer, created on a day of 2024 by its key, valid for 30 to 129 days."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    created = F.timestamp_seconds(F.lit(1704067200) + (k % 366) * 86400)
    expires = F.timestamp_seconds(F.lit(1704067200) + (k % 366 + 30 + k % 100) * 86400)
    return c.select(k.cast("string").alias("id"), created.alias("created_at"), expires.alias("expires_at"), F.when(k % 9 == 0, 1).otherwise(0).alias("revoked"))


_SERVICE = "CASE WHEN user_id % 50 = 0 THEN 'unknown' ELSE 'svc-' || (user_id % 20) END"
SQL = {
    "spans": f"""spans AS (
    SELECT event_id // 50 AS batch_id, md5('t' || (event_id // 5)) AS trace_id, event_id::VARCHAR AS span_id, {_SERVICE} AS service, event_type AS name,
           event_id % 6 AS kind, CASE WHEN event_type = 'error' THEN 2 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS status,
           round(value * 1e7)::BIGINT AS duration_ns, epoch_us(ts) AS arrival_us, 100 + event_id % 400 AS bytes_est, event_id AS ord,
           CASE WHEN event_id % 14 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS n_exceptions,
           CASE WHEN event_id % 21 = 0 THEN 'unknown' ELSE 'E' || (event_id % 3) END AS exception_type
    FROM events)""",
    "resources": """resources AS (
    SELECT ['traces', 'logs', 'metrics'][user_id % 3 + 1] AS signal, CASE WHEN user_id % 37 = 0 THEN 0 ELSE count(*) END AS n_records,
           sum(length(props) + 32)::BIGINT AS resource_bytes,
           CASE WHEN user_id % 50 <> 0 THEN 'svc-' || (user_id % 20) ELSE 'unknown' END AS service_name,
           CASE WHEN user_id % 11 <> 0 THEN 'team-' || (user_id % 7) ELSE 'unknown' END AS team, 'v' || (user_id % 4) AS vertical,
           CASE WHEN user_id % 5 = 0 THEN 'http' WHEN user_id % 5 < 3 THEN 'grpc' ELSE 'unknown' END AS transport,
           ['java', 'go', 'python'][user_id % 3 + 1] AS sdk_language, CASE WHEN user_id % 2 = 0 THEN 'otel' ELSE 'unknown' END AS sdk_name,
           '1.' || (user_id % 5) AS sdk_version, CASE user_id % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'unknown' END AS cloud_provider,
           'c' || (user_id % 2) AS k8s_cluster, 'n' || (user_id % 6) AS k8s_namespace,
           CASE WHEN user_id % 4 = 0 THEN 'prod line' WHEN user_id % 4 < 3 THEN 'dev' ELSE 'unknown' END AS environment
    FROM events GROUP BY user_id, event_type)""",
    "logs": f"""raw_logs AS (
    SELECT event_id AS ord, ts, {_SERVICE} AS service, [0, 1, 8, 9, 17][event_id % 5 + 1] AS severity_number,
           CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_id % 5 > 0 THEN [0, 1, 8, 9, 17][event_id % 5 + 1]::VARCHAR ELSE 'unknown' END AS severity,
           CASE WHEN event_id % 10 = 0 THEN 'cache miss key=' || substr(md5(event_id::VARCHAR), 1, 12) || ' ''shard ' || (event_id % 4) || ''''
                ELSE 'User ' || user_id || ' did ' || event_type || ' value ' || round(value * 100)::BIGINT || ' from 10.0.0.' || (user_id % 250) END AS body
    FROM events),
templates AS (
    SELECT *, strlen(body) AS body_bytes,
           trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '"[^"]*"|''[^'']*''', '<STR>', 'g'),
               '\\b[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}(?::[0-9]+)?\\b', '<IP>', 'g'),
               '\\b(?:0x)?(?:{"|".join(f"[0-9]{{{k}}}[a-fA-F][0-9a-fA-F]{{{7 - k},}}" for k in range(7))}|[0-9]{{7,}}[a-fA-F][0-9a-fA-F]*)\\b', '<HEX>', 'g'),
               '[0-9]+', '<NUM>', 'g'), '\\s+', ' ', 'g')) AS template
    FROM raw_logs),
logs AS (
    SELECT *, printf('%X', list_reduce(list_prepend(0::BIGINT, [ord(c)::BIGINT FOR c IN string_split(template, '')]), lambda a, c: (a * 31 + c) & 4294967295)) AS upper_hash,
           lower(upper_hash) AS hash
    FROM templates)""",
    "attrs": """attrs AS (
    SELECT event_type AS metric_name, unnest(['k', 'user_id', 'region']) AS attr_key,
           unnest([json_extract_string(props, '$.k'), user_id::VARCHAR, (event_id % 5)::VARCHAR]) AS attr_value
    FROM events)""",
    "samples": """hourly AS (SELECT event_type, epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY ALL),
samples AS (
    SELECT event_type AS type, hour, (sum(n) OVER (PARTITION BY event_type, hour // 168 ORDER BY hour))::DOUBLE AS value FROM hourly),
stepped AS (
    SELECT *, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS delta FROM samples WINDOW w AS (PARTITION BY type ORDER BY hour))""",
    "batches": """batches AS (
    SELECT ['traces', 'logs', 'metrics'][event_id // 50 % 3 + 1] AS signal, event_id // 50 AS batch_id, event_id // 50 % 2 AS subtask, count(*) AS n_records,
           sum(length(props))::BIGINT AS n_bytes, event_id // 50 % 17 = 0 AS malformed, event_id // 50 AS ord, epoch_ms(max(ts)) // 36000000 * 36000000 AS now_ms
    FROM events GROUP BY event_id // 50)""",
}
