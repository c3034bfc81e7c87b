"""Envelopes in JSON, one to a line, from files; batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.schema import ENVELOPES


def decode_json(payloads: DataFrame, signal: str, malformed: str = "count") -> DataFrame:
    """envelope, n_bytes, malformed and signal from rows with value (text or bytes), batch_id and arrival_ts.

    Null payloads are left out.  A payload that is no JSON object, or whose fields have other types than the protocol's, is
    kept with a null envelope (``count``), left out (``skip``) or fails the job (``fail``).
    """
    strict = malformed == "fail"
    schema = ENVELOPES[signal] if strict else f"{ENVELOPES[signal]}, _corrupt STRING"
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = payloads.where(F.col("value").isNotNull()).withColumn("_parsed", F.from_json(F.col("value").cast("string"), schema, options))
    bad = F.col("_parsed").isNull() if strict else F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull()
    envelope = F.when(~bad, F.col("_parsed") if strict else F.col("_parsed").dropFields("_corrupt"))
    out = rows.select(F.lit(signal).alias("signal"), "batch_id", "arrival_ts", F.octet_length("value").cast("long").alias("n_bytes"), bad.alias("malformed"), envelope.alias("envelope"))
    return out.where(~F.col("malformed")) if malformed == "skip" else out


def read_otlp_json(spark: SparkSession, path: str, signal: str, *, streaming: bool = False, malformed: str = "count") -> DataFrame:
    """Envelopes of the lines of text files.  batch_id is the hash of a line's file and text, arrival_ts the file's time."""
    lines = (spark.readStream if streaming else spark.read).format("text").load(path)
    rows = lines.select("value", F.xxhash64(F.col("_metadata.file_path"), "value").alias("batch_id"), F.col("_metadata.file_modification_time").alias("arrival_ts"))
    return decode_json(rows, signal, malformed)
