"""Where results go: sample tables, rotated JSON files, topics, the console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark.operators.tail import kept_spans


def as_samples(df: DataFrame, metric: str, value: str, ts: Column, *labels: str) -> DataFrame:
    """Rows of the samples table from a result's label columns and one value."""
    pairs = [x for c in labels for x in (F.lit(c), F.col(c).cast("string"))]
    named = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return df.select(F.lit(metric).alias("metric"), named.alias("labels"), ts.alias("ts"), F.col(value).cast("double").alias("value"))


def write_samples(samples: DataFrame, target: str, max_batch: int = 500_000) -> None:
    """Appends samples to a Parquet table partitioned by metric and day, ``max_batch`` rows a file at most."""
    dated = samples.withColumn("day", F.to_date("ts"))
    dated.write.mode("append").option("maxRecordsPerFile", max_batch).partitionBy("metric", "day").parquet(target)


def write_jsonl(df: DataFrame, path: str, max_rows: int = 100_000, ts: str | None = None) -> None:
    """Appends JSON lines, a new file after ``max_rows`` rows, and a folder for each day of ``ts`` if that is given."""
    dated = df.withColumn("day", F.to_date(ts)) if ts else df
    out = dated.write.mode("append").option("maxRecordsPerFile", max_rows)
    (out.partitionBy("day") if ts else out).json(path)


def stream_jsonl(stream: DataFrame, path: str, checkpoint: str, max_rows: int = 100_000, ts: str | None = None, trigger: dict | None = None):
    """The same for a stream: each row is written once, and each micro-batch begins files of its own."""
    dated = stream.withColumn("day", F.to_date(ts)) if ts else stream
    out = dated.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", max_rows).trigger(**(trigger or {"processingTime": "10 seconds"}))
    return (out.partitionBy("day") if ts else out).start()


def emit_kept(spans: DataFrame, decisions: DataFrame, path: str, *window: str) -> None:
    """Writes the spans of kept traces; with ``window``, those of the windows in which a trace is kept."""
    write_jsonl(kept_spans(spans, decisions, *window), path)


def debug_sink(stream: DataFrame, rows: int = 20):
    """A console query of a stream."""
    return stream.writeStream.format("console").option("numRows", rows).option("truncate", "false")
