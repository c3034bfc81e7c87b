"""Raw payloads from a message broker, one topic for each signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.config import JobConfig


def read_kafka(spark: SparkSession, signal: str, config: JobConfig = JobConfig(), *, streaming: bool = True) -> DataFrame:
    """value, batch_id (partition and offset) and arrival_ts of a signal's topic, from the configured offsets.

    Needs Spark's Kafka connector on the class path.  Every query that reads it has a checkpoint of its own and so sees the
    whole stream.  The decoders take any rows with these three columns.
    """
    reader = spark.readStream if streaming else spark.read
    options = {"kafka.bootstrap.servers": config.bootstrap, "subscribe": config.topics[signal], "startingOffsets": config.starting_offsets}
    rows = reader.format("kafka").options(**options).load()
    return rows.select("value", (F.shiftleft(F.col("partition").cast("long"), 44) + F.col("offset")).alias("batch_id"), F.col("timestamp").alias("arrival_ts"))
