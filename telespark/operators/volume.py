"""Volumes: totals by signal, running totals, and sample times that strictly rise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def volume(batches: DataFrame) -> DataFrame:
    """batches, records and bytes by signal, and how many batches were malformed; those count with no records."""
    return batches.groupBy("signal").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum(F.when(F.col("malformed"), 0).otherwise(F.col("n_records"))).alias("records"),
        F.sum("n_bytes").alias("bytes"),
        F.count_if("malformed").alias("malformed"),
    )


def efficiency(batches: DataFrame) -> DataFrame:
    """Average records of a batch and bytes of a record, by signal."""
    v = volume(batches)
    return v.select("signal", (F.col("records") / F.col("batches")).alias("records_per_batch"), (F.col("bytes") / F.nullif("records", F.lit(0))).alias("bytes_per_record"))


def _bucketed(batches: DataFrame, by: tuple[str, ...], width: int) -> tuple[DataFrame, list[str], WindowSpec, WindowSpec]:
    """Rows with their bucket of ``ord``, the keys of a bucket, the window inside it, and that over the buckets before.

    A group's rows are summed up bucket by bucket, so that no task holds all rows of a group; the table of buckets is small.
    """
    keys = [*by, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return batches.withColumn("_bucket", F.floor(F.col("ord") / width)), keys, inside, earlier


def _joined(rows: DataFrame, buckets: DataFrame, keys: list[str]) -> DataFrame:
    named = buckets.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in buckets.columns if c not in keys))
    return rows.join(named, [rows[k].eqNullSafe(named[f"_k_{k}"]) for k in keys]).drop(*(f"_k_{k}" for k in keys))


def running_totals(batches: DataFrame, *by: str, width: int = 1 << 16) -> DataFrame:
    """Adds total, the sum of n_records so far in order of ord (a number), for each group of ``by``.

    Sums run inside buckets of ``width`` values of ord and over the buckets' sums.
    """
    rows, keys, inside, earlier = _bucketed(batches, by, width)
    sums = rows.groupBy(*keys).agg(F.sum("n_records").alias("_sum"))
    before = sums.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return _joined(rows.withColumn("_inside", F.sum("n_records").over(inside)), before, keys).withColumn("total", F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside")


def monotonic(batches: DataFrame, *by: str, width: int = 1 << 16) -> DataFrame:
    """Adds sample_ms: now_ms, or one more than the sample before where that is not later.  Order is ord (a number).

    The n-th sample is n more than the greatest now_ms - k of the first n; that runs by buckets of ``width`` values of ord.
    """
    rows, keys, inside, earlier = _bucketed(batches, by, width)
    placed = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).withColumn("_d", F.col("now_ms") - F.col("_rn"))
    sums = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_most"))
    counted = sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    before = counted.select(*keys, "_before", F.max(F.col("_most") - F.col("_before")).over(earlier).alias("_ahead"))
    most = F.greatest(F.col("_ahead"), F.col("_so_far") - F.col("_before"))
    out = _joined(placed.withColumn("_so_far", F.max("_d").over(inside)), before, keys).withColumn("sample_ms", F.col("_before") + F.col("_rn") + most)
    return out.drop("_bucket", "_rn", "_d", "_before", "_ahead", "_so_far")


def alive(batches: DataFrame) -> DataFrame:
    """A heartbeat sample of 1 for each signal that sends, at its last arrival."""
    return batches.groupBy("signal").agg(F.max("arrival_ts").alias("ts")).select(F.lit("job_alive").alias("metric"), "signal", "ts", F.lit(1.0).alias("value"))
