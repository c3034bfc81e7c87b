"""Queries over metric samples: metric, labels, ts and value.

A series is a metric with its labels; label columns are named by the caller, so that every step groups by plain columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labelled(samples: DataFrame, *labels: str) -> DataFrame:
    """The samples with some of their labels as columns."""
    return samples.select("metric", *(F.try_element_at("labels", F.lit(x)).alias(x) for x in labels), "ts", "value")


def matching(samples: DataFrame, metric: str, **patterns: str) -> DataFrame:
    """The samples of a metric whose labels match regular expressions as a whole; a missing label is an empty one."""
    found = samples.where(F.col("metric") == metric)
    for label, pattern in patterns.items():
        found = found.where(F.coalesce(F.try_element_at("labels", F.lit(label)), F.lit("")).rlike(f"^(?:{pattern})$"))
    return found


def against_target(measured: DataFrame, config: DataFrame, on: tuple[str, ...], value: str = "per_second") -> DataFrame:
    """target, measured and their ratio: what generators were set to send (``access.target_rate``) and what came of it.

    A generator of which nothing came measures 0.  Where there is no target (disabled, or no throttle) the ratio is null.
    """
    came = measured.select(*on, F.col(value).alias("measured"))
    out = config.select(*on, "target").join(came, list(on), "left").na.fill(0.0, ["measured"])
    return out.withColumn("ratio", F.when(F.col("target") > 0, F.col("measured") / F.col("target")))


def union_all(*streams: DataFrame) -> DataFrame:
    """Several streams of samples as one."""
    return reduce(lambda a, b: a.unionByName(b), streams)


def instant(series: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The latest value of each series."""
    return series.groupBy(*by).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def aggregate(values: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """sum, avg and count of values by labels."""
    return values.groupBy(*by).agg(F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.count("value").alias("count"))


def steps(series: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Adds delta, what a counter rose by since the sample before; after a reset it counts from 0.  Null for the first."""
    before = F.lag("value").over(Window.partitionBy(*by).orderBy("ts"))
    return series.withColumn("delta", F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def increase(series: DataFrame, by: tuple[str, ...], window: str) -> DataFrame:
    """window_start and increase of each series in each window of fixed length: the steps that end in it."""
    w = F.window("ts", window)
    return steps(series, by).where(F.col("delta").isNotNull()).groupBy(*by, w.alias("w")).agg(F.sum("delta").alias("increase")).select(*by, F.col("w.start").alias("window_start"), "increase")


def rate(series: DataFrame, by: tuple[str, ...], window: str, seconds: int, extrapolate: bool = False) -> DataFrame:
    """Increase for each second of the window.

    With ``extrapolate``, the increase between the window's first and last samples is stretched to the window's ends, by
    half of the mean gap at most where an end is further from its sample than 1.1 gaps.
    """
    if not extrapolate:
        return increase(series, by, window).select(*by, "window_start", (F.col("increase") / seconds).alias("rate"))
    w = F.window("ts", window)
    ranked = steps(series, by).withColumn("w", w)
    first = F.min("ts").over(Window.partitionBy(*by, "w"))
    inside = ranked.withColumn("d", F.when(F.col("ts") > first, F.col("delta")).otherwise(0.0)).groupBy(*by, "w").agg(
        F.sum("d").alias("inc"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")
    )
    secs = lambda x, y: (F.unix_micros(y) - F.unix_micros(x)) / 1e6
    span, head, tail = secs("a", "b"), secs(F.col("w.start"), F.col("a")), secs(F.col("b"), F.col("w.end"))
    gap = span / (F.col("n") - 1)
    reach = lambda x: F.when(x < gap * 1.1, x).otherwise(gap / 2)
    factor = (span + reach(head) + reach(tail)) / span
    return inside.where(F.col("n") > 1).select(*by, F.col("w.start").alias("window_start"), (F.col("inc") * factor / seconds).alias("rate"))


def delta_per_minute(series: DataFrame, by: tuple[str, ...], window: str, minutes: int) -> DataFrame:
    """A gauge's last value less its first in each window, for a minute; resets are not looked for."""
    w = F.window("ts", window)
    ends = series.groupBy(*by, w.alias("w")).agg((F.max_by("value", "ts") - F.min_by("value", "ts")).alias("d"))
    return ends.select(*by, F.col("w.start").alias("window_start"), (F.col("d") / minutes).alias("delta_per_minute"))


def deriv(series: DataFrame, by: tuple[str, ...], window: str) -> DataFrame:
    """The slope of the least-squares line through each window's samples, for a second; windows of one sample have none."""
    w = F.window("ts", window)
    x = (F.unix_micros("ts") - F.unix_micros(w["start"])) / 1e6
    return series.groupBy(*by, w.alias("w")).agg(F.regr_slope("value", x).alias("slope")).where(F.col("slope").isNotNull()).select(*by, F.col("w.start").alias("window_start"), "slope")


def topk(values: DataFrame, value: str, k: int, step: tuple[str, ...], ties: tuple[str, ...]) -> DataFrame:
    from telespark.operators.topn import top_k

    return top_k(values, value, k, step, ties)


def quantile(buckets: DataFrame, q: float, by: tuple[str, ...]) -> DataFrame:
    """The q-quantile from rows (by, le, cumulative_count), linear inside a bucket.

    Below the first bound it starts from 0; past the last finite bound it is that bound.  Null without observations.
    """
    bound = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    summed = buckets.withColumn("b", bound).groupBy(*by, "b").agg(F.sum("cumulative_count").alias("c"))
    lists = summed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("b", "c"))).alias("h"))
    rank = q * F.element_at("h", -1)["c"]
    at = F.size(F.filter("h", lambda x: x["c"] < rank))
    hit = F.try_element_at("h", at + 1)
    prior = F.when(at > 0, F.try_element_at("h", F.greatest(at, F.lit(1)))).otherwise(F.struct(F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("c")))
    inside = prior["b"] + (hit["b"] - prior["b"]) * (rank - prior["c"]) / (hit["c"] - prior["c"])
    value = F.when(F.element_at("h", -1)["c"] == 0, None).when(hit["b"] == float("inf"), prior["b"]).otherwise(inside)
    return lists.select(*by, value.alias("quantile"))


def ratio(left: DataFrame, right: DataFrame, on: tuple[str, ...], value: str = "value") -> DataFrame:
    """left / right for the label values that both have; null where right is 0."""
    r = right.select(*on, F.col(value).alias("_d"))
    return left.select(*on, F.col(value).alias("_n")).join(r, list(on)).select(*on, (F.col("_n") / F.nullif("_d", F.lit(0))).alias("ratio"))


def above(values: DataFrame, threshold: float, value: str = "value") -> DataFrame:
    return values.where(F.col(value) >= threshold)


def alert_runs(points: DataFrame, by: tuple[str, ...], firing: Column, step: int, least: int) -> DataFrame:
    """start, until and points of each run of at least ``least`` successive points at which ``firing`` is true.

    points have a whole number ``step_no`` for their place in time, ``step`` apart; a gap ends a run.
    """
    w = Window.partitionBy(*by).orderBy("step_no")
    rows = points.where(firing).withColumn("_g", F.col("step_no") - step * F.row_number().over(w))
    runs = rows.groupBy(*by, "_g").agg(F.min("step_no").alias("start"), F.max("step_no").alias("until"), F.count(F.lit(1)).alias("points"))
    return runs.where(F.col("points") >= least).drop("_g")


def absent(expected: DataFrame, present: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """The expected label values of which no series is there."""
    return expected.select(*on).distinct().join(present.select(*on), list(on), "left_anti")


def parity(sent: DataFrame, processed: DataFrame, on: tuple[str, ...], value: str = "value") -> DataFrame:
    """sent, processed and their difference; a side that is missing counts 0."""
    a, b = sent.select(*on, F.col(value).alias("sent")), processed.select(*on, F.col(value).alias("processed"))
    out = a.join(b, list(on), "full_outer").na.fill(0, ["sent", "processed"])
    return out.withColumn("difference", F.col("sent") - F.col("processed"))


def throughput(counters: DataFrame, by: tuple[str, ...], window_us: int = 5_000_000) -> DataFrame:
    """Adds per_second to scraped counters (t_us, value, failed): the rise since the last sample over ``window_us`` ago,
    or the oldest; 0 for a fall, and for a lone sample.  A failed scrape gives null and starts the history anew."""
    rows = counters.withColumn("_session", F.count_if(F.col("failed")).over(Window.partitionBy(*by).orderBy("t_us")))
    ok = rows.where(~F.col("failed"))
    w = Window.partitionBy(*by, "_session").orderBy("t_us")
    far = w.rangeBetween(Window.unboundedPreceding, -window_us - 1)
    point = F.struct("t_us", "value")
    base = F.coalesce(F.last(point).over(far), F.first(point).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dt = (F.col("t_us") - base["t_us"]) / 1e6
    speed = F.when(dt > 0, F.greatest(F.col("value") - base["value"], F.lit(0.0)) / dt).otherwise(F.lit(0.0))
    return ok.withColumn("per_second", speed).unionByName(rows.where("failed").withColumn("per_second", F.lit(None).cast("double"))).drop("_session")


def accepted_totals(samples: DataFrame) -> DataFrame:
    """Summed counters of what a receiver accepted, by signal, over all label sets."""
    kind = (
        F.when(F.col("metric").startswith("otelcol_receiver_accepted_log_records"), "logs")
        .when(F.col("metric").startswith("otelcol_receiver_accepted_metric_points"), "metrics")
        .when(F.col("metric").startswith("otelcol_receiver_accepted_spans"), "traces")
    )
    return samples.withColumn("signal", kind).where(F.col("signal").isNotNull()).groupBy("signal").agg(F.sum("value").alias("accepted"))


def share(values: DataFrame, by: tuple[str, ...], value: str = "value") -> DataFrame:
    """Each label value's part of the whole."""
    total = values.agg(F.sum(value).alias("_all"))
    return values.groupBy(*by).agg(F.sum(value).alias("value")).crossJoin(F.broadcast(total)).select(*by, "value", (F.col("value") / F.nullif("_all", F.lit(0))).alias("share"))
