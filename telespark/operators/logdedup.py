"""Log templates: duplicates, savings, noisy templates and floods.

Inputs have service, severity, body, body_bytes, ts and a total order ``ord``.  The key of a template is its 32-bit hash, so
two templates of one hash are one.  Past ``cap`` templates, in the order in which they are first seen, a record only counts
as overflow.

Records are summed up by template before anything else, so that hashes are worked out for templates and not for records.
Where records are needed again, they are masked once and kept with a 64-bit key of their template, by which the at most
``cap`` admitted hashes are joined to them; no template's text is joined or broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telespark.functions.hashing import hash_hex
from telespark.functions.logs import fingerprint
from telespark.operators.anchored import anchored
from telespark.shared import kept_table

CAP = 20_000


def fingerprinted(logs: DataFrame) -> DataFrame:
    """Adds template; a null body is an empty one."""
    return logs.withColumn("template", fingerprint(F.coalesce("body", F.lit(""))))


def templated(logs: DataFrame) -> DataFrame:
    """Adds template and its hash to every record, of a stream too."""
    return fingerprinted(logs).withColumn("hash", hash_hex(F.col("template")))


def masked(logs: DataFrame, *columns: str) -> DataFrame:
    """Adds template and key, its 64-bit hash, to the ``columns`` (all, if none are named) of every record of a table, once
    for all that follows."""
    return kept_table(fingerprinted(logs).select(*(columns or logs.columns), "template", F.xxhash64("template").alias("key")), "masked")


def hashes(rows: DataFrame) -> DataFrame:
    """key, hash and first_ord of each template of ``masked`` rows."""
    # the hash is of an aggregate, so that no optimiser moves it to the records
    by_key = rows.groupBy("key").agg(F.max("template").alias("text"), F.min("ord").alias("first_ord"))
    return by_key.withColumn("hash", hash_hex(F.col("text"))).drop("text")


def hashed(logs: DataFrame, *columns: str) -> DataFrame:
    """Adds template and its hash to the ``columns`` (or all) of every record of a table; the hash is worked out for each
    template."""
    rows = masked(logs, *columns)
    return rows.join(hashes(rows).drop("first_ord"), "key").drop("key")


def per_template(logs: DataFrame) -> DataFrame:
    """One row for each hash: records, their bytes, the first ord, first body bytes, first 200 characters of the first
    template, and last service and severity.

    One shuffle of partial sums by template, and one of those sums by hash.
    """
    first = F.min(F.struct("ord", F.col("body_bytes").alias("bytes"))).alias("first")
    last = F.max(F.struct("ord", "service", "severity")).alias("last")
    by_text = fingerprinted(logs).groupBy("template").agg(F.max("template").alias("text"), F.count(F.lit(1)).alias("n"), F.sum("body_bytes").alias("b"), first, last)
    hashed = by_text.withColumn("hash", hash_hex(F.col("text")))
    sample = F.min(F.struct("first", F.substring("text", 1, 200).alias("text"))).alias("s")
    out = hashed.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), sample, F.max("last").alias("last"))
    return out.select(
        "hash", "n", "b", F.col("s.first.ord").alias("first_ord"), F.col("s.first.bytes").alias("first_bytes"), F.col("s.text").alias("sample"), F.col("last.service").alias("last_service"), F.col("last.severity").alias("last_severity")
    )


def _first(templates: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` hashes seen first, ties by hash: a sort that keeps ``cap`` rows a task."""
    return templates.orderBy("first_ord", "hash").limit(cap)


def admitted(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """key and hash of the templates of ``masked`` rows whose hash is one of the ``cap`` that are seen first: as many as
    ``cap``, but for those that share a hash with another."""
    found = hashes(rows)
    first = _first(found.groupBy("hash").agg(F.min("first_ord").alias("first_ord")), cap).select("hash")
    return found.join(F.broadcast(first), "hash", "left_semi").select("key", "hash")


def kept(logs: DataFrame, cap: int = CAP) -> DataFrame:
    """service, severity, ts, ord and hash of the records of admitted templates."""
    rows = masked(logs, "service", "severity", "ts", "ord")
    return rows.join(F.broadcast(admitted(rows, cap)), "key").drop("key", "template")


def summary(logs: DataFrame, cap: int = CAP) -> DataFrame:
    """records, unique_templates, dedup_ratio, bytes_saved, bytes_saved_avg and overflow, in one row.

    bytes_saved: all but the first body of each admitted template.  bytes_saved_avg: the documented form, occurrences
    less one times the average body size in whole bytes.
    """
    per = per_template(logs)
    every = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"))
    first = _first(per, cap).agg(
        F.count(F.lit(1)).alias("unique_templates"),
        F.coalesce(F.sum(F.col("b") - F.col("first_bytes")), F.lit(0)).alias("bytes_saved"),
        F.coalesce(F.sum((F.col("n") - 1) * F.floor(F.col("b") / F.col("n"))), F.lit(0)).alias("bytes_saved_avg"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("_kept"),
    )
    one = every.join(F.broadcast(first)).withColumn("overflow", F.col("records") - F.col("_kept")).drop("_kept")
    ratio = F.greatest(F.lit(0.0), 1 - F.col("unique_templates") / F.nullif("records", F.lit(0)))
    return one.withColumn("dedup_ratio", F.coalesce(ratio, F.lit(0.0)))


def occurrences(logs: DataFrame, least: int = 100, cap: int = CAP) -> DataFrame:
    """occurrences by service, severity and hash of templates from their ``least``-th record on.

    That record counts for all before it; each counts under its own labels.
    """
    return occurrences_of(kept(logs, cap), least)


def occurrences_of(rows: DataFrame, least: int = 100, before: DataFrame | None = None) -> DataFrame:
    """The same of records with their hash, after ``before`` (hash, n) records of each, a table of as many rows as
    templates are admitted."""
    labels = ["service", "severity", "hash"]
    past = rows.withColumn("_past", F.lit(0).cast("long")) if before is None else rows.join(F.broadcast(before.select("hash", F.col("n").alias("_past"))), "hash", "left").na.fill(0, ["_past"])
    # the first records of a hash are cut before the shuffle; all others need only be counted
    nth = Window.partitionBy("hash").orderBy("ord")
    head = past.select(*labels, "ord", "_past").withColumn("rn", F.row_number().over(nth)).where(F.col("rn") <= least).withColumn("rn", F.col("rn") + F.col("_past")).where(F.col("rn") <= least)
    early = head.groupBy(*labels).agg(F.count(F.lit(1)).alias("early"), F.count_if(F.col("rn") == least).alias("hits"))
    total = rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))
    joined = total.join(early, labels, "left").na.fill(0, ["early", "hits"])
    return joined.select(*labels, (F.col("n") - F.col("early") + F.col("hits") * least).alias("occurrences")).where(F.col("occurrences") > 0)


def template_stats(logs: DataFrame, cap: int = CAP) -> DataFrame:
    """Of each admitted template: sample (200 characters of the first), occurrences, avg_body_bytes, last service and severity."""
    average = F.floor(F.col("b") / F.col("n")).alias("avg_body_bytes")
    return _first(per_template(logs), cap).select("hash", "sample", F.col("n").alias("occurrences"), average, "last_service", "last_severity")


def noisiest(logs: DataFrame, k: int = 10, cap: int = CAP) -> DataFrame:
    return template_stats(logs, cap).orderBy(F.desc("occurrences"), "hash").limit(k)


def floods_tumbling(logs: DataFrame, window: str = "60 seconds", threshold: int = 1000) -> DataFrame:
    """Templates with ``threshold`` records or more in a fixed window."""
    by_text = fingerprinted(logs).groupBy(F.window("ts", window).alias("w"), "template").agg(F.max("template").alias("text"), F.count(F.lit(1)).alias("n"))
    by_hash = by_text.groupBy("w", hash_hex(F.col("text")).alias("hash")).agg(F.sum("n").alias("records"))
    return by_hash.where(F.col("records") >= threshold).select(F.col("w.start").alias("window_start"), "hash", "records")


def floods(logs: DataFrame, length_us: int = 60_000_000, threshold: int = 1000, cap: int = CAP) -> DataFrame:
    """flood_events by service: an event for each anchored window of an admitted template that has ``threshold`` records,
    under the service of the record that fills it.

    The windows are found on one row for each template and time, so that a flood's records, which share times, meet as
    counts; only those of the time at which a window fills up are looked at one by one.
    """
    return flood_events(kept(logs, cap), length_us, threshold)[0].groupBy("service").agg(F.count(F.lit(1)).alias("flood_events"))


def flood_events(rows: DataFrame, length_us: int = 60_000_000, threshold: int = 1000, opened: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The floods among records (hash, ts, ord, service), and the last window of each hash: hash, ts (its start) and n.

    ``opened`` holds the windows that records before these have left open, in the same form; records from before a window's
    start count as of its start.
    """
    rows = rows.select("hash", "ts", "ord", "service")
    counts = rows.groupBy("hash", "ts").agg(F.count(F.lit(1)).alias("n"))
    if opened is not None:
        held = F.broadcast(opened.select("hash", F.col("ts").alias("_start")))
        rows = rows.join(held, "hash", "left").withColumn("ts", F.greatest("ts", "_start")).drop("_start")
        counts = rows.groupBy("hash", "ts").agg(F.count(F.lit(1)).alias("n")).withColumn("past", F.lit(0).cast("long"))
        counts = counts.unionByName(opened.select("hash", "ts", "n", F.col("n").alias("past"))).groupBy("hash", "ts").agg(F.sum("n").alias("n"), F.sum("past").alias("past"))
    else:
        counts = counts.withColumn("past", F.lit(0).cast("long"))
    windows = anchored(counts, "hash", "ts", length_us)
    upto = F.sum("n").over(Window.partitionBy("hash", "window_start").orderBy("ts"))
    new = F.col("upto") - F.col("n") + F.col("past")
    filled = windows.withColumn("upto", upto).where((F.col("upto") >= threshold) & (new < threshold))
    filled = filled.select("hash", "ts", "window_start", (threshold - new).alias("at"))
    nth = F.row_number().over(Window.partitionBy("hash", "ts").orderBy("ord"))
    hit = rows.join(filled, ["hash", "ts"]).withColumn("nth", nth).where(F.col("nth") == F.col("at"))
    sums = windows.groupBy("hash", F.col("window_start").alias("ts")).agg(F.sum("n").alias("n"))
    last = sums.groupBy("hash").agg(F.max(F.struct("ts", "n")).alias("w")).select("hash", "w.ts", "w.n")
    return hit.select("hash", "window_start", "service", F.col("ts").alias("at")), last
