"""Credentials and requests: who is active, and why a request is turned away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(registry: DataFrame, as_of: Column) -> DataFrame:
    """Credentials neither revoked nor expired, newest first."""
    return registry.where((F.col("revoked") == 0) & (F.col("expires_at") > as_of)).orderBy(F.desc("created_at"), "id")


def generator_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """A generator's own log lines: those that start with a year, without its transport library's chatter."""
    c = F.col(column)
    noise = F.lit(False)
    for x in ("grpc_log", "channelz/", "grpclog/"):
        noise = noise | c.contains(x)
    return lines.where(c.rlike("^[0-9]{4}-") & ~noise)


def early_verdict(*, skew_s: int = 300, nonce: tuple[int, int] = (16, 128)) -> Column:
    """Why a request (ts, key_id, sig_ts in seconds as text, nonce, sig) is turned away before its nonce is taken, or null."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    stamp = F.expr("try_cast(sig_ts AS BIGINT)")
    return (
        F.when(~(given("key_id") & given("sig_ts") & given("nonce") & given("sig")), "missing_header")
        .when(stamp.isNull(), "bad_timestamp")
        .when(F.abs(F.unix_timestamp("ts") - stamp) > skew_s, "skew")
        .when(~F.length("nonce").between(*nonce), "bad_nonce")
    )


def judged(checked: DataFrame, keys: DataFrame, early: str = "early", replay: str = "replay", most_keys: int = 1_000_000) -> DataFrame:
    """Adds tenant_id and verdict to requests with their early verdict and whether they are replays, which two go.

    Keys (key_id, tenant_id, revoked) are broadcast if there are no more than ``most_keys`` that aren't revoked.
    """
    known = keys.where(F.col("revoked") == 0).groupBy(F.col("key_id").alias("_key")).agg(F.min("tenant_id").alias("tenant_id"))
    side = F.broadcast(known) if known.count() <= most_keys else known
    out = checked.join(side, F.col("key_id") == F.col("_key"), "left")
    verdict = F.coalesce(early, F.when(F.col(replay), "replay"), F.when(F.col("_key").isNull(), "invalid_key"), F.lit("accepted"))
    return out.withColumn("verdict", verdict).drop(early, replay, "_key")


def audit(requests: DataFrame, keys: DataFrame, *, skew_s: int = 300, nonce: tuple[int, int] = (16, 128), ttl_s: int = 600) -> DataFrame:
    """Adds verdict to requests (ts, key_id, sig_ts in seconds as text, nonce, sig, ord): the first that applies of
    missing_header, bad_timestamp, skew, bad_nonce, replay, invalid_key, else accepted.

    A nonce is taken before the key is looked at, by requests that reach that check; a replay within ``ttl_s`` of the
    taking is rejected and does not extend it.  A window's first request is the one that takes its nonce; one without a time
    takes none and is no replay.
    """
    from telespark.operators.anchored import anchored

    rows = requests.withColumn("_early", early_verdict(skew_s=skew_s, nonce=nonce))
    valid = rows.where(F.col("_early").isNull())
    # of the requests of one instant only the first can take the nonce, so windows are found on a row for each instant
    instants = valid.groupBy("nonce", "ts").agg(F.min("ord").alias("_first"))
    windows = anchored(instants, "nonce", "ts", ttl_s * 1_000_000)
    takers = windows.where(F.col("ts") == F.col("window_start")).select(F.col("nonce").alias("_n"), F.col("ts").alias("_t"), "_first")
    fresh = valid.join(takers, (F.col("nonce") == F.col("_n")) & (F.col("ts") == F.col("_t")), "left")
    fresh = fresh.withColumn("_replay", F.coalesce(F.col("ord") != F.col("_first"), F.col("ts").isNotNull())).drop("_n", "_t", "_first")
    checked = fresh.unionByName(rows.where(F.col("_early").isNotNull()).withColumn("_replay", F.lit(False)))
    return judged(checked, keys, "_early", "_replay")


def target_rate(config: DataFrame) -> DataFrame:
    """Adds target: 0 where disabled, -1 (no throttle) for a rate of 0 or less, else rate times workers, one at least."""
    target = F.when(~F.col("enabled"), F.lit(0.0)).when(F.col("rate") <= 0, F.lit(-1.0)).otherwise(F.col("rate") * F.greatest("workers", F.lit(1)))
    return config.withColumn("target", target.cast("double"))
