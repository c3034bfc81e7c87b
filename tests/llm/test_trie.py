"""The prefix trie of conversations, against a plain trie."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from telespark.llm import queries, trie
from telespark.llm.common import numbered
from tests.conftest import SF
from tests.oracle import assert_same

CONVERSATIONS = "conv_id long, turn long, role string, text string, pos string, n long"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = [*turns.get(base, [])[:h], *turns[c][h:]]
    members = defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = own_saved + sum(saved[k] for k in kids[p])
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "clash", 5) for r in rows], CONVERSATIONS).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    return sorted(map(tuple, queries.op12_prefix_trie(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_a_plain_one(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 130), 60):
        for t in range(rng.choice([1, 2, 3, 5, 8, 9, 17, 33][: 4 + 2 * seed])):
            rows.append((c, rng.choice([None, t, t, 1]), rng.choice(["user", "bot", None]), rng.choice(["a b", "a b", "c  d e", "", None])))
    rng.shuffle(rows)
    assert built(spark, tmp_path, rows) == brute(rows)


def test_odd_conversations(spark, tmp_path):
    rows = [(None, 1, "user", "gone")]
    rows += [(c, t, "user", "hot " * 3) for c in range(100, 160) for t in range(4)]  # copies of one conversation
    rows += [(7, None, None, None), (7, None, None, None), (7, 0, "user", " \t"), (7, 0, "user", "x" * 50_000)]
    rows += [(20, t, "u", f"turn {t}") for t in range(130)]  # long, and the head of others
    rows += [(c, 0, "u", "short") for c in range(21, 40)]  # some lose all turns of their own
    rows += [(241, 5, "u", "no base")]
    assert built(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x")], [(3, 1, "u", "x")], [(c, 0, "u", "x") for c in range(1, 20)], [(c, 1, "u", "one two") for c in range(20, 40)]])
def test_small_tables(spark, tmp_path, rows):
    assert built(spark, tmp_path, rows) == brute(rows)


def test_equals_its_sql(spark):
    assert_same(queries.op12_prefix_trie(spark, SF), SF, queries.ORACLE_SQL["op12_prefix_trie"])


def test_ends_are_hashed_in_numeric_order_across_pieces(spark):
    ids = [5, 4096, 12, 100_000, -3, 8191, 70_000]
    whole = spark.createDataFrame([(i, 1, 2) for i in ids] + [(9, 3, 4)], "conv_id long, x1 long, x2 long")
    got = {(r["x1"], r["x2"]): r["ends_sha256"] for r in trie._ends(whole).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (3, 4): hashlib.sha256(b"9").hexdigest()}


def test_places_of_a_key_that_is_spread_over_tasks(spark):
    df = spark.range(3000).select((F.col("id") % 3 > 0).cast("int").alias("k"), F.pmod(F.col("id") * 7919, F.lit(3001)).alias("v"), F.lit("x").alias("_place"))
    got = numbered(df, ["k"], ["v"], ["k", "v", "_place"], "at")
    assert got.columns == ["k", "v", "_place", "at"] and got.select("_place").distinct().first()[0] == "x"
    for k in (0, 1):
        rows = sorted((r["at"], r["v"]) for r in got.where(f"k = {k}").collect())
        assert [a for a, _ in rows] == list(range(1, len(rows) + 1)) and [v for _, v in rows] == sorted(v for _, v in rows)
