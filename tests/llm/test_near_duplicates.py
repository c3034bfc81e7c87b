from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from telespark.llm import minhash, stages
from telespark.llm.components import components
from tests.llm.data import corpus, frame, words


def brute(rows: list[tuple], percent: int = 75) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of each row, by comparing all sets."""

    def shingled(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingled(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None) if sets[i] else r[0]))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()), key=str)


def test_odd_rows(spark):
    assert found(frame(spark)) == brute(corpus())


def test_chains_and_large_groups(spark, monkeypatch):
    """Copies with more and more changed words: links near the threshold, and components that hang on few links."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(4)
    rows = []
    for g in range(4):
        base = words(80, g)
        for k in range(60):
            w = list(base)
            for _ in range(rng.randrange(8)):
                w[rng.randrange(80)] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), *[None] * 6))
    got = found(frame(spark, rows))
    assert got == brute(rows)
    assert 4 < len({c for _, _, c in got}) < 200


def test_near_copies_without_ids_and_long_texts_in_small_blocks(spark, monkeypatch):
    """Blocks are bounded by the sizes of sets; near copies that have no id, and rows that repeat, keep their links."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2_000)
    rng = random.Random(9)
    rows = []
    for g, n in enumerate([60, 60, 3_000]):
        base = words(n, 50 + g)
        for k in range(24):
            w = list(base)
            for _ in range(rng.randrange(n // 16)):
                w[rng.randrange(n)] = f"new{rng.randrange(10**6)}"
            rows.append((None if g == 1 or k % 5 == 0 else len(rows), " ".join(w), *[None] * 6))
    rows += [rows[30], rows[30], rows[0]]
    assert found(frame(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert found(frame(spark, [])) == []


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 400), st.integers(0, 400), st.integers(0, 400))
def test_sketches_estimate_similarity(common, left, right):
    rng = np.random.default_rng(common * 1000 + left)
    pool = rng.integers(0, 2**63, common + left + right).astype(np.uint64)
    a, b = np.unique(pool[: common + left]), np.unique(np.concatenate([pool[:common], pool[common + left :]]))
    x, y = minhash.sketch(a), minhash.sketch(b)
    j = common / (common + left + right)
    assert len(x) == minhash.SIZE and abs((x == y).mean() - j) < 5 * (j * (1 - j) / minhash.SIZE) ** 0.5 + 1e-9


def test_components_of_a_path_and_a_ring(spark):
    links = [(k, k + 1) for k in range(40)] + [(100 + k, 100 + (k + 1) % 7) for k in range(7)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 107), 100)}


def test_stage_keeps_one_of_each_group(spark):
    docs = frame(spark)
    kept = stages.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    rows = corpus()
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    base = rows[0][1]
    assert got.count((0, base)) == 1 and (1, base.upper()) not in got and (None, base) not in got
    assert {(4, ""), (5, None), (6, " \t\n"), (8, "one two three four"), (7, "one"), (None, "solo words of no id at all")} <= set(got)
    assert (9, "ONE two three four") not in got
    assert len([g for g in got if g[0] == 3]) == 2


def plain_sketch(members: np.ndarray) -> list[int]:
    """A sketch as its definition has it, one shingle and round at a time."""
    best = [None] * minhash.SIZE
    for i in range(2 * minhash.SIZE):
        for x in members:
            h = int(minhash._mix(np.array([x], dtype=np.uint64) ^ minhash._SEEDS[i])[0])
            at = h % minhash.SIZE if i < minhash.SIZE else i - minhash.SIZE
            value = (i << 56) | (h >> 8)
            best[at] = value if best[at] is None else min(best[at], value)
        if None not in best:
            break
    return (minhash._mix(np.array(best, dtype=np.uint64)) >> np.uint64(32)).tolist()


@pytest.mark.parametrize("n", [1, 2, 5, 127, 300])
def test_sketches_equal_their_definition_and_fill_every_coordinate(n):
    members = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    assert minhash.sketch(members).tolist() == plain_sketch(members)


def test_roots_are_joined_to_nodes_and_not_to_members_of_buckets(spark):
    """A thousand near copies in all 32 bands are 32,000 members; pairs of one component are dropped as they are made."""
    at = [(k, k) for k in range(32)]
    buckets = spark.createDataFrame([(n, 10, at) for n in range(1000)] + [(2000, 10, at[:1])], "node long, n_shingles long, at array<struct<key:long,band:int>>")
    roots = spark.createDataFrame([(n, 0) for n in range(1000)], "node long, root long")
    assert minhash._members(buckets, roots).count() == 32_001
    pairs = minhash._against_pivots(buckets, roots, 1)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and plan.count("Generate") == 2, "roots meet nodes below the explosion, once for each side"
    for line in plan.splitlines():
        if "Join Inner" in line:
            assert "NOT (root" in line, "pairs of one component are no rows"
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    assert all(b == 2000 for _, b in found) and len(found) in (1, 1000), "the pivot of the one mixed bucket against its rest"
