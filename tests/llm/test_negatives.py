"""Hard negatives by the threshold algorithm, against plain searches of all rows."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from telespark.llm import negatives, queries
from tests.conftest import SF
from tests.oracle import assert_same


def brute(rows, positives=5, most=5, low=80, high=100):
    """rows: (id, label, vector of integers).  The result as sorted tuples."""
    anchors = {}
    for i, label, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if i % 100 == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own == label) for i, own, w in rows if i != a)
        for s, i, _ in [x for x in scored if x[2]][:positives]:
            hard = [(t, j) for t, j, same in scored if not same and low * -s <= 100 * -t <= high * -s][:most]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(hard)]
    return sorted(out)


def as_rows(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id long, label long, vector array<long>")
    least = df.where("id % 100 = 0").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select("id", "a.label", "a.vector")
    return as_rows(negatives.mine(df, least, **kw))


@pytest.mark.parametrize("seed", range(4))
def test_mining_equals_a_search_of_all_rows(spark, seed):
    rng = np.random.default_rng(seed)
    spread = [3, 60, 300, 2][seed]  # few values give many ties
    rows = [(k, int(rng.integers(0, 3)), rng.integers(-spread, spread, 6).tolist()) for k in range(420)]
    rows += [rows[5]] * 30 + [(100, 7, [1] * 6), (7, 2, rows[7][2]), (300, 1, [0] * 6), (500, 99, [1] * 6)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, block_rows=37, chunk=2, positives=2, negatives=3) == brute(rows, 2, 3)


def test_scores_beyond_doubles_are_exact(spark):
    big = 1 << 29
    rows = [(k, k % 2, [big + k, big - k, -big + 3 * k]) for k in range(130)]
    assert mined(spark, rows) == brute(rows) != []


def test_lists_stop_when_the_threshold_falls_below_the_last_score():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (5000, 8))
    x[:40] = rng.integers(90, 100, (40, 8))  # far above all others
    lists = negatives.Lists(np.arange(5000), np.arange(5000) % 2, x)
    met = 0
    walk = lists.walk
    def counted(anchor):
        nonlocal met
        for new, threshold in walk(anchor):
            met += len(new)
            yield new, threshold
    lists.walk = counted
    scores, ids = negatives.nearest(lists, 0, 0, x[0], 5)
    plain = sorted((-int(x[k] @ x[0]), k) for k in range(2, 5000, 2))[:5]
    assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == plain and met < 600
    met = 0
    hard = negatives.within(lists, 0, 0, x[0], [int(s) for s in scores], 80, 100, 5)
    for g, (s, i) in zip(scores.tolist(), hard):
        want = sorted((-int(x[k] @ x[0]), k) for k in range(1, 5000, 2) if 80 * g <= 100 * int(x[k] @ x[0]) <= 100 * g)[:5]
        assert [(-a, b) for a, b in zip(s.tolist(), i.tolist())] == want
    assert met < 600


@pytest.mark.parametrize("anchor", [[0, 0, 0], [5, 0, -7], [-1, -1, -1]])
def test_walk_meets_every_row_once_and_its_threshold_holds(anchor):
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (700, 3))
    lists, a = negatives.Lists(np.arange(700), np.zeros(700), x), np.array(anchor)
    left = set(range(700))
    for new, threshold in lists.walk(a):
        assert left >= set(new.tolist())
        left -= set(new.tolist())
        assert all(int(x[k] @ a) <= threshold for k in left)
    assert not left


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=4).astype(np.float32).tolist(), int(rng.integers(0, 10))) for k in range(260)]
    odd = [(None, [1.0] * 4, 1), (300, None, 1), (301, [float("nan")] + [1.0] * 3, 1), (302, [float("inf")] * 4, 1), (303, [1.0, None, 1.0, 1.0], 1), (304, [1.0] * 4, None), (400, [1.0] * 3, 1), (305, [0.0] * 4, 1), (200, [0.0] * 4, 0), rows[9], rows[9], (306, [], 1)]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows + odd], "vec_id long, embedding array<float>, label int, id string, score double")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    ok = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, label in [*rows, (305, [0.0] * 4, 1), (200, [0.0] * 4, 0), rows[9], rows[9]]]
    assert as_rows(queries.op11_hard_negatives(spark, str(tmp_path))) == brute(ok)
    assert_same(queries.op11_hard_negatives(spark, str(tmp_path)), str(tmp_path), queries.ORACLE_SQL["op11_hard_negatives"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'"))


def test_equals_its_sql_and_takes_an_empty_table(spark, tmp_path):
    assert_same(queries.op11_hard_negatives(spark, SF), SF, queries.ORACLE_SQL["op11_hard_negatives"])
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.op11_hard_negatives(spark, str(tmp_path)).count() == 0


def test_a_label_of_a_third_of_all_rows(spark):
    rows = [(k, 0 if k % 3 == 0 else k % 5 + 1, [k % 11, k % 7 - 3]) for k in range(900)]
    found = mined(spark, rows, block_rows=100)
    assert found == brute(rows)
    per = defaultdict(int)
    for r in found:
        per[r[0], r[1]] += 1
    assert max(per.values()) <= 5
