"""Nearest neighbours, BM25 and quotations."""

from __future__ import annotations

import random
import shutil
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telespark.llm import ann, bm25, chat, queries
from tests.conftest import SF
from tests.llm.data import corpus, frame
from tests.oracle import assert_same


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def asked(spark, tmp_path, rows):
    vectors(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    return queries.op2_multi_index(spark, str(tmp_path)).collect()


def brute(rows, top=20):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in {i: x for i, x in reversed(ok) if i % 20 == 0}.items():
        out[q] = sorted(((-float((x * y).sum()), i) for i, y in ok if i != q))[:top]
    return out


def test_small_tables_are_searched_whole(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist(), 0) for k in range(300)]
    rows += [(300 + k, rows[40][1], 0) for k in range(60)]  # ties with a query, more than are returned
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [1.0] * 7 + [float("nan")], 0), (403, [1.0] * 7 + [None], 0), (404, [float("inf")] * 8, 0), (405, [1.0] * 3, 0), (407, rows[1][1], 0), (407, rows[1][1], 0)]
    want = brute([(i, v) for i, v, _ in rows])
    got = asked(spark, tmp_path, rows)
    assert {r["query_id"] for r in got} == set(want)
    for q, best in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(r, i) for r, i, _ in mine] == [(k + 1, i) for k, (_, i) in enumerate(best)]
        assert np.allclose([s for *_, s in mine], [-s for s, _ in best], rtol=1e-12, atol=1e-12)


def test_doubles_are_scored_as_given_and_queries_come_in_chunks(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist(), 0) for k in range(400)] + [(None, [1.0] * 8, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = brute([(i, v) for i, v, _ in rows if i is not None])
    for r in queries.op2_multi_index(spark, str(tmp_path)).collect():
        s, i = want[r["query_id"]][r["rank"] - 1]
        assert i == r["vec_id"] and abs(r["score"] + s) < 1e-12
    df = spark.createDataFrame([(i, v) for i, v, _ in rows if i is not None], "id long, vector array<double>")
    few = ann.search(df, df.where("id % 20 = 0"), chunk=3).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in few} == {(q, k + 1, i) for q, best in want.items() for k, (_, i) in enumerate(best)}


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 0)], [(1, None, 0)], [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0)]])
def test_few_vectors(spark, tmp_path, rows):
    assert len(asked(spark, tmp_path, rows)) == (1 if len(rows) == 2 else 0)


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    got = ann.search(rows, rows.where("id % 20 = 0"), least=0).groupBy("query_id").agg(F.collect_set("vec_id").alias("s")).collect()
    ids, x = zip(*[(r["id"], r["vector"]) for r in rows.collect()])
    x, at = np.array(x, dtype=np.float64), {i: k for k, i in enumerate(ids)}
    hits = 0
    assert len(got) == rows.where("id % 20 = 0").count() and all(len(r["s"]) == 20 for r in got)
    for r in got:
        score = x @ x[at[r["query_id"]]]
        score[at[r["query_id"]]] = -np.inf
        hits += len({ids[k] for k in np.argsort(-score)[:20]} & set(r["s"]))
    assert hits / (20 * len(got)) >= 0.9


def test_walk_takes_cells_by_rising_distance():
    m = ann.MultiIndex((np.eye(3), np.eye(3)), np.zeros(0), np.zeros((0, 6)), np.full((3, 3), 2), np.zeros(3), np.ones(3))
    near, far = np.array([0.0, 1.0, 5.0]), np.array([0.5, 0.0, 9.0])
    assert m.walk(near, far, 8).tolist() == [2, 2, 0] and m.walk(near, far, 1).tolist() == [1, 0, 0] and m.walk(near, far, 99).tolist() == [3, 3, 3]


def test_bm25_equals_its_sql(spark):
    assert_same(queries.op10_bm25(spark, SF), SF, queries.ORACLE_SQL["op10_bm25"])


def test_bm25_odd_rows_and_small_shards(spark, tmp_path):
    rows = [*corpus(), (8, "ONE Σίσυφος ΣΊΣΥΦΟΣ İki one", "el", "s", 0, None, None, None), (7, "one", "en", "s", 0, None, None, None)]
    docs = frame(spark, rows)
    asked_for = spark.createDataFrame([(1, "one two one"), (2, None), (3, ""), (4, "absent"), (None, "one"), (5, "émigré don't"), (6, "σίσυφος"), (6, "iki"), (6, None)], "query_id long, text string")
    many = bm25.search(docs, asked_for, shard_words=9, block=2, slice_words=3).orderBy("query_id", "rank").collect()
    assert many == bm25.search(docs, asked_for).orderBy("query_id", "rank").collect()
    assert {r["doc_id"] for r in many if r["query_id"] == 1} == {7, 8, 9}
    assert {r["query_id"] for r in many} == {1, 5, 6}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    asked_for.selectExpr("query_id as item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name in ("documents", "benchmark"):
        (tmp_path / f"{name}.parquet").rename(tmp_path / name)
        spark.read.parquet(str(tmp_path / name)).toPandas().to_parquet(tmp_path / f"{name}.parquet")
        shutil.rmtree(tmp_path / name)
    assert_same(queries.op10_bm25(spark, str(tmp_path)), str(tmp_path), queries.ORACLE_SQL["op10_bm25"])
    assert bm25.search(frame(spark, []), asked_for).count() == 0
    assert bm25.search(docs, asked_for.limit(0)).count() == 0


def test_an_index_serves_other_queries_and_parameters(spark):
    held = bm25.index(frame(spark))
    for text, k1 in (("one two", 1.2), ("naïve words of no id", 2.0)):
        asked_for = spark.createDataFrame([(1, text)], "query_id long, text string")
        assert bm25.find(held, asked_for, k1=k1).collect() == bm25.search(frame(spark), asked_for, k1=k1).collect() != []


def shard_of(texts: list[str], block: int) -> tuple[bm25.Shard, dict[str, tuple]]:
    builder = bm25.Builder()
    for k, text in enumerate(texts):
        builder.add(3 * k, text)
    rows = builder.rows(0, block).to_pylist()
    read = lambda x: np.frombuffer(x, dtype="<i4")
    mean = rows[-1]["n_words"] / rows[-1]["n_rows"]
    shard = bm25.Shard(np.frombuffer(rows[-1]["docs"], dtype="<i8"), read(rows[-1]["counts"]), mean, block)
    return shard, {r["term"]: (read(r["docs"]), read(r["counts"]), read(r["most"]), read(r["least"])) for r in rows[:-1]}


def test_pruned_search_equals_a_full_scan():
    rng = random.Random(5)
    names = [chr(97 + k) for k in range(20)]
    texts = [" ".join(rng.choices(names, weights=[1 / (k + 1) for k in range(20)], k=rng.randrange(0, 60))) for _ in range(700)]
    shard, lists = shard_of(texts, 4)
    for asked_for in ("a", "b f h", " ".join(names), "l l t", "zz"):
        given = [bm25.Postings(*lists[t], n, 1.5 / (1 + names.index(t))) for t, n in Counter(asked_for.split()).items() if t in lists]
        score = Counter()
        for p in given:
            for d, g in zip(p.docs.tolist(), shard.gain(p.idf, p.counts, shard.lengths[p.docs]).tolist()):
                score[3 * d] += int(p.times * g)
        want = sorted(((s, d) for d, s in score.items()), key=lambda x: (-x[0], x[1]))[:10]
        assert shard.top(given, 10)[0] == want


def test_pruning_scores_few_postings():
    """Documents that hold a rare word come first, so most postings of the frequent ones are never scored."""
    rng = random.Random(6)
    texts = [" ".join(["the"] * rng.randrange(1, 4) + ["of"] * rng.randrange(0, 3) + ["x"] * rng.randrange(9)) for _ in range(20_000)]
    for k in range(100, 20_000, 70):
        texts[k] += " rare"
    shard, lists = shard_of(texts, 64)
    weights = {"the": 0.01, "of": 0.3, "rare": 6.0}
    best, scored = shard.top([bm25.Postings(*lists[t], 1, w) for t, w in weights.items()], 10)
    every = sum(len(lists[t][0]) for t in weights)
    assert {d // 3 for _, d in best} <= set(range(100, 20_000, 70))
    assert 0 < scored < every / 4, (scored, every)


MESSAGES = [
    (1, 0, "user", "How do I start?\nSecond line."),
    (1, 1, "assistant", "> How do I start?\nPress the button. Then wait for the lamp\nto turn green. Call me."),
    (1, 2, "user", ">> how do i   START\n> Press the button!\n\nThanks."),
    (1, 3, "user", "> never said\nHm."),
    (1, 4, "user", None),
    (1, 5, "user", "On Monday, helper wrote:\n> Press the button. Then wait\n> for the lamp to turn\n> green.\nIt stays red."),
    (1, 6, "other", "helper wrote:\n> > How do I start? Second\n> > line.\n> Call me.\nI write:\nno quote here"),
    (1, 7, "user", "Last."),
    (2, 0, "user", "> How do I start?\nOther talk."),
    (None, 0, "user", "no conversation"),
    (None, 1, "user", "> no conversation\nyes"),
    (3, None, None, ""),
    (4, 1, "user", "delta"), (4, 1, "user", "alpha"), (4, 1, "user", None), (4, 1, "user", "charlie"), (4, 1, "user", "bravo"), (4, 1, "user", "bravo"),
]
CHATS = "conv_id long, turn long, role string, text string"


def test_quotes_are_linked(spark):
    df = spark.createDataFrame(MESSAGES + [MESSAGES[0]], CHATS).withColumns({"position": F.lit("clash"), "branch": F.lit(1)})
    got = {(r["conv_id"], r["position"]): r for r in chat.linked(df).collect()}
    assert len(got) == len(MESSAGES) + 1
    first, _, reply, nested, lost, nothing, wrapped, deep, last = (got[1, k] for k in range(1, 10))
    assert first["answers"] is None and reply["answers"] == 1 and reply["text"].startswith("Press the button.") and reply["n_linked"] == 1
    assert (nested["depth"], nested["n_quoted"], nested["n_linked"], nested["answers"], nested["text"]) == (2, 2, 2, 3, "Thanks.")
    assert (lost["n_quoted"], lost["n_linked"], lost["answers"]) == (1, 0, 4) and nothing["text"] == ""
    assert (wrapped["n_quoted"], wrapped["n_linked"], wrapped["answers"], wrapped["text"]) == (1, 1, 3, "It stays red."), "wrapped anew, in part, with its author"
    assert (deep["depth"], deep["n_quoted"], deep["n_linked"], deep["answers"], deep["text"]) == (2, 2, 2, 3, "I write:\nno quote here")
    assert last["answers"] == 8
    assert got[2, 1]["n_linked"] == 0 and got[None, 1]["text"] == "no conversation" and got[None, 2]["answers"] == 1
    assert [got[4, k]["text"] for k in range(1, 7)] == ["alpha", "bravo", "bravo", "charlie", "delta", ""], "ties go by text, nulls last"


def test_conversations_follow_replies(spark):
    df = spark.createDataFrame(MESSAGES, CHATS)
    shown = {(r["conv_id"], r["branch"], r["block"]): r for r in chat.rendered(chat.branched(chat.linked(df))).collect()}
    assert {k[1:] for k in shown if k[0] == 1} == {(1, 0), (6, 0), (7, 0)}
    assert shown[1, 1, 0]["n_messages"] == 5 and shown[1, 1, 0]["answers"] is None
    assert shown[1, 6, 0]["chat"] == "<|user|>\nIt stays red.\n<|end|>" and shown[1, 6, 0]["answers"] == 2
    assert shown[1, 7, 0]["chat"].endswith("no quote here\n<|end|>\n<|user|>\nLast.\n<|end|>")
    assert all("\n>" not in r["chat"] and "wrote" not in r["chat"] for r in shown.values())
    blocks = chat.rendered(chat.branched(chat.linked(df)), block=2).where("conv_id = 4").collect()
    assert sorted((r["block"], r["n_messages"], r["answers"]) for r in blocks) == [(0, 2, None), (1, 2, 2), (2, 2, 4)]


def test_chat_equals_its_sql_and_takes_empty_tables(spark, tmp_path):
    assert_same(queries.op5_chat(spark, SF), SF, queries.ORACLE_SQL["op5_chat"])
    rng = random.Random(4)
    said = ["Yes. It works.", "No way", "See the\nlong answer. It is here.", "Ok", "é à ü. Ñandú!"]
    rows = list(MESSAGES)
    for c in range(10, 40):
        texts = []
        for k in range(rng.randrange(1, 12)):
            quoted = "\n".join("> " * rng.randrange(1, 3) + x for x in rng.choice([*said, *texts]).split("\n"))
            texts.append("\n".join(rng.choices([rng.choice(said), quoted, "Ana wrote:", "", "x y"], k=rng.randrange(0, 5))))
            rows.append((c, k, rng.choice(["a", "b", None]), texts[-1]))
    pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(tmp_path / "conversations.parquet")
    assert_same(queries.op5_chat(spark, str(tmp_path)), str(tmp_path), queries.ORACLE_SQL["op5_chat"])
    empty = spark.createDataFrame([], CHATS)
    assert chat.rendered(chat.branched(chat.linked(empty))).count() == 0


def test_rows_are_dealt_into_files_once_whatever_the_number_of_chunks(spark):
    from pathlib import Path

    from telespark.llm.common import shared_dir

    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(700)], "id long, vector array<double>")
    shared = Path(shared_dir(spark).removeprefix("file://"))
    found = []
    for chunk in (2, 4096):
        before = set(shared.glob("cells-*"))
        found.append(sorted(map(tuple, ann.search(df, df.where("id % 20 = 0"), chunk=chunk, least=0).collect())))
        (made,) = set(shared.glob("cells-*")) - before
        assert spark.read.parquet(str(made)).count() == 700
    assert found[0] == found[1]
