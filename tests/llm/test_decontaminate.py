"""Benchmark passages in documents, against a plain search of all positions."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from telespark.llm import decontaminate, queries
from tests.conftest import SF
from tests.oracle import assert_same

DOCS = "doc_id long, text string, row long, position int, tid string, item_id string"


def split(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words


def brute(docs, bench, length=10):
    windows = set()
    for i, text in bench:
        w = split(text)
        n = min(length, len(w))
        windows |= {(tuple(w[s : s + n]), i) for s in range(len(w) - n + 1)} if w else set()
    by = {}
    for w, i in windows:
        by.setdefault(w, set()).add(i)
    sizes = {len(w) for w in by}
    out = []
    for d, text in docs:
        w = split(text)
        hit, ids = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (found := by.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    ids |= found
        listed = ",".join(sorted(str(i) for i in ids if i is not None))
        out.append((d, len(w), len(hit), len([i for i in ids if i is not None]), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found(spark, tmp_path, docs, bench):
    spark.createDataFrame([(d, t, 1, 2, "x", "y") for d, t in docs], DOCS).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t, "z", 3) for i, t in bench], "item_id long, text string, doc_id string, place int").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    return sorted(map(tuple, queries.op13_decontaminate(spark, str(tmp_path)).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 4))) for _ in range(12)]  # few words: many near misses

    def text(n):
        return " ".join(rng.choices(vocabulary, k=n))

    bench = [(k, text(rng.choice([1, 3, 9, 10, 11, 30]) if k % 4 else 25)) for k in range(14)]
    docs = [(k, text(rng.randrange(60))) for k in range(40)]
    for k in range(60):
        words = text(30).split()
        piece = rng.choice(bench)[1].split()
        a = rng.randrange(len(piece))
        piece = piece[a : a + rng.randrange(6, 26)]
        at = rng.randrange(len(words))
        docs.append((100 + k, rng.choice([" ", ", ", " -- ", "_"]).join([*words[:at], *piece, *words[at:]]).upper() if k % 3 else "...".join(piece)))
    return docs, bench


@pytest.mark.parametrize("seed", range(3))
def test_hits_equal_a_plain_search(spark, tmp_path, seed):
    docs, bench = corpus(seed)
    assert found(spark, tmp_path, docs, bench) == brute(docs, bench)


def test_odd_rows(spark, tmp_path):
    passage = " ".join(f"w{k}" for k in range(40))
    same = " ".join(["echo"] * 25)
    docs = [(0, None), (1, ""), (2, "... --- ..."), (3, passage), (3, passage), (None, passage), (4, f"x {passage.upper()} y " * 3), (5, same), (6, " ".join(["echo"] * 9)), (7, "solo"), (8, "Éa ÉA"), (9, " ".join(f"v{k}" for k in range(9000)) + " " + passage), (10, "w0 w1 w2 w3 w4 w5 w6 w7 w8 x w9 w10"), (11, "İ ſ K")]
    bench = [(1, passage), (1, passage), (2, passage), (None, same), (10, " ".join(f"w{k}" for k in range(5, 16))), (3, None), (4, ""), (5, "!!!"), (6, "SOLO"), (7, "Éa ÉA"), (8, "never seen anywhere by anyone at all in any text"), (9, "i s k")]
    assert found(spark, tmp_path, docs, bench) == brute(docs, bench)


@pytest.mark.parametrize("docs, bench", [([], [(1, "a b")]), ([(1, "a b")], []), ([], [])])
def test_empty_tables(spark, tmp_path, docs, bench):
    assert found(spark, tmp_path, docs, bench) == brute(docs, bench)


def test_equals_its_sql(spark):
    assert_same(queries.op13_decontaminate(spark, SF), SF, queries.ORACLE_SQL["op13_decontaminate"])


def test_all_joins_by_shuffles_give_the_same_hits(spark, monkeypatch, tmp_path):
    docs, bench = corpus(7)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = decontaminate.items(spark.createDataFrame(bench, "item_id long, text string"))
    idx = decontaminate.index(d, b.terms)
    few = sorted(map(tuple, decontaminate.phrases(idx.postings, b.slots).collect()))
    monkeypatch.setattr(decontaminate, "sided", lambda df, most_rows=0: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, decontaminate.phrases(idx.postings, b.slots).collect())) == few != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_main_path_has_no_python(spark):
    plan = queries.op13_decontaminate(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_proximity_matches_equal_a_plain_search(spark):
    bench = [(1, "alpha beta gamma"), (2, "solo"), (3, "alpha missing word")]
    docs = [(1, "alpha x x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "x " * 30 + "beta gamma"), (4, "solo z solo"), (5, "alpha alpha")]
    b = decontaminate.items(spark.createDataFrame(bench, "item_id long, text string"))
    idx = decontaminate.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), b.terms)
    ids = {r["item"]: r["item_id"] for r in b.members.collect()}
    rows = {r["row"]: r["doc_id"] for r in idx.documents.collect()}
    got = sorted((rows[r["row"]], ids[r["item"]], r["position"], r["gap"]) for r in decontaminate.near(idx.postings, b.slots, within=4).collect())
    # of the first item "beta" and "gamma" are rarer than "alpha", and "beta" comes first
    assert got == [(1, 1, 3, 2), (2, 1, 1, 1), (3, 1, 31, 1), (4, 2, 0, 0), (4, 2, 2, 0)]
