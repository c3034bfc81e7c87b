from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from telespark.llm import mixing, queries, stages
from tests.llm.data import corpus, frame

SF = "/root/testdata/sf0.01"


def plain_targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in order}
        over = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 50}, {"a": 0, "b": 7}, {"a": 1}, {"a": 0}, {f"s{k:02}": (k * 37) % 101 for k in range(20)}, {"a": 1, "b": 1, "c": 100, "d": 2, "e": 3}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, (5, 2, 1), 3.0).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def prepared(docs):
    return docs.withColumns({"size": mixing.words("text"), "tie": F.xxhash64("text"), "quality": F.lit(None).cast("double")})


def test_odd_rows(spark):
    docs = prepared(frame(spark))
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus())
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["size"] == len((r["text"] or "").encode().split())
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert target == pytest.approx(plain_targets(size))
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_empty_table(spark):
    assert mixing.mix(prepared(frame(spark, []))).count() == 0


def test_better_documents_come_more_often(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("g"), F.lit(10).cast("long").alias("size"), F.lit(0).cast("long").alias("tie"))
    df = df.withColumns({"source": F.when(F.col("doc_id") < 3000, "b").otherwise("a"), "quality": F.when(F.col("g") == "1", 2.0).otherwise(0.5)})
    part = mixing.mix(df).where("source = 'b'")
    got = {r["g"]: r["t"] for r in part.groupBy("g").agg(F.sum("taken").alias("t")).collect()}
    assert got["1"] > 1.8 * got["0"]


def test_registered_query(spark):
    rows = queries.op1_mix(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stage_repeats_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = stages.mixing_sources(spark, docs, SF)
    assert out.columns == docs.columns and out.join(docs, docs.columns, "left_anti").count() == 0
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
