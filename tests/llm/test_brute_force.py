"""The learned and sampled operators against plain versions of themselves, and the pipeline on odd rows."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from telespark.llm import langid, linear, mixing, quality, queries, stages, tokens, toxicity
from telespark.llm.common import hash_fraction, table
from tests.conftest import SF
from tests.llm.data import corpus, frame
from tests.llm.test_mixing import plain_targets
from tests.llm.test_near_duplicates import brute as near_brute


def test_mix_takes_whole_epochs_and_then_the_smallest_keys(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 5, 40, 300]), rng.choice([None, 0.5, 1.0, 2.0])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double").withColumn("tie", F.xxhash64("doc_id"))
    drawn = df.withColumn("u", hash_fraction("doc_id", "tie", seed=1)).collect()
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    by = defaultdict(list)
    for r in drawn:
        by[r["source"]].append((-math.log(r["u"]) / (r["quality"] or 1.0), r["doc_id"], r["size"]))
    assert len(got) == len(rows)
    for source, docs in by.items():
        whole = sum(n for *_, n in docs)
        target = got[docs[0][1]]["target"]
        epochs, left = int(target // whole), round(target - target // whole * whole)
        for _, i, n in sorted(docs):
            last = min(n, left)
            left -= last
            assert got[i]["taken"] == epochs * n + last, (source, i)


def plain_ftrl(rows, p):
    """The update rule, one feature at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for epoch in range(p.epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            y, idx, val = rows[k]
            w = {i: weight(i) for i in idx.tolist()}
            p_hat = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(idx.tolist(), val.tolist()))))
            for i, v in zip(idx.tolist(), val.tolist()):
                g = (p_hat - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_training_equals_a_plain_loop_and_scores_are_dot_products(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    train = queries.labelled(spark, SF, docs, "quality").collect()
    p = linear.Ftrl(bits=12, epochs=2, shards=1)
    rows = [(r["label"], *quality.features(r["text"], p.bits)) for r in train]
    want = plain_ftrl(rows, p)
    got = linear.train_shard(rows, p)
    assert len(rows) > 20 and np.allclose([got[i] for i in want], list(want.values()), atol=1e-9) and np.count_nonzero(got) == sum(w != 0 for w in want.values())
    for r in quality.score(docs, got).collect():
        idx, val = quality.features(r["text"], p.bits)
        assert abs(r["score"] - 1 / (1 + math.exp(-sum(got[i] * v for i, v in zip(idx.tolist(), val.tolist()))))) < 1e-9


def test_quality_features_equal_plain_counts():
    text = "The the cat sat, 12 TIMES! the the _x"
    tokens = ["The", "the", "cat", "sat", ",", "12", "TIMES", "!", "the", "the", "_", "x"]
    words, shapes = [quality._hash(t)[0] for t in tokens], [quality._hash(t)[1] for t in tokens]
    mixed = lambda salt, *h: int(quality._mixed(*(np.array([x], dtype=np.uint64) for x in h), salt=salt)[0])
    found = [mixed(1, w) for w in words] + [mixed(2, *x) for x in zip(words, words[1:])] + [mixed(3, s) for s in shapes]
    found += [mixed(4, *x) for x in zip(shapes, shapes[1:])] + [mixed(5, *x) for x in zip(shapes, shapes[1:], shapes[2:])]
    found += [mixed(6, s) for a, b, s in zip(words, words[1:], shapes[1:]) if a == b]
    counts = Counter(x & 0xFFFF for x in found)
    idx, val = quality.features(text, 16)
    size = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
    assert {i: v for i, v in zip(idx.tolist(), val.tolist()) if i} == pytest.approx({i: 4 * math.log1p(n) / size for i, n in counts.items()})


MODEL = toxicity.CharModel({"idiot": 5, "stupid": 5, "class": 9, "book": 9, "see": 7, "shell": 4, "is": 20, "it": 20})


def test_decoding_equals_an_exhaustive_search():
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(c * rng.choice([1, 1, 1, 2, 3]) for c in rng.choices("isto1$.-@5", k=rng.randint(1, 5)))
        lattice = toxicity.readings(word)

        def cost(path):
            state, total = "^^", sum(x for _, x in path)
            for c in "".join(p for p, _ in path) + "$":
                total += MODEL.cost(state, c)
                state = state[1] + c
            return total

        best = min(map(cost, itertools.product(*lattice)))
        told = toxicity.decode(word, MODEL)
        assert min(cost(p) for p in itertools.product(*lattice) if "".join(x for x, _ in p) == told) == pytest.approx(best), word


def test_toxicity_scores_equal_plain_sums(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    features, w = toxicity.fit(queries.labelled(spark, SF, docs, "toxic"), "label", corpus=docs)
    for r in toxicity.score(docs, features, w).collect():
        words = toxicity.restored(r["text"] or "", features.model)
        idx = {linear.BIAS, *features.of_words(words)}
        assert abs(r["score"] - linear.logistic(math.fsum(w[i] for i in idx))) < 1e-12


def plain_back_off(train):
    """The model's counts and a function from text to (language, posterior), one word at a time.  train: (text, lang)."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in train:
        for word in langid.words_of(text):
            for kind, gram in [(0, word), *((k, g) for k in range(1, 6) for g in langid.grams_of(word, k))]:
                counts[lang, kind][gram] += 1
                total[lang, kind] += 1
    langs = sorted({lang for lang, _ in counts})
    known = {kind: set().union(*(counts[lang, kind] for lang in langs)) for kind in range(6)}

    def logs(kind, gram):
        return np.array([math.log((counts[x, kind][gram] + 0.5) / (total[x, kind] + 1.0)) for x in langs])

    def of_word(word):
        if word in known[0]:
            return logs(0, word)
        for k in range(5, 0, -1):
            if hits := [logs(k, g) for g in langid.grams_of(word, k) if g in known[k]]:
                return sum(hits) / len(hits)
        return np.zeros(len(langs))

    prior = np.log([total[x, 0] / sum(total[y, 0] for y in langs) for x in langs])

    def told(text):
        s = prior + sum((n * of_word(w) for w, n in Counter(langid.words_of(text)).items()), np.zeros(len(langs)))
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        return langs[int(p.argmax())], p.max()

    return langs, known, told


def test_languages_equal_a_plain_back_off(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    langs, known, told = plain_back_off([(r["text"], r["lang"]) for r in docs.where("text is not null and lang is not null").collect()])
    assert langs == model.langs and known[0] == set(model.words) and all(known[k] == set(model.grams[k]) for k in range(1, 6))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for r in docs.collect():
        if langid.has_letter(r["text"]):
            lang, p = told(r["text"])
            assert got[r["doc_id"]]["lang_pred"] == lang and abs(got[r["doc_id"]]["score"] - p) < 1e-3


def test_pipeline_equals_plain_stages(spark):
    """The pipeline's rows against plain versions of all stages: back-off word by word, sums of weights, all pairs of sets,
    targets by repeated capping and keys in order, and the tokenizer itself."""
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    _, _, told = plain_back_off([(t, lang) for i, t, lang, _ in rows if not held(i) and t is not None and lang is not None])
    rows = [r for r in rows if langid.has_letter(r[1]) and told(r[1])[1] >= 0.5]

    left = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    features, weights = toxicity.fit(queries.labelled(spark, SF, left, "toxic"), "label", corpus=left)
    odds = {r[0]: math.fsum(float(weights[k]) for k in features.of(r[1])) for r in rows}
    rows = [r for r in rows if odds[r[0]] < 0]

    component = {i: c for i, _, c in near_brute([r[:2] for r in rows])}
    rows = [r for r in rows if component[r[0]] == r[0]]

    marks = defaultdict(int)
    for r in table(spark, SF, "labels").where("quality is not null").collect():
        marks[r["doc_id"]] = max(marks[r["doc_id"]], 2 if r["quality"] == 1 else 1)
    left = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tie", F.xxhash64("text"))
    drawn = {r["doc_id"]: r["u"] for r in left.withColumn("u", hash_fraction("doc_id", "tie", seed=1)).collect()}
    size = {i: len(t.encode().split()) for i, t, _, _ in rows}
    whole = Counter()
    for i, *_, source in rows:
        whole[source] += size[i]
    copies = {}
    for source, target in plain_targets(dict(whole)).items():
        order = sorted((-math.log(drawn[i]) / (1.0, 0.5, 2.0)[marks[i]], i) for i, *_, s in rows if s == source)
        epochs, rest = int(target // whole[source]), round(target - target // whole[source] * whole[source])
        for _, i in order:
            part = max(0, min(size[i], rest))
            rest -= part
            copies[i] = round((epochs * size[i] + part) / size[i])

    t = Tokenizer.from_file(tokens.default_tokenizer())
    ids = {r[0]: [*t.encode(r[1], add_special_tokens=False).ids, 1] for r in rows}
    starts, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        starts[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(starts) == {i for i, n in copies.items() if n}
    for i, pieces in starts.items():
        covered = Counter(k for at, n in pieces for k in range(at, at + n))
        assert covered == {k: copies[i] for k in range(len(ids[i]))}, i
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


def written(spark, path, rows, labels):
    frame(spark, rows).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "near_duplicates"], ids=lambda s: s[0])
def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path, stage):
    name, step = stage
    d = written(spark, tmp_path, corpus(), [(k, k % 2, k % 3 == 0) for k in range(0)] + [(0, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1)])
    docs = table(spark, d, "documents")
    out = step(spark, docs, d)
    rows = out.collect()
    if name != "packing":
        assert out.columns == docs.columns
        have = Counter(map(str, docs.collect()))
        assert set(map(str, rows)) <= set(have)
        if name != "mixing":
            assert not Counter(map(str, rows)) - have
        if name == "language_id":
            assert all(langid.has_letter(r["text"]) for r in rows)
            assert {r["doc_id"] for r in rows} >= {0, 1, 2, 7, 8, 9}
    assert step(spark, docs.limit(0), d).count() == 0


HELPERS = ["_lang", "_score", "_told", "_toxicity", "_text_hash", "_number", "_id", "_hash", "_nth", "_size", "_tie", "_of", "_key", "_copies", "_as_read", "_place", "_range", "_n", "_first", "_before", "tie", "copies", "quality", "size"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_leave_columns_with_names_of_helpers_alone(spark, tmp_path, stage):
    d = written(spark, tmp_path, corpus() + [corpus()[0]] * 5, [(0, 1, 0), (2, 0, 1)])
    docs = table(spark, d, "documents").withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in HELPERS})
    out = stage[1](spark, docs, d)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in HELPERS)


def test_mixing_stage_repeats_equal_rows_as_often_as_their_budget(spark, tmp_path):
    rows = [(1, "a b c d", "en", "s0", 7, None, None, None)] * 40 + [(2, "e f", "en", "s1", 3, None, None, None)] * 30 + [(3, "g h i", None, None, 5, None, None, None)] * 25
    d = written(spark, tmp_path, rows, [(1, 1, 0)])
    mixed = Counter()
    for r in mixing.mix(queries.mixable(spark, d, table(spark, d, "documents").select("doc_id", "source", "text"))).collect():
        mixed[r["doc_id"]] += r["copies"]
    out = Counter(r["doc_id"] for r in stages.mixing_sources(spark, table(spark, d, "documents"), d).collect())
    assert out == mixed and {k: v % n != 0 for (k, v), n in zip(sorted(out.items()), (40, 30, 25))} != {}


def test_run_takes_odd_rows_and_empty_tables(spark, tmp_path):
    d = written(spark, tmp_path / "a", corpus(), [(0, 1, 0), (7, 0, 0)])
    pieces = corpus_pipeline.run(spark, d).collect()
    ids = {r["doc_id"] for r in pieces}
    assert ids <= {r[0] for r in corpus() if langid.has_letter(r[1])} and 0 in ids and 1 not in ids, "a copy of document 0 goes"
    d = written(spark, tmp_path / "b", [], [])
    assert corpus_pipeline.run(spark, d).count() == 0


def test_run_equals_its_stages(spark):
    docs = table(spark, SF, "documents")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
    by_stage = stages.packed(spark, docs, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    by_run = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(map(tuple, by_stage)) == sorted(map(tuple, by_run)) and len(by_run) > 100
