"""Language identification, quality and toxicity."""

from __future__ import annotations

import itertools
import pickle
import random
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from telespark.llm import langid, linear, quality, queries, stages, toxicity
from tests.llm.data import corpus, frame

SF = "/root/testdata/sf0.01"


def accuracy(spark, df, label: str, rule) -> float:
    marks = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    return df.where("held_out").join(marks, "doc_id").agg(F.avg(rule.cast("double"))).first()[0]


def test_languages_of_held_out_texts(spark):
    got = queries.op9_langid(spark, SF).cache()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count() and got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert {(r["doc_id"], r["held_out"]) for r in got.collect()} == {(r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in docs.collect()}


def test_quality_of_held_out_texts(spark):
    assert accuracy(spark, queries.op3_quality(spark, SF), "quality", F.col("predicted") == F.col("quality")) > 0.95


def test_toxicity_never_accuses_most_clean_texts(spark):
    df = queries.op8_toxicity(spark, SF)
    assert accuracy(spark, df, "toxic", F.col("predicted") == F.col("toxic")) > 0.9


def test_odd_rows(spark):
    docs = frame(spark)
    model = langid.fit(docs)
    told = {(r["doc_id"], r["text"]): r for r in langid.predict(docs, model, lang="p", score="q").collect()}
    for text in ("", None, " \t\n", "1234 $$$ !!!"):
        assert [(r["p"], r["q"]) for k, r in told.items() if k[1] == text] == [("und", 0.0)]
    assert {r["p"] for r in told.values()} <= {"en", "fr", "und"} and all(0 <= r["q"] <= 1 for r in told.values())
    train = docs.withColumn("y", (F.col("doc_id") % 2).cast("int"))
    weights = quality.fit(train, "y")
    rows = quality.score(docs, weights, out="s").collect()
    assert len(rows) == len(corpus()) and all(0 <= r["s"] <= 1 for r in rows)
    assert len({r["s"] for r in rows if not r["text"]}) == 1
    features, w = toxicity.fit(train, "y")
    rows = toxicity.score(docs, features, w, out="s").collect()
    assert len(rows) == len(corpus()) and all(0 <= r["s"] <= 1 for r in rows)


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert langid.predict(docs, langid.fit(docs)).count() == 0
    assert not quality.fit(docs.withColumn("y", F.lit(1)), "y").any()
    features, w = toxicity.fit(docs.withColumn("y", F.lit(1)), "y")
    assert not w.any() and toxicity.score(docs, features, w).count() == 0
    some = frame(spark).limit(3)
    assert {r["lang_pred"] for r in langid.predict(some, langid.fit(docs)).collect()} == {"und"}


def test_back_off_goes_to_shorter_grams():
    matrix = np.log(np.array([[0.9, 0.1], [0.2, 0.8], [0.5, 0.5]]))
    m = langid.LanguageModel(["de", "en"], np.log([0.5, 0.5]), matrix, {"known": 0}, {3: {"<ab": 1}, 1: {"z": 2}})
    assert np.allclose(m.vector("abx"), matrix[1]) and np.allclose(m.vector("z"), matrix[2]) and m.vector("qqq") is None
    assert m.posterior("known")[0] > 0.8 and m.posterior("abx")[1] > 0.7 and np.allclose(m.posterior("qqq"), 0.5)


def test_language_model_keeps_every_word_and_n_gram_of_its_sample(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(4000))
    docs = spark.createDataFrame([(1, text, "xx"), (2, "kurz", "yy")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert sorted(model.grams) == [1, 2, 3, 4, 5] and model.matrix.dtype == np.float32
    words = {*text.split(), "kurz"}
    assert set(model.words) == words
    assert all(set(model.grams[k]) == {g for w in words for g in langid.grams_of(w, k)} for k in range(1, 6)) and len(model.grams[5]) > 20_000


def test_training_separates_and_repeats():
    rng = np.random.default_rng(1)
    rows = [(int(y), np.array([1 + int(y), 3 + int(rng.integers(50)), 0]), np.ones(3)) for y in rng.integers(0, 2, 300)]
    p = linear.Ftrl(bits=8, shards=1)
    w = linear.train_shard(rows, p)
    assert w[2] > 1 > -1 > w[1] and np.array_equal(w, linear.train_shard(rows, p))


CHARS = toxicity.CharModel({"idiot": 5, "stupid": 5, "moron": 5, "loser": 5, "people": 9, "book": 9, "pathetic": 5, "trash": 4})


def test_decoding():
    for written, word in [("1d10t", "idiot"), ("id1ot", "idiot"), ("i.d.i.o.t", "idiot"), ("iiidiooot", "idiot"), ("$tupid", "stupid"), ("m0r0n", "moron"), ("tr@sh", "trash"), ("path3tic", "pathetic"), ("boook", "book")]:
        assert toxicity.decode(written, CHARS) == word, written


def test_restored_words():
    got = toxicity.restored("You m-0-r-0-n, i d i o t! l o 5 e r end", CHARS)
    assert {"you", "moron", "end"} <= got and ("idiot" in got or any("idiot" in w for w in got))
    assert "idiot" in toxicity.restored("x1d10t 1d10t!", CHARS)
    assert toxicity.restored("", CHARS) == set() and toxicity.restored("plain words", CHARS) == {"plain", "words"}


OBFUSCATED = toxicity.CharModel({"idiot": 5, "stupid": 5, "shit": 5, "ass": 5, "asshole": 5, "the": 40, "you": 20, "people": 9, "are": 20, "see": 9, "evil": 5})


def test_every_obfuscated_piece_is_decoded():
    for written, word in [
        ("$tup1d", "stupid"), ("$h1t", "shit"), ("!d!ot", "idiot"), ("!d!ot.", "idiot"), ("stuupid", "stupid"), ("a55", "ass"),
        ("5h17", "shit"), ("idi0+", "idiot"), ("@$$hole", "asshole"), ("s" + "t" * 60 + "upid", "stupid"), ("i" + "-" * 50 + "d.i.o.t", "idiot"),
    ]:
        assert word in toxicity.forms(written, OBFUSCATED), written
    assert toxicity.forms("plain.", OBFUSCATED) == {"plain"}


def test_letters_set_apart_are_cut_at_words():
    told = ["you", "are", "stupid"] * 9 + ["idiot", "see", "evil"]
    letters = [c for w in told for c in w]
    assert toxicity.decode_words("".join(letters), OBFUSCATED) == told
    assert set(told) <= toxicity.set_apart(letters, OBFUSCATED)
    assert toxicity.decode_words("5tup1dpeople", OBFUSCATED) == ["stupid", "people"]


def test_runs_of_letters_are_settled_one_by_one():
    rng = random.Random(5)
    model = toxicity.CharModel({"".join(rng.choices("abc", k=rng.randint(2, 7))): rng.randint(1, 9) for _ in range(60)})
    for _ in range(2000):
        w = "".join(c * rng.choice([1, 1, 2, 2, 3, 5]) for c in rng.choices("abcd", k=rng.randint(1, 7)))
        assert toxicity.decode(w, model) == "".join(toxicity._search(toxicity.readings(w), model)), w


def test_search_is_linear():
    took = []
    for n in (2_000, 40_000):
        start = time.perf_counter()
        assert len(toxicity.decode("1d10t." * n, CHARS)) >= 3 * n
        took.append(time.perf_counter() - start)
    assert took[1] < 80 * took[0]


def test_trigrams_of_words():
    for words in ({"ab": 2, "abab": 3, "é": 1, "😀b": 4}, {chr(0x4E00 + k) + "x" + chr(0x4E00 + k % 7): k for k in range(1, 400)}, {}):
        want = Counter()
        for w, n in words.items():
            for k in range(len(w) + 1):
                want[f"^^{w}$"[k : k + 3]] += n
        assert toxicity.trigrams(words) == want


def test_character_model_counts_every_text(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "_FOLD", 3)
    docs = frame(spark).selectExpr("doc_id", "text", "cast(null as int) as y")
    rare = frame(spark).selectExpr("doc_id + 100 as doc_id", "'zyzzyva, " + "quux" * 9 + " x' as text", "cast(null as int) as y").limit(2)
    both = docs.unionByName(rare)
    model = toxicity.fit(docs, "y", corpus=both)[0].model
    words = [w.rstrip(".,") for r in both.collect() for w in (r["text"] or "").lower().split()]
    want = toxicity.CharModel(Counter(w for w in words if len(w) > 1 and w.isalpha()))
    # every trigram met, every one of characters met, and characters never met
    signs = sorted({c for t in want.met for c in t} | set("☃#"))
    asked = [*want.met, *("".join(t) for t in itertools.islice(itertools.product(signs, repeat=3), 0, None, 7))]
    assert {t: model.cost(t[:2], t[2]) for t in asked} == {t: want.cost(t[:2], t[2]) for t in asked}
    few = toxicity.fit(docs, "y")[0].model
    assert all(t in want.met and few.cost(t[:2], t[2]) != want.cost(t[:2], t[2]) for t in ("zyz", "uxq"))


def test_stored_model_in_many_files(spark, monkeypatch):
    """Files, kept files and kept costs as small as can be: costs are those of the model in memory, also after it was sent."""
    for name, n in (("_PAGE", 20), ("_PAGES", 2), ("_COSTS", 3)):
        monkeypatch.setattr(toxicity, name, n)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdé字😀", k=rng.randint(2, 6))) for _ in range(30)) for _ in range(20)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    model = pickle.loads(pickle.dumps(toxicity.fit_chars(docs)))
    want = toxicity.CharModel(Counter(w for t in texts for w in t.split() if w.isalpha()))
    assert len(model.files) > 5
    for t in itertools.product("^abcdé字😀$z", repeat=3):
        assert model.cost("".join(t[:2]), t[2]) == want.cost("".join(t[:2]), t[2])
    assert len(model.pages) <= 2 and len(model.costs) <= 3
    assert toxicity.decode("a1d.5aa", model) == toxicity.decode("a1d.5aa", want)
    assert toxicity.fit_chars(docs.limit(0)).cost("^^", "a") == toxicity.CharModel({}).cost("^^", "a") == 0


def test_stages_keep_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("mine"))
    kept = stages.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.count() and kept.first()["score"] == "mine"
    left = stages.toxicity(spark, docs, SF)
    marks = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0")
    assert left.columns == docs.columns
    assert docs.join(marks, "doc_id", "left_semi").join(left, "doc_id", "left_anti").count() <= 3
