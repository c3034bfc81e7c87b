"""The stages of the corpus pipeline.

Each takes (spark, docs, sf_dir).  All but the last return the columns of docs: filters return the rows that they keep,
unchanged; mixing repeats rows.  Columns beyond those of documents pass through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.llm import langid, minhash, mixing, packing, tokens
from telespark.llm import toxicity as tox
from telespark.llm.common import held_out, numbered, saved, unused
from telespark.llm.queries import labelled, mixable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts, texts without a letter, and posteriors under a half."""
    model = langid.fit(docs.where(~held_out("doc_id")))
    lang, score = unused(docs, "_lang", "_score")
    told = langid.predict(docs, model, lang=lang, score=score)
    return told.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= 0.5)).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity is a half or more."""
    features, weights = tox.fit(labelled(spark, sf_dir, docs, "toxic"), "label", corpus=docs)
    (out,) = unused(docs, "_toxicity")
    return tox.score(docs, features, weights, out=out).where(F.col(out) < 0.5).select(*docs.columns)


def _same(docs: DataFrame, *pairs: tuple[str, str]):
    """True where columns of ``docs`` equal those of the other side of a join, nulls too."""
    found = F.lit(True)
    for own, other in pairs:
        found = found & F.col(own).eqNullSafe(F.col(other))
    return found


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of the smallest doc_id, and of rows of one id the first by its text's hash.

    Documents without words are in no group and stay.
    """
    found = saved(minhash.near_duplicates(docs.select("doc_id", "text")), "found")
    grouped = found.where(F.col("n_shingles") > 0)
    kept = grouped.where("kept").groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = kept.groupBy("group").agg(F.min("text_hash").alias("first"))
    kept = saved(kept.join(first, "group"), "kept")
    own, number, id_, hash_, nth = unused(docs, "_text_hash", "_number", "_id", "_hash", "_nth")
    pair = F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)
    again = kept.where((F.col("n") > 1) & (F.col("text_hash") == F.col("first"))).select(*pair)
    gone = grouped.where(~F.col("kept")).select(*pair).unionByName(kept.where(F.col("text_hash") != F.col("first")).select(*pair)).distinct()
    hashed = docs.withColumns({own: F.xxhash64("text"), number: F.col("doc_id").cast("long")})
    same = F.col(number).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_))
    slim = gone.count() <= minhash.BROADCAST_ROWS
    left = hashed.join(F.broadcast(gone) if slim else gone, same, "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    repeated = left.join(again, same, "left")
    # each row of an id and text is as good as another; they are told apart without sending all of them to one task
    twice = repeated.where(F.col(hash_).isNotNull()).withColumn(id_, F.coalesce(F.col(number).cast("string"), F.lit("")))
    once = numbered(twice, [hash_, id_], [], [*docs.columns, hash_, id_], nth).where(F.col(nth) == 1)
    return repeated.where(F.col(hash_).isNull()).select(*docs.columns).unionByName(once.select(*docs.columns))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix of its source takes it, none included; parts of texts round to whole ones.

    The mix is worked out on ids, hashes of texts, sources and sizes; what it takes is then joined to the documents, of
    which each row is sent once, whatever the numbers of labels and sources.
    """
    size, tie, id_, hash_, source, key, nth, copies = unused(docs, "_size", "_tie", "_id", "_hash", "_of", "_key", "_nth", "_copies")
    mixed = mixing.mix(mixable(spark, sf_dir, docs.select("doc_id", "source", "text")))
    found = mixed.groupBy(F.col("doc_id").alias(id_), F.col("tie").alias(hash_), F.col("source").alias(source))
    taken = saved(found.agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.sum("copies").alias("total"), F.count(F.lit(1)).alias("n")).where("most > 0"), "copies")
    hashed = docs.withColumn(tie, F.xxhash64("text"))
    same = _same(docs, ("doc_id", id_), (tie, hash_), ("source", source))
    alike = taken.where("least = most").select(id_, hash_, source, F.col("most").alias(copies)).hint("shuffle_hash")
    out = hashed.join(alike, same)
    uneven = taken.where("least < most").select(id_, hash_, source, F.col("total").alias(copies), F.col("n").alias(size))
    if not uneven.isEmpty():  # equal rows among which a budget ends: of each source one group at most
        rows = hashed.join(uneven.hint("shuffle_hash"), same).withColumn(key, F.to_json(F.struct(id_, hash_, source)))
        placed = numbered(rows, [key], [], [*docs.columns, key, copies, size], nth)
        share = F.floor(F.col(copies) / F.col(size)) + (F.col(nth) <= F.col(copies) % F.col(size)).cast("int")
        some = placed.withColumn(copies, share.cast("int")).where(F.col(copies) > 0)
        out = out.select(*docs.columns, copies).unionByName(some.select(*docs.columns, copies))
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.digest(packing.pack(docs, tokenizer=tokens.default_tokenizer(), added_tokens=True))
