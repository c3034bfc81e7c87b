"""Benchmark passages in training texts, by a positional inverted index.

The index holds a posting (term, row, position) for each word of the documents that is a term of the benchmark, sorted by
term inside its files, which are shards by document.  A window of an item is looked for from its rarest term: the postings
of that term give the alignments (row, position minus the term's place in the item) at which the window could stand, the
list of the second rarest one keeps those on which both agree, and the postings of the other words are met only there.
Everything is DataFrame work, and nothing is cut off: a window of frequent words only is searched in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm.common import saved, sided

#: A word is a maximal run of ASCII letters, digits and anything beyond ASCII.  (As a positive class, which Java's regular
#: expressions match many times faster than the same set as a negative one.)
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Follows the last word of each document: its posting tells how many words there are.
END = ""


def words(text: str) -> Column:
    """The words of a text as they are written; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def lowered(word: str) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


@dataclass
class Items:
    """The benchmark's distinct sequences of words, as tables.

    texts: item (a number), n_words.  members: item, item_id (one row for each id of a sequence, null ids too).
    terms: term, tid; tid 0 is ``END``.  slots: item, place (from 0), tid, n_words.
    """

    texts: DataFrame
    members: DataFrame
    terms: DataFrame
    slots: DataFrame


@dataclass
class Index:
    """postings: tid, row, position.  documents: row, doc_id, n_words, one row for each row of the documents."""

    postings: DataFrame
    documents: DataFrame


def items(benchmark: DataFrame) -> Items:
    """From rows (item_id, text).  Items without words have no part; rows of equal words are one sequence."""
    worded = benchmark.select("item_id", F.concat_ws(" ", F.transform(words("text"), lambda w: F.translate(w, _UPPER, _LOWER))).alias("key")).where("key <> ''")
    texts = saved(worded.select("key").distinct().withColumn("item", F.monotonically_increasing_id()), "texts")
    members = saved(worded.join(texts, "key").select("item", "item_id").distinct(), "members")
    placed = texts.select("item", F.posexplode(F.split("key", " ")).alias("place", "term"), F.size(F.split("key", " ")).alias("n_words"))
    # the end's tid is 0, others are from 1
    terms = placed.select("term").distinct().withColumn("tid", F.monotonically_increasing_id() + 1)
    end = benchmark.sparkSession.createDataFrame([(END, 0)], "term string, tid long")
    terms = saved(terms.unionByName(end), "terms")
    slots = saved(placed.join(terms, "term").select("item", "place", "tid", "n_words"), "slots")
    return Items(texts.select("item"), members, terms, slots)


def index(docs: DataFrame, terms: DataFrame, *, most_rows: int = 1_000_000) -> Index:
    """The postings of all rows of ``docs`` (doc_id, text) for the terms (term, tid); other words take up a position only.

    Terms are broadcast if there are no more than ``most_rows`` of them and joined by a shuffle else.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(words("text"), F.array(F.lit(END))).alias("words"))
    placed = numbered.select("row", "doc_id", F.posexplode("words").alias("position", "written"))
    met = placed.select("row", "doc_id", "position", lowered("written").alias("term")).join(sided(terms, most_rows), "term")
    kept = met.select("tid", "row", "position", F.when(F.col("tid") == 0, F.col("doc_id")).alias("doc_id"))
    all_ = saved(kept.sortWithinPartitions("tid", "row", "position"), "postings", compression="zstd")
    return Index(all_.where("tid > 0").select("tid", "row", "position"), all_.where("tid = 0").select("row", "doc_id", F.col("position").alias("n_words")))


def anchors(slots: DataFrame, postings: DataFrame, length: int) -> DataFrame:
    """For each item the places of its windows' two rarest terms: item, place1, tid1, place2, tid2, and the places from
    ``start`` to before ``stop`` that windows with these two cover.

    A window is ``length`` words that follow each other, or an item of fewer words.  Ties go to the earlier place; a window
    of one word has it twice.
    """
    counts = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    known = slots.join(sided(counts), "tid", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ahead = Window.partitionBy("item").orderBy("place").rowsBetween(0, length - 1)
    rare = F.sort_array(F.collect_list(F.struct("df", "place", "tid")).over(ahead))
    windows = known.withColumn("rare", rare).where((F.col("place") + length <= F.col("n_words")) | (F.col("place") == 0))
    first, second = F.col("rare")[0], F.when(F.size("rare") > 1, F.col("rare")[1]).otherwise(F.col("rare")[0])
    # a window with a term that no document has stands nowhere
    pairs = windows.where(first["df"] > 0).select("item", F.col("place"), (F.col("place") + F.size("rare")).alias("stop"), *(x[c].alias(f"{c}{k}") for k, x in ((1, first), (2, second)) for c in ("place", "tid")))
    return saved(pairs.groupBy("item", "place1", "tid1", "place2", "tid2").agg(F.min("place").alias("start"), F.max("stop").alias("stop")), "anchors")


def _aligned(postings: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """item, place, row and shift (position minus place) of all postings of the k-th term of the pairs."""
    ends = pairs.select("item", F.col(f"place{k}").alias("place"), F.col(f"tid{k}").alias("tid")).distinct()
    return postings.join(sided(ends), "tid").select("item", F.col("place").alias(f"place{k}"), "row", (F.col("position") - F.col("place")).alias("shift"))


def phrases(postings: DataFrame, slots: DataFrame, *, length: int = 10, most_rows: int = 500_000) -> DataFrame:
    """The words of documents that lie in an occurrence of a window of an item: row, item, shift, position.

    Each alignment of an item with a row (shift: the position at which the item's first word would stand) has its own
    rows.  What is left of the alignments after the second list is broadcast for the other words if it has no more than
    ``most_rows`` words, and met by a shuffle else; the result is the same.
    """
    pairs = anchors(slots, postings, length)
    first = _aligned(postings, pairs, 1).join(sided(pairs.select("item", "place1", "place2", "start", "stop")), ["item", "place1"])
    both = first.join(_aligned(postings, pairs, 2), ["item", "place2", "row", "shift"])
    spots = both.select("item", "row", "shift", F.explode(F.sequence("start", F.col("stop") - 1)).alias("place")).where(F.col("shift") + F.col("place") >= 0).distinct()
    wanted = saved(spots.join(sided(slots), ["item", "place"]).select("item", "row", "shift", "place", "n_words", "tid", (F.col("shift") + F.col("place")).alias("position")), "wanted")
    met = postings.join(sided(wanted, most_rows), ["row", "position", "tid"])
    order = Window.partitionBy("row", "item", "shift").orderBy("place")
    runs = met.withColumn("run", F.col("place") - F.row_number().over(order))
    whole = Window.partitionBy("row", "item", "shift", "run")
    return runs.withColumn("n", F.count(F.lit(1)).over(whole)).where(F.col("n") >= F.least(F.lit(length), F.col("n_words"))).select("row", "item", "shift", "position")


def near(postings: DataFrame, slots: DataFrame, *, length: int = 10, within: int = 20) -> DataFrame:
    """Proximity matches: row, item and position of the rarest term of a window where its second rarest one stands at most
    ``within`` words away on either side, in any order, with the distance to the nearest (``gap``).

    Positions are met by blocks of ``within`` words and their neighbours.
    """
    pairs = anchors(slots, postings, length)
    at = [_aligned(postings, pairs, k).select("item", f"place{k}", "row", (F.col("shift") + F.col(f"place{k}")).alias(f"position{k}")) for k in (1, 2)]
    block = F.floor(F.col("position1") / within)
    first = at[0].join(sided(pairs.select("item", "place1", "place2")), ["item", "place1"]).withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    second = at[1].withColumn("block", F.floor(F.col("position2") / within))
    gap = F.abs(F.col("position1") - F.col("position2"))
    met = first.join(second, ["item", "place2", "row", "block"]).where((gap <= within) & ((gap > 0) | (F.col("place1") == F.col("place2"))))
    return met.groupBy("row", "item", F.col("position1").alias("position")).agg(F.min(gap).alias("gap"))


def report(idx: Index, found: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (as strings, sorted), items_sha256 and contaminated of each row of the documents.

    An item without an id marks words, but isn't counted or listed.
    """
    found = saved(found, "phrases")
    hit = found.select("row", "position").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("row", "item").distinct().join(sided(members.where(F.col("item_id").isNotNull())), "item")
    listed = named.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    marks = hit.join(listed, "row", "left")
    none = F.array().cast("array<string>")
    out = idx.documents.join(sided(marks), "row", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "item_ids": F.coalesce("item_ids", none)})
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
