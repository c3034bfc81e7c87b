"""Exact BM25 top-k search: an inverted index for each shard, pruned by block-max WAND, merged under global statistics.

``index`` writes posting lists of all words of all documents, a row for each word of a shard.  A list is cut into blocks of
its own, and each block tells its greatest count and the least length of its documents, which bound its contributions under
any statistics and parameters.  ``search`` reads the lists of its queries' words only.

In a shard the blocks' ends of a query's lists cut the documents into windows, in each of which every list has one block.
The search moves in document order, with a threshold that the windows of the greatest sums of block maxima have given it.
Its next pivot is the first window in which that sum is more than the k-th best score so far; all before it is skipped
unread.  There, documents whose own lists' block maxima don't sum to more are passed over, and only the others'
contributions are worked out.

Contributions are rounded to millionths, so that scores add up alike in any order and ties are true ties.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm.common import blocks, saved, small_batches

_TERMS = re.compile(r"[^\W_]+").findall
UNIT = 1_000_000
_INDEX = "shard long, term string, df int, docs binary, counts binary, most binary, least binary, n_rows long, n_words long"


def terms(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case letter by letter: the final form of a letter is like its others."""
    if not text:
        return []
    if not text.isascii():
        return _TERMS(text.replace("İ", "i").lower().replace("ς", "σ"))
    return _TERMS(text.lower())


class Builder:
    """Gathers the documents of a shard."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.numbers: list[np.ndarray] = []
        self.term: dict[str, int] = defaultdict(itertools.count().__next__)
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        found = terms(text)
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.numbers.append(np.fromiter(map(self.term.__getitem__, found), dtype=np.int64, count=len(found)))
        self.size += len(found) + 1

    def rows(self, shard: int, block: int) -> pa.RecordBatch:
        """A row for each term, in order, and one without a term for the documents: their ids in ascending order, those
        without an id left out, and the lengths of all, those without an id last."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        spot = np.empty(len(order), dtype=np.int64)
        spot[order] = np.arange(len(order))
        length = np.array(self.lengths, dtype=np.int64)
        ids = np.array([self.ids[k] for k in order if self.ids[k] is not None], dtype="<i8")

        names = sorted(self.term)
        rank = np.empty(len(names), dtype=np.int64)
        rank[[self.term[t] for t in names]] = np.arange(len(names))
        key = rank[np.concatenate([np.empty(0, dtype=np.int64), *self.numbers])] * len(order) + np.repeat(spot, length)
        key.sort()
        at = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(at, append=len(key)).astype("<i4")
        term, doc = np.divmod(key[at], max(1, len(order)))
        lists = np.flatnonzero(np.diff(term, prepend=-1))
        df = np.diff(lists, append=len(term))
        n_blocks = -(-df // block)
        of_list = np.cumsum(n_blocks) - n_blocks
        starts = np.repeat(lists - of_list * block, n_blocks) + np.arange(n_blocks.sum()) * block
        sorted_length = length[order].astype("<i4")
        most = np.maximum.reduceat(count, starts) if len(starts) else count
        least = np.minimum.reduceat(sorted_length[doc], starts) if len(starts) else sorted_length[:0]

        def packed(values: np.ndarray, first: np.ndarray, whole: np.ndarray) -> pa.Array:
            raw = values.tobytes() + whole.tobytes()
            bounds = np.append(first * values.itemsize, [values.nbytes, len(raw)]).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(first) + 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw)])

        nothing = np.empty(0, dtype="<i4")
        n = len(names)
        columns = [
            pa.array(np.full(n + 1, shard, dtype=np.int64)),
            pa.array([*names, None], pa.string()),
            pa.array(np.append(df, len(ids)).astype(np.int32)),
            packed(doc.astype("<i4"), lists, ids),
            packed(count, lists, sorted_length),
            packed(most, of_list, nothing),
            packed(least, of_list, nothing),
            pa.array([None] * n + [len(order)], pa.int64()),
            pa.array([None] * n + [int(length.sum())], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _INDEX.split(", ")])


def index(docs: DataFrame, *, block: int = 128, shard_words: int = 2_000_000) -> DataFrame:
    """The inverted index of rows (doc_id, text), written to the shared folder: all words of the whole texts.

    A shard is the documents that a task meets one after another until they have ``shard_words`` words.  Each row is a
    document, repeated ids too; null texts are empty documents, and rows with a null id count in the statistics only.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, shard = TaskContext.get().partitionId(), 0, Builder()
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for at, texts in blocks(b.column("text")):
                for k, text in enumerate(texts):
                    shard.add(ids[at + k], text)
                    if shard.size >= shard_words:
                        yield from sliced(shard.rows((task << 32) + n, block))
                        n, shard = n + 1, Builder()
        if shard.ids:
            yield from sliced(shard.rows((task << 32) + n, block))

    def sliced(rows: pa.RecordBatch, most: int = 20_000) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), most):
            yield rows.slice(at, most)

    given = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(given.mapInArrow(made, _INDEX), "index")


@dataclass
class Postings:
    """The list of a query's term in a shard: documents by their place, counts, and what bounds each block; how often the
    query has the term, and its weight."""

    docs: np.ndarray
    counts: np.ndarray
    most: np.ndarray
    least: np.ndarray
    times: int
    idf: float


@dataclass
class Shard:
    """A shard's documents, those without an id at the end, and the parameters of a score."""

    ids: np.ndarray
    lengths: np.ndarray
    mean: float
    block: int
    k1: float = 1.2
    b: float = 0.75

    def gain(self, weight: np.ndarray | float, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        f = count.astype(np.float64)
        return np.rint(UNIT * (weight * f * (self.k1 + 1) / (f + self.k1 * (1 - self.b + self.b * length / self.mean))))

    def top(self, lists: list[Postings], k: int) -> tuple[list[tuple[int, int]], int]:
        """(score, doc_id) of the ``k`` best documents, ties to smaller ids, and how many postings were scored."""
        lists = [p for p in lists if len(p.docs)]
        if not lists:
            return [], 0
        ends = [np.append(p.docs[self.block - 1 : -1 : self.block], p.docs[-1]) for p in lists]
        edges = np.unique(np.concatenate(ends))
        bound = np.zeros((len(lists), len(edges)))
        until = np.zeros((len(lists), len(edges) + 1), dtype=np.int64)
        first = 0
        for i, (p, end) in enumerate(zip(lists, ends)):
            best = np.append(p.times * self.gain(p.idf, p.most, p.least), 0.0)
            bound[i] = best[np.searchsorted(end, edges)]
            until[i, 1:] = first + np.searchsorted(p.docs, edges, side="right")
            until[i, 0] = first
            first += len(p.docs)
        docs, counts = np.concatenate([p.docs for p in lists]), np.concatenate([p.counts for p in lists])
        times, idf = np.array([p.times for p in lists], dtype=np.float64), np.array([p.idf for p in lists])
        whole = bound.sum(axis=0)
        scored = 0

        def reached(pivot: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
            """Score and place of the documents of some windows whose score is above ``floor``."""
            nonlocal scored
            lo, size = until[:, pivot], (until[:, pivot + 1] - until[:, pivot]).ravel()
            posting = np.repeat(lo.ravel() - (np.cumsum(size) - size), size) + np.arange(size.sum())
            doc, which = np.unique(docs[posting], return_inverse=True)
            likely = np.bincount(which, weights=np.repeat(bound[:, pivot].ravel(), size), minlength=len(doc)) > floor
            use = (likely & (doc < len(self.ids)))[which]
            posting, which = posting[use], which[use]
            term = np.repeat(np.repeat(np.arange(len(lists)), len(pivot)), size)[use]
            scored += len(posting)
            gains = times[term] * self.gain(idf[term], counts[posting], self.lengths[docs[posting]])
            sums = np.bincount(which, weights=gains, minlength=len(doc))
            hit = np.flatnonzero(sums > floor)
            return sums[hit], doc[hit]

        # the most promising windows tell what the k-th best score is at least; what equals it is looked at again in order
        first = np.sort(np.argsort(-whole, kind="stable")[:8])
        floor = max(0.0, float(np.sort(reached(first, 0.0)[0])[::-1][k - 1 : k].sum()) - 1)
        score, found, at, step = np.empty(0), np.empty(0, dtype=np.int64), 0, 8
        while len(pivot := at + np.flatnonzero(whole[at:] > floor)[:step]):
            at, step = int(pivot[-1]) + 1, min(step * 2, 256)
            score, found = (np.concatenate(x) for x in zip((score, found), reached(pivot, floor)))
            keep = np.lexsort((found, -score))[:k]
            score, found = score[keep], found[keep]
            if len(score) == k:
                floor = float(score[-1])
        return [(int(s), int(self.ids[d])) for s, d in zip(score, found)], scored


def asked(queries: DataFrame) -> DataFrame:
    """query_id, term and times of the words of rows (query_id, text); rows of one id are one query, those of none are left
    out."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(q, t, n) for q, text in zip(pdf["query_id"], pdf["text"]) for t, n in Counter(terms(text)).items()]
            yield pd.DataFrame(rows, columns=["query_id", "term", "times"])

    given = queries.select(F.col("query_id").cast("long").alias("query_id"), "text").where(F.col("query_id").isNotNull())
    return given.mapInPandas(made, "query_id long, term string, times long").groupBy("query_id", "term").agg(F.sum("times").alias("times"))


def search(docs: DataFrame, queries: DataFrame, *, top: int = 20, k1: float = 1.2, b: float = 0.75, block: int = 128, shard_words: int = 2_000_000, slice_words: int = 100_000) -> DataFrame:
    """As ``find``, in an index made for the purpose."""
    return find(index(docs, block=block, shard_words=shard_words), queries, top=top, k1=k1, b=b, block=block, slice_words=slice_words)


def find(held: DataFrame, queries: DataFrame, *, top: int = 20, k1: float = 1.2, b: float = 0.75, block: int = 128, slice_words: int = 100_000) -> DataFrame:
    """query_id, rank (from 1), doc_id and score of the ``top`` documents of an ``index`` for each query (query_id, text).

    score is the sum over the query's terms, repeats counted, of ln(1 + (N - n + 0.5) / (n + 0.5)) * f * (k1 + 1) /
    (f + k1 * (1 - b + b * length / mean length)), each rounded to a millionth; N counts all rows, n those with the term.
    Documents without a term of the query, and those with a null id, are no results.  Ties go to the smaller doc_id, and
    equal rows take ranks of their own.  Queries without words, an empty index and no queries give no rows.

    Queries are dealt into slices of about ``slice_words`` different words, each searched and broadcast on its own.
    """
    spark = held.sparkSession
    words = saved(asked(queries), "asked")
    slices = max(1, -(-words.count() // slice_words))
    total = held.where(F.col("term").isNull()).agg(F.sum("n_rows").alias("n"), F.sum("n_words").alias("words")).first()
    n, mean = total["n"] or 0, float((total["words"] or 0) / (total["n"] or 1)) or 1.0

    def in_shards(mine: DataFrame) -> DataFrame:
        lists = held.join(F.broadcast(mine.select("term").distinct()), "term", "left_semi")
        df = {r["term"]: r["df"] for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        idf = {t: float(np.log(1 + (n - c + 0.5) / (c + 0.5))) for t, c in df.items()}
        by_query: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for r in mine.where(F.col("term").isNotNull()).collect():
            if r["term"] in idf:
                by_query[r["query_id"]].append((r["term"], r["times"]))
        shared = spark.sparkContext.broadcast((dict(by_query), idf))

        def searched(pdf: pd.DataFrame) -> pd.DataFrame:
            by_query, idf = shared.value
            whole = pdf[pdf["term"].isna()].iloc[0]
            read = lambda x: np.frombuffer(x, dtype="<i4")
            shard = Shard(np.frombuffer(whole["docs"], dtype="<i8"), read(whole["counts"]), mean, block, k1, b)
            found = {r.term: (read(r.docs), read(r.counts), read(r.most), read(r.least)) for r in pdf[pdf["term"].notna()].itertuples()}
            rows = []
            for q, asked_for in by_query.items():
                best, _ = shard.top([Postings(*found[t], times, idf[t]) for t, times in asked_for if t in found], top)
                rows += [(q, doc, score) for score, doc in best]
            return pd.DataFrame(rows, columns=["query_id", "doc_id", "units"]).astype("int64")

        sides = lists.unionByName(held.where(F.col("term").isNull())).select("shard", "term", "docs", "counts", "most", "least")
        return sides.groupBy("shard").applyInPandas(searched, "query_id long, doc_id long, units long")

    parts = [in_shards(words.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == s)) for s in range(slices)]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("units"), "doc_id"))
    merged = reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(F.col("rank") <= top)
    return merged.select("query_id", "rank", "doc_id", (F.col("units") / UNIT).alias("score"))
