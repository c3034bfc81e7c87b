"""Nearest neighbours by inner product with an inverted multi-index.

The two halves of a vector are quantised apart, each to one of k centroids, so that k * k cells share out the rows.  A
query walks through the centroid pairs by rising summed distance, with a heap, until the cells it has met hold a given
share of all rows; the entries of those cells are then ranked by their exact inner product.

Rows are dealt once into blocks of cells of bounded size (a crowded cell's rows are dealt over several blocks), and each
block is a file in the shared folder.  A query is sent to the blocks that hold a cell of its walk.  Queries are dealt into
chunks of bounded size, and a task reads one block against one chunk; so what is shuffled of the rows doesn't grow with the
number of queries.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm.common import hash_fraction, read_table, shared_dir, small_batches


@dataclass
class MultiIndex:
    """Centroids of both halves, the sampled rows, rows of each cell, and the blocks of each first centroid (first, number)."""

    halves: tuple[np.ndarray, np.ndarray]
    sample_ids: np.ndarray
    sample: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    number: np.ndarray

    def __post_init__(self) -> None:
        self.sample_cells = self.cells(self.sample)

    @property
    def cut(self) -> int:
        return self.halves[0].shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each half to its centroids: the negative inner product, which sums over the halves."""
        return -(x[:, : self.cut] @ self.halves[0].T), -(x[:, self.cut :] @ self.halves[1].T)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each half, by Euclidean distance."""
        parts = x[:, : self.cut], x[:, self.cut :]
        i, j = (((c**2).sum(axis=1) - 2 * (p @ c.T)).argmin(axis=1) for p, c in zip(parts, self.halves))
        return i, j

    def floor(self, score: np.ndarray, own: int, far: np.ndarray, reached: np.ndarray, top: int) -> float:
        """The ``top``-th best score among the sampled rows that the walk meets; nothing below it can be in the result.

        score: the query's inner products with the sampled rows.
        """
        i, j = self.sample_cells
        order = far.argsort(kind="stable").argsort(kind="stable")
        met = score[(order[j] < reached[i]) & (self.sample_ids != own)]
        return float(np.partition(met, -top)[-top]) if len(met) >= top else -np.inf

    def walk(self, near: np.ndarray, far: np.ndarray, rows: int) -> np.ndarray:
        """For each first centroid, how many second centroids in rising distance the walk reaches before ``rows`` rows are met."""
        left, right = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
        a, b = near[left].tolist(), far[right].tolist()
        counts = self.counts[np.ix_(left, right)].tolist()
        reached = [0] * len(a)
        heap = [(a[0] + b[0], 0, 0)]
        met = 0
        while heap and met < rows:
            _, p, q = heapq.heappop(heap)
            met += counts[p][q]
            reached[p] = q + 1
            if q + 1 < len(b):
                heapq.heappush(heap, (a[p] + b[q + 1], p, q + 1))
            if q == 0 and p + 1 < len(a):
                heapq.heappush(heap, (a[p + 1] + b[0], p + 1, 0))
        out = np.zeros(len(a), dtype=np.int32)
        out[left] = reached
        return out


def usable(vector: str, dim: int) -> Column:
    """True for vectors of ``dim`` finite components that aren't all zero."""
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) == dim) & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


def _means(x: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    rng = np.random.default_rng(5)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].astype(np.float64)
    for _ in range(turns):
        own = ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def build(rows: DataFrame, *, k: int = 64, most_rows: int = 20_000, most_block: int = 16_384) -> MultiIndex:
    """Learns from rows (id, vector): the centroids from about ``most_rows`` rows chosen by a hash of their id, the counts
    from all."""
    n = rows.count()
    drawn = rows.where(hash_fraction("id", seed=3) <= most_rows / max(n, 1)).orderBy("id").toPandas()
    if not len(drawn):
        drawn = rows.orderBy("id").limit(1).toPandas()
    sample = matrix(drawn["vector"])
    cut = sample.shape[1] // 2
    halves = _means(sample[:, :cut], k), _means(sample[:, cut:], k)
    index = MultiIndex(halves, drawn["id"].to_numpy(dtype=np.int64), sample, np.zeros((len(halves[0]), len(halves[1])), dtype=np.int64), np.zeros(1), np.zeros(1))
    for r in placed(rows, index).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect():
        index.counts[r["i"], r["j"]] = r["n"]
    size = min(most_block, max(512, n // 64))
    index.first, index.number = np.zeros(len(halves[0]), dtype=np.int64), np.ones(len(halves[0]), dtype=np.int64)
    block = held = 0
    for i, m in enumerate(index.counts.sum(axis=1).tolist()):
        if held and held + m > size:
            block, held = block + 1, 0
        index.first[i] = block
        held += m
        if m > size:
            index.number[i] = -(-m // size)
            block, held = block + int(index.number[i]), 0
    return index


def placed(rows: DataFrame, index: MultiIndex) -> DataFrame:
    """Adds i, j (the cell) and block to rows (id, vector)."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            if len(pdf):
                i, j = m.cells(matrix(pdf["vector"]))
                pdf["i"], pdf["j"] = i, j
                if len(m.first) == len(m.halves[0]):
                    spread = (pdf["id"].to_numpy(dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    pdf["block"] = m.first[i] + spread.astype(np.int64) % m.number[i]
                else:
                    pdf["block"] = 0
                yield pdf[["id", "vector", "i", "j", "block"]]

    return rows.mapInPandas(at, f"id long, vector {dict(rows.dtypes)['vector']}, i int, j int, block long")


def search(rows: DataFrame, queries: DataFrame, *, top: int = 20, share: float = 0.45, least: int = 2000, k: int = 64, chunk: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``top`` nearest rows found.

    ``rows`` and ``queries`` have id (long) and vector (array<float> or array<double>, of one length, as ``usable``
    tells).  A row of the query's own id is no candidate.  Cells are met until they hold ``share`` of all rows and
    ``least`` rows.  score is the inner product of the given vectors in double precision; nearest first, ties to the
    smaller id.  Rows of one id are candidates each; queries need ids of their own.  ``rows`` must not be empty.
    """
    index = build(small_batches(rows), k=k)
    spark, total = rows.sparkSession, int(index.counts.sum())
    shared = spark.sparkContext.broadcast(index)
    wanted = max(least, int(np.ceil(share * total)))
    chunks = max(1, -(-queries.count() // chunk))
    kind = dict(rows.dtypes)["vector"]

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = []
            if len(pdf):
                given = matrix(pdf["vector"])
                near, far = m.distances(given)
                for q, v, x, y, z in zip(pdf["id"], pdf["vector"], near, far, given):
                    reached = m.walk(x, y, wanted)
                    floor = m.floor(m.sample @ z, q, y, reached, top)
                    to = {b for i in np.flatnonzero(reached) for b in range(m.first[i], m.first[i] + m.number[i])}
                    out += [(b, q, v, reached, floor) for b in sorted(to)]
            yield pd.DataFrame(out, columns=["block", "id", "vector", "reached", "floor"])

    def ranked(key: tuple[int, int], qs: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        es = pd.concat([read_table(f).to_pandas() for f in files.get(key[0], [])]) if key[0] in files else pd.DataFrame({"id": []})
        out: list[tuple[np.ndarray, ...]] = []
        if len(qs) and len(es):
            es = es.sort_values(["i", "j", "id"], kind="stable")
            same = es["vector"].map(lambda v: v.tobytes())
            # of equal vectors only the smallest ids can be among the nearest; one more, as the query itself may be one
            es = es[es.groupby(same).cumcount() <= top]
            vectors, ids = matrix(es["vector"]), es["id"].to_numpy(dtype=np.int64)
            cells = list(es.groupby(["i", "j"], sort=False).indices.items())
            for at in range(0, len(qs), 512):
                part = qs.iloc[at : at + 512]
                x, own = matrix(part["vector"]), part["id"].to_numpy(dtype=np.int64)
                order = m.distances(x)[1].argsort(axis=1, kind="stable").argsort(axis=1)
                reached = np.stack(part["reached"].to_list())
                score = np.full((len(part), len(es)), -np.inf)
                for (i, j), e in cells:
                    q = np.flatnonzero(order[:, j] < reached[:, i])
                    score[np.ix_(q, e)] = x[q] @ vectors[e].T
                score[own[:, None] == ids[None, :]] = -np.inf
                last = np.maximum(np.partition(score, -min(top, len(es)), axis=1)[:, -min(top, len(es))], part["floor"].to_numpy())
                q, e = np.nonzero((score >= (last - 1e-9 * np.abs(last) - 1e-12)[:, None]) & (score > -np.inf))
                out.append((own[q], ids[e], (x[q] * vectors[e]).sum(axis=1)))
        empty = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
        cols = [np.concatenate(c) for c in zip(empty, *out)] if out else empty
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))

    spread = queries.select("id", "vector").repartition(max(spark.sparkContext.defaultParallelism, 8), "id")
    asked = spread.mapInPandas(sent, f"block long, id long, vector {kind}, reached array<int>, floor double")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    path = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    placed(rows.select("id", "vector"), index).repartition("block").write.partitionBy("block").parquet(path)
    files: dict[int, list[str]] = {}
    for f in spark.read.parquet(path).inputFiles():
        files.setdefault(int(re.search(r"/block=(\d+)/", f)[1]), []).append(f)
    pairs = asked.groupBy("block", "chunk").applyInPandas(ranked, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
