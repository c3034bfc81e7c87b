"""Hard negatives by Fagin's threshold algorithm.

Rows are written once, in files of bounded size in the shared folder; a file is a block.  A task gets anchors of one block,
reads the block's file and sorts its rows once for each dimension.  An anchor goes through the lists of its dimensions at
once, from the top where its component is positive and from the bottom where it is negative (sorted access), and scores
each row that it meets for the first time (random access).  No row that it hasn't met can score more than the threshold,
the inner product of the anchor with the values at which it stands; so it stops once the threshold is strictly below the
k-th score of every window that it searches.  Only anchors are shuffled, once for each block; rows never are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm.common import read_table, saved, shared_dir, small_batches

Best = tuple[np.ndarray, np.ndarray]


def finite(vector: str) -> Column:
    """True for vectors whose components are all given and finite."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


class Lists:
    """Rows of integers, sorted by each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.order = np.ascontiguousarray(x.argsort(axis=0, kind="stable").T.astype(np.int32))
        self.values = np.ascontiguousarray(np.take_along_axis(x, self.order.T, axis=0).T)
        self.most = int(np.abs(x).max()) if x.size else 0
        self.typed: dict[type, np.ndarray] = {}

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products: in floats as far as these hold every partial sum, else in whole numbers of any size."""
        bound = self.most * int(np.abs(anchor).sum())
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
        if kind not in self.typed:
            self.typed[kind] = self.x.astype(kind)
        return (self.typed[kind][rows] @ anchor.astype(kind)).astype(np.int64)

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, int | float]]:
        """Runs of rows met for the first time, each with the most that any row not met yet can score."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) and not len(down):
            up = np.arange(len(anchor))  # nothing but zeros: all rows score 0
        seen, done = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        at, step = 0, 16
        while at < n:
            to = min(n, at + step)
            seen[self.order[up, n - to : n - at]] = True
            seen[self.order[down, at:to]] = True
            new = np.flatnonzero(seen & ~done)
            done[new] = True
            ends = (int(a) * int(v) for d, v in ((up, self.values[up, n - to]), (down, self.values[down, to - 1])) for a, v in zip(anchor[d], v))
            yield new, -np.inf if done.all() else sum(ends)
            if done.all():
                return
            at, step = to, step * 2


def merged(best: Best, scores: np.ndarray, ids: np.ndarray, most: int) -> Best:
    """The ``most`` highest scores, ties to smaller ids."""
    s, i = np.concatenate([best[0], scores]), np.concatenate([best[1], ids])
    if len(s) > 64 * most:  # what is below the last of the best can't be among them
        few = s >= np.partition(s, -most)[-most]
        s, i = s[few], i[few]
    order = np.lexsort((i, -s))[:most]
    return s[order], i[order]


_NONE: Best = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))


def nearest(lists: Lists, own: int, label: int, anchor: np.ndarray, most: int) -> Best:
    """The best ``most`` rows of the anchor's label but for its own id's."""
    best = _NONE
    for new, threshold in lists.walk(anchor):
        rows = new[(lists.labels[new] == label) & (lists.ids[new] != own)]
        if len(rows):
            best = merged(best, lists.scores(rows, anchor), lists.ids[rows], most)
        if len(best[0]) == most and threshold < best[0][-1]:
            break
    return best


def within(lists: Lists, own: int, label: int, anchor: np.ndarray, goals: list[int], low: int, high: int, most: int) -> list[Best]:
    """For each goal the best ``most`` rows of other labels with low * goal <= 100 * score <= high * goal."""
    best = [_NONE] * len(goals)
    ends = [(-(-low * g // 100), high * g // 100) for g in goals]  # whole scores, so no product can overflow
    for new, threshold in lists.walk(anchor):
        rows = new[(lists.labels[new] != label) & (lists.ids[new] != own)]
        s, ids = lists.scores(rows, anchor), lists.ids[rows]
        going = False
        for k, (first, last) in enumerate(ends):
            inside = (s >= first) & (s <= last)
            if inside.any():
                best[k] = merged(best[k], s[inside], ids[inside], most)
            full = len(best[k][0]) == most
            going |= first <= last and not (threshold < first or full and threshold < best[k][0][-1])
        if not going:
            break
    return best


def _read(path: str) -> Lists:
    """A block's rows."""
    t = read_table(path)
    vectors = t["vector"].combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return Lists(t["id"].to_numpy(), t["label"].to_numpy(), flat.reshape(len(t), -1))


def _searched(anchors: DataFrame, files: list[str], find: Callable[[Lists, dict], Iterator[tuple]], schema: str, chunk: int) -> DataFrame:
    """Sends each anchor to each block; ``find`` gives the rows of ``schema`` that an anchor has in a block."""
    chunks = max(1, -(-anchors.count() // chunk))
    names = [c.split()[0] for c in schema.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists = -1, None
        for b in batches:
            out: list[tuple] = []
            for a in b.to_pylist():
                if a["block"] != block:
                    block, lists = a["block"], _read(files[a["block"]])
                if len(lists.ids):
                    out += find(lists, a | {"vector": np.array(a["vector"], dtype=np.int64)})
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=pa.schema([(n, pa.int64()) for n in names]))

    dealt = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(len(files) - 1)))).withColumn("_chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    dealt = dealt.repartition(min(len(files) * chunks, 10_000), "block", "_chunk").sortWithinPartitions("block")
    return small_batches(dealt).mapInArrow(search, schema)


def _first(df: DataFrame, key: list[str], score: str, id_: str, out: str, most: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc(score), id_)
    return df.withColumn(out, F.row_number().over(order)).where(F.col(out) <= most)


def mine(rows: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_rows: int = 65_536, chunk: int = 65_536) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    ``rows`` and ``anchors`` have id, label (long) and vector (array<long>, all of one length); anchors have ids of their
    own.  Scores are inner products with the anchor, which have to fit in a long; higher ones come first, ties to the
    smaller id.  Positives: the first ``positives`` rows of the anchor's label; negatives of a positive: the first
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's.  Rows of the anchor's
    id are neither.  Rows of one id are candidates each.  A positive without negatives gives no row.

    A block has at most ``block_rows`` rows, and a task at most about ``chunk`` anchors of each of its blocks.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    rows.select("id", "label", "vector").write.option("maxRecordsPerFile", block_rows).parquet(path)
    files = sorted(spark.read.parquet(path).inputFiles())
    asked = saved(anchors.select("id", "label", "vector"), "anchors")

    def near(lists: Lists, a: dict) -> Iterator[tuple]:
        return ((a["id"], i, s) for s, i in zip(*(x.tolist() for x in nearest(lists, a["id"], a["label"], a["vector"], positives))))

    found = _searched(asked, files, near, "anchor_id long, positive_id long, positive_score long", chunk)
    pairs = saved(_first(found, ["anchor_id"], "positive_score", "positive_id", "nth", positives), "positives")

    goals = pairs.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("nth", "positive_score")))["positive_score"].alias("goals"))

    def hard(lists: Lists, a: dict) -> Iterator[tuple]:
        best = within(lists, a["id"], a["label"], a["vector"], a["goals"], low, high, negatives)
        return ((a["id"], k + 1, i, s) for k, b in enumerate(best) for s, i in zip(*(x.tolist() for x in b)))

    met = _searched(asked.join(goals, "id"), files, hard, "anchor_id long, nth long, negative_id long, negative_score long", chunk)
    top = _first(met, ["anchor_id", "nth"], "negative_score", "negative_id", "rank", negatives)
    return top.join(pairs, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
