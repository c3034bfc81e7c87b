"""Near-duplicate groups: fast similarity sketches, banding, and exact verification on full shingle sets.

A sketch has ``SIZE`` coordinates.  In round i every shingle is hashed to a coordinate and a value in [i, i + 1), and a
coordinate keeps its least value; rounds go on until every coordinate is filled.  From round ``SIZE`` on all shingles go
to the one coordinate i - SIZE, so that at most 2 * SIZE rounds fill everything.  Two coordinates agree with the
probability of the sets' Jaccard similarity, and their mean is as concentrated as that of independent samples.

Documents with equal sets are one node.  Nodes that agree in all coordinates of a band share a bucket.  A bucket's links
are looked for in steps that lose none of its components: first every member is held against one pivot, drawn anew for
each bucket; after that only pairs whose members are still in different components.  Sketches drop pairs that are
hopeless (over four standard deviations below the threshold) and the rest is verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.llm.common import blocks, saved, small_batches, take_over
from telespark.llm.components import components

SIZE, ROWS = 128, 4
BANDS = SIZE // ROWS
WORDS = 5
_MUL, _MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = np.array([xxhash.xxh3_64_intdigest(f"round {i}") for i in range(2 * SIZE)], dtype=np.uint64)
#: Members of a bucket that one task compares with as many others, and the sum of their sets' sizes that makes them fewer.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Rows up to which a list of ids is sent to every executor (8 bytes a row); a longer one is joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _MUL
    x ^= x >> np.uint64(31)
    x *= _MUL2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of five words; of the whole sequence where it has fewer words.

    A-Z are lower-cased, and words are what stands between ASCII white space.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, text.encode("utf-8", "surrogatepass").lower().split()), dtype=np.uint64)
    n = len(hashed)
    if n == 0:
        return hashed
    width = min(n, WORDS)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _mix(out ^ hashed[k : n - width + 1 + k])
    return np.unique(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set, each coordinate shortened to 32 bits."""
    best = np.full(SIZE, np.iinfo(np.uint64).max, dtype=np.uint64)
    at = 0
    while at < 2 * SIZE:
        rounds = 1 if len(s) >= 2 * SIZE else min(2 * SIZE - at, max(1, 4 * SIZE // len(s)))
        i = np.arange(at, at + rounds)
        h = _mix(s[None, :] ^ _SEEDS[i][:, None])
        place = np.where(i[:, None] < SIZE, (h & np.uint64(SIZE - 1)).astype(np.int64), (i - SIZE)[:, None])
        value = (i.astype(np.uint64)[:, None] << np.uint64(56)) | (h >> np.uint64(8))
        np.minimum.at(best, place.ravel(), value.ravel())
        at += rounds
        if best.max() < np.iinfo(np.uint64).max:
            break
    return (_mix(best) >> np.uint64(32)).astype("<u4")


def _batches(b: pa.RecordBatch) -> Iterator[tuple[int, int, list]]:
    take_over("minhash", lambda: None)
    for at, texts in blocks(b.column("text")):
        yield at, len(texts), [shingles(t) for t in texts]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, row, n_shingles, sig (16 bytes that tell sets apart; null for an empty one) and sketch of each row
    of ``docs`` (doc_id, text, text_hash, row)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, sets in _batches(b):
                size = pa.array([len(s) for s in sets], pa.int64())
                sig = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                drawn = pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())
                named = [b.column(c).slice(at, n) for c in ("doc_id", "text_hash", "row")]
                yield pa.RecordBatch.from_arrays([*named, size, sig, drawn], ["doc_id", "text_hash", "row", "n_shingles", "sig", "sketch"])

    return docs.mapInArrow(made, "doc_id long, text_hash long, row long, n_shingles long, sig binary, sketch binary")


def restrict(df: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """The rows of ``df`` whose ``by`` is among ``keys`` (one column of that name, distinct longs)."""
    small = keys.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if small else keys, by, "left_semi")


def _plausible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches agree in at least a share ``least`` of their coordinates."""

    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = (np.frombuffer(b"".join(s), dtype="<u4").reshape(-1, SIZE) for s in (x, y))
        return pd.Series((p == q).mean(axis=1) >= least)

    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    drawn = restrict(nodes.select("node", "sketch"), used, "node")
    both = pairs.join(drawn.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
    both = both.join(drawn.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    return both.where(F.pandas_udf(close, "boolean")("x", "y")).select("a", "b")


def _sets(used: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and members (its full set, sorted as unsigned numbers) of the distinct nodes ``used``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, found in _batches(b):
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                members = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.empty(0, dtype=np.uint64), *found]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), members], ["sig", "members"])

    named = saved(restrict(nodes.select("node", "row", "sig"), used, "node"), "named")
    texts = restrict(docs.select("row", "text"), named.select("row"), "row")
    once = texts.mapInArrow(made, "sig binary, members array<long>").groupBy("sig").agg(F.first("members").alias("members"))  # rows may repeat
    return saved(once.join(named.select("sig", "node"), "sig").select("node", "members"), "sets")


def linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """For each other set: is 100 * intersection >= percent * union?  All are sorted unsigned numbers without repeats."""
    size = np.array([len(x) for x in others], dtype=np.int64)
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    both = np.add.reduceat((one[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
    return 100 * both >= percent * (size + len(one) - both)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""

    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    full = _sets(used, nodes, docs)
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    both = both.join(full.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _members(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """key, band, node, n_shingles and root of each member of each bucket; ``buckets`` has one row for each node, so roots
    are joined to nodes and not to members.  A node that has no links is its own root."""
    rooted = buckets.withColumn("root", F.col("node")) if roots is None else buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.select("node", "n_shingles", "root", F.explode("at").alias("x")).select("x.key", "x.band", "node", "n_shingles", "root")


def _against_pivots(buckets: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's members with one of them, which is drawn by ``turn``; where roots are given, only
    pairs of different components."""
    salt = F.xxhash64("band", F.lit(turn))
    members = _members(buckets, roots).select("key", "node", "root", F.col("node").bitwiseXOR(salt).alias("drawn"), salt.alias("salt"))
    pivot = members.groupBy("key").agg(F.min(F.struct("drawn", "root", "salt")).alias("p"))
    pivot = pivot.select("key", F.col("p.drawn").bitwiseXOR(F.col("p.salt")).alias("pivot"), F.col("p.root").alias("other"))
    pairs = members.select("key", "node", "root").join(pivot, "key").where(F.col("root") != F.col("other"))
    return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _all_others(buckets: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, least: float, percent: int) -> DataFrame:
    """The links (a, b) between members of one bucket that are in different components so far.

    Members of a bucket's largest component stand on one side, all others on both.  Sides are cut into blocks by hash, and
    a task holds two blocks against each other, so that no pair is ever a row: it compares sketches first, to tell which
    members need their full sets, and then those.  Nodes that share several buckets are compared in the first band.
    """
    weight = F.lit(1 / BLOCK) + F.col("n_shingles") / BLOCK_SHINGLES
    rooted = _members(buckets, roots).select("key", "band", "node", "root", weight.alias("w"))
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    # the bucket's size in members and blocks, its number of components, and the root and blocks of the largest
    whole = parts.groupBy("key").agg(F.sum("n").alias("m"), F.sum("w").alias("all"), F.count(F.lit(1)).alias("k"), F.max(F.struct("n", (-F.col("root")).alias("minus"), "w")).alias("most"))
    largest = whole.where(F.col("k") > 1).select("key", "m", "all", (-F.col("most.minus")).alias("main"), F.greatest(F.col("all") - F.col("most.w"), F.lit(0.0)).alias("few"))
    # a pair is all of a bucket of two, and every pair of such a bucket met its pivot
    mixed = saved(rooted.join(largest.where(F.col("m") > 2), "key").select("key", "band", "node", "root", "main", "all", "few"), "mixed")
    wide = F.ceil("all").cast("int")
    slim = F.greatest(F.lit(1), F.ceil("few").cast("int"))
    right = mixed.withColumn("j", F.pmod(F.xxhash64("node"), wide).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), slim - 1)))
    left = mixed.where(F.col("root") != F.col("main")).withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), slim).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), wide - 1)))
    cols = ["key", "band", "i", "j", "node", "root"]
    sides = right.select(*cols, F.lit(True).alias("right")).unionByName(left.select(*cols, F.lit(False).alias("right")))
    drawn = restrict(nodes.select("node", "sketch"), mixed.select("node").distinct(), "node")

    def near(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """A row of the left side, and the rows of the right side whose sketches come near it."""
        drawn = np.frombuffer(b"".join(pdf["sketch"]), dtype="<u4").reshape(-1, SIZE)
        right, root, band = pdf["right"].to_numpy(), pdf["root"].to_numpy(), int(pdf["band"].iloc[0])
        across = np.flatnonzero(right)
        for k in np.flatnonzero(~right).tolist():
            same = drawn[across] == drawn[k]
            earlier = same[:, : band * ROWS].reshape(len(across), band, ROWS).all(axis=2).any(axis=1)
            yield k, across[(same.mean(axis=1) >= least) & ~earlier & (root[across] != root[k])]

    def needed(pdf: pd.DataFrame) -> pd.DataFrame:
        use = np.zeros(len(pdf), dtype=bool)
        for k, found in near(pdf):
            use[found] = True
            use[k] |= len(found) > 0
        return pdf.loc[use, [*cols, "right", "sketch"]]

    def judged(pdf: pd.DataFrame) -> pd.DataFrame:
        sets, node = [x.view(np.uint64) for x in pdf["members"]], pdf["node"].to_numpy()
        a, b = [], []
        for k, found in near(pdf):
            if len(found):
                hit = node[found[linked(sets[k], [sets[x] for x in found], percent)]]
                a.append(np.maximum(hit, node[k]))
                b.append(np.minimum(hit, node[k]))
        empty = np.empty(0, dtype=np.int64)
        return pd.DataFrame({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})

    block = ["key", "i", "j"]
    use = saved(sides.join(drawn, "node").groupBy(*block).applyInPandas(needed, "key long, band int, i int, j int, node long, root long, right boolean, sketch binary"), "needed")
    full = _sets(use.select("node").distinct(), nodes, docs)
    return use.join(full, "node").groupBy(*block).applyInPandas(judged, "a long, b long").distinct()


def _as_links(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def near_duplicates(docs: DataFrame, *, percent: int = 75) -> DataFrame:
    """doc_id, text_hash, group, n_shingles, component_id and kept of each row of ``docs`` (columns doc_id and text).

    Links join documents with 100 * intersection >= percent * union of their sets; component_id is the smallest doc_id
    that links reach, and group tells components apart that share one (as ids may repeat).  A document without words
    (null and empty texts too) links with nothing.  Rows of one doc_id are documents of their own, and so are rows without
    one.  A null doc_id counts only where its component has no other; kept is true where doc_id equals component_id, both
    null included.  An empty table gives no rows.
    """
    least = percent / 100 - 4.2 * (percent / 100 * (1 - percent / 100) / SIZE) ** 0.5
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"))
    rows = saved(sketches(docs), "sketches")
    whole = rows.where(F.col("sig").isNotNull())
    grouped = whole.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes = saved(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])
    keys = nodes.select("node", "n_shingles", F.posexplode(bands).alias("band", "key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key")
    members = keys.join(shared, "key").groupBy("node", "n_shingles").agg(F.collect_list(F.struct("key", "band")).alias("at"))  # no more than BANDS
    buckets = saved(members, "buckets")

    links = roots = None
    for turn in range(2):
        pairs = saved(_plausible(_against_pivots(buckets, roots, turn), nodes, least), "pairs")
        found = _verified(pairs, nodes, docs, percent)
        links = found if roots is None else _as_links(roots).unionByName(found)
        roots = saved(components(links), "roots")
    found = saved(_all_others(buckets, roots, nodes, docs, least, percent), "found")
    if not found.isEmpty():
        roots = saved(components(_as_links(roots).unionByName(found)), "roots")

    rooted = nodes.join(roots, "node", "left").select("sig", "doc_id", F.coalesce("root", "node").alias("group"))
    ids = rooted.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(ids, "group").select("sig", "group", "component_id")
    out = rows.select("doc_id", "text_hash", "n_shingles", "sig").join(named, "sig", "left")
    own = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "text_hash", "group", "n_shingles", own.alias("component_id")).withColumn("kept", kept)
