"""The prefix trie of conversations, built by van Emde Boas recursion.

A trie over sequences of up to 2^L turns is cut at half its depth.  The prefixes that end at the cut are named; the upper
trie holds each of them once, however many sequences share it, and below each name hangs a lower forest of the rests.
Both halves are built in the same way, all of a level in the same job, until after L levels every segment is one turn deep
and its distinct rows are the nodes.  Totals then go upward: the sum of a lower forest is grafted onto the name at whose
cut it hangs, and from there onto everything above it in the upper trie, level by level.

A prefix's name is 128 bits: the exclusive or of two hashes of each of its turns with their places.  That needs no order
and is summed up before it is shuffled, so neither a long conversation nor a prefix that most conversations share goes
through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm.common import numbered, saved
from telespark.llm.mixing import words

NAME, ROOT = ["x1", "x2"], ["r1", "r2"]
_VALUES = ["n_leaves", "saved_tokens"]
#: SHA-256 of the empty string.
NO_ENDS = hashlib.sha256(b"").hexdigest()


def head_turns(conv_id: str = "conv_id") -> Column:
    """How many of its first turns a conversation takes from another one."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % 4).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), c1 and c2 (hashes of role and text) and w (words of the text) of each turn.

    Turns go by turn, nulls first, then by role and text; a null role or text is empty.  Rows without a conv_id are left
    out.
    """
    told = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashes = [F.xxhash64(F.lit(salt), "role", "text").alias(c) for c, salt in (("c1", 1), ("c2", 2))]
    return numbered(told, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "text"], ["conv_id", *hashes, words("text").alias("w")], "pos")


def rebuilt(own: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """From ``turns``: the rebuilt conversations' turns (conv_id, pos, x1, x2, w) and all conv_ids.

    Conversation c starts with the first ``head_turns`` turns of conversation c - c % every, as many as that has, and goes
    on with its own turns after its first ``head_turns``.
    """
    ids = own.groupBy("conv_id").agg(F.lit(1).alias("_")).select("conv_id").withColumn("h", head_turns())
    heads = own.where(F.col("pos") <= 3).withColumnRenamed("conv_id", "base")
    heads = ids.where("h > 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base").where(F.col("pos") <= F.col("h"))
    heads = saved(heads.select("conv_id", "pos", "c1", "c2", "w"), "heads")
    had = heads.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_head"))
    h = head_turns()
    rest = own.where(F.col("pos") > h).join(had, "conv_id", "left")
    rest = rest.withColumn("pos", F.col("pos") - h + F.coalesce("n_head", F.lit(0))).drop("n_head")
    names = [F.xxhash64(F.lit(salt), F.col("pos").cast("long"), "c1", "c2").alias(x) for x, salt in zip(NAME, (3, 4))]
    return saved(heads.unionByName(rest.select(heads.columns)).select("conv_id", F.col("pos").cast("long").alias("pos"), *names, "w"), "rebuilt"), ids.select("conv_id")


def _xor(of: str, when: Column | None = None) -> Column:
    return F.coalesce(F.bit_xor(F.col(of) if when is None else F.when(when, F.col(of))), F.lit(0).cast("long"))


def _cut(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Cuts segments of ``size`` turns in half.

    rows: g (segment), s (a conversation for each distinct sequence of the segment), pos, x1, x2 (the turn), w, n (how many
    conversations have the sequence), r1, r2 (name of the prefix before the segment).  Returns the rows of the halves, and
    of each sequence the names at its end (e1, e2) and at the cut (p1, p2).
    """
    upper = (F.col("pos") - 1) % size < size // 2
    folded = rows.groupBy("g", "s").agg(
        *(_xor(x, upper).alias(f"p{k}") for k, x in enumerate(NAME, 1)), *(_xor(x).alias(f"e{k}") for k, x in enumerate(NAME, 1)), F.max("n").alias("n"), *(F.max(r).alias(r) for r in ROOT)
    )
    names = [F.col(f"{of}{k}").bitwiseXOR(F.col(f"r{k}")).alias(f"{of}{k}") for of in "pe" for k in (1, 2)]
    named = saved(folded.select("g", "s", "n", *names), "named")
    shared = named.groupBy("g", "p1", "p2").agg(F.min("s").alias("s"), F.sum("n").alias("n_upper")).select("g", "s", "n_upper")
    marks = named.select("g", "s", "p1", "p2").join(shared, ["g", "s"], "left")
    met = rows.join(marks, ["g", "s"]).where(~upper | F.col("n_upper").isNotNull())
    halves = met.select(
        (F.col("g") * 2 + F.when(upper, 0).otherwise(1)).alias("g"), "s", "pos", *NAME, "w", F.when(upper, F.col("n_upper")).otherwise(F.col("n")).alias("n"),
        *(F.when(upper, F.col(f"r{k}")).otherwise(F.col(f"p{k}")).alias(f"r{k}") for k in (1, 2)),
    )
    return saved(halves, "halves"), named


def _grafted(nodes: DataFrame, named: list[DataFrame], levels: int) -> DataFrame:
    """What hangs below each name at which a segment of the last level ends: x1, x2 and the sums of the nodes' values."""
    # a node is in a lower forest at the levels at which its place has a one bit
    spots = [F.when(F.shiftright(F.col("depth") - 1, levels - 1 - k) % 2 == 1, F.struct(F.lit(k).alias("level"), F.shiftright(F.col("depth") - 1, levels - k).alias("g"))) for k in range(levels)]
    held = nodes.where(" + ".join(_VALUES) + " > 0").select("s", *_VALUES, F.explode(F.array_compact(F.array(*spots))).alias("spot")).select("s", "spot.*", *_VALUES)
    cuts = None
    for k, m in enumerate(named):
        part = m.select(F.lit(k).alias("level"), "g", "s", "p1", "p2")
        cuts = part if cuts is None else cuts.unionByName(part)
    sums = [F.sum(v).alias(v) for v in _VALUES]
    lower = saved(held.join(cuts, ["level", "g", "s"]).groupBy("level", F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(*sums), "lower")
    below = lower.where("level = 0").drop("level")
    for k in range(1, levels):
        # what hangs below the end of a sequence hangs below its cut too
        above = below.join(named[k].select(F.col("e1").alias("x1"), F.col("e2").alias("x2"), "p1", "p2"), NAME)
        above = above.select(F.col("p1").alias("x1"), F.col("p2").alias("x2"), *_VALUES)
        grafts = lower.where(F.col("level") == k).drop("level")
        below = saved(below.unionByName(above).unionByName(grafts).groupBy(*NAME).agg(*sums), "below")
    return below


def _ends(whole: DataFrame, piece: int = 12) -> DataFrame:
    """x1, x2 and ends_sha256 of the sequences that conversations have: the hash is fed in order, in pieces of bounded
    length, so a group of any size takes constant memory."""
    parts = whole.groupBy(*NAME, F.shiftright("conv_id", piece).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, hashlib.sha256()
        out: list[tuple] = []
        for b in batches:
            for x1, x2, ids in zip(*(b.column(c).to_pylist() for c in (*NAME, "ids"))):
                if (x1, x2) == key:
                    h.update(f",{ids}".encode())
                    continue
                if key is not None:
                    out.append((*key, h.hexdigest()))
                key, h = (x1, x2), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict(dict(zip((*NAME, "ends_sha256"), zip(*out))) if out else {c: [] for c in (*NAME, "ends_sha256")}, schema=_ENDS)
            out = []
        if key is not None:
            yield pa.RecordBatch.from_pydict(dict(zip((*NAME, "ends_sha256"), ([key[0]], [key[1]], [h.hexdigest()]))), schema=_ENDS)

    return parts.repartition(*NAME).sortWithinPartitions(*NAME, "part").mapInArrow(digest, "x1 long, x2 long, ends_sha256 string")


_ENDS = pa.schema([("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])


def trie(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations of ``ids`` (conv_id), whose turns are ``rows`` as ``rebuilt`` has them.

    conv_id: the smallest one that starts with the node's turns; depth; parent_conv_id: the parent's conv_id, null for the
    root; n_convs; n_children; n_leaves: childless nodes of the subtree, top included; saved_tokens: the subtree's sum of
    (n_convs - 1) * words of the last turn; ends_sha256: of the conversations that end at the node, as decimals in
    ascending order with commas.  The root, of depth 0, holds conversations without turns too; no conversations, no nodes.
    """
    sums = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"), *(_xor(x).alias(x) for x in NAME))
    whole = saved(ids.join(sums, "conv_id", "left").na.fill(0, ["len", *NAME]), "whole")
    all_ = whole.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.max("len").alias("deepest")).first()
    levels = max(0, (all_["deepest"] or 0) - 1).bit_length()
    distinct = whole.where("len > 0").groupBy("len", *NAME).agg(F.min("conv_id").alias("s"), F.count(F.lit(1)).alias("n")).select("s", "n")
    nil = F.lit(0).cast("long")
    seqs = rows.withColumnRenamed("conv_id", "s").join(distinct, "s").select(nil.alias("g"), "s", "pos", *NAME, "w", "n", *(nil.alias(r) for r in ROOT))
    named: list[DataFrame] = []
    for k in range(levels):
        seqs, names = _cut(seqs, 1 << (levels - k))
        named.append(names)
    ends = [F.col(x).bitwiseXOR(F.col(r)).alias(x) for x, r in zip(NAME, ROOT)]
    found = seqs.select("s", F.col("pos").alias("depth"), F.col("n").alias("n_convs"), "w", *ROOT, *ends)
    children = found.groupBy(F.col("r1").alias("x1"), F.col("r2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    found = found.join(children, NAME, "left").withColumn("n_children", F.coalesce("n_children", nil))
    nodes = saved(found.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("w")}), "nodes")
    if levels:
        below = _grafted(nodes, named, levels).select(*NAME, *(F.col(v).alias(f"_{v}") for v in _VALUES))
        nodes = saved(nodes.join(below, NAME, "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", nil) for v in _VALUES}).drop(*(f"_{v}" for v in _VALUES)), "totals")
    tops = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), *(F.coalesce(F.sum(v), nil).alias(v) for v in _VALUES))
    root = tops.where(F.lit(all_["n"] > 0)).select(
        F.lit(all_["conv_id"]).cast("long").alias("conv_id"), nil.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(all_["n"]).cast("long").alias("n_convs"),
        "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens", *(nil.alias(x) for x in NAME),
    )
    parents = nodes.select(F.col("x1").alias("r1"), F.col("x2").alias("r2"), F.col("s").alias("parent_conv_id"))
    first = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(all_["conv_id"]).cast("long"))
    inner = nodes.where("depth > 1").join(parents, ROOT).select(first.columns).unionByName(first).withColumnRenamed("s", "conv_id")
    out = inner.select(root.columns).unionByName(root).join(_ends(whole), NAME, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
