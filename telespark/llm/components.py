"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node that it reaches) of every node in links (a, b); loops and repeats do no harm.

    A step moves links towards the smallest neighbours and drops repeats; the links of all nodes of a component end at
    its smallest node after a number of steps that grows with the logarithm of the component's size.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = saved(links.where(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct(), "links")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, "links")
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = saved(small.unionByName(root.select("a", F.col("m").alias("b"))).distinct(), "links")
        mark, before = _mark(now), mark
        if mark == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(links: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 24)), F.bit_xor(h)).first())
