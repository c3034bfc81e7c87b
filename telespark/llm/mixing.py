"""Mixing sources to target weights by weighted sampling without replacement, after whole epochs.

Every document draws the key -ln(u) / w with u uniform and w its quality weight; the smallest keys of a source are a
weighted sample of it.  A source takes whole epochs while its target allows and then documents in key order up to the
rest of its budget.  The order is found in two steps, so that no source has to be sorted in one task: sizes are summed
by source and key bucket, and only the bucket in which a budget ends is sorted and prefix-summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm.common import WORD, hash_fraction, saved, sided

BUCKETS = 1 << 14


def words(text: str) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size and target from one row (source, source_size) for each source.

    Sources in code point order, null last, have the weights in turn.  Targets share the sum of all sizes by weight; one
    that comes to more than ``most`` times its source's size stops there, and the excess is shared by weight among the
    others, until none is above.  Closed form: sources are capped in order of size / weight, and the first k of them are
    capped for the smallest k that leaves the next one under its cap.
    """
    everything = Window.partitionBy(F.lit(0))
    named = sizes.withColumn("_pos", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    named = named.withColumn("_w", w).withColumn("_ratio", F.col("source_size") / F.col("_w"))
    order = everything.orderBy("_ratio", "_pos")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    # level: what a unit of weight gets if exactly the sources before this one are capped
    level = (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / F.sum("_w").over(after)
    ranked = named.withColumn("_level", level).withColumn("_free", (F.col("_level") <= most * F.col("_ratio")) & (F.col("_ratio") > 0))
    cut = ranked.withColumn("_at", F.min(F.when(F.col("_free"), F.struct("_ratio", "_pos", "_level"))).over(everything))
    capped = F.col("_at").isNull() | (F.struct("_ratio", "_pos") < F.struct(F.col("_at._ratio"), F.col("_at._pos")))
    target = F.when(capped, most * F.col("source_size")).otherwise(F.col("_at._level") * F.col("_w"))
    return cut.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 1) -> DataFrame:
    """Adds source_size, target, taken and copies to rows with columns doc_id, source, size, quality and tie.

    size: words of the row, not negative.  quality: a positive weight, null for 1.  tie: anything that tells rows of one
    doc_id apart.  Other columns pass through.

    taken: words that the mix takes from the row, repeats counted: size times the source's whole epochs, and size again
    for the rows that its last, partial epoch selects; the row at which the budget ends gives the words that are left.
    copies: the number of whole texts nearest to taken.  Rows without words give nothing.  Equal rows draw equal keys and
    follow each other and are summed up first; reruns agree.  A null source is a source of its own, after all others.
    """
    u = hash_fraction("doc_id", "tie", seed=seed)
    key = -F.log(u) / F.greatest(F.coalesce(F.col("quality"), F.lit(1.0)), F.lit(1e-6))
    # 1 - exp(-key) rises with key and is spread over [0, 1)
    bucket = F.least(F.floor((F.lit(1.0) - F.exp(-key)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    keyed = saved(docs.withColumns({"_mix_key": key, "_mix_bucket": bucket}), "mix")

    tally = keyed.groupBy("source", F.col("_mix_bucket").alias("bucket")).agg(F.sum("size").alias("n"))
    plan = targets(tally.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    plan = plan.withColumn("_mix_epochs", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("_mix_epochs") * F.col("source_size")).cast("long"))
    plan = plan.withColumnRenamed("source", "_mix_source")
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    steps = tally.withColumn("upto", F.sum("n").over(upto)).join(plan, F.col("source").eqNullSafe(F.col("_mix_source")))
    # one row a source: the bucket in which the budget ends, and what of the budget is left at its start
    ends = (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest"))
    edge = F.max(F.when(ends, F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))))
    budget = steps.groupBy("_mix_source", "source_size", "target", "_mix_epochs").agg(edge.alias("_mix_edge"))

    found = keyed.join(sided(budget, 100_000), F.col("source").eqNullSafe(F.col("_mix_source")))
    at_edge = F.coalesce(F.col("_mix_bucket") == F.col("_mix_edge.bucket"), F.lit(False))
    before = F.coalesce(F.col("_mix_bucket") < F.col("_mix_edge.bucket"), F.lit(True))
    # equal rows follow each other: they are one row of the prefix sum, and the n-th of them starts n sizes later
    alike = found.where(at_edge).groupBy(*found.columns).agg(F.count(F.lit(1)).alias("_mix_n"))
    together = F.col("size") * F.col("_mix_n")
    inside = Window.partitionBy("source").orderBy("_mix_key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    first = alike.withColumn("_mix_left", F.col("_mix_edge.left") - (F.sum(together).over(inside) - together))
    each = first.withColumn("_mix_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_n") - 1)))
    cut = each.withColumn("_mix_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_mix_left") - F.col("_mix_nth") * F.col("size")))).drop("_mix_n", "_mix_left", "_mix_nth")
    rest = found.where(~at_edge).withColumn("_mix_part", F.when(before & (F.col("target") > 0), F.col("size")).otherwise(F.lit(0)))
    taken = (F.col("size") * F.col("_mix_epochs") + F.col("_mix_part")).cast("long")
    out = cut.unionByName(rest).withColumn("taken", taken)
    copies = F.coalesce(F.round(F.col("taken") / F.nullif("size", F.lit(0))), F.lit(0)).cast("int")
    return out.withColumn("copies", copies).drop("_mix_key", "_mix_bucket", "_mix_source", "_mix_epochs", "_mix_edge", "_mix_part")
