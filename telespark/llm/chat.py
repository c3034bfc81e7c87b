"""Quotation linking: which message a reply quotes, and conversations in reply order without their quotes.

Lines of one quote level that follow each other are a passage, however a mail program wrapped them.  A quoted passage is
joined by the hash of its normal form to the passages, lines and sentences that earlier messages of its conversation wrote
themselves; one that is nowhere as a whole is looked for sentence by sentence.  The links make a conversation a tree, and
each branch of it is a chat of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm.common import saved
from telespark.llm.components import components

_QUOTE = r"^[ \t]*>[ \t>]*"
#: How a line that names the author of the quote after it ends, in the languages of the corpus.
ATTRIBUTION = r"(?i)(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*$"
_SENTENCES = r"[.!?]+"


def level(line: Column) -> Column:
    """How deep a line is quoted: the number of its leading ``>`` signs, white space between them or not."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 0), "[^>]", ""))


def content(line: Column) -> Column:
    return F.regexp_replace(line, _QUOTE, "")


def normal(text: Column) -> Column:
    """Text for comparison: lower case, and single spaces for all but letters and digits."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def own_lines(text: Column) -> Column:
    """The lines of a message that are neither quoted nor name the author of a quote right after them; the rest as nulls."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    quoted = lambda x: F.coalesce(x.rlike(_QUOTE), F.lit(False))
    return F.transform(lines, lambda x, i: F.when(~quoted(x) & ~(x.rlike(ATTRIBUTION) & quoted(F.get(lines, i + 1))), x))


def numbered(messages: DataFrame) -> DataFrame:
    """Adds position, a row's place in its conversation from 1, by turn, role and text; nulls last.

    The rows are sorted in ranges, so that a long conversation spreads over tasks, and counted by range first.
    """
    order = [F.col(c).asc_nulls_last() for c in ("conv_id", "turn", "role", "_start", "text")]
    ranged = messages.select("conv_id", "turn", "role", "text").withColumn("_start", F.substring("text", 1, 64)).repartitionByRange(*order[:4]).sortWithinPartitions(*order)
    rows = saved(ranged.drop("_start").withColumn("mid", F.monotonically_increasing_id()), "messages").withColumn("_part", F.shiftright("mid", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = rows.join(base, "_part").withColumn("_rank", F.col("_base") + F.col("mid").bitwiseAND((1 << 33) - 1))
    first = placed.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_rank").alias("_first"))
    out = placed.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return out.select("mid", "conv_id", "turn", "role", "text", (F.col("_rank") - F.col("_first") + 1).alias("position"))


def passages(rows: DataFrame) -> DataFrame:
    """mid, conv_id, position, level, raw (the text of a passage) and norms (the normal forms of its lines).

    A line without a letter or digit, or that names the author of the quote after it, ends a passage.
    """
    own = F.posexplode(F.arrays_zip(F.split("text", "\n").alias("line"), own_lines(F.col("text")).alias("own"))).alias("at", "x")
    lines = rows.select("mid", "conv_id", "position", own).select("mid", "conv_id", "position", "at", level(F.col("x.line")).alias("level"), content(F.col("x.line")).alias("raw"), F.col("x.own").isNotNull().alias("own"))
    used = lines.withColumn("norm", normal(F.col("raw"))).where((F.col("norm") != "") & ((F.col("level") > 0) | F.col("own")))
    # lines of one level that follow each other have the same difference of their places among all and among those
    island = F.col("at") - F.row_number().over(Window.partitionBy("mid", "level").orderBy("at"))
    grouped = used.withColumn("island", island).groupBy("mid", "conv_id", "position", "level", "island").agg(F.array_sort(F.collect_list(F.struct("at", "raw", "norm"))).alias("x"))
    return grouped.select("mid", "conv_id", "position", "level", "island", F.array_join("x.raw", " ").alias("raw"), F.col("x.norm").alias("norms"))


def linked(messages: DataFrame) -> DataFrame:
    """One row for each message of ``messages`` (conv_id, turn, role, text), all but text of a message kept.

    mid: a number that rises with conversation and position.  position: its place in the conversation; a message never
    comes before the one it answers.  text: its own lines, outer white space trimmed; empty for a null text.  depth: the
    deepest quote level.  n_quoted: its quoted passages.  n_linked: those of which an earlier message of the conversation
    wrote the whole as a passage, line or sentence, or else all sentences; the earliest such message is the original, of
    several sentences the latest of theirs.  answers: the position of the message that it answers, which is the latest
    original of its passages of level 1, else the message before; null for the first.  Rows of a null conv_id are one
    conversation, equal rows follow each other, and other columns are left out.  Conversations have no order among each
    other, so quotes are looked for in their own.
    """
    rows = saved(numbered(messages), "numbered")
    parts = saved(passages(rows), "passages")
    sentences = F.filter(F.transform(F.split("raw", _SENTENCES), normal), lambda x: x != "")
    units = F.array_distinct(F.concat(F.array(normal(F.col("raw"))), "norms", sentences))
    said = parts.where("level = 0").select("conv_id", "position", F.explode(units).alias("unit"))
    original = said.groupBy(F.col("conv_id").alias("_conv"), F.xxhash64("unit").alias("h"), F.col("unit").alias("_unit")).agg(F.min("position").alias("origin"))
    whole = F.array(F.struct(F.lit(True).alias("whole"), normal(F.col("raw")).alias("unit")))
    pieces = F.transform(sentences, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit")))
    asked = parts.where("level > 0").select("mid", "conv_id", "position", "level", "island", F.explode(F.concat(whole, pieces)).alias("x"))
    asked = asked.select("mid", "conv_id", "position", "level", "island", "x.whole", "x.unit", F.xxhash64("x.unit").alias("_h"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_h") == F.col("h")) & (F.col("unit") == F.col("_unit"))
    hits = asked.join(original, same & (F.col("origin") < F.col("position")), "left")
    found = hits.groupBy("mid", "level", "island").agg(
        F.max(F.when(F.col("whole"), F.col("origin"))).alias("at_once"),
        F.bool_and(F.col("whole") | F.col("origin").isNotNull()).alias("all"),
        F.max(F.when(~F.col("whole"), F.col("origin"))).alias("latest"),
    )
    found = found.withColumn("origin", F.coalesce("at_once", F.when(F.col("all"), F.col("latest"))))
    quotes = found.groupBy(F.col("mid").alias("_mid")).agg(
        F.max("level").alias("depth"), F.count(F.lit(1)).alias("n_quoted"), F.count("origin").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("_origin")
    )
    own = F.array_join(F.filter(own_lines(F.col("text")), lambda x: x.isNotNull()), "\n")
    before = F.when(F.col("position") > 1, F.col("position") - 1)
    zero = F.lit(0).cast("long")
    return rows.join(quotes, F.col("mid") == F.col("_mid"), "left").select(
        "mid",
        "conv_id",
        "turn",
        "role",
        "position",
        F.coalesce("_origin", before).alias("answers"),
        F.coalesce(F.col("depth").cast("long"), zero).alias("depth"),
        F.coalesce("n_quoted", zero).alias("n_quoted"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        F.regexp_replace(own, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("text"),
    )


def branched(messages: DataFrame) -> DataFrame:
    """Adds branch to ``linked`` messages: the position of the first message of its branch.

    A message goes on with the branch of the one it answers if it is the first to answer that, and begins one otherwise.
    Only conversations in which some message doesn't answer the one before have more branches than one; their branches
    are paths, whose beginnings are found as connected components.
    """
    rows = saved(messages, "linked")
    forked = rows.where(F.col("answers") < F.col("position") - 1).select(F.col("conv_id").alias("_conv")).distinct()
    inside = rows.join(forked, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    first = inside.where(F.col("answers").isNotNull()).groupBy("conv_id", "answers").agg(F.min(F.struct("position", "mid"))["mid"].alias("b"))
    edges = first.join(inside.select(F.col("conv_id").alias("_conv"), F.col("position").alias("_position"), F.col("mid").alias("a")), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("answers") == F.col("_position")))
    edges = saved(edges.select("a", "b"), "edges")
    if edges.isEmpty():
        return rows.withColumn("branch", F.lit(1).cast("long"))
    roots = components(edges).join(rows.select(F.col("mid").alias("root"), F.col("position").alias("_branch")), "root").select(F.col("node").alias("_node"), "_branch")
    alone = inside.select(F.col("mid").alias("_inside"))
    out = rows.join(roots, F.col("mid") == F.col("_node"), "left").join(alone, F.col("mid") == F.col("_inside"), "left")
    branch = F.coalesce("_branch", F.when(F.col("_inside").isNotNull(), F.col("position")), F.lit(1))
    return out.withColumn("branch", branch.cast("long")).select(*rows.columns, "branch")


def rendered(messages: DataFrame, *, block: int = 512) -> DataFrame:
    """conv_id, branch, block, answers, n_messages, depth, n_quoted, n_linked and chat of each branch of ``branched``
    messages, in blocks of at most ``block`` places.

    chat has the messages in reply order without their quotes, each between role and end marks (role ``unknown`` for
    null).  answers: which message of another branch, or of the block before, the first one answers.
    """
    part = F.floor((F.col("position") - F.col("branch")) / block).alias("block")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
    held = messages.groupBy("conv_id", "branch", part).agg(
        F.min_by("answers", "position").alias("answers"),
        F.count(F.lit(1)).alias("n_messages"),
        F.max("depth").alias("depth"),
        F.sum("n_quoted").alias("n_quoted"),
        F.sum("n_linked").alias("n_linked"),
        F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("_m"),
    )
    return held.select("conv_id", "branch", "block", "answers", "n_messages", "depth", "n_quoted", "n_linked", F.array_join("_m.line", "\n").alias("chat"))
