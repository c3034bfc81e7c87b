"""Cost-balanced packing of documents into training sequences of a fixed token capacity.

A document is cut into whole sequences and a rest.  Rests are dealt by hash into groups of bounded size; in each group
they go, longest first, to the sequence of lowest estimated cost that has room.  The cost of a piece has a linear part
and a quadratic part for attention.  Rests that fit nowhere whole fill the gaps in pieces, so only one sequence of a
group stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.llm import tokens
from telespark.llm.common import blocks, saved, small_batches, take_over

#: Of how many units of text a worker keeps the ids: fewer than for token tables, as it also holds pieces.
KEPT = 150_000
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Places pieces of the given lengths: (piece, cut start, cut length, sequence, offset), in no particular order.

    Each length is from 1 to capacity.  Ties go to the piece and the sequence that come first.
    """
    n = -(-int(lengths.sum()) // capacity)
    room, cost = np.full(n, capacity, dtype=np.int64), np.zeros(n)
    out, left = [], []

    def put(piece: int, start: int, length: int, to: int) -> None:
        out.append((piece, start, length, to, int(capacity - room[to])))
        room[to] -= length
        cost[to] += linear * length + quadratic * length * length

    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        open_cost = np.where(room >= length, cost, np.inf)
        to = int(open_cost.argmin())
        if open_cost[to] < np.inf:
            put(piece, 0, length, to)
        else:
            left.append(piece)
    gaps = iter(sorted(np.flatnonzero(room).tolist(), key=lambda k: (-room[k], k)))
    to = next(gaps, -1)
    for piece in left:
        start = 0
        while start < lengths[piece]:
            if room[to] == 0:
                to = next(gaps)
            length = int(min(room[to], lengths[piece] - start))
            put(piece, start, length, to)
            start += length
    return out


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 1, capacity: int = 2048, group_rows: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048, added_tokens: bool = False, kept: int = KEPT) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 16 bits).

    Needs columns doc_id and text.  A document's ids are its text's and ``end_id``, which is all that a null or empty text
    has; equal doc_ids stay apart, as each row is a document.  Every id lies in exactly one piece, and the pieces of a
    sequence leave no gap.  A vocabulary whose ids don't fit in 16 bits is an error.  ``kept``: of how many units of text a
    worker keeps the ids.

    The packed pieces are saved: a task that packed them and passed them on to a caller's Python step would hold two
    workers at once, and an executor keeps as many workers as its tasks ever held.
    """
    end = np.array([end_id], dtype="<u2").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.check_ids(tokenizer, 16, kept)
        for b in batches:
            names = b.column("doc_id")
            for at, texts in blocks(b.column("text")):
                rows: list[tuple[int, int, int, bytes]] = []
                for k, ids in enumerate(tokens.encode(texts, tokenizer, added_tokens=added_tokens, kept=kept)):
                    short = np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes() + end
                    n = len(short) // 2
                    rows += [(at + k, s, n, short[2 * s : 2 * (s + capacity)]) for s in range(0, n, capacity)]
                place, start, total, ids = zip(*rows)
                size = [len(x) // 2 for x in ids]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(place)), *map(pa.array, (start, size, total, ids))], ["doc_id", "start", "length", "doc_tokens", "ids"])

    given = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = given.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")
    pieces = saved(made.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == capacity).select("doc_id", "start", "length", "doc_tokens", (F.col("rid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_rows))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        take_over("packing", lambda: None)
        pdf = pdf.sort_values("rid")
        ids = pdf["ids"].to_list()
        rows = assign(pdf["length"].to_numpy(), capacity, linear, quadratic)
        piece, start, length, to, offset = (np.array(x, dtype=np.int64) for x in zip(*rows))
        out = pdf[["doc_id", "doc_tokens"]].iloc[piece].reset_index(drop=True)
        out["start"] = pdf["start"].to_numpy()[piece] + start
        out["length"], out["offset"] = length, offset
        out["sequence_id"] = ((pdf["g"].iloc[0] << 24) + to) * 2 + 1
        out["ids"] = [ids[p][2 * s : 2 * (s + n)] for p, s, n in zip(piece.tolist(), start.tolist(), length.tolist())]
        return out[["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]]

    dealt = rest.withColumn("g", F.pmod(F.xxhash64("rid"), F.lit(groups)))
    return whole.unionByName(saved(dealt.groupBy("g").applyInPandas(packed, _PIECES), "packed"))


def digest(pieces: DataFrame) -> DataFrame:
    """Replaces ids by ids_crc32, the checksum of the ids as little-endian unsigned 32-bit integers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            ids = b.column("ids").to_pylist()
            wide = memoryview(np.frombuffer(b"".join(ids), dtype="<u2").astype("<u4")).cast("B")
            ends = np.cumsum([2 * len(x) for x in ids], dtype=np.int64).tolist()
            crcs = pa.array([tokens.crc(wide[i:j]) for i, j in zip([0, *ends], ends)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in before), crcs, *(b.column(c) for c in behind)], [*before, "ids_crc32", *behind])

    before, behind = ("doc_id", "start", "length"), ("doc_tokens", "sequence_id", "offset")
    return small_batches(pieces).mapInArrow(summed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
