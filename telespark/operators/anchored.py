"""Anchored windows: a key's first row opens a window of fixed length, and the first row past its end opens the next.

Where a window starts depends on the one before, yet no key has to stay in one task.  Rows are dealt by ranges of key and
time, so a key of many rows is cut into pieces that follow each other.  All that a piece needs to know of those before it is
``due``: the time from which on the next row opens a window.  Each piece that holds nothing but one key gives the function
from due at its entry to due at its exit, as the steps of a table; only times within one window's length of its start can
matter.  Composing these functions over a key's pieces gives each piece its own due, and then all pieces are folded at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.shared import shared_dir

#: Names of helper columns, which a caller's tables won't have.
_TIME, _WINDOW, _PIECE, _KEY = "_anchored_time_us", "_anchored_window_us", "_anchored_piece", "_anchored_key"
_PIECES = f"{_KEY} string, piece int, place int, whole boolean, due long, upto array<long>, leaves array<long>"


def starts(times: np.ndarray, length: int, open_at: int | None) -> np.ndarray:
    """Window start of each of one key's sorted times; ``open_at`` is the window open before them, if any."""
    out = np.empty_like(times)
    at = 0
    if open_at is not None:
        at = int(np.searchsorted(times, open_at + length, side="left"))
        out[:at] = open_at
    while at < len(times):
        end = int(np.searchsorted(times, times[at] + length, side="left"))
        out[at:end] = times[at]
        at = end
    return out


def exits(times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The function of a piece of one key's sorted times, as steps (upto, leaves): due at entry, which is at most the first
    time plus ``length``, is looked up as the first upto that isn't below it; beyond the last one it leaves as it came."""
    t = np.unique(times)
    following = np.searchsorted(t, t + length, side="left")
    last = np.where(following < len(t), following, np.arange(len(t)))
    while True:  # the last window of the chain from each time, by doubling
        further = last[last]
        if (further == last).all():
            break
        last = further
    first = min(len(t), int(np.searchsorted(t, t[0] + length, side="left")) + 1)
    upto, leaves = t[:first], t[last[:first]] + length
    step = np.append(leaves[1:] != leaves[:-1], True)
    return upto[step], leaves[step]


def _edges(keys: pa.Array) -> np.ndarray:
    """Where runs of equal keys begin, and the number of keys."""
    changed = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [len(keys)]])


def _summaries(length: int):
    """Of each piece: of its first key whether it fills the piece, and if so its function; of its last key due at the end."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = first = last = due = None
        whole, held = True, []
        for b in batches:
            if not len(b):
                continue
            keys, times = b.column(_KEY), b.column(_TIME).to_numpy()
            edges = _edges(keys)
            start, end = keys[0].as_py(), keys[len(keys) - 1].as_py()
            if piece is None:
                piece, first, last = b.column(_PIECE)[0].as_py(), start, start
            if start != last or len(edges) > 2:
                whole, held = False, []
            if end != last or len(edges) > 2:
                last, due = end, None
            tail = times[edges[-2] :]
            due = int(starts(tail, length, None if due is None else due - length)[-1]) + length
            if whole:
                held.append(tail)
        out = []
        if piece is not None:
            steps = [x.tolist() for x in exits(np.concatenate(held), length)] if whole else [[], []]
            out.append({_KEY: first, "piece": piece, "place": 0, "whole": whole, "due": due if whole else None, "upto": steps[0], "leaves": steps[1]})
            if not whole:
                out.append({_KEY: last, "piece": piece, "place": 1, "whole": False, "due": due, "upto": [], "leaves": []})
        yield pa.RecordBatch.from_pylist(out, schema=_SUMMARY)

    return summed


_SUMMARY = pa.schema([(_KEY, pa.string()), ("piece", pa.int32()), ("place", pa.int32()), ("whole", pa.bool_()), ("due", pa.int64()), ("upto", pa.list_(pa.int64())), ("leaves", pa.list_(pa.int64()))])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through the pieces of a key in order and gives due at the entry of each that continues it."""
    key, due = object(), None
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r[_KEY] != key:
                key, due = r[_KEY], None
            if r["place"]:
                due = r["due"]  # the key begins in this piece, behind others
                continue
            if due is not None:
                out.append({"piece": r["piece"], "due": due})
            if not r["whole"]:
                due = None
            elif due is None:
                due = r["due"]
            else:
                at = int(np.searchsorted(r["upto"], due, side="left"))
                due = r["leaves"][at] if at < len(r["upto"]) else due
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("piece", pa.int32()), ("due", pa.int64())]))


def anchored(df: DataFrame, key: str, ts: str, length_us: int, *order: str, pieces: int | None = None) -> DataFrame:
    """Adds window_start, a timestamp, to the rows of ``df``.  Rows with a null time are left out; a null key is a key.

    Rows are cut into ``pieces``, as many as the session has shuffle partitions if that isn't given, and kept in a
    checkpoint, which holds them in order.  What the driver gets is a number for each piece at most.
    """
    shared_dir(df.sparkSession)
    slim = df.where(F.col(ts).isNotNull()).withColumn(_TIME, F.unix_micros(ts)).withColumn(_KEY, F.concat(F.when(F.col(key).isNull(), "n").otherwise("k"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    by = [_KEY, _TIME, *order]
    dealt = slim.repartitionByRange(pieces, *by) if pieces else slim.repartitionByRange(*by)
    cut = dealt.sortWithinPartitions(*by).withColumn(_PIECE, F.spark_partition_id()).checkpoint()
    found = cut.select(_KEY, _TIME, _PIECE).mapInArrow(_summaries(length_us), _PIECES)
    entries = {r["piece"]: r["due"] for r in found.repartition(_KEY).sortWithinPartitions(_KEY, "piece", "place").mapInArrow(_composed, "piece int, due long").collect()}
    schema = cut.withColumn(_WINDOW, F.lit(0).cast("long")).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_at = None, None
        for b in batches:
            if not len(b):
                continue
            keys, times = b.column(_KEY), b.column(_TIME).to_numpy()
            edges = _edges(keys)
            start = keys[0].as_py()
            if last is None:
                due = entries.get(b.column(_PIECE)[0].as_py())
                open_at = None if due is None else due - length_us
            elif start != last:
                open_at = None
            # most keys' rows lie in one window, which their first row opens
            firsts, ends = times[edges[:-1]], times[edges[1:] - 1]
            out = np.repeat(firsts, np.diff(edges))
            for k in [0, *np.flatnonzero(ends[1:] - firsts[1:] >= length_us) + 1]:
                i, j = edges[k], edges[k + 1]
                out[i:j] = starts(times[i:j], length_us, open_at if k == 0 else None)
            last, open_at = keys[len(keys) - 1].as_py(), int(out[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, _WINDOW])

    return cut.mapInArrow(fold, schema).withColumn("window_start", F.timestamp_micros(_WINDOW)).drop(_TIME, _WINDOW, _PIECE, _KEY)
