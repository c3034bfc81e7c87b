"""Quality score: logistic regression over hashed word n-grams, scored as a sparse dot product."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.llm import linear
from telespark.llm.common import bounded_sample, small_batches, take_over

_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Tokens whose hashes a worker keeps; past this number the memory is emptied.
_KEPT = 200_000
_hashes: dict[str, tuple[int, int]] = {}


def _shape(token: str) -> str:
    if not token[0].isalpha():
        return "9" if token[0].isdigit() else token[:4]
    case = "X" if len(token) > 1 and token.isupper() else "x" if token.islower() else "Xx"
    return f"{case}{min(3, len(token) // 6)}"


def _hash(token: str) -> tuple[int, int]:
    if len(_hashes) >= _KEPT:
        _hashes.clear()
    h = _hashes[token] = (xxhash.xxh3_64_intdigest(token.lower()), xxhash.xxh3_64_intdigest(_shape(token), 7))
    return h


def _mixed(*hashes: np.ndarray, salt: int) -> np.ndarray:
    out = np.full(len(hashes[0]), salt, dtype=np.uint64)
    for h in hashes:
        out = (out ^ h) * _MIX
        out ^= out >> np.uint64(29)
    return out


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features and their values: log counts of word 1- and 2-grams, of 1- to 3-grams of word shapes and
    of immediate repeats, scaled to length 1; the bias has value 1 and is all that an empty text has."""
    take_over("quality", _hashes.clear)
    known = _hashes.get
    pairs = [known(t) or _hash(t) for t in _TOKENS(text)] if text else []
    if not pairs:
        return np.array([linear.BIAS]), np.array([1.0])
    word, shape = np.array(pairs, dtype=np.uint64).T
    same = word[1:] == word[:-1]
    found = np.concatenate(
        [
            _mixed(word, salt=1),
            _mixed(word[:-1], word[1:], salt=2),
            _mixed(shape, salt=3),
            _mixed(shape[:-1], shape[1:], salt=4),
            _mixed(shape[:-2], shape[1:-1], shape[2:], salt=5),
            _mixed(shape[1:][same], salt=6),
        ]
    )
    idx, n = np.unique((found & np.uint64((1 << bits) - 1)).astype(np.int64), return_counts=True)
    val = np.log1p(n)
    val /= np.sqrt(val @ val)
    keep = idx != linear.BIAS
    return np.append(idx[keep], linear.BIAS), np.append(val[keep] * 4.0, 1.0)


def fit(train: DataFrame, label: str, *, most_rows: int = 5000, params: linear.Ftrl | None = None) -> np.ndarray:
    """Learns from columns doc_id, text and ``label`` (0 or 1; rows with another value or none teach nothing).

    Reads at most about ``most_rows`` rows of each label, chosen by a hash of id and text.
    """
    p = params or linear.Ftrl()
    y = F.col(label).cast("int")
    rows = bounded_sample(small_batches(train).where(y.isin(0, 1)), y, most_rows, "doc_id", "text")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [features(t, p.bits) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "label": pdf["label"], "idx": [i.astype(np.int32) for i, _ in found], "val": [v.astype(np.float32) for _, v in found]})

    given = rows.select(F.xxhash64("doc_id", "text").alias("key"), y.alias("label"), "text")
    return linear.fit(given.mapInPandas(made, "key long, label int, idx array<int>, val array<float>"), p)


def score(docs: DataFrame, weights: np.ndarray, *, out: str = "score") -> DataFrame:
    """Adds the probability of label 1 to rows with a column text; null and empty texts get that of the bias alone."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(weights)
    bits = int(len(weights)).bit_length() - 1

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for texts in batches:
            yield pd.Series([linear.logistic(w[i] @ v) for i, v in (features(t, bits) for t in texts)], dtype="float64")

    return docs.withColumn(out, F.pandas_udf(scored, "double")(F.col("text")))
