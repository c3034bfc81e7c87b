"""Logistic regression over hashed sparse features, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Index of the feature that every row has.
BIAS = 0


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the learner.  ``shards`` models learn side by side and are averaged, so no task sees the whole sample."""

    bits: int = 18
    alpha: float = 0.2
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    epochs: int = 4
    shards: int = 4

    @property
    def dim(self) -> int:
        return 1 << self.bits


def train_shard(rows: list[tuple[int, np.ndarray, np.ndarray]], p: Ftrl) -> np.ndarray:
    """One pass after another over (label, indices, values); indices of a row are distinct."""
    z, n, w_all = np.zeros(p.dim), np.zeros(p.dim), np.zeros(p.dim)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - p.l1, 0)
        return -shrunk / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)

    for epoch in range(p.epochs):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for k in order:
            y, i, x = rows[k]
            w = weights(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            g2 = g * g
            z[i] += g - (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / p.alpha * w
            n[i] += g2
    w_all[:] = weights(slice(None))
    return w_all


def fit(examples: DataFrame, p: Ftrl) -> np.ndarray:
    """Weights from columns key (long), label (0 or 1), idx array<int> and val array<float>; zeros without rows.

    The result depends on the set of rows alone: shards are dealt by the hash of key and sorted by it before training.
    """

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "label"], kind="stable")
        rows = list(zip(pdf["label"].astype(int).tolist(), pdf["idx"], pdf["val"]))  # as they came, without a wider copy
        w = train_shard(rows, p)
        at = np.flatnonzero(w)
        return pd.DataFrame({"i": np.append(at, -1), "w": np.append(w[at], 1.0)})  # index -1 counts the shards

    dealt = examples.withColumn("_shard", F.pmod(F.xxhash64("key"), F.lit(p.shards)))
    parts = dealt.groupBy("_shard").applyInPandas(learn, "i long, w double").toPandas().sort_values(["i", "w"])
    i, w = parts["i"].to_numpy(dtype=np.int64), parts["w"].to_numpy(dtype=np.float64)
    out = np.zeros(p.dim)
    np.add.at(out, i[i >= 0], w[i >= 0])
    return out / max(1, int((i < 0).sum()))


def logistic(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, x)))))
