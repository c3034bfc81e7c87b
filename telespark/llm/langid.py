"""Language identification by words first, then by ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.llm.common import bounded_sample, small_batches, take_over, unused

_LETTERS = re.compile(r"[^\W\d_]+").findall
UNDETERMINED = "und"


def words_of(text: str) -> list[str]:
    return _LETTERS(text.lower())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of the word between boundary marks; a shorter word is its own only gram."""
    w = f"<{word}>"
    return [w[i : i + n] for i in range(max(1, len(w) - n + 1))]


@dataclass
class LanguageModel:
    """Log frequencies of words and of character n-grams in each language, in rows of one matrix (single precision)."""

    langs: list[str]
    prior: np.ndarray
    matrix: np.ndarray
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    unseen: dict[str, int] = field(default_factory=dict)
    #: Vectors of unseen words that a worker keeps; past this number they are found anew from the next text on.
    kept: int = 200_000

    def __getstate__(self) -> dict:
        return {**self.__dict__, "unseen": {}}

    def vector(self, word: str) -> np.ndarray | None:
        """The back-off for an unseen word: mean log frequency of its known n-grams of the greatest length that has any."""
        for n in sorted(self.grams, reverse=True):
            known = [i for g in grams_of(word, n) if (i := self.grams[n].get(g)) is not None]
            if known:
                return np.add.reduce(self.matrix.take(known, axis=0), axis=0) / len(known)
        return None

    def posterior(self, text: str) -> np.ndarray:
        if len(self.unseen) >= self.kept:
            self.unseen.clear()  # their rows of the matrix are used again
        counts = Counter(words_of(text))
        total, rows, times = self.prior.copy(), [], []
        for w, n in counts.items():
            i = self.words.get(w)
            if i is None:
                i = self.unseen.get(w)
                if i is None:
                    v = self.vector(w)
                    if v is None:
                        continue
                    i = self._keep(w, v)
            rows.append(i)
            times.append(n)
        if rows:
            total += np.asarray(times, dtype=np.float64) @ self.matrix[rows]
        p = np.exp(total - total.max())
        return p / p.sum()

    def _keep(self, word: str, v: np.ndarray) -> int:
        base = len(self.words) + sum(map(len, self.grams.values()))
        i = base + len(self.unseen)
        if i >= len(self.matrix):
            self.matrix = np.vstack([self.matrix, np.zeros((max(4096, len(self.matrix) // 2), len(self.langs)), dtype=self.matrix.dtype)])
        self.matrix[i] = v
        self.unseen[word] = i
        return i


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word (kind 0) and n-gram (kind n) counts of a partition, by language."""
    for pdf in batches:
        found: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(pdf["text"], pdf["lang"]):
            if text is not None:
                found[lang].update(words_of(text))
        rows: Counter = Counter()
        for lang, counts in found.items():
            for w, n in counts.items():
                rows[lang, 0, w] += n
                for k in range(1, MAX_GRAM + 1):
                    for g in grams_of(w, k):
                        rows[lang, k, g] += n
        yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["lang", "kind", "gram", "n"])


MAX_GRAM = 5


def fit(train: DataFrame, *, most_rows: int = 1500) -> LanguageModel:
    """Learns from columns doc_id, text and lang.

    Reads at most about ``most_rows`` rows of each language, chosen by a hash of their id and text, and keeps every word
    and n-gram that these hold.  Rows with a null text or language teach nothing; without any rows the model has no
    language.
    """
    rows = small_batches(train).select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = bounded_sample(rows, F.col("lang"), most_rows, "doc_id", "text").select("text", "lang")
    counts = (
        sample.mapInPandas(_counted, "lang string, kind int, gram string, n long")
        .groupBy("lang", "kind", "gram")
        .agg(F.sum("n").alias("n"))
    )
    # as columns, in order: what the driver holds is little more than the n-grams' letters
    top = counts.orderBy("kind", "gram", "lang").toArrow().combine_chunks()
    kind, n = top["kind"].to_numpy(), top["n"].to_numpy()
    langs = sorted(top["lang"].unique().to_pylist())
    at = {x: i for i, x in enumerate(langs)}
    lang = np.array([at[x] for x in top["lang"].to_pylist()], dtype=np.int64)
    total = np.ones((MAX_GRAM + 1, len(langs)))
    np.add.at(total, (kind, lang), n)
    total[total > 1] -= 1
    gram = top["gram"].combine_chunks()
    new = np.ones(len(top), dtype=bool)
    if len(top) > 1:
        new[1:] = (kind[1:] != kind[:-1]) | pc.not_equal(gram.slice(1), gram.slice(0, len(top) - 1)).to_numpy(zero_copy_only=False)
    row, kinds = np.cumsum(new) - 1, kind[new]
    freq = np.zeros((len(kinds), len(langs)))
    freq[row, lang] = n
    grams: dict[int, dict[str, int]] = {k: {} for k in range(MAX_GRAM + 1)}
    for i, (k, g) in enumerate(zip(kinds.tolist(), gram.filter(pa.array(new)).to_pylist())):
        grams[k][g] = i
    matrix = np.log((freq + 0.5) / (total[kinds] + 1.0)).astype(np.float32) if len(kinds) else freq
    words = grams.pop(0)
    return LanguageModel(langs, np.log(total[0] / total[0].sum()), matrix, words, grams)


def predict(docs: DataFrame, model: LanguageModel, *, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the language and its posterior, under the given names, to the rows of ``docs``, which need a column text.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text under a model without languages.
    Ties go to the language first in code point order.  Equal texts get equal results; other columns pass through.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        take_over("langid", m.unseen.clear)
        for texts in batches:
            out = []
            for text in texts:
                if not m.langs or not has_letter(text):
                    out.append((UNDETERMINED, 0.0))
                else:
                    p = m.posterior(text)
                    i = int(p.argmax())
                    out.append((m.langs[i], min(1.0, float(p[i])) if math.isfinite(p[i]) else 0.0))
            yield pd.DataFrame(out, columns=["lang", "score"])

    (both,) = unused(docs, "_told")
    found = docs.withColumn(both, F.pandas_udf(told, "lang string, score double")(F.col("text")))
    return found.withColumns({lang: F.col(f"{both}.lang"), score: F.col(f"{both}.score")}).drop(both)
