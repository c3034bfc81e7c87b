"""Toxicity score of text that a noisy-channel decoder has restored.

Words written with digits or signs for letters, with stretched letters or with their letters set apart span a lattice of
readings.  A Viterbi search under a character language model picks the likeliest reading, and a linear model scores the
words as written and as restored.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import sys
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.llm import linear
from telespark.llm.common import Recent, bounded_sample, read_table, saved, shared_dir, small_batches, take_over

#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”’…¿¡"
#: What a reading may differ for: signs between letters, a sign that may stand for a letter, or a repeated character.
_ODD = re.compile(rf"[^\W\d_][\W\d_]+[^\W\d_]|[{re.escape(''.join(SIGNS))}]|(.)\1").search
_RUNS = re.compile(r"(.)\1*")
_REPEATED = re.compile(r"(.)\1+").finditer
#: Edge signs that stand for no letter: every reading leaves them out.
_NOISE = "".join(c for c in _EDGE if c not in SIGNS)
#: Pieces of whose features a worker keeps as many to twice as many.
_KEPT = 150_000
#: Bits of a character in a trigram's key, and what stands there for any character that was never met after the other two.
_BITS = 21
_ANY = (1 << _BITS) - 1
#: Trigrams of a file of the stored model, about; files and costs of which a worker keeps as many to twice as many.
_PAGE = 50_000
_PAGES = 16
_COSTS = 100_000
#: Words or trigrams that a task sums up before it passes their counts on.
_FOLD = 200_000


class CharModel:
    """Character trigrams with add-k smoothing over lower-case words."""

    def __init__(self, counts: dict[str, int], k: float = 0.05):
        """Costs of the trigrams met and, by the two characters before, of those never met."""
        tri = trigrams(counts)
        bi: Counter = Counter()
        for t, n in tri.items():
            bi[t[:2]] += n
        size = 1 + len({c for t in tri for c in t})
        self.met = {t: -math.log((n + k) / (bi[t[:2]] + k * size)) for t, n in tri.items()}
        self.new = {b: -math.log(k / (n + k * size)) for b, n in bi.items()}
        self.none = math.log(size)

    def cost(self, before: str, c: str) -> float:
        found = self.met.get(before + c)
        return self.new.get(before, self.none) if found is None else found

    def forget(self) -> None:
        """Nothing here was only remembered."""


class StoredModel(CharModel):
    """The same model as files of the shared folder, each a range of trigrams in the order of their keys.

    A worker reads a file when it first meets a trigram of its range, and keeps some files and the costs that it worked out
    lately.  So neither the driver nor a worker holds what grows with the corpus, but for the first key of each file.
    """

    def __init__(self, files: list[tuple[int, str]], size: int, k: float = 0.05):
        self.first, self.files = [f for f, _ in files], [f for _, f in files]
        self.size, self.k = size, k
        self.forget()

    def forget(self) -> None:
        self.pages = Recent(self._page, _PAGES, 10_000)
        self.costs = Recent(self._cost, _COSTS)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("pages", "costs")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def cost(self, before: str, c: str) -> float:
        return self.costs[before + c]

    def _page(self, file: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = read_table(file)
        return tuple(found.column(c).to_numpy() for c in ("key", "n", "total"))

    def _cost(self, gram: str) -> float:
        key = key_of(gram)
        for wanted in (key, key | _ANY):
            page = bisect.bisect_right(self.first, wanted) - 1
            if page >= 0:
                keys, n, total = self.pages[self.files[page]]
                at = int(np.searchsorted(keys, wanted))
                if at < len(keys) and keys[at] == wanted:
                    return -math.log((int(n[at]) + self.k) / (int(total[at]) + self.k * self.size))
        return math.log(self.size)


def key_of(gram: str) -> int:
    """The three characters of a trigram as one number."""
    a, b, c = map(ord, gram)
    return a << 2 * _BITS | b << _BITS | c


def trigrams(words: dict[str, int]) -> Counter:
    """Counts of the character trigrams of words, with two marks before each and one after it."""
    if not words:
        return Counter()
    codes = np.frombuffer("".join([f"^^{w}$" for w in words]).encode("utf-32-le"), dtype="<u4")
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 3)
    starts = np.ones(len(codes), dtype=bool)
    starts[ends - 1] = starts[ends - 2] = False  # those would reach into the next word
    at = np.flatnonzero(starts)
    met = np.zeros(sys.maxunicode + 1, dtype=bool)
    met[codes] = True
    letters = np.flatnonzero(met)
    place = np.cumsum(met)[codes] - 1
    n = len(letters)
    where = (place[at] * n + place[at + 1]) * n + place[at + 2]
    keys = None
    if n > 200:  # too many for a table of all
        keys, where = np.unique(where, return_inverse=True)
    sums = np.bincount(where, weights=np.repeat(np.fromiter(words.values(), dtype=np.int64, count=len(words)), sizes + 1)).astype(np.int64)
    if keys is None:
        keys = np.flatnonzero(sums)
        sums = sums[keys]
    chars = [chr(c) for c in letters]
    return Counter({chars[k // (n * n)] + chars[k // n % n] + chars[k % n]: c for k, c in zip(keys.tolist(), sums.tolist())})


@functools.cache
def _read(c: str, n: int) -> list[tuple[str, float]]:
    letters = c if c.isalpha() else SIGNS.get(c, "")
    swap = 0.0 if c.isalpha() else 1.0
    found = [(x, swap + (0.0 if n == 1 else 0.7)) for x in letters]
    if n > 1:
        found += [(x * 2, swap + (0.2 if n == 2 else 0.9)) for x in letters]
    if not c.isalpha():
        found.append(("", 5.0 if c in SIGNS else 0.3))  # a separator, or noise
    return found


def readings(word: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of equal characters, what it may stand for and the channel's cost of that."""
    return [_read(m[1], min(3, m.end() - m.start())) for m in _RUNS.finditer(word)]


def decode(word: str, model: CharModel) -> str:
    """The reading of least total cost; of equal ones that whose parts come first in the lattice."""
    return _unstretched(word, model.cost) if word.isalpha() else "".join(_search(readings(word), model))


def _unstretched(word: str, cost: Callable[[str, str], float]) -> str:
    """The search for a word of letters alone: how often a letter is kept bears on no cost past the letter after its run,
    so each run is settled by itself."""
    out, at = "", 0
    for m in _REPEATED(word):
        i, j = m.span()
        c, before, after = word[i], word[i - 1] if i else "^", word[j : j + 1] or "$"
        once = 0.7 + cost(before + c, after)
        twice = (0.2 if j - i == 2 else 0.9) + cost(before + c, c) + cost(c + c, after)
        out += word[at:i] + (c if once <= twice else c + c)
        at = j
    return out + word[at:]


def decode_words(letters: str, model: CharModel) -> list[str]:
    """The reading of least total cost of letters in which a word may end after any of them, as words."""
    lattice = []
    for run, choices in zip((m[0] for m in _RUNS.finditer(letters)), readings(letters)):
        n, found = len(run), list(choices)
        if n > 1:  # words may also end inside a run
            swap, signs = (0.0, run[0]) if run[0].isalpha() else (1.0, SIGNS.get(run[0], ""))
            for x in signs:
                for left, right in ((1, 1), (1, 2), (2, 1), (2, 2)):
                    if left + right <= n:
                        found.append((f"{x * left} {x * right}", swap + (0.2 if left + right == n else 0.9)))
        if lattice:
            found += [(f" {piece}", extra) for piece, extra in found if piece]
        lattice.append(found)
    return "".join(_search(lattice, model)).split()


def _search(lattice: list[list[tuple[str, float]]], model: CharModel) -> list[str]:
    """The parts of the cheapest path; a space ends a word and begins the next.

    Paths are chains that share their beginnings, so time and memory are linear in the length of the lattice.
    """
    cost = model.cost
    paths: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for choices in lattice:
        best: dict[str, tuple[float, tuple | None]] = {}
        for state, (total, chain) in paths.items():
            for piece, extra in choices:
                s, now = state, total + extra
                for c in piece:
                    if c == " ":
                        now += cost(s, "$")
                        s = "^^"
                    else:
                        now += cost(s, c)
                        s = s[1] + c
                if s not in best or now < best[s][0]:
                    best[s] = (now, (chain, piece))
        paths = best
    _, chain = min(((total + cost(s, "$"), chain) for s, (total, chain) in paths.items()), key=lambda x: x[0])
    parts = []
    while chain:
        chain, piece = chain
        parts.append(piece)
    return parts[::-1]


def forms(piece: str, model: CharModel) -> set[str]:
    """The word of a lower-case piece of text without signs at its edges and, where it is odd, what it restores to with
    those signs and without them."""
    w, whole = piece.strip(_EDGE), piece.strip(_NOISE)
    out = {w}
    if _ODD(whole):
        out.add(decode(whole, model))
        if w != whole and _ODD(w):
            out.add(decode(w, model))
    return out - {""}


def set_apart(pieces: list[str], model: CharModel) -> set[str]:
    """What runs of three or more single letters or letter signs restore to, as one word and as several."""
    out: set[str] = set()
    apart: list[str] = []
    for p in [*pieces, ""]:
        if 0 < len(p) <= 2 and len(w := p.strip(_EDGE) or p[0]) == 1 and (w.isalpha() or w in SIGNS):
            apart.append(w)
            continue
        if len(apart) >= 3 and len(set(apart)) > 1:
            joined = "".join(apart)
            out.update((decode(joined, model), *decode_words(joined, model)))
        apart = []
    return out - {""}


def restored(text: str, model: CharModel) -> set[str]:
    """Distinct lower-case words of a text as written and as restored."""
    pieces = _SPLIT(text.lower())
    return set_apart(pieces, model).union(*(forms(p, model) for p in set(pieces)))


class Features:
    """Hashed features of a text: its words, as written and restored, and their first four and five letters, each once."""

    def __init__(self, model: CharModel, bits: int):
        self.model, self.mask = model, (1 << bits) - 1
        self.kept = Recent(self.of_piece, _KEPT)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.kept = Recent(self.of_piece, _KEPT)

    def forget(self) -> None:
        self.kept.clear()
        self.model.forget()

    def of_words(self, words: set[str]) -> tuple[int, ...]:
        named = {f"w{w}" for w in words} | {f"p{w[:n]}" for w in words for n in (4, 5) if len(w) > n}
        return tuple({max(1, xxhash.xxh3_64_intdigest(f) & self.mask) for f in named})

    def of_piece(self, piece: str) -> tuple[int, ...]:
        return self.of_words(forms(piece, self.model))

    def of(self, text: str | None) -> np.ndarray:
        """Distinct indices, the bias among them; that alone for an empty text."""
        out = {linear.BIAS}
        if text:
            pieces = _SPLIT(text.lower())
            out.update(*map(self.kept.__getitem__, set(pieces)), self.of_words(set_apart(pieces, self.model)))
        return np.fromiter(out, dtype=np.int64, count=len(out))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a partition's words; words, and then trigrams, are summed up before they are passed on."""
    words: Counter = Counter()
    found: Counter = Counter()

    def fold() -> None:
        spelt: Counter = Counter()
        for piece, n in words.items():
            w = piece[:-1] if piece[-1] in ".," else piece
            if len(w) > 1 and w.isalpha():
                spelt[w] += n
        words.clear()
        found.update(trigrams(spelt))

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(map(key_of, found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["key", "n"])
        found.clear()
        return out

    for b in batches:
        for text in b.column(0):
            words.update((text.as_py() or "").lower().split())
            if len(words) >= _FOLD:
                fold()
            if len(found) >= _FOLD:
                yield rows()
    fold()
    yield rows()


def fit_chars(docs: DataFrame) -> StoredModel:
    """The character model of all purely alphabetic words of two letters or more in the texts of ``docs``.

    Every text counts whole and no trigram is left out, so the model grows with the corpus; it stays in files of the shared
    folder.  Letters that stand alone are what the decoder has to join; they teach nothing.
    """
    spark = docs.sparkSession
    grams = saved(docs.select("text").mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    third = F.col("key").bitwiseAND(F.lit(_ANY))
    pairs = grams.groupBy((F.col("key") - third).alias("pair")).agg(F.sum("n").alias("total"))
    chars = grams.select(F.explode(F.array(third, F.shiftright("key", _BITS).bitwiseAND(F.lit(_ANY)), F.shiftright("key", 2 * _BITS)))).distinct().count()
    met = grams.join(pairs, F.col("key") - third == F.col("pair")).select("key", "n", "total")
    new = pairs.select((F.col("pair") + F.lit(_ANY)).alias("key"), F.lit(0).cast("long").alias("n"), "total")
    path = f"{shared_dir(spark)}/trigrams-{uuid.uuid4().hex}"
    met.unionByName(new).repartitionByRange(-(-grams.count() // _PAGE) or 1, "key").sortWithinPartitions("key").write.parquet(path)
    firsts = spark.read.schema("key long").parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.min("key").alias("first"))
    return StoredModel(sorted((r["first"], r["file"]) for r in firsts.collect()), 1 + chars)


def fit(train: DataFrame, label: str, *, corpus: DataFrame | None = None, most_rows: int = 8000, params: linear.Ftrl | None = None) -> tuple[Features, np.ndarray]:
    """Learns the character model from all texts of ``corpus`` (``train`` where there is none), and the weights from the
    columns doc_id, text and ``label`` of ``train`` (0 or 1; other rows teach nothing), reading at most about ``most_rows``
    rows of each label, chosen by a hash of id and text."""
    p = params or linear.Ftrl(bits=20, alpha=1.0, l1=4.0, epochs=6, shards=1)
    y = F.col(label).cast("int")
    rows = bounded_sample(small_batches(train).where(y.isin(0, 1)), y, most_rows, "doc_id", "text")
    features = Features(fit_chars(train if corpus is None else corpus), p.bits)
    shared = train.sparkSession.sparkContext.broadcast(features)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_over("toxicity examples", shared.value.forget)
        for pdf in batches:
            idx = [np.sort(shared.value.of(t)).astype(np.int32) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "label": pdf["label"], "idx": idx, "val": [np.ones(len(i), dtype=np.float32) for i in idx]})

    given = rows.select(F.xxhash64("doc_id", "text").alias("key"), y.alias("label"), "text")
    return features, linear.fit(given.mapInPandas(made, "key long, label int, idx array<int>, val array<float>"), p)


def score(docs: DataFrame, features: Features, weights: np.ndarray, *, out: str = "score") -> DataFrame:
    """Adds the probability of label 1 to rows with a column text; null and empty texts get that of the bias alone."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast((features, weights))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f, w = shared.value
        take_over("toxicity", f.forget)
        for texts in batches:
            yield pd.Series([linear.logistic(math.fsum(w[f.of(t)])) for t in texts], dtype="float64")

    return docs.withColumn(out, F.pandas_udf(scored, "double")(F.col("text")))
