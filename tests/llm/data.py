"""Small inputs with what real corpora hold: nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

LETTERS = "abcdefghijklmnop"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, kept string"


def words(n: int, seed: int, size: int = 400) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(LETTERS, k=1 + (rng.randrange(size) % 7))) for _ in range(n)]


def corpus() -> list[tuple]:
    base = words(60, 1)
    near = [*base[:30], "changed", *base[31:]]
    far = [*base[:10], *words(50, 2)]
    texts = [
        " ".join(base), " ".join(base).upper(), " ".join(near), " ".join(far), "", None, " \t\n", "one", "one two three four", "ONE two three four",
        " ".join(words(6000, 3)), "1234 $$$ !!!", "a b  c\r\n\td", "x" * 5000, "émigré naïve 😀 <|endoftext|> don't",
    ]
    rows = [(k, t, "en" if k % 3 else "fr", f"s{k % 4}" if k % 5 else None, len(t or ""), 0.5, "l", "k") for k, t in enumerate(texts)]
    rows += [rows[0], rows[0]]  # repeated rows
    rows += [(3, " ".join(words(40, 9)), None, None, 0, None, None, None), (None, " ".join(base), "en", "s1", 0, None, None, None), (None, "solo words of no id at all", None, "s1", 0, None, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, DOCS)
