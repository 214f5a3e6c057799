"""Small document tables with nulls, empty and long texts, repeated rows and clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, kept boolean, row string"


def words(n: int, seed: int, vocabulary: int = 5000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    base, long = words(120, 1), words(3000, 2)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, long), (9, long + " tail"),
        (10, "a, b. ÄÖ ñ 日本語 😀\nA line\nA line\n"), (11, words(200, 3)), (11, words(200, 3)), (12, None), (None, words(90, 4)), (13, "ONE"),
        (14, words(80, 5) + " " + base), (15, "x" * 5000), (16, "<|endoftext|> \x1c  two  spaces "),
    ]
    sources = ["b", "a", None, "c"]
    return [(i, t, "en" if k % 2 else None, sources[k % 4], len(t or ""), 7, True, "r") for k, (i, t) in enumerate(texts)]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
