"""Small document tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, score double, key string, component long"


def documents(spark, texts, lang=None):
    """doc_id counts up; further columns have names that operators use inside."""
    rows = [(k if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1]) for k, t in enumerate(texts)]
    langs = lang or ["en"] * len(rows)
    return spark.createDataFrame([(i, t, langs[k], "src", None if t is None else len(t), 7, "x", 0.5, "k", 1) for k, (i, t) in enumerate(rows)], SCHEMA)


def words(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


HARD = [None, "", " \t\n", "a", "a b", "ÀÉ ß 日本語 🙂", "x" * 5000, "a\x00b", "same text here again", "same text here again"]
