"""Made-up documents for the tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size string, text_key int, shard string, __own_note string, __own string, removed string"
LETTERS = "the of and to in is that for it as was with be by on are this at from alpha beta gamma delta"


def words(rng: random.Random, n: int) -> list[str]:
    common = LETTERS.split()
    return [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def sentence_text(rng: random.Random, n: int) -> str:
    out = words(rng, n)
    for at in range(9, n, 10):
        out[at] += "." + ("\n" if at % 30 == 29 else "")
    return " ".join(out).replace("\n ", "\n")


def as_table(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, g, s, len(t) if t else None, "x", "y", 1, None, "z", "own", "gone") for i, t, g, s in rows], SCHEMA)
