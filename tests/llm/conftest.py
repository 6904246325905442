from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from texts import as_table, sentence_text, words  # noqa: E402

@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, equal ids, odd characters and spaces."""
    rng = random.Random(5)
    base = sentence_text(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n\x0b ", "en", "a"),
        (4, base, "en", "a"),
        (5, base, "en", "b"),
        (6, " ".join(near), "en", "b"),
        (6, "another text with the same id", "en", "b"),
        (7, base, "en", "a"),
        (7, base, "en", "a"),
        (8, "é 日本 ö|# ß <|endoftext|>  two  spaces ", "fr", "c"),
        (None, "a document without an id of its own", "en", "c"),
        (None, None, None, "c"),
        (9, "one two three", "en", "c"),
        (10, "One TWO three", "en", "c"),
        (11, " ".join(words(rng, 6000)), "en", "long"),
        (12, "x" * 50_000, "en", "long"),
        (13, "same line of words here\n" * 40, "en", "d"),
        (-4, "negative id", "en", "d"),
    ]
    return rows + [(100 + i, sentence_text(rng, 40 + i), "en", "abcd"[i % 4]) for i in range(40)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return as_table(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return as_table(spark, [])
