"""Golden vectors of the sequence expressions and identities."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lamina.functions import identity as I
from lamina.functions import residues as R
from lamina.operators import members as M


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "s string").select(expression(F.col("s")).alias("x")).first()["x"]


POSITIONS = [
    ("ABC", (True, True, True), "ABC", [1, 2, 3], [True] * 3),
    ("ABC", (True, True, False), "ABC", [1, 2, 3], [True] * 3),
    ("aBC", (True, True, True), "ABC", [0, 1, 2], [False, True, True]),
    ("aBC", (True, True, False), "ABC", [1, 2, 3], [False, True, True]),
    ("aBCaa", (True, True, True), "ABCAA", [0, 1, 2, 2, 2], [False, True, True, False, False]),
    ("azBCaa", (True, True, True), "AZBCAA", [0, 0, 1, 2, 2, 2], [False, False, True, True, False, False]),
    ("azBzCaa", (True, False, True), "BC", [1, 2], [True, True]),
    ("abCdEFgHi", (False, True, False), "ABCDEFGHI", list(range(1, 10)), [False, False, True, False, True, True, False, True, False]),
    ("..--ab-C.d-E..f-G.-", (False, True, True), "ABCDEFG", [2, 2, 4, 4, 6, 6, 8], [False, False, True, False, True, False, True]),
    ("..--ab-C.d-E..f-G.-", (False, True, False), "ABCDEFG", list(range(1, 8)), None),
    ("GdfkHIJm--F", (False, True, True), "GDFKHIJMF", [1, 1, 1, 1, 2, 3, 4, 4, 7], None),
    ("GdfkHIJm--F", (True, False, True), "GHIJ--F", list(range(1, 8)), None),
]


@pytest.mark.parametrize("text,flags,sequence,positions,match", POSITIONS)
def test_positions(spark, text, flags, sequence, positions, match):
    row = one(spark, text, lambda s: R.match_positions(s, *flags))
    assert (row["sequence"], row["positions"]) == (sequence, positions)
    if match is not None:
        assert row["is_match"] == match


def test_empty_sequence(spark):
    assert one(spark, "", R.raw_positions) == []
    assert one(spark, "", R.homology_code) == []
    assert one(spark, "", lambda s: R.match_positions(s)["sequence"]) == ""


def test_gap_runs(spark):
    text = "ACDe" + "-" * 11 + "FG-HI" + "-" * 10 + "KL"
    assert one(spark, text, R.gap_run_fragments) == ["ACDE", "FGHIKL"]


@pytest.mark.parametrize("n,expected", [(80, False), (81, True)])
def test_repeat_guard(spark, n, expected):
    assert one(spark, "A" * n, R.repeat_guard) is expected


def test_length_filter(spark):
    rows = spark.createDataFrame([("ARG",), ("PMMPMM",), ("RP",)], "s string")
    kept = lambda *b: sorted(r.s for r in rows.filter(M.length_between(F.length("s"), *b)).collect())
    assert kept(3, 5) == ["ARG"]
    assert kept(None, 3) == ["ARG", "RP"]


def test_unknown_tokens(spark):
    assert one(spark, "AU", lambda s: R.token_ids(s, True)) == [0, R.UNK]
    with pytest.raises(Exception, match="vocabulary"):
        one(spark, "AU", R.token_ids)


def test_identities(spark):
    row = spark.createDataFrame([("AC-E", "ACD-")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = row.select(
        I.equal_length_identity(a, b), I.pairwise_identity(a, b), I.longest_ungapped_similarity(a, b), I.homology_similarity(a, b), I.column_identity(a, b)
    ).first()
    assert list(got) == pytest.approx([0.5, 0.5, 2 / 3, 2 / 3, 0.5])


def test_accession(spark):
    assert one(spark, "sp|P12345|NAME_X rest", R.accession_of) == "P12345"
    assert one(spark, "plain", R.accession_of) == "plain"
