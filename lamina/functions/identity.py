"""The identity definitions, each under its own name; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.residues import characters, without_gaps


def _pairs(a: Column, b: Column) -> Column:
    return F.arrays_zip(characters(a).alias("x"), characters(b).alias("y"))


def _count(a: Column, b: Column, test) -> Column:
    return F.size(F.filter(_pairs(a, b), lambda p: test(p["x"], p["y"])))


def equal_length_identity(a: Column, b: Column) -> Column:
    """Equal positions, gaps included, over the length; lengths must agree."""
    share = _count(a, b, lambda x, y: x == y) / F.length(a)
    return F.when(F.length(a) == F.length(b), share).otherwise(F.raise_error(F.lit("sequences differ in length")).cast("double"))


def pairwise_identity(a: Column, b: Column) -> Column:
    """Equal non-gap positions over positions where one is no gap; the shorter is padded; both empty is 1."""
    some = F.greatest(F.length(a), F.length(b))
    a, b = F.rpad(a, some, "-"), F.rpad(b, some, "-")
    same = _count(a, b, lambda x, y: (x == y) & (x != "-"))
    any_ = _count(a, b, lambda x, y: (x != "-") | (y != "-"))
    return F.when(any_ == 0, 1.0).otherwise(F.try_divide(same, any_))


def longest_ungapped_similarity(a: Column, b: Column) -> Column:
    """Equal non-gap positions over the larger ungapped length; 0 if that is 0."""
    longest = F.greatest(F.length(without_gaps(a)), F.length(without_gaps(b)))
    return F.when(longest == 0, 0.0).otherwise(F.try_divide(_count(a, b, lambda x, y: (x == y) & (x != "-")), longest))


def homology_similarity(query: Column, other: Column) -> Column:
    """Equal non-gap positions over the query's non-gap count: asymmetric."""
    return F.try_divide(_count(query, other, lambda x, y: (x == y) & (x != "-")), F.length(F.replace(query, F.lit("-"), F.lit(""))))


def column_identity(a: Column, b: Column) -> Column:
    """Equal columns, gaps included, over the alignment length."""
    return F.try_divide(_count(a, b, lambda x, y: x == y), F.greatest(F.length(a), F.length(b)))


def best_hit(percent_identity: Column) -> Column:
    """The best external hit as a share; none is 0."""
    return F.coalesce(F.max(percent_identity), F.lit(0.0)) / 100
