"""Token budgets: which members of a family fit a document. Lengths decide; sequences join afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions.residues import uniform
from lamina.operators.sampling import hash_order


def _running(key: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def prefix_cut(rows: DataFrame, cost: Column, misfit, key: list[str], order: list[str]) -> DataFrame:
    """Rows before the first misfit(running cost) of each key, with tokens_so_far.

    The running cost never falls, so that comparing each row's own sum finds the same prefix.
    """
    so_far = F.sum(cost).over(_running(key, order))
    return rows.withColumn("tokens_so_far", so_far).filter(~misfit(F.col("tokens_so_far")))


def aligned_cut(rows: DataFrame, budget: int | Column, per_document: int = 2, key: str = "family_id", order: str = "member_idx") -> DataFrame:
    """Members up to the first whose addition reaches the budget (>=): it is never filled exactly."""
    return prefix_cut(rows, F.col("seq_len") + 1, lambda t: t + per_document >= budget, [key], [order])


def token_cap(rows: DataFrame, cap: int, key: str = "family_id", order: str = "member_idx") -> DataFrame:
    """Members up to the first whose addition exceeds the cap; a family may be left empty."""
    return prefix_cut(rows, F.col("seq_len"), lambda t: t > cap, [key], [order])


def prompt_cut(rows: DataFrame, budget: int, start_tokens: int = 2, key: str = "family_id", order: str = "member_idx") -> DataFrame:
    """Members while start tokens and members with separators fit (<=)."""
    return prefix_cut(rows, F.col("seq_len") + 1, lambda t: t + start_tokens > budget, [key], [order])


def dealt(rows: DataFrame, seed: str | None, drop_first: bool, keep_first: bool, key: str = "family_id", order: str = "member_idx") -> DataFrame:
    """place, from 1: members in hash order, or as they are without a seed.

    The first member is dropped on request unless it is alone, or keeps its place before the shuffled others.
    """
    first = F.col(order) == F.min(order).over(Window.partitionBy(key))
    if drop_first:
        alone = F.count("*").over(Window.partitionBy(key)) == 1
        rows = rows.withColumn("_keep", ~first | alone).filter("_keep").drop("_keep")
    by = [F.col(order)] if seed is None else [hash_order(seed, F.col(key), F.col(order)), F.col(order)]
    if keep_first:
        rows = rows.withColumn("_later", (~first).cast("int"))
        by = [F.col("_later"), *by]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*by))).drop("_later")


def raw_sample(
    rows: DataFrame, budget: int, seed: str | None = None, drop_first: bool = False, keep_first: bool = False, cut_last: bool = True,
    key: str = "family_id", order: str = "member_idx",
) -> DataFrame:
    """place, kept_start, kept_len: whole members below the budget, and a random slice of the next one.

    Running lengths count each member with its separator and the document's two tokens. Members before the
    first that reaches the budget are whole; if more than one token is left, a slice of the next has what is left,
    and if not even the first fits, a slice of it has budget - 3. If one token is left, the last whole member is
    cut to one residue, unless cut_last is off.
    """
    member = Window.partitionBy(key).orderBy("place")
    so_far = F.sum(F.col("seq_len") + 1).over(member.rowsBetween(Window.unboundedPreceding, 0)) + 2
    rows = dealt(rows, seed, drop_first, keep_first, key, order).withColumn("_to", so_far)
    rows = rows.withColumn("_from", F.col("_to") - F.col("seq_len") - 1).withColumn("_more", F.lead(F.lit(True)).over(member).isNotNull())
    room = F.lit(budget) - F.col("_from") - 1
    next_is_out = F.col("_more") & (F.lead("_to").over(member) >= budget)
    last = F.lit(cut_last) & next_is_out & (F.col("_to") == budget - 2)
    kept = (
        F.when((F.col("_to") < budget) & last, F.least(F.col("seq_len"), F.lit(1)))
        .when(F.col("_to") < budget, F.col("seq_len"))
        .when(F.col("place") == 1, F.least(F.col("seq_len"), F.lit(budget - 3)))
        .when((F.col("_from") < budget) & (room > 1), F.least(F.col("seq_len"), room))
    )
    out = rows.withColumn("kept_len", kept.cast("int")).filter("kept_len is not null").drop("_to", "_from", "_more")
    free = F.col("seq_len") - F.col("kept_len") + 1
    start = F.lit(0) if seed is None else F.floor(uniform(seed, F.lit("start"), F.col(key), F.col(order)) * free)
    return out.withColumn("kept_start", start.cast("int"))


def raw_cut(rows: DataFrame, budget: int, key: str = "family_id", order: str = "member_idx") -> DataFrame:
    """kept_len of a raw sample in the given order that keeps prefixes and leaves a single token unused."""
    return raw_sample(rows, budget, cut_last=False, key=key, order=order).drop("place", "kept_start")


def room_cut(rows: DataFrame, budget: int, seed: str | None = None, drop_first: bool = False, keep_first: bool = False, key: str = "family_id", order: str = "member_idx") -> DataFrame:
    """Members of an aligned cut that leaves room for rows' longest_completion."""
    return aligned_cut(dealt(rows, seed, drop_first, keep_first, key, order), context_budget(budget, F.col("longest_completion")), key=key, order="place")


def context_budget(budget: int, longest_completion: Column) -> Column:
    """Tokens for the context so that the longest completion and two markers still fit."""
    return F.lit(budget) - longest_completion - 2


def variant_budget(budget: int, longest: Column, u: Column) -> Column:
    """A context budget drawn evenly from the longest member up to the room, by the uniform u, but at least half the room.

    The room leaves 1.2 times the longest member free; where it is smaller than that member, the draw is the member.
    """
    room = F.greatest(F.lit(budget) - F.floor(longest * 1.2), F.lit(0))
    drawn = F.when(room < longest, longest).otherwise(longest + F.floor(u * (room - longest + 1)))
    return F.greatest(drawn, F.floor(room / 2)).cast("long")


def context_sizes(families: DataFrame, budget: int, completion: int) -> DataFrame:
    """lo, hi: the numbers of context members to choose from, by assumed length (min + mean) / 2.

    families(family_id, n, min_len, avg_len); the context has budget - completion - 5 tokens.
    """
    room = budget - completion - 5
    assumed = (F.col("min_len") + F.col("avg_len")) / 2
    top = F.least(F.floor(F.try_divide(F.lit(room), assumed)) + 2, F.col("n")).cast("long")
    return families.select("family_id", F.least(top, F.lit(2)).alias("lo"), F.least(top, F.col("n")).alias("hi"))


def largest_fitting_prefix(rows: DataFrame, budget: int, completion: int, key: str, order: str) -> DataFrame:
    """family, n: the largest prefix with 2 + lengths + separators + completion <= budget; at least 0."""
    fits = prefix_cut(rows, F.col("seq_len") + 1, lambda t: t + 2 + completion > budget, [key], [order])
    counts = fits.groupBy(key).agg(F.count("*").alias("n"))
    return rows.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
