"""Scoring of candidates under family contexts by a pluggable scorer, and the stand-in profile scorer."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions.residues import parsed, uniform, without_gaps, without_insertions
from lamina.operators import evaluation
from lamina.operators.alignment import column_frequencies
from lamina.operators.budget import context_sizes, prefix_cut
from lamina.operators.sampling import weighted_order
from lamina.sources.relations import cells


class Scorer(Protocol):
    """Anything that turns contexts and candidates into token log-probabilities."""

    def token_scores(self, contexts: DataFrame, candidates: DataFrame) -> DataFrame:
        """contexts(msa_id, member, row_id, aln), candidates(msa_id, candidate, aln) to
        (msa_id, candidate, member, pos, log_prob)."""
        ...


class ProfileScorer:
    """Log-probabilities from each context's column frequencies with a pseudocount: no model is needed."""

    def __init__(self, alpha: float = 0.1):
        self.alpha = alpha

    def token_scores(self, contexts: DataFrame, candidates: DataFrame) -> DataFrame:
        # Each ensemble member's context is an alignment of its own.
        keyed = contexts.withColumn("msa_id", F.struct("msa_id", "member"))
        long = cells(keyed).withColumn("weight", F.lit(1.0))
        tokens = candidates.select(F.explode(F.split("aln", "")).alias("token")).union(long.select("token")).distinct()
        members = contexts.select(F.struct("msa_id", "member").alias("msa_id")).distinct()
        # A row for each residue letter.
        alphabet = members.join(F.broadcast(tokens))
        profile = column_frequencies(long, alphabet, self.alpha).select(
            F.col("msa_id.msa_id").alias("msa_id"), F.col("msa_id.member").alias("member"), "col", "token", F.log("frequency").alias("log_prob")
        )
        # Sizes estimated before the explode are too small by the columns, so that cells could be broadcast; they are merged.
        wanted = candidates.select("msa_id", "candidate", F.posexplode(F.split("aln", "")).alias("col", "token")).hint("merge")
        return wanted.join(profile, ["msa_id", "col", "token"]).select("msa_id", "candidate", "member", F.col("col").alias("pos"), "log_prob")


def contexts(weights: DataFrame, rows: DataFrame, ensemble_size: int, n: int, seed: int) -> DataFrame:
    """msa_id, member, row_id, aln: for each ensemble member n rows by weighted sampling without replacement."""
    members = weights.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(ensemble_size - 1))))
    members = members.withColumn("_group", F.concat_ws("#", "msa_id", F.col("member").cast("string")))
    chosen = weighted_order(members, str(seed), "_group", "row_id", "weight").filter(F.col("rank") <= n)
    return chosen.select("msa_id", "member", "row_id").join(rows.hint("merge"), ["msa_id", "row_id"])


def contexts_within(weights: DataFrame, rows: DataFrame, ensemble_size: int, budget: int, completion: int, seed: int) -> DataFrame:
    """msa_id, member, rank, row_id, aln: for each ensemble member the rows of a random context that leaves room for a completion.

    The number of rows is drawn evenly from the sizes that an assumed length allows; of the rows in weighted random
    order the longest prefix of at most that many stays whose tokens, with two for the document and one for each
    row, fit beside the completion. A member none of whose rows fits has no context.
    """
    sized = rows.select("msa_id", "row_id", "aln", F.length(F.replace("aln", F.lit("-"), F.lit(""))).alias("seq_len"))
    families = sized.groupBy(F.col("msa_id").alias("family_id")).agg(F.count("*").alias("n"), F.min("seq_len").alias("min_len"), F.avg("seq_len").alias("avg_len"))
    sizes = context_sizes(families, budget, completion).withColumnRenamed("family_id", "msa_id")
    members = weights.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(ensemble_size - 1))))
    members = members.withColumn("_group", F.concat_ws("#", "msa_id", F.col("member").cast("string")))
    order = weighted_order(members, str(seed), "_group", "row_id", "weight")
    drawn = F.col("lo") + F.floor(uniform(str(seed), F.lit("size"), F.col("_group")) * (F.col("hi") - F.col("lo") + 1))
    placed = order.join(sizes, "msa_id").filter(F.col("rank") <= drawn).select("msa_id", "member", "_group", "rank", "row_id")
    placed = placed.join(sized, ["msa_id", "row_id"])
    fits = prefix_cut(placed, F.col("seq_len") + 1, lambda t: t + 2 + completion > budget, ["_group"], ["rank"])
    return fits.select("msa_id", "member", "rank", "row_id", "aln")


def score(scorer: Scorer, chosen: DataFrame, candidates: DataFrame, per_residue: bool = False) -> DataFrame:
    """msa_id, candidate, members, score (mean over members of mean log-probability), and per residue if asked.

    A score depends on the aligned text alone: the scorer gets each text of an alignment once, under its md5 as the
    candidate, and sums and counts go back to all candidates that have it.
    """
    named = candidates.select("msa_id", "candidate", F.unhex(F.md5("aln")).alias("text"), "aln")
    tokens = scorer.token_scores(chosen, named.select("msa_id", F.col("text").alias("candidate"), "aln").distinct())
    named = named.select("msa_id", "text", F.struct("msa_id", "candidate").alias("key")).hint("merge")

    def of_candidates(part: str, mean: str) -> DataFrame:
        """candidate, part and the mean log-probability of the tokens of all its rows there."""
        texts = tokens.groupBy("msa_id", F.col("candidate").alias("text"), part).agg(F.sum("log_prob").alias("s"), F.count("log_prob").alias("n"))
        rows = named.join(texts, ["msa_id", "text"]).select(F.col("key").alias("candidate"), part, "s", "n")
        return rows.groupBy("candidate", part).agg(F.try_divide(F.sum("s"), F.sum("n")).alias(mean))

    out = evaluation.ensemble_scores(of_candidates("member", "log_prob"))
    out = out.select("candidate.msa_id", "candidate.candidate", "members", "score")
    if not per_residue:
        return out
    lists = of_candidates("pos", "l").groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("pos", "l"))).alias("r"))
    lists = lists.select("candidate.msa_id", "candidate.candidate", "r")
    return out.join(lists, ["msa_id", "candidate"]).withColumn("residue_scores", F.transform("r", lambda x: x["l"])).drop("r")


def resolved_prompts(rows: DataFrame, use_weights: bool) -> DataFrame:
    """prompt_id, accession, conditioning, aligned, is_aligned: aligned views where all match lengths agree.

    With diversity weights an unaligned prompt is an error. rows(prompt_id, accession, sequence)
    """
    aligned = parsed(F.col("sequence"), True, False, True)
    n = F.max(F.length(without_insertions(F.col("sequence")))).over(Window.partitionBy("prompt_id"))
    low = F.min(F.length(without_insertions(F.col("sequence")))).over(Window.partitionBy("prompt_id"))
    same = n == low
    wrong = F.raise_error(F.concat(F.lit("prompt is not aligned: "), F.col("prompt_id").cast("string"))).cast("string")
    view = F.when(same, aligned).otherwise(wrong if use_weights else F.lit(None).cast("string"))
    return rows.select("prompt_id", "accession", F.upper(without_gaps(F.col("sequence"))).alias("conditioning"), view.alias("aligned"), same.alias("is_aligned"))


MOST_GENERATED_TOKENS = 8192


def checked_generation_length(max_tokens: int) -> int:
    if max_tokens > MOST_GENERATED_TOKENS:
        raise ValueError(f"max_tokens must be at most {MOST_GENERATED_TOKENS}")
    return max_tokens
