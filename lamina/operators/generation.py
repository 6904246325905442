"""Generation of sequences for prompts by a pluggable sampler, with acceptance filters and retries."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions.residues import repeat_guard, uniform, without_gaps
from lamina.operators.alignment import best_similarity, column_frequencies
from lamina.operators.scoring import checked_generation_length
from lamina.sources.relations import cells


class Sampler(Protocol):
    """Anything that draws token sequences for prompts."""

    def samples(self, prompts: DataFrame, n: int, seed: str) -> DataFrame:
        """prompts(msa_id, row_id, aln) to (msa_id, sample_id, aln, score): n samples of each."""
        ...


class ProfileSampler:
    """Draws each column from its residue frequencies; the score is the mean log-probability of what was drawn."""

    def samples(self, prompts: DataFrame, n: int, seed: str) -> DataFrame:
        long = cells(prompts).withColumn("weight", F.lit(1.0))
        frequencies = column_frequencies(long, long.select("msa_id", "token").distinct()).filter("frequency > 0")
        so_far = F.sum("frequency").over(Window.partitionBy("msa_id", "col").orderBy("token").rowsBetween(Window.unboundedPreceding, 0))
        bounds = frequencies.withColumn("hi", F.round(so_far, 9)).withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy("msa_id", "col").orderBy("token")), F.lit(0.0)))
        # A column's residues are at most one for each letter, so that they fit an array.
        choices = bounds.groupBy("msa_id", "col").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "token", "frequency"))).alias("c"))
        drawn = choices.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("u", uniform(seed, F.col("msa_id"), F.col("sample_id"), F.col("col")))
        hit = F.get(F.filter("c", lambda x: (x["lo"] <= F.col("u")) & ((F.col("u") < x["hi"]) | (x["hi"] >= 1))), F.lit(0))
        drawn = drawn.select("msa_id", "sample_id", "col", hit.alias("h"))
        parts = F.array_sort(F.collect_list(F.struct("col", F.col("h.token").alias("token"))))
        rows = drawn.groupBy("msa_id", "sample_id").agg(parts.alias("p"), F.avg(F.log("h.frequency")).alias("score"))
        return rows.select("msa_id", "sample_id", F.array_join(F.transform("p", lambda x: x["token"]), "").alias("aln"), "score")


def generate(
    sampler: Sampler, prompts: DataFrame, n: int, seed: str, least_share: float | None = None, least_identity: float | None = None, retries: int = 1, max_tokens: int = 8192
) -> DataFrame:
    """msa_id, sample_id, sequence, score, accepted: the first accepted try of each sample, else the first try.

    A sample is accepted if it has least_share of the shortest prompt's residues, if its best identity to a
    prompt row reaches least_identity (skipped if that is none or 0), and if it does not end in repeats.
    """
    checked_generation_length(max_tokens)
    tries = None
    for attempt in range(max(1, retries)):
        drawn = sampler.samples(prompts, n, f"{seed}/{attempt}").withColumn("attempt", F.lit(attempt))
        tries = drawn if tries is None else tries.unionByName(drawn)
    rows = tries.withColumn("sequence", F.substr(F.upper(without_gaps(F.col("aln"))), F.lit(1), F.lit(max_tokens)))
    shortest = prompts.groupBy("msa_id").agg(F.min(F.length(without_gaps(F.col("aln")))).alias("prompt_min"))
    rows = rows.join(shortest, "msa_id")
    fine = ~repeat_guard(F.col("sequence"))
    if least_share is not None:
        fine = fine & (F.length("sequence") >= F.floor(F.col("prompt_min") * least_share))
    if least_identity:
        rows = rows.withColumn("row_id", F.concat_ws("/", F.col("sample_id").cast("string"), F.col("attempt").cast("string")))
        rows = rows.join(best_similarity(rows.select("msa_id", "row_id", "aln"), prompts), ["msa_id", "row_id"])
        fine = fine & (F.col("best") >= least_identity)
    ranked = rows.withColumn("accepted", fine)
    chosen = ranked.groupBy("msa_id", "sample_id").agg(F.min(F.struct((~F.col("accepted")).alias("no"), "attempt", "sequence", "score", "accepted")).alias("r"))
    return chosen.select("msa_id", "sample_id", "r.sequence", "r.score", "r.accepted")
