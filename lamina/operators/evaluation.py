"""Evaluation statistics over generated and reference sequences, results and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions.statistics import correlation


def length_ratios(generated: DataFrame, prompts: DataFrame, group: str) -> DataFrame:
    """generated_id, min, max and mean of its length over each prompt's length.

    A ratio's extremes need only the prompts' extremes, and its mean their mean reciprocal, so that no
    pair is formed: generated(group, generated_id, n), prompts(group, n).
    """
    p = prompts.groupBy(group).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.avg(F.try_divide(F.lit(1.0), F.col("n"))).alias("inv"))
    rows = generated.join(p, group)
    return rows.select(
        group,
        "generated_id",
        F.round(F.try_divide(F.col("n"), F.col("hi")), 9).alias("min_ratio"),
        F.round(F.try_divide(F.col("n"), F.col("lo")), 9).alias("max_ratio"),
        F.round(F.col("n") * F.col("inv"), 9).alias("mean_ratio"),
    )


def outer_of_inner(rows: DataFrame, group: str, columns: dict[str, str], digits: int = 3) -> DataFrame:
    """{min, max, mean} over a group of each inner statistic column."""
    aggs = []
    for name, column in columns.items():
        for outer, f in (("min", F.min), ("max", F.max), ("mean", F.avg)):
            aggs.append(F.round(f(column), digits).alias(f"{outer}_of_{name}"))
    return rows.groupBy(group).agg(*aggs)


def spearman(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties; constant values give 0."""

    def average_rank(c: str) -> Column:
        peers = F.count("*").over(Window.partitionBy(group, c))
        return F.rank().over(Window.partitionBy(group).orderBy(c)) + (peers - 1) / 2

    ranked = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", average_rank(x)).withColumn("_y", average_rank(y))
    r = F.when((F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0), correlation(F.col("_x"), F.col("_y"))).otherwise(0.0)
    return ranked.groupBy(group).agg(F.count("*").alias("n"), F.round(r, 9).alias("spearman"))


def pair_statistics(pairs: DataFrame, sample: str, value: str) -> DataFrame:
    return pairs.groupBy(sample).agg(F.min(value).alias("min_value"), F.round(F.avg(value), 9).alias("mean_value"), F.max(value).alias("max_value"))


def merged_statistics(coverage: DataFrame, identity: DataFrame, key: str = "generated_id") -> DataFrame:
    """Full outer merge of two statistics tables."""
    return coverage.join(identity, key, "full")


def hit_statistics(hits: DataFrame, samples: DataFrame, key: str, threshold: float = 1e-3, none: float = 1e8) -> DataFrame:
    """samples(key, n): the share of samples with a hit below the threshold, and the mean e-value, `none` if there is no hit."""
    best = hits.groupBy(key).agg(F.count("*").alias("hits"), F.sum((F.col("evalue") < threshold).cast("int")).alias("good"), F.avg("evalue").alias("mean_evalue"))
    rows = samples.join(best, key, "left")
    return rows.select(
        key,
        F.round(100 * F.coalesce("good", F.lit(0)) / F.col("n"), 9).alias("hit_percent"),
        F.round(F.coalesce("mean_evalue", F.lit(none)), 9).alias("mean_evalue"),
    )


def metric_means(results: DataFrame) -> DataFrame:
    return results.groupBy("evaluator", "sampler", "metric").agg(F.count("*").alias("instances"), F.round(F.avg("value"), 9).alias("mean_value"))


def ensemble_scores(scores: DataFrame) -> DataFrame:
    """candidate, score: the mean over ensemble members of each member's mean; scores(candidate, member, log_prob)."""
    per = scores.groupBy("candidate", "member").agg(F.avg("log_prob").alias("s"))
    return per.groupBy("candidate").agg(F.count("*").alias("members"), F.round(F.avg("s"), 9).alias("score"))


def ensemble_tokens(probabilities: DataFrame, reduction: str) -> DataFrame:
    """step, token, p from (step, member, token, p): mean of probabilities, or softmax of mean log(p + 1e-12)."""
    if reduction == "mean_probs":
        return probabilities.groupBy("step", "token").agg(F.avg("p").alias("p"))
    if reduction != "sum_log_probs":
        raise ValueError(f"unknown reduction {reduction}")
    logs = probabilities.groupBy("step", "token").agg(F.avg(F.log(F.col("p") + 1e-12)).alias("l"))
    step = Window.partitionBy("step")
    raised = logs.withColumn("e", F.exp(F.col("l") - F.max("l").over(step)))
    return raised.select("step", "token", (F.col("e") / F.sum("e").over(step)).alias("p"))


def accepted(samples: DataFrame, group: str, least_share: float, least_identity: float | None) -> DataFrame:
    """Samples long enough for their prompts, and close enough if a least identity other than 0 is given.

    samples(group, sample_id, seq_len, prompt_min, best_identity)
    """
    keep = F.col("seq_len") >= F.floor(F.col("prompt_min") * least_share)
    if least_identity:
        keep = keep & (F.coalesce("best_identity", F.lit(0.0)) >= least_identity)
    return samples.filter(keep)


def batch_repetition(rows: DataFrame, batch: str, identifier: str, dataset: str) -> DataFrame:
    """batch_hash, times: how often a batch of the same members was seen, whatever their order."""
    member = F.concat(F.col(identifier).cast("string"), F.lit(":"), F.col(dataset))
    batches = rows.groupBy(batch).agg(F.md5(F.array_join(F.array_sort(F.collect_list(member)), "")).alias("batch_hash"), F.count("*").alias("members"))
    return batches.groupBy("batch_hash", "members").agg(F.count("*").alias("times"))


def repetition_summary(times: DataFrame) -> DataFrame:
    return times.agg(
        F.sum("times").alias("total"),
        F.count("*").alias("distinct_batches"),
        F.sum((F.col("times") > 1).cast("long")).alias("repeated"),
        F.min("times").alias("least"),
        F.max("times").alias("most"),
        F.round(F.avg("times"), 9).alias("mean_times"),
    )


def structure_metrics(residues: DataFrame, sample: str, most: int) -> DataFrame:
    """One row over all samples from (sample, plddt): mean of means, lengths, and how many are longer than most."""
    per = residues.groupBy(sample).agg(F.avg("plddt").alias("m"), F.count("*").alias("n"))
    return per.agg(
        F.round(F.avg("m"), 9).alias("mean_plddt"), F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.round(F.avg("n"), 9).alias("mean_len"),
        F.sum((F.col("n") > most).cast("long")).alias("too_long"),
    )


def schedule_value(steps: DataFrame, thresholds: dict[int, float], step: str) -> DataFrame:
    """The value of the largest threshold that is not above the step; none below the first."""
    value = F.lit(None).cast("double")
    for t in sorted(thresholds):
        value = F.when(F.col(step) >= t, F.lit(float(thresholds[t]))).otherwise(value)
    return steps.withColumn("scheduled", value)


def learning_rate(step: Column, warmup: int, stable: int, decay: int, least: float = 0.0) -> Column:
    """Linear warm-up, a plateau, and a linear decay to the least share."""
    down = 1 - (step - warmup - stable) / float(decay) * (1 - least)
    return F.when(step < warmup, step / float(warmup)).when(step < warmup + stable, 1.0).otherwise(F.greatest(F.lit(least), down))


def cosine_rate(step: Column, warmup: int, total: int, least: float = 0.0) -> Column:
    """Linear warm-up, then half a cosine from 1 to the least share at the last step."""
    half = 0.5 * (1 + F.cos((step - warmup) / float(max(1, total - warmup)) * math.pi))
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(F.greatest(F.lit(0.0), half * (1 - least) + least))
