"""Assay catalogues, configuration joins, caches and reports."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import identity as I
from lamina.functions import residues as R
from lamina.functions.statistics import correlation
from lamina.operators import budget, members, sampling
from lamina.operators.alignment import homology_weights


def selected_assays(catalogue: DataFrame, ids: list[str] | None = None, most_length: int | None = None, name_part: str | None = None) -> DataFrame:
    """Rows by id, length and file name part; sorted by id only where ids are given."""
    rows = catalogue
    if ids is not None:
        rows = rows.filter(F.col("DMS_id").isin(ids))
    if most_length is not None:
        rows = rows.filter(F.col("seq_len") <= most_length)
    if name_part is not None:
        rows = rows.filter(F.col("DMS_filename").contains(name_part))
    return rows.orderBy("DMS_id") if ids is not None else rows


def alignment_path(folder: Column, name: Column) -> Column:
    """The alignment file of an assay, by how its folder is named."""
    stem = F.substring_index(name, ".", 1)
    return (
        F.when(folder.contains("poet"), F.concat_ws("/", folder, F.concat(stem, F.lit(".a3m"))))
        .when(folder.contains("openprotein"), F.concat_ws("/", folder, F.concat(stem, F.lit("_aligned.a3m"))))
        .when(folder.contains("a3m"), F.concat_ws("/", folder, F.concat(stem, F.lit(".a3m"))))
        .otherwise(F.concat_ws("/", folder, name))
    )


def consistent(documents: DataFrame, arrays: list[str]) -> DataFrame:
    """Documents whose parallel arrays have one length."""
    keep = F.lit(True)
    for name in arrays[1:]:
        keep = keep & (F.size(name) == F.size(arrays[0]))
    return documents.filter(keep)


def configured(datasets: DataFrame, weights: DataFrame, validation: DataFrame) -> DataFrame:
    """Datasets with weight (1 if none is given; those of no weight are skipped) and whether they validate."""
    rows = datasets.join(weights, "dataset", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    marks = validation.select("dataset", F.lit(True).alias("is_validation")).distinct()
    return rows.filter("weight > 0").join(marks, "dataset", "left").withColumn("is_validation", F.coalesce("is_validation", F.lit(False)))


#: Names of special tokens.
SPECIAL_TOKENS = {"[PAD]": 46, "[start-of-document]": 47, "[end-of-document]": 48, "[SEP]": 49, "[UNK]": 50, "?": 51, "[MSA]": 62, "[RAW]": 63, "[RAW-WITH-MSA-POS]": 64}


def named_token(name: Column) -> Column:
    """The id of bos, sep, a special token or a letter; other names are an error."""
    found = F.when(name == "bos", R.START).when(name == "sep", R.SEP)
    for token, number in SPECIAL_TOKENS.items():
        found = found.when(name == token, number)
    letter = F.instr(F.lit(R.TOKEN_ALPHABET), name)
    return found.when((F.length(name) == 1) & (letter > 0), letter - 1).otherwise(F.raise_error(F.concat(F.lit("no token named "), name)).cast("int"))


def substitution_distance(pairs: DataFrame, key: list[str], matrix: DataFrame) -> DataFrame:
    """key, distance: the matrix scores summed over unequal pairs without gaps of a and b; matrix(x, y, score).

    The matrix has a row for each pair of residues, a few hundred.
    """
    n = F.least(F.length("a"), F.length("b"))
    both = F.arrays_zip(F.slice(R.characters(F.col("a")), 1, n).alias("x"), F.slice(R.characters(F.col("b")), 1, n).alias("y"))
    rows = pairs.select(*key, F.explode_outer(both).alias("p")).select(*key, "p.x", "p.y")
    scored = rows.join(F.broadcast(matrix), ["x", "y"], "left").withColumn("s", F.when((F.col("x") != F.col("y")) & (F.col("x") != "-") & (F.col("y") != "-"), F.coalesce("score", F.lit(0))))
    return scored.groupBy(*key).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("distance"))


def missing_weights(alignments: DataFrame, cache: DataFrame, theta: float) -> DataFrame:
    """Alignments (msa_id, content) without cached weights for this content and theta."""
    keyed = alignments.withColumn("content_hash", F.sha2("content", 256)).withColumn("theta", F.lit(theta))
    return keyed.join(cache.select("content_hash", "theta").distinct(), ["content_hash", "theta"], "left_anti")


def alignment_digest(rows: DataFrame) -> DataFrame:
    """msa_id, content_hash of the multiset of an alignment's rows, without gathering them."""
    sums = [F.sum(F.xxhash64("aln", F.lit(part)).cast("decimal(38,0)")).cast("string") for part in (0, 1)]
    return rows.groupBy("msa_id").agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("content_hash"))


def cached_weights(rows: DataFrame, path: str, theta: float, recompute: bool = False) -> DataFrame:
    """msa_id, row_id, weight: homology weights, from the table in path where it has the alignment's content and theta.

    Others are computed and appended; recompute computes all and, where a content is there twice, the last write counts.
    The table is (content_hash, theta, aln, weight, written); equal rows have equal weights.
    """
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    digests = alignment_digest(rows)
    missing = digests
    if not recompute and folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.parquet(path).filter(F.col("theta") == theta).select("content_hash").distinct()
        missing = digests.join(known, "content_hash", "left_anti")
    own = rows.join(missing, "msa_id").dropDuplicates(["msa_id", "row_id"])
    fresh = homology_weights(own.select("msa_id", "row_id", "aln"), theta).join(own, ["msa_id", "row_id"])
    fresh = fresh.select("content_hash", "aln", "weight").distinct()
    fresh.select("content_hash", F.lit(theta).alias("theta"), "aln", "weight", F.current_timestamp().alias("written")).write.mode("append").parquet(path)
    table = spark.read.parquet(path).filter(F.col("theta") == theta)
    last = table.groupBy("content_hash", "aln").agg(F.max_by("weight", "written").alias("weight"))
    return rows.join(digests, "msa_id").join(last, ["content_hash", "aln"]).select("msa_id", "row_id", "weight")


def recovery(samples: DataFrame, native: DataFrame, key: str) -> DataFrame:
    """key, mean identity of samples(key, sample, mask) to native(key, native), over all and over masked positions.

    mask is a boolean array; a length mismatch is an error.
    """
    rows = samples.join(native, key)
    spots = F.arrays_zip(R.characters(F.col("sample")).alias("x"), R.characters(F.col("native")).alias("y"), F.col("mask").alias("m"))
    kept = F.filter(spots, lambda p: p["m"])
    masked = F.try_divide(F.size(F.filter(kept, lambda p: p["x"] == p["y"])), F.size(kept))
    return rows.groupBy(key).agg(
        F.round(F.avg(I.equal_length_identity(F.col("sample"), F.col("native"))), 9).alias("recovery"), F.round(F.avg(masked), 9).alias("masked_recovery")
    )


def instance_summary(results: DataFrame) -> DataFrame:
    """One row for each evaluator, sampler and instance with its metrics as a map in text order."""
    entries = F.array_sort(F.collect_list(F.struct("metric", "value")))
    return results.groupBy("evaluator", "sampler", "instance").agg(
        F.array_join(F.transform(entries, lambda e: F.concat(e["metric"], F.lit("="), F.format_string("%.3f", e["value"]))), ";").alias("metrics")
    )


def weighted_covariance(vectors: DataFrame, group: str, vector: str, weight: str) -> DataFrame:
    """group, i, j, cov for i <= j: weighted covariance with sum(w) - sqrt(mean(w)) points.

    Each task sums outer products of its rows; only one matrix a task and group is shuffled, not the rows.
    """

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for g, rows in pdf.groupby(group):
                x, w = np.stack(rows[vector].to_numpy()).astype(float), rows[weight].to_numpy(float)
                now = sums.setdefault(g, [np.zeros((x.shape[1],) * 2), np.zeros(x.shape[1]), 0.0, 0])
                now[0] += (x * w[:, None]).T @ x
                now[1] += (x * w[:, None]).sum(axis=0)
                now[2] += w.sum()
                now[3] += len(w)
        for g, (xx, x1, w, n) in sums.items():
            i, j = np.triu_indices(len(x1))
            yield pd.DataFrame({"g": g, "i": i, "j": j, "xx": xx[i, j], "xi": x1[i], "xj": x1[j], "w": w, "n": n})

    kind = dict(vectors.dtypes)[group]
    parts = vectors.select(group, vector, weight).mapInPandas(partial, f"g {kind}, i int, j int, xx double, xi double, xj double, w double, n long")
    total = parts.groupBy("g", "i", "j").agg(*[F.sum(c).alias(c) for c in ("xx", "xi", "xj", "w", "n")])
    points = F.col("w") - F.sqrt(F.col("w") / F.col("n"))
    return total.select(F.col("g").alias(group), "i", "j", ((F.col("xx") - F.col("xi") * F.col("xj") / F.col("w")) / points).alias("cov"))


def report(entropies: DataFrame, divergences: DataFrame, ratios: DataFrame) -> DataFrame:
    """The statistics tables of one evaluation joined by alignment."""
    return entropies.join(divergences, "msa_id", "full").join(ratios, "msa_id", "full")


@dataclass(frozen=True)
class PreprocessConfig:
    """How families become documents."""

    max_tokens_per_example: int = 8192
    keep_gaps: bool = False
    keep_insertions: bool = True
    to_upper: bool = True
    use_msa_pos: bool = False
    sample_order_seed: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    transforms: tuple = field(default=())


def preprocessed(rows: DataFrame, config: PreprocessConfig) -> DataFrame:
    """family_id, n_members, n_tokens, document: filter, clean, order, cut to the budget, then the transforms.

    rows(family_id, member_idx, accession, sequence); transforms are functions from DataFrame to DataFrame.
    """
    clean = R.standard_residues(R.parsed(F.col("sequence"), config.keep_gaps, config.keep_insertions, config.to_upper))
    out = rows.withColumn("sequence", clean).withColumn("seq_len", F.length("sequence"))
    out = out.filter(members.length_between(F.col("seq_len"), config.min_length, config.max_length))
    order = "member_idx"
    if config.sample_order_seed is not None:
        out, order = out.withColumn("_order", sampling.hash_order(config.sample_order_seed, F.col("family_id"), F.col("accession"))), "_order"
    slim = out.select("family_id", "member_idx", order, "seq_len") if order != "member_idx" else out.select("family_id", "member_idx", "seq_len")
    chosen = budget.aligned_cut(slim, config.max_tokens_per_example, order=order).select("family_id", "member_idx", "tokens_so_far")
    out = out.join(chosen, ["family_id", "member_idx"])
    for transform in config.transforms:
        out = out.transform(transform)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("tokens_so_far", "sequence"))), lambda m: m["sequence"])
    marker = F.first(R.document_marker(F.lit(config.keep_gaps), F.lit(config.use_msa_pos)))
    grouped = out.groupBy("family_id").agg(parts.alias("m"), marker.alias("marker"), F.max("tokens_so_far").alias("t"))
    document = F.concat(F.lit("[start-of-document]"), "marker", F.array_join("m", "[SEP]"), F.lit("[SEP]"))
    return grouped.select("family_id", F.size("m").alias("n_members"), (F.col("t") + 2).alias("n_tokens"), document.alias("document"))


class Evaluator:
    """Turns samples into metrics: subclasses implement evaluate()."""

    name = "evaluator"

    def __init__(self, num_samples: int | None = None):
        self.num_samples = num_samples

    def first_samples(self, samples: DataFrame, group: str, order: str) -> DataFrame:
        """The first num_samples of each group; fewer are an error."""
        if self.num_samples is None:
            return samples
        n = F.count("*").over(sampling.Window.partitionBy(group))
        few = F.raise_error(F.concat(F.lit("too few samples in "), F.col(group).cast("string"))).cast("boolean")
        checked = samples.withColumn("_n", n).filter(F.when(F.col("_n") < self.num_samples, few).otherwise(True)).drop("_n")
        return members.capped(checked, group, [order], self.num_samples)

    def evaluate(self, samples: DataFrame, references: DataFrame) -> DataFrame:
        raise NotImplementedError


class LengthEvaluator(Evaluator):
    """Mean length of samples over the mean length of references, by instance."""

    name = "length"

    def evaluate(self, samples: DataFrame, references: DataFrame) -> DataFrame:
        a = samples.groupBy("instance").agg(F.avg(F.length("sequence")).alias("s"))
        b = references.groupBy("instance").agg(F.avg(F.length("sequence")).alias("r"))
        return a.join(b, "instance").select("instance", F.lit("length_ratio").alias("metric"), F.try_divide("s", "r").alias("value"))


def evaluated(evaluators: list[Evaluator], samplers: dict[str, DataFrame], references: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Results (evaluator, sampler, instance, metric, value) of every pair that done does not hold yet."""
    out = None
    for evaluator in evaluators:
        for sampler, samples in samplers.items():
            rows = evaluator.evaluate(samples, references).select(F.lit(evaluator.name).alias("evaluator"), F.lit(sampler).alias("sampler"), "instance", "metric", "value")
            out = rows if out is None else out.unionByName(rows)
    keys = ["evaluator", "sampler", "instance"]
    return out if done is None else done.unionByName(out.join(done.select(*keys).distinct(), keys, "left_anti"))


def agreement(results: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of two samplers' values by evaluator and metric."""
    wide = results.groupBy("evaluator", "metric", "instance").pivot("sampler", [x, y]).agg(F.first("value"))
    return wide.groupBy("evaluator", "metric").agg(correlation(F.col(x), F.col(y)).alias("correlation"))
