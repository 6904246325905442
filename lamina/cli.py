"""Command line: score candidates against an alignment, or generate sequences for it.

    python -m lamina.cli score --prompt X.a3m --candidates V.csv --out scores
    python -m lamina.cli generate --prompt X.fasta --num-samples 10 --out samples
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.residues import parsed
from lamina.operators import alignment, evaluation, generation, scoring
from lamina.session import local_session
from lamina.sources import text_formats


def prompt_rows(spark: SparkSession, path: str) -> DataFrame:
    """msa_id, row_id, aln of an alignment file; rows of unequal length are padded with gaps."""
    rows = text_formats.fasta(text_formats.read_files(spark, path))
    aln = parsed(F.col("sequence"), True, False, True)
    longest = rows.agg(F.max(F.length(aln))).first()[0] or 0
    return rows.select(F.lit("prompt").alias("msa_id"), F.col("seq_idx").alias("row_id"), F.rpad(aln, longest, "-").alias("aln"))


def candidate_rows(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence, DMS_score of a CSV file, or of a FASTA file without insertions; none is an error."""
    if path.endswith(".csv"):
        table = spark.read.option("header", True).csv(path)
        rows = text_formats.candidates_csv(table.withColumn("row", F.monotonically_increasing_id()))
    else:
        records = text_formats.fasta(text_formats.read_files(spark, path))
        rows = records.select(F.col("accession").alias("name"), parsed(F.col("sequence"), False, False, True).alias("sequence"), F.lit(None).cast("double").alias("DMS_score"))
    if not rows.limit(1).count():
        raise ValueError(f"no candidates in {path}")
    return rows


def score(spark: SparkSession, prompt: str, candidates: str, out: str, ensemble: int = 3, context: int = 64, theta: float = 0.2, seed: int = 42) -> dict:
    """Write name, sequence, score (and DMS_score) as CSV and the run's metadata as JSON lines below out."""
    rows = prompt_rows(spark, prompt)
    wanted = candidate_rows(spark, candidates)
    weights = alignment.homology_weights(rows, theta)
    chosen = scoring.contexts(weights, rows, ensemble, context, seed)
    asked = wanted.select(F.lit("prompt").alias("msa_id"), F.col("name").alias("candidate"), F.col("sequence").alias("aln"))
    scores = scoring.score(scoring.ProfileScorer(), chosen, asked).select(F.col("candidate").alias("name"), "score")
    table = wanted.join(scores, "name", "left")
    table.write.mode("overwrite").option("header", True).csv(f"{out}/scores")
    found = evaluation.spearman(table.withColumn("g", F.lit(0)), "g", "score", "DMS_score").first()
    about = {"prompt": prompt, "candidates": candidates, "ensemble": ensemble, "theta": theta, "seed": seed, "spearman": found and found.spearman, "time": time.time()}
    spark.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(f"{out}/metadata")
    return about


def generate(spark: SparkSession, prompt: str, out: str, num_samples: int = 10, seed: int = 42, least_share: float | None = None, least_identity: float | None = None, retries: int = 3) -> int:
    """Write samples as FASTA, named sample_{i}_log_likelihood_{score}; returns how many."""
    made = generation.generate(generation.ProfileSampler(), prompt_rows(spark, prompt), num_samples, str(seed), least_share, least_identity, retries)
    name = F.concat(F.lit("sample_"), F.col("sample_id").cast("string"), F.lit("_log_likelihood_"), F.format_string("%.3f", "score"))
    lines = text_formats.fasta_lines(made, name, F.col("sequence"))
    lines.write.mode("overwrite").text(out)
    return made.count()


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="lamina")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("score")
    two = sub.add_parser("generate")
    for p in (one, two):
        p.add_argument("--prompt", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--seed", type=int, default=42)
    one.add_argument("--candidates", required=True)
    one.add_argument("--ensemble", type=int, default=3)
    one.add_argument("--theta", type=float, default=0.2)
    two.add_argument("--num-samples", type=int, default=10)
    two.add_argument("--least-share", type=float)
    two.add_argument("--least-identity", type=float)
    args = top.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    if args.command == "score":
        print(json.dumps(score(spark, args.prompt, args.candidates, args.out, args.ensemble, theta=args.theta, seed=args.seed)))
    else:
        print(generate(spark, args.prompt, args.out, args.num_samples, args.seed, args.least_share, args.least_identity))


if __name__ == "__main__":
    main()
