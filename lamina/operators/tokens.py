"""Token tables: document and sequence numbers, accuracy and length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions.residues import IGNORE


def numbered(tokens: DataFrame, key: str, pos: str, is_start: Column, is_separator: Column) -> DataFrame:
    """doc_no: starts so far; seq_no: separators before the token, counted from the document's start."""
    so_far = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    rows = tokens.withColumn("doc_no", F.sum(is_start.cast("int")).over(so_far))
    rows = rows.withColumn("_seps", F.coalesce(F.sum(is_separator.cast("int")).over(before), F.lit(0)))
    return rows.withColumn("seq_no", F.col("_seps") - F.min("_seps").over(Window.partitionBy(key, "doc_no"))).drop("_seps")


def accuracy(tokens: DataFrame, key: str, dataset: str) -> DataFrame:
    """dataset, all, first and last sequence accuracy over tokens(label, prediction, doc_no, seq_no).

    Ignored labels do not count. The last sequence is the largest number, or the one before if the
    document's final label is ignored. The row with a null dataset is over all of them.
    """
    doc = Window.partitionBy(key, "doc_no")
    final = F.max_by("label", "pos").over(doc)
    last = F.max("seq_no").over(doc) - F.when(final == IGNORE, 1).otherwise(0)
    rows = tokens.withColumn("_last", last).filter(F.col("label") != IGNORE).withColumn("_hit", (F.col("label") == F.col("prediction")).cast("double"))
    return rows.rollup(dataset).agg(
        F.round(F.avg("_hit"), 9).alias("global_accuracy"),
        F.round(F.avg(F.when(F.col("seq_no") == 0, F.col("_hit"))), 9).alias("first_accuracy"),
        F.round(F.avg(F.when(F.col("seq_no") == F.col("_last"), F.col("_hit"))), 9).alias("last_accuracy"),
    )


def run_lengths(tokens: DataFrame, key: str, pos: str, is_separator: Column) -> DataFrame:
    """Lengths of the runs before each separator; the first is the first separator's position."""
    seps = tokens.filter(is_separator)
    before = F.lag(pos).over(Window.partitionBy(key).orderBy(pos))
    return seps.withColumn("run", F.when(before.isNull(), F.col(pos)).otherwise(F.col(pos) - before - 1))


def length_statistics(runs: DataFrame, key: str) -> DataFrame:
    return runs.groupBy(key).agg(F.min("run").alias("min_len"), F.max("run").alias("max_len"), F.round(F.avg("run"), 9).alias("mean_len"))


def masked_mean(value: Column, keep: Column) -> Column:
    """Sum over kept tokens by their number, which counts as at least 1."""
    return F.sum(F.when(keep, value).otherwise(0.0)) / F.greatest(F.sum(keep.cast("int")), F.lit(1))


def training_metrics(tokens: DataFrame, batch: str, is_start: Column, is_separator: Column, loss: str) -> DataFrame:
    return tokens.groupBy(batch).agg(
        F.count("*").alias("tokens"),
        F.sum(is_separator.cast("int")).alias("separators"),
        F.sum(is_start.cast("int")).alias("documents"),
        F.round(F.exp(F.avg(loss)), 9).alias("perplexity"),
    )


def structure_share(tokens: DataFrame, key: str, is_structure: Column, has_coordinates: Column) -> DataFrame:
    have = F.sum((is_structure & has_coordinates).cast("int"))
    return tokens.groupBy(key).agg(F.round(F.try_divide(have, F.sum(is_structure.cast("int"))), 9).alias("with_coordinates"))
