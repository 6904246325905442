"""Families as flat member rows and as nested documents, and the set operations on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def length_between(length: Column, least: int | None = None, most: int | None = None) -> Column:
    keep = F.lit(True)
    if least is not None:
        keep = keep & (length >= least)
    if most is not None:
        keep = keep & (length <= most)
    return keep


def standard_only(sequence: Column) -> Column:
    return ~sequence.rlike("[XUZOBJ]")


def nested(rows: DataFrame) -> DataFrame:
    """One row for each family: members in order of member_idx, kept together in one array."""
    members = F.array_sort(F.collect_list(F.struct("member_idx", "accession", "sequence")))
    return rows.groupBy("family_id").agg(members.alias("members"), F.count("*").alias("original_size"))


def flat(documents: DataFrame) -> DataFrame:
    return documents.select("family_id", F.posexplode("members").alias("pos", "m")).select(
        "family_id", F.col("pos").alias("member_idx"), "m.accession", "m.sequence"
    )


def gathered(members: Column, indexes: Column) -> Column:
    """Members at zero-based indexes, all fields together."""
    return F.transform(indexes, lambda i: F.get(members, i.cast("int")))


def truncated_member(members: Column, index: int, length: int) -> Column:
    cut = lambda m: m.withField("sequence", F.substr(m["sequence"], F.lit(1), F.lit(length)))
    return F.transform(members, lambda m, i: F.when(i == index, cut(m)).otherwise(m))


def representative(members: Column, accession: Column) -> Column:
    """The first member with the accession."""
    return F.get(F.filter(members, lambda m: m["accession"] == accession), F.lit(0))


def without_representative(members: Column, accession: Column) -> Column:
    """The members without the first one of that accession."""
    at = F.array_position(F.transform(members, lambda m: m["accession"]), accession)
    return F.filter(members, lambda m, i: i + 1 != at)


def extended(left: Column, right: Column, left_size: Column, right_size: Column) -> tuple[Column, Column]:
    """Members one after the other; the size is known only if both are."""
    return F.concat(left, right), left_size + right_size


def capped(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key in a stable order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def resolved(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """Members joined with their sequences by (file, seq_idx); a missing one is an error."""
    joined = members.join(sequences, ["file", "seq_idx"], "left")
    missing = F.raise_error(F.concat(F.lit("no sequence "), "file", F.lit(":"), F.col("seq_idx").cast("string"))).cast("string")
    return joined.withColumn("sequence", F.when(F.col("sequence").isNull(), missing).otherwise(F.col("sequence")))


def excluded(rows: DataFrame, accessions: DataFrame) -> DataFrame:
    """Rows whose accession is not listed; blank entries are ignored."""
    return rows.join(accessions.filter(F.trim("accession") != "").select("accession").distinct(), "accession", "left_anti")


def with_clusters(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """Members of clusters of two and more; a member without a cluster is its own."""
    joined = rows.join(assigned.dropDuplicates(["accession"]), "accession", "left").withColumn("cluster_id", F.coalesce("cluster_id", "accession"))
    n = F.count("*").over(Window.partitionBy("cluster_id"))
    return joined.withColumn("cluster_size", n).filter(F.col("cluster_size") > 1)


def first_occurrences(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; only order and payload of winners are aggregated."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def relabelled(rows: DataFrame, family: str, label: str, pos: str) -> DataFrame:
    """Labels numbered from 0 in the order in which they are first seen in a family."""
    seen = F.min(pos).over(Window.partitionBy(family, label))
    return rows.withColumn("_seen", seen).withColumn("new_label", F.dense_rank().over(Window.partitionBy(family).orderBy("_seen")) - 1).drop("_seen")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def combined(prompt: DataFrame, generated: DataFrame, group: str, order: str) -> DataFrame:
    """Both tables' rows with role, place (from 0) and generated_start: the prompt's rows come first in each group."""
    both = prompt.withColumn("role", F.lit("prompt")).unionByName(generated.withColumn("role", F.lit("generated")))
    later = F.col("role") == "generated"
    place = F.row_number().over(Window.partitionBy(group).orderBy(later, order)) - 1
    start = F.sum((~later).cast("long")).over(Window.partitionBy(group))
    return both.select("*", place.alias("place"), start.alias("generated_start"))
