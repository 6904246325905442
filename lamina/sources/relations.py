"""The tables that stand for sequence families and alignments in the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.session import table


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family_id, member_idx, accession, doc_id, sequence, seq_len: the letters of every whole document."""
    docs = table(spark, sf_dir, "documents")
    order = Window.partitionBy("source", "lang").orderBy("doc_id")
    rows = docs.select(
        F.concat_ws("_", "source", "lang").alias("family_id"),
        (F.row_number().over(order) - 1).alias("member_idx"),
        F.concat(F.lit("D"), "doc_id").alias("accession"),
        "doc_id",
        F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"),
    )
    return rows.withColumn("seq_len", F.length("sequence"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequences() without the sequences: no payload is shuffled."""
    docs = table(spark, sf_dir, "documents").select(
        "source", "lang", "doc_id", F.length(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq_len")
    )
    order = Window.partitionBy("source", "lang").orderBy("doc_id")
    return docs.select(
        F.concat_ws("_", "source", "lang").alias("family_id"),
        (F.row_number().over(order) - 1).alias("member_idx"),
        F.concat(F.lit("D"), "doc_id").alias("accession"),
        "doc_id",
        "seq_len",
    )


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msa_id, row_id, aln: one alignment for each brand, each part a row of its whole name and type."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_type")
    name, kind = parts.agg(F.max(F.length("p_name")), F.max(F.length("p_type"))).first()

    def residues(c: str, n: int):
        return F.rpad(F.upper(F.regexp_replace(c, "[^A-Za-z]", "-")), n or 0, "-")

    return parts.select(
        F.col("p_brand").alias("msa_id"), F.col("p_partkey").alias("row_id"), F.concat(residues("p_name", name), residues("p_type", kind)).alias("aln")
    )


def cells(rows: DataFrame) -> DataFrame:
    """An alignment as a sparse table: msa_id, row_id, col, token (gaps included)."""
    return rows.select("msa_id", "row_id", F.posexplode(F.split("aln", "")).alias("col", "token"))
