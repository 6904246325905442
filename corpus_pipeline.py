"""Five corpus stages from the documents table to shards, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of docs, the last the shards as well. They
are written as Parquet in the shared folder and reread in turn. Defined cases of every stage: an empty table
gives no rows; further columns pass through, whatever their names; a column that is missing from docs but for
doc_id, text and source is not needed; repeated rows and null ids are said in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import decontaminate, ngram_join, quality_rules, sharding, source_mixing
from lamina.llm.common import staged
from lamina.session import table

#: Near copies share four fifths of their five-word shingles.
NEAR = ngram_join.JaccardJoin(width=5, percent=80)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule of length, symbols, stop words, lines or repetition.

    Null, empty and blank texts have no words and go; every other row is judged by its whole text alone, repeated
    rows each, whatever the id.
    """
    return quality_rules.apply_rules(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies.

    The smallest id stays, null ids last, of equal ids the smallest hash of the text, of rows equal in both one.
    Null, empty and blank texts are like no other: of them only rows equal in id and text go.
    """
    return ngram_join.one_of_each(docs, NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts have no words and stay; repeated rows stay or go together; null and empty items, and an
    empty benchmark, take nothing away.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once or more, by its source's target weight.

    A null source is the one with the empty name; null and empty texts have one token; rows equal in id, source and
    text are passed together; a source alone is passed once; no document is lost.
    """
    return source_mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with all its columns, and its shard and slot.

    Null ids come first, ties by checksum and size; a null text counts no bytes; repeated rows are placed one by
    one. The columns of the shards replace those of the same names.
    """
    return sharding.placed_rows(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no components of near copies at this size; tests/llm holds the whole run against brute force instead.
ORACLE_SQL = None
