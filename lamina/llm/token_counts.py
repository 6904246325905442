"""Exact histogram of encoded lengths, and what it answers for every context limit.

Documents are aggregated by their encoded length, the end token included; suffix sums over the distinct
lengths then give, for each limit L in the histogram, the documents and tokens at or above L and the
tokens left when every document is cut to L. Defined cases: a null or empty text is one token long (the
end token); repeated rows count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import running, staged, text_batches
from lamina.llm.tokenizing import encoder, gathered, vocabulary

#: Lengths of one block of the two-level prefix sums.
BLOCK = 128


def encoded_lengths(docs: DataFrame, vocabulary_path: str, text: str = "text", end_tokens: int = 1) -> DataFrame:
    """A row (length) for each document."""
    handle = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))  # one vocabulary file of fixed size

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(handle.value)
        for batch in gathered(text_batches(batches, 0)):
            _, at = own.encode(batch.column(0))
            yield pa.record_batch([pa.array(np.diff(at) + end_tokens, pa.int64())], ["length"])

    return docs.select(F.col(text).alias("text")).mapInArrow(lengths, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """length, n_docs for each distinct length."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def length_answers(counts: DataFrame) -> DataFrame:
    """For each distinct length L: totals below and from L on, tokens when cut to L, and the quantile of L.

    The sums run in two levels, over blocks of lengths and inside each block, so that no task sees more
    than a block's lengths or one row for each block.
    """
    counts = staged(counts, "lengths")  # used twice below; without this the documents would be encoded twice
    rows = counts.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.expr(f"length div {BLOCK}"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
    blocks = running(blocks, "block", "docs", "tokens")
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(blocks, "block").select(
        "length",
        "n_docs",
        "n_tokens",
        (F.col("docs_before") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_below"),
        (F.col("tokens_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("tokens_below"),
        F.col("docs_all").alias("all_docs"),
        F.col("tokens_all").alias("all_tokens"),
    )
    return out.select(
        "length",
        "n_docs",
        "n_tokens",
        (F.col("all_docs") - F.col("docs_below")).alias("docs_from"),
        (F.col("all_tokens") - F.col("tokens_below")).alias("tokens_from"),
        (F.col("tokens_below") + F.col("length") * (F.col("all_docs") - F.col("docs_below"))).alias("tokens_if_cut"),
        F.round((F.col("docs_below") + F.col("n_docs")) / F.col("all_docs"), 9).alias("quantile"),
    )


def answers_at(answers: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any context limits, in one pass over the answers without a join.

    The smallest histogram length at or above the limit decides: tokens_if_cut(limit) = tokens below that
    length + limit * documents from it on; a limit above every length cuts nothing.
    """
    below = F.col("tokens_if_cut") - F.col("length") * F.col("docs_from")
    total = F.max("tokens_if_cut")
    found = []
    for limit in sorted({int(x) for x in limits}):
        at = F.min_by(F.struct(below.alias("below"), F.col("docs_from").alias("docs")), F.when(F.col("length") >= limit, F.col("length")))
        found.append(
            F.struct(
                F.lit(limit).cast("long").alias("limit"),
                F.coalesce(at["docs"], F.lit(0)).alias("docs_from"),
                F.coalesce(at["below"] + limit * at["docs"], total, F.lit(0)).alias("tokens_if_cut"),
            )
        )
    return answers.agg(F.array(*found).alias("found")).select(F.inline("found"))
