"""Temperature mixing of sources, realised as budgeted block permutations.

Token shares p of the sources are raised to an exponent and normalised; the exponent is bisected until the
mix meets a target entropy, or until no source is passed more often than a limit while the least repeated
source is passed once. A source then gets its whole number of passes, and a last pass of part of its
tokens. Each pass permutes the source's blocks by hash and the documents in each block by hash; the last
pass takes blocks in that order up to its budget and cuts the block at the border. Tokens are words plus
one for the document's end. Defined cases: a null source is the source with the empty name; null and empty
texts have one token; equal rows (id and text) are taken together; one source alone is passed once; an
empty table gives no rows; extra columns are passed through by mixed().
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import SPACES, packed, staged


#: Slices of the order of a source's blocks.
SLICES = 4096


@dataclass(frozen=True)
class Mix:
    """Give target_entropy (nats) or most_passes; block_docs documents make a block.

    With budget_tokens the whole mix has that many tokens, to within a document a source; else the least
    repeated source is passed once.
    """

    most_passes: float = 1.5
    target_entropy: float | None = None
    budget_tokens: int | None = None
    block_docs: int = 4096
    seed: str = "mix"


def tokens(text: str = "text") -> Column:
    """Words of the text, and one for its end."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), rf"^{SPACES}|{SPACES}$", "")
    return F.when(body == "", F.lit(1)).otherwise(F.size(F.split(body, SPACES)) + 1).cast("long")


def _fraction(*parts: Column) -> Column:
    """Eight hex digits of an md5 as a number; the same in other engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def units(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """source, doc_id, text_key, copies and n_tokens (of all copies) of every distinct row."""
    rows = docs.select(
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.col(key).cast("long").alias("doc_id"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_key"),
        tokens(text).alias("n_tokens"),
    )
    return rows.groupBy("source", "doc_id", "text_key").agg(F.count("*").alias("copies"), F.sum("n_tokens").alias("n_tokens"))


def exponent(sources: DataFrame, mix: Mix) -> float:
    """The bisected exponent in [0, 1] over sources(share); only sums over all sources reach the driver."""
    if mix.target_entropy is None:
        low, high = sources.agg(F.min("share"), F.max("share")).first()
        if low is None:
            return 1.0

        def too_flat(alpha: float) -> bool:
            return (high / low) ** (1 - alpha) > mix.most_passes
    else:

        def too_flat(alpha: float) -> bool:
            w = F.pow("share", F.lit(alpha))
            total, spread = sources.agg(F.sum(w), F.sum(w * F.log(w))).first()
            return bool(total) and math.log(total) - spread / total > mix.target_entropy

    if not too_flat(0.0):
        return 0.0
    low_alpha, high_alpha = 0.0, 1.0
    for _ in range(48 if mix.target_entropy is None else 30):
        middle = (low_alpha + high_alpha) / 2
        low_alpha, high_alpha = (middle, high_alpha) if too_flat(middle) else (low_alpha, middle)
    return high_alpha


def source_plan(parts: DataFrame, mix: Mix) -> DataFrame:
    """source, n_docs, n_tokens, share, weight, passes (rounded to 6 digits), n_blocks, a row for each source."""
    totals = staged(parts.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "sources")
    everything = totals.agg(F.sum("n_tokens")).first()[0] or 1
    shares = totals.withColumn("share", F.col("n_tokens") / F.lit(float(everything)))
    alpha = exponent(shares, mix)
    raised = shares.withColumn("raised", F.pow("share", F.lit(alpha)))
    total, least = raised.agg(F.sum("raised"), F.min(F.col("raised") / F.col("share"))).first()
    if mix.budget_tokens is None:
        passes = F.col("raised") / F.col("share") / F.lit(least or 1.0)
    else:
        passes = F.col("raised") / F.lit(total or 1.0) * F.lit(float(mix.budget_tokens)) / F.col("n_tokens")
    return raised.select(
        "source",
        "n_docs",
        "n_tokens",
        F.round("share", 9).alias("share"),
        F.round(F.col("raised") / F.lit(total or 1.0), 9).alias("weight"),
        F.round(passes, 6).alias("passes"),
        F.ceil(F.col("n_docs") / F.lit(mix.block_docs)).cast("long").alias("n_blocks"),
    )


def schedule(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """source, doc_id, text_key, copies, n_tokens, weight, pass, block_rank and slot of every pass of every document."""
    parts = staged(units(docs, key, source, text), "units")
    plan = staged(source_plan(parts, mix), "plan")
    seed = F.lit(mix.seed)
    whole = F.floor("passes").cast("long")
    rest = F.round((F.col("passes") - F.floor("passes")) * F.col("n_tokens")).cast("long")
    rates = plan.select("source", "weight", whole.alias("whole"), rest.alias("rest"), "n_blocks")
    rows = parts.join(rates, "source").withColumn(
        "block", F.pmod(_fraction(seed, F.lit("block"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_key")), F.col("n_blocks"))
    )
    blocks = staged(rows.groupBy("source", "block", "whole", "rest").agg(F.sum("n_tokens").alias("block_tokens")), "blocks")
    last = (F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0)).cast("long")
    blocks = blocks.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    # The order of a source's blocks in two levels: slices of the hash's range, at most SLICES rows a window,
    # and the blocks of a slice. A source of any size is spread over its slices.
    blocks = blocks.withColumn("at", _fraction(seed, F.col("source"), F.col("pass").cast("string"), F.col("block").cast("string")))
    blocks = blocks.withColumn("slice", F.expr(f"at div {(1 << 32) // SLICES}"))
    slices = blocks.groupBy("source", "pass", "slice").agg(F.count("*").alias("slice_blocks"), F.sum("block_tokens").alias("slice_tokens"))
    before = Window.partitionBy("source", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        "source", "pass", "slice", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("slice_blocks", "slice_tokens")]
    )
    order = Window.partitionBy("source", "pass", "slice").orderBy("at", "block")
    blocks = blocks.join(slices, ["source", "pass", "slice"]).select(
        "source",
        "block",
        "pass",
        (F.col("slice_blocks_before") + F.row_number().over(order) - 1).cast("long").alias("block_rank"),
        (F.col("slice_tokens_before") + F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")).alias("tokens_before"),
    )
    passes = rows.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    inside = Window.partitionBy("source", "block", "pass").orderBy(
        _fraction(seed, F.lit("slot"), F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_key")),
        "doc_id",
        "text_key",
    )
    passes = passes.withColumn("slot", (F.row_number().over(inside) - 1).cast("long")).withColumn(
        "in_block", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    )
    taken = passes.join(blocks, ["source", "block", "pass"]).filter(
        (F.col("pass") <= F.col("whole")) | (F.col("tokens_before") + F.col("in_block") < F.col("rest"))
    )
    return taken.select("source", "doc_id", "text_key", "copies", "n_tokens", "weight", F.col("pass").alias("pass_no"), "block_rank", "slot")


def mixed(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, each as often as the schedule passes it."""
    times = schedule(docs, mix, key, source, text).groupBy("source", "doc_id", "text_key").agg(F.count("*").cast("int").alias("__times"))
    times = times.select(F.col("source").alias("__source"), F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__times")
    own = docs.select(
        packed(docs), F.col(key).cast("long").alias("_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("_source")
    )
    same = own["_id"].eqNullSafe(times["__id"]) & (own["_key"] == times["__key"]) & (own["_source"] == times["__source"])
    return own.join(times, same).withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("_row.*")
