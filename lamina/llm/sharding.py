"""Contiguous shards of near-equal byte size, by global prefix sums.

Rows are ordered by doc_id (nulls first; ties by checksum and size, and rows equal in all three are
interchangeable). The order is cut into range partitions; per-partition totals, one row each, give every
partition its offset, and a window inside each partition gives every row its global start. Row r goes to
shard floor(start * shards / total), so that shard sizes differ from the target by less than one document.
Defined cases: a null text counts no bytes (size 8, checksum 0); an empty table gives no rows; repeated
rows are placed one by one; extra columns are ignored. Sizes up to 2**63 / shards bytes in total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import packed, partitions, running, staged

OVERHEAD_BYTES = 8


def assign_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard, and the columns named in carry.

    Only these slim columns are shuffled; name bulky ones in carry only where they must be placed.
    """
    if clash := {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}.intersection(carry):
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        key,
        *carry,
        (F.octet_length(body) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = [key, "text_crc32", "size", "_tie"]
    dealt = slim.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    dealt = staged(dealt.sortWithinPartitions(*order), "shards")

    totals = dealt.groupBy("_part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row for each range partition, a number set by spark.sql.shuffle.partitions: safe to broadcast.
    offsets = running(totals, "_part", "bytes", "rows")
    inside = Window.partitionBy("_part").orderBy(*order)
    placed = dealt.join(F.broadcast(offsets), "_part").select(
        key,
        *carry,
        "size",
        "text_crc32",
        (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("_start"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("_index"),
        "bytes_all",
    )
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"_start * {shards} div bytes_all")).cast("int"))
    # One row for each shard.
    firsts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        key,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_index") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *carry,
    )


def placed_rows(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with all their columns, and size, text_crc32, law, shard, slot and grown_shard.

    The latter replace columns of docs with these names. Whole rows are dealt by ranges of the key and written
    once in that order, as the shards' files would be.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), packed(docs))
    put = assign_shards(slim, shards, "_key", "_text", ("_row",))
    own = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    return put.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in own], *own)
