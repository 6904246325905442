"""Token ids in ORC files with integer run-length encoding, row indexes and Bloom filters.

Documents are dealt by ranges of doc_id and sorted before they are encoded, so that only texts are
shuffled and each partition writes its stripes once, in ascending doc_id order over all files. ORC keeps
the id lists run-length encoded, with minima and maxima of every 10,000 rows and a Bloom filter on doc_id,
so that readers take stripes in parallel and skip those that cannot hold a document. Defined cases: a null
or empty text is just the end id; null doc_ids come first; rows with equal doc_id follow the order of
their texts, and equal rows are interchangeable; an empty table writes files without rows; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import partitions, running, small_batches, text_batches
from lamina.llm.tokenizing import WordEncoder, encoder, gathered, vocabulary

END_ID = 2
#: Bytes of whole texts encoded at once; a longer text comes alone. Words, ids and their copies take many times this,
#: in each worker and beside the writer's heap, and larger pieces encode no faster.
PIECE_BYTES = 1 << 20
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
#: ORC settings: doc_id filters, rows for each index entry, stripe bytes.
ORC_OPTIONS = {
    "compression": "snappy",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(64 << 20),
}


def token_rows(batches: Iterator[pa.RecordBatch], own: WordEncoder, end_id: int) -> Iterator[pa.RecordBatch]:
    """The rows of one partition's file from its doc_id, text and part, a piece of texts at a time."""
    start = 0
    for batch in gathered(text_batches(batches, 1, PIECE_BYTES), PIECE_BYTES):
        ids, at = own.encode(batch.column(1))
        ids = np.insert(ids, at[1:], end_id)
        at = at + np.arange(len(at))
        sizes = np.diff(at)
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
        columns = [batch.column(0), batch.column(2), pa.array(start + at[:-1]), pa.array(sizes), lists]
        start += int(at[-1])
        yield pa.record_batch(columns, ["doc_id", "part", "start_in_part", "n_tokens", "ids"])


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> str:
    """Encode every text, append end_id, and write the ids below path; returns path."""
    spark = docs.sparkSession
    handle = spark.sparkContext.broadcast(vocabulary(vocabulary_path))  # one vocabulary file of fixed size

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return token_rows(batches, encoder(handle.value), end_id)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(spark), "doc_id", "tie")
    rows = rows.sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("part"))
    with small_batches(spark, PIECE_BYTES):
        rows.mapInArrow(encoded, SCHEMA).write.options(**ORC_OPTIONS).orc(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, from the files."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    offsets = running(totals, "part", "tokens")  # a row for each range partition, a number set by the session
    return rows.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("tokens_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"
    )


def with_checksum(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian 32-bit integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
