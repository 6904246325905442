"""Packing examples into batches, batch labels and padding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions import residues as R
from lamina.functions.residues import IGNORE, PAD


def greedy_bins(rows: DataFrame, capacity: int, shard: str, order: str, tokens: str) -> DataFrame:
    """rows with bin_id: a bin closes when the next example would overfill it; oversize examples are left out.

    The state is one running total for each shard, so that a partition streams in order: rows are dealt by
    shard and sorted, and no shard is held in memory.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, number = None, 0, -1
        for batch in batches:
            bins = []
            for at, size in zip(batch.column("_shard").to_pylist(), batch.column("_tokens").to_pylist(), strict=True):
                if at != now:
                    now, total, number = at, 0, -1
                if size is None or size > capacity:
                    total = capacity + 1  # the open bin closes before an oversize example
                    bins.append(None)
                    continue
                if number < 0 or total + size > capacity:
                    total, number = 0, number + 1
                total += size
                bins.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(bins, pa.int64())], [*batch.schema.names[:-2], "bin_id"])

    keyed = rows.withColumn("_shard", F.col(shard)).withColumn("_tokens", F.col(tokens).cast("long"))
    dealt = keyed.repartition(F.col("_shard")).sortWithinPartitions("_shard", order)
    schema = rows.schema.add("bin_id", "long")
    return dealt.mapInArrow(pack, schema).filter("bin_id is not null")


def split_bins(rows: DataFrame, capacity: int, shard: str, order: str, tokens: str, key: str, overhang: int = 10) -> DataFrame:
    """shard, key, bin_id, start, n_tokens: as greedy_bins, but an example that overhangs is split.

    If at least `overhang` tokens of room are left, the prefix fills the bin, and the rest goes on in the
    next bin behind a new start token; an example may fill several bins.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, number = None, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for at, name, size in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if at != now:
                    now, total, number = at, 0, 0
                start, left, again = 0, size or 0, 0
                while left > 0:
                    room = capacity - total - again
                    if left <= room:
                        out.append((at, name, number, start, left + again))
                        total += left + again
                        break
                    if room >= overhang:
                        out.append((at, name, number, start, room + again))
                        start, left = start + room, left - room
                        again = 1
                    total, number = 0, number + 1
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(columns[i], pa.int64()) for i in range(5)], ["shard", "key", "bin_id", "start", "n_tokens"])

    slim = rows.select(F.col(shard).cast("long").alias("shard"), F.col(key).cast("long").alias("key"), F.col(tokens).cast("long").alias("n"), F.col(order).alias("o"))
    dealt = slim.repartition("shard").sortWithinPartitions("shard", "o").drop("o")
    return dealt.mapInArrow(pack, "shard long, key long, bin_id long, start long, n_tokens long")


def packed_examples(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each bin: ids joined in order, identifiers by '-', mean original size, number of examples."""
    parts = F.array_sort(F.collect_list(F.struct(order, "identifier", "input_ids")))
    out = rows.groupBy(*keys).agg(parts.alias("p"), F.avg("original_size").alias("original_size"), F.count("*").alias("batch_size"))
    return out.select(
        *keys,
        F.flatten(F.transform("p", lambda x: x["input_ids"])).alias("input_ids"),
        F.array_join(F.transform("p", lambda x: x["identifier"]), "-").alias("identifier"),
        "original_size",
        "batch_size",
    )


def taken_while(rows: DataFrame, capacity: int, key: str, order: str, tokens: str) -> DataFrame:
    """The first example of each batch, then those that fit (<=) until one does not."""
    w = Window.partitionBy(key).orderBy(order)
    so_far = F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("so_far", so_far).withColumn("_rn", F.row_number().over(w)).filter((F.col("_rn") == 1) | (F.col("so_far") <= capacity)).drop("_rn")


def padded_ids(ids: Column, longest: Column, value: int = 0) -> Column:
    """Ids padded to the batch's longest. Collation pads with 0, completions with the pad token."""
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(0), longest - F.size(ids))))


def assembled(rows: DataFrame, batch: str, marker: int = R.RAW_DOC) -> DataFrame:
    """prompt_ids and completion_ids of rows (context: array of sequences, completion); completions are padded to the batch's longest."""
    ids = rows.withColumn("prompt_ids", R.prompt_ids(F.col("context"), marker, True))
    ids = ids.withColumn("completion_ids", R.completion_ids(F.col("completion"), F.col("context"), marker, True))
    longest = F.max(F.size("completion_ids")).over(Window.partitionBy(batch))
    return ids.withColumn("completion_ids", padded_ids(F.col("completion_ids"), longest, R.PAD))


def labels(ids: Column, gap_id: int | None = None, mask_id: int | None = None) -> Column:
    """Ids with pads, and if asked gaps and masks, ignored."""
    ignored = [PAD, *([gap_id] if gap_id is not None else []), *([mask_id] if mask_id is not None else [])]
    return F.transform(ids, lambda x: F.when(x.isin(*ignored), F.lit(IGNORE)).otherwise(x))


def flattened(lists: Column) -> tuple[Column, Column, Column]:
    """Joined ids, positions that restart with each example, and labels whose first token is ignored."""
    ids = F.flatten(lists)
    positions = F.flatten(F.transform(lists, lambda x: F.transform(x, lambda _, i: i)))
    marks = F.flatten(F.transform(lists, lambda x: F.transform(x, lambda v, i: F.when(i == 0, F.lit(IGNORE)).otherwise(v))))
    return ids, positions, marks


def fixed_batches(rows: DataFrame, size: int, shard: str, order: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(shard).orderBy(order)) - 1
    return rows.withColumn("batch_id", F.floor(number / size).cast("long"))


def positions_in_document(tokens: DataFrame, key: str, pos: str, is_start: Column) -> DataFrame:
    """Position from the last document start; tokens before the first start have none."""
    last = F.max(F.when(is_start, F.col(pos))).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return tokens.withColumn("doc_pos", F.col(pos) - last)


def accumulation_steps(target: Column, tokens: Column, batch: Column, devices: Column) -> Column:
    return F.ceil(target / (tokens * batch * devices)).cast("long")
