"""Deterministic sampling, shuffles, interleaving and shards; randomness is an md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions.residues import uniform


def hash_order(seed: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))


def sampled(rows: DataFrame, n: int, seed: str, group: list[str], key: str) -> DataFrame:
    """n rows of each group, in hash order; without a group, of the table, as a distributed top-n."""
    if not group:
        return rows.orderBy(hash_order(seed, F.col(key)), key).limit(n)
    order = Window.partitionBy(*group).orderBy(hash_order(seed, F.col(key)), key)
    return rows.withColumn("sample_rank", F.row_number().over(order)).filter(F.col("sample_rank") <= n)


def weighted_order(rows: DataFrame, seed: str, group: str, key: str, weight: str, force_first: bool = False) -> DataFrame:
    """rank: weighted sampling without replacement, by -ln(u) / weight; optionally the smallest key comes first."""
    u = F.greatest(uniform(seed, F.col(group), F.col(key)), F.lit(1e-15))
    rows = rows.withColumn("_k", -F.log(u) / F.col(weight))
    order = [F.col("_k"), F.col(key)]
    if force_first:
        rows = rows.withColumn("_first", (F.col(key) != F.min(key).over(Window.partitionBy(group))).cast("int"))
        order = [F.col("_first"), *order]
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return out.drop("_k", "_first")


def block_shuffled(rows: DataFrame, index: str, size: int, seed: str) -> DataFrame:
    """new_pos: blocks in hash order, and rows in hash order inside them, without a total sort.

    Offsets come in two levels: over the first digits of the blocks' hashes, 4,096 rows at most, and over the
    blocks of equal digits; a window inside each block gives the rest.
    """
    block = F.floor(F.col(index) / size).cast("long")
    rows = rows.withColumn("block", block)
    counts = rows.groupBy("block").agg(F.count("*").alias("n")).withColumn("h", hash_order(seed, F.col("block"))).withColumn("top", F.substring("h", 1, 3))
    above = counts.groupBy("top").agg(F.sum("n").alias("m"))
    up_to = Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    above = above.select("top", F.coalesce(F.sum("m").over(up_to), F.lit(0)).alias("above"))
    order = Window.partitionBy("top").orderBy("h", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(F.broadcast(above), "top").select("block", (F.col("above") + F.coalesce(F.sum("n").over(order), F.lit(0))).alias("before"))
    inside = Window.partitionBy("block").orderBy(hash_order(seed, F.col("block"), F.col(index)), index)
    return rows.join(offsets, "block").withColumn("new_pos", F.col("before") + F.row_number().over(inside) - 1).drop("before")


def rolling_files(rows: DataFrame, key: str, per_file: int, seed: str) -> DataFrame:
    """file_no, place: rows in hash order over the whole table, per_file to a file.

    Offsets are over the first digits of the hashes, 4,096 rows at most; a window inside equal digits gives the rest.
    """
    rows = rows.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_top", F.substring("_h", 1, 3))
    up_to = Window.orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_top").agg(F.count("*").alias("_n"))
    above = counts.select("_top", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_above"))
    place = F.col("_above") + F.row_number().over(Window.partitionBy("_top").orderBy("_h", key)) - 1
    out = rows.join(F.broadcast(above), "_top").withColumn("place", place)
    return out.withColumn("file_no", F.expr(f"place div {per_file}")).drop("_h", "_top", "_above")


def write_rolling(rows: DataFrame, path: str, key: str, per_file: int = 10_000, seed: str = "0") -> None:
    """A folder file_no=N of one Parquet file for each per_file rows of the shuffled table; the last may be shorter."""
    out = rolling_files(rows, key, per_file, seed)
    out.repartition("file_no").sortWithinPartitions("file_no", "place").drop("place").write.partitionBy("file_no").parquet(path)


def interleaved(spark, sizes: dict[str, int], weights: dict[str, float], cycle: int, n: int) -> DataFrame:
    """pos, dataset, local_idx of a stream of n: each cycle has round(weight * cycle) slots a dataset.

    The last dataset takes the rest of the cycle, and indexes wrap at the dataset's size. Datasets of no
    weight are skipped. Slots are a table of one row a dataset, matched by range.
    """
    names = [d for d in sizes if weights[d] > 0]
    total = sum(weights[d] for d in names)
    counts = [round(weights[d] / total * cycle) for d in names[:-1]]
    counts.append(cycle - sum(counts))
    low, bounds = 0, []
    for d, c in zip(names, counts, strict=True):
        bounds.append((d, low, low + c, c, sizes[d]))
        low += c
    position = F.col("id")
    slot, turn = F.pmod(position, F.lit(cycle)), F.floor(position / cycle).cast("long")
    dataset, local = F.lit(None).cast("string"), F.lit(None).cast("long")
    for d, lo, hi, c, size in bounds:
        here = (slot >= lo) & (slot < hi)
        dataset = F.when(here, d).otherwise(dataset)
        local = F.when(here, F.pmod(turn * c + slot - lo, F.lit(size))).otherwise(local)
    return spark.range(n).select(position.alias("pos"), dataset.alias("dataset"), local.alias("local_idx"))


def range_lookup(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """points(i) with the bounds(name, lo, hi) row whose lo <= i < hi; a row for each file or dataset."""
    return points.join(F.broadcast(bounds), (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")))


def round_robin(pos: Column, world: int) -> Column:
    return F.pmod(pos, F.lit(world))


def shard_floor(i: Column, n: Column, shards: int) -> Column:
    """Shards of floor(n / shards) items; the last takes the rest."""
    size = F.greatest(F.floor(n / shards), F.lit(1))
    return F.least(F.floor(i / size), F.lit(shards - 1)).cast("int")


def shard_balanced(i: Column, n: Column, shards: int) -> Column:
    """Shard k has the items from k * n // shards on."""
    return F.floor(((i + 1) * shards - 1) / n).cast("int")


def shard_ceiling(i: Column, n: Column, shards: int) -> Column:
    """Shards of n // shards + 1 items."""
    return F.floor(i / (F.floor(n / shards) + 1)).cast("int")


def held_out(rows: DataFrame, n: int, first: int, seed: str, key: str) -> DataFrame:
    """split: of the n first keys in hash order, `first` are val and the others test; the rest is train.

    Only the keys up to n are ordered (a top-n), not the table.
    """
    chosen = rows.select(key).distinct().orderBy(hash_order(seed, F.col(key)), key).limit(n)
    numbered = chosen.withColumn("_rn", F.row_number().over(Window.orderBy(hash_order(seed, F.col(key)), key)))
    marks = numbered.select(key, F.when(F.col("_rn") <= first, "val").otherwise("test").alias("split"))
    return rows.join(F.broadcast(marks), key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def nucleus(rows: DataFrame, group: str, token: str, p: str, top: float) -> DataFrame:
    """The most probable tokens while their sum is at most `top`, at least one, renormalised."""
    order = Window.partitionBy(group).orderBy(F.desc(p), token)
    so_far = F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("_s", so_far).withColumn("_rn", F.row_number().over(order)).filter((F.round("_s", 9) <= top) | (F.col("_rn") == 1))
    return kept.withColumn("renormalised", F.col(p) / F.sum(p).over(Window.partitionBy(group))).drop("_s", "_rn")
