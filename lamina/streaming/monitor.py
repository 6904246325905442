"""Monitoring of sample streams with Structured Streaming; every function works on a streaming table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


def sample_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """An unbounded stream of sample files; a checkpointed query resumes where it stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dataset_counts(stream: DataFrame, names: str) -> DataFrame:
    """Samples of each dataset; joined names ('a$b') count for each. Complete output keeps running totals."""
    return stream.select(F.explode(F.split(names, r"\$")).alias("dataset")).groupBy("dataset").agg(F.count("*").alias("samples"))


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each sample once within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, delay: str, size: str) -> DataFrame:
    """An extension: tumbling event-time counts with late data dropped after the delay."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n"))


class GreedyPacker(StatefulProcessor):
    """State of one shard's open batch: its number and its tokens."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "batch long, tokens long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        batch, tokens = self.open.get() if self.open.exists() else (0, 0)
        parts = pd.concat(list(rows)).sort_values("sample_id")
        batches = []
        for n in parts.tokens:
            if tokens and tokens + n > self.capacity:
                batch, tokens = batch + 1, 0
            tokens += n
            batches.append(batch)
        self.open.update((int(batch), int(tokens)))
        yield pd.DataFrame({"shard": key[0], "sample_id": parts.sample_id.to_numpy(), "batch": batches})

    def close(self) -> None:
        pass


#: State of several columns needs the RocksDB store; set this key to this class before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def packed_stream(stream: DataFrame, capacity: int) -> DataFrame:
    """shard, sample_id, batch of stream(shard, sample_id, tokens): a batch closes when the next sample overfills it."""
    return stream.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=GreedyPacker(capacity), outputStructType="shard long, sample_id long, batch long", outputMode="Append", timeMode="None"
    )


def rolling_throughput(updates: DataFrame, key: str, order: str, time: str, total: str, window: int) -> DataFrame:
    """(last - first) / seconds over the last `window` updates, once so many are there.

    updates hold a running total for each key; a falling total is an error.
    """
    rows = Window.partitionBy(key).orderBy(order)
    last_n = rows.rowsBetween(-(window - 1), 0)
    falls = F.lag(total).over(rows) > F.col(total)
    checked = F.when(falls, F.raise_error(F.lit("a running total fell")).cast("double")).otherwise(F.col(total).cast("double"))
    out = updates.withColumn("_n", F.count("*").over(last_n)).withColumn("_total", checked)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    first_time, first_total = F.first(seconds).over(last_n), F.first(F.col("_total")).over(last_n)
    rate = F.try_divide(F.col("_total") - first_total, seconds - first_time)
    return out.withColumn("throughput", F.when(F.col("_n") == window, rate)).drop("_n", "_total")
