"""What the corpus operators share: staging tables, batch size, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of whole texts that a worker takes up at once; a longer text comes alone.
TEXT_BATCH_BYTES = 8 << 20
#: The word separators of the contracts: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, the folder that driver and executors share.

    Where the setting is empty, only a session whose executors run on this machine falls back to a temporary
    folder (tests); on a cluster such a folder would be another one for each executor.
    """
    top = spark.conf.get("spark.checkpoint.dir", "")
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"{tempfile.gettempdir()}/lamina"
    return f"{top.rstrip('/')}/lamina/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session setting for the length of a block; then it is what it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession, most_bytes: int = TEXT_BATCH_BYTES):
    """Arrow batches of few bytes for the plans that run inside the block, so that workers hold little."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage and fixes nondeterministic columns; the table outlives any executor. The shuffle
    files of the write go as soon as it ends.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame | None) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in tables:
        if df is None:
            continue
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(batches: Iterable[pa.RecordBatch], column: int, most_bytes: int = TEXT_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of whole texts, each of at most most_bytes or one row, without copies."""
    for batch in batches:
        texts = batch.column(column)
        if batch.num_rows < 2 or texts.nbytes <= most_bytes:
            yield batch
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(totals: DataFrame, key: str, *sums: str) -> DataFrame:
    """Exclusive prefix sums ({sum}_before), in the order of key, and sums over all ({sum}_all).

    totals has a row for each partition or block, so that its single window stays small.
    """
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return totals.select(
        key,
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_all") for s in sums],
    )


def packed(docs: DataFrame) -> Column:
    """The whole row as a column _row: the operators' own names beside it cannot clash with those inside."""
    return F.struct(*[docs[c] for c in docs.columns]).alias("_row")


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
