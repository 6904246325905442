"""Connected components of an edge table, by local forests and alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import dropped, staged

#: Far above the rounds that any graph of n nodes needs (about the square of log n).
MOST_ROUNDS = 60


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: each node of a partition's edges with the smallest node of its component in the partition."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:  # labels move to smaller ones along edges, then along themselves, until nothing changes
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    for start in range(0, len(nodes), 100_000):
        part = slice(start, start + 100_000)
        yield pa.record_batch([pa.array(nodes[part]), pa.array(nodes[label[part]])], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every end of the edges (a, b).

    Each partition of the edges becomes a forest of stars. Unless these fit together already, a round connects
    every node's larger neighbours to its smallest neighbour (large star), then its smaller ones and itself
    (small star), and makes forests again. The stars are aggregations, and a hub's neighbours are spread over
    tasks. Null ends are ignored; self-loops and repeated edges do no harm; no edges give no rows.
    """

    def settled(df: DataFrame) -> DataFrame:
        return staged(df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().mapInArrow(forest, "a long, b long"), "edges")

    now = settled(edges.filter("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long")))
    for _ in range(MOST_ROUNDS):
        if _is_forest(now):
            break
        both = now.union(now.select("b", "a"))
        # Dealt anew, so that both sides of the joins are plain exchanges, whose large keys are split at run time.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).hint("rebalance")
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(now.filter("a = b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).hint("rebalance")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = settled(small)
        dropped(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node has one component, and every component is a root."""
    up = edges.filter("a <> b")
    ends = up.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(up.select("b", F.lit(0), F.lit(1)))
    sums = ends.distinct().groupBy("x").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    most = up.distinct().groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
    return not sums.filter("up = 1 and down = 1").limit(1).count() and not most.limit(1).count()
