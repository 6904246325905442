"""Alignment statistics on the sparse cell table (msa_id, row_id, col, token)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lamina.functions.statistics import correlation
from lamina.sources.relations import cells


def distinct_rows(rows: DataFrame) -> DataFrame:
    """msa_id, aln, copies: equal rows once; pair counts need no row for each copy."""
    return rows.groupBy("msa_id", "aln").agg(F.count("*").alias("copies"), F.min("row_id").alias("row_id"))


def shared_tokens(rows: DataFrame, gaps: bool) -> DataFrame:
    """msa_id, a, b, n: equal columns of every pair of rows that has one (a row with itself as well).

    Rows meet on (alignment, column, token), so that unlike rows are never paired.
    """
    long = cells(rows) if gaps else cells(rows).filter("token <> '-'")
    a, b = long.withColumnRenamed("row_id", "a"), long.withColumnRenamed("row_id", "b")
    return a.join(b, ["msa_id", "col", "token"]).groupBy("msa_id", "a", "b").agg(F.count("*").alias("n"))


def best_similarity(samples: DataFrame, prompts: DataFrame) -> DataFrame:
    """msa_id, row_id, best: each sample's largest share of equal residues with a prompt row.

    Equal non-gap columns over the larger ungapped length, 0 without any. Samples and prompts meet on equal
    cells, prompts once for each distinct row.
    """

    def residues(rows: DataFrame) -> Column:
        return F.length(F.replace("aln", F.lit("-"), F.lit("")))

    unlike = distinct_rows(prompts).select("msa_id", F.col("row_id").alias("prompt"), "aln")
    a = cells(samples).filter("token <> '-'")
    b = cells(unlike.withColumnRenamed("prompt", "row_id")).filter("token <> '-'").withColumnRenamed("row_id", "prompt")
    shared = a.join(b, ["msa_id", "col", "token"]).groupBy("msa_id", "row_id", "prompt").agg(F.count("*").alias("n"))
    shared = shared.join(unlike.select("msa_id", "prompt", residues(unlike).alias("lp")), ["msa_id", "prompt"])
    sizes = samples.select("msa_id", "row_id", residues(samples).alias("ls"))
    best = shared.join(sizes, ["msa_id", "row_id"]).groupBy("msa_id", "row_id").agg(F.max(F.col("n") / F.greatest("ls", "lp")).alias("best"))
    return sizes.join(best, ["msa_id", "row_id"], "left").select("msa_id", "row_id", F.coalesce("best", F.lit(0.0)).alias("best"))


#: Rows of an alignment that a task compares, on each side.
BLOCK_ROWS = 512


def block_values(distinct: DataFrame, gaps: bool, value: Callable, kind: str, fold: Callable[[str], Column]) -> DataFrame:
    """msa_id, row_id, n: fold over blocks of value(equal columns, own size, sizes, copies, is the row) for each row.

    distinct(msa_id, row_id, aln, copies). A row's size is its columns, or its residues where gaps do not count.
    Rows are dealt to blocks, each two blocks of an alignment meet in a task as byte matrices, and only values
    of single rows leave it: no pair of rows is ever a row.
    """
    kinds = dict(distinct.dtypes)
    blocks = distinct.groupBy("msa_id").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = distinct.join(blocks, "msa_id").withColumn("own", F.pmod(F.xxhash64("row_id", "aln"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("msa_id", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "row_id", "aln", "copies")

    def counted(table: pa.Table) -> pa.Table:
        texts = table.column("aln").to_pylist()
        width = max(map(len, texts))
        codes = np.zeros((len(texts), width), dtype=np.uint32)  # 0 stands for no column
        for i, text in enumerate(texts):
            codes[i, : len(text)] = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        counts = codes != 0 if gaps else (codes != 0) & (codes != ord("-"))
        sizes, copies = counts.sum(axis=1), table.column("copies").to_numpy()
        left = table.column("own").to_numpy() == table.column("x").to_numpy()
        sides = [(np.flatnonzero(left), np.flatnonzero(~left)), (np.flatnonzero(~left), np.flatnonzero(left))]
        if left.all():
            sides = [(np.arange(len(texts)), np.arange(len(texts)))]
        n = np.zeros(len(texts), dtype=np.int64 if kind == "long" else float)
        for mine, theirs in sides:
            others, weights = codes[theirs], copies[theirs]
            for i in mine.tolist():
                equal = ((others == codes[i]) & counts[i]).sum(axis=1)
                n[i] = value(equal, sizes[i], sizes[theirs], weights, theirs == i)
        return pa.table([table.column("msa_id"), table.column("row_id"), pa.array(n)], ["msa_id", "row_id", "n"])

    found = rows.groupBy("msa_id", "x", "y").applyInArrow(counted, f"msa_id {kinds['msa_id']}, row_id {kinds['row_id']}, n {kind}")
    return found.groupBy("msa_id", "row_id").agg(fold("n").alias("n"))


def neighbour_counts(distinct: DataFrame, gaps: bool, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """msa_id, row_id, n: the copies of the rows that near(equal columns, own size) accepts for each row."""
    return block_values(distinct, gaps, lambda equal, size, _sizes, copies, _own: copies[near(equal, size)].sum(), "long", F.sum)


def best_among(rows: DataFrame) -> DataFrame:
    """msa_id, row_id, best: each row's largest share of equal residues with another row; null if it is alone.

    Equal non-gap columns over the larger ungapped length, 0 without any; a copy is another row.
    """

    def largest(equal, size, sizes, copies, own):
        share = equal / np.maximum(np.maximum(size, sizes), 1)
        share = share[~own | (copies > 1)]
        return share.max() if len(share) else -1.0

    distinct = distinct_rows(rows)
    found = distinct.join(block_values(distinct, False, largest, "double", F.max), ["msa_id", "row_id"]).select("msa_id", "aln", "n")
    return rows.join(found, ["msa_id", "aln"]).select("msa_id", "row_id", F.when(F.col("n") >= 0, F.col("n")).alias("best"))


def pairwise_summary(rows: DataFrame) -> DataFrame:
    """msa_id, rows, mean_identity, mean_distance, mean_gaps over all pairs i < j, copies included.

    A column token of n rows is equal in n (n - 1) / 2 pairs, so that token counts give the means and no pairs
    are formed. The first two means are null for a single row.
    """
    counts = cells(rows).groupBy("msa_id", "col", "token").agg(F.count("*").cast("double").alias("n"))
    sums = counts.groupBy("msa_id").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"), F.sum(F.when(F.col("token") == "-", F.col("n")).otherwise(0.0)).alias("gaps"))
    sizes = rows.groupBy("msa_id").agg(F.count("*").alias("rows"), F.max(F.length("aln")).alias("l"))
    each = F.try_divide(F.col("same"), F.col("rows") * (F.col("rows") - 1) / 2)
    return sizes.join(sums, "msa_id").select(
        "msa_id", "rows", (each / F.col("l")).alias("mean_identity"), (F.col("l") - each).alias("mean_distance"), (F.col("gaps") / F.col("rows")).alias("mean_gaps")
    )


def homology_weights(rows: DataFrame, theta: float) -> DataFrame:
    """msa_id, row_id, neighbours, weight, p, n_eff; a row with only gaps is its copies' neighbour alone.

    A row's neighbours are the rows whose distance, one minus equal residues over the row's own residues,
    is at most theta; the row itself counts. Copies are collapsed before they meet.
    """

    def near(equal: np.ndarray, size: int) -> np.ndarray:
        return 1 - equal / size <= theta if size else np.zeros(len(equal), dtype=bool)

    distinct = distinct_rows(rows)
    counts = neighbour_counts(distinct, False, near)
    counts = distinct.hint("merge").join(counts, ["msa_id", "row_id"]).select("msa_id", "aln", F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("copies")).alias("neighbours"))
    out = rows.hint("merge").join(counts, ["msa_id", "aln"]).withColumn("weight", 1 / F.col("neighbours"))
    total = F.sum("weight").over(Window.partitionBy("msa_id"))
    return out.select("msa_id", "row_id", "neighbours", "weight", (F.col("weight") / total).alias("p"), total.alias("n_eff"))


def strict_weights(rows: DataFrame, identity: float = 0.8) -> DataFrame:
    """msa_id, row_id, weight: one over the rows that share strictly more than that of all columns, gaps included."""
    distinct = distinct_rows(rows)
    counts = neighbour_counts(distinct, True, lambda equal, size: equal / size > identity if size else equal < 0)
    named = distinct.join(counts, ["msa_id", "row_id"]).select("msa_id", "aln", F.when(F.col("n") > 0, 1 / F.col("n")).alias("weight"))
    return rows.join(named, ["msa_id", "aln"]).select("msa_id", "row_id", "weight")


def effective_size(weights: DataFrame) -> DataFrame:
    return weights.groupBy("msa_id").agg(F.sum("weight").alias("meff"))


def column_frequencies(long: DataFrame, alphabet: DataFrame, alpha: float = 0.0) -> DataFrame:
    """msa_id, col, token, frequency for every token of alphabet(msa_id, token), mixed with alpha / tokens.

    long(msa_id, col, token, weight)
    """
    counts = long.groupBy("msa_id", "col", "token").agg(F.sum("weight").alias("w"))
    totals = counts.groupBy("msa_id", "col").agg(F.sum("w").alias("total"))
    tokens = alphabet.withColumn("k", F.count("*").over(Window.partitionBy("msa_id")))
    dense = totals.join(tokens, "msa_id").join(counts, ["msa_id", "col", "token"], "left")
    f = F.coalesce(F.col("w") / F.col("total"), F.lit(0.0))
    return dense.select("msa_id", "col", "token", ((1 - alpha) * f + alpha / F.col("k")).alias("frequency"))


def pair_frequencies(long: DataFrame) -> DataFrame:
    """msa_id, i, x, j, y, frequency, covariance for columns i < j and tokens seen together.

    long(msa_id, row_id, col, token, weight). Rows of an alignment meet on their id, and copies should be
    collapsed into weights first: the cells are columns squared by tokens squared.
    """
    a = long.select("msa_id", "row_id", F.col("col").alias("i"), F.col("token").alias("x"), "weight")
    b = long.select("msa_id", "row_id", F.col("col").alias("j"), F.col("token").alias("y"))
    both = a.join(b, ["msa_id", "row_id"]).filter("i < j").groupBy("msa_id", "i", "x", "j", "y").agg(F.sum("weight").alias("w"))
    single = long.groupBy("msa_id", "col", "token").agg(F.sum("weight").alias("w"))
    single = single.withColumn("f", F.col("w") / F.sum("w").over(Window.partitionBy("msa_id", "col"))).drop("w")
    total = long.select("msa_id", "row_id", "weight").distinct().groupBy("msa_id").agg(F.sum("weight").alias("total"))
    left = single.select("msa_id", F.col("col").alias("i"), F.col("token").alias("x"), F.col("f").alias("fi"))
    right = single.select("msa_id", F.col("col").alias("j"), F.col("token").alias("y"), F.col("f").alias("fj"))
    rows = both.join(total, "msa_id").join(left, ["msa_id", "i", "x"]).join(right, ["msa_id", "j", "y"])
    f = F.col("w") / F.col("total")
    return rows.select("msa_id", "i", "x", "j", "y", f.alias("frequency"), (f - F.col("fi") * F.col("fj")).alias("covariance"))


def column_entropy(long: DataFrame, columns: DataFrame) -> DataFrame:
    """msa_id, col, depth, entropy (nats, null at depth 0) over non-gap tokens, for every column of columns(msa_id, col)."""
    counts = long.filter("token <> '-'").groupBy("msa_id", "col", "token").agg(F.count("*").alias("n"))
    counts = counts.withColumn("depth", F.sum("n").over(Window.partitionBy("msa_id", "col"))).withColumn("p", F.col("n") / F.col("depth"))
    entropy = counts.groupBy("msa_id", "col").agg(F.max("depth").alias("depth"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"))
    return columns.join(entropy, ["msa_id", "col"], "left").select("msa_id", "col", F.coalesce("depth", F.lit(0)).alias("depth"), "entropy")


def entropy_correlation(first: DataFrame, second: DataFrame, least_depth: int = 10) -> DataFrame:
    """msa_id, columns, correlation of two entropy tables over the columns that are deep in both."""
    a = first.select("msa_id", "col", F.col("depth").alias("da"), F.col("entropy").alias("ea"))
    b = second.select("msa_id", "col", F.col("depth").alias("db"), F.col("entropy").alias("eb"))
    rows = a.join(b, ["msa_id", "col"]).filter((F.col("da") >= least_depth) & (F.col("db") >= least_depth))
    r = F.when((F.count("*") > 1) & (F.stddev_pop("ea") > 1e-12) & (F.stddev_pop("eb") > 1e-12), correlation(F.col("ea"), F.col("eb")))
    return rows.groupBy("msa_id").agg(F.count("*").alias("columns"), r.alias("correlation"))


def divergences(natural: DataFrame, generated: DataFrame, least_depth: int = 10, pseudocount: float = 1e-9, mass: float = 2.0) -> DataFrame:
    """msa_id, columns, js, kl_symmetric, kl_smoothed: means over the columns that are deep in both.

    Arguments are counts(msa_id, col, token, n) without gaps. Counts over the union of tokens get the
    pseudocount; the smoothed divergence adds `mass` evenly over the natural column's tokens instead.
    """
    a = natural.withColumn("ta", F.sum("n").over(Window.partitionBy("msa_id", "col"))).filter(F.col("ta") >= least_depth)
    b = generated.withColumn("tb", F.sum("n").over(Window.partitionBy("msa_id", "col"))).filter(F.col("tb") >= least_depth)
    a, b = a.withColumnRenamed("n", "na"), b.withColumnRenamed("n", "nb")
    both = a.select("msa_id", "col").distinct().join(b.select("msa_id", "col").distinct(), ["msa_id", "col"])
    rows = both.join(a.join(b, ["msa_id", "col", "token"], "full"), ["msa_id", "col"])
    column = Window.partitionBy("msa_id", "col")
    na, nb = F.coalesce("na", F.lit(0)) + pseudocount, F.coalesce("nb", F.lit(0)) + pseudocount
    rows = rows.withColumn("p", na / F.sum(na).over(column)).withColumn("q", nb / F.sum(nb).over(column)).withColumn("m", (F.col("p") + F.col("q")) / 2)
    seen = F.col("na").isNotNull()
    extra = mass / F.sum(seen.cast("int")).over(column)
    sa, sb = F.when(seen, F.col("na") + extra), F.when(seen, F.coalesce("nb", F.lit(0)) + extra)
    rows = rows.withColumn("sp", sa / F.sum(sa).over(column)).withColumn("sq", sb / F.sum(sb).over(column))
    p, q, m = F.col("p"), F.col("q"), F.col("m")
    per = rows.groupBy("msa_id", "col").agg(
        (F.sum(p * F.log(p / m)) / 2 + F.sum(q * F.log(q / m)) / 2).alias("js"),
        (F.sum(p * F.log(p / q)) / 2 + F.sum(q * F.log(q / p)) / 2).alias("kl"),
        F.sum(F.when(seen, F.col("sp") * F.log(F.col("sp") / F.col("sq")))).alias("ks"),
    )
    return per.groupBy("msa_id").agg(F.count("*").alias("columns"), F.avg("js").alias("js"), F.avg("kl").alias("kl_symmetric"), F.avg("ks").alias("kl_smoothed"))


def summary(rows: DataFrame) -> DataFrame:
    """msa_id, m, l, and the number of columns with less than half gaps."""
    gaps = cells(rows).groupBy("msa_id", "col").agg(F.avg((F.col("token") == "-").cast("double")).alias("g"))
    columns = gaps.groupBy("msa_id").agg(F.count("*").alias("l"), F.sum((F.col("g") < 0.5).cast("long")).alias("occupied"))
    return rows.groupBy("msa_id").agg(F.count("*").alias("m")).join(columns, "msa_id")


def logo(long: DataFrame, tokens: list[str]) -> DataFrame:
    return long.groupBy("msa_id", "col").pivot("token", tokens).count().na.fill(0)


def similarity_band(rows: DataFrame, most: float, most_difference: float) -> DataFrame:
    """Rows whose share of columns equal to the first row (gaps count) is in the band."""
    first = rows.groupBy("msa_id").agg(F.min_by("aln", "row_id").alias("query"))
    x = F.arrays_zip(F.split("aln", "").alias("a"), F.split("query", "").alias("b"))
    s = F.size(F.filter(x, lambda p: p["a"] == p["b"])) / F.length("query")
    # One row for each alignment.
    return rows.join(first, "msa_id").withColumn("similarity", s).filter((F.col("similarity") <= most) & (1 - F.col("similarity") <= most_difference)).drop("query")


def contact_matrix(covariance: np.ndarray, column: np.ndarray, is_gap: np.ndarray, penalty: float) -> np.ndarray:
    """Scores of all pairs of columns from the covariance of their states.

    The inverse of the covariance with penalty on its diagonal is divided by its own diagonal, which then is
    zero, and made symmetric. Norms are taken over states without gaps; the product of the means of row and
    column over the mean, all over the matrix with its zero diagonal, is subtracted.
    """
    inverse = np.linalg.inv(covariance + np.eye(len(covariance)) * penalty)
    inverse = inverse / np.diagonal(inverse) - np.eye(len(covariance))
    squares = (0.5 * (inverse + inverse.T)) ** 2
    squares[is_gap, :] = 0.0
    squares[:, is_gap] = 0.0
    columns, at = np.unique(column, return_inverse=True)
    member = np.zeros((len(columns), len(column)))
    member[at, np.arange(len(column))] = 1.0
    norm = np.sqrt(member @ squares @ member.T)
    np.fill_diagonal(norm, 0.0)
    mean = norm.mean() if norm.size else 0.0
    scores = norm - np.outer(norm.mean(axis=1), norm.mean(axis=0)) / mean if mean else norm
    np.fill_diagonal(scores, 0.0)
    return scores


def contact_scores(pairs: DataFrame, singles: DataFrame, penalty: float = 4.5) -> DataFrame:
    """msa_id, i, j, score for columns i < j: inverse shrunk covariance, norms without gaps, average product corrected.

    pairs(msa_id, i, x, j, y, covariance), singles(msa_id, i, x, frequency, total). The dense matrix of one
    alignment is as wide as its columns times tokens, whatever the number of rows; states never seen would
    only add zeros.
    """

    def scores(key: tuple, p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values(["i", "x"], ignore_index=True)
        states = pd.MultiIndex.from_arrays([s.i, s.x])
        column, f = s.i.to_numpy(), s.frequency.to_numpy(dtype=float)
        # Pairs of states that were never seen together have no row: their joint frequency is zero.
        c = -np.outer(f, f)
        a = states.get_indexer(pd.MultiIndex.from_arrays([p.i, p.x]))
        b = states.get_indexer(pd.MultiIndex.from_arrays([p.j, p.y]))
        c[a, b] = c[b, a] = p.covariance.to_numpy(dtype=float)
        c[np.diag_indices(len(f))] = f - f * f
        names, out = np.unique(column), contact_matrix(c, column, (s.x == "-").to_numpy(), penalty / np.sqrt(float(s.total.iloc[0])))
        i, j = np.triu_indices(len(names), 1)
        return pd.DataFrame({"msa_id": key[0], "i": names[i], "j": names[j], "score": out[i, j]})

    singles = singles.select(*[F.col(c).alias(c) for c in singles.columns])
    return pairs.groupBy("msa_id").cogroup(singles.groupBy(singles["msa_id"])).applyInPandas(scores, "msa_id string, i int, j int, score double")


def global_alignment_identity(a: Column, b: Column) -> Column:
    """Identity after global alignment (match 1, mismatch 0, gap -1) of unaligned strings; a pandas function."""
    return _aligned_identity(a, b)


@F.pandas_udf(T.DoubleType())
def _aligned_identity(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if not x and not y:
            return 1.0
        best = [(-j, 0, j) for j in range(len(y) + 1)]  # score, equal positions, alignment length
        for i, c in enumerate(x, 1):
            row = [(-i, 0, i)]
            for j, d in enumerate(y, 1):
                diagonal, up, left = best[j - 1], best[j], row[j - 1]
                row.append(
                    max(
                        (diagonal[0] + (c == d), diagonal[1] + (c == d), diagonal[2] + 1),
                        (up[0] - 1, up[1], up[2] + 1),
                        (left[0] - 1, left[1], left[2] + 1),
                        key=lambda t: (t[0], t[1], -t[2]),
                    )
                )
            best = row
        return best[-1][1] / best[-1][2]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def superposition_rmsd(pairs: DataFrame, key: str) -> DataFrame:
    """key, rmsd after the best rotation of two lists of 3-D points xs and ys (arrays of arrays)."""

    def fit(batches):
        for pdf in batches:
            out = []
            for xs, ys in zip(pdf["xs"], pdf["ys"], strict=True):
                x, y = np.stack(list(xs)), np.stack(list(ys))
                x, y = x - x.mean(axis=0), y - y.mean(axis=0)
                u, s, v = np.linalg.svd(x.T @ y)
                s[-1] *= np.sign(np.linalg.det(u @ v))
                out.append(float(np.sqrt(max(0.0, ((x**2).sum() + (y**2).sum() - 2 * s.sum()) / len(x)))))
            yield pd.DataFrame({key: pdf[key], "rmsd": out})

    return pairs.select(key, "xs", "ys").mapInPandas(fit, f"{key} {dict(pairs.dtypes)[key]}, rmsd double")
