"""Leakage-free splits: held-out routing by hits, thinning to representatives, fragments and k-mer clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def member_header(file: Column, family: Column, row: Column, member: Column, accession: Column) -> Column:
    return F.concat_ws("|", file, family, row.cast("string"), member.cast("string"), accession)


def held_out_union(sources: list[DataFrame]) -> DataFrame:
    """sequence, split: the union of held-out sets; a sequence in both splits is test."""
    rows = sources[0]
    for other in sources[1:]:
        rows = rows.unionByName(other)
    tested = F.max((F.col("split") == "test").cast("int"))
    return rows.groupBy("sequence").agg(F.when(tested == 1, "test").otherwise("val").alias("split"))


def hit_splits(hits: DataFrame, least_identity: float = 30.0, least_coverage: float = 0.8) -> DataFrame:
    """query_header, split ('val', 'test' or 'both') of the hits that are close enough; split is the target's prefix."""
    close = hits.filter((F.col("pident") >= least_identity) & (F.col("qcov") >= least_coverage))
    split = F.substring_index("target_header", "_", 1)
    found = close.groupBy("query_header").agg(F.min(split).alias("a"), F.max(split).alias("b"))
    return found.select("query_header", F.when(F.col("a") != F.col("b"), "both").otherwise(F.col("a")).alias("split"))


def routed(members: DataFrame, splits: DataFrame) -> DataFrame:
    """members(family_id, query_header) with route: train for members without hits; for families of which all
    members hit one same split, that split; the others' hit members are dropped."""
    rows = members.join(splits, "query_header", "left")
    families = rows.groupBy("family_id").agg(
        F.sum(F.col("split").isNull().cast("int")).alias("clean"), F.min("split").alias("a"), F.max("split").alias("b")
    )
    whole = F.when((F.col("clean") == 0) & (F.col("a") == F.col("b")) & (F.col("a") != "both"), F.col("a"))
    families = families.select("family_id", whole.alias("family_split"))
    rows = rows.join(families, "family_id").withColumn("route", F.when(F.col("split").isNull(), "train").otherwise(F.col("family_split")))
    return rows.filter("route is not null").select("family_id", "query_header", "route")


def retained_share(members: DataFrame, routes: DataFrame) -> DataFrame:
    kept = routes.filter("route = 'train'").select("family_id").distinct().withColumn("kept", F.lit(1))
    joined = members.select("family_id").distinct().join(kept, "family_id", "left")
    return joined.agg(F.count("*").alias("families"), F.count("kept").alias("retained"), F.round(100 * F.count("kept") / F.count("*"), 6).alias("percent"))


def representatives(rows: DataFrame, excluded: DataFrame, least: int = 2) -> DataFrame:
    """One member, the first not excluded, of each (family, s20, s90), where the s20 cluster keeps `least` of them.

    rows(family_id, s20, s90, pos, accession)
    """
    left = rows.join(excluded.select("accession").distinct(), "accession", "left_anti")
    first = left.groupBy("family_id", "s20", "s90").agg(F.min(F.struct("pos", "accession")).alias("r")).select("family_id", "s20", "s90", "r.*")
    n = F.count("*").over(Window.partitionBy("family_id", "s20"))
    return first.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def fragments(rows: DataFrame, pieces: Column, least: int = 3) -> DataFrame:
    """msa_id, fragment_id, accession, fragment: pieces of each row, the first occurrence of each in its alignment.

    rows(msa_id, row_id, accession, ...); ids are accession_number; alignments with fewer than `least`
    fragments are left out.
    """
    cut = rows.select("msa_id", "row_id", "accession", F.posexplode(pieces).alias("piece", "fragment"))
    best = cut.groupBy("msa_id", "fragment").agg(F.min(F.struct("row_id", "piece", "accession")).alias("b"))
    out = best.select("msa_id", "fragment", "b.accession", F.concat_ws("_", "b.accession", F.col("b.piece").cast("string")).alias("fragment_id"))
    return out.withColumn("_n", F.count("*").over(Window.partitionBy("msa_id"))).filter(F.col("_n") >= least).drop("_n")


def valid_clusters(rows: DataFrame, least_residues: int, least_members: int = 2) -> DataFrame:
    """cluster ids with enough members of enough residues and equal aligned lengths; rows(cluster_id, aln)."""
    long = rows.filter(F.length(F.replace("aln", F.lit("-"), F.lit(""))) >= least_residues)
    sizes = long.groupBy("cluster_id").agg(F.count("*").alias("members"), F.min(F.length("aln")).alias("a"), F.max(F.length("aln")).alias("b"))
    return sizes.filter((F.col("members") >= least_members) & (F.col("a") == F.col("b"))).select("cluster_id", "members")


#: Windows that a worker hashes at once; bits of the filter of target k-mers for each of them, and at most; marks of a k-mer.
WINDOWS, BITS_A_KMER, MOST_BITS, MARKS = 1 << 18, 64, 1 << 27, 3


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive codes, from hashes of runs of powers of two."""
    run, power, size = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 1
    whole, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                # The runs that are done come before this one.
                whole = run if whole is None else whole[: len(run) - done] * power + run[done:]
                done += size
            if done == k:
                break
            run, power, size = run[:-size] * power + run[size:], power * power, size * 2
        whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        return whole ^ (whole >> np.uint64(33))


def mark(hashes: np.ndarray, bits: int, i: int) -> np.ndarray:
    """The i-th place of each hash in a filter of so many bits, a power of two."""
    with np.errstate(over="ignore"):
        mixed = hashes * np.uint64((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)[i])
    return (mixed >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def letters(texts: pa.Array) -> tuple[str | bytes, np.ndarray, np.ndarray]:
    """The texts one after the other, their code points, and where each text ends."""
    whole = b"".join(x.as_buffer() for x in texts if x.is_valid)
    if whole.isascii():
        return whole, np.frombuffer(whole, dtype=np.uint8), np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    text = whole.decode("utf-8")
    return text, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))


def hashed_windows(codes: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """First place and hashes of WINDOWS windows at a time, those across two texts too."""
    for at in range(0, len(codes) - k + 1, WINDOWS):
        yield at, window_hashes(codes[at : at + WINDOWS + k - 1], k)


def inside(places: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the places whose windows end in the text where they begin, and the numbers of these texts."""
    texts = np.searchsorted(ends, places, side="right")
    whole = places + k <= ends[texts]
    return places[whole], texts[whole]


def kmer_filter(targets: DataFrame, k: int) -> bytes:
    """A bitmap with MARKS bits set for every k-mer of targets(id, sequence): 16 MB at most, whatever their number."""
    n = targets.agg(F.sum(F.greatest(F.length("sequence") - k + 1, F.lit(0)))).first()[0] or 0
    bits = min(MOST_BITS, max(1 << 15, 1 << (n * BITS_A_KMER).bit_length()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, codes, ends = letters(batch.column(0))
            for at, hashes in hashed_windows(codes, k):
                own, _ = inside(at + np.arange(len(hashes)), ends, k)
                for i in range(MARKS):
                    yield pa.record_batch([pa.array(np.unique(mark(hashes[own - at], bits, i)))], ["place"])

    pieces = targets.select("sequence").mapInArrow(marked, "place long").groupBy(F.expr("place div 32768").alias("piece"))
    out = bytearray(bits // 8)
    # Pieces of 4,096 bytes.
    for row in pieces.agg(F.expr("bitmap_construct_agg(place % 32768)").alias("own")).toLocalIterator():
        out[row["piece"] * 4096 : row["piece"] * 4096 + 4096] = row["own"]
    return bytes(out)


def filtered_kmers(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """query_id, kmer: the distinct k-mers of each row of queries(id, sequence) that targets hold, and few others.

    Windows are hashed and looked up in the filter where the text is, so that other k-mers never become rows.
    """
    found = kmer_filter(targets, k)
    bits, handle = len(found) * 8, queries.sparkSession.sparkContext.broadcast(found)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(handle.value, dtype=np.uint8)
        for batch in batches:
            whole, codes, ends = letters(batch.column(1))
            found_at = []
            for at, hashes in hashed_windows(codes, k):
                places = np.arange(len(hashes))
                for i in range(MARKS):
                    bit = mark(hashes[places] if i else hashes, bits, i)
                    places = places[(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                found_at.append(inside(places + at, ends, k))
            if not found_at:
                continue
            places, rows = (np.concatenate(x) for x in zip(*found_at, strict=True))
            kmers = [whole[p : p + k] for p in places.tolist()]
            one = pa.table([pa.array(rows), pa.array(kmers, pa.binary() if isinstance(whole, bytes) else pa.string()).cast(pa.string())], ["row", "kmer"])
            one = one.group_by(["row", "kmer"]).aggregate([]).combine_chunks()
            for own in one.to_batches():
                yield pa.record_batch([batch.column(0).take(own.column("row")), own.column("kmer")], ["query_id", "kmer"])

    return queries.select("id", "sequence").mapInArrow(kept, f"query_id {dict(queries.dtypes)['id']}, kmer string")


def kmer_candidates(queries: DataFrame, targets: DataFrame, k: int, least_shared: int) -> DataFrame:
    """query_id, target_id, shared: pairs with at least so many k-mers in common; a prefilter, not an aligner.

    queries and targets are (id, sequence). Every k-mer counts. Those that the same targets hold are one
    group, so that a passage of many targets costs a row for each query and target instead of one for each of
    its k-mers, and queries whose k-mers cannot reach least_shared with any target go before they meet
    targets. Groups are named by their size and two 40-bit sums of hashes. K-mers of queries that no target
    holds go by a filter before they become rows; the join decides about the rest. Estimates leave out the
    explode to k-mers, so that their tables are merged and never broadcast.
    """

    n = F.length("sequence") - k + 1
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))
    kmers = F.explode(F.array_distinct(F.transform(at, lambda i: F.substr(F.col("sequence"), i, F.lit(k)))))

    def summed(seed: int) -> Column:
        return F.sum(F.pmod(F.xxhash64(F.lit(seed), "target_id", "times"), F.lit(1 << 40)))

    held = targets.select(F.col("id").alias("target_id"), kmers.alias("kmer")).groupBy("kmer", "target_id").agg(F.count("*").alias("times"))
    held_by = held.groupBy("kmer").agg(F.struct(F.count("*").alias("n"), summed(1).alias("x"), summed(2).alias("y")).alias("grp"), F.max("times").alias("most"))
    first = held_by.groupBy("grp").agg(F.min("kmer").alias("kmer"))
    members = held.hint("merge").join(first, "kmer").select("grp", "target_id", "times")
    found = filtered_kmers(queries, targets, k).hint("merge").join(held_by, "kmer").groupBy("query_id", "grp").agg(F.count("*").alias("own"), F.max("most").alias("most"))
    # A query has a row for each group at most, repeated and null ids too.
    reach = F.sum(F.col("own") * F.col("most")).over(Window.partitionBy("query_id"))
    found = found.withColumn("reach", reach).filter(F.col("reach") >= least_shared).select("query_id", "grp", "own")
    pairs = found.hint("merge").join(members, "grp").groupBy("query_id", "target_id").agg(F.sum(F.col("own") * F.col("times")).alias("shared"))
    return pairs.filter(F.col("shared") >= least_shared)
