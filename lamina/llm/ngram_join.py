"""Jaccard self-join of documents' shingle sets by PartEnum signatures, and its connected components.

Sets a and b link when 100 * |a & b| >= percent * |a | b|. Then their Hamming distance is at most
k = (|a| + |b|) * (100 - percent) // (100 + percent). Pairs fall into bands by that k; a set signs for
each band that a partner of a possible size would put it in. In a band the hash domain of shingles is cut
into n1 partitions with n1 * (spare + 1) > k, each cut again into n2; one of the n1 then holds at most
`spare` differing shingles, and leaving out each choice of `spare` of its n2 parts gives one projection on
which both sets agree. A signature is the band, the partition, the left-out part and the sum of the hashes
of the projected shingles. An empty projection says nothing and would be shared by many sets. With
`margin` more partitions than needed, at least 1 + margin of them agree, so that a set with empty
projections in no more than margin partitions can leave those out; other sets replace each by the
signatures of the same band under a second hash.

Documents with equal sets are one node, so that copies cost one row a task. Signatures travel in binary
blocks, in as many buckets as keep a bucket small; a signature that is frequent in a block travels once for
the block, as the name of a local group. Each bucket gives its groups of two and more nodes. In rounds, each
node is compared with one member of the groups it is in, and the links' components are formed. What is left
are groups with nodes in different components. Of their nodes those go on that share one of their rarest shingles
with another component (two sets that link share one of the n - ceil(percent * n / 100) + 1 rarest of n): they
meet in tasks of a bounded number of sets, which look at such pairs only. A task returns a forest of the links
that it finds, so that no link between components is lost and no group is expanded to pairs. Sets are compared
exactly, as 64-bit shingle hashes. The plan is the same at every size.

Defined cases: null, empty and blank texts have an empty set and are components of their own (component_id
is the own doc_id); fewer words than a shingle make one shingle of the whole; a null doc_id takes part and
counts only where its component has no other id; repeated rows and ids each get their row; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import dropped, packed, partitions, staged, text_batches
from lamina.llm.components import connected_components

_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); equal inputs and seeds give equal outputs."""
    with np.errstate(over="ignore"):
        x = x + _U(seed) * _M3 + _M1
        x = (x ^ (x >> _U(30))) * _M2
        x = (x ^ (x >> _U(27))) * _M3
        return x ^ (x >> _U(31))


@dataclass(frozen=True)
class JaccardJoin:
    """Link at `percent` hundredths; bands grow by `growth` in k; n2 parts of which `spare` are left out."""

    width: int = 4
    percent: int = 85
    parts: int = 3
    spare: int = 1
    growth: float = 1.35

    def bands(self, most: int) -> np.ndarray:
        """The largest k of each band, up to one that covers sets of `most` shingles and their partners."""
        top = self.distance(most + most * 100 // self.percent)
        ks = [0]
        while ks[-1] < top:
            ks.append(max(ks[-1] + 1, int((ks[-1] + 1) * self.growth) - 1))
        return np.array(ks)

    def distance(self, total: int) -> int:
        return total * (100 - self.percent) // (100 + self.percent)

    def needed(self, k: int) -> int:
        """Partitions of which one holds at most `spare` of k differing shingles."""
        return k // (min(self.spare, k) + 1) + 1

    def margin(self, k: int) -> int:
        return self.needed(k) // 8

    def bands_of(self, size: int) -> list[tuple[int, int]]:
        """(band, k) for every band that a pair with a set of this size can fall into."""
        ks = self.bands(size)
        low = self.distance(size + -(-size * self.percent // 100))
        high = self.distance(size + size * 100 // self.percent)
        first, last = np.searchsorted(ks, [low, high])
        return [(int(band), int(ks[band])) for band in range(first, last + 1)]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; words are split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    own = min(width, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - own + 1, own, dtype=np.uint64)
        for j in range(own):
            out = (out ^ hashes[j : j + len(out)]) * _M2
            out ^= out >> _U(29)
    return np.unique(mixed(out))


def set_digest(shingles: np.ndarray) -> int:
    """The node: a signed 64-bit digest of the set."""
    with np.errstate(over="ignore"):
        return int((mixed(shingles, 1).sum(dtype=np.uint64) * _M2 ^ _U(len(shingles))).astype(np.int64))


_choices: dict[tuple[int, int], np.ndarray] = {}


def _left_out(parts: int, spare: int) -> np.ndarray:
    """For each choice of `spare` parts, a 0/1 row that marks them."""
    if (parts, spare) not in _choices:
        _choices[parts, spare] = np.array([[int(p in c) for p in range(parts)] for c in combinations(range(parts), spare)], dtype=np.uint64)
    return _choices[parts, spare]


def signatures(shingles: np.ndarray, join: JaccardJoin) -> np.ndarray:
    """All 64-bit signatures of a set that is not empty."""
    out = []
    for band, k in join.bands_of(len(shingles)):
        sums, counts = _band(shingles, join, band, k, 0)
        out.append(sums[counts > 0].ravel())
        empty = np.flatnonzero(counts.ravel() == 0)
        if (counts == 0).any(axis=1).sum() > join.margin(k):
            again = _band(shingles, join, band, k, 1)[0].ravel()
            with np.errstate(over="ignore"):
                out.extend(mixed(again ^ (_U(at + 1) * _M1), 7) for at in empty.tolist())
    return np.unique(np.concatenate(out))


def _band(shingles: np.ndarray, join: JaccardJoin, band: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one band, a row for each partition, and how many shingles each projects on."""
    spare = min(join.spare, k)
    parts = join.parts if spare else 1
    n1 = join.needed(k) + join.margin(k)
    values = mixed(shingles, 11 + seed)
    place = (mixed(shingles, 1000 * (seed + 1) + band) % _U(n1 * parts)).astype(np.int64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n1 * parts, dtype=np.uint64)
        np.add.at(sums, place, values)
        counts = np.bincount(place, minlength=n1 * parts).reshape(n1, parts)
        sums = sums.reshape(n1, parts)
        if spare:
            out = _left_out(parts, spare).T
            sums = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums @ out
            counts = counts.sum(axis=1)[:, None] - counts @ out.astype(np.int64)
        at = np.arange(sums.size, dtype=np.uint64)
        named = mixed(sums.ravel() + mixed(at + _U(1_000_003) * _U(band), 5), 3 + seed)
        return named.reshape(sums.shape), counts.reshape(sums.shape)


def headers(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles and node (null for empty sets) of every row."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2):
            sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
            sizes, nodes = pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), sizes, nodes], ["doc_id", "text_key", "n_shingles", "node"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(heads, "doc_id long, text_key long, n_shingles long, node long")


#: Signatures and nodes in one binary block; a block has a 16-bit number for each of its members.
_BLOCK_RECORDS, _BLOCK_NODES = 1_000_000, 30_000
#: A signature that so many nodes of a block share travels once, for the block's group of them.
HOT_RUN = 512
#: Bytes of signatures that a task gathers in one bucket; a worker needs about four times that.
BUCKET_BYTES = 64 << 20


def bucket_count(heads: DataFrame, join: JaccardJoin) -> int:
    """Buckets for the signatures of these nodes, by their expected bytes."""
    large = 4096
    each = sum((join.needed(k) + join.margin(k)) * join.parts for _, k in join.bands_of(large)) / large
    nodes, shingles = heads.filter("node is not null").agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    return max(partitions(heads.sparkSession), -(-int(10 * (each * shingles + 8 * nodes)) // BUCKET_BYTES))


def _names(node: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A name for each run of nodes: equal sets of nodes have equal names."""
    with np.errstate(over="ignore"):
        return np.add.reduceat(mixed(node.astype(np.uint64), 21), starts) + mixed(sizes.astype(np.uint64), 22)


def _runs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal signatures begin in sorted ones, and how long they are."""
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(sig)))


def _named_groups(node: np.ndarray, size: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the runs, and rows (grp, node, n, times) of the distinct groups that they form."""
    names = _names(node, starts, lengths)
    _, first, times = np.unique(names, return_index=True, return_counts=True)
    at = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in first.tolist()])
    each = lengths[first]
    return names, np.stack([np.repeat(names[first], each).astype(np.int64), node[at], size[at], np.repeat(times, each)], axis=1)


def _blocks(docs: DataFrame, join: JaccardJoin, buckets: int, text: str) -> DataFrame:
    """bucket, local and a block: members, their set sizes, a member number for each signature, the signatures.

    A member is a node, or with size -1 a group of nodes of this block. Rows with local set hold the
    rows (grp, node, n, times) of such groups instead.
    """

    def flushed(nodes: list[int], sizes: list[int], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not nodes:
            return
        every = np.concatenate(found)
        owner = np.repeat(np.arange(len(nodes)), [len(x) for x in found])
        names, own = np.array(nodes, dtype=np.int64), np.array(sizes, dtype=np.int32)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        starts, lengths = _runs(every)
        hot = lengths >= HOT_RUN
        ids, local, payloads = [], [], []
        if hot.any():
            inside, rows = _named_groups(names[owner], own[owner].astype(np.int64), starts[hot], lengths[hot])
            for at in range(0, len(rows), 100_000):
                ids.append(int(_U(rows[at, 0]) % _U(buckets)) if rows[at, 0] >= 0 else int(-rows[at, 0] % buckets))
                local.append(True)
                payloads.append(rows[at : at + 100_000].tobytes())
            single = np.ones(len(every), dtype=bool)
            for a, n in zip(starts[hot].tolist(), lengths[hot].tolist(), strict=True):
                single[a : a + n] = False
            known, which = np.unique(inside, return_inverse=True)
            every = np.concatenate([every[single], every[starts[hot]]])
            owner = np.concatenate([owner[single], len(names) + which])
            names, own = np.concatenate([names, known.astype(np.int64)]), np.concatenate([own, np.full(len(known), -1, np.int32)])
        bucket = ((every >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        every, owner, bucket = every[order], owner[order], bucket[order]
        starts, lengths = _runs(bucket)
        for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            used, number = np.unique(owner[a : a + n], return_inverse=True)
            head = np.array([len(used)], dtype=np.int64).tobytes() + names[used].tobytes() + own[used].tobytes()
            ids.append(int(bucket[a]))
            local.append(False)
            payloads.append(head + every[a : a + n].tobytes() + number.astype(np.uint16).tobytes())
        for at in range(0, len(ids), 64):
            part = slice(at, at + 64)
            yield pa.record_batch([pa.array(ids[part], pa.int32()), pa.array(local[part], pa.bool_()), pa.array(payloads[part], pa.binary())], ["bucket", "local", "block"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        nodes, sizes, found, records = [], [], [], 0
        for batch in text_batches(batches, 0):
            for body in batch.column(0).to_pylist():
                shingles = shingle_set(body, join.width)
                node = set_digest(shingles) if len(shingles) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                own = signatures(shingles, join)
                nodes.append(node)
                sizes.append(len(shingles))
                found.append(own)
                records += len(own)
                if records >= _BLOCK_RECORDS or len(nodes) >= _BLOCK_NODES:
                    yield from flushed(nodes, sizes, found)
                    nodes, sizes, found, records = [], [], [], 0
        yield from flushed(nodes, sizes, found)

    return docs.select(F.col(text).alias("text")).mapInArrow(signed, "bucket int, local boolean, block binary")


_GROUPS = "grp long, node long, n long, times long"


def _groups(table: pa.Table) -> pa.Table:
    """The distinct groups of two and more members that share signatures of this bucket, and how many."""
    sigs, nodes, sizes, rows = [], [], [], [np.empty((0, 4), dtype=np.int64)]
    for local, block in zip(table.column("local").to_pylist(), table.column("block").to_pylist(), strict=True):
        if local:
            rows.append(np.frombuffer(block, np.int64).reshape(-1, 4))
            continue
        n = int(np.frombuffer(block, np.int64, 1)[0])
        names, own = np.frombuffer(block, np.int64, n, 8), np.frombuffer(block, np.int32, n, 8 + 8 * n)
        start = 8 + 12 * n
        records = (len(block) - start) // 10
        sigs.append(np.frombuffer(block, np.uint64, records, start))
        number = np.frombuffer(block, np.uint16, records, start + 8 * records)
        nodes.append(names[number])
        sizes.append(own[number])
    if sigs:
        sig, node, size = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(sizes)
        del sigs, nodes, sizes
        order = np.argsort(sig, kind="stable")
        same = sig[order[1:]] == sig[order[:-1]]
        shared = np.zeros(len(sig), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        order = order[shared]
        sig, node, size = sig[order], node[order], size[order]
        order = np.lexsort((node, sig))
        sig, node, size = sig[order], node[order], size[order]
        fresh = np.ones(len(sig), dtype=bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, size = sig[fresh], node[fresh], size[fresh].astype(np.int64)
        starts, lengths = _runs(sig)
        many = lengths > 1
        if many.any():
            rows.append(_named_groups(node, size, starts[many], lengths[many])[1])
    out = np.concatenate(rows)
    return pa.table([pa.array(np.ascontiguousarray(out[:, i])) for i in range(4)], ["grp", "node", "n", "times"])


def _united(found: DataFrame) -> DataFrame:
    """grp, node, n, times: groups that several buckets found become one, and local groups their nodes."""
    groups = staged(found.groupBy("grp", "node").agg(F.max("n").alias("n"), F.sum("times").alias("times")), "groups")
    inner = groups.filter("n < 0").select("grp", F.col("node").alias("name"), F.col("times").alias("outer_times"))
    if not inner.limit(1).count():
        return groups
    members = groups.filter("n >= 0").select(F.col("grp").alias("name"), "node", "n")
    whole = groups.filter("n >= 0").unionByName(inner.join(members, "name").select("grp", "node", "n", F.col("outer_times").alias("times")))
    return staged(whole.groupBy("grp", "node").agg(F.max("n").alias("n"), F.sum("times").alias("times")), "groups")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """node, n, sketch, shingles for the representatives in wanted (node, doc_id, text_key)."""
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).alias("text"))
    wanted = wanted.hint("merge")  # texts and sets meet their keys by the same join at every size
    rows = rows.join(wanted, rows["_id"].eqNullSafe(wanted["doc_id"]) & (rows["_key"] == wanted["text_key"])).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_batches(batches, 1):
            # Equal rows of documents are the same representative: once a task is enough, links are a set.
            batch = batch.filter(pa.array([not (n in seen or seen.add(n)) for n in batch.column(0).to_pylist()], pa.bool_()))
            own = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(s) for s in own])
            values = pa.array(np.concatenate(own).astype(np.int64) if own else [], pa.int64())
            cells = [np.minimum(np.bincount((s >> _U(7)).astype(np.int64) % SKETCH_CELLS, minlength=SKETCH_CELLS), 127) for s in own]
            sketches = pa.array(np.concatenate(cells).astype(np.int8) if own else [], pa.int8())
            at = pa.array(np.arange(len(own) + 1) * SKETCH_CELLS, pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            columns = [batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(at, sketches), lists]
            yield pa.record_batch(columns, ["node", "n", "sketch", "shingles"])

    return rows.mapInArrow(sets, "node long, n long, sketch array<tinyint>, shingles array<long>")


#: Cells of a set's sketch: how many shingles fall into each, at most 127.
SKETCH_CELLS = 256


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs that link, by exact intersection, staged.

    Sets whose sketches differ by more than the pair's Hamming distance may do, differ by more as well; such
    pairs, and the sets that no other pair has, go before any set is shuffled.
    """

    def side(pair_end: str, column: str) -> DataFrame:
        return sets.select(F.col("node").alias(pair_end), F.col(column).alias(f"{column}_{pair_end}"), F.col("n").alias(f"n_{pair_end}"))

    total = F.col("n_a") + F.col("n_b")
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda t, d: t + d)
    near = pairs.join(side("a", "sketch").hint("merge"), "a").join(side("b", "sketch").hint("merge"), "b")
    near = staged(near.filter(apart * (100 + percent) <= total * (100 - percent)).select("a", "b").distinct(), "near")
    both = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")

    def needed(pair_end: str) -> DataFrame:
        return side(pair_end, "shingles").join(near.select(pair_end).distinct().hint("merge"), pair_end, "left_semi")

    known = near.join(needed("b").hint("merge"), "b").join(needed("a").hint("merge"), "a")
    links = staged(known.filter(100 * both >= percent * (total - both)).select("a", "b"), "links")
    dropped(near)
    return links


#: Rounds of stars before the groups that are left are compared; the result is the same for any number.
STAR_ROUNDS = 1


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _open(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The groups whose nodes are in several components, with component."""
    if labels is None:
        return groups.withColumn("component", F.col("node"))
    named = groups.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Dealt anew, so that both sides of the join are plain exchanges, whose large keys are split at run time.
    still = named.groupBy("grp").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("grp")
    return staged(named.join(still.hint("rebalance"), "grp", "left_semi"), "open")


def _stars(groups: DataFrame, tested: DataFrame | None, percent: int, turn: int) -> DataFrame:
    """a < b: for each node the centre, drawn anew each turn, with which it shares most signatures, staged."""
    drawn = F.min_by(F.struct(F.col("component").alias("cc"), F.col("node").alias("center"), F.col("n").alias("cn")), F.xxhash64("node", F.lit(turn)))
    center = groups.groupBy("grp").agg(drawn.alias("c")).select("grp", "c.*").hint("rebalance")
    rays = groups.join(center, "grp").filter((F.col("component") != F.col("cc")) & _sizes_fit("n", "cn", percent))
    rays = rays.groupBy("node", "center").agg(F.sum("times").alias("times"))
    rays = rays.select("node", "times", F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b"))
    if tested is not None:
        rays = rays.join(tested, ["a", "b"], "left_anti")
    best = rays.groupBy("node").agg(F.max(F.struct("times", "a", "b")).alias("best"))
    return staged(best.select("best.a", "best.b").distinct(), "stars")


#: Sets that a task compares, on each side.
BLOCK_NODES = 1024
#: Overlapping open groups are compared as one unit if that has at most so many nodes, else group by group.
UNIT_NODES = 16 * BLOCK_NODES


def _units(groups: DataFrame) -> DataFrame:
    """unit, node, component: nodes that share an open group share a unit; staged."""
    roots = groups.groupBy("grp").agg(F.min("node").alias("a")).hint("rebalance")
    spokes = groups.select("grp", F.col("node").alias("b")).join(roots, "grp").select("a", "b").distinct()
    labels = connected_components(spokes).withColumnRenamed("component", "unit")
    nodes = groups.select("node", "component").distinct()
    rows = staged(nodes.join(labels, "node"), "units")
    sizes = staged(rows.groupBy("unit").agg(F.count("*").alias("nodes")).filter(F.col("nodes") > UNIT_NODES).select("unit"), "sizes")
    if sizes.limit(1).count():
        wide = rows.join(sizes, "unit", "left_semi").select("node")
        by_group = groups.join(wide, "node", "left_semi").select(F.xxhash64("grp", F.lit("group")).alias("unit"), "node", "component")
        rows = staged(rows.join(sizes, "unit", "left_anti").select("unit", "node", "component").unionByName(by_group), "units")
    return rows.select("unit", "node", "component")


def _met(rows: DataFrame) -> DataFrame:
    """unit, x, y, block, node, component: the nodes of each two blocks of a unit that have to be compared.

    Components of a block's size and more have blocks of their own, which are not compared with each other;
    smaller ones share blocks. So a node meets the nodes of other components, and of its own only if that is
    small.
    """
    sizes = rows.groupBy("unit", "component").agg(F.count("*").alias("size"))
    small = F.when(F.col("size") < BLOCK_NODES, F.col("size"))
    sizes = sizes.withColumn("home", F.when(F.col("size") >= BLOCK_NODES, F.col("component")))
    shared = sizes.groupBy("unit").agg(F.coalesce(F.ceil(F.sum(small) / BLOCK_NODES), F.lit(1)).alias("shared")).hint("rebalance")
    sizes = sizes.hint("rebalance")
    placed = rows.join(sizes.select("unit", "component", "home", "size"), ["unit", "component"]).join(shared, "unit")
    own = F.struct(
        F.col("home"),
        F.when(F.col("home").isNull(), F.pmod(F.xxhash64("component"), F.col("shared")))
        .otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK_NODES)))
        .cast("long").alias("part"),
    )
    placed = staged(placed.select("unit", own.alias("block"), "node", "component"), "placed")
    blocks = placed.select("unit", F.col("block").alias("own")).distinct()
    others = blocks.withColumnRenamed("own", "other")
    differ = ~(F.col("own.home").isNotNull() & F.col("own.home").eqNullSafe(F.col("other.home")))
    pairs = blocks.join(others, "unit").filter(differ & (F.col("own") <= F.col("other")))
    each = pairs.select("unit", F.col("own").alias("x"), F.col("other").alias("y"), F.col("own").alias("block"))
    each = each.unionByName(pairs.filter("own <> other").select("unit", F.col("own").alias("x"), F.col("other").alias("y"), F.col("other").alias("block")))
    met = each.join(placed, ["unit", "block"])
    return met.select("unit", "x", "y", (F.col("block") == F.col("x")).alias("left"), "node", "component")


def _forest(percent: int) -> Callable[[pa.Table], pa.Table]:
    def forest(table: pa.Table) -> pa.Table:
        """a, b: links between the components of the table's sets, as many as join them."""
        nodes, left = table.column("node").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
        _, component = np.unique(table.column("component").to_numpy(), return_inverse=True)
        lists = table.column("shingles").combine_chunks()
        ends = lists.offsets.to_numpy()
        sizes = np.diff(ends)
        owner = np.repeat(np.arange(len(nodes)), sizes)
        _, column, times = np.unique(lists.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True, return_counts=True)
        ends = ends - ends[0]
        # The rarest shingles of each set, as many as any set that links with it must share one of.
        order = np.lexsort((column, times[column], owner))
        place = np.arange(len(owner)) - np.repeat(ends[:-1], sizes)
        prefix = order[place < np.repeat(sizes + 1 - -(-percent * sizes // 100), sizes)]
        prefix = prefix[times[column[prefix]] > 1]
        prefix = prefix[np.argsort(column[prefix], kind="stable")]
        met = np.zeros((len(nodes), len(nodes)), dtype=bool)
        starts, lengths = _runs(column[prefix])
        for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            those = owner[prefix[a : a + n]]
            if n > 1 and component[those].min() != component[those].max():
                met[np.ix_(those, those)] = True
        met &= component[:, None] != component[None, :]
        if not left.all():
            met &= left[:, None] != left[None, :]
        parent = list(range(int(component.max()) + 1))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out, marked = [], np.zeros(len(times), dtype=bool)
        for i in range(len(nodes)):
            others = np.flatnonzero(met[i, i + 1 :]) + i + 1
            others = others[100 * np.minimum(sizes[i], sizes[others]) >= percent * np.maximum(sizes[i], sizes[others])]
            if not len(others):
                continue
            marked[column[ends[i] : ends[i + 1]]] = True
            for j in others.tolist():
                if (x := root(component[i])) == (y := root(component[j])):
                    continue
                both = int(np.count_nonzero(marked[column[ends[j] : ends[j + 1]]]))
                if 100 * both >= percent * int(sizes[i] + sizes[j] - both):
                    parent[x] = y
                    out.append((int(nodes[i]), int(nodes[j])))
            marked[column[ends[i] : ends[i + 1]]] = False
        return pa.table([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], ["a", "b"])

    return forest


def _rare_groups(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """grp, node, component: the nodes of open groups by rare shingles that they share across components, staged.

    Shingles of one component come first in the order, then the others by the number of nodes that hold them. A
    set's first n - ceil(percent * n / 100) + 1 shingles are its rare ones; two sets that link have one of these in
    common, as in any order that is the same for all, and across components it is one of several components. So
    sets that only share passages of many documents do not meet. Counts are exact at every size.
    """
    nodes = groups.select("node", "component").distinct()
    each = staged(nodes.hint("merge").join(sets.select("node", "n", "shingles"), "node"), "open_sets")
    held = each.select(F.explode("shingles").alias("grp"), "component").groupBy("grp")
    held = held.agg(F.count("*").alias("times"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    held = staged(held.select("grp", "times"), "held")  # the shuffle files of the counts go before shingles travel again
    shared = staged(each.select("node", F.explode("shingles").alias("grp")).join(held.hint("merge"), "grp"), "shared")
    dropped(held)
    place = F.row_number().over(Window.partitionBy("node").orderBy("times", "grp"))
    several = F.count("*").over(Window.partitionBy("node"))
    ranked = shared.select("grp", "node", place.alias("place"), several.alias("several"))
    ranked = ranked.join(each.select("node", "component", "n").hint("merge"), "node")
    first = F.col("n") + 1 + F.floor(F.lit(-percent) * F.col("n") / 100)
    rare = staged(ranked.filter(F.col("place") <= first - (F.col("n") - F.col("several"))).select("grp", "node", "component"), "rare")
    still = rare.groupBy("grp").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("grp")
    out = staged(rare.join(still.hint("rebalance"), "grp", "left_semi"), "open")
    dropped(each, shared, rare)
    return out


def _across(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect the components of the open groups, staged."""
    rare = _rare_groups(groups, sets, percent)
    met = _met(_units(rare)).hint("merge").join(sets.select("node", "shingles"), "node")
    links = staged(met.groupBy("unit", "x", "y").applyInArrow(_forest(percent), "a long, b long"), "links")
    dropped(rare)
    return links


def _owned(docs: DataFrame, join: JaccardJoin, key: str, text: str, report: Callable[..., None] | None = None) -> DataFrame:
    """doc_id, text_key, n_shingles, node and _c, the key of the component (null for empty sets), of every row of docs."""
    heads = staged(headers(docs, join.width, key, text), "headers")
    blocks = _blocks(docs, join, bucket_count(heads, join), text)
    found = staged(blocks.groupBy("bucket").applyInArrow(_groups, _GROUPS), "found")
    groups = _united(found)
    dropped(found)
    reps = heads.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
    nodes = staged(groups.select("node").distinct().join(reps, "node").select("node", "r.doc_id", "r.text_key"), "nodes")
    sets = staged(_sets(docs, nodes, join.width, key, text), "sets")
    if sets.groupBy("node").agg(F.count("*").alias("rows")).filter("rows > 1").limit(1).count():  # equal rows in several tasks
        sets = staged(sets.dropDuplicates(["node"]), "sets")

    links, tested, labels, old = [], None, None, [nodes]
    for turn in range(STAR_ROUNDS):
        groups = _open(groups, labels)
        stars = _stars(groups, tested, join.percent, turn)
        if not stars.limit(1).count():
            break
        new = _verified(stars, sets, join.percent)
        tested = stars if tested is None else tested.unionByName(stars)
        links.append(new)
        old += [stars, new]
        if report:
            report(open=groups, stars=stars, links=new)
        if labels is None or new.limit(1).count():
            labels = staged(connected_components(_all(links)), "labels")
    former, groups = groups, _open(groups, labels)
    if labels is not None:
        dropped(former)
    if groups.limit(1).count():
        links.append(_across(groups, sets, join.percent))
        if report:
            report(open=groups, links=links[-1])
        labels = staged(connected_components(_all(links)), "labels")
    owned = heads if labels is None else heads.join(labels, "node", "left")
    owned = owned.withColumn("_c", F.coalesce("component", "node") if labels is not None else F.col("node"))
    owned = staged(owned.select("doc_id", "text_key", "n_shingles", "node", "_c"), "owned")
    dropped(heads, groups, sets, labels, *old)
    return owned


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def link_components(
    docs: DataFrame, join: JaccardJoin = JaccardJoin(), key: str = "doc_id", text: str = "text", report: Callable[..., None] | None = None
) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id for every row of docs."""
    owned = _owned(docs, join, key, text, report)
    # A table of its own, so that the large components of the join are split at run time.
    least = staged(owned.filter("_c is not null").groupBy("_c").agg(F.min("doc_id").alias("component_id")), "least")
    out = owned.join(least, "_c", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("_c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, join: JaccardJoin, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that are the first of their component.

    The row with the smallest id stays, null ids last, of several rows with that id the one with the smallest
    text hash, and of rows equal in id and text one. Documents with empty sets are like no other: of them only
    rows equal in id and text go.
    """
    owned = _owned(docs, join, key, text)
    rows = owned.groupBy("_c", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "rows")).alias("first")
    keep = rows.filter("_c is not null").groupBy("_c").agg(first).select("first.doc_id", "first.text_key", "first.rows")
    keep = staged(keep.unionByName(rows.filter("_c is null").drop("_c")), "keep")
    dropped(owned)
    marks = keep.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    whole = docs.select(packed(docs), F.col(key).cast("long").alias("_own"), F.xxhash64(text).alias("_text"))
    kept = whole.join(marks.hint("merge"), whole["_own"].eqNullSafe(marks["_id"]) & (whole["_text"] == marks["_key"]), "left_semi").select("_row.*")
    # Only where ids repeat do whole rows have to meet.
    return kept.dropDuplicates([key, text]) if keep.filter("rows > 1").limit(1).count() else kept
