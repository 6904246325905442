"""Occurrences of benchmark windows in documents, by Wu-Manber search over words.

Words are the symbols of the search. The windows of a length form one searcher: a block is its last three
words, a shift table says how far the next block that could end a window is, so that positions between are
never looked at; where the shift is 0, the hash bucket of the block selects the windows that end in it and
direct comparison confirms each. Windows have ten words; items of fewer words form searchers of their own
lengths, with blocks no longer than the item. The tables are flat arrays over hashes, of some 20 times the
benchmark's text, made once in a worker. The benchmark is read in blocks of bounded size, each broadcast; longer
items are cut into pieces that have all their windows. All documents run against each block and hits are united
by document.
Defined cases: null and empty texts have no words, so nothing is hit; items without words never occur;
items with equal ids count once; a null item_id hits but is not listed; repeated documents get a row each;
empty tables give no rows (documents) or no hits (benchmark); extra columns are ignored.
"""

from __future__ import annotations

import sys
import types
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import packed, staged, text_batches

WINDOW = 10
BLOCK = 3
#: Benchmark text in one broadcast; more text means more blocks, not less work.
BLOCK_BYTES = 16 << 20

#: Bytes that are no word characters become spaces, A-Z lower case; bytes from 128 on belong to words.
_TO_WORDS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class Searcher:
    """All windows of one length, in flat arrays.

    shift holds for each block hash how far a search may move on, begin and at the windows by the hash of
    their last block, in the order of the hash of their first words. Hashes only select; words decide.
    """

    def __init__(self, length: int, items: Iterable[tuple[int, list[bytes]]]):
        self.length, self.block = length, min(BLOCK, length)
        skip, known = length - self.block + 1, {}
        self.words: list[bytes] = []
        hashes, far, begins, windows, numbers = array("q"), array("B"), [], [], []
        for number, own in items:
            begins.append(len(self.words))
            windows.append(len(own) - length + 1)
            numbers.append(number)
            self.words.extend(known.setdefault(w, w) for w in own)
            blocks = len(own) - self.block + 1
            hashes.extend(hash(tuple(own[i : i + self.block])) for i in range(blocks))
            # The block at i ends this many words before the end of the first window that has it.
            far.extend(max(0, skip - 1 - i) for i in range(blocks))
        hashes = np.frombuffer(hashes, dtype=np.int64)
        self.mask = (1 << min(25, max(10, (8 * len(hashes)).bit_length()))) - 1
        shift = np.full(self.mask + 1, skip, dtype=np.uint8)
        np.minimum.at(shift, hashes & self.mask, np.frombuffer(far, dtype=np.uint8))
        self.shift = shift.tobytes()
        begins, windows = np.array(begins, dtype=np.int64), np.array(windows, dtype=np.int64)
        inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        at = np.repeat(begins, windows) + inside
        # An item has fewer blocks than words, so that block numbers lag behind word numbers.
        first = at - np.repeat(np.arange(len(begins)), windows) * (self.block - 1)
        self.bucket_mask = (1 << max(8, len(at).bit_length())) - 1
        buckets = hashes[first + skip - 1] & self.mask & self.bucket_mask
        order = np.lexsort((hashes[first], buckets))
        self.begin = array("q", np.searchsorted(buckets[order], np.arange(self.bucket_mask + 2)).tobytes())
        self.first, self.at = array("q", hashes[first][order].tobytes()), array("q", at[order].tobytes())
        self.owner = array("i", np.repeat(np.array(numbers, dtype=np.int32), windows)[order].tobytes())

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(first word, items) of every occurrence, in order."""
        length, block, shift, mask, begin = self.length, self.block, self.shift, self.mask, self.begin
        end, last = length, len(words)
        while end <= last:
            tail = hash(tuple(words[end - block : end]))
            step = shift[tail & mask]
            if step:
                end += step
                continue
            bucket = tail & mask & self.bucket_mask
            low, high = begin[bucket], begin[bucket + 1]
            if low < high:
                window = words[end - length : end]
                head = hash(tuple(window[:block]))
                low, items = bisect_left(self.first, head, low, high), set()
                while low < high and self.first[low] == head:
                    if self.words[self.at[low] : self.at[low] + length] == window:
                        items.add(self.owner[low])
                    low += 1
                if items:
                    yield end - length, items
            end += 1


def searchers(items: list[tuple[int, str | None]]) -> list[Searcher]:
    """One searcher for each window length that occurs; items are (number, text)."""
    by_length: dict[int, list[tuple[int, str]]] = {}
    for number, text in items:
        if n := len(words_of(text)):
            by_length.setdefault(min(WINDOW, n), []).append((number, text))
    return [Searcher(length, ((i, words_of(t)) for i, t in those)) for length, those in by_length.items()]


def search(words: list[bytes], found: list[Searcher]) -> tuple[list[tuple[int, int]], set[int]]:
    """The hit spans of words, merged and in order, and the items that occur."""
    spans, items = [], set()
    for searcher in found:
        for at, those in searcher.find(words):
            spans.append((at, at + searcher.length))
            items |= those
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(text: str, most_bytes: int) -> Iterator[str]:
    """The text, or if it is longer runs of its words that have all its windows and about most_bytes each."""
    if len(text) * 4 <= most_bytes or len(text.encode("utf-8", "surrogatepass")) <= most_bytes:
        yield text
        return
    words, at = words_of(text), 0
    while at == 0 or at + WINDOW - 1 < len(words):
        size, end = 0, at
        while end < len(words) and (size < most_bytes or end < at + WINDOW):
            size += len(words[end]) + 1
            end += 1
        yield b" ".join(words[at:end]).decode("utf-8", "surrogatepass")
        at = max(at + 1, end - WINDOW + 1)


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of at most block_bytes of text and a piece; one block is on the driver at a time."""
    held, size, any_block = [], 0, False
    for row in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        for piece in pieces(row["text"], block_bytes):
            own = len(piece.encode("utf-8", "surrogatepass"))
            if held and size + own > block_bytes:
                yield held
                held, size, any_block = [], 0, True
            held.append((row["item_id"], piece))
            size += own
    if held or not any_block:
        yield held


def kept_searchers(handle) -> tuple[list, list[Searcher]]:
    """The items of a broadcast block and their searchers, made once in a worker process and kept until the next block.

    They are in a module of their own: functions travel by value, and their globals end with the task.
    """
    kept = sys.modules.setdefault("lamina_worker_state", types.ModuleType("lamina_worker_state")).__dict__
    own = handle.value
    if kept.get("searchers", (None,))[0] is not own:
        kept.pop("searchers", None)
        kept["searchers"] = (own, searchers([(i, t) for i, (_, t) in enumerate(own)]))
    return kept["searchers"]


OUT = "doc_id long, n_words long, spans array<struct<a:int,b:int>>, items array<long>, key long"


def hits(docs: DataFrame, items: list[tuple[int | None, str]], key: str = "doc_id", text: str = "text", only_hit: bool = False) -> DataFrame:
    """doc_id, n_words, spans of hit words, ids of occurring items, and a key of the text, for one block of items."""
    spark = docs.sparkSession
    handle = spark.sparkContext.broadcast(items)  # at most about BLOCK_BYTES of text

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tools = kept_searchers(handle)
        for batch in text_batches(batches, 1):
            counts, spans, found = [], [], []
            for body in batch.column(1).to_pylist():
                words = words_of(body)
                hit, those = search(words, tools)
                counts.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in hit])
                found.append(sorted({own[i][0] for i in those if own[i][0] is not None}))
            columns = [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                pa.array(found, pa.list_(pa.int64())),
                batch.column(2),
            ]
            out = pa.record_batch(columns, ["doc_id", "n_words", "spans", "items", "key"])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if only_hit else out

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    return rows.mapInArrow(scan, OUT)


def scan_documents(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, spans and items for every document, whatever the number of benchmark blocks."""
    blocks = benchmark_blocks(benchmark, block_bytes)
    first = hits(docs, next(blocks), key, text)
    more = [hits(docs, block, key, text, only_hit=True) for block in blocks]
    if not more:
        return first.drop("key")
    others = more[0]
    for df in more[1:]:
        others = others.unionByName(df)
    # Equal rows of the documents hit alike, so that one entry for each id and text is enough.
    united = others.groupBy("doc_id", "key").agg(
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("more_spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items"),
    )
    same = first["doc_id"].eqNullSafe(united["doc_id"]) & first["key"].eqNullSafe(united["key"])
    joined = first.join(united, same, "left")
    spans = F.concat(first["spans"], F.coalesce("more_spans", F.expr("cast(array() as array<struct<a:int,b:int>>)")))
    items = F.array_union(first["items"], F.coalesce("more_items", F.expr("cast(array() as array<bigint>)")))
    return joined.select(first["doc_id"], first["n_words"], F.array_sort(spans).alias("spans"), items.alias("items"))


def digest(scanned: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from the scan's spans and items."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        "spans",
        start,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["upto"]))).cast("long").alias("n"), F.greatest(s["upto"], x["b"]).alias("upto")
        ),
        lambda s: s["n"],
    )
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    out = scanned.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256")
    )
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, in which no benchmark window occurs.

    A benchmark of one block filters the rows as they pass. Several blocks each scan the documents for the ids
    and texts that they hit, so that no worker holds more than one, and these rows go by an anti-join.
    """
    blocks = benchmark_blocks(benchmark, block_bytes)
    items, more = next(blocks), next(blocks, None)
    if more is None:
        handle, at = docs.sparkSession.sparkContext.broadcast(items), docs.columns.index(text)  # at most about BLOCK_BYTES of text

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, tools = kept_searchers(handle)
            for batch in text_batches(batches, at):
                hit = [any(next(s.find(words), None) for s in tools) for words in map(words_of, batch.column(at).to_pylist())]
                yield batch.filter(pa.array([not x for x in hit], pa.bool_()))

        return docs.mapInArrow(clean, docs.schema)
    found = [hits(docs, block, key, text, only_hit=True).select("doc_id", "key") for block in chain([items, more], blocks)]
    bad = found[0]
    for df in found[1:]:
        bad = bad.unionByName(df)
    bad = staged(bad.distinct(), "contaminated")
    whole = docs.select(packed(docs), F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_key"))
    return whole.join(bad, whole["_id"].eqNullSafe(bad["doc_id"]) & (whole["_key"] == bad["key"]), "left_anti").select("_row.*")
