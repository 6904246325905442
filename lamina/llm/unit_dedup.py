"""Repeated lines and sentences: keep the earliest occurrence, remove the rest, with original offsets.

Units are lines, cut further at the ends of sentences because repeated passages begin inside lines. They
are normalised (lower case, single spaces) and hashed to 128 bits. Digests are grouped over all documents
with map-side aggregation; the document with the smallest id keeps a unit at its first place, and every
other occurrence is repeated. Consecutive repeated units make a span; spans of min_words and more words
are removed. Units that only few words repeat are so left alone, and boilerplate of a line too unless it
adds up. Defined cases: null and empty texts have no units; documents rank by id, null ids last, and those
with equal ids or none by the 64-bit hash of the text, so that one of them keeps a unit; rows equal in id and
text are one document, which loses the same spans in each row; repeats inside a document go after the first;
an empty table gives no rows; extra columns are ignored by repeated_spans and passed through by remove_spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import packed, staged, text_batches

MIN_WORDS = 20
#: From a visible character to the end of the sentence or line.
_UNIT = re.compile(r"(?=\S)(?:[^\n.!?]+|[.!?]+(?=[^\s.!?]))*+[.!?]*")
_LAST = (1 << 63) - 1


def units(text: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit; offsets count code points."""
    for found in _UNIT.finditer(text):
        words = found[0].lower().split()
        body = found[0].rstrip()
        yield found.start(), found.start() + len(body), len(words), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


_OCCURRENCE = "doc_id long, text_key long, unit int, start int, stop int, words int, d1 long, d2 long, again boolean"


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each unit; `again` marks repeats of an earlier unit of the same document."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2):
            rows, digests, counts, again = [], [], [], []
            for body in batch.column(2).to_pylist():
                seen: set[bytes] = set()
                n = 0
                for start, stop, words, digest in units(body) if body else ():
                    rows.append((n, start, stop, words))
                    digests.append(digest)
                    again.append(digest in seen)
                    seen.add(digest)
                    n += 1
                counts.append(n)
            table = np.array(rows, dtype=np.int32).reshape(-1, 4)
            both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(len(counts)), counts))
            columns = [batch.column(0).take(owner), batch.column(1).take(owner), *[pa.array(np.ascontiguousarray(table[:, i])) for i in range(4)]]
            columns += [pa.array(np.ascontiguousarray(both[:, i])) for i in range(2)] + [pa.array(again, pa.bool_())]
            names = ["doc_id", "text_key", "unit", "start", "stop", "words", "d1", "d2", "again"]
            for at in range(0, len(owner), 20_000):
                yield pa.record_batch([c.slice(at, 20_000) for c in columns], names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, _OCCURRENCE)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, start, stop, n_units, n_words, kept_doc_id of every span to remove."""
    found = occurrences(docs, key, text).withColumn("rank", F.coalesce("doc_id", F.lit(_LAST)))
    # The aggregation has one row a task for units that are everywhere. Its result is a table of its own, so
    # that both sides of the join are plain exchanges, whose large keys are split at run time.
    found = found.withColumn("rank", F.struct(F.col("rank").alias("id"), F.col("text_key").alias("text")))
    first = found.groupBy("d1", "d2").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.max("again").alias("_any"))
    first = first.filter((F.col("first") < F.col("last")) | F.col("_any")).select("d1", "d2", "first")
    first = staged(first, "repeated")
    repeated = found.join(first, ["d1", "d2"]).filter((F.col("rank") > F.col("first")) | F.col("again"))
    repeated = repeated.groupBy("doc_id", "text_key", "unit").agg(
        F.min("start").alias("start"), F.min("stop").alias("stop"), F.min("words").alias("words"), F.min("first.id").alias("first")
    )
    order = Window.partitionBy("doc_id", "text_key").orderBy("unit")
    runs = repeated.withColumn("run", F.col("unit") - F.row_number().over(order))
    spans = runs.groupBy("doc_id", "text_key", "run").agg(
        F.min("start").cast("long").alias("start"),
        F.max("stop").cast("long").alias("stop"),
        F.count("*").alias("n_units"),
        F.sum("words").alias("n_words"),
        F.min("first").alias("kept_doc_id"),
    )
    spans = spans.filter(F.col("n_words") >= min_words).drop("run")
    return spans.withColumn("kept_doc_id", F.when(F.col("kept_doc_id") != _LAST, F.col("kept_doc_id")))


def remove_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows and columns of docs, with the spans cut from the text and their offsets in `removed`, which replaces a column of that name."""
    cuts = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("removed"))
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "removed")
    own = docs.select(packed(docs), F.col(key).cast("long").alias("_own"), F.xxhash64(text).alias("_text"))
    joined = own.join(cuts, own["_own"].eqNullSafe(cuts["_id"]) & (own["_text"] == cuts["_key"]), "left")
    joined = joined.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() != "removed"], "removed")
    pieces = F.aggregate(
        "removed",
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(
            F.concat(s["text"], F.substr(F.col(text), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).alias("text"), x["stop"].alias("at")
        ),
        lambda s: F.concat(s["text"], F.substr(F.col(text), (s["at"] + 1).cast("int"))),
    )
    return joined.withColumn(text, F.when(F.col("removed").isNull(), F.col(text)).otherwise(pieces))
