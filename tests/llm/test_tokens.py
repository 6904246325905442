from __future__ import annotations

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lamina.llm import token_counts as C
from lamina.llm import token_files as F
from lamina.llm.common import shared_folder
from lamina.llm.tokenizing import WordEncoder, vocabulary

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def encoded(encoder, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


ODD = [
    "a  b", " a", "a ", "a \n b", "  ", " ", "x<|endoftext|> y", "don't  stop", "a\xa0 b", "tab\t x", "\n\n a", "a\x1c b", "it 's 'll x", " \x85 b", "", None,
    "日本語 é ß 😀", "a b.' c.'s d!! e-f g_ h'", "q ² ½ ⅷ x́", "　 x", "w" * 500,
]


@pytest.mark.parametrize("cache_words", [0, 1000])
def test_same_ids_as_whole_texts(library, odd_rows, cache_words):
    encoder = WordEncoder(vocabulary(VOCABULARY), cache_words)
    rng = random.Random(1)
    texts = ODD + [t for _, t, _, _ in odd_rows] + ["".join(rng.choice(" \n\t.,'!aeT1é²日́-_\"’ſ​|") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        assert encoded(encoder, some) == [library(t) for t in some]
    assert encoded(encoder, []) == []


def test_a_vocabulary_of_another_kind_goes_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    encoder = WordEncoder(vocabulary(path))
    assert not encoder.by_words
    assert encoded(encoder, ["Two  words, here", None]) == [own.encode("Two  words, here", add_special_tokens=False).ids, []]


def test_files_hold_every_document_in_order(spark, odd_docs, odd_rows, library):
    path = F.write_token_files(odd_docs, shared_folder(spark, "test"), VOCABULARY)
    rows = F.read_token_files(spark, path).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((i, (*library(t), 2)) for i, t, _, _ in odd_rows)
    order = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in order] == np.concatenate(([0], np.cumsum([r.n_tokens for r in order])))[:-1].tolist()
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in order]
    assert ids == sorted(ids)
    sums = F.with_checksum(F.read_token_files(spark, path)).collect()
    assert Counter((r.start, r.ids_crc32) for r in sums) == Counter((r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows)
    found = F.read_token_files(spark, path).filter("doc_id = 4").collect()  # an id filter that the files can prune by
    assert len(found) == 1


def test_a_writer_encodes_a_piece_of_texts_at_a_time(library):
    """NumPy and Python hold less than four times a batch of 8 MB beside it; rows and offsets go on over pieces."""
    texts = ["some words to encode, again " * n for n in [300] * 1000 + [50_000] + [1] * 10] + [None, ""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts), pa.array([3] * len(texts), pa.int32())], ["doc_id", "text", "part"])
    own, short = WordEncoder(vocabulary(VOCABULARY)), batch.slice(0, 1000)  # the next text is longer than a piece
    own.encode(short.column(1).slice(0, 1))
    tracemalloc.start()
    try:
        assert sum(rows.num_rows for rows in F.token_rows(iter([short]), own, 2)) == 1000
        beside = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert beside < 4 * short.nbytes
    found = pa.Table.from_batches(list(F.token_rows(iter([batch]), own, 2))).to_pydict()
    ids = {t: [*library(t), 2] for t in set(texts)}
    assert found["ids"] == [ids[t] for t in texts]
    assert found["n_tokens"] == [len(ids[t]) for t in texts]
    assert found["start_in_part"] == [0, *np.cumsum(found["n_tokens"])[:-1].tolist()]
    assert found["doc_id"] == list(range(len(texts))) and set(found["part"]) == {3}


def test_files_carry_indexes_that_skip_rows(spark):
    """Integer run lengths, row indexes and a Bloom filter are in the footers; an absent id inside the ranges reads nothing."""
    first = 10**10
    docs = spark.range(first, first + 60_000, 2).selectExpr("id as doc_id", "concat('document ', id) as text")
    path = F.write_token_files(docs, shared_folder(spark, "test"), VOCABULARY)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    sarg = jvm.org.apache.hadoop.hive.ql.io.sarg
    whole, read = 0, Counter()
    present, absent = first + 24_000, first + 24_001
    for file in F.read_token_files(spark, path).inputFiles():
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        whole += reader.getNumberOfRows()
        footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
        streams = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
        assert (1, "BLOOM_FILTER_UTF8") in streams and {(c, "ROW_INDEX") for c in range(7)} <= streams
        assert {c.getKind().toString() for c in list(footer.getColumnsList())[1:]} == {"DIRECT_V2"}
        for wanted in (present, absent):
            search = sarg.SearchArgumentFactory.newBuilder(conf).startAnd()
            search = search.equals("doc_id", getattr(sarg, "PredicateLeaf$Type").LONG, wanted).end().build()
            rows, batch = reader.rows(reader.options().searchArgument(search, None)), reader.getSchema().createRowBatch()
            while rows.nextBatch(batch):
                read[wanted] += batch.count()
    assert whole == 30_000
    assert 0 < read[present] <= int(F.ORC_OPTIONS["orc.row.index.stride"])
    assert read[absent] == 0


def test_no_documents(spark, no_docs):
    path = F.write_token_files(no_docs, shared_folder(spark, "test"), VOCABULARY)
    assert F.with_checksum(F.read_token_files(spark, path)).count() == 0
    assert C.length_answers(C.histogram(C.encoded_lengths(no_docs, VOCABULARY))).count() == 0


def test_histogram_answers(odd_docs, odd_rows, library):
    lengths = sorted(len(library(t)) + 1 for _, t, _, _ in odd_rows)
    answers = C.length_answers(C.histogram(C.encoded_lengths(odd_docs, VOCABULARY)))
    rows = {r.length: r for r in answers.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for n, r in rows.items():
        assert (r.n_docs, r.docs_from) == (lengths.count(n), sum(x >= n for x in lengths))
        assert (r.tokens_from, r.tokens_if_cut) == (sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths))
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    limits = [1, 2, 7, 64, 1000, 10**6]
    got = {r.limit: r for r in C.answers_at(answers, limits).collect()}
    assert {n: (r.docs_from, r.tokens_if_cut) for n, r in got.items()} == {n: (sum(x >= n for x in lengths), sum(min(x, n) for x in lengths)) for n in limits}
