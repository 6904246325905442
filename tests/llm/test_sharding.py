from __future__ import annotations

import zlib
from collections import Counter

import pytest

from lamina.llm import sharding as S


def test_contiguous_balanced_shards(odd_docs, odd_rows):
    got = S.assign_shards(odd_docs, shards=5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in odd_rows)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in order]
    assert ids == sorted(ids)
    largest, target = max(r.size for r in got), sum(r.size for r in got) / 5
    for shard in {r.shard for r in got}:
        rows = [r for r in order if r.shard == shard]
        assert [r.slot for r in rows] == list(range(len(rows)))
        assert abs(sum(r.size for r in rows) - target) <= largest
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_carried_columns(odd_docs):
    assert S.assign_shards(odd_docs, carry=("lang",)).columns[-1] == "lang"
    with pytest.raises(ValueError, match="size"):
        S.assign_shards(odd_docs, carry=("size",))


def test_whole_rows(odd_docs, odd_rows, no_docs):
    out = S.placed_rows(odd_docs, shards=5)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "node", "text_key", "__own_note", "__own", "removed", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in out.collect()) == Counter(odd_rows)
    key = lambda rows: sorted((str(r.doc_id), r.size, r.shard, r.slot) for r in rows)
    assert key(out.collect()) == key(S.assign_shards(odd_docs, shards=5).collect())
    assert S.placed_rows(no_docs).count() == 0


def test_many_equal_rows(spark):
    docs = spark.range(1000).selectExpr("7L as doc_id", "'same' as text")
    got = S.assign_shards(docs, shards=10).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [100] * 10


def test_empty_table(no_docs):
    assert S.assign_shards(no_docs).count() == 0
