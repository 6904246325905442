from __future__ import annotations

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from compare import assert_same
from test_ngram_join import brute

from lamina.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), sf_dir, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == columns, name
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
        if name != "source_mixing":
            assert after.count() < before.count()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert last.count() == before.count() and set(columns) <= set(last.columns)


def test_pipeline_against_brute_force(spark, sf_dir):
    """Every stage by SQL or brute force in turn, on whole tables."""
    db = duckdb.connect()
    db.execute(f"CREATE TABLE documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet'")
    assert db.sql("SELECT count(*) = count(DISTINCT doc_id) FROM documents").fetchall() == [(True,)]
    for stage in ("quality", "near", "clean", "mix"):
        if stage == "quality":
            ids = [i for i, kept in db.sql(f"SELECT doc_id, kept FROM ({queries.ORACLES['op2_quality_rules']})").fetchall() if kept]
        elif stage == "near":
            rows = db.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()
            ids = [int(doc) for doc, n, component in brute(rows, 5, 80) if not n or doc == component]
        elif stage == "clean":
            ids = [i for i, bad in db.sql(f"SELECT doc_id, contaminated FROM ({queries.ORACLES['op9_decontamination']})").fetchall() if not bad]
        else:
            ids = [i for (i,) in db.sql(f"SELECT doc_id FROM ({queries.ORACLES['op8_source_mixing']})").fetchall()]
        left_ids = pd.DataFrame({"id": ids})  # noqa: F841  named in the statement
        db.execute("CREATE OR REPLACE TABLE documents AS SELECT d.* FROM documents d JOIN left_ids ON id = doc_id")
    want = db.sql(f"SELECT doc_id, size, text_crc32, shard, slot FROM ({queries.ORACLES['op4_sharding']})").fetchall()
    texts = dict(db.sql("SELECT DISTINCT doc_id, text FROM documents").fetchall())
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == sorted(want)
    assert all(r.text == texts[r.doc_id] for r in got)


def test_registered_once():
    import __spark_entry__ as entry

    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())
