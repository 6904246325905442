"""Physical plans: no cartesian products, pruned scans, no single-partition window over a large table."""

from __future__ import annotations

import re

import pytest

from lamina.plans import registry

#: Joins by range or with a table of one row for each letter, whose small side is broadcast.
NESTED_LOOPS = {"dataset_range_lookup", "ensemble_profile_scores", "assay_spearman"}
#: Windows over one row for each file, family, block or dataset.
SMALL_WINDOWS = {"file_shards", "global_indexes", "family_sources", "sequences_file_roundtrip", "held_out_families", "block_shuffle", "offset_resume", "shuffled_files"}
ONE_TASK_WINDOW = re.compile(r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition")
STREAMS = {name for name in registry.QUERIES if name.startswith("stream_")}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - STREAMS))
def test_joins_and_windows(spark, sf_dir, name):
    text = plan(registry.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text or name in NESTED_LOOPS
    assert not ONE_TASK_WINDOW.search(text) or name in SMALL_WINDOWS


def test_scans_are_pruned(spark, sf_dir):
    text = plan(registry.QUERIES["structure_metrics"](spark, sf_dir))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in text
    text = plan(registry.QUERIES["exclusion_antijoin"](spark, sf_dir))
    assert "EqualTo(quality,0)" in text


@pytest.mark.parametrize("name", ["assay_spearman", "ensemble_profile_scores"])
def test_cells_and_rows_of_alignments_are_not_broadcast(spark, sf_dir, name):
    # Estimates leave out the explode to cells, so that tables of many cells looked small enough.
    rows = re.compile(r"BroadcastExchange[^\n]*\n(?:[^\n]*[-:] (?:\*\(\d+\) )?(?:Project|Filter|ColumnarToRow)[^\n]*\n)*[^\n]*(?:Generate|FileScan)")
    assert not rows.search(plan(registry.QUERIES[name](spark, sf_dir)))


def test_documents_are_not_exploded_to_kmers(spark, sf_dir):
    exploded = re.compile(r"Generate[^\n]*\n(?:[^\n]*[-:] (?:\*\(\d+\) )?(?:Project|Filter|ColumnarToRow)[^\n]*\n)*[^\n]*FileScan[^\n]*doc_id")
    text = plan(registry.QUERIES["kmer_cluster"](spark, sf_dir))
    assert not exploded.search(text)
    assert "BroadcastExchange" not in text
