from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from texts import as_table

from lamina.llm import source_mixing as M


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i} " + "w " * (i % 13), "en", "big" if i % 4 else f"s{i % 3}") for i in range(600)]
    return as_table(spark, rows)


def shares(rows):
    total = Counter()
    for r in rows:
        total[r.source] += r.n_tokens
    return {s: n / sum(total.values()) for s, n in total.items()}


def test_passes_meet_limit_and_weights(docs):
    mix = M.Mix(most_passes=2.0, block_docs=16)
    rows = M.schedule(docs, mix).collect()
    plan = {r.source: r for r in M.source_plan(M.units(docs), mix).collect()}
    assert min(r.passes for r in plan.values()) == 1.0 and max(r.passes for r in plan.values()) == pytest.approx(2.0, abs=1e-5)
    got = shares(rows)
    assert all(got[s] == pytest.approx(r.weight, abs=0.01) for s, r in plan.items())
    seen = Counter((r.doc_id, r.pass_no) for r in rows)
    assert set(seen.values()) == {1} and {d for d, _ in seen} == set(range(600))
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.source, r.pass_no, r.block_rank].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in blocks.values())


def test_token_budget(docs):
    for budget in (2_000, 9_000):
        mix = M.Mix(budget_tokens=budget, block_docs=16)
        rows = M.schedule(docs, mix).collect()
        plan = {r.source: r.weight for r in M.source_plan(M.units(docs), mix).collect()}
        longest = max(r.n_tokens for r in rows)
        assert abs(sum(r.n_tokens for r in rows) - budget) <= len(plan) * longest
        for source, weight in plan.items():
            assert abs(sum(r.n_tokens for r in rows if r.source == source) - weight * budget) <= longest


def test_target_entropy(docs):
    plan = M.source_plan(M.units(docs), M.Mix(target_entropy=1.3)).collect()
    assert -sum(r.weight * math.log(r.weight) for r in plan) == pytest.approx(1.3, abs=1e-5)


def test_result_does_not_depend_on_partitions(docs):
    key = lambda rows: sorted((r.doc_id, r.pass_no, r.block_rank, r.slot) for r in rows)
    assert key(M.schedule(docs).collect()) == key(M.schedule(docs.repartition(5)).collect())


def test_mixed_rows(odd_docs, no_docs):
    out = M.mixed(odd_docs)
    assert out.columns == odd_docs.columns
    have = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    before = Counter((r.doc_id, r.text, r.source) for r in odd_docs.collect())
    assert set(have) == set(before) and all(before[k] <= have[k] <= 2 * before[k] for k in before)
    assert M.mixed(no_docs).count() == 0


def test_one_source(odd_docs):
    assert M.mixed(odd_docs.filter("source = 'a'")).count() == odd_docs.filter("source = 'a'").count()
