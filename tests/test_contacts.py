"""Contact scores and neighbour counts against dense numpy over all states and pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lamina.operators import alignment as A

STATES = "-ACDE"


def test_contact_scores(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice(STATES) for _ in range(6)) for _ in range(40)]
    rows = [r[:3] + r[0] + r[4:] for r in rows]  # columns 0 and 3 agree
    x = np.array([[[c == s for s in STATES] for c in r] for r in rows], dtype=float).reshape(40, -1)
    f = x.mean(axis=0)
    c = x.T @ x / 40 - np.outer(f, f)
    inverse = np.linalg.inv(c + np.eye(len(c)) * 4.5 / np.sqrt(40))
    w = inverse / np.diagonal(inverse)[None, :] - np.eye(len(c))
    w = (0.5 * (w + w.T)).reshape(6, 5, 6, 5)[:, 1:, :, 1:]
    norm = np.sqrt((w**2).sum(axis=(1, 3))) * (1 - np.eye(6))
    want = norm - norm.mean(axis=1, keepdims=True) * norm.mean(axis=0, keepdims=True) / norm.mean()
    long = spark.createDataFrame([("m", i, j, ch, 1.0) for i, r in enumerate(rows) for j, ch in enumerate(r)], "msa_id string, row_id long, col int, token string, weight double")
    singles = long.groupBy("msa_id", long.col.alias("i"), long.token.alias("x")).count().selectExpr("msa_id", "i", "x", "count / 40 as frequency", "40.0D as total")
    got = {(r.i, r.j): r.score for r in A.contact_scores(A.pair_frequencies(long), singles).collect()}
    assert len(got) == 15 and max(got, key=got.get) == (0, 3)
    assert all(v == pytest.approx(want[i, j], abs=1e-9) for (i, j), v in got.items())


@pytest.mark.parametrize("block", [512, 7])
def test_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK_ROWS", block)
    rng = random.Random(5)
    base = ["".join(rng.choice(STATES) for _ in range(12)) for _ in range(6)]
    rows = [("a" if i % 3 else "b", i, "".join(c if rng.random() < 0.85 else rng.choice(STATES) for c in rng.choice(base))) for i in range(60)]
    rows += [("a", 100, rows[1][2]), ("a", 101, "-" * 12), ("a", 102, "-" * 12)]
    table = spark.createDataFrame(rows, "msa_id string, row_id long, aln string")
    got = {(r.msa_id, r.row_id): r for r in A.homology_weights(table, 0.3).collect()}
    strict = {(r.msa_id, r.row_id): r.weight for r in A.strict_weights(table, 0.7).collect()}
    for m, i, x in rows:
        size = sum(c != "-" for c in x)
        others = [y for n, _, y in rows if n == m]
        near = sum(1 - sum(p == q != "-" for p, q in zip(x, y, strict=True)) / size <= 0.3 for y in others) if size else 2
        assert got[m, i].neighbours == near
        assert strict[m, i] == pytest.approx(1 / sum(sum(p == q for p, q in zip(x, y, strict=True)) / 12 > 0.7 for y in others))
