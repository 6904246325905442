from __future__ import annotations

import random

import numpy as np
import pytest

from texts import as_table, words
from lamina.llm import ngram_join as N
from lamina.llm.components import connected_components


def shingles(text, width):
    out = (text or "").encode().lower().split()
    return {tuple(out[i : i + width]) for i in range(max(1, len(out) - width + 1))} if out else set()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t, _, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc, _, _, _) in enumerate(rows):
        if doc is not None and sets[i]:
            ids[root(i)] = min(doc, ids.get(root(i), doc))
    return sorted((str(doc), len(sets[i]), str(ids.get(root(i)) if sets[i] else doc)) for i, (doc, _, _, _) in enumerate(rows))


def found(docs, join):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in N.link_components(docs, join).collect())


def test_odd_documents(odd_docs, odd_rows):
    assert found(odd_docs, N.JaccardJoin()) == brute(odd_rows, 4, 85)


@pytest.mark.parametrize("join", [N.JaccardJoin(), N.JaccardJoin(width=5, percent=80)])
def test_families_of_near_copies(spark, join, monkeypatch):
    rng, rows = random.Random(3), []
    for family in range(6):
        base = words(rng, rng.choice([8, 25, 60, 150]))
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(1000)}"
            rows.append((len(rows) + 1, " ".join(copy), "en", f"s{family}"))
    monkeypatch.setattr(N, "BLOCK_NODES", 16)  # units of several blocks
    assert found(as_table(spark, rows).repartition(4), join) == brute(rows, join.width, join.percent)


@pytest.mark.parametrize("small", ["HOT_RUN", "UNIT_NODES"])
def test_hot_signatures_and_large_units(spark, monkeypatch, small):
    rng, rows = random.Random(13), []
    base, passage = words(rng, 40), words(rng, 45)
    for i in range(150):  # near copies of one text, and texts that share a passage but are not alike
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(1000)}"
        rows.append((len(rows) + 1, " ".join(copy if i % 2 else passage + [f"v{rng.randrange(10**6)}" for _ in range(9)]), "en", "s"))
    monkeypatch.setattr(N, small, 3)
    monkeypatch.setattr(N, "BLOCK_NODES", 16)
    assert found(as_table(spark, rows).repartition(2), N.JaccardJoin()) == brute(rows, 4, 85)


def test_thousands_of_near_copies(spark):
    rng, rows = random.Random(17), []
    base = [f"b{i}" for i in range(50)]
    for _ in range(3000):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
        rows.append((len(rows) + 1, " ".join(copy), "en", "s"))
    sets = [shingles(t, 4) for _, t, _, _ in rows]
    names = {x: i for i, x in enumerate(sorted({x for s in sets for x in s if all(w[:1] == b"b" for w in x)}))}
    table = np.zeros((len(sets), len(names)), dtype=np.float32)
    for i, s in enumerate(sets):
        table[i, [names[x] for x in s if x in names]] = 1  # shingles with a changed word are in one text each
    both, size = (table @ table.T).astype(np.int64), np.array([len(s) for s in sets])
    near = 100 * both >= 85 * (size[:, None] + size[None, :] - both)
    label = np.arange(len(sets))
    while (new := np.where(near, label[None, :], len(sets)).min(axis=1).clip(max=label)).tolist() != label.tolist():
        label = new
    want = {i + 1: int(label[i]) + 1 for i in range(len(sets))}
    got = {r.doc_id: r.component_id for r in N.link_components(as_table(spark, rows).repartition(4)).collect()}
    assert got == want and 1 < len(set(want.values())) < 3000


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for join in (N.JaccardJoin(), N.JaccardJoin(percent=80)):
        for size in [1, 2, 3, 5, 7, 12, 30, 61, 200, 777]:
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
                most = (2 * size * (100 - join.percent)) // (100 + join.percent)
                gone = rng.integers(0, most // 2 + 1)
                b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 62, most // 2 - gone if most // 2 > gone else 0, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= join.percent * (len(a) + len(b) - both):
                    assert len(np.intersect1d(N.signatures(a, join), N.signatures(b, join)))


def test_one_of_each(odd_docs):
    kept = N.one_of_each(odd_docs, N.JaccardJoin(width=5, percent=80))
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert 4 in ids and 5 not in ids and 7 not in ids
    assert {1, 2, 3, 8, 9, 11, 12, 13, 100, 139} <= set(ids) and 10 not in ids


def test_one_of_each_component_whatever_the_ids(spark):
    rng = random.Random(11)
    texts = [" ".join(words(rng, 40)) for _ in range(6)]
    near = texts[0] + " more"  # one shingle more, linked
    rows = [(None, t) for t in texts[:3]] + [(7, t) for t in texts[3:]]  # unrelated, of one size, no id or one id
    rows += [(None, near), (7, texts[3] + " more"), (20, texts[1]), (None, texts[2])]
    rows += [(None, None), (None, ""), (None, " "), (7, ""), (8, ""), (8, "")]
    docs = as_table(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)
    kept = [(r.doc_id, r.text) for r in N.one_of_each(docs, N.JaccardJoin(width=5, percent=80)).collect()]
    assert len(kept) == len(set(kept)) == 11
    assert sum(t in (texts[0], near) for _, t in kept) == 1
    assert [i for i, t in kept if t == texts[1]] == [20]
    assert (None, texts[2]) in kept and {(7, t) for t in texts[4:]} <= set(kept)
    assert sum(t in (texts[3], texts[3] + " more") for _, t in kept) == 1
    assert {(None, None), (None, ""), (None, " "), (7, ""), (8, "")} <= set(kept)


def test_empty_table(no_docs):
    assert N.link_components(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 49), (49, 48), (7, 7), (50, 49), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {48: 48, 49: 48, 50: 48}
