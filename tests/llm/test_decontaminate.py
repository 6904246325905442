from __future__ import annotations

import random
import re

import pytest

from lamina.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    words, hit, found = split(text), set(), set()
    for item, body in items:
        own = split(body)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[i : i + n]:
                    hit.update(range(at, at + n))
                    found.add(item)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    draw = lambda n: [rng.choice("the of a b c ß 日本 x1 don t".split()) for _ in range(n)]
    items = [(1, " ".join(draw(30))), (2, " ".join(draw(12))), (3, "short item here"), (4, "one"), (5, ""), (6, None), (7, "..."), (None, " ".join(draw(15))), (2, " ".join(draw(11)))]
    bodies = [b for _, b in items if b]
    docs = [(None, None), (1, ""), (1, "one"), (2, "One-TWO; a SHORT item, here! and one more")]
    for i in range(80):
        words = draw(rng.randrange(5, 60))
        own = split(rng.choice(bodies))
        at = rng.randrange(len(words))
        words[at:at] = own[rng.randrange(3) :][: rng.randrange(5, 20)]
        docs.append((10 + i, rng.choice([" ", "\n", ", "]).join(words)))
    docs += docs[-2:]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_against_brute_force(tables, block_bytes):
    docs, bench, rows, items = tables
    import hashlib

    want = sorted((str(i), *brute(t, items)) for i, t in rows)
    got = D.digest(D.scan_documents(docs, bench, block_bytes)).collect()
    expected = sorted((i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for i, n, h, f in want)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == expected


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_removal_keeps_clean_rows(tables, block_bytes):
    docs, bench, rows, items = tables
    kept = D.remove_contaminated(docs.selectExpr("*", "1 as spans", "'x' as items"), bench, block_bytes)
    assert kept.columns == ["doc_id", "text", "spans", "items"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if not brute(t, items)[1])


def test_long_text_and_empty_tables(spark, tables):
    docs, bench, _, _ = tables
    long = spark.createDataFrame([(1, "z " * 200_000 + "short item here")], "doc_id long, text string")
    assert D.digest(D.scan_documents(long, bench)).first().n_hit == 3
    assert D.scan_documents(docs.limit(0), bench).count() == 0
    assert D.digest(D.scan_documents(docs, bench.limit(0))).filter("contaminated").count() == 0
    assert D.remove_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_pieces_have_all_windows():
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(10**rng.randrange(1, 9))}" for _ in range(500))
    windows = lambda t: {tuple(t.split()[i : i + 10]) for i in range(len(t.split()) - 9)}
    for most in (1, 40, 200, 1000, 10_000):
        found = list(D.pieces(text, most))
        assert set().union(*map(windows, found)) == windows(text)
        assert max(map(len, found)) <= max(most, 100) + 100
    assert list(D.pieces("", 1)) == [""] and list(D.pieces("a b", 1)) == ["a b"]


def test_many_windows_with_one_last_block():
    rng = random.Random(4)
    items = [(i, " ".join(f"x{rng.randrange(1000)}" for _ in range(7)) + " end of it") for i in range(500)]
    tools = D.searchers(items)
    for i, text in items[::50]:
        assert D.search(D.words_of(f"a b {text} c"), tools) == ([(2, 12)], {i})
    assert D.search(D.words_of("a b c d e f g end of it"), tools) == ([], set())


def test_a_full_block_stays_small():
    """16 MB of benchmark text; run in a process of its own so that its peak is the searchers'."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import random, resource
from lamina.llm import decontaminate as D
rng = random.Random(1)
words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(200_000)]
items = [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(9_000)]
assert sum(len(t) for _, t in items) > 14 << 20
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
tools = D.searchers(items)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    assert int(out.stdout.split()[-1]) < 500
