from __future__ import annotations

import pytest
import xxhash
from texts import as_table, sentence_text

from lamina.llm import unit_dedup as U


def cut(text):
    """(start, stop, words, normal form) of each unit, character by character: a unit runs from a visible character
    to the end of its line, or past full stops and the like that white space or the line's end follows."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        end = at
        while end < len(text) and text[end] != "\n":
            if text[end] in ".!?":
                while end < len(text) and text[end] in ".!?":
                    end += 1
                if end == len(text) or text[end].isspace():
                    break
            else:
                end += 1
        body = text[at:end].rstrip()
        out.append((at, at + len(body), len(body.split()), " ".join(body.lower().split())))
        at = end
    return out


def rank(doc, text):
    key = xxhash.xxh64((text or "").encode(), seed=42).intdigest()
    return (doc is None, doc or 0, key - (1 << 64) if key >> 63 else key)


def brute(rows, min_words):
    """Spans by document: the lowest id keeps a unit, of equal ids the lowest text hash; the others and later repeats lose it."""
    first = {}
    for doc, text, _, _ in rows:
        for *_, body in cut(text or ""):
            first[body] = min(first.get(body, rank(doc, text)), rank(doc, text))
    out = set()
    for doc, text, _, _ in rows:
        seen, run = set(), []
        for start, stop, words, body in [*cut(text or ""), (0, 0, 0, None)]:
            gone = body is not None and (body in seen or first[body] < rank(doc, text))
            seen.add(body)
            if gone:
                run.append((start, stop, words))
            else:
                if sum(w for *_, w in run) >= min_words:
                    out.add((str(doc), run[0][0], run[-1][1], len(run), sum(w for *_, w in run)))
                run = []
    return out


@pytest.mark.parametrize("min_words", [1, 20])
def test_against_brute_force(odd_docs, odd_rows, min_words):
    got = {(str(r.doc_id), r.start, r.stop, r.n_units, r.n_words) for r in U.repeated_spans(odd_docs, min_words).collect()}
    assert got == brute(odd_rows, min_words)


def test_units_by_both_definitions():
    import random

    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("ab .!?\n\t…") for _ in range(rng.randrange(30)))
        assert [(a, b, w) for a, b, w, _ in U.units(text)] == [(a, b, w) for a, b, w, _ in cut(text)], repr(text)


def test_rows_without_an_id_or_with_one_id(spark):
    import random

    rng = random.Random(8)
    passage = sentence_text(rng, 40)
    rows = [(None if i % 2 else 5, f"{sentence_text(rng, 10)} {passage}", "en", "s") for i in range(40)]
    docs = as_table(spark, rows)
    kept = U.remove_spans(docs, U.repeated_spans(docs)).collect()
    assert sum(passage[:-30].split("\n")[-1] in r.text for r in kept) == 1
    assert {(str(r.doc_id), r.start, r.stop, r.n_units, r.n_words) for r in U.repeated_spans(docs).collect()} == brute(rows, 20)


def test_units_cover_the_text():
    text = "One two. Three 3.5 four!\n  five\n\n…six?! seven\xa0\n."
    found = [text[a:b] for a, b, _, _ in U.units(text)]
    assert found == ["One two.", "Three 3.5 four!", "five", "…six?!", "seven", "."]


def test_passages_inside_lines_are_found(spark):
    import random

    rng = random.Random(9)
    passage = sentence_text(rng, 60)
    rows = [(i, f"{sentence_text(rng, 15)} {passage} {sentence_text(rng, 15)}", "en", "s") for i in range(5)]
    rows += [(100 + i, sentence_text(rng, 90), "en", "s") for i in range(5)]
    docs = as_table(spark, rows)
    spans = U.repeated_spans(docs)
    assert {r.doc_id for r in spans.collect()} == {1, 2, 3, 4}
    assert {r.kept_doc_id for r in spans.collect()} == {0}
    texts = {r.doc_id: r for r in U.remove_spans(docs, spans).collect()}
    assert texts[0].text == rows[0][1] and texts[101].text == rows[6][1]
    for i in range(1, 5):
        cut = rows[i][1]
        for span in reversed(texts[i].removed):
            cut = cut[: span.start] + cut[span.stop :]
        assert texts[i].text == cut and len(cut) < len(rows[i][1]) - 100


def test_removal_keeps_columns_and_rows(odd_docs, no_docs):
    out = U.remove_spans(odd_docs, U.repeated_spans(odd_docs))
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert U.repeated_spans(no_docs).count() == 0 and U.remove_spans(no_docs, U.repeated_spans(no_docs)).count() == 0
