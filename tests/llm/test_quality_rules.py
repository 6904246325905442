from __future__ import annotations

import re

from lamina.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(words) < 1000 else set()
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_against_brute_force(odd_docs, odd_rows):
    got = sorted(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in Q.judge(odd_docs).collect())
    assert got == sorted(measured(t) for _, t, _, _ in odd_rows)


def test_short_and_repetitive_texts_fail(odd_docs):
    failed = {r.doc_id for r in Q.judge(odd_docs).filter("base_failed").collect()}
    assert {1, 2, 3, 9, 12, 13} <= failed and 4 not in failed


def test_clean_texts_stay_with_their_columns(odd_docs):
    kept = Q.apply_rules(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {4, 5, 6, 7, 100, 139} <= {r.doc_id for r in kept.collect()}


def test_symbols_are_rejected(spark, odd_docs):
    text = " ".join(f"word{i}%%% the" for i in range(30))
    row = Q.judge(odd_docs.limit(1).selectExpr("1L as doc_id", f"'{text}' as text")).first()
    assert not row.base_failed and not row.kept and "symbols_per_word" in row.failed_rules


def test_rule_table_is_a_parameter(odd_docs):
    none = Q.judge(odd_docs, rules=())
    assert none.filter("kept = base_failed").count() == 0


def test_empty_table(no_docs):
    assert Q.judge(no_docs).count() == 0 and Q.apply_rules(no_docs).count() == 0
