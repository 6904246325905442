"""Threshold rules over length, symbol, stop-word and line ratios, as one Spark projection.

The threshold table RULES is compiled into Column expressions; no user function runs. Defined cases:
a null or empty text has no words, so every count is 0 and base_failed is true; repeated rows each get
their own row; extra columns of the input are ignored by measure() and passed through by apply_rules().
Two five-word windows count as equal if the 64-bit hashes of their words' hashes are equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import SPACES, packed

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "are", "this", "at", "from",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "dans", "pour", "est", "en", "par", "sur", "au", "pas",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine",
    "el", "los", "las", "y", "del", "se", "por", "con", "una", "su", "para", "como", "al", "lo",
)


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= ratio <= high; it is not judged below min_words words."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None
    min_words: int = 10


#: The threshold table. Ratios are SQL over the measured counts.
RULES = (
    Rule("word_length", "word_chars / n_words", low=2.0, high=15.0),
    Rule("symbols_per_word", "n_symbols / n_words", high=0.15),
    Rule("stop_word_share", "n_stop_words / n_words", low=0.02, min_words=40),
    Rule("duplicate_lines", "n_dup_lines / n_lines", high=0.5),
)


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts that the rules need, one row for each row of docs, within the row and without a shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *keep,
        F.filter(F.split(body, SPACES), lambda w: w != "").alias("_words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        *keep,
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    rows = rows.withColumn(
        "_windows",
        F.when(
            F.col("n_words") >= 5,
            F.transform(F.sequence(F.lit(0), F.size("_hashes") - 5), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(5)])),
        ).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    rows = rows.withColumn("_repeats", F.size("_windows") != F.size(F.array_distinct("_windows")))
    rows = rows.withColumn(
        "_sorted",
        F.when(F.col("_repeats"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
            F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
        ),
    )
    twice = F.filter(
        "_sorted",
        lambda e, j: (e["h"] == F.get("_sorted", j + 1)["h"]) | (e["h"] == F.get("_sorted", j - 1)["h"]),
    )
    rows = rows.withColumn("_at", F.array_sort(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda i, j: F.least(F.lit(5), F.coalesce(F.get("_at", j + 1) - i, F.lit(5)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    # A row number in a count that every rule reads keeps the optimizer from moving filters on the result below
    # these projections: that would copy all of them into one condition, and planning would not end.
    n_words = F.when(F.monotonically_increasing_id() >= 0, F.col("n_words")).alias("n_words")
    return rows.select(
        *keep, n_words, "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"), "n_stop_words"
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """For each rule a Column that is true where the document breaks it; never null."""
    broken = {}
    for rule in rules:
        ratio, fails = F.expr(f"try_divide({rule.ratio.replace(' / ', ', ')})"), F.lit(False)
        if rule.low is not None:
            fails = fails | (ratio < F.lit(float(rule.low)))
        if rule.high is not None:
            fails = fails | (ratio > F.lit(float(rule.high)))
        broken[rule.name] = F.coalesce((F.col("n_words") >= rule.min_words) & fails, F.lit(False))
    return broken


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, base_failed, the names of the broken rules, and kept."""
    counts = measure(docs, text, keep)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    names = F.array_compact(F.array(*[F.when(fails, F.lit(name)) for name, fails in compiled(rules).items()]))
    judged = counts.withColumn("base_failed", base).withColumn("failed_rules", F.array_join(names, ","))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    whole = docs.select(packed(docs), F.col(text).alias("_text"))
    return judge(whole, rules, "_text", ("_row",)).filter("kept").select("_row.*")
