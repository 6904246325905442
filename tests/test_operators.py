"""Operators on small tables with hand-made results."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lamina.operators import alignment as A
from lamina.operators import budget as B
from lamina.operators import evaluation as E
from lamina.operators import packing as P
from lamina.operators import sampling as S
from lamina.operators import scoring as L
from lamina.operators import splits as T
from lamina.operators import tokens as K
from lamina.sources import text_formats as X


def test_homology_weights(spark):
    rows = spark.createDataFrame([("m", 0, "ACD-E"), ("m", 1, "ACD-E"), ("m", 2, "AC--E"), ("g", 0, "---")], "msa_id string, row_id long, aln string")
    got = {(r.msa_id, r.row_id): r for r in A.homology_weights(rows, 0.2).collect()}
    assert [got["m", i].neighbours for i in range(3)] == [2, 2, 3]
    assert [got["m", i].p for i in range(3)] == pytest.approx([0.375, 0.375, 0.25])
    assert got["m", 0].n_eff == pytest.approx(4 / 3)
    assert got["g", 0].neighbours == 1


def test_accuracy(spark):
    labels = [1, 2, 3, 4, 5, 3, 4, 5, 3, 4]
    wrong = [1, 5, 3, 4, 5, 5, 4, 3, 5, 4]
    def table(predictions):
        rows = [(0, i, x, y, "d") for i, (x, y) in enumerate(zip(labels, predictions, strict=True))]
        df = spark.createDataFrame(rows, "k long, pos long, label long, prediction long, ds string")
        return K.accuracy(K.numbered(df, "k", "pos", F.col("label") == 1, F.col("label") == 4), "k", "ds").filter("ds is null").first()
    perfect = table(labels)
    assert (perfect.global_accuracy, perfect.first_accuracy, perfect.last_accuracy) == (1.0, 1.0, 1.0)
    assert table(wrong).global_accuracy == pytest.approx(0.6)
    ignored = spark.createDataFrame([(0, 0, -100, 1, "d")], "k long, pos long, label long, prediction long, ds string")
    out = K.accuracy(K.numbered(ignored, "k", "pos", F.lit(True), F.lit(False)), "k", "ds").collect()
    assert all(r.global_accuracy is None for r in out)


def lengths(spark, *n):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(n)], "family_id string, member_idx int, seq_len int")


def test_raw_budget(spark):
    assert [r.kept_len for r in B.raw_cut(lengths(spark, 100, 150, 200), 50).collect()] == [47]
    assert [r.kept_len for r in B.raw_cut(lengths(spark, 10, 10, 100), 50).orderBy("member_idx").collect()] == [10, 10, 25]


def test_aligned_budget_is_never_filled(spark):
    assert B.aligned_cut(lengths(spark, 5, 5), 14).count() == 1
    assert B.aligned_cut(lengths(spark, 5, 5), 15).count() == 2
    assert B.prompt_cut(lengths(spark, 5, 5), 14).count() == 2


def docs(spark, *n):
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(n)], "shard long, k long, tokens long")


@pytest.mark.parametrize("n,size,capacity,bins,fullest", [(100, 10, 10, 100, 10), (100, 10, 20, 50, 20), (100, 9, 15, 100, 9)])
def test_greedy_bins(spark, n, size, capacity, bins, fullest):
    out = P.greedy_bins(docs(spark, *[size] * n), capacity, "shard", "k", "tokens").groupBy("bin_id").agg(F.sum("tokens").alias("t")).collect()
    assert (len(out), max(r.t for r in out)) == (bins, fullest)


def test_oversize_examples_close_the_bin(spark):
    out = P.greedy_bins(docs(spark, 3, 50, 3, 3), 10, "shard", "k", "tokens").orderBy("k").collect()
    assert [(r.k, r.bin_id) for r in out] == [(0, 0), (2, 1), (3, 1)]


def test_split_bins(spark):
    out = P.split_bins(docs(spark, *[9] * 100), 15, "shard", "k", "tokens", "k", overhang=1).groupBy("bin_id").agg(F.sum("n_tokens").alias("t")).orderBy("bin_id").collect()
    assert {r.t for r in out[:-1]} == {15}
    one = P.split_bins(docs(spark, 10), 5, "shard", "k", "tokens", "k", overhang=1).orderBy("bin_id").collect()
    assert [r.n_tokens for r in one] == [5, 5, 2]


def test_block_shuffle_is_a_permutation(spark):
    out = S.block_shuffled(spark.range(95).withColumnRenamed("id", "i"), "i", 10, "s").collect()
    assert sorted(r.new_pos for r in out) == list(range(95))
    spread = {}
    for r in out:
        spread.setdefault(r.block, []).append(r.new_pos)
    assert all(max(v) - min(v) == len(v) - 1 for v in spread.values())


def test_shard_formulas(spark):
    rows = spark.range(23).select(F.col("id").alias("i"), F.lit(23).alias("n"))
    out = rows.select(S.shard_floor(F.col("i"), F.col("n"), 5).alias("a"), S.shard_balanced(F.col("i"), F.col("n"), 5).alias("b"), S.shard_ceiling(F.col("i"), F.col("n"), 5).alias("c"))
    count = lambda c: [r["count"] for r in out.groupBy(c).count().orderBy(c).collect()]
    assert count("a") == [4, 4, 4, 4, 7]
    assert sorted(count("b")) == [4, 4, 5, 5, 5]
    assert count("c") == [5, 5, 5, 5, 3]


def test_force_first(spark):
    rows = spark.createDataFrame([("g", i, 1.0) for i in range(20)], "g string, k long, w double")
    out = S.weighted_order(rows, "s", "g", "k", "w", force_first=True)
    assert out.filter("rank = 1").first().k == 0
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 21))


def test_routing(spark):
    members = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("b", "4"), ("c", "5"), ("c", "6"), ("d", "7")], "family_id string, query_header string")
    splits = spark.createDataFrame([("1", "val"), ("3", "val"), ("4", "val"), ("5", "val"), ("6", "test"), ("7", "both")], "query_header string, split string")
    got = {(r.family_id, r.query_header): r.route for r in T.routed(members, splits).collect()}
    assert got == {("a", "2"): "train", ("b", "3"): "val", ("b", "4"): "val"}


def test_spearman_of_constants_is_zero(spark):
    rows = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 2.0)], "g string, x double, y double")
    assert E.spearman(rows, "g", "x", "y").first().spearman == 0.0


def test_nucleus_keeps_one(spark):
    rows = spark.createDataFrame([("s", "a", 0.9), ("s", "b", 0.1)], "g string, t string, p double")
    out = S.nucleus(rows, "g", "t", "p", 0.5).collect()
    assert [(r.t, r.renormalised) for r in out] == [("a", 1.0)]


def test_global_alignment(spark):
    rows = spark.createDataFrame([("ABCD", "ABD"), ("", ""), ("A", "")], "a string, b string")
    got = [r.x for r in rows.select(A.global_alignment_identity(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [0.75, 1.0, 0.0]


def test_prompt_views(spark):
    def views(*s, weights=False):
        rows = spark.createDataFrame([("p", str(i), x) for i, x in enumerate(s)], "prompt_id string, accession string, sequence string")
        out = L.resolved_prompts(rows, weights).orderBy("accession").collect()
        return [r.conditioning for r in out], [r.aligned for r in out]
    assert views("ACD-E", "ACD-E", "AC--E") == (["ACDE", "ACDE", "ACE"], ["ACD-E", "ACD-E", "AC--E"])
    assert views("ACD-E", "ACDaa-E", "ACD..-E") == (["ACDE", "ACDAAE", "ACDE"], ["ACD-E"] * 3)
    assert views("ACDE", "ACDEF", "AC")[1] == [None] * 3
    with pytest.raises(Exception, match="not aligned"):
        views("ACDE", "ACD", weights=True)
    with pytest.raises(ValueError, match="max_tokens"):
        L.checked_generation_length(9000)


def test_fasta(spark):
    files = spark.createDataFrame([("x.fa", ">a one\nAC\nGT\n>b\n\n>c\nA>C\n")], "file string, value string")
    got = [(r.accession, r.sequence) for r in X.fasta(files).orderBy("seq_idx").collect()]
    assert got == [("a one", "ACGT"), ("b", ""), ("c", "A>C")]
    with pytest.raises(Exception, match="no header"):
        X.fasta(spark.createDataFrame([("y", "AC\n>a\nC")], "file string, value string")).collect()


def test_mapping_last_line_wins(spark):
    files = spark.createDataFrame([("m", ">f\na:1,2\na:3\nb:0")], "file string, value string")
    got = sorted((r.file, r.member_pos, r.seq_idx) for r in X.mapping_file(files).collect())
    assert got == [("a", 0, 3), ("b", 0, 0)]


def test_sequences_file_needs_pairs(spark):
    with pytest.raises(Exception, match="odd number"):
        X.sequences_file(spark.createDataFrame([("s", ">a\nAC\n>b\n")], "file string, value string")).collect()


def test_read_and_write_fasta(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ACD"), ("b", "EF")], "accession string, sequence string")
    X.write_fasta(rows.coalesce(1), str(tmp_path / "f"), F.col("accession"), F.col("sequence"))
    got = X.fasta(X.read_files(spark, str(tmp_path / "f"))).collect()
    assert sorted((r.accession, r.sequence) for r in got) == [("a", "ACD"), ("b", "EF")]
    records = X.read_records(spark, str(tmp_path / "f")).select(X.record_fields(F.col("value")).alias("f")).collect()
    assert sorted(r.f.accession for r in records) == ["a", "b"]


def test_superposition(spark):
    xs = [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 3.0]]
    turned = [[-y, x, z + 5] for x, y, z in xs]
    rows = spark.createDataFrame([(1, xs, turned)], "k long, xs array<array<double>>, ys array<array<double>>")
    assert A.superposition_rmsd(rows, "k").first().rmsd == pytest.approx(0, abs=1e-6)


def test_kmers_of_many_targets_count(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    passage, stem = word(40), word(16)
    targets = [(i, word(20) + passage + word(20)) for i in range(9)] + [(i, stem + word(50)) for i in range(20, 30)] + [(40, None), (41, "AC"), (3, passage), (50, passage[:25] + word(30))]
    queries = [(1, word(50) + passage), (2, passage[:31]), (3, passage[:30]), (4, stem + word(30)), (5, stem + targets[9][1][16:40]), (None, passage), (None, passage), (6, word(60))]

    def kmers(text):
        return {text[i : i + 12] for i in range(len(text) - 11)} if text else set()

    expected = {}
    for q, a in queries:
        for t, b in targets:
            expected[q, t] = expected.get((q, t), 0) + len(kmers(a) & kmers(b))
    expected = {pair: n for pair, n in expected.items() if n >= 20}
    got = T.kmer_candidates(spark.createDataFrame(queries, "id long, sequence string"), spark.createDataFrame(targets, "id long, sequence string"), 12, 20)
    assert {(r.query_id, r.target_id): r.shared for r in got.collect()} == expected
    assert {(2, i) for i in range(9)} <= set(expected)


def test_scores_of_copies_are_their_texts(spark):
    contexts = [("m", 0, 1, "AC-"), ("m", 0, 2, "AD-"), ("m", 1, 1, "AC-"), ("n", 0, 5, "DD")]
    # Copies, a candidate of two rows, a longer text than its contexts, null, and an alignment without contexts.
    candidates = [("m", 1, "AC-"), ("m", 2, "AC-"), ("m", 2, "D"), ("m", 3, "DDDD"), ("m", 4, None), ("n", 1, "AC"), ("n", 1, "AC"), ("o", 1, "AC")]
    letters = set("".join(t for *_, t in contexts) + "".join(t for *_, t in candidates if t))
    found = {}
    for m, c, text in candidates:
        for a, e in {x[:2] for x in contexts if x[0] == m}:
            own = [t for x, y, _, t in contexts if (x, y) == (a, e)]
            for i, letter in enumerate((text or "")[: len(own[0])]):
                share = sum(t[i] == letter for t in own) / len(own)
                found.setdefault((m, c), {}).setdefault(e, []).append((i, math.log(0.9 * share + 0.1 / len(letters))))
    mean = lambda x: sum(x) / len(x)
    asked = []

    class Counted(L.ProfileScorer):
        def token_scores(self, contexts, candidates):
            asked.append(candidates.filter("aln is not null").count())
            return super().token_scores(contexts, candidates)

    got = L.score(
        Counted(), spark.createDataFrame(contexts, "msa_id string, member int, row_id long, aln string"), spark.createDataFrame(candidates, "msa_id string, candidate long, aln string"), True
    ).collect()
    assert asked == [5]
    assert {(r.msa_id, r.candidate) for r in got} == set(found) and len(got) == len(found)
    for r in got:
        members = found[r.msa_id, r.candidate]
        assert r.members == len(members)
        assert r.score == pytest.approx(mean([mean([x for _, x in v]) for v in members.values()]), abs=1e-8)
        positions = sorted({i for v in members.values() for i, _ in v})
        assert r.residue_scores == pytest.approx([mean([x for v in members.values() for j, x in v if j == i]) for i in positions])


@pytest.mark.parametrize("k", [1, 7, 12, 33])
def test_only_kmers_of_targets_become_rows(spark, k):
    rng = random.Random(k)
    word = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZ": "".join(rng.choice(a) for _ in range(n))
    passage, foreign = word(60), word(50, "aé中😀")
    targets = [(1, word(200) + passage), (2, foreign), (3, None), (4, ""), (5, "AB")]
    # Windows do not go on from one text into the next; one text has more windows than are hashed at once.
    queries = [(1, passage[:20]), (2, passage[20:]), (3, None), (4, ""), (5, word(T.WINDOWS - 5) + passage + word(90)), (6, "é" + passage + foreign), (7, foreign[:40] + foreign[:40]), (None, passage)]
    kmers = lambda x: {x[i : i + k] for i in range(len(x or "") - k + 1)}
    held = set().union(*(kmers(x) for _, x in targets))
    expected = {(q, x) for q, text in queries for x in kmers(text) & held}
    schema = "id long, sequence string"
    rows = [tuple(r) for r in T.filtered_kmers(spark.createDataFrame(queries, schema).coalesce(1), spark.createDataFrame(targets, schema), k).collect()]
    assert len(rows) == len(set(rows))
    assert expected <= set(rows)
    assert len(set(rows) - expected) < 0.01 * T.WINDOWS


def test_no_kmers_without_targets(spark):
    queries = spark.createDataFrame([(1, "ABCDEFGHIJKLMNOPQ")], "id long, sequence string")
    assert T.kmer_candidates(queries, queries.filter("id = 2"), 12, 1).count() == 0
    assert T.kmer_candidates(queries.filter("id = 2"), queries, 12, 1).count() == 0
    assert [tuple(r) for r in T.kmer_candidates(queries, queries, 12, 1).collect()] == [(1, 1, 6)]
