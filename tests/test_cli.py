from __future__ import annotations

from pyspark.sql import functions as F

from lamina import cli
from lamina.operators import catalogue as C
from lamina.operators import generation as G

A3M = ">q\nACDEFG\n>a\nACDE-G\n>b\nACaDQFG\n>c\nAC-EFG\n"


def test_score(spark, tmp_path):
    (tmp_path / "p.a3m").write_text(A3M)
    (tmp_path / "v.csv").write_text("mutant,mutated_sequence,DMS_score\nx,ACDEFG,3\ny,ACDQFG,2\nz,WWWWWW,1\n")
    about = cli.score(spark, str(tmp_path / "p.a3m"), str(tmp_path / "v.csv"), str(tmp_path / "out"))
    rows = {r.name: float(r.score) for r in spark.read.option("header", True).csv(str(tmp_path / "out/scores")).collect()}
    assert rows["x"] > rows["y"] > rows["z"] and about["spearman"] == 1.0


def test_generate(spark, tmp_path):
    (tmp_path / "p.a3m").write_text(A3M)
    cli.main(["generate", "--prompt", str(tmp_path / "p.a3m"), "--out", str(tmp_path / "f"), "--num-samples", "7", "--least-share", "0.5"])
    names = [r.value for r in spark.read.text(str(tmp_path / "f")).collect() if r.value.startswith(">")]
    assert len(names) == 7 and all("_log_likelihood_-" in n for n in names)


def test_acceptance_and_fallback(spark):
    prompts = spark.createDataFrame([("m", i, s) for i, s in enumerate(["ACDEFG", "ACDEFG", "WWWEFG"])], "msa_id string, row_id long, aln string")
    draw = lambda **k: G.generate(G.ProfileSampler(), prompts, 20, "s", **k).collect()
    assert all(r.accepted for r in draw(least_identity=0.5, retries=4))
    never = draw(least_share=9.0, retries=2)
    assert len(never) == 20 and not any(r.accepted for r in never)
    assert sorted(draw()) == sorted(draw())


def test_evaluator_needs_enough_samples(spark):
    rows = spark.createDataFrame([("i", k, "AC") for k in range(3)], "instance string, k long, sequence string")
    assert C.LengthEvaluator(2).first_samples(rows, "instance", "k").count() == 2
    try:
        C.LengthEvaluator(5).first_samples(rows, "instance", "k").collect()
    except Exception as error:
        assert "too few" in str(error)
    else:
        raise AssertionError("too few samples were accepted")


def test_cache_is_keyed_by_content_and_theta(spark):
    rows = spark.createDataFrame([("a", "X"), ("b", "Y")], "msa_id string, content string")
    cache = rows.filter("msa_id = 'a'").select(F.sha2("content", 256).alias("content_hash"), F.lit(0.2).alias("theta"))
    assert [r.msa_id for r in C.missing_weights(rows, cache, 0.2).collect()] == ["b"]
    assert C.missing_weights(rows, cache, 0.3).count() == 2
