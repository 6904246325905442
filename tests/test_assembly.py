"""Samples to a budget, rolling files, strict JSON, best rows of several blocks, and a stream that resumes."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lamina.operators import alignment, budget, catalogue, sampling
from lamina.sources import text_formats
from lamina.streaming import monitor


def _rows(spark, lengths):
    return spark.createDataFrame([("f", i, n) for i, n in enumerate(lengths)], "family_id string, member_idx int, seq_len int")


def _kept(df):
    return [(r.member_idx, r.kept_len) for r in df.orderBy("place").collect()]


@pytest.mark.parametrize(
    ("lengths", "limit", "want"),
    [
        ([5, 5, 5], 100, [(0, 5), (1, 5), (2, 5)]),
        ([5, 5, 5], 20, [(0, 5), (1, 5), (2, 5)]),  # the last reaches the budget and its slice is whole
        ([5, 5, 5], 18, [(0, 5), (1, 5), (2, 3)]),
        ([5, 5, 5], 16, [(0, 5), (1, 1)]),  # one token is left: the last whole member loses all but one
        ([5, 5, 5], 15, [(0, 5), (1, 5)]),
        ([50, 5], 20, [(0, 17)]),
    ],
)
def test_raw_sample(spark, lengths, limit, want):
    assert _kept(budget.raw_sample(_rows(spark, lengths), limit)) == want


def test_raw_sample_first(spark):
    rows = _rows(spark, [7, 3, 4, 5])
    assert {i for i, _ in _kept(budget.raw_sample(rows, 99, "s", drop_first=True))} == {1, 2, 3}
    assert _kept(budget.raw_sample(rows, 99, "s", keep_first=True))[0] == (0, 7)
    assert _kept(budget.raw_sample(_rows(spark, [4]), 99, "s", drop_first=True)) == [(0, 4)]
    for r in budget.raw_sample(_rows(spark, [900] * 5), 1500, "t").collect():
        assert 0 <= r.kept_start <= r.seq_len - r.kept_len


def test_rolling_files(spark, tmp_path):
    path = str(tmp_path / "files")
    sampling.write_rolling(spark.range(105).withColumnRenamed("id", "k"), path, "k", 20)
    back = spark.read.parquet(path)
    assert sorted(r["count"] for r in back.groupBy("file_no").count().collect()) == [5, 20, 20, 20, 20, 20]
    assert sorted(r.k for r in back.collect()) == list(range(105))
    assert back.groupBy(F.input_file_name()).count().count() == 6


def test_strict_json(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": 2}',)], "j string")
    assert rows.select(text_formats.strict_json(F.col("j"), ["a", "b", "c"])).first()[0]
    with pytest.raises(PySparkException, match="unknown fields: b"):
        rows.select(text_formats.strict_json(F.col("j"), ["a"])).collect()


def test_best_among_over_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("m", i, "".join(rng.choice("AC-") for _ in range(9))) for i in range(40)] + [("m", 40, "-" * 9), ("one", 0, "ACA")]
    monkeypatch.setattr(alignment, "BLOCK_ROWS", 7)
    got = {(r.msa_id, r.row_id): r.best for r in alignment.best_among(spark.createDataFrame(rows, "msa_id string, row_id int, aln string")).collect()}

    def share(a, b):
        longer = max(len(a) - a.count("-"), len(b) - b.count("-"))
        return sum(x == y != "-" for x, y in zip(a, b, strict=True)) / longer if longer else 0.0

    for m, i, a in rows:
        others = [share(a, b) for n, j, b in rows if n == m and j != i]
        assert got[m, i] == (pytest.approx(max(others)) if others else None)


def test_a_stream_resumes(spark, tmp_path):
    source, checkpoint, sink = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))

    def run():
        stream = monitor.sample_stream(spark, source, "id long")
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
        return sorted(r.id for r in spark.read.schema("id long").parquet(sink).collect())

    spark.range(3).coalesce(1).write.parquet(source)
    assert run() == [0, 1, 2]
    spark.range(3, 5).coalesce(1).write.mode("append").parquet(source)
    assert run() == [0, 1, 2, 3, 4]  # files that were read are not read again
    assert run() == [0, 1, 2, 3, 4]


def test_cached_weights(spark, tmp_path):
    path = str(tmp_path / "weights")
    rows = [("m", 0, "ACDEF"), ("m", 1, "ACDEF"), ("m", 2, "ACDEY"), ("n", 0, "WWWWW"), ("n", 1, "ACDEF")]

    def weights(rows, theta=0.2, **options):
        found = catalogue.cached_weights(spark.createDataFrame(rows, "msa_id string, row_id int, aln string"), path, theta, **options)
        return {(r.msa_id, r.row_id): r.weight for r in found.collect()}

    def stored():
        return spark.read.parquet(path).select("content_hash", "theta").distinct().count()

    first = weights(rows)
    assert first == {("m", 0): 1 / 3, ("m", 1): 1 / 3, ("m", 2): 1 / 3, ("n", 0): 1, ("n", 1): 1}
    assert stored() == 2 and weights(rows) == first and stored() == 2
    assert weights([("other", r, a) for m, r, a in rows if m == "m"]) == {("other", r): 1 / 3 for r in range(3)} and stored() == 2
    assert weights(rows, 0.1)["m", 2] == 1 and stored() == 4
    assert weights([*rows, ("m", 3, "ACDEF")])["m", 0] == 1 / 4 and stored() == 5
    changed = spark.read.parquet(path).selectExpr("content_hash", "theta", "aln", "weight * 2 as weight", "written + interval 1 second as written").collect()
    spark.createDataFrame(changed).write.mode("append").parquet(path)
    assert weights(rows)["n", 0] == 2  # read, not computed
