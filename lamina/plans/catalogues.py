"""Queries on catalogues, caches, preprocessing, evaluation runs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import residues as R
from lamina.operators import catalogue as C
from lamina.operators import sampling as S
from lamina.plans import alignments as A
from lamina.plans.proxies import MSA, SEQS
from lamina.session import table
from lamina.sources.relations import aligned, lengths, sequences


def _catalogue(spark, sf):
    return table(spark, sf, "part").select(
        F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("DMS_id"), F.concat("p_name", F.lit(".a2m")).alias("MSA_filename"),
        F.concat("p_type", F.lit(".csv")).alias("DMS_filename"), F.col("p_size").alias("seq_len"), "p_brand",
    )


def assay_selection(spark, sf):
    return C.selected_assays(_catalogue(spark, sf), [f"A{i}" for i in range(0, 500, 7)], 30, "E").select("DMS_id", "DMS_filename", "seq_len")


def alignment_paths(spark, sf):
    folder = F.when(F.col("p_brand").endswith("1"), "poet_msas").when(F.col("p_brand").endswith("2"), "openprotein").when(F.col("p_brand").endswith("3"), "x_a3m").otherwise("raw")
    return _catalogue(spark, sf).select("DMS_id", C.alignment_path(folder, F.col("MSA_filename")).alias("path"))


def array_consistency(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("a"), F.collect_list(F.when(F.length("text") > 100, F.col("role"))).alias("b"))
    return C.consistent(rows, ["a", "b"]).select("conv_id", F.size("a").alias("members"))


def configured_datasets(spark, sf):
    nation = table(spark, sf, "nation")
    return C.configured(
        nation.select(F.col("n_name").alias("dataset")),
        nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("dataset"), (F.col("n_regionkey") * 0.5).alias("weight")),
        nation.filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("dataset")),
    )


def named_tokens(spark, sf):
    names = ["bos", "sep", "[PAD]", "[MSA]", "A", "-", "v"]
    rows = table(spark, sf, "part").select("p_partkey", F.get(F.array(*map(F.lit, names)), F.pmod("p_partkey", F.lit(len(names))).cast("int")).alias("name"))
    return rows.select("p_partkey", "name", C.named_token(F.col("name")).alias("id"))


def index_remap(spark, sf):
    n = F.lit(1000).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", R.remapped_index(F.pmod("o_orderkey", F.lit(2000)) - 1000, n).alias("i"))


def substitution_distances(spark, sf):
    """A matrix by rule: the distance of two letters in the alphabet."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    matrix = spark.createDataFrame([(x, y, abs(ord(x) - ord(y)) % 7 - 3) for x in letters for y in letters if x != y], "x string, y string, score int")
    rows = aligned(spark, sf)
    first = rows.groupBy("msa_id").agg(F.min_by("aln", "row_id").alias("b"))
    return C.substitution_distance(rows.join(first, "msa_id").withColumnRenamed("aln", "a"), ["msa_id", "row_id"], matrix)


def weights_cache(spark, sf):
    rows = aligned(spark, sf).groupBy("msa_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "aln"))), lambda r: r["aln"]), "\n").alias("content"))
    cached = rows.filter("msa_id like '%1'").select(F.sha2("content", 256).alias("content_hash"), F.lit(0.2).alias("theta"))
    return C.missing_weights(rows, cached.unionByName(cached.withColumn("theta", F.lit(0.3))), 0.2).select("msa_id", "content_hash")


def sequence_recovery(spark, sf):
    rows = aligned(spark, sf)
    native = rows.groupBy("msa_id").agg(F.min_by("aln", "row_id").alias("native"))
    samples = rows.select("msa_id", F.col("aln").alias("sample"), F.transform(F.split("aln", ""), lambda c: c != "-").alias("mask"))
    return C.recovery(samples, native, "msa_id")


def instance_summaries(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("evaluator"), F.col("o_orderstatus").alias("sampler"), F.pmod("o_custkey", F.lit(10)).cast("string").alias("instance"))
    wide = rows.agg(F.max("o_totalprice").alias("most"), F.count("*").cast("double").alias("n"))
    long = wide.select("evaluator", "sampler", "instance", F.expr("stack(2, 'most', most, 'n', n) as (metric, value)"))
    return C.instance_summary(long)


def embedding_covariance(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.pmod("label", F.lit(2)).alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.lit(1.0).alias("w"))
    return C.weighted_covariance(rows, "label", "v", "w").select("label", "i", "j", F.round("cov", 9).alias("cov"))


def evaluation_report(spark, sf):
    return C.report(A.entropy_correlation(spark, sf).withColumnRenamed("columns", "entropy_columns"), A.js_kl_divergence(spark, sf), A.ratio_of_aggregates(spark, sf))


def fasta_subsample(spark, sf):
    """1000 lines of two-line records: 500 records in hash order."""
    return S.sampled(sequences(spark, sf), 1000 // 2, "fasta", [], "accession").select("accession", F.md5("sequence").alias("sequence"))


def prompt_members(spark, sf):
    """Members whose accession is in the prompt."""
    prompt = table(spark, sf, "labels").filter("quality = 1").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("accession"))
    return lengths(spark, sf).join(prompt, "accession", "left_semi").groupBy("family_id").agg(F.count("*").alias("members"))


def timing_totals(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("seconds"), F.count("*").alias("steps"))


def preprocessed_documents(spark, sf):
    config = C.PreprocessConfig(max_tokens_per_example=6000, min_length=50, sample_order_seed="p")
    rows = sequences(spark, sf).select("family_id", "member_idx", "accession", "sequence")
    return C.preprocessed(rows, config).select("family_id", "n_members", "n_tokens", F.md5("document").alias("document"))


def evaluation_run(spark, sf):
    seqs = sequences(spark, sf).select(F.col("family_id").alias("instance"), "sequence", "doc_id")
    samplers = {"even": seqs.filter("doc_id % 2 = 0"), "odd": seqs.filter("doc_id % 2 = 1")}
    done = spark.createDataFrame([("length", "even", "src0_en", "length_ratio", 7.0)], "evaluator string, sampler string, instance string, metric string, value double")
    return C.evaluated([C.LengthEvaluator()], samplers, seqs, done).withColumn("value", F.round("value", 9))


def generated_samples(spark, sf):
    from lamina.operators import generation as G

    out = G.generate(G.ProfileSampler(), aligned(spark, sf), 20, "gen", least_share=0.8, least_identity=0.3, retries=2)
    return out.select("msa_id", "sample_id", "sequence", F.round("score", 6).alias("score"), "accepted")


QUERIES = {
    f.__name__: f
    for f in (
        assay_selection, alignment_paths, array_consistency, configured_datasets, named_tokens, index_remap, substitution_distances, weights_cache,
        sequence_recovery, instance_summaries, embedding_covariance, evaluation_report, fasta_subsample, prompt_members, timing_totals,
        preprocessed_documents, evaluation_run, generated_samples,
    )
}

_EQUAL = "len(list_filter(range(1, length(aln) + 1), lambda i: substr(aln, i, 1) = substr(query, i, 1){}))"


def _inner(sql: str, name: str) -> str:
    return f"{name} AS ({sql})"


ORACLES = {
    "assay_selection": """SELECT 'A' || p_partkey AS "DMS_id", p_type || '.csv' AS "DMS_filename", p_size AS seq_len FROM part
        WHERE p_partkey < 500 AND p_partkey % 7 = 0 AND p_size <= 30 AND contains(p_type || '.csv', 'E')""",
    "alignment_paths": """SELECT 'A' || p_partkey AS "DMS_id", CASE WHEN ends_with(p_brand, '1') THEN 'poet_msas/' || p_name || '.a3m' WHEN ends_with(p_brand, '2') THEN 'openprotein/' || p_name || '_aligned.a3m'
        WHEN ends_with(p_brand, '3') THEN 'x_a3m/' || p_name || '.a3m' ELSE 'raw/' || p_name || '.a2m' END AS path FROM part""",
    "array_consistency": "SELECT conv_id, count(*) AS members FROM conversations GROUP BY conv_id HAVING count(*) = count(*) FILTER (length(text) > 100 AND role IS NOT NULL)",
    "configured_datasets": """WITH n AS (SELECT n_name AS dataset, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey * 0.5::DOUBLE ELSE 1 END AS weight, n_nationkey % 5 = 0 AS is_validation FROM nation) SELECT * FROM n WHERE weight > 0""",
    "named_tokens": """WITH n AS (SELECT p_partkey, (['bos', 'sep', '[PAD]', '[MSA]', 'A', '-', 'v'])[p_partkey % 7 + 1] AS name, ([47, 49, 46, 62, 0, 24, 44])[p_partkey % 7 + 1] AS id FROM part) SELECT * FROM n""",
    "index_remap": "SELECT o_orderkey, CASE WHEN o_orderkey % 2000 < 1000 THEN o_orderkey % 2000 ELSE o_orderkey % 2000 - 1000 END AS i FROM orders",
    "substitution_distances": f"""WITH {MSA}, q AS (SELECT *, first_value(aln) OVER (PARTITION BY msa_id ORDER BY row_id) AS query FROM m)
        SELECT msa_id, row_id, coalesce(list_sum(list_transform(range(1, length(aln) + 1), lambda i: CASE WHEN substr(aln, i, 1) <> substr(query, i, 1) AND substr(aln, i, 1) <> '-' AND substr(query, i, 1) <> '-'
          THEN abs(ascii(substr(aln, i, 1)) - ascii(substr(query, i, 1))) % 7 - 3 ELSE 0 END)), 0)::BIGINT AS distance FROM q""",
    "weights_cache": f"WITH {MSA} SELECT msa_id, sha256(string_agg(aln, chr(10) ORDER BY row_id)) AS content_hash FROM m WHERE msa_id NOT LIKE '%1' GROUP BY msa_id",
    "sequence_recovery": f"""WITH {MSA}, q AS (SELECT *, first_value(aln) OVER (PARTITION BY msa_id ORDER BY row_id) AS query FROM m)
        SELECT msa_id, round(avg({_EQUAL.format('')}::DOUBLE / length(aln)), 9) AS recovery, round(avg({_EQUAL.format(" AND substr(aln, i, 1) <> '-'")}::DOUBLE / nullif(length(replace(aln, '-', '')), 0)), 9) AS masked_recovery FROM q GROUP BY msa_id""",
    "instance_summaries": """SELECT o_orderpriority AS evaluator, o_orderstatus AS sampler, (o_custkey % 10)::VARCHAR AS instance,
        'most=' || printf('%.3f', max(o_totalprice)) || ';n=' || printf('%.3f', count(*)::DOUBLE) AS metrics FROM orders GROUP BY ALL""",
    "embedding_covariance": """WITH e AS (SELECT vec_id, label % 2 AS label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
        SELECT a.label, a.i, b.i AS j, round((sum(a.x * b.x) - sum(a.x) * sum(b.x) / count(*)) / (count(*) - 1), 9) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL""",
    "evaluation_report": f"""WITH {_inner('SELECT msa_id, columns AS entropy_columns, correlation FROM (' + A.ORACLES['entropy_correlation'] + ')', 'ea')}, {_inner(A.ORACLES['js_kl_divergence'], 'eb')}, {_inner(A.ORACLES['ratio_of_aggregates'], 'ec')}
        SELECT * FROM ea FULL JOIN eb USING (msa_id) FULL JOIN ec USING (msa_id)""",
    "fasta_subsample": f"WITH {SEQS}, r AS (SELECT accession, md5(sequence) AS sequence, row_number() OVER (ORDER BY md5('fasta|' || accession), accession) AS rn FROM s) SELECT accession, sequence FROM r WHERE rn <= 500",
    "prompt_members": f"WITH {SEQS} SELECT family_id, count(*) AS members FROM s WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1",
    "timing_totals": "SELECT event_type, round(sum(value), 4) AS seconds, count(*) AS steps FROM events GROUP BY 1",
    "preprocessed_documents": f"""WITH {SEQS}, k AS (SELECT *, translate(sequence, 'UO', 'CK') AS q FROM s WHERE seq_len >= 50),
        r AS (SELECT *, sum(seq_len + 1) OVER (PARTITION BY family_id ORDER BY md5('p|' || family_id || '|' || accession) ROWS UNBOUNDED PRECEDING) AS t FROM k)
        SELECT family_id, count(*) AS n_members, (max(t) + 2)::BIGINT AS n_tokens, md5('[start-of-document][RAW]' || string_agg(q, '[SEP]' ORDER BY t) || '[SEP]') AS document FROM r WHERE t + 2 < 6000 GROUP BY 1""",
    "evaluation_run": f"""WITH {SEQS}, a AS (SELECT family_id, doc_id % 2 AS h, avg(seq_len) AS x FROM s GROUP BY ALL), b AS (SELECT family_id, avg(seq_len) AS y FROM s GROUP BY 1),
        o AS (SELECT 'length' AS evaluator, CASE WHEN h = 0 THEN 'even' ELSE 'odd' END AS sampler, family_id AS instance, 'length_ratio' AS metric, round(x / y, 9) AS value FROM a JOIN b USING (family_id))
        SELECT * FROM o WHERE NOT (sampler = 'even' AND instance = 'src0_en') UNION ALL SELECT 'length', 'even', 'src0_en', 'length_ratio', 7.0::DOUBLE""",
}
