"""Queries on sampling, sharding, splits, evaluation tables and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions import residues as R
from lamina.operators import evaluation as E
from lamina.operators import members as M
from lamina.operators import sampling as S
from lamina.operators import scoring as L
from lamina.operators import splits as P
from lamina.operators.alignment import homology_weights as _homology
from lamina.plans.proxies import MSA, SEQS, UNIFORM
from lamina.session import table
from lamina.sources.relations import aligned, lengths, sequences
from lamina.streaming import monitor


# Sampling, shuffles, shards


def sample_top_n(spark, sf):
    return S.sampled(lengths(spark, sf), 5, "52", ["family_id"], "accession").select("family_id", "accession", "sample_rank")


def weighted_sample_order(spark, sf):
    out = S.weighted_order(lengths(spark, sf).filter("seq_len > 0"), "7", "family_id", "accession", "seq_len")
    return out.select("family_id", "accession", "rank")


def weighted_sample_force_first(spark, sf):
    out = S.weighted_order(lengths(spark, sf).filter("seq_len > 0"), "7", "family_id", "accession", "seq_len", force_first=True)
    return out.filter("rank <= 4").select("family_id", "accession", "rank")


def block_shuffle(spark, sf):
    return S.block_shuffled(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000, "11").select("o_orderkey", "block", "new_pos")


_SIZES, _WEIGHTS = {"a": 1000, "b": 37, "c": 500, "off": 10}, {"a": 0.5, "b": 0.2, "c": 0.3, "off": 0.0}


def interleave_index(spark, sf):
    return S.interleaved(spark, _SIZES, _WEIGHTS, 17, 20000)


def dataset_range_lookup(spark, sf):
    bounds = spark.createDataFrame([("a", 0, 5000), ("b", 5000, 9000), ("c", 9000, 1 << 40)], "name string, lo long, hi long")
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"))
    return S.range_lookup(points, bounds).groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("i") - F.col("lo")).alias("local_sum"))


def offset_resume(spark, sf):
    out = block_shuffle(spark, sf).filter(F.col("new_pos") >= 5000)
    return out.select("o_orderkey", (F.col("new_pos") - 5000).alias("pos"))


def round_robin_batches(spark, sf):
    return table(spark, sf, "events").groupBy(S.round_robin(F.col("event_id"), 8).alias("rank")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def file_shards(spark, sf):
    """Families as files: the four ways to number their shards."""
    files = lengths(spark, sf).select("family_id").distinct()
    i = F.row_number().over(Window.orderBy("family_id")) - 1
    n = F.count("*").over(Window.partitionBy())
    rows = files.select("family_id", i.alias("i"), n.alias("n"))
    at, all_ = F.col("i"), F.col("n")
    return rows.select("family_id", S.shard_floor(at, all_, 7).alias("floor_last"), S.shard_balanced(at, all_, 7).alias("balanced"), S.shard_ceiling(at, all_, 7).alias("ceiling"), F.pmod(at, F.lit(7)).cast("int").alias("modulo"))


def held_out_families(spark, sf):
    out = S.held_out(lengths(spark, sf), 20, 8, "held", "family_id")
    return out.groupBy("split").agg(F.countDistinct("family_id").alias("families"), F.count("*").alias("members"), F.sum("seq_len").alias("residues"))


def nucleus_cut(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_orderpriority", F.col("o_orderstatus")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus")))
    out = S.nucleus(rows, "o_orderstatus", "o_orderpriority", "p", 0.7)
    return out.select("o_orderstatus", "o_orderpriority", F.round("p", 9).alias("p"), F.round("renormalised", 9).alias("renormalised"))


def first_sample_strings(spark, sf):
    names = F.transform(F.array_sort(F.collect_list(F.struct("member_idx", "accession"))), lambda x: x["accession"])
    return lengths(spark, sf).groupBy("family_id").agg(F.array_join(F.slice(names, 1, 5), "|").alias("samples"))


# Splits


def _headers(spark, sf):
    rows = lengths(spark, sf)
    return rows.withColumn("query_header", P.member_header(F.lit("f"), F.col("family_id"), F.lit(0), F.col("member_idx"), F.col("accession")))


def _hits(spark, sf):
    """Search results stand-in: labelled documents hit val or test, by the parity of their id."""
    labels = table(spark, sf, "labels").join(_headers(spark, sf).select("doc_id", "query_header", "seq_len"), "doc_id")
    return labels.select(
        "query_header", F.concat(F.when(F.pmod("doc_id", F.lit(2)) == 0, "val").otherwise("test"), F.lit("_"), F.col("doc_id").cast("string")).alias("target_header"),
        F.when(F.col("quality") == 1, 60.0).otherwise(20.0).alias("pident"), F.when(F.col("toxic") == 1, 0.5).otherwise(0.9).alias("qcov"),
    )


def split_hits(spark, sf):
    return P.hit_splits(_hits(spark, sf))


def split_antijoin_route(spark, sf):
    members = _headers(spark, sf).withColumn("family_id", F.concat_ws("_", "family_id", F.pmod("doc_id", F.lit(97)).cast("string")))
    out = P.routed(members.select("family_id", "query_header"), P.hit_splits(_hits(spark, sf)))
    return out.groupBy("route").agg(F.count("*").alias("members"), F.countDistinct("family_id").alias("families"))


def retained_families(spark, sf):
    members = _headers(spark, sf).withColumn("family_id", F.concat_ws("_", "family_id", F.pmod("doc_id", F.lit(97)).cast("string"))).select("family_id", "query_header")
    return P.retained_share(members, P.routed(members, P.hit_splits(_hits(spark, sf))))


def heldout_union_dedup(spark, sf):
    docs = sequences(spark, sf).select("sequence", F.lit("val").alias("split"), "doc_id")
    a = docs.filter("doc_id % 3 = 0").drop("doc_id")
    b = docs.filter("doc_id % 5 = 0").withColumn("split", F.lit("test")).drop("doc_id")
    bench = table(spark, sf, "benchmark").select(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"), F.lit("test").alias("split"))
    out = P.held_out_union([a, b, bench])
    return out.select(F.md5("sequence").alias("sequence"), "split")


def s20_s90_representatives(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("family_id"), F.col("p_name").alias("s20"), F.concat_ws("/", "p_name", "p_type").alias("s90"), F.col("p_partkey").alias("pos"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("accession"))
    bad = rows.filter(F.pmod("pos", F.lit(11)) == 0).select("accession")
    return P.representatives(rows, bad)


def first_seen_labels(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    return M.relabelled(rows, "p_brand", "p_name", "p_partkey").select("p_brand", "p_partkey", "new_label")


def fragment_dedup(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("msa_id"), F.col("turn").alias("row_id"), F.concat(F.lit("T"), F.col("turn").cast("string")).alias("accession"), F.regexp_replace("text", "[^A-Za-z]", "-").alias("aln"))
    out = P.fragments(rows, R.gap_run_fragments(F.col("aln"), 1, 5))
    return out.select("msa_id", "fragment_id", "accession", F.md5("fragment").alias("fragment"))


def cluster_validity(spark, sf):
    rows = aligned(spark, sf).select(F.concat_ws("/", "msa_id", F.substr("aln", F.lit(1), F.lit(3))).alias("cluster_id"), "aln")
    return P.valid_clusters(rows, 14)


def cluster_left_join_default(spark, sf):
    rows = lengths(spark, sf).select("accession", "doc_id")
    assigned = table(spark, sf, "labels").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("accession"), F.when(F.col("quality") == 1, F.concat(F.lit("c"), F.pmod("doc_id", F.lit(40)).cast("string"))).alias("cluster_id"))
    return M.with_clusters(rows, assigned).select("accession", "cluster_id", "cluster_size")


def exclusion_antijoin(spark, sf):
    bad = table(spark, sf, "labels").filter("quality = 0").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("accession"))
    return M.excluded(lengths(spark, sf), bad).groupBy("family_id").agg(F.count("*").alias("members"))


def family_first_occurrence(spark, sf):
    rows = sequences(spark, sf).select("family_id", "member_idx", "accession", F.md5("sequence").alias("digest"))
    return M.first_occurrences(rows, ["family_id", "digest"], ["member_idx"])


def kmer_cluster(spark, sf):
    """Benchmark items against all documents by shared words of 12 letters."""
    docs = sequences(spark, sf).select(F.col("doc_id").alias("id"), "sequence")
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"))
    return P.kmer_candidates(docs, bench, 12, 20)


# Evaluation and scoring


def _orders(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus", F.col("o_custkey")).agg(F.floor(F.max("o_totalprice")).cast("double").alias("value"))


def results_upsert(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderpriority", "o_custkey", "o_orderkey", "o_totalprice")
    latest = lambda d: d.groupBy("o_orderpriority", "o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("value"))
    old, new = latest(rows.filter("o_orderkey % 3 <> 0")), latest(rows.filter("o_orderkey % 3 = 0"))
    return M.upserted(old, new, ["o_orderpriority", "o_custkey"])


def resume_antijoin(spark, sf):
    done = table(spark, sf, "labels").select("doc_id")
    return lengths(spark, sf).join(done, "doc_id", "left_anti").select("doc_id", "family_id")


def metric_means(spark, sf):
    rows = _orders(spark, sf).select(F.col("o_orderpriority").alias("evaluator"), F.col("o_orderstatus").alias("sampler"), F.lit("price").alias("metric"), "value")
    return E.metric_means(rows).withColumn("mean_value", F.round("mean_value", 5))


def merged_statistics(spark, sf):
    a = lengths(spark, sf).filter("doc_id % 2 = 0").select(F.col("doc_id").alias("generated_id"), F.col("seq_len").alias("coverage"))
    b = table(spark, sf, "labels").select(F.col("doc_id").alias("generated_id"), F.col("quality").alias("identity"))
    return E.merged_statistics(a, b)


def spearman_by_group(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return E.spearman(rows, "lang", "n_chars", "quality")


def assay_spearman(spark, sf):
    """Profile scores of the parts of an alignment against their price rank."""
    weights = _homology(aligned(spark, sf), 0.2)
    chosen = L.contexts(weights, aligned(spark, sf), 2, 20, 42)
    wanted = aligned(spark, sf).select("msa_id", F.col("row_id").alias("candidate"), "aln")
    scores = L.score(L.ProfileScorer(), chosen, wanted)
    target = table(spark, sf, "part").select(F.col("p_partkey").alias("candidate"), "p_retailprice")
    # A row for each part on both sides: estimates of so narrow a table must not choose a broadcast.
    rows = scores.join(target.hint("merge"), "candidate").withColumn("score", F.round("score", 7))
    return E.spearman(rows, "msa_id", "score", "p_retailprice").withColumn("spearman", F.round("spearman", 6))


def ensemble_profile_scores(spark, sf):
    weights = _homology(aligned(spark, sf), 0.2)
    chosen = L.contexts(weights, aligned(spark, sf), 3, 20, 42)
    wanted = aligned(spark, sf).select("msa_id", F.col("row_id").alias("candidate"), "aln")
    return L.score(L.ProfileScorer(), chosen, wanted).select("msa_id", "candidate", "members", F.round(F.col("score") + 1e-8, 5).alias("score"))


def ensemble_reduction_probs(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("step"), F.pmod("o_custkey", F.lit(3)).alias("member"), F.col("o_orderpriority").alias("token")).agg(F.count("*").alias("n"))
    p = rows.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("step", "member")))
    a = E.ensemble_tokens(p, "mean_probs").withColumnRenamed("p", "mean_p")
    b = E.ensemble_tokens(p, "sum_log_probs").withColumnRenamed("p", "log_p")
    return a.join(b, ["step", "token"]).select("step", "token", F.round("mean_p", 9).alias("mean_p"), F.round("log_p", 9).alias("log_p"))


def sample_acceptance(spark, sf):
    rows = lengths(spark, sf).join(table(spark, sf, "labels").select("doc_id", (F.col("quality") * 0.6).alias("best_identity")), "doc_id", "left")
    rows = rows.withColumn("prompt_min", F.min("seq_len").over(Window.partitionBy("family_id")) * 3)
    return E.accepted(rows, "family_id", 0.8, 0.3).select("family_id", "accession")


def best_identity(spark, sf):
    from lamina.functions.identity import best_hit

    hits = _hits(spark, sf)
    return _headers(spark, sf).join(hits, "query_header", "left").groupBy("accession").agg(best_hit(F.col("pident")).alias("best"))


def hit_statistics(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_discount") / 50).alias("evalue")).filter("s % 4 <> 0")
    samples = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"), F.lit(1000).alias("n"))
    return E.hit_statistics(hits, samples, "s")


def structure_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") * 2).alias("plddt"))
    return E.structure_metrics(rows, "l_suppkey", 600)


def learning_rates(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey")
    return rows.select("o_orderkey", F.round(E.learning_rate(F.col("o_orderkey"), 1000, 5000, 8000, 0.1), 9).alias("rate"))


def schedule_lookup(spark, sf):
    return E.schedule_value(table(spark, sf, "orders").select("o_orderkey"), {100: 1.0, 1000: 2.0, 12000: 4.0}, "o_orderkey")


def prompt_views(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_name").alias("prompt_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("accession"), F.concat(F.upper("p_type"), F.lit("-a.")).alias("sequence"))
    return L.resolved_prompts(rows, False)


# Monitoring


def batch_repetition(spark, sf):
    rows = table(spark, sf, "events").select(F.floor(F.col("event_id") / 3).alias("batch"), F.col("user_id").alias("identifier"), F.col("event_type").alias("dataset"))
    return E.repetition_summary(E.batch_repetition(rows, "batch", "identifier", "dataset"))


def dataset_sample_counts(spark, sf):
    rows = table(spark, sf, "events").select(F.concat_ws("$", "event_type", F.when(F.col("value") > 20, F.lit("big"))).alias("names"))
    return monitor.dataset_counts(rows, "names")


def rolling_throughput(spark, sf):
    running = F.sum(F.floor("value")).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", running.alias("total"))
    out = monitor.rolling_throughput(rows, "user_id", "event_id", "ts", "total", 5)
    return out.select("user_id", "event_id", F.round("throughput", 6).alias("throughput"))


def _streamed(spark, sf, make, mode):
    """Run a query over the events as a stream to its end, and return what its sink holds.

    The sink is a table in the shared folder, and the checkpoint lies beside it.
    """
    import uuid

    top = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/lamina/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    # A glob keeps the single file a source of its own; a folder of that name is read as well.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/events.parquet*")
    out = make(stream)
    if mode == "complete":
        sink = lambda batch, _: batch.write.mode("overwrite").parquet(f"{top}/out")
        query = out.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    else:
        query = out.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start(f"{top}/out")
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out")


def stream_dataset_counts(spark, sf):
    return _streamed(spark, sf, lambda s: monitor.dataset_counts(s.withColumn("names", F.concat_ws("$", "event_type", F.when(F.col("value") > 20, F.lit("big")))), "names"), "complete")


def stream_first_seen(spark, sf):
    out = _streamed(spark, sf, lambda s: monitor.first_seen(s, ["event_id"], "ts", "365 days").select("event_id", "user_id"), "append")
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


def stream_packing(spark, sf):
    spark.conf.set(*monitor.STATE_STORE)
    out = _streamed(spark, sf, lambda s: monitor.packed_stream(s.select(F.col("user_id").alias("shard"), F.col("event_id").alias("sample_id"), F.floor("value").alias("tokens")), 200), "append")
    return out.select("shard", "sample_id", "batch")


QUERIES = {
    f.__name__: f
    for f in (
        sample_top_n, weighted_sample_order, weighted_sample_force_first, block_shuffle, interleave_index, dataset_range_lookup, offset_resume, round_robin_batches,
        file_shards, held_out_families, nucleus_cut, first_sample_strings, split_hits, split_antijoin_route, retained_families, heldout_union_dedup,
        s20_s90_representatives, first_seen_labels, fragment_dedup, cluster_validity, cluster_left_join_default, exclusion_antijoin, family_first_occurrence,
        kmer_cluster, results_upsert, resume_antijoin, metric_means, merged_statistics, spearman_by_group, assay_spearman, ensemble_profile_scores,
        ensemble_reduction_probs, sample_acceptance, best_identity, hit_statistics, structure_metrics, learning_rates, schedule_lookup, prompt_views,
        batch_repetition, dataset_sample_counts, rolling_throughput, stream_dataset_counts, stream_first_seen, stream_packing,
    )
}

_ES = f"-ln(greatest({UNIFORM.format(chr(39) + '7|' + chr(39) + ' || family_id || ' + chr(39) + '|' + chr(39) + ' || accession')}, 1e-15)) / seq_len"
_BLOCK = """k AS (SELECT o_orderkey, o_orderkey // 1000 AS block FROM orders), n AS (SELECT block, count(*) AS n FROM k GROUP BY block),
f AS (SELECT block, coalesce(sum(n) OVER (ORDER BY md5('11|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
o AS (SELECT o_orderkey, block, (before + row_number() OVER (PARTITION BY block ORDER BY md5('11|' || block || '|' || o_orderkey), o_orderkey) - 1)::BIGINT AS new_pos FROM k JOIN f USING (block))"""
_HITS = f"""{SEQS}, h AS (SELECT s.*, 'f|' || family_id || '|0|' || member_idx || '|' || accession AS query_header FROM s),
x AS (SELECT query_header, CASE WHEN doc_id % 2 = 0 THEN 'val' ELSE 'test' END AS split, CASE WHEN quality = 1 THEN 60.0::DOUBLE ELSE 20 END AS pident, CASE WHEN toxic = 1 THEN 0.5 ELSE 0.9 END AS qcov FROM labels JOIN h USING (doc_id)),
sp AS (SELECT query_header, CASE WHEN min(split) <> max(split) THEN 'both' ELSE min(split) END AS split FROM x WHERE pident >= 30 AND qcov >= 0.8 GROUP BY 1)"""
_ROUTE = f"""{_HITS}, mm AS (SELECT family_id || '_' || (doc_id % 97) AS family_id, query_header, split FROM h LEFT JOIN sp USING (query_header)),
fm AS (SELECT family_id, CASE WHEN count(*) = count(split) AND min(split) = max(split) AND min(split) <> 'both' THEN min(split) END AS fs FROM mm GROUP BY 1),
rt AS (SELECT family_id, query_header, CASE WHEN split IS NULL THEN 'train' ELSE fs END AS route FROM mm JOIN fm USING (family_id))"""
_LETTERS = "upper(regexp_replace({}, '[^A-Za-z]', '', 'g'))"
_RANKS = """r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM v)"""


def _profile(members):
    p = f"{MSA}, z AS (SELECT a.msa_id, a.row_id, count(*) FILTER (1 - len(list_filter(range(1, length(a.aln) + 1), lambda i: substr(a.aln, i, 1) = substr(b.aln, i, 1) AND substr(a.aln, i, 1) <> '-'))::DOUBLE / length(replace(a.aln, '-', '')) <= 0.2) AS nb FROM m a JOIN m b USING (msa_id) GROUP BY ALL)"
    u = UNIFORM.format("'42|' || msa_id || '#' || member || '|' || row_id")
    return f"""{p},
e AS (SELECT msa_id, row_id, member, row_number() OVER (PARTITION BY msa_id, member ORDER BY -ln(greatest({u}, 1e-15)) / (1 / nb), row_id) AS rk FROM z, range(0, {members}) AS o(member)),
ch AS (SELECT e.msa_id, member, aln FROM e JOIN m USING (msa_id, row_id) WHERE rk <= 20),
cc AS (SELECT msa_id, member, unnest(range(0, length(aln))) AS col, unnest(string_split(aln, '')) AS token FROM ch),
al AS (SELECT DISTINCT token FROM (SELECT unnest(string_split(aln, '')) AS token FROM m)),
ct AS (SELECT msa_id, member, col, token, count(*) AS n FROM cc GROUP BY ALL), tt AS (SELECT msa_id, member, col, sum(n) AS t FROM ct GROUP BY ALL),
wc AS (SELECT msa_id, row_id AS candidate, unnest(range(0, length(aln))) AS col, unnest(string_split(aln, '')) AS token FROM m),
lp AS (SELECT wc.msa_id, candidate, tt.member, avg(ln((1 - 0.1::DOUBLE) * coalesce(n / t, 0) + 0.1::DOUBLE / (SELECT count(*) FROM al))) AS s
  FROM wc JOIN tt ON tt.msa_id = wc.msa_id AND tt.col = wc.col LEFT JOIN ct ON ct.msa_id = wc.msa_id AND ct.member = tt.member AND ct.col = wc.col AND ct.token = wc.token GROUP BY ALL),
sc AS (SELECT msa_id, candidate, count(*) AS members, round(avg(s), 9) AS score FROM lp GROUP BY ALL)"""


ORACLES = {
    "sample_top_n": f"WITH {SEQS}, r AS (SELECT family_id, accession, row_number() OVER (PARTITION BY family_id ORDER BY md5('52|' || accession), accession) AS sample_rank FROM s) SELECT * FROM r WHERE sample_rank <= 5",
    "weighted_sample_order": f"WITH {SEQS} SELECT family_id, accession, row_number() OVER (PARTITION BY family_id ORDER BY {_ES}, accession) AS rank FROM s WHERE seq_len > 0",
    "weighted_sample_force_first": f"""WITH {SEQS}, q AS (SELECT *, accession <> min(accession) OVER (PARTITION BY family_id) AS later FROM s WHERE seq_len > 0),
        r AS (SELECT family_id, accession, row_number() OVER (PARTITION BY family_id ORDER BY later, {_ES}, accession) AS rank FROM q) SELECT * FROM r WHERE rank <= 4""",
    "block_shuffle": f"WITH {_BLOCK} SELECT * FROM o",
    "offset_resume": f"WITH {_BLOCK} SELECT o_orderkey, new_pos - 5000 AS pos FROM o WHERE new_pos >= 5000",
    "interleave_index": """WITH p AS (SELECT i AS pos, i % 17 AS slot, i // 17 AS turn FROM range(0, 20000) AS o(i))
        SELECT pos, CASE WHEN slot < 8 THEN 'a' WHEN slot < 11 THEN 'b' ELSE 'c' END AS dataset,
          CASE WHEN slot < 8 THEN (turn * 8 + slot) % 1000 WHEN slot < 11 THEN (turn * 3 + slot - 8) % 37 ELSE (turn * 6 + slot - 11) % 500 END AS local_idx FROM p""",
    "dataset_range_lookup": """SELECT CASE WHEN o_orderkey < 5000 THEN 'a' WHEN o_orderkey < 9000 THEN 'b' ELSE 'c' END AS name, count(*) AS n,
        sum(o_orderkey - CASE WHEN o_orderkey < 5000 THEN 0 WHEN o_orderkey < 9000 THEN 5000 ELSE 9000 END)::BIGINT AS local_sum FROM orders GROUP BY 1""",
    "round_robin_batches": "SELECT event_id % 8 AS rank, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1",
    "file_shards": f"""WITH {SEQS}, f AS (SELECT family_id, row_number() OVER (ORDER BY family_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT family_id FROM s))
        SELECT family_id, least(i // greatest(n // 7, 1), 6)::INTEGER AS floor_last, (SELECT max(k) FROM range(0, 7) AS o(k) WHERE k * n // 7 <= i)::INTEGER AS balanced, (i // (n // 7 + 1))::INTEGER AS ceiling, (i % 7)::INTEGER AS modulo FROM f""",
    "held_out_families": f"""WITH {SEQS}, f AS (SELECT family_id, row_number() OVER (ORDER BY md5('held|' || family_id), family_id) AS rn FROM (SELECT DISTINCT family_id FROM s))
        SELECT CASE WHEN rn <= 8 THEN 'val' WHEN rn <= 20 THEN 'test' ELSE 'train' END AS split, count(DISTINCT family_id) AS families, count(*) AS members, sum(seq_len)::BIGINT AS residues FROM s JOIN f USING (family_id) GROUP BY 1""",
    "nucleus_cut": """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY o_orderstatus) AS p FROM c),
        k AS (SELECT *, sum(p) OVER w AS s, row_number() OVER w AS rn FROM p WINDOW w AS (PARTITION BY o_orderstatus ORDER BY p DESC, o_orderpriority ROWS UNBOUNDED PRECEDING)),
        t AS (SELECT * FROM k WHERE round(s, 9) <= 0.7 OR rn = 1) SELECT o_orderstatus, o_orderpriority, round(p, 9) AS p, round(p / sum(p) OVER (PARTITION BY o_orderstatus), 9) AS renormalised FROM t""",
    "first_sample_strings": f"WITH {SEQS} SELECT family_id, array_to_string(list_slice(list(accession ORDER BY member_idx), 1, 5), '|') AS samples FROM s GROUP BY family_id",
    "split_hits": f"WITH {_HITS} SELECT * FROM sp",
    "split_antijoin_route": f"WITH {_ROUTE} SELECT route, count(*) AS members, count(DISTINCT family_id) AS families FROM rt WHERE route IS NOT NULL GROUP BY 1",
    "retained_families": f"""WITH {_ROUTE}, k AS (SELECT family_id, max((route = 'train')::INTEGER) AS kept FROM rt GROUP BY 1)
        SELECT count(*) AS families, coalesce(sum(kept), 0)::BIGINT AS retained, round(100 * coalesce(sum(kept), 0) / count(*), 6) AS percent FROM k""",
    "heldout_union_dedup": f"""WITH {SEQS}, u AS (SELECT sequence, 0 AS t FROM s WHERE doc_id % 3 = 0 UNION ALL SELECT sequence, 1 FROM s WHERE doc_id % 5 = 0
        UNION ALL SELECT {_LETTERS.format('text')}, 1 FROM benchmark) SELECT md5(sequence) AS sequence, CASE WHEN max(t) = 1 THEN 'test' ELSE 'val' END AS split FROM u GROUP BY u.sequence""",
    "s20_s90_representatives": """WITH r AS (SELECT p_brand AS family_id, p_name AS s20, p_name || '/' || p_type AS s90, min(p_partkey) AS pos FROM part WHERE p_partkey % 11 <> 0 GROUP BY ALL),
        n AS (SELECT *, count(*) OVER (PARTITION BY family_id, s20) AS n FROM r) SELECT family_id, s20, s90, pos, 'P' || pos AS accession FROM n WHERE n >= 2""",
    "first_seen_labels": """WITH f AS (SELECT p_brand, p_name, dense_rank() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) - 1 AS new_label FROM part GROUP BY p_brand, p_name)
        SELECT p_brand, p_partkey, new_label FROM part JOIN f USING (p_brand, p_name)""",
    "fragment_dedup": """WITH t AS (SELECT conv_id AS msa_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '[^A-Za-z]', '-', 'g'), '--'), lambda x: upper(replace(x, '-', ''))), lambda x: length(x) >= 5) AS f FROM conversations),
        e AS (SELECT msa_id, turn, unnest(range(0, len(f))) AS piece, unnest(f) AS fragment FROM t),
        b AS (SELECT *, row_number() OVER (PARTITION BY msa_id, fragment ORDER BY turn, piece) AS rn FROM e),
        n AS (SELECT *, count(*) OVER (PARTITION BY msa_id) AS n FROM b WHERE rn = 1)
        SELECT msa_id, 'T' || turn || '_' || piece AS fragment_id, 'T' || turn AS accession, md5(fragment) AS fragment FROM n WHERE n >= 3""",
    "cluster_validity": f"""WITH {MSA} SELECT msa_id || '/' || substr(aln, 1, 3) AS cluster_id, count(*) AS members FROM m WHERE length(replace(aln, '-', '')) >= 14 GROUP BY 1
        HAVING count(*) >= 2 AND count(DISTINCT length(aln)) = 1""",
    "cluster_left_join_default": f"""WITH {SEQS}, j AS (SELECT accession, coalesce(CASE WHEN quality = 1 THEN 'c' || (s.doc_id % 40) END, accession) AS cluster_id FROM s LEFT JOIN labels USING (doc_id)),
        n AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM j) SELECT * FROM n WHERE cluster_size > 1""",
    "exclusion_antijoin": f"WITH {SEQS} SELECT family_id, count(*) AS members FROM s WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1",
    "family_first_occurrence": f"WITH {SEQS} SELECT family_id, md5(sequence) AS digest, min(member_idx) AS member_idx, min_by(accession, member_idx) AS accession FROM s GROUP BY family_id, md5(sequence)",
    "kmer_cluster": f"""WITH d AS (SELECT doc_id AS id, {_LETTERS.format('text')} AS q FROM documents), b AS (SELECT item_id AS id, {_LETTERS.format('text')} AS q FROM benchmark),
        dk AS (SELECT DISTINCT id, substr(q, i, 12) AS k FROM (SELECT id, q, unnest(range(1, greatest(length(q) - 11, 0) + 1)) AS i FROM d)),
        bk AS (SELECT DISTINCT id, substr(q, i, 12) AS k FROM (SELECT id, q, unnest(range(1, greatest(length(q) - 11, 0) + 1)) AS i FROM b))
        SELECT dk.id AS query_id, bk.id AS target_id, count(*) AS shared FROM dk JOIN bk USING (k) GROUP BY ALL HAVING count(*) >= 20""",
    "results_upsert": """WITH o AS (SELECT o_orderpriority, o_custkey, max_by(o_totalprice, o_orderkey) FILTER (o_orderkey % 3 = 0) AS n, max_by(o_totalprice, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS p FROM orders GROUP BY ALL)
        SELECT o_orderpriority, o_custkey, coalesce(n, p) AS value FROM o""",
    "resume_antijoin": f"WITH {SEQS} SELECT doc_id, family_id FROM s WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "metric_means": """WITH v AS (SELECT o_orderpriority, o_orderstatus, o_custkey, floor(max(o_totalprice)) AS value FROM orders GROUP BY ALL)
        SELECT o_orderpriority AS evaluator, o_orderstatus AS sampler, 'price' AS metric, count(*) AS instances, round(round(avg(value), 9), 5) AS mean_value FROM v GROUP BY ALL""",
    "merged_statistics": f"WITH {SEQS} SELECT coalesce(s.doc_id, l.doc_id) AS generated_id, seq_len AS coverage, quality AS identity FROM (SELECT * FROM s WHERE doc_id % 2 = 0) s FULL JOIN labels l ON s.doc_id = l.doc_id",
    "spearman_by_group": f"""WITH v AS (SELECT lang AS g, n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)), {_RANKS}
        SELECT g AS lang, count(*) AS n, round(CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) ELSE 0 END, 9) AS spearman FROM r GROUP BY g""",
    "assay_spearman": f"""WITH {_profile(2)}, v AS (SELECT msa_id AS g, round(score, 7) AS x, p_retailprice AS y FROM sc JOIN part ON p_partkey = candidate), {_RANKS}
        SELECT g AS msa_id, count(*) AS n, round(CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) ELSE 0 END, 6) AS spearman FROM r GROUP BY g""",
    "ensemble_profile_scores": f"WITH {_profile(3)} SELECT msa_id, candidate, members, round(score + 1e-8, 5) AS score FROM sc",
    "ensemble_reduction_probs": """WITH c AS (SELECT o_orderstatus AS step, o_custkey % 3 AS member, o_orderpriority AS token, count(*) AS n FROM orders GROUP BY ALL),
        p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY step, member) AS p FROM c), a AS (SELECT step, token, avg(p) AS mp, avg(ln(p + 1e-12)) AS l FROM p GROUP BY ALL)
        SELECT step, token, round(mp, 9) AS mean_p, round(exp(l) / sum(exp(l)) OVER (PARTITION BY step), 9) AS log_p FROM a""",
    "sample_acceptance": f"""WITH {SEQS}, j AS (SELECT s.*, quality * 0.6::DOUBLE AS b, min(seq_len) OVER (PARTITION BY family_id) * 3 AS pm FROM s LEFT JOIN labels USING (doc_id))
        SELECT family_id, accession FROM j WHERE seq_len >= floor(pm * 0.8::DOUBLE) AND coalesce(b, 0) >= 0.3""",
    "best_identity": f"WITH {_HITS} SELECT accession, coalesce(max(pident), 0) / 100 AS best FROM h LEFT JOIN x USING (query_header) GROUP BY 1",
    "hit_statistics": """WITH h AS (SELECT l_suppkey AS s, count(*) FILTER (l_discount / 50 < 0.001) AS good, avg(l_discount / 50) AS e FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1)
        SELECT s_suppkey AS s, round(100 * coalesce(good, 0) / 1000, 9) AS hit_percent, round(coalesce(e, 1e8), 9) AS mean_evalue FROM supplier LEFT JOIN h ON s = s_suppkey""",
    "structure_metrics": """WITH p AS (SELECT l_suppkey, avg(l_quantity * 2) AS m, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT round(avg(m), 9) AS mean_plddt, min(n) AS min_len, max(n) AS max_len, round(avg(n), 9) AS mean_len, sum((n > 600)::INTEGER)::BIGINT AS too_long FROM p""",
    "learning_rates": """SELECT o_orderkey, round(CASE WHEN o_orderkey < 1000 THEN o_orderkey / 1000.0::DOUBLE WHEN o_orderkey < 6000 THEN 1 ELSE greatest(0.1::DOUBLE, 1 - (o_orderkey - 6000) / 8000.0::DOUBLE * 0.9::DOUBLE) END, 9) AS rate FROM orders""",
    "schedule_lookup": "SELECT o_orderkey, CASE WHEN o_orderkey >= 12000 THEN 4.0::DOUBLE WHEN o_orderkey >= 1000 THEN 2 WHEN o_orderkey >= 100 THEN 1 END AS scheduled FROM orders",
    "prompt_views": """WITH r AS (SELECT p_name AS prompt_id, 'P' || p_partkey AS accession, upper(p_type) || '-a.' AS q FROM part),
        n AS (SELECT *, min(length(regexp_replace(q, '[a-z.]', '', 'g'))) OVER (PARTITION BY prompt_id) = max(length(regexp_replace(q, '[a-z.]', '', 'g'))) OVER (PARTITION BY prompt_id) AS is_aligned FROM r)
        SELECT prompt_id, accession, upper(regexp_replace(q, '[-.]', '', 'g')) AS conditioning, CASE WHEN is_aligned THEN upper(replace(regexp_replace(q, '[a-z.]', '', 'g'), '.', '-')) END AS aligned, is_aligned FROM n""",
    "batch_repetition": """WITH b AS (SELECT event_id // 3 AS batch, md5(string_agg(user_id || ':' || event_type, '' ORDER BY user_id || ':' || event_type)) AS h, count(*) AS n FROM events GROUP BY 1),
        t AS (SELECT h, n, count(*) AS times FROM b GROUP BY ALL)
        SELECT sum(times)::BIGINT AS total, count(*) AS distinct_batches, sum((times > 1)::INTEGER)::BIGINT AS repeated, min(times) AS least, max(times) AS most, round(avg(times), 9) AS mean_times FROM t""",
    "dataset_sample_counts": "WITH n AS (SELECT unnest(CASE WHEN value > 20 THEN [event_type, 'big'] ELSE [event_type] END) AS dataset FROM events) SELECT dataset, count(*) AS samples FROM n GROUP BY 1",
    "rolling_throughput": """WITH t AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS sec, sum(floor(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS total FROM events),
        w AS (SELECT *, count(*) OVER w AS n, first_value(sec) OVER w AS s0, first_value(total) OVER w AS t0 FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
        SELECT user_id, event_id, round(CASE WHEN n = 5 THEN (total - t0) / nullif(sec - s0, 0) END, 6) AS throughput FROM w""",
    "stream_first_seen": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
}
ORACLES["stream_dataset_counts"] = ORACLES["dataset_sample_counts"]
ORACLES["stream_packing"] = """WITH RECURSIVE k AS (SELECT user_id AS shard, event_id AS sample_id, floor(value)::BIGINT AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
p(shard, sample_id, tokens, rn, total, batch) AS (SELECT shard, sample_id, tokens, rn, tokens, 0::BIGINT FROM k WHERE rn = 1
  UNION ALL SELECT k.shard, k.sample_id, k.tokens, k.rn, CASE WHEN p.total > 0 AND p.total + k.tokens > 200 THEN k.tokens ELSE p.total + k.tokens END,
    CASE WHEN p.total > 0 AND p.total + k.tokens > 200 THEN p.batch + 1 ELSE p.batch END FROM p JOIN k ON k.shard = p.shard AND k.rn = p.rn + 1)
SELECT shard, sample_id, batch FROM p"""
