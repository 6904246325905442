"""Queries on random samples to a budget, prompts and completions, rolling files, combined records and row pairs' means."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import residues as R
from lamina.operators import alignment as A
from lamina.operators import budget as B
from lamina.operators import evaluation as E
from lamina.operators import members as M
from lamina.operators import packing as P
from lamina.operators import sampling as S
from lamina.operators import scoring as L
from lamina.plans.proxies import MSA, SEQS, UNIFORM
from lamina.session import table
from lamina.sources import text_formats as T
from lamina.sources.relations import aligned, lengths


def budget_raw_sample(spark, sf):
    out = B.raw_sample(lengths(spark, sf), 4096, "raw", keep_first=True)
    return out.select("family_id", "member_idx", "place", "kept_start", "kept_len")


def budget_raw_drop_first(spark, sf):
    out = B.raw_sample(lengths(spark, sf), 2500, "raw", drop_first=True)
    return out.select("family_id", "member_idx", "place", "kept_start", "kept_len")


def budget_room_cut(spark, sf):
    """The family's own longest member is the completion that needs room."""
    rows = lengths(spark, sf)
    longest = rows.groupBy("family_id").agg(F.max("seq_len").alias("longest_completion"))
    cut = B.room_cut(rows.join(longest, "family_id"), 8192, "room", drop_first=True)
    return cut.groupBy("family_id").agg(F.count("*").alias("n_members"), F.max("tokens_so_far").alias("tokens"))


def prompt_completions(spark, sf):
    """The last turn of a conversation completes the others; ten batches."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^A-Za-z]", "").alias("s"))
    rows = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]).alias("m"))
    rows = rows.select("conv_id", F.pmod("conv_id", F.lit(10)).alias("batch"), F.slice("m", 1, F.size("m") - 1).alias("context"), F.element_at("m", -1).alias("completion"))
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda i: i.cast("string")), ","))
    return P.assembled(rows, "batch").select(
        "conv_id", F.size("prompt_ids").alias("prompt_tokens"), text("prompt_ids").alias("prompt"),
        F.size("completion_ids").alias("completion_tokens"), text("completion_ids").alias("completion"),
    )


def bad_tokens(spark, sf):
    one = table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), (F.col("r_regionkey") % 2 == 0).alias("sample_gaps"))
    return one.select("key", F.explode(F.when(F.col("sample_gaps"), R.bad_token_ids(True)).otherwise(R.bad_token_ids(False))).alias("id"))


def shuffled_files(spark, sf):
    return S.rolling_files(table(spark, sf, "documents").select("doc_id"), "doc_id", 100, "files").select("doc_id", "file_no", "place")


def combined_records(spark, sf):
    rows = aligned(spark, sf).withColumn("n", F.row_number().over(S.Window.partitionBy("msa_id").orderBy("row_id")))
    out = M.combined(rows.filter("n <= 5").drop("n"), rows.filter("n > 5").drop("n"), "msa_id", "row_id")
    return out.select("msa_id", "row_id", "role", "place", "generated_start", F.md5("aln").alias("aln"))


def pairwise_summary(spark, sf):
    means = [F.round(c, 6).alias(c) for c in ("mean_identity", "mean_distance", "mean_gaps")]
    return A.pairwise_summary(aligned(spark, sf)).select("msa_id", "rows", *means)


def similarity_max_samples(spark, sf):
    """Rows of even id as samples: the largest similarity of each to another sample, then per alignment."""
    best = A.best_among(aligned(spark, sf).filter(F.pmod("row_id", F.lit(2)) == 0))
    return best.groupBy("msa_id").agg(F.count("best").alias("samples"), *[F.round(f("best"), 9).alias(n) for n, f in (("least", F.min), ("mean", F.avg), ("most", F.max))])


def cosine_rates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(E.cosine_rate(F.col("o_orderkey"), 1000, 70000, 0.1), 9).alias("rate"))


def strict_documents(spark, sf):
    fields = ["p_name", "p_type", "p_size"]
    j = T.strict_json(F.to_json(F.struct(*fields)), [*fields, "note"])
    return table(spark, sf, "part").select("p_partkey", F.from_json(j, "p_name string, p_type string, p_size long").alias("d")).select("p_partkey", "d.*")


def chosen_contexts(spark, sf):
    rows = aligned(spark, sf)
    weights = rows.select("msa_id", "row_id", (1 / (F.pmod("row_id", F.lit(7)) + 1)).alias("weight"))
    return L.contexts_within(weights, rows, 3, 600, 50, 5).select("msa_id", "member", "rank", "row_id")


QUERIES = {
    f.__name__: f
    for f in (
        budget_raw_sample, budget_raw_drop_first, budget_room_cut, prompt_completions, bad_tokens, shuffled_files, combined_records, pairwise_summary,
        similarity_max_samples, cosine_rates, strict_documents, chosen_contexts,
    )
}


def _raw(budget: int, drop: bool, keep: bool) -> str:
    """Walks each family member by member, as the samples are described."""
    return f"""WITH {SEQS}, k AS (SELECT family_id, member_idx, seq_len, count(*) OVER (PARTITION BY family_id) AS n FROM s),
        d AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY {"(member_idx > 0)," if keep else ""} md5('raw|' || family_id || '|' || member_idx), member_idx) AS place FROM k {"WHERE member_idx > 0 OR n = 1" if drop else ""}),
        c AS (SELECT *, 2 + sum(seq_len + 1) OVER (PARTITION BY family_id ORDER BY place) AS t FROM d),
        e AS (SELECT family_id, count(*) AS n, count(*) FILTER (t < {budget}) AS endpoint, coalesce(max(t) FILTER (t < {budget}), 0) AS used FROM c GROUP BY 1),
        f AS (SELECT *, CASE WHEN endpoint = n THEN n WHEN endpoint = 0 THEN 1 WHEN {budget} - used - 1 > 1 THEN endpoint + 1 ELSE endpoint END AS upto,
          CASE WHEN endpoint = n THEN NULL WHEN endpoint = 0 THEN {budget} - 3 WHEN {budget} - used - 1 > 0 THEN {budget} - used - 1 END AS final FROM e),
        g AS (SELECT family_id, member_idx, place, seq_len, CASE WHEN place = upto AND final IS NOT NULL THEN least(seq_len, final) ELSE seq_len END AS kept FROM c JOIN f USING (family_id) WHERE place <= upto)
        SELECT family_id, member_idx, place, floor({UNIFORM.format("'raw|start|' || family_id || '|' || member_idx")} * (seq_len - kept + 1))::INTEGER AS kept_start, kept::INTEGER AS kept_len FROM g"""


_CODES = f"""CASE WHEN {{0}} = '' THEN [] ELSE list_transform(string_split({{0}}, ''), lambda c: CASE WHEN strpos('{R.TOKEN_ALPHABET}', c) > 0 THEN strpos('{R.TOKEN_ALPHABET}', c) - 1 ELSE 50 END) END"""
_EQUAL = "len(list_filter(range(1, length(a.aln) + 1), lambda i: substr(a.aln, i, 1) = substr(b.aln, i, 1){}))"
_LONGER = "greatest(length(replace(a.aln, '-', '')), length(replace(b.aln, '-', '')))"

ORACLES = {
    "budget_raw_sample": _raw(4096, False, True),
    "budget_raw_drop_first": _raw(2500, True, False),
    "budget_room_cut": f"""WITH {SEQS}, k AS (SELECT family_id, member_idx, seq_len, count(*) OVER (PARTITION BY family_id) AS n, max(seq_len) OVER (PARTITION BY family_id) AS longest FROM s),
        r AS (SELECT *, sum(seq_len + 1) OVER (PARTITION BY family_id ORDER BY md5('room|' || family_id || '|' || member_idx), member_idx ROWS UNBOUNDED PRECEDING) AS t FROM k WHERE member_idx > 0 OR n = 1)
        SELECT family_id, count(*) AS n_members, max(t)::BIGINT AS tokens FROM r WHERE t + 2 < 8192 - longest - 2 GROUP BY family_id""",
    "prompt_completions": f"""WITH t AS (SELECT conv_id, list(regexp_replace(text, '[^A-Za-z]', '', 'g') ORDER BY turn) AS m FROM conversations GROUP BY 1),
        u AS (SELECT conv_id, conv_id % 10 AS batch, m[1:len(m) - 1] AS context, m[len(m)] AS s FROM t),
        p AS (SELECT conv_id, batch, CASE WHEN len(context) = 0 THEN [47] ELSE list_concat([47, 63], flatten(list_transform(context, lambda x, i: list_concat(CASE WHEN i = 1 THEN [] ELSE [49] END, {_CODES.format('x')})))) END AS p,
          list_concat([CASE WHEN len(context) = 0 THEN 63 ELSE 49 END], {_CODES.format('s')}, [49]) AS c FROM u),
        q AS (SELECT conv_id, p, list_resize(c, max(len(c)) OVER (PARTITION BY batch), 46) AS c FROM p)
        SELECT conv_id, len(p)::INTEGER AS prompt_tokens, md5(array_to_string(p, ',')) AS prompt, len(c)::INTEGER AS completion_tokens, md5(array_to_string(c, ',')) AS completion FROM q""",
    "bad_tokens": """WITH i AS (SELECT unnest(range(0, 68)) AS id) SELECT r_regionkey AS key, id::INTEGER AS id FROM region CROSS JOIN i
        WHERE id BETWEEN 20 AND 21 OR id = 23 OR id = 22 OR (id = 24 AND r_regionkey % 2 = 1) OR id BETWEEN 25 AND 48 OR id >= 50""",
    "shuffled_files": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('files|' || doc_id), doc_id) - 1 AS place FROM documents) SELECT doc_id, place // 100 AS file_no, place FROM r",
    "combined_records": f"""WITH {MSA}, r AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY msa_id) AS k FROM m WINDOW w AS (PARTITION BY msa_id ORDER BY row_id))
        SELECT msa_id, row_id, CASE WHEN n <= 5 THEN 'prompt' ELSE 'generated' END AS role, n - 1 AS place, least(k, 5) AS generated_start, md5(aln) AS aln FROM r""",
    "pairwise_summary": f"""WITH {MSA}, g AS (SELECT msa_id, count(*) AS rows, avg(length(aln) - length(replace(aln, '-', ''))) AS gaps FROM m GROUP BY 1),
        p AS (SELECT a.msa_id, avg({_EQUAL.format('')}::DOUBLE / length(a.aln)) AS i, avg(length(a.aln) - {_EQUAL.format('')}) AS d FROM m a JOIN m b ON a.msa_id = b.msa_id AND a.row_id < b.row_id GROUP BY 1)
        SELECT msa_id, rows, round(i, 6) AS mean_identity, round(d, 6) AS mean_distance, round(gaps, 6) AS mean_gaps FROM g LEFT JOIN p USING (msa_id)""",
    "similarity_max_samples": f"""WITH {MSA}, z AS (SELECT a.msa_id, a.row_id, max(CASE WHEN b.row_id IS NULL THEN NULL WHEN {_LONGER} = 0 THEN 0 ELSE {_EQUAL.format(" AND substr(a.aln, i, 1) <> '-'")}::DOUBLE / {_LONGER} END) AS best
          FROM m a LEFT JOIN m b ON a.msa_id = b.msa_id AND a.row_id <> b.row_id AND b.row_id % 2 = 0 WHERE a.row_id % 2 = 0 GROUP BY ALL)
        SELECT msa_id, count(best) AS samples, round(min(best), 9) AS least, round(avg(best), 9) AS mean, round(max(best), 9) AS most FROM z GROUP BY 1""",
    "cosine_rates": """SELECT o_orderkey, round(CASE WHEN o_orderkey < 1000 THEN o_orderkey / 1000.0::DOUBLE
        ELSE greatest(0, 0.5::DOUBLE * (1 + cos((o_orderkey - 1000) / 69000.0::DOUBLE * pi())) * 0.9::DOUBLE + 0.1::DOUBLE) END, 9) AS rate FROM orders""",
    "strict_documents": "SELECT p_partkey, p_name, p_type, p_size::BIGINT AS p_size FROM part",
    "chosen_contexts": f"""WITH {MSA}, l AS (SELECT msa_id, row_id, length(replace(aln, '-', '')) AS n FROM m),
        f AS (SELECT msa_id, count(*) AS k, least(floor(545 / ((min(n) + avg(n)) / 2))::BIGINT + 2, count(*)) AS top FROM l GROUP BY 1),
        e AS (SELECT l.*, member::INTEGER AS member, msa_id || '#' || member AS g FROM l, range(0, 3) r(member)),
        o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY -ln(greatest({UNIFORM.format("'5|' || g || '|' || row_id")}, 1e-15)) / (1.0::DOUBLE / (row_id % 7 + 1)), row_id) AS rank FROM e),
        d AS (SELECT o.*, least(top, 2) + floor({UNIFORM.format("'5|size|' || g")} * (least(top, k) - least(top, 2) + 1)) AS most FROM o JOIN f USING (msa_id)),
        c AS (SELECT *, sum(n + 1) OVER (PARTITION BY g ORDER BY rank ROWS UNBOUNDED PRECEDING) AS t FROM d WHERE rank <= most)
        SELECT msa_id, member, rank, row_id FROM c WHERE t + 52 <= 600""",
}
