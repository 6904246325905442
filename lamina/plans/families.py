"""Queries on families as documents, token budgets and packing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions import residues as R
from lamina.operators import budget as B
from lamina.operators import members as M
from lamina.operators import packing as P
from lamina.operators import tokens as K
from lamina.plans.proxies import SEQS, UNIFORM
from lamina.session import table
from lamina.sources import text_formats as T
from lamina.sources.relations import lengths, sequences


def budget_aligned_cut(spark, sf):
    cut = B.aligned_cut(lengths(spark, sf), 8192)
    return cut.groupBy("family_id").agg(F.count("*").alias("n_members"), F.max("tokens_so_far").alias("tokens"))


def budget_documents(spark, sf):
    """The flagship with payload: lengths decide, then the chosen members' sequences are joined and encoded."""
    chosen = B.aligned_cut(lengths(spark, sf), 8192).select("family_id", "member_idx", "doc_id")
    docs = table(spark, sf, "documents").select("doc_id", R.standard_residues(F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))).alias("sequence"))
    members = F.transform(F.array_sort(F.collect_list(F.struct("member_idx", "sequence"))), lambda m: m["sequence"])
    out = chosen.join(docs, "doc_id").groupBy("family_id").agg(members.alias("m"))
    return out.select("family_id", F.size("m").alias("members"), F.md5(R.document_string(F.col("m"))).alias("document"))


def family_token_cap(spark, sf):
    cut = B.token_cap(lengths(spark, sf), 4000)
    return cut.groupBy("family_id").agg(F.count("*").alias("n_members"), F.max("tokens_so_far").alias("tokens"))


def budget_prompt_cut(spark, sf):
    cut = B.prompt_cut(lengths(spark, sf), 4096)
    return cut.groupBy("family_id").agg(F.count("*").alias("n_members"), F.max("tokens_so_far").alias("tokens"))


def budget_raw_cut(spark, sf):
    return B.raw_cut(lengths(spark, sf), 4096).select("family_id", "member_idx", "seq_len", "kept_len")


def budget_context_sizes(spark, sf):
    rows = lengths(spark, sf).groupBy("family_id").agg(F.count("*").alias("n"), F.min("seq_len").alias("min_len"), F.avg("seq_len").alias("avg_len"))
    return B.context_sizes(rows, 8192, 1000)


def budget_context_prefix(spark, sf):
    return B.largest_fitting_prefix(lengths(spark, sf), 8192, 1000, "family_id", "member_idx")


def budget_variants(spark, sf):
    longest = lengths(spark, sf).groupBy("family_id").agg(F.max("seq_len").alias("longest"))
    u = R.uniform("variant", F.col("family_id"))
    return longest.select("family_id", B.variant_budget(65536, F.col("longest"), u).alias("budget"), B.context_budget(65536, F.col("longest")).alias("context"))


def family_join_sequences(spark, sf):
    seqs = sequences(spark, sf).select(F.lit("all").alias("file"), F.col("doc_id").alias("seq_idx"), "accession", "sequence")
    members = lengths(spark, sf).select("family_id", F.col("member_idx").alias("member_pos"), F.lit("all").alias("file"), F.col("doc_id").alias("seq_idx"))
    return M.resolved(members, seqs).select("family_id", "member_pos", "seq_idx", "accession", F.md5("sequence").alias("sequence"))


def document_gather(spark, sf):
    docs = M.nested(lengths(spark, sf).withColumn("sequence", F.lit("")))
    order = F.reverse(F.sequence(F.lit(0), F.size("members") - 1))
    picked = F.transform(M.gathered(F.col("members"), order), lambda m: m["accession"])
    return docs.select("family_id", F.array_join(picked, ",").alias("reversed"), "original_size")


def document_representative(spark, sf):
    docs = M.nested(lengths(spark, sf).withColumn("sequence", F.lit("")))
    rep = F.get("members", F.lit(0))["accession"]
    rest = M.without_representative(F.col("members"), rep)
    return docs.select("family_id", M.representative(F.col("members"), rep)["accession"].alias("representative"), F.size(rest).alias("others"))


def document_truncate(spark, sf):
    docs = M.nested(sequences(spark, sf))
    cut = M.truncated_member(F.col("members"), 0, 50)
    return docs.select("family_id", F.aggregate(cut, F.lit(0), lambda s, m: s + F.length(m["sequence"])).alias("residues"))


def document_extend(spark, sf):
    docs = M.nested(lengths(spark, sf).withColumn("sequence", F.lit("")))
    keyed = docs.select(F.split_part("family_id", F.lit("_"), F.lit(1)).alias("source"), F.split_part("family_id", F.lit("_"), F.lit(2)).alias("lang"), "members", "original_size")
    a, b = keyed.filter("lang = 'en'"), keyed.filter("lang = 'fr'")
    both = a.alias("a").join(b.alias("b"), "source")
    members, size = M.extended(F.col("a.members"), F.col("b.members"), F.col("a.original_size"), F.col("b.original_size"))
    return both.select("source", F.array_join(F.transform(members, lambda m: m["accession"]), ",").alias("accessions"), size.alias("original_size"))


def max_families(spark, sf):
    return M.capped(lengths(spark, sf), "family_id", ["member_idx"], 3).select("family_id", "member_idx", "accession")


def final_separator(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("m"))
    return rows.select("conv_id", F.array_join(R.final_separator(F.col("m")), ",").alias("members"))


def _examples(spark, sf):
    """Events as a token stream: signups start documents, purchases separate sequences."""
    return table(spark, sf, "events").select(F.col("user_id").alias("shard"), F.col("event_id").alias("pos"), "event_type", "value", F.floor("value").alias("tokens"))


def pack_greedy(spark, sf):
    docs = lengths(spark, sf).select("doc_id", F.pmod("doc_id", F.lit(8)).alias("shard"), F.col("seq_len").cast("long").alias("tokens"))
    return P.greedy_bins(docs, 4000, "shard", "doc_id", "tokens")


def pack_summary(spark, sf):
    bins = pack_greedy(spark, sf).groupBy("shard", "bin_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    return bins.groupBy("shard").agg(F.count("*").alias("bins"), F.max("n").alias("most"), F.max("t").alias("fullest"), F.sum("t").alias("tokens"))


def pack_split(spark, sf):
    docs = lengths(spark, sf).select("doc_id", F.pmod("doc_id", F.lit(8)).alias("shard"), F.col("seq_len").alias("tokens"))
    return P.split_bins(docs, 4000, "shard", "doc_id", "tokens", "doc_id")


def pack_examples(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("identifier"), R.token_ids(F.regexp_replace("text", "[^A-Za-z]", ""), True).alias("input_ids"), F.length("text").cast("double").alias("original_size"))
    out = P.packed_examples(rows, ["conv_id"], "turn")
    return out.select("conv_id", F.size("input_ids").alias("tokens"), F.md5(F.array_join(F.transform("input_ids", lambda i: i.cast("string")), ",")).alias("ids"), "identifier", F.round("original_size", 9).alias("original_size"), "batch_size")


def collate_take_while(spark, sf):
    kept = P.taken_while(_examples(spark, sf), 500, "shard", "pos", "tokens")
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "event_type"))), lambda x: x["event_type"])
    return kept.groupBy("shard").agg(F.array_join(names, "$").alias("names"), F.sum("tokens").alias("tokens"))


def _turn_ids(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", R.token_ids(F.regexp_replace("text", "[^A-Za-z-]", ""), True).alias("ids"))


def collate_padding(spark, sf):
    longest = F.max(F.size("ids")).over(Window.partitionBy("conv_id"))
    rows = _turn_ids(spark, sf).withColumn("longest", longest)
    out = rows.withColumn("p", P.padded_ids(F.col("ids"), F.col("longest")))
    return out.select("conv_id", "turn", F.size("p").alias("n"), F.md5(F.array_join(F.transform("p", lambda i: i.cast("string")), ",")).alias("ids"))


def collate_labels(spark, sf):
    rows = _turn_ids(spark, sf).withColumn("l", P.labels(F.col("ids"), gap_id=24, mask_id=R.MASK))
    return rows.select("conv_id", "turn", F.aggregate("l", F.lit(0), lambda s, x: s + x).alias("label_sum"), F.size(F.filter("l", lambda x: x == R.IGNORE)).alias("ignored"))


def collate_flatten(spark, sf):
    lists = F.transform(F.array_sort(F.collect_list(F.struct("turn", "ids"))), lambda x: x["ids"])
    rows = _turn_ids(spark, sf).groupBy("conv_id").agg(lists.alias("l"))
    ids, positions, marks = P.flattened(F.col("l"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("conv_id", F.size(ids).alias("tokens"), total(positions).alias("position_sum"), total(marks).alias("label_sum"))


def fixed_batches(spark, sf):
    return P.fixed_batches(_examples(spark, sf), 100, "shard", "pos").groupBy("shard", "batch_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def _marks():
    return F.col("event_type") == "signup", F.col("event_type") == "purchase"


def position_in_document(spark, sf):
    rows = _examples(spark, sf)
    out = P.positions_in_document(rows, "shard", "pos", _marks()[0])
    return out.select("shard", "pos", "doc_pos")


def token_doc_seq_ids(spark, sf):
    rows = _examples(spark, sf)
    return K.numbered(rows, "shard", "pos", *_marks()).select("shard", "pos", "doc_no", "seq_no")


def accuracy_first_last(spark, sf):
    rows = _examples(spark, sf)
    tokens = K.numbered(rows, "shard", "pos", *_marks()).withColumn("label", F.when(F.col("event_type") == "error", F.lit(R.IGNORE)).otherwise(F.col("pos") % 5))
    tokens = tokens.withColumn("prediction", F.col("tokens") % 5)
    return K.accuracy(tokens, "shard", "event_type")


def length_stats(spark, sf):
    rows = _examples(spark, sf)
    return K.length_statistics(K.run_lengths(rows, "shard", "pos", _marks()[1]), "shard")


def training_metrics(spark, sf):
    rows = _examples(spark, sf).withColumn("loss", F.col("value") / 100)
    return K.training_metrics(rows, "shard", *_marks(), "loss")


def masked_log_likelihood(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey")
    return rows.agg(F.round(K.masked_mean(-F.col("l_discount"), F.col("l_returnflag") != "N"), 9).alias("score"))


def structure_share(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("batch", F.pmod("l_orderkey", F.lit(50)))
    return K.structure_share(rows, "batch", F.col("l_returnflag") == "R", F.col("l_quantity") > 10)


def accumulation(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", P.accumulation_steps(F.lit(400000), F.col("p_size") * 100, F.lit(2), F.lit(4)).alias("steps"))
    return rows


def global_indexes(spark, sf):
    rows = lengths(spark, sf).select(F.col("family_id").alias("file"), F.col("member_idx").alias("seq_idx"), "accession")
    return T.global_index(rows).select("file", "seq_idx", "global_idx", "accession")


def document_markers(spark, sf):
    rows = table(spark, sf, "part")
    return rows.select("p_partkey", R.document_marker(F.col("p_size") > 40, F.col("p_size") > 20).alias("marker"))


QUERIES = {
    f.__name__: f
    for f in (
        budget_aligned_cut, budget_documents, family_token_cap, budget_prompt_cut, budget_raw_cut, budget_context_sizes, budget_context_prefix, budget_variants,
        family_join_sequences, document_gather, document_representative, document_truncate, document_extend, max_families, final_separator, pack_greedy,
        pack_summary, pack_split, pack_examples, collate_take_while, collate_padding, collate_labels, collate_flatten, fixed_batches, position_in_document,
        token_doc_seq_ids, accuracy_first_last, length_stats, training_metrics, masked_log_likelihood, structure_share, accumulation, global_indexes, document_markers,
    )
}

_RUN = "r AS (SELECT *, sum(seq_len + 1) OVER (PARTITION BY family_id ORDER BY member_idx ROWS UNBOUNDED PRECEDING) AS t, sum(seq_len) OVER (PARTITION BY family_id ORDER BY member_idx ROWS UNBOUNDED PRECEDING) AS u FROM s)"
_TOK = "x AS (SELECT user_id AS shard, event_id AS pos, event_type, value, floor(value)::BIGINT AS tokens FROM events)"
_NUM = f"""{_TOK},
n1 AS (SELECT *, sum((event_type = 'signup')::INTEGER) OVER w AS doc_no, coalesce(sum((event_type = 'purchase')::INTEGER) OVER (PARTITION BY shard ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seps
  FROM x WINDOW w AS (PARTITION BY shard ORDER BY pos ROWS UNBOUNDED PRECEDING)),
n2 AS (SELECT *, seps - min(seps) OVER (PARTITION BY shard, doc_no) AS seq_no FROM n1)"""
_IDS = f"""i AS (SELECT conv_id, turn, CASE WHEN t = '' THEN [] ELSE list_transform(string_split(t, ''), lambda c:
  CASE WHEN strpos('{R.TOKEN_ALPHABET}', c) > 0 THEN strpos('{R.TOKEN_ALPHABET}', c) - 1 ELSE 50 END) END AS ids
  FROM (SELECT *, regexp_replace(text, '[^A-Za-z-]', '', 'g') AS t FROM conversations))"""
_PACK = f"""WITH RECURSIVE {SEQS}, k AS (SELECT doc_id, doc_id % 8 AS shard, seq_len::BIGINT AS tokens, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) AS rn FROM s),
p(doc_id, shard, tokens, rn, total, bin_id) AS (
  SELECT doc_id, shard, tokens, rn, CASE WHEN tokens > 4000 THEN 4001 ELSE tokens END, CASE WHEN tokens > 4000 THEN -1 ELSE 0 END::BIGINT FROM k WHERE rn = 1
  UNION ALL SELECT k.doc_id, k.shard, k.tokens, k.rn,
    CASE WHEN k.tokens > 4000 THEN 4001 WHEN p.bin_id < 0 OR p.total + k.tokens > 4000 THEN k.tokens ELSE p.total + k.tokens END,
    CASE WHEN k.tokens > 4000 THEN p.bin_id WHEN p.bin_id < 0 OR p.total + k.tokens > 4000 THEN p.bin_id + 1 ELSE p.bin_id END
  FROM p JOIN k ON k.shard = p.shard AND k.rn = p.rn + 1),
b AS (SELECT doc_id, shard, tokens, bin_id FROM p WHERE tokens <= 4000)"""
_ACC = """avg(hit) AS g, avg(CASE WHEN seq_no = 0 THEN hit END) AS f, avg(CASE WHEN seq_no = last THEN hit END) AS l"""

ORACLES = {
    "budget_aligned_cut": f"WITH {SEQS}, {_RUN} SELECT family_id, count(*) AS n_members, max(t)::BIGINT AS tokens FROM r WHERE t + 2 < 8192 GROUP BY family_id",
    "budget_documents": f"""WITH {SEQS}, {_RUN} SELECT family_id, count(*)::INTEGER AS members,
        md5('[start-of-document][RAW]' || string_agg(translate(sequence, 'UO', 'CK'), '[SEP]' ORDER BY member_idx) || '[SEP]') AS document FROM r WHERE t + 2 < 8192 GROUP BY family_id""",
    "family_token_cap": f"WITH {SEQS}, {_RUN} SELECT family_id, count(*) AS n_members, max(u)::BIGINT AS tokens FROM r WHERE u <= 4000 GROUP BY family_id",
    "budget_prompt_cut": f"WITH {SEQS}, {_RUN} SELECT family_id, count(*) AS n_members, max(t)::BIGINT AS tokens FROM r WHERE t + 2 <= 4096 GROUP BY family_id",
    "budget_raw_cut": f"""WITH {SEQS}, {_RUN}, k AS (SELECT family_id, member_idx, seq_len, CASE WHEN t + 2 < 4096 THEN seq_len WHEN member_idx = 0 THEN least(seq_len, 4093)
        WHEN t + 2 - seq_len - 1 < 4096 AND 4096 - (t + 2 - seq_len - 1) - 1 > 1 THEN least(seq_len, 4096 - (t + 2 - seq_len - 1) - 1) END::INTEGER AS kept_len FROM r)
        SELECT * FROM k WHERE kept_len IS NOT NULL""",
    "budget_context_sizes": f"""WITH {SEQS}, f AS (SELECT family_id, count(*) AS n, (min(seq_len) + avg(seq_len)) / 2 AS a FROM s GROUP BY family_id),
        t AS (SELECT *, least(floor(7187 / nullif(a, 0))::BIGINT + 2, n) AS top FROM f) SELECT family_id, least(top, 2) AS lo, least(top, n) AS hi FROM t""",
    "budget_context_prefix": f"WITH {SEQS}, {_RUN} SELECT family_id, count(*) FILTER (t + 1002 <= 8192) AS n FROM r GROUP BY family_id",
    "budget_variants": f"""WITH {SEQS}, f AS (SELECT family_id, max(seq_len) AS longest FROM s GROUP BY family_id),
        r AS (SELECT *, greatest(65536 - floor(longest * 1.2::DOUBLE), 0) AS most, {UNIFORM.format("'variant|' || family_id")} AS u FROM f),
        l AS (SELECT *, CASE WHEN most + 1 <= longest THEN longest ELSE longest + floor(u * (most + 1 - longest)) END AS tokens FROM r)
        SELECT family_id, greatest(tokens, floor(most / 2))::BIGINT AS budget, 65536 - longest - 2 AS context FROM l""",
    "family_join_sequences": f"WITH {SEQS} SELECT family_id, member_idx AS member_pos, doc_id AS seq_idx, accession, md5(sequence) AS sequence FROM s",
    "document_gather": f"WITH {SEQS} SELECT family_id, string_agg(accession, ',' ORDER BY member_idx DESC) AS reversed, count(*) AS original_size FROM s GROUP BY family_id",
    "document_representative": f"WITH {SEQS} SELECT family_id, min_by(accession, member_idx) AS representative, count(*) - 1 AS others FROM s GROUP BY family_id",
    "document_truncate": f"WITH {SEQS} SELECT family_id, sum(CASE WHEN member_idx = 0 THEN least(seq_len, 50) ELSE seq_len END)::BIGINT AS residues FROM s GROUP BY family_id",
    "document_extend": f"""WITH {SEQS}, k AS (SELECT split_part(family_id, '_', 1) AS source, split_part(family_id, '_', 2) AS lang, accession, member_idx FROM s),
        o AS (SELECT source FROM k WHERE lang IN ('en', 'fr') GROUP BY source HAVING count(DISTINCT lang) = 2)
        SELECT source, string_agg(accession, ',' ORDER BY lang, member_idx) AS accessions, count(*) AS original_size FROM k JOIN o USING (source) WHERE lang IN ('en', 'fr') GROUP BY source""",
    "max_families": f"WITH {SEQS} SELECT family_id, member_idx, accession FROM s WHERE member_idx < 3",
    "final_separator": "SELECT conv_id, string_agg(role, ',' ORDER BY turn) || '[SEP]' AS members FROM conversations GROUP BY conv_id",
    "pack_greedy": f"{_PACK} SELECT * FROM b",
    "pack_summary": f"""{_PACK} SELECT shard, count(*) AS bins, max(n) AS most, max(t)::BIGINT AS fullest, sum(t)::BIGINT AS tokens
        FROM (SELECT shard, bin_id, count(*) AS n, sum(tokens) AS t FROM b GROUP BY ALL) GROUP BY shard""",
    "pack_examples": f"""WITH i AS (SELECT conv_id, turn, role, text, regexp_replace(text, '[^A-Za-z]', '', 'g') AS t FROM conversations),
        j AS (SELECT *, CASE WHEN t = '' THEN [] ELSE list_transform(string_split(t, ''), lambda c: CASE WHEN strpos('{R.TOKEN_ALPHABET}', c) > 0 THEN strpos('{R.TOKEN_ALPHABET}', c) - 1 ELSE 50 END) END AS ids FROM i)
        SELECT conv_id, sum(len(ids))::INTEGER AS tokens, md5(array_to_string(flatten(list(ids ORDER BY turn)), ',')) AS ids, string_agg(role, '-' ORDER BY turn) AS identifier,
          round(avg(length(text)), 9) AS original_size, count(*) AS batch_size FROM j GROUP BY conv_id""",
    "collate_take_while": f"""WITH {_TOK}, r AS (SELECT *, sum(tokens) OVER w AS so_far, row_number() OVER w AS rn FROM x WINDOW w AS (PARTITION BY shard ORDER BY pos ROWS UNBOUNDED PRECEDING))
        SELECT shard, string_agg(event_type, '$' ORDER BY pos) AS names, sum(tokens)::BIGINT AS tokens FROM r WHERE rn = 1 OR so_far <= 500 GROUP BY shard""",
    "collate_padding": f"""WITH {_IDS}, p AS (SELECT conv_id, turn, list_resize(ids, max(len(ids)) OVER (PARTITION BY conv_id), 0) AS p FROM i)
        SELECT conv_id, turn, len(p) AS n, md5(array_to_string(p, ',')) AS ids FROM p""",
    "collate_labels": f"""WITH {_IDS}, l AS (SELECT conv_id, turn, list_transform(ids, lambda x: CASE WHEN x IN (46, 24, 51) THEN -100 ELSE x END) AS l FROM i)
        SELECT conv_id, turn, coalesce(list_sum(l), 0)::BIGINT AS label_sum, len(list_filter(l, lambda x: x = -100)) AS ignored FROM l""",
    "collate_flatten": f"""WITH {_IDS} SELECT conv_id, sum(len(ids))::BIGINT AS tokens, sum(len(ids) * (len(ids) - 1) // 2)::BIGINT AS position_sum,
        sum(coalesce(list_sum(ids), 0) - CASE WHEN len(ids) > 0 THEN ids[1] + 100 ELSE 0 END)::BIGINT AS label_sum FROM i GROUP BY conv_id""",
    "fixed_batches": f"""WITH {_TOK}, b AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY pos) - 1) // 100 AS batch_id FROM x)
        SELECT shard, batch_id, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM b GROUP BY ALL""",
    "position_in_document": f"""WITH {_TOK} SELECT shard, pos, pos - max(CASE WHEN event_type = 'signup' THEN pos END) OVER (PARTITION BY shard ORDER BY pos ROWS UNBOUNDED PRECEDING) AS doc_pos FROM x""",
    "token_doc_seq_ids": f"WITH {_NUM} SELECT shard, pos, doc_no::BIGINT AS doc_no, seq_no::BIGINT AS seq_no FROM n2",
    "accuracy_first_last": f"""WITH {_NUM}, a AS (SELECT *, CASE WHEN event_type = 'error' THEN -100 ELSE pos % 5 END AS label, tokens % 5 AS prediction FROM n2),
        f AS (SELECT *, max(seq_no) OVER d - CASE WHEN max_by(label, pos) OVER d = -100 THEN 1 ELSE 0 END AS last, (label = prediction)::INTEGER::DOUBLE AS hit FROM a WINDOW d AS (PARTITION BY shard, doc_no)),
        o AS (SELECT event_type, {_ACC} FROM f WHERE label <> -100 GROUP BY ROLLUP (event_type))
        SELECT event_type, round(g, 9) AS global_accuracy, round(f, 9) AS first_accuracy, round(l, 9) AS last_accuracy FROM o""",
    "length_stats": f"""WITH {_TOK}, q AS (SELECT shard, pos, lag(pos) OVER (PARTITION BY shard ORDER BY pos) AS b FROM x WHERE event_type = 'purchase'),
        r AS (SELECT shard, CASE WHEN b IS NULL THEN pos ELSE pos - b - 1 END AS run FROM q)
        SELECT shard, min(run) AS min_len, max(run) AS max_len, round(avg(run), 9) AS mean_len FROM r GROUP BY shard""",
    "training_metrics": f"""WITH {_TOK} SELECT shard, count(*) AS tokens, sum((event_type = 'purchase')::INTEGER)::BIGINT AS separators, sum((event_type = 'signup')::INTEGER)::BIGINT AS documents,
        round(exp(avg(value / 100)), 9) AS perplexity FROM x GROUP BY 1""",
    "masked_log_likelihood": """SELECT l_orderkey, round(sum(CASE WHEN l_returnflag <> 'N' THEN -l_discount ELSE 0 END) / greatest(sum((l_returnflag <> 'N')::INTEGER), 1), 9) AS score FROM lineitem GROUP BY 1""",
    "structure_share": """SELECT l_orderkey % 50 AS batch, round(sum((l_returnflag = 'R' AND l_quantity > 10)::INTEGER)::DOUBLE / nullif(sum((l_returnflag = 'R')::INTEGER), 0), 9) AS with_coordinates
        FROM lineitem GROUP BY 1""",
    "accumulation": "SELECT p_partkey, ceil(400000::DOUBLE / (p_size * 100 * 2 * 4))::BIGINT AS steps FROM part",
    "global_indexes": f"""WITH {SEQS}, b AS (SELECT family_id, sum(count(*)) OVER (ORDER BY family_id) - count(*) AS base FROM s GROUP BY family_id)
        SELECT family_id AS file, member_idx AS seq_idx, (member_idx + base)::BIGINT AS global_idx, accession FROM s JOIN b USING (family_id)""",
    "document_markers": "SELECT p_partkey, CASE WHEN p_size > 40 THEN '[MSA]' WHEN p_size > 20 THEN '[RAW-WITH-MSA-POS]' ELSE '[RAW]' END AS marker FROM part",
}
