"""Queries on alignments: identities, homology weights, column statistics and divergences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import identity as I
from lamina.functions import residues as R
from lamina.functions.statistics import correlation
from lamina.operators import alignment as A
from lamina.operators import evaluation as E
from lamina.plans.proxies import CELLS, MSA
from lamina.session import table
from lamina.sources.relations import aligned, cells


def _with_first(spark, sf):
    rows = aligned(spark, sf)
    return rows.join(rows.groupBy("msa_id").agg(F.min_by("aln", "row_id").alias("query")), "msa_id")


def identity_definitions(spark, sf):
    a, b = F.col("aln"), F.col("query")
    return _with_first(spark, sf).select(
        "msa_id",
        "row_id",
        F.round(I.equal_length_identity(a, b), 9).alias("equal_length"),
        F.round(I.pairwise_identity(a, b), 9).alias("pairwise"),
        F.round(I.longest_ungapped_similarity(a, b), 9).alias("longest_ungapped"),
        F.round(I.homology_similarity(a, b), 9).alias("homology"),
        F.round(I.column_identity(a, b), 9).alias("columns"),
    )


def hamming_distances(spark, sf):
    a, b = F.rtrim(F.replace("aln", F.lit("-"), F.lit(" "))), F.rtrim(F.replace("query", F.lit("-"), F.lit(" ")))
    return _with_first(spark, sf).select("msa_id", "row_id", R.hamming(a, b).alias("prefix"), R.hamming(a, b, include_flanking=True).alias("flanking"), R.hamming(F.col("aln"), F.col("query"), ignore_gaps=True).alias("no_gaps"))


def similarity_band_filter(spark, sf):
    return A.similarity_band(aligned(spark, sf), 0.9, 0.75).select("msa_id", "row_id", F.round("similarity", 9).alias("similarity"))


def homology_weights(spark, sf):
    out = A.homology_weights(aligned(spark, sf), 0.2)
    return out.select("msa_id", "row_id", "neighbours", F.round("p", 9).alias("p"), F.round("n_eff", 6).alias("n_eff"))


def meff_strict(spark, sf):
    return A.effective_size(A.strict_weights(aligned(spark, sf))).select("msa_id", F.round("meff", 6).alias("meff"))


def meff_sampled(spark, sf):
    """Effective size from the neighbours of a hash sample of at most 64 rows of each alignment."""
    from lamina.operators.sampling import sampled

    weights = A.strict_weights(aligned(spark, sf))
    chosen = sampled(weights, 64, "meff", ["msa_id"], "row_id")
    m = weights.groupBy("msa_id").agg(F.count("*").alias("m"))
    return chosen.groupBy("msa_id").agg(F.avg("weight").alias("w")).join(m, "msa_id").select("msa_id", F.round(F.col("w") * F.col("m"), 6).alias("meff"))


def alignment_summary(spark, sf):
    return A.summary(aligned(spark, sf))


def _alphabet(long):
    return long.select("msa_id", "token").distinct()


def col_frequencies(spark, sf):
    long = cells(aligned(spark, sf)).withColumn("weight", F.lit(1.0))
    return A.column_frequencies(long, _alphabet(long)).select("msa_id", "col", "token", F.round("frequency", 9).alias("frequency"))


def col_frequencies_pseudocount(spark, sf):
    long = cells(aligned(spark, sf)).withColumn("weight", F.lit(1.0))
    return A.column_frequencies(long, _alphabet(long), 0.3).select("msa_id", "col", "token", F.round("frequency", 9).alias("frequency"))


def _weighted_cells(spark, sf):
    rows = A.distinct_rows(aligned(spark, sf))
    return cells(rows).join(rows.select("msa_id", "row_id", F.col("copies").cast("double").alias("weight")), ["msa_id", "row_id"])


def pair_frequencies(spark, sf):
    out = A.pair_frequencies(_weighted_cells(spark, sf))
    return out.select("msa_id", "i", "x", "j", "y", F.round("frequency", 9).alias("frequency"), F.round("covariance", 9).alias("covariance"))


def pair_frequencies_pearson(spark, sf):
    """Correlation of joint and product frequencies in each alignment."""
    out = A.pair_frequencies(_weighted_cells(spark, sf))
    return out.groupBy("msa_id").agg(F.count("*").alias("cells"), F.round(correlation(F.col("frequency"), F.col("frequency") - F.col("covariance")), 6).alias("pearson"))


def contact_scores(spark, sf):
    long = _weighted_cells(spark, sf)
    total = long.select("msa_id", "row_id", "weight").distinct().groupBy("msa_id").agg(F.sum("weight").alias("total"))
    single = long.groupBy("msa_id", F.col("col").alias("i"), F.col("token").alias("x")).agg(F.sum("weight").alias("w")).join(total, "msa_id")
    single = single.select("msa_id", "i", "x", (F.col("w") / F.col("total")).alias("frequency"), "total")
    out = A.contact_scores(A.pair_frequencies(long), single)
    return out.select("msa_id", "i", "j", F.round("score", 6).alias("score"))


def _entropy(spark, sf, half=None):
    rows = aligned(spark, sf)
    columns = rows.select("msa_id", F.explode(F.sequence(F.lit(0), F.length("aln") - 1)).alias("col")).distinct()
    if half is not None:
        rows = rows.filter(F.pmod("row_id", F.lit(2)) == half)
    return A.column_entropy(cells(rows), columns)


def col_entropy(spark, sf):
    return _entropy(spark, sf).select("msa_id", "col", "depth", F.round(F.col("entropy") + 0.0, 9).alias("entropy"), F.round(F.exp("entropy"), 9).alias("perplexity"))


def entropy_correlation(spark, sf):
    """Rows split by the parity of their id play natural and generated sequences."""
    out = A.entropy_correlation(_entropy(spark, sf, 0), _entropy(spark, sf, 1))
    return out.select("msa_id", "columns", F.round("correlation", 6).alias("correlation"))


def js_kl_divergence(spark, sf):
    counts = cells(aligned(spark, sf)).filter("token <> '-'").groupBy("msa_id", "col", "token", F.pmod("row_id", F.lit(2)).alias("half")).agg(F.count("*").alias("n"))
    out = A.divergences(counts.filter("half = 0").drop("half"), counts.filter("half = 1").drop("half"))
    return out.select("msa_id", "columns", *[F.round(c, 8).alias(c) for c in ("js", "kl_symmetric", "kl_smoothed")])


_LETTERS = list("-ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def logo_matrix(spark, sf):
    out = A.logo(cells(aligned(spark, sf)), _LETTERS)
    return out.select("msa_id", "col", *[F.col(f"`{c}`").alias("gap" if c == "-" else f"n_{c}") for c in _LETTERS])


def global_alignment(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("a"), F.lower("p_type").alias("b"))
    return rows.select("p_partkey", F.round(A.global_alignment_identity(F.col("a"), F.col("b")), 9).alias("identity"))


def superposition(spark, sf):
    pts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda j: F.element_at("embedding", i * 3 + j).cast("double")))
    rows = table(spark, sf, "embeddings").select("vec_id", pts.alias("xs"))
    turned = F.transform("xs", lambda p: F.array(-F.get(p, F.lit(1)), F.get(p, F.lit(0)), F.get(p, F.lit(2)) + 1.0))
    return A.superposition_rmsd(rows.withColumn("ys", turned), "vec_id").select("vec_id", F.round("rmsd", 5).alias("rmsd"))


def similarity_max_prompt(spark, sf):
    """Distinct rows of even id against those of odd id: the largest similarity of each, then per alignment."""
    rows = aligned(spark, sf)
    samples = A.distinct_rows(rows.filter(F.pmod("row_id", F.lit(2)) == 0)).select("msa_id", "row_id", "aln")
    best = A.best_similarity(samples, rows.filter(F.pmod("row_id", F.lit(2)) == 1))
    return best.groupBy("msa_id").agg(F.count("*").alias("samples"), *[F.round(f("best"), 9).alias(n) for n, f in (("least", F.min), ("mean", F.avg), ("most", F.max))])


def diversity(spark, sf):
    """Mean and least distance of the distinct rows of an alignment to the others."""
    rows = A.distinct_rows(aligned(spark, sf))
    shared = A.shared_tokens(rows.select("msa_id", "row_id", "aln"), gaps=True)
    n = rows.select("msa_id", F.col("row_id").alias("a"), F.length("aln").alias("l"))
    others = rows.groupBy("msa_id").agg(F.count("*").alias("m"))
    per = shared.filter("a <> b").groupBy("msa_id", "a").agg(F.sum("n").alias("same"), F.max("n").alias("closest"))
    out = n.join(per, ["msa_id", "a"], "left").join(others, "msa_id")
    mean = F.col("l") - F.try_divide(F.coalesce("same", F.lit(0)), F.col("m") - 1)
    return out.groupBy("msa_id").agg(F.round(F.avg(mean), 6).alias("diversity"), F.round(F.avg(F.col("l") - F.coalesce("closest", F.lit(0))), 6).alias("mean_min_distance"))


def generated_length_ratios(spark, sf):
    rows = aligned(spark, sf).select("msa_id", "row_id", F.length(F.replace("aln", F.lit("-"), F.lit(""))).alias("n"))
    gen, prompt = rows.filter(F.pmod("row_id", F.lit(2)) == 0), rows.filter(F.pmod("row_id", F.lit(2)) == 1)
    return E.length_ratios(gen.withColumnRenamed("row_id", "generated_id"), prompt.select("msa_id", "n"), "msa_id")


def ratio_of_aggregates(spark, sf):
    return E.outer_of_inner(generated_length_ratios(spark, sf), "msa_id", {"min": "min_ratio", "max": "max_ratio", "mean": "mean_ratio"})


QUERIES = {
    f.__name__: f
    for f in (
        identity_definitions, hamming_distances, similarity_band_filter, homology_weights, meff_strict, meff_sampled, alignment_summary, col_frequencies,
        col_frequencies_pseudocount, pair_frequencies, pair_frequencies_pearson, contact_scores, col_entropy, entropy_correlation, js_kl_divergence, logo_matrix,
        global_alignment, superposition, similarity_max_prompt, diversity, generated_length_ratios, ratio_of_aggregates,
    )
}

_FIRST = f"{MSA}, q AS (SELECT m.*, first_value(aln) OVER (PARTITION BY msa_id ORDER BY row_id) AS query FROM m)"


def _count(a, b, test):
    return f"len(list_filter(range(1, length({a}) + 1), lambda i: {test.format(x=f'substr({a}, i, 1)', y=f'substr({b}, i, 1)')}))"


_SAME = _count("aln", "query", "{x} = {y}")
_REAL = _count("aln", "query", "{x} = {y} AND {x} <> '-'")
_SOME = _count("aln", "query", "{x} <> '-' OR {y} <> '-'")
_PAIRS = f"""{MSA}, z AS (SELECT a.msa_id, a.row_id AS a, b.row_id AS b, length(a.aln) AS l, length(replace(a.aln, '-', '')) AS r,
  {_count('a.aln', 'b.aln', "{x} = {y} AND {x} <> '-'")} AS n, {_count('a.aln', 'b.aln', '{x} = {y}')} AS g FROM m a JOIN m b USING (msa_id))"""
_RATIOS = f"""{MSA}, n AS (SELECT msa_id, row_id, length(replace(aln, '-', '')) AS n FROM m),
r AS (SELECT g.msa_id, g.row_id AS generated_id, min(g.n::DOUBLE / p.n) AS lo, max(g.n::DOUBLE / p.n) AS hi, avg(g.n::DOUBLE / p.n) AS av
  FROM n g JOIN n p ON g.msa_id = p.msa_id AND g.row_id % 2 = 0 AND p.row_id % 2 = 1 GROUP BY ALL),
o AS (SELECT msa_id, generated_id, round(lo, 9) AS min_ratio, round(hi, 9) AS max_ratio, round(av, 9) AS mean_ratio FROM r)"""
_FREQ = f"""{CELLS}, f AS (SELECT msa_id, col, token, count(*) AS n FROM c GROUP BY ALL),
t AS (SELECT msa_id, col, sum(n) AS total FROM f GROUP BY ALL), a AS (SELECT msa_id, token, count(*) OVER (PARTITION BY msa_id) AS k FROM (SELECT DISTINCT msa_id, token FROM c)),
d AS (SELECT t.msa_id, t.col, a.token, coalesce(n::DOUBLE / total, 0) AS fr, k FROM t JOIN a USING (msa_id) LEFT JOIN f ON f.msa_id = t.msa_id AND f.col = t.col AND f.token = a.token)"""
_PF = f"""{CELLS}, f0 AS (SELECT msa_id, col, token, count(*) AS n FROM c GROUP BY ALL), f AS (SELECT msa_id, col, token, n::DOUBLE / sum(n) OVER (PARTITION BY msa_id, col) AS f FROM f0),
tot AS (SELECT msa_id, count(*) AS total FROM m GROUP BY msa_id),
p AS (SELECT a.msa_id, a.col AS i, a.token AS x, b.col AS j, b.token AS y, count(*) AS w FROM c a JOIN c b ON a.msa_id = b.msa_id AND a.row_id = b.row_id AND a.col < b.col GROUP BY ALL),
o AS (SELECT p.*, w::DOUBLE / total AS fr, w::DOUBLE / total - u.f * v.f AS cov FROM p JOIN tot USING (msa_id)
  JOIN f u ON u.msa_id = p.msa_id AND u.col = i AND u.token = x JOIN f v ON v.msa_id = p.msa_id AND v.col = j AND v.token = y)"""


def _ent(name, where):
    return f"""{name}c AS (SELECT msa_id, col, token, count(*) AS n FROM c WHERE token <> '-' {where} GROUP BY ALL),
{name}p AS (SELECT *, sum(n) OVER (PARTITION BY msa_id, col) AS depth FROM {name}c),
{name}g AS (SELECT msa_id, col, max(depth)::BIGINT AS depth, -sum(n / depth * ln(n / depth)) AS entropy FROM {name}p GROUP BY ALL),
{name} AS (SELECT k.msa_id, k.col, coalesce(depth, 0) AS depth, entropy FROM (SELECT DISTINCT msa_id, col FROM c) k LEFT JOIN {name}g USING (msa_id, col))"""


ORACLES = {
    "identity_definitions": f"""WITH {_FIRST} SELECT msa_id, row_id, round({_SAME}::DOUBLE / length(aln), 9) AS equal_length, round(CASE WHEN {_SOME} = 0 THEN 1 ELSE {_REAL}::DOUBLE / {_SOME} END, 9) AS pairwise,
        round(CASE WHEN greatest(length(replace(aln, '-', '')), length(replace(query, '-', ''))) = 0 THEN 0 ELSE {_REAL}::DOUBLE / greatest(length(replace(aln, '-', '')), length(replace(query, '-', ''))) END, 9) AS longest_ungapped,
        round({_REAL}::DOUBLE / nullif(length(replace(aln, '-', '')), 0), 9) AS homology, round({_SAME}::DOUBLE / length(aln), 9) AS columns FROM q""",
    "hamming_distances": f"""WITH {_FIRST}, h AS (SELECT *, rtrim(replace(aln, '-', ' ')) AS a, rtrim(replace(query, '-', ' ')) AS b FROM q),
        o AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) AS p FROM h)
        SELECT msa_id, row_id, p AS prefix, p + abs(length(a) - length(b)) AS flanking, {_count('aln', 'query', "{x} <> {y} AND {x} <> '-' AND {y} <> '-'")} AS no_gaps FROM o""",
    "similarity_band_filter": f"""WITH {_FIRST}, o AS (SELECT *, {_SAME}::DOUBLE / length(query) AS s FROM q) SELECT msa_id, row_id, round(s, 9) AS similarity FROM o WHERE s <= 0.9 AND 1 - s <= 0.75""",
    "homology_weights": f"""WITH {_PAIRS}, k AS (SELECT msa_id, a AS row_id, count(*) FILTER (1 - n::DOUBLE / r <= 0.2) AS neighbours FROM z GROUP BY ALL)
        SELECT msa_id, row_id, neighbours, round(1 / neighbours / sum(1 / neighbours) OVER w, 9) AS p, round(sum(1 / neighbours) OVER w, 6) AS n_eff FROM k WINDOW w AS (PARTITION BY msa_id)""",
    "meff_strict": f"""WITH {_PAIRS}, k AS (SELECT msa_id, a, count(*) FILTER (g::DOUBLE / l > 0.8) AS n FROM z GROUP BY ALL) SELECT msa_id, round(sum(1 / n), 6) AS meff FROM k GROUP BY msa_id""",
    "meff_sampled": f"""WITH {_PAIRS}, k AS (SELECT msa_id, a, count(*) FILTER (g::DOUBLE / l > 0.8) AS n FROM z GROUP BY ALL),
        o AS (SELECT *, count(*) OVER (PARTITION BY msa_id) AS m, row_number() OVER (PARTITION BY msa_id ORDER BY md5('meff|' || a), a) AS rn FROM k)
        SELECT msa_id, round(avg(1 / n) * max(m), 6) AS meff FROM o WHERE rn <= 64 GROUP BY msa_id""",
    "alignment_summary": f"""WITH {CELLS}, g AS (SELECT msa_id, col, avg((token = '-')::INTEGER) AS g FROM c GROUP BY ALL),
        o AS (SELECT msa_id, count(*) AS l, sum((g < 0.5)::INTEGER)::BIGINT AS occupied FROM g GROUP BY msa_id) SELECT msa_id, count(*) AS m, l, occupied FROM m JOIN o USING (msa_id) GROUP BY ALL""",
    "col_frequencies": f"WITH {_FREQ} SELECT msa_id, col, token, round(fr, 9) AS frequency FROM d",
    "col_frequencies_pseudocount": f"WITH {_FREQ} SELECT msa_id, col, token, round((1 - 0.3::DOUBLE) * fr + 0.3::DOUBLE / k, 9) AS frequency FROM d",
    "pair_frequencies": f"WITH {_PF} SELECT msa_id, i, x, j, y, round(fr, 9) AS frequency, round(cov, 9) AS covariance FROM o",
    "pair_frequencies_pearson": f"WITH {_PF} SELECT msa_id, count(*) AS cells, round(corr(fr, fr - cov), 6) AS pearson FROM o GROUP BY msa_id",
    "col_entropy": f"WITH {CELLS}, {_ent('e', '')} SELECT msa_id, col, depth, round(entropy + 0.0::DOUBLE, 9) AS entropy, round(exp(entropy), 9) AS perplexity FROM e",
    "entropy_correlation": f"""WITH {CELLS}, {_ent('e', 'AND row_id % 2 = 0')}, {_ent('h', 'AND row_id % 2 = 1')},
        j AS (SELECT msa_id, e.entropy AS a, h.entropy AS b FROM e JOIN h USING (msa_id, col) WHERE e.depth >= 10 AND h.depth >= 10)
        SELECT msa_id, count(*) AS columns, round(CASE WHEN count(*) > 1 AND stddev_pop(a) > 1e-12 AND stddev_pop(b) > 1e-12 THEN corr(a, b) END, 6) AS correlation FROM j GROUP BY msa_id""",
    "js_kl_divergence": f"""WITH {CELLS}, n AS (SELECT msa_id, col, token, row_id % 2 AS half, count(*) AS n FROM c WHERE token <> '-' GROUP BY ALL),
        t AS (SELECT *, sum(n) OVER (PARTITION BY msa_id, col, half) AS t FROM n), a AS (SELECT * FROM t WHERE half = 0 AND t >= 10), b AS (SELECT * FROM t WHERE half = 1 AND t >= 10),
        k AS (SELECT DISTINCT msa_id, col FROM a INTERSECT SELECT DISTINCT msa_id, col FROM b),
        u AS (SELECT msa_id, col, token, a.n AS na, b.n AS nb FROM a FULL JOIN b USING (msa_id, col, token)),
        v AS (SELECT u.*, coalesce(na, 0) + 1e-9 AS pa, coalesce(nb, 0) + 1e-9 AS pb, na + 2.0::DOUBLE / sum((na IS NOT NULL)::INTEGER) OVER w AS sa,
          CASE WHEN na IS NOT NULL THEN coalesce(nb, 0) + 2.0::DOUBLE / sum((na IS NOT NULL)::INTEGER) OVER w END AS sb FROM u JOIN k USING (msa_id, col) WINDOW w AS (PARTITION BY msa_id, col)),
        x AS (SELECT msa_id, col, pa / sum(pa) OVER w AS p, pb / sum(pb) OVER w AS q, sa / sum(sa) OVER w AS sp, sb / sum(sb) OVER w AS sq FROM v WINDOW w AS (PARTITION BY msa_id, col)),
        y AS (SELECT msa_id, col, sum(p * ln(2 * p / (p + q))) / 2 + sum(q * ln(2 * q / (p + q))) / 2 AS js, sum(p * ln(p / q)) / 2 + sum(q * ln(q / p)) / 2 AS kl, sum(sp * ln(sp / sq)) AS ks FROM x GROUP BY ALL)
        SELECT msa_id, count(*) AS columns, round(avg(js), 8) AS js, round(avg(kl), 8) AS kl_symmetric, round(avg(ks), 8) AS kl_smoothed FROM y GROUP BY msa_id""",
    "logo_matrix": f"WITH {CELLS} SELECT msa_id, col, " + ", ".join(f"count(*) FILTER (token = '{c}') AS {'gap' if c == '-' else 'n_' + c}" for c in _LETTERS) + " FROM c GROUP BY msa_id, col",
    "similarity_max_prompt": f"""WITH {MSA}, d AS (SELECT DISTINCT msa_id, aln, row_id % 2 AS half FROM m),
        p AS (SELECT a.msa_id, a.aln AS aln, b.aln AS query FROM d a JOIN d b ON a.msa_id = b.msa_id AND a.half = 0 AND b.half = 1),
        o AS (SELECT msa_id, aln, max(CASE WHEN greatest(length(replace(aln, '-', '')), length(replace(query, '-', ''))) = 0 THEN 0 ELSE {_REAL}::DOUBLE / greatest(length(replace(aln, '-', '')), length(replace(query, '-', ''))) END) AS best FROM p GROUP BY ALL)
        SELECT msa_id, count(*) AS samples, round(min(best), 9) AS least, round(avg(best), 9) AS mean, round(max(best), 9) AS most FROM o GROUP BY msa_id""",
    "diversity": f"""WITH {MSA}, d AS (SELECT DISTINCT msa_id, aln FROM m), p AS (SELECT a.msa_id, a.aln AS aln, b.aln AS query FROM d a JOIN d b USING (msa_id)),
        o AS (SELECT msa_id, aln, avg(length(aln) - {_SAME}) FILTER (aln <> query) AS mean, min(length(aln) - {_SAME}) FILTER (aln <> query) AS least FROM p GROUP BY ALL)
        SELECT msa_id, round(avg(mean), 6) AS diversity, round(avg(coalesce(least, length(aln))), 6) AS mean_min_distance FROM o GROUP BY msa_id""",
    "generated_length_ratios": f"WITH {_RATIOS} SELECT * FROM o",
    "ratio_of_aggregates": f"WITH {_RATIOS} SELECT msa_id, "
    + ", ".join(f"round({f}({c}_ratio), 3) AS {o}_of_{c}" for c in ("min", "max", "mean") for o, f in (("min", "min"), ("max", "max"), ("mean", "avg")))
    + " FROM o GROUP BY msa_id",
}
