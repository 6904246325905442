"""The corpus operators as registered queries, with DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, html_text, ngram_join, quality_rules, sharding, source_mixing, token_counts, token_files, unit_dedup, url_filters
from lamina.llm.common import shared_folder
from lamina.session import table

#: The vocabulary file of the token queries; any tokenizers file with the same kind of pieces will do.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"), VOCABULARY)
    return token_counts.length_answers(token_counts.histogram(lengths))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "failed_rules"
    )


def repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("text_key")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents")).drop("text_key")


def token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), shared_folder(spark, "tokens"), VOCABULARY)
    return token_files.with_checksum(token_files.read_token_files(spark, path))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.schedule(table(spark, sf_dir, "documents")).drop("text_key")


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(scanned)


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_token_counts": token_histogram,
    "op2_quality_rules": quality,
    "op3_substring_dedup": repeated_units,
    "op4_sharding": shards,
    "op5_ngram_jaccard": jaccard,
    "op6_token_orc": token_orc,
    "op7_url_filters": urls,
    "op8_source_mixing": mixing,
    "op9_decontamination": contamination,
    "op10_html_text": page_texts,
}

_WORD = r"'[^\x20\x09-\x0D]+'"
_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)


def _broken(rule: quality_rules.Rule) -> str:
    top, bottom = rule.ratio.split(" / ")
    ratio = f"(CASE WHEN {bottom} <> 0 THEN {top}::DOUBLE / {bottom} END)"
    tests = [f"{ratio} < {rule.low}::DOUBLE"] if rule.low is not None else []
    tests += [f"{ratio} > {rule.high}::DOUBLE"] if rule.high is not None else []
    return f"coalesce(n_words >= {rule.min_words} AND ({' OR '.join(tests)}), false)"


_RULES = ", ".join(f"CASE WHEN {_broken(r)} THEN '{r.name}' END" for r in quality_rules.RULES)

ORACLES = {
    "op2_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT r, doc_id, body, regexp_extract_all(body, {_WORD}) AS words,
        list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM d),
p AS (SELECT r, unnest(range(1, greatest(len(words) - 4, 0) + 1)) AS i, words FROM w),
g AS (SELECT r, i, list_slice(words, i, i + 4) AS win FROM p),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM t, range(0, 5) AS o(k) GROUP BY r),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN c USING (r)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        array_to_string(list_filter([{_RULES}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, n_lines, n_stop_words, failed_rules FROM j""",
    "op4_sharding": """
WITH RECURSIVE bits(n, v, k) AS (
  SELECT n, n, 0 FROM range(0, 256) AS o(n)
  UNION ALL SELECT n, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
s AS (SELECT doc_id, (strlen(body) + 8)::BIGINT AS size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32 FROM d, crc),
o AS (SELECT *, sum(size) OVER w - size AS start, row_number() OVER w - 1 AS i, sum(size) OVER () AS total FROM s
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, least(23, (start * 24) // total)::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (i - min(i) OVER (PARTITION BY shard))::BIGINT AS slot,
  NULL::INTEGER AS grown_shard FROM p""",
    "op5_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4
    THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(list_slice(words, i, i + 3), ' '))
    WHEN len(words) > 0 THEN ['short ' || array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.y)::BIGINT AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n""",
}


def _shrunk(level: str, parent: str, on: str, out: str, columns: str) -> str:
    """One level of the beta-binomial shrinkage: strengths by moments, then a and b."""
    return f"""
{out}_s AS (SELECT sum(n)::DOUBLE AS nn, sum(k)::DOUBLE AS kk, count(*)::DOUBLE AS m, sum(n::DOUBLE * n) AS n2, sum(k::DOUBLE * k / n) AS k2
  FROM {level} WHERE n > 0),
{out}_r AS (SELECT (k2 - nn * (kk / nn) * (kk / nn) - (kk / nn) * (1 - kk / nn) * (m - 1))
  / nullif((kk / nn) * (1 - kk / nn) * (nn - n2 / nn - (m - 1)), 0) AS rho FROM {out}_s),
{out}_t AS (SELECT coalesce(least(1000, greatest(1, CASE WHEN rho <= 0 THEN 1000 ELSE 1 / rho - 1 END)), 1000)::DOUBLE AS strength FROM {out}_r),
{out} AS (SELECT {columns}, k + strength * prior AS a, n - k + strength * (1 - prior) AS b FROM {level} JOIN {parent} USING ({on}), {out}_t)"""


_URL_RULES = sorted(url_filters.RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", f"'{h}{p}'", f"'{v}'") for v, h, p in _URL_RULES]

_LONG = ", ".join(f"'{s}'" for s in url_filters.LONG_SUFFIXES)

ORACLES["op7_url_filters"] = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
h AS (SELECT host, string_split(host, '.') AS parts, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k
  FROM p LEFT JOIN marks ON doc_id = page_id GROUP BY host),
g AS (SELECT *, CASE WHEN len(parts) >= 2 THEN parts[-2] || '.' || parts[-1] ELSE host END AS pair FROM h),
hosts AS (SELECT host, n, k, CASE WHEN pair IN ({_LONG}) THEN pair ELSE parts[-1] END AS suffix,
    CASE WHEN pair IN ({_LONG}) AND len(parts) >= 3 THEN parts[-3] || '.' || pair ELSE pair END AS domain FROM g),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, 1 AS one, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains GROUP BY ALL),
base AS (SELECT 1 AS one, coalesce(sum(k)::DOUBLE / nullif(sum(n), 0), 0) AS prior FROM suffixes),
{_shrunk("suffixes", "base", "one", "by_suffix", "suffix")},
pri_s AS (SELECT suffix, a / (a + b) AS prior FROM by_suffix),
{_shrunk("domains", "pri_s", "suffix", "by_domain", "domain")},
pri_d AS (SELECT domain, a / (a + b) AS prior FROM by_domain),
{_shrunk("hosts", "pri_d", "domain", "by_host", "host")},
bound AS (SELECT host, round(greatest(0, a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 9) >= 0.5 AS blocked FROM by_host)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN {r}" for f, r, _ in _FITS)} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN {v}" for f, _, v in _FITS)} WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM p JOIN bound USING (host)"""

ORACLES["op8_source_mixing"] = f"""
WITH u AS (SELECT coalesce(source, '') AS source, doc_id, md5(coalesce(text, '')) AS text_key, count(*) AS copies,
    sum(len(regexp_extract_all(coalesce(text, ''), {_WORD})) + 1)::BIGINT AS n_tokens FROM documents GROUP BY ALL),
s AS (SELECT source, count(*) AS n_docs, sum(n_tokens)::BIGINT AS t FROM u GROUP BY source),
q AS (SELECT *, t::DOUBLE / (SELECT sum(t) FROM s) AS share FROM s),
e AS (SELECT CASE WHEN max(share) / min(share) <= 1.5 THEN 0.0::DOUBLE ELSE 1 - ln(1.5::DOUBLE) / ln(max(share) / min(share)) END AS alpha,
    max(share) AS top FROM q),
r AS (SELECT source, n_docs, t, pow(share, alpha) AS raised, pow(share / top, alpha - 1) AS passes FROM q, e),
pl AS (SELECT source, t, round(raised / (SELECT sum(raised) FROM r), 9) AS weight, round(passes, 6) AS passes,
    ceil(n_docs / 4096)::BIGINT AS n_blocks FROM r),
ra AS (SELECT source, weight, floor(passes)::BIGINT AS whole, round((passes - floor(passes)) * t)::BIGINT AS rest, n_blocks FROM pl),
ro AS (SELECT u.*, weight, whole, rest,
    ('0x' || substr(md5('mix|block|' || coalesce(doc_id::VARCHAR, '') || '|' || text_key), 1, 8))::BIGINT % n_blocks AS block FROM u JOIN ra USING (source)),
b AS (SELECT source, block, whole, rest, sum(n_tokens) AS bt FROM ro GROUP BY ALL),
bp AS (SELECT *, unnest(range(1, whole + (rest > 0)::BIGINT + 1)) AS pass FROM b),
bo AS (SELECT source, block, pass, row_number() OVER w - 1 AS block_rank, sum(bt) OVER w - bt AS tokens_before FROM bp
  WINDOW w AS (PARTITION BY source, pass ORDER BY ('0x' || substr(md5('mix|' || source || '|' || pass || '|' || block), 1, 8))::BIGINT, block
    ROWS UNBOUNDED PRECEDING)),
pa AS (SELECT *, unnest(range(1, whole + (rest > 0)::BIGINT + 1)) AS pass FROM ro),
po AS (SELECT *, row_number() OVER w - 1 AS slot, sum(n_tokens) OVER w - n_tokens AS in_block FROM pa
  WINDOW w AS (PARTITION BY source, block, pass ORDER BY ('0x' || substr(md5('mix|slot|' || pass || '|' || coalesce(doc_id::VARCHAR, '') || '|' || text_key), 1, 8))::BIGINT,
    doc_id, text_key ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, copies::BIGINT AS copies, n_tokens, weight, pass::BIGINT AS pass_no, block_rank::BIGINT AS block_rank, slot::BIGINT AS slot
FROM po JOIN bo USING (source, block, pass) WHERE pass <= whole OR tokens_before + in_block < rest"""

_PLAIN = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"


def _plain_words(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_PLAIN})"


ORACLES["op9_decontamination"] = f"""
WITH b AS (SELECT item_id, {_plain_words("text")} AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, len10 AS l, unnest(list_transform(range(1, len(words) - len10 + 2), lambda i: array_to_string(list_slice(words, i, i + len10 - 1), ' '))) AS win
  FROM (SELECT *, least(10, len(words)) AS len10 FROM b WHERE len(words) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_plain_words("text")} AS words FROM documents),
p AS (SELECT r, l, words, unnest(range(1, greatest(len(words) - l + 1, 0) + 1)) AS i FROM d, (SELECT DISTINCT l FROM bw)),
g AS (SELECT r, l, i, array_to_string(list_slice(words, i, i + l - 1), ' ') AS win FROM p),
h AS (SELECT DISTINCT r, l, i, item_id FROM g JOIN bw USING (l, win)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS x FROM h) GROUP BY r),
t AS (SELECT r, list(DISTINCT item_id::VARCHAR) AS items FROM h GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(array_to_string(list_sort(coalesce(items, [])), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""
