"""Queries on sequence cleaning, parsing and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import residues as R
from lamina.operators import members as M
from lamina.plans.proxies import SEQS, UNIFORM
from lamina.session import table
from lamina.sources import text_formats as T
from lamina.sources.relations import lengths, sequences


def a2m(docs):
    """Mixed-case text as an a2m string: upper case matches, lower case insertions, '.' and '-' gaps."""
    return F.regexp_replace(F.col("text"), "[^A-Za-z.]", "-")


A2M = "d AS (SELECT *, regexp_replace(text, '[^A-Za-z.]', '-', 'g') AS a FROM documents)"


def seq_clean_gaps(spark, sf):
    s = R.without_gaps(a2m(None))
    return table(spark, sf, "documents").select("doc_id", F.length(s).alias("n"), F.md5(s).alias("cleaned"))


def seq_clean_insertions(spark, sf):
    s = R.without_insertions(a2m(None))
    return table(spark, sf, "documents").select("doc_id", F.length(s).alias("n"), F.md5(s).alias("cleaned"))


def seq_parse_modes(spark, sf):
    docs = table(spark, sf, "documents").withColumn("a", a2m(None)).withColumn("kind", F.when(F.col("lang") == "en", "a3m").otherwise("gym"))
    return docs.select("doc_id", "kind", F.md5(R.msa_sequence(F.col("a"), F.col("kind"))).alias("parsed"), F.md5(R.plain_upper(F.col("a"))).alias("plain"))


def seq_uo_fix(spark, sf):
    return sequences(spark, sf).select("accession", F.md5(R.standard_residues(F.col("sequence"))).alias("fixed"))


def seq_positions_msa(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(".-"), F.upper("p_type"), F.lit("-b")).alias("t"))
    cols = ["p_partkey"]
    for name, flags in {"aligned": (True, True, True), "raw": (False, True, False), "plain": (False, False, True)}.items():
        p = R.match_positions(F.translate("t", " ", "."), *flags)
        cols += [p["sequence"].alias(f"{name}_sequence"), F.array_join(F.transform(p["positions"], lambda x: x.cast("string")), ",").alias(f"{name}_positions")]
    return parts.select(*cols)


def _positions_sql(name, keep_gaps, keep_insertions, use_msa):
    skip = ["ch <> '.'"]
    if not keep_insertions:
        skip.append("NOT regexp_matches(ch, '^[a-z]$')")
    if not keep_gaps and not use_msa:
        skip.append("ch <> '-'")
    move = "CASE WHEN regexp_matches(ch, '^[a-z]$') THEN 0 ELSE 1 END" if use_msa else "1"
    shown = "true" if keep_gaps else "ch <> '-'"
    return f"""
{name}_r AS (SELECT k, i, ch, sum({move}) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS p FROM x WHERE {' AND '.join(skip)}),
{name} AS (SELECT k, string_agg(upper(ch), '' ORDER BY i) AS {name}_sequence, string_agg(p::VARCHAR, ',' ORDER BY i) AS {name}_positions FROM {name}_r WHERE {shown} GROUP BY k)"""


def seq_split_gap_runs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "-").alias("a"))
    runs = docs.withColumn("f", R.gap_run_fragments(F.col("a"), 1, 3))
    return runs.select("doc_id", F.size("f").alias("fragments"), F.md5(F.array_join("f", "|")).alias("joined"))


def seq_uniprot_regex(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("sp|"), F.upper(F.translate("p_name", " ", "")), F.lit("|"), "p_type").alias("h"), "p_name")
    return parts.select("p_partkey", R.accession_of(F.col("h")).alias("accession"), R.accession_of(F.col("p_name")).alias("whole"))


def fasta_roundtrip(spark, sf):
    rows = sequences(spark, sf)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member_idx", "accession", "sequence"))), lambda m: F.concat(F.lit(">"), m["accession"], F.lit("\n"), m["sequence"])), "\n")
    files = rows.groupBy(F.col("family_id").alias("file")).agg(text.alias("value"))
    return T.fasta(files).select("file", "seq_idx", "accession", "seq_len", F.md5("sequence").alias("sequence"))


def sequences_file_roundtrip(spark, sf):
    rows = sequences(spark, sf)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member_idx", "accession", "sequence"))), lambda m: F.concat(F.lit(">"), m["accession"], F.lit("\n"), m["sequence"])), "\n")
    files = rows.groupBy(F.col("family_id").alias("file")).agg(F.concat(text, F.lit("\n")).alias("value"))
    return T.global_index(T.sequences_file(files)).select("file", "seq_idx", "global_idx", "accession", "seq_len", F.md5("sequence").alias("sequence"))


def mapping_parse(spark, sf):
    rows = lengths(spark, sf)
    lists = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), ",")
    families = rows.groupBy("family_id").agg(lists.alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("family_id", "l"))), lambda f: F.concat(F.lit(">"), f["family_id"], F.lit("\nall.sequences:0,1\nall.sequences:"), f["l"])), "\n")
    files = families.groupBy(F.substring_index("family_id", "_", 1).alias("file")).agg(text.alias("value"))
    return T.mapping_file(files)


def first_records(spark, sf):
    rows = sequences(spark, sf).select(F.col("family_id").alias("file"), F.col("member_idx").alias("seq_idx"), "accession", "sequence")
    return T.first_record(rows).select("file", "accession", F.md5("sequence").alias("sequence"))


def fasta_lines(spark, sf):
    return T.fasta_lines(sequences(spark, sf), F.col("accession"), F.col("sequence")).select(F.md5("value").alias("line"))


def csv_fields(spark, sf):
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_type")
    f = T.csv_fields(line, {"key": 0, "brand": 2, "kind": 3})
    return table(spark, sf, "part").select(f.alias("f")).select("f.key", "f.brand", "f.kind")


def jsonl_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", T.json_line(F.col("props"), "k bigint").alias("j")).select("event_id", "j.k")


def cluster_sessions(spark, sf):
    """Turns as lines: a conversation's user turns begin clusters."""
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("file"), (2 * F.col("turn")).alias("line_no"), F.when(F.col("role") == "user", F.lit("#cl-")).alias("mark"),
        F.concat(F.lit(">t"), F.col("turn").cast("string")).alias("h"), F.regexp_replace("text", r"\s", "").alias("t"),
    )
    lines = rows.select("file", F.explode(F.array(F.struct((F.col("line_no") * 3).alias("line_no"), F.col("mark").alias("value")), F.struct((F.col("line_no") * 3 + 1).alias("line_no"), F.col("h").alias("value")), F.struct((F.col("line_no") * 3 + 2).alias("line_no"), F.col("t").alias("value")))).alias("x"))
    lines = lines.select("file", "x.line_no", "x.value").filter("value is not null")
    return T.clusters(lines).select("file", "cluster_no", "name", "pos", "header", F.md5("sequence").alias("sequence"))


def document_json(spark, sf):
    docs = M.nested(sequences(spark, sf))
    text = docs.select("family_id", T.document_json(F.col("members")).alias("j"))
    back = text.select("family_id", F.from_json("j", "array<struct<member_idx int, accession string, sequence string>>").alias("members"))
    return M.flat(back).select("family_id", "member_idx", "accession", F.md5("sequence").alias("sequence"))


def coordinate_text(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.md5(T.coordinate_text(F.transform("embedding", lambda x: F.round(x.cast("double"), 1) + 0.0))).alias("line"))


def candidates(spark, sf):
    rows = table(spark, sf, "part").select(F.when(F.col("p_size") > 25, F.col("p_name")).alias("mutant"), F.col("p_type").alias("mutated_sequence"), F.col("p_retailprice").alias("DMS_score"), F.col("p_partkey").alias("row"))
    return T.candidates_csv(rows)


def token_encode(spark, sf):
    """Whole conversations as token documents; unknown characters are UNK."""
    rows = table(spark, sf, "conversations")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace("text", "[^A-Za-z]", "").alias("s")))), lambda x: x["s"])
    ids = rows.groupBy("conv_id").agg(parts.alias("members")).withColumn("ids", R.document_ids(F.col("members"), allow_unknown=True))
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return ids.select("conv_id", F.size("ids").alias("n_tokens"), F.md5(text).alias("ids"), F.md5(R.document_string(F.col("members"))).alias("string"))


def token_decode(spark, sf):
    rows = table(spark, sf, "conversations")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace("text", "[^A-Za-z]", "").alias("s")))), lambda x: x["s"])
    text = rows.groupBy("conv_id").agg(parts.alias("members")).select("conv_id", R.document_string(F.col("members")).alias("t"))
    found = text.withColumn("m", R.decoded_members(F.concat("t", F.lit("[PAD][PAD]"))))
    return found.select("conv_id", F.size("m").alias("members"), F.md5(F.array_join("m", "|")).alias("joined"))


def homology_encode(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.upper("p_type").alias("t"))
    code = R.homology_code(F.col("t"))
    return parts.select("p_partkey", F.array_join(F.transform(code, lambda i: i.cast("string")), ",").alias("codes"))


def repeat_guard(spark, sf):
    s = F.regexp_replace("text", "[^A-Za-z]", "")
    return table(spark, sf, "documents").select("doc_id", R.repeat_guard(s).alias("repeats"))


def random_crop(spark, sf):
    rows = sequences(spark, sf)
    u = [R.uniform(f"crop{i}", F.col("accession")) for i in range(3)]
    cut = R.crop(F.col("sequence"), *u, least=20, most=200)
    return rows.select("accession", F.length(cut).alias("n"), F.md5(cut).alias("cropped"))


def content_hashes(spark, sf):
    return sequences(spark, sf).select("accession", F.sha1("sequence").alias("sha1"), F.sha2("sequence", 256).alias("sha256"), F.md5("sequence").alias("md5"))


def confidence_colors(spark, sf):
    return table(spark, sf, "lineitem").groupBy(R.confidence_color(F.col("l_quantity") * 2).alias("color")).agg(F.count("*").alias("n"))


def length_filter(spark, sf):
    rows = lengths(spark, sf).filter(M.length_between(F.col("seq_len"), 200, 2000))
    return rows.groupBy("family_id").agg(F.count("*").alias("kept"), F.sum("seq_len").alias("residues"))


def nonstandard_filter(spark, sf):
    return table(spark, sf, "part").filter(M.standard_only(F.upper("p_name"))).select("p_partkey")


def encoded_parts(spark, sf):
    """Index encoding of letters by an alphabet with one code for all others, and back."""
    letters = F.upper(F.regexp_replace("p_type", "[^A-Za-z]", ""))
    codes = R.alphabet_code(letters, R.HOMOLOGY_ALPHABET, 20)
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(F.transform(codes, lambda x: x.cast("string")), ",").alias("codes"), R.decoded(codes, R.HOMOLOGY_ALPHABET + "?").alias("letters")
    )


def padded_lists(spark, sf):
    """Per-residue values of a conversation's turns, with a fill at the start, at the end and between turns."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    lists = F.transform("t", lambda x: F.array_repeat(x["turn"].cast("double"), F.least(x["n"], F.lit(5))))
    return turns.select("conv_id", F.array_join(F.transform(R.padded(lists, -1.0, 1, 1), lambda x: x.cast("int").cast("string")), ",").alias("padded"))


def sliced_members(spark, sf):
    s = R.sliced(F.col("sequence"), F.lit(3), F.least(F.length("sequence"), F.lit(40)))
    return sequences(spark, sf).select("accession", F.length(s).alias("n"), F.md5(s).alias("part"))


def strict_distances(spark, sf):
    """Parts against the next brand's part of the same name length: equal lengths only, else it is an error."""
    rows = table(spark, sf, "part").select("p_brand", "p_name", F.length("p_name").alias("n")).distinct()
    first = rows.groupBy("n").agg(F.min("p_name").alias("first"))
    return rows.join(first, "n").select("p_brand", "p_name", R.strict_hamming(F.col("p_name"), F.col("first")).alias("distance"))


def family_names(spark, sf):
    path = F.concat(F.lit("data/"), "p_brand", F.lit("/"), F.replace("p_type", F.lit(" "), F.lit(".")), F.lit(".a3m"))
    return table(spark, sf, "part").select("p_partkey", R.family_of(path).alias("family"))


def _records(spark, sf):
    rows = sequences(spark, sf).groupBy("family_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member_idx", F.col("doc_id").alias("d"), F.substr("sequence", F.lit(1), F.lit(30)).alias("s")))),
            lambda m: F.concat(F.lit(">"), F.pmod(m["d"], F.lit(7)).cast("string"), F.lit("\n"), m["s"])), "\n").alias("value")
    )
    return T.fasta(rows.select(F.concat("family_id", F.lit(".fasta")).alias("file"), "value"))


def sequences_by_name(spark, sf):
    """The last of several records of a name in a file."""
    return T.by_name(_records(spark, sf).withColumn("accession", F.concat_ws("|", "file", "accession")).withColumn("seq_idx", F.col("seq_idx")))


def family_sources(spark, sf):
    """FASTA files of families as the lines of one .sequences and one .mapping file."""
    lines, lists = T.family_files(_records(spark, sf))
    return lines.select(F.lit("sequences").alias("kind"), F.md5("value").alias("line")).unionByName(lists.select(F.lit("mapping").alias("kind"), F.md5("value").alias("line")))


QUERIES = {
    f.__name__: f
    for f in (
        seq_clean_gaps, seq_clean_insertions, seq_parse_modes, seq_uo_fix, seq_positions_msa, seq_split_gap_runs, seq_uniprot_regex, fasta_roundtrip,
        sequences_file_roundtrip, mapping_parse, first_records, fasta_lines, csv_fields, jsonl_fields, cluster_sessions, document_json, coordinate_text,
        candidates, token_encode, token_decode, homology_encode, repeat_guard, random_crop, content_hashes, confidence_colors, length_filter, nonstandard_filter,
        encoded_parts, padded_lists, sliced_members, strict_distances, family_names, sequences_by_name, family_sources,
    )
}

_WORDS = "(SELECT conv_id, list(regexp_replace(text, '[^A-Za-z]', '', 'g') ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"
ORACLES = {
    "seq_clean_gaps": f"WITH {A2M} SELECT doc_id, length(regexp_replace(a, '[-.]', '', 'g')) AS n, md5(regexp_replace(a, '[-.]', '', 'g')) AS cleaned FROM d",
    "seq_clean_insertions": f"WITH {A2M} SELECT doc_id, length(regexp_replace(a, '[a-z.]', '', 'g')) AS n, md5(regexp_replace(a, '[a-z.]', '', 'g')) AS cleaned FROM d",
    "seq_parse_modes": f"""WITH {A2M} SELECT doc_id, CASE WHEN lang = 'en' THEN 'a3m' ELSE 'gym' END AS kind,
        md5(CASE WHEN lang = 'en' THEN upper(replace(regexp_replace(a, '[a-z.]', '', 'g'), '.', '-')) ELSE upper(replace(a, '.', '-')) END) AS parsed,
        md5(upper(translate(a, '.-', ''))) AS plain FROM d""",
    "seq_uo_fix": f"WITH {SEQS} SELECT accession, md5(translate(sequence, 'UO', 'CK')) AS fixed FROM s",
    "seq_positions_msa": f"""WITH t AS (SELECT p_partkey AS k, replace(p_name || '.-' || upper(p_type) || '-b', ' ', '.') AS t FROM part),
        x AS (SELECT k, unnest(range(0, length(t))) AS i, unnest(string_split(t, '')) AS ch FROM t),
        {_positions_sql('aligned', True, True, True)}, {_positions_sql('raw', False, True, False)}, {_positions_sql('plain', False, False, True)}
        SELECT t.k AS p_partkey, aligned_sequence, aligned_positions, raw_sequence, raw_positions, coalesce(plain_sequence, '') AS plain_sequence,
          coalesce(plain_positions, '') AS plain_positions FROM t LEFT JOIN aligned USING (k) LEFT JOIN raw USING (k) LEFT JOIN plain USING (k)""",
    "seq_split_gap_runs": """WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[^A-Za-z]', '-', 'g'), '--'),
        lambda x: upper(replace(x, '-', ''))), lambda x: length(x) >= 3) AS f FROM documents)
        SELECT doc_id, len(f) AS fragments, md5(array_to_string(f, '|')) AS joined FROM d""",
    "seq_uniprot_regex": """SELECT p_partkey, CASE WHEN regexp_extract(h, '\\|([A-Z0-9]+)\\|', 1) = '' THEN h ELSE regexp_extract(h, '\\|([A-Z0-9]+)\\|', 1) END AS accession,
        p_name AS whole FROM (SELECT *, 'sp|' || upper(replace(p_name, ' ', '')) || '|' || p_type AS h FROM part)""",
    "fasta_roundtrip": f"WITH {SEQS} SELECT family_id AS file, member_idx AS seq_idx, accession, seq_len, md5(sequence) AS sequence FROM s",
    "sequences_file_roundtrip": f"""WITH {SEQS}, b AS (SELECT family_id, sum(count(*)) OVER (ORDER BY family_id) - count(*) AS base FROM s GROUP BY family_id)
        SELECT family_id AS file, member_idx AS seq_idx, (member_idx + base)::BIGINT AS global_idx, accession, seq_len, md5(sequence) AS sequence FROM s JOIN b USING (family_id)""",
    "mapping_parse": f"WITH {SEQS} SELECT family_id, 'all.sequences' AS file, row_number() OVER (PARTITION BY family_id ORDER BY doc_id) - 1 AS member_pos, doc_id AS seq_idx FROM s",
    "first_records": f"WITH {SEQS} SELECT family_id AS file, accession, md5(sequence) AS sequence FROM s WHERE member_idx = 0",
    "fasta_lines": f"WITH {SEQS} SELECT md5('>' || accession || chr(10) || sequence) AS line FROM s",
    "csv_fields": "SELECT p_partkey::VARCHAR AS key, p_brand AS brand, p_type AS kind FROM part",
    "jsonl_fields": "SELECT event_id, (props->>'k')::BIGINT AS k FROM events",
    "cluster_sessions": """WITH r AS (SELECT conv_id::VARCHAR AS file, turn, role, 't' || turn AS header, regexp_replace(text, '\\s', '', 'g') AS t,
          sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS cluster_no FROM conversations)
        SELECT file, cluster_no, first_value(header) OVER w || '_clust_' || (cluster_no - 1) AS name, row_number() OVER w AS pos, header, md5(t) AS sequence
        FROM r WHERE cluster_no > 0 WINDOW w AS (PARTITION BY file, cluster_no ORDER BY turn)""",
    "document_json": f"WITH {SEQS} SELECT family_id, member_idx, accession, md5(sequence) AS sequence FROM s",
    "coordinate_text": "SELECT vec_id, md5(array_to_string(list_transform(embedding, lambda x: printf('%.3f', round(x::DOUBLE, 1) + 0.0::DOUBLE)), ',')) AS line FROM embeddings",
    "candidates": """SELECT coalesce(CASE WHEN p_size > 25 THEN p_name END, 'seq_' || p_partkey) AS name, p_type AS sequence, p_retailprice AS "DMS_score" FROM part""",
    "token_encode": f"""WITH m AS {_WORDS},
        i AS (SELECT conv_id, m, list_concat([47, 63], flatten(list_transform(m, lambda s: list_concat(
          CASE WHEN s = '' THEN [] ELSE list_transform(string_split(s, ''), lambda c: CASE WHEN strpos('{R.TOKEN_ALPHABET}', c) > 0 THEN strpos('{R.TOKEN_ALPHABET}', c) - 1 ELSE 50 END) END, [49])))) AS ids FROM m)
        SELECT conv_id, len(ids) AS n_tokens, md5(array_to_string(ids, ',')) AS ids, md5('[start-of-document][RAW]' || array_to_string(m, '[SEP]') || '[SEP]') AS string FROM i""",
    "token_decode": f"WITH m AS {_WORDS}, f AS (SELECT conv_id, list_filter(m, lambda x: x <> '') AS m FROM m) SELECT conv_id, len(m) AS members, md5(array_to_string(m, '|')) AS joined FROM f",
    "homology_encode": f"""SELECT p_partkey, array_to_string(list_transform(string_split(upper(p_type), ''), lambda c:
        CASE WHEN strpos('{R.HOMOLOGY_ALPHABET}', c) > 0 THEN strpos('{R.HOMOLOGY_ALPHABET}', c) - 1 ELSE 20 END), ',') AS codes FROM part""",
    "repeat_guard": """WITH d AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS t FROM documents)
        SELECT doc_id, length(t) >= 81 AND (length(t) - length(replace(t, right(t, 9), ''))) / 9 >= 9 AS repeats FROM d""",
    "content_hashes": f"WITH {SEQS} SELECT accession, sha1(sequence) AS sha1, sha256(sequence) AS sha256, md5(sequence) AS md5 FROM s",
    "confidence_colors": """SELECT CASE WHEN l_quantity * 2 > 90 THEN 'blue' WHEN l_quantity * 2 > 70 THEN 'lightblue' WHEN l_quantity * 2 > 50 THEN 'yellow' ELSE 'orange' END AS color,
        count(*) AS n FROM lineitem GROUP BY 1""",
    "length_filter": f"WITH {SEQS} SELECT family_id, count(*) AS kept, sum(seq_len)::BIGINT AS residues FROM s WHERE seq_len BETWEEN 200 AND 2000 GROUP BY family_id",
    "nonstandard_filter": "SELECT p_partkey FROM part WHERE NOT regexp_matches(upper(p_name), '[XUZOBJ]')",
    "random_crop": f"""WITH {SEQS}, u AS (SELECT *, length(sequence) AS n, {{u0}} AS a, {{u1}} AS b, {{u2}} AS c FROM s),
        z AS (SELECT *, CASE WHEN n <= 20 THEN n ELSE 20 + floor(b * (least(200, n) - 20 + 1)) END AS size FROM u),
        o AS (SELECT accession, CASE WHEN a < 0.5 THEN substr(sequence, floor(c * (n - size + 1))::BIGINT + 1, size::BIGINT) ELSE sequence END AS x FROM z)
        SELECT accession, length(x) AS n, md5(x) AS cropped FROM o""",
}
_RECORDS = f"""WITH {SEQS}, r AS (SELECT family_id, member_idx, (doc_id % 7)::VARCHAR AS name, substr(sequence, 1, 30) AS q FROM s)"""
ORACLES |= {
    "encoded_parts": f"""WITH p AS (SELECT p_partkey, upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS t FROM part)
        SELECT p_partkey, array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN strpos('{R.HOMOLOGY_ALPHABET}', c) > 0
          THEN strpos('{R.HOMOLOGY_ALPHABET}', c) - 1 ELSE 20 END), ',') AS codes, regexp_replace(t, '[^{R.HOMOLOGY_ALPHABET}]', '?', 'g') AS letters FROM p""",
    "padded_lists": """SELECT conv_id, '-1,' || string_agg(rtrim(repeat(turn || ',', least(length(text), 5)::BIGINT), ','), ',-1,' ORDER BY turn) || ',-1' AS padded
        FROM conversations GROUP BY conv_id""",
    "sliced_members": f"WITH {SEQS} SELECT accession, length(x) AS n, md5(x) AS part FROM (SELECT accession, sequence[4:40] AS x FROM s)",
    "strict_distances": """WITH p AS (SELECT DISTINCT p_brand, p_name FROM part), f AS (SELECT length(p_name) AS n, min(p_name) AS first FROM p GROUP BY 1)
        SELECT p_brand, p_name, hamming(p_name, first)::BIGINT AS distance FROM p JOIN f ON n = length(p_name)""",
    "family_names": "SELECT p_partkey, split_part(p_type, ' ', 1) AS family FROM part",
    "sequences_by_name": f"{_RECORDS} SELECT family_id || '.fasta|' || name AS accession, max_by(q, member_idx) AS sequence FROM r GROUP BY family_id, name",
    "family_sources": f"""{_RECORDS}, g AS (SELECT *, row_number() OVER (ORDER BY family_id || '.fasta', member_idx) - 1 AS i FROM r)
        SELECT 'sequences' AS kind, md5('>' || name || chr(10) || q) AS line FROM g
        UNION ALL SELECT 'mapping', md5('>' || family_id || chr(10) || 'all.sequences:' || string_agg(i::VARCHAR, ',' ORDER BY i)) FROM g GROUP BY family_id""",
}
ORACLES["random_crop"] = ORACLES["random_crop"].format(**{f"u{i}": UNIFORM.format(f"'crop{i}|' || accession") for i in range(3)})
