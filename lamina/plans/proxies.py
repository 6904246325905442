"""SQL for the tables that stand for families and alignments, as in sources.relations."""

SEQS = """s AS (SELECT source || '_' || lang AS family_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS member_idx,
  'D' || doc_id AS accession, doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq_len FROM documents)"""

MSA = """m AS (SELECT p_brand AS msa_id, p_partkey AS row_id,
  rpad(upper(regexp_replace(p_name, '[^A-Za-z]', '-', 'g')), (SELECT max(length(p_name)) FROM part)::INTEGER, '-') ||
  rpad(upper(regexp_replace(p_type, '[^A-Za-z]', '-', 'g')), (SELECT max(length(p_type)) FROM part)::INTEGER, '-') AS aln FROM part)"""

CELLS = MSA + """,
c AS (SELECT msa_id, row_id, unnest(range(0, length(aln))) AS col, unnest(string_split(aln, '')) AS token FROM m)"""

#: The md5 uniform of functions.residues.uniform; give the joined text.
UNIFORM = "(('0x' || substr(md5({0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
