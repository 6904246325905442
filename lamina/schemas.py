"""Column layouts of the engine's tables; nothing is inferred."""

from __future__ import annotations

SEQUENCES = "file string, seq_idx bigint, accession string, sequence string, seq_len int"
MAPPING = "family_id string, file string, member_pos int, seq_idx bigint"
MEMBER = "struct<idx:int,accession:string,sequence:string,similarity:double,coverage:double,weight:double>"
FAMILY = f"identifier string, representative_accession string, original_size bigint, members array<{MEMBER}>"
HITS = "query_header string, target_header string, pident double, alnlen int, qlen int, tlen int, qcov double, tcov double"
RESULTS = "evaluator string, sampler string, instance string, metric string, value double"
ASSAY = "mutant string, mutated_sequence string, DMS_score double, DMS_score_bin int"
CATALOGUE = "DMS_id string, MSA_filename string, DMS_filename string, seq_len int"
