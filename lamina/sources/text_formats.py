"""Readers and writers of the line-based sequence formats.

Readers take a DataFrame (file, value) of whole files, from read_files(), or of records, and return flat
tables. Gzipped files are decompressed by Spark's reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, value: each text file whole. For sequence files that fit a row; see read_records for others."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, value: the text between '>' marks, splittable over large files; headers must hold no '>'."""
    rows = spark.read.option("lineSep", ">").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")


def record_fields(value: Column) -> Column:
    """struct(accession, sequence) of one record: the first line, and the rest without white space."""
    first = F.trim(F.substring_index(value, "\n", 1))
    rest = F.when(F.instr(value, "\n") > 0, F.substr(value, F.instr(value, "\n") + 1)).otherwise("")
    return F.struct(first.alias("accession"), F.regexp_replace(rest, r"\s", "").alias("sequence"))


def fasta(files: DataFrame) -> DataFrame:
    """file, seq_idx, accession, sequence, seq_len of whole files; the first line must be a header."""
    bad = ~F.col("value").rlike(r"^\s*(>|$)")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no header at the start of "), "file"))).otherwise(F.col("value"))
    records = F.filter(F.split(F.concat(F.lit("\n"), checked), "\n>"), lambda r: F.trim(r) != "")
    rows = files.select("file", F.posexplode(records).alias("seq_idx", "record"))
    rows = rows.select("file", F.col("seq_idx").cast("long").alias("seq_idx"), record_fields(F.col("record")).alias("f"))
    return rows.select("file", "seq_idx", "f.accession", "f.sequence", F.length("f.sequence").alias("seq_len"))


def by_name(rows: DataFrame) -> DataFrame:
    """The last sequence of each accession."""
    return rows.groupBy("accession").agg(F.max_by("sequence", "seq_idx").alias("sequence"))


def first_record(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.min_by(F.struct("accession", "sequence"), "seq_idx").alias("r")).select("file", "r.*")


def sequences_file(files: DataFrame) -> DataFrame:
    """.sequences files: alternating header and sequence lines; an odd number of lines is an error."""
    lines = F.split(F.regexp_replace("value", r"\n+$", ""), "\n")
    checked = F.when(F.size(lines) % 2 == 1, F.raise_error(F.concat(F.lit("odd number of lines in "), "file")).cast("array<string>")).otherwise(lines)
    pairs = F.transform(
        F.sequence(F.lit(0), F.expr("size(lines) div 2") - 1),
        lambda i: F.struct(F.trim(F.substr(F.get("lines", 2 * i), F.lit(2))).alias("accession"), F.trim(F.get("lines", 2 * i + 1)).alias("sequence")),
    )
    rows = files.select("file", checked.alias("lines")).select("file", F.posexplode(pairs).alias("seq_idx", "p"))
    return rows.select("file", F.col("seq_idx").cast("long").alias("seq_idx"), "p.accession", "p.sequence", F.length("p.sequence").alias("seq_len"))


def mapping_file(files: DataFrame) -> DataFrame:
    """.mapping files: family_id, file, member_pos, seq_idx; of lines that name a file twice the last counts."""
    families = F.filter(F.split(F.concat(F.lit("\n"), F.col("value")), "\n>"), lambda r: F.trim(r) != "")
    rows = files.select(F.explode(families).alias("family")).select(
        F.trim(F.substring_index("family", "\n", 1)).alias("family_id"), F.posexplode(F.split("family", "\n")).alias("line", "entry")
    )
    rows = rows.filter((F.col("line") > 0) & F.col("entry").contains(":")).select(
        "family_id", F.substring_index("entry", ":", 1).alias("file"), F.struct("line", F.substring_index("entry", ":", -1).alias("list")).alias("e")
    )
    last = rows.groupBy("family_id", "file").agg(F.max("e").alias("e"))
    return last.select("family_id", "file", F.posexplode(F.split("e.list", ",")).alias("member_pos", "i")).select(
        "family_id", "file", "member_pos", F.col("i").cast("long").alias("seq_idx")
    )


def csv_field(line: Column, index: int, separator: str = ",") -> Column:
    """One field of a line by a naive split, without quoting."""
    return F.split_part(line, F.lit(separator), F.lit(index + 1))


def csv_fields(line: Column, fields: dict[str, int], separator: str = ",") -> Column:
    return F.struct(*[csv_field(line, i, separator).alias(name) for name, i in fields.items()])


def json_line(line: Column, schema: str) -> Column:
    return F.from_json(line, schema)


def record_lines(value: Column, fields: dict[str, int]) -> Column:
    """Fields of a '>' record by line number."""
    parts = F.split(value, "\n")
    return F.struct(*[F.get(parts, i).alias(name) for name, i in fields.items()])


def clusters(lines: DataFrame) -> DataFrame:
    """Cluster alignments: '#cl-' lines begin a cluster, named by its first header and a number.

    lines(file, line_no, value); returns file, cluster_no, name, pos, header, sequence.
    """
    order = Window.partitionBy("file").orderBy("line_no")
    begins = F.col("value").startswith("#cl-")
    rows = lines.withColumn("cluster_no", F.sum(begins.cast("int")).over(order)).filter(~begins & (F.col("cluster_no") > 0))
    rows = rows.withColumn("pos", F.sum(F.col("value").startswith(">").cast("int")).over(Window.partitionBy("file", "cluster_no").orderBy("line_no")))
    records = rows.groupBy("file", "cluster_no", "pos").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("l"))
    records = records.select(
        "file",
        "cluster_no",
        "pos",
        F.trim(F.substr(F.get("l", F.lit(0))["value"], F.lit(2))).alias("header"),
        F.array_join(F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda x: F.trim(x["value"])), "").alias("sequence"),
    )
    first = F.min_by("header", "pos").over(Window.partitionBy("file", "cluster_no"))
    return records.withColumn("name", F.concat(first, F.lit("_clust_"), (F.col("cluster_no") - 1).cast("string")))


def global_index(rows: DataFrame) -> DataFrame:
    """seq_idx plus the number of sequences in the files that sort before, as global_idx."""
    counts = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = counts.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(before, "file").withColumn("global_idx", F.col("seq_idx") + F.col("base"))


def fasta_lines(rows: DataFrame, name: Column, sequence: Column) -> DataFrame:
    """A text row for each record; write it with .write.text()."""
    return rows.select(F.concat(F.lit(">"), name, F.lit("\n"), sequence).alias("value"))


def write_fasta(rows: DataFrame, path: str, name: Column, sequence: Column) -> None:
    fasta_lines(rows, name, sequence).write.text(path)


def family_files(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FASTA records (file, seq_idx, accession, sequence) to the lines of one .sequences and one .mapping file.

    The family is the file name up to its first dot; dashes go; indexes run over the sorted files; families
    without members are left out.
    """
    numbered = global_index(rows)
    family = F.substring_index(F.substring_index("file", "/", -1), ".", 1)
    members = numbered.select("global_idx", family.alias("family_id"), "accession", F.replace("sequence", F.lit("-"), F.lit("")).alias("sequence"))
    lines = members.select("global_idx", F.concat(F.lit(">"), "accession", F.lit("\n"), "sequence").alias("value"))
    lists = members.groupBy("family_id").agg(F.array_sort(F.collect_list("global_idx")).alias("l"))
    return lines, lists.select("family_id", F.concat(F.lit(">"), "family_id", F.lit("\nall.sequences:"), F.array_join(F.transform("l", lambda i: i.cast("string")), ",")).alias("value"))


def coordinate_text(values: Column, digits: int = 3) -> Column:
    return F.array_join(F.transform(values, lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), ",")


def document_json(members: Column) -> Column:
    return F.to_json(members)


def strict_json(text: Column, fields: list[str]) -> Column:
    """The JSON object's text if it has no other fields than these, else an error."""
    other = F.array_except(F.json_object_keys(text), F.array(*[F.lit(f) for f in fields]))
    return F.when(F.size(other) == 0, text).otherwise(F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(other, ", "))).cast("string"))


def candidates_csv(rows: DataFrame) -> DataFrame:
    """name, sequence, DMS_score of an assay table; the name is the mutant or seq_{row}."""
    have = rows.columns
    if "mutated_sequence" not in have:
        raise ValueError("the candidates need a column mutated_sequence")
    given = F.col("mutant") if "mutant" in have else F.lit(None).cast("string")
    score = F.col("DMS_score").cast("double") if "DMS_score" in have else F.lit(None).cast("double")
    return rows.select(
        F.coalesce(given, F.concat(F.lit("seq_"), F.col("row").cast("string"))).alias("name"), F.col("mutated_sequence").alias("sequence"), score.alias("DMS_score")
    )
