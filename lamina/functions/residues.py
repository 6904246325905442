"""Sequence expressions: pure Column functions on residue strings.

Upper-case letters are match columns, lower-case letters insertions, '-' deletions and '.' insert padding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Residue order of the homology code; anything else is 20.
HOMOLOGY_ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
#: Token order of the vocabulary; specials follow.
TOKEN_ALPHABET = "ARNDCQEGHILKMFPSTWYVXBZJ-arndcqeghilkmfpstwyvx"
PAD, START, END, SEP, UNK, MASK = 46, 47, 48, 49, 50, 51
MSA_DOC, RAW_DOC, RAW_POSITIONS_DOC = 62, 63, 64
IGNORE = -100


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def characters(s: Column) -> Column:
    """The characters of s; none for the empty string."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(empty("string"))


def without_gaps(s: Column) -> Column:
    return F.regexp_replace(s, "[-.]", "")


def without_insertions(s: Column) -> Column:
    return F.regexp_replace(s, "[a-z.]", "")


def upper_aligned(s: Column) -> Column:
    """Upper case, with '.' turned into '-'."""
    return F.upper(F.replace(s, F.lit("."), F.lit("-")))


def parsed(s: Column, keep_gaps: bool, keep_insertions: bool, to_upper: bool) -> Column:
    """The parser's order: gaps, insertions, then upper case."""
    s = s if keep_gaps else without_gaps(s)
    s = s if keep_insertions else without_insertions(s)
    return upper_aligned(s) if to_upper else s


def msa_sequence(s: Column, kind: Column) -> Column:
    """a3m rows lose insertions, gym rows keep them in upper case; other kinds are an error."""
    return (
        F.when(kind == "a3m", parsed(s, True, False, True))
        .when(kind == "gym", parsed(s, True, True, True))
        .otherwise(F.raise_error(F.concat(F.lit("unknown alignment format "), kind)))
    )


def plain_upper(s: Column) -> Column:
    return F.upper(F.translate(s, ".-", ""))


def standard_residues(s: Column) -> Column:
    """U becomes C and O becomes K, which the vocabulary has."""
    return F.translate(s, "UO", "CK")


def match_positions(s: Column, keep_gaps: bool = False, keep_insertions: bool = True, use_msa_pos: bool = True) -> Column:
    """struct(sequence, positions, is_match) of an aligned string.

    '.' is skipped. Upper-case letters and '-' are match states and advance the position; lower-case ones
    keep it (use_msa_pos) or advance it. A '-' that is not kept advances only with use_msa_pos. Positions
    are running counts, computed for each character from the prefix, so that the form stays linear.
    """
    chars = F.filter(characters(s), lambda c: c != ".")
    if not keep_insertions:
        chars = F.filter(chars, lambda c: ~c.rlike("^[a-z]$"))
    if not keep_gaps and not use_msa_pos:
        chars = F.filter(chars, lambda c: c != "-")

    def step(state: Column, c: Column) -> Column:
        moves = F.lit(1) if not use_msa_pos else F.when(c.rlike("^[a-z]$"), 0).otherwise(1)
        at = state["at"] + moves
        shown = F.lit(True) if keep_gaps else c != "-"
        return F.struct(at.alias("at"), F.when(shown, F.concat(state["out"], F.array(F.struct(F.upper(c).alias("c"), at.alias("p"), (~c.rlike("^[a-z]$")).alias("m"))))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<c:string,p:int,m:boolean>>)").alias("out"))
    rows = F.aggregate(chars, start, step, lambda state: state["out"])
    return F.struct(
        F.array_join(F.transform(rows, lambda r: r["c"]), "").alias("sequence"),
        F.transform(rows, lambda r: r["p"]).alias("positions"),
        F.transform(rows, lambda r: r["m"]).alias("is_match"),
    )


def raw_positions(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(empty("int"))


def gap_run_fragments(s: Column, most_gaps: int = 10, least: int = 3) -> Column:
    """Pieces between runs of more than most_gaps dashes, without dashes, upper case, of least residues and more."""
    pieces = F.transform(F.split(s, "-{%d}" % (most_gaps + 1)), lambda x: F.upper(F.replace(x, F.lit("-"), F.lit(""))))
    return F.filter(pieces, lambda x: F.length(x) >= least)


def accession_of(header: Column) -> Column:
    """The first |ACCESSION| of a header, or the whole header."""
    found = F.regexp_extract(header, r"\|([A-Z0-9]+)\|", 1)
    return F.when(found == "", header).otherwise(found)


def family_of(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def hamming(a: Column, b: Column, ignore_gaps: bool = False, include_flanking: bool = False) -> Column:
    """Differing positions of the common prefix length, optionally plus the difference in length."""

    def differs(x: Column, y: Column) -> Column:
        unequal = x != y
        return unequal & (x != "-") & (y != "-") if ignore_gaps else unequal

    both = F.arrays_zip(F.slice(characters(a), 1, F.least(F.length(a), F.length(b))).alias("x"), F.slice(characters(b), 1, F.least(F.length(a), F.length(b))).alias("y"))
    n = F.size(F.filter(both, lambda p: differs(p["x"], p["y"])))
    return n + F.abs(F.length(a) - F.length(b)) if include_flanking else n


def strict_hamming(a: Column, b: Column) -> Column:
    return F.when(F.length(a) == F.length(b), hamming(a, b)).otherwise(F.raise_error(F.lit("sequences differ in length")))


def homology_code(s: Column) -> Column:
    """0 to 19 in alphabetical residue order, 20 for everything else."""
    return F.transform(characters(s), lambda c: F.pmod(F.instr(F.lit(HOMOLOGY_ALPHABET), c) - 1, F.lit(21)))


def alphabet_code(s: Column, alphabet: str, unknown: int) -> Column:
    """Index in the alphabet; other upper-case letters are `unknown`, other characters an error."""
    at = F.instr
    return F.transform(
        characters(s),
        lambda c: F.when(at(F.lit(alphabet), c) > 0, at(F.lit(alphabet), c) - 1)
        .when(c.rlike("^[A-Z]$"), F.lit(unknown))
        .otherwise(F.raise_error(F.concat(F.lit("not in the alphabet: "), c)).cast("int")),
    )


def decoded(ids: Column, alphabet: str) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.substr(F.lit(alphabet), i + 1, F.lit(1))), "")


def token_ids(s: Column, allow_unknown: bool = False) -> Column:
    """Character tokens; a character outside the vocabulary is UNK if allowed, else an error."""
    other = F.lit(UNK) if allow_unknown else F.raise_error(F.lit("character outside the vocabulary")).cast("int")
    place = lambda c: F.instr(F.lit(TOKEN_ALPHABET), c)
    return F.transform(characters(s), lambda c: F.when(place(c) > 0, place(c) - 1).otherwise(other))


def document_ids(members: Column, marker: int = RAW_DOC, allow_unknown: bool = False) -> Column:
    """[start][marker] s1 [SEP] s2 [SEP] ... as ids."""
    body = F.flatten(F.transform(members, lambda s: F.concat(token_ids(s, allow_unknown), F.array(F.lit(SEP)))))
    return F.concat(F.array(F.lit(START), F.lit(marker)), body)


def prompt_ids(context: Column, marker: int = RAW_DOC, allow_unknown: bool = False) -> Column:
    """[start][marker] s1 [SEP] s2 ... without the last separator, which opens the completion; without context [start]."""
    ids = document_ids(context, marker, allow_unknown)
    return F.when(F.size(context) > 0, F.slice(ids, 1, F.size(ids) - 1)).otherwise(F.array(F.lit(START)))


def completion_ids(s: Column, context: Column, marker: int = RAW_DOC, allow_unknown: bool = False) -> Column:
    """[SEP] s [SEP]; without context the document's marker opens the completion."""
    opening = F.when(F.size(context) > 0, F.lit(SEP)).otherwise(F.lit(marker))
    return F.concat(F.array(opening), token_ids(s, allow_unknown), F.array(F.lit(SEP)))


#: Residues that generation never writes, beside lower-case ones.
UNWANTED = "XxBJOUZ"
FIRST_SPECIAL, LAST_SPECIAL = 46, 67


def bad_token_ids(sample_gaps: bool) -> Column:
    """Ids that generation must not choose: specials but the separator, unwanted and lower-case residues, and gaps unless wanted."""
    letters = UNWANTED + "".join(c for c in TOKEN_ALPHABET if c.islower()) + ("" if sample_gaps else "-")
    ids = [TOKEN_ALPHABET.index(c) if c in TOKEN_ALPHABET else UNK for c in letters] + [i for i in range(FIRST_SPECIAL, LAST_SPECIAL + 1) if i != SEP]
    return F.array(*[F.lit(i) for i in sorted(set(ids))])


def document_string(members: Column, start: str = "[start-of-document]", marker: str = "[RAW]") -> Column:
    return F.concat(F.lit(start), F.lit(marker), F.array_join(members, "[SEP]"), F.lit("[SEP]"))


def decoded_members(s: Column) -> Column:
    """Members of a decoded document string: no spaces or pads, split at separators, no markers, no empties."""
    clean = F.replace(F.replace(s, F.lit(" "), F.lit("")), F.lit("[PAD]"), F.lit(""))
    parts = F.transform(F.split(clean, r"\[SEP\]"), lambda x: F.regexp_replace(x, r"\[[A-Za-z-]+\]", ""))
    return F.filter(parts, lambda x: x != "")


def final_separator(members: Column) -> Column:
    """The separator appended to the last member only."""
    return F.transform(members, lambda x, i: F.when(i == F.size(members) - 1, F.concat(x, F.lit("[SEP]"))).otherwise(x))


def padded(lists: Column, separator: float, at_start: int = 0, at_end: int = 0) -> Column:
    """Per-residue lists joined, with a fill between two lists and at start and end slots."""
    fill = lambda n: F.array_repeat(F.lit(separator), n)
    joined = F.flatten(F.transform(lists, lambda x, i: F.when(i > 0, F.concat(fill(1), x)).otherwise(x)))
    return F.concat(fill(at_start), joined, fill(at_end))


def repeat_guard(s: Column, tail: int = 9, times: int = 9) -> Column:
    """Whether the last `tail` characters occur `times` times without overlap in a string that can hold them."""
    hits = (F.length(s) - F.length(F.replace(s, F.right(s, F.lit(tail)), F.lit("")))) / tail
    return (F.length(s) >= tail * times) & (hits >= times)


def confidence_color(plddt: Column) -> Column:
    return F.when(plddt > 90, "blue").when(plddt > 70, "lightblue").when(plddt > 50, "yellow").otherwise("orange")


def remapped_index(i: Column, n: Column) -> Column:
    """Negative indexes count from the end; outside is an error."""
    j = F.when(i < 0, n + i).otherwise(i)
    return F.when((j >= 0) & (j < n), j).otherwise(F.raise_error(F.lit("index out of range")).cast("long"))


def document_marker(keep_gaps: Column, msa_positions: Column) -> Column:
    return F.when(keep_gaps, "[MSA]").when(msa_positions, "[RAW-WITH-MSA-POS]").otherwise("[RAW]")


def sliced(s: Column, start: Column, stop: Column) -> Column:
    """s[start:stop] with zero-based bounds."""
    return F.substr(s, (start + 1).cast("int"), F.greatest(F.lit(0), stop - start).cast("int"))


def crop(s: Column, u_take: Column, u_length: Column, u_start: Column, least: int, most: int, probability: float = 0.5) -> Column:
    """With the probability, a substring of uniform length in [least, most] and uniform start; uniforms are given."""
    top = F.least(F.lit(most), F.length(s))
    size = F.when(F.length(s) <= least, F.length(s)).otherwise(least + F.floor(u_length * (top - least + 1)))
    start = F.floor(u_start * (F.length(s) - size + 1))
    return F.when(u_take < probability, sliced(s, start, start + size)).otherwise(s)


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the md5 of seed and keys; the same in every engine."""
    text = F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
