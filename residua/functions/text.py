"""Column functions: keys, sequence text, labels, tool reports and nested payloads. All are JVM expressions but for the greedy alignment."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Three-letter and one-letter codes of the standard residues.
RESIDUE_CODES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def normal_accession(c: Column) -> Column:
    """Upper case, without an isoform suffix."""
    return F.upper(F.split_part(c, F.lit("-"), F.lit(1)))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def prefix_key(c: Column, n: int = 6) -> Column:
    return F.substring(c, 1, n)


def leading_code(c: Column) -> Column:
    """The four-character code that a name starts with, upper case; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(c, r"^([0-9][A-Za-z0-9]{3})", 1)), F.lit(""))


def find_text(c: Column, what: str) -> Column:
    """0-based index of the first occurrence, or null."""
    return F.nullif(F.locate(what, c), F.lit(0)) - 1


def has_all(c: Column, motifs: list[str]) -> Column:
    """Does the text hold every motif? False for null."""
    return F.coalesce(reduce(and_, [F.contains(c, F.lit(m)) for m in motifs], F.lit(True)) & c.isNotNull(), F.lit(False))


def residue_label(name: Column, position: Column, index: Column | None = None) -> Column:
    """ALA-123, or with an index ALA123 (0)."""
    return F.concat_ws("-", name, position) if index is None else F.format_string("%s%s (%s)", name, position, index)


def pair_label(p1: Column, p2: Column) -> Column:
    return F.concat_ws("-", p1.cast("string"), p2.cast("string"))


def residue_letters(names: Column) -> Column:
    """One-letter text of an array of three-letter names; unknown ones are X."""
    table = F.create_map(*[F.lit(x) for kv in RESIDUE_CODES.items() for x in kv])
    return F.array_join(F.transform(names, lambda x: F.coalesce(F.try_element_at(table, x), F.lit("X"))), "")


def motif_region(sequence: Column, motifs: list[str]) -> tuple[Column, Column]:
    """From the first found motif's start to the last one's end (exclusive); null if none is found."""
    starts = [find_text(sequence, m) for m in motifs]
    ends = [s + len(m) for s, m in zip(starts, motifs)]
    return (F.least(*starts), F.greatest(*ends)) if len(motifs) > 1 else (starts[0], ends[0])


def motif_validity(reference: Column, other: Column, motifs: list[str]) -> Column:
    """Struct: per motif its index in the reference row and the other row's text there; valid if all are found without a gap."""
    parts, valid = [], F.lit(True)
    for m in motifs:
        at = find_text(reference, m)
        piece = F.substring(other, at + 1, F.lit(len(m)))
        parts += [at.alias(f"{m.lower()}_index"), piece.alias(f"{m.lower()}_text")]
        valid = valid & at.isNotNull() & ~F.contains(F.coalesce(piece, F.lit("-")), F.lit("-"))
    return F.struct(*parts, F.coalesce(valid, F.lit(False)).alias("valid"))


@F.pandas_udf(T.StructType([T.StructField("aligned", T.StringType()), T.StructField("matched", T.IntegerType()), T.StructField("longest_gap", T.IntegerType())]))
def _greedy(declared: pd.Series, observed: pd.Series) -> pd.DataFrame:
    out = []
    for d, o in zip(declared, observed):
        text, at, run, longest = [], 0, 0, 0
        o = o or ""
        for ch in d or "":
            if o[at : at + 1] == ch:
                text.append(ch)
                at, run = at + 1, 0
            else:
                text.append("-")
                run += 1
                longest = max(longest, run)
        out.append(("".join(text), at, longest))
    return pd.DataFrame(out, columns=["aligned", "matched", "longest_gap"])


def greedy_alignment(declared: Column, observed: Column) -> Column:
    """Declared letters against observed ones: advance on a match, else a gap. Struct of text, matched, longest gap.

    One pass over the letters: as a fold in Spark's expressions each step would copy the text so far.
    """
    return F.when(declared.isNotNull(), _greedy(declared, observed))


def natural_residues(declared: Column, aligned: Column) -> Column:
    """X becomes G unless the aligned text has a gap beside it; B, Z, J become N, Q, L."""
    letters = F.filter(F.split(declared, ""), lambda x: x != "")
    gap = lambda i: F.coalesce(F.substring(aligned, i, F.lit(1)) == "-", F.lit(False))
    near = lambda i: ((i > 0) & gap(F.greatest(i, F.lit(1)))) | gap(i + 2)
    swap = lambda x, i: F.when((x == "X") & ~near(i), "G").when(x == "B", "N").when(x == "Z", "Q").when(x == "J", "L").otherwise(x)
    return F.array_join(F.transform(letters, swap), "")


def triage(declared: Column, observed: Column, limit: int, motifs: tuple[str, str] = ("DFG", "APE")) -> Column:
    """Struct: decision (copy, needs_rebuild or reject), reason, longest_gap, and both segments.

    The segments run over both motifs, which both sequences must hold. The declared one is
    aligned greedily with the observed one; a gap over the limit rejects. If the declared
    segment with natural residues equals the observed letters, nothing is to be rebuilt.
    """
    d0, d1 = motif_region(declared, list(motifs))
    o0, o1 = motif_region(observed, list(motifs))
    cut = lambda c, a, b: F.substring(c, a + 1, b - a)
    d, o = cut(declared, d0, d1), cut(observed, o0, o1)
    whole = has_all(declared, list(motifs)) & has_all(observed, list(motifs))
    judged = F.transform(F.array(greedy_alignment(d, o)), lambda x: F.struct(x["aligned"].alias("aligned"), x["longest_gap"].alias("longest_gap"), (natural_residues(d, x["aligned"]) == F.replace(x["aligned"], F.lit("-"), F.lit(""))).alias("same")))[0]
    reason = F.when(declared.isNull() | observed.isNull(), "no sequence").when(~whole, "motif missing").when(judged["longest_gap"] > limit, "gap too long")
    decision = F.when(reason.isNotNull(), "reject").when(judged["same"], "copy").otherwise("needs_rebuild")
    return F.struct(decision.alias("decision"), reason.alias("reason"), judged["longest_gap"].alias("longest_gap"), d.alias("declared"), o.alias("observed"))


def first_match(c: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


#: Where annotations name a family, in order.
FAMILY_PATTERNS = [r"Belongs to the ([^.]+?) family", r"member of the ([^.]+?) family", r"([A-Z][A-Za-z0-9]+) family"]


def family(c: Column) -> Column:
    return first_match(c, FAMILY_PATTERNS)


#: Which group a keyword stands for; the first that occurs wins.
KEYWORD_GROUPS = (("serine/threonine", "STE"), ("tyrosine", "TK"))


def keyword_group(keywords: Column) -> Column:
    """Group of the first keyword that stands for one, or null."""

    def of(k: Column) -> Column:
        out = F.lit(None).cast("string")
        for text, group in reversed(KEYWORD_GROUPS):
            out = F.when(F.contains(F.lower(k), F.lit(text)), group).otherwise(out)
        return out

    return F.get(F.filter(F.transform(keywords, of), lambda x: x.isNotNull()), F.lit(0))


#: How reports write a dihedral state, and the column that names it.
STATE_PATTERN = r"(?i)\b(BL[AB][mp][il][nu][us]s?|BB[AB][mp][il][nu][us]s?|AB[AB][mp][il][nu][us]s?)\b"
STATE_COLUMN = r"Dihedral_label\s+(\S+)"


def dihedral_state(report: Column) -> Column:
    """The dihedral state that a report names, in its spelling; else the word after the column's name; else unknown."""
    none = report.isNull() | F.contains(report, F.lit("not a protein kinase"))
    return F.when(none, "unknown").otherwise(F.coalesce(first_match(report, [STATE_PATTERN, STATE_COLUMN]), F.lit("unknown")))


def activation(description: Column, mode: str = "three") -> Column:
    """Activation label of a conformation text.

    three: Active, Inactive, else Unknown. four: also Other, for known text that says
    neither. binary: 1 where it says Active, else 0 (null too). The word Active is
    matched in that spelling.
    """
    active, inactive = F.contains(description, F.lit("Active")), F.contains(F.lower(description), F.lit("inactive"))
    if mode == "binary":
        return F.coalesce(active.cast("int"), F.lit(0))
    unknown = description.isNull() | (F.lower(description) == "unknown")
    return F.when(unknown, "Unknown").when(active, "Active").when(inactive, "Inactive").otherwise("Other" if mode == "four" else "Unknown")


#: Descriptions of composed report states.
CONFORMATIONS = {
    "DFGin_Chelix_in": "Active conformation (Type I)",
    "DFGin_Chelix_out": "Inactive conformation (Type I/Type II-like)",
    "DFGout_Chelix_in": "DFG-out conformation (Type II)",
    "DFGout_Chelix_out": "DFG-out inactive conformation",
}


def parse_report(raw: Column) -> Column:
    """Struct of dfg, chelix, overall, description, ligand and ligand_label from a tool's report.

    A line that mentions a part decides its state: "out" before "in", each anywhere in the
    lower-cased line; the last such line wins. Ligands stand below the headers that name
    them, in the same column of words.
    """
    lines = F.split(F.trim(raw), "\n")

    def state(*parts: str) -> Column:
        about = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in parts])
        hits = F.filter(F.transform(lines, F.lower), lambda x: about(x) & (F.contains(x, F.lit("out")) | F.contains(x, F.lit("in"))))
        last = F.get(hits, F.size(hits) - 1)
        return F.when(F.coalesce(F.size(hits), F.lit(0)) < 1, "unknown").when(F.contains(last, F.lit("out")), "out").otherwise("in")

    dfg, chelix = state("dfg"), state("chelix", "c-helix", "regulatory spine")
    known = (dfg != "unknown") & (chelix != "unknown")
    overall = F.when(known, F.concat(F.lit("DFG"), dfg, F.lit("_Chelix_"), chelix)).otherwise("unknown")
    table = F.create_map(*[F.lit(x) for kv in CONFORMATIONS.items() for x in kv])
    is_header = lambda x: F.contains(x, F.lit("Ligand")) & F.contains(x, F.lit("Ligand_label"))
    rows = F.transform(lines, lambda x, i: F.struct(x.alias("header"), F.get(lines, i + 1).alias("data")))
    tables = F.filter(rows, lambda r: is_header(r["header"]) & r["data"].isNotNull())
    last = F.get(tables, F.size(tables) - 1)
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")

    def cell(name: str) -> Column:
        at = F.array_position(words(last["header"]), name)
        return F.coalesce(F.when(at > 0, F.get(words(last["data"]), (at - 1).cast("int"))), F.lit("unknown"))

    return F.struct(
        dfg.alias("dfg_conformation"), chelix.alias("chelix_conformation"), overall.alias("overall_conformation"),
        F.coalesce(F.try_element_at(table, overall), F.lit("unknown")).alias("conformation_description"),
        cell("Ligand").alias("ligand"), cell("Ligand_label").alias("ligand_label"),
    )


def gene_name(genes: Column) -> Column:
    """First primary name, else the first synonym, of an array of genes."""
    primary = F.filter(F.transform(genes, lambda g: g["geneName"]["value"]), lambda x: x.isNotNull())
    synonym = F.filter(F.flatten(F.transform(genes, lambda g: F.coalesce(g["synonyms"], F.array().cast("array<struct<value: string>>")))), lambda s: s["value"].isNotNull())
    return F.coalesce(F.get(primary, F.lit(0)), F.get(synonym, F.lit(0))["value"])


def first_mention(texts: Column, *keywords: str) -> Column:
    """The first text that mentions any keyword, whatever the case."""
    hit = lambda t: reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(k.lower())) for k in keywords])
    return F.get(F.filter(texts, lambda t: F.coalesce(hit(t), F.lit(False))), F.lit(0))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two structs with x, y, z."""
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) + F.pow(a["z"] - b["z"], 2))
