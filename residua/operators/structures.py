"""Atom tables: chains, residues, sequences, peptide fragments and loop cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.functions import text as tx
from residua.operators.graph import written


def requested_chains(atoms: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Protein atoms of each requested (accession, chain), named accession_chain; and the requests without any."""
    asked = manifest.select("accession", F.explode("chains").alias("chain"))
    protein = atoms.where(F.col("resname").isin(list(tx.RESIDUE_CODES))).withColumn("accession", F.upper("structure"))
    found = protein.join(asked, ["accession", "chain"]).withColumn("structure", F.concat_ws("_", "accession", "chain"))
    none = asked.join(protein.select("accession", "chain").distinct(), ["accession", "chain"], "left_anti")
    return found.drop("accession"), none


def requested_counts(atoms: DataFrame, manifest: DataFrame) -> DataFrame:
    """accession, chain, n_atoms of each request: the rows of requested_chains (0: none), counted before they are joined."""
    protein = atoms.where(F.col("resname").isin(list(tx.RESIDUE_CODES)))
    counts = protein.groupBy("structure", "chain").agg(F.count("*").alias("n")).groupBy(F.upper("structure").alias("accession"), "chain").agg(F.sum("n").alias("n"))
    asked = manifest.select("accession", F.explode("chains").alias("chain"))
    return asked.join(counts, ["accession", "chain"], "left").select("accession", "chain", F.coalesce("n", F.lit(0)).alias("n_atoms"))


def select_atoms(atoms: DataFrame, *names: str) -> DataFrame:
    return atoms.where(F.col("atom").isin(list(names)))


def residues(atoms: DataFrame) -> DataFrame:
    """One row per residue in order of its first atom: pos from 0, letter, and its N and C atoms."""
    point = lambda a: F.max(F.when(F.col("atom") == a, F.struct("x", "y", "z")))
    rows = atoms.groupBy("structure", "chain", "resseq", "icode").agg(F.min("atom_ord").alias("first"), F.min("resname").alias("resname"), point("N").alias("n"), point("C").alias("c"))
    letter = tx.residue_letters(F.array("resname"))
    order = Window.partitionBy("structure", "chain").orderBy("first")
    return rows.withColumns({"letter": letter, "pos": F.row_number().over(order) - 1})


def peptide_fragments(rows: DataFrame, longest_bond: float = 1.8) -> DataFrame:
    """residues with `fragment`, cut where a C-N distance is over the bond's length (or unknown); single residues go."""
    order = Window.partitionBy("structure", "chain").orderBy("first")
    bond = tx.distance(F.lag("c").over(order), F.col("n"))
    cut = rows.withColumn("cut", F.when(bond <= longest_bond, 0).otherwise(1))
    marked = cut.withColumn("fragment", F.sum("cut").over(order)).drop("cut")
    size = F.count("*").over(Window.partitionBy("structure", "chain", "fragment"))
    kept = marked.withColumn("_size", size).where("_size > 1").drop("_size")
    return kept.withColumn("pos", F.row_number().over(order) - 1)


def sequences(rows: DataFrame) -> DataFrame:
    """structure, seq and resnums in order."""
    ordered = F.sort_array(F.collect_list(F.struct("chain", "first", "letter", "resseq")))
    out = rows.groupBy("structure").agg(ordered.alias("r"))
    return out.select("structure", F.array_join(F.transform("r", lambda x: x["letter"]), "").alias("seq"), F.transform("r", lambda x: x["resseq"]).alias("resnums"))


def _motif_ends(seqs: DataFrame, motifs: list[str]) -> DataFrame:
    start, end = tx.motif_region(F.col("seq"), motifs)
    rows = seqs.withColumns({"_a": start, "_b": end})
    return rows.select("structure", F.element_at("resnums", F.col("_a") + 1).alias("low"), F.element_at("resnums", F.col("_b")).alias("high"), F.col("_a").isNotNull().alias("found"))


def motif_bounds(seqs: DataFrame, motifs: list[str]) -> DataFrame:
    """first and last residue number of the region that the found motifs span (one is enough); none: no row."""
    return _motif_ends(seqs, motifs).where("found").drop("found")


def slice_residues(atoms: DataFrame, bounds: DataFrame) -> DataFrame:
    """Atoms whose residue number is in its structure's bounds, ends included."""
    return atoms.join(bounds, "structure").where(F.col("resseq").between(F.col("low"), F.col("high"))).drop("low", "high")


def loops(atoms: DataFrame, motifs: list[str], names: tuple[str, ...] = ("CA",)) -> tuple[DataFrame, DataFrame]:
    """Named atoms of each structure's motif region, and the structures without a motif."""
    ends = written(_motif_ends(sequences(residues(atoms)), motifs))  # a row per structure
    bounds = ends.where("found").drop("found")
    return select_atoms(slice_residues(atoms, bounds), *names), ends.where("not found").select("structure")
