"""Alignments column by column: reference positions, conservation, residue indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reference_row(rows: DataFrame, name: str) -> DataFrame:
    """The first record whose name holds the text, else the first record: one row (name, aligned)."""
    order = F.struct(F.when(F.contains("name", F.lit(name)), 0).otherwise(1), "ord")
    return rows.agg(F.min_by(F.struct("name", "aligned"), order).alias("r")).where("r is not null").select("r.*")


def _letters(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(F.filter(F.split("aligned", ""), lambda x: x != "")).alias("col", "ch"))


def reference_columns(reference: DataFrame) -> DataFrame:
    """col, ref_ch and ref_pos of the reference's columns that are no gap; bounded by the alignment's length."""
    letters = _letters(reference).where("ch != '-'")
    return letters.select("col", F.col("ch").alias("ref_ch"), (F.row_number().over(Window.orderBy("col")) - 1).alias("ref_pos"))


def zip_with_reference(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """name, ref_pos, ref_ch, ch: every row against the reference, without the reference's gap columns."""
    return _letters(rows, "name").join(F.broadcast(reference_columns(reference)), "col").select("name", "ref_pos", "ref_ch", "ch")


def conservation(zipped: DataFrame) -> DataFrame:
    """Share of rows that are no gap, per reference position."""
    return zipped.groupBy("ref_pos").agg(F.avg((F.col("ch") != "-").cast("int")).alias("conservation"))


def conserved_outside(conserved: DataFrame, low: int, high: int, least: float) -> DataFrame:
    """Positions outside [low, high] whose conservation reaches `least`."""
    return conserved.where(((F.col("ref_pos") < low) | (F.col("ref_pos") > high)) & (F.col("conservation") >= least))


def conserved_report(conserved: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """ref_pos, conservation, resname (N/A without one)."""
    kept = conserved.where(F.col("conservation") >= least)
    return kept.join(F.broadcast(names.select("ref_pos", "resname")), "ref_pos", "left").withColumn("resname", F.coalesce("resname", F.lit("N/A")))


def residue_index(zipped: DataFrame) -> DataFrame:
    """zipped without gaps, with `index`: how many kept columns before it are no gap in its own row.

    Residues inserted relative to the reference are not counted.
    """
    before = Window.partitionBy("name").orderBy("ref_pos").rowsBetween(Window.unboundedPreceding, -1)
    counted = zipped.withColumn("index", F.coalesce(F.sum((F.col("ch") != "-").cast("int")).over(before), F.lit(0)))
    return counted.where("ch != '-'")


def alignment_summary(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Number of records, alignment length, reference name."""
    out = rows.agg(F.count("*").alias("n_records"), F.max(F.length("aligned")).alias("length"))
    return out.crossJoin(F.broadcast(reference.select(F.col("name").alias("reference"))))


def ungapped_lengths(rows: DataFrame) -> DataFrame:
    return rows.select("name", F.length(F.replace("aligned", F.lit("-"), F.lit(""))).alias("n_residues"))


def longest_gap(rows: DataFrame) -> DataFrame:
    """Longest run of gaps per row, by islands of consecutive columns."""
    gaps = _letters(rows, "name").where("ch = '-'")
    island = F.col("col") - F.row_number().over(Window.partitionBy("name").orderBy("col"))
    runs = gaps.withColumn("island", island).groupBy("name", "island").agg(F.count("*").alias("n"))
    longest = runs.groupBy("name").agg(F.max("n").alias("longest_gap"))
    return rows.select("name").join(longest, "name", "left").select("name", F.coalesce("longest_gap", F.lit(0)).alias("longest_gap"))
