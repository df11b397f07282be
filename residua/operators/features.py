"""Pairwise-distance features in a long table (structure, pos1, pos2, value, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.operators import alignment as al
from residua.operators.graph import written
from residua.operators.ranges import group_quantiles, quantiles


def residue_pairs(rows: DataFrame, pos: str = "pos", structure: str = "structure") -> DataFrame:
    """All unordered pairs of rows of one structure (pos1 < pos2); hash-partitioned by structure, never across."""
    a, b = rows.alias("a"), rows.alias("b")
    others = [c for c in rows.columns if c not in (pos, structure)]
    both = a.join(b, (F.col(f"a.{structure}") == F.col(f"b.{structure}")) & (F.col(f"a.{pos}") < F.col(f"b.{pos}")))
    side = lambda t, n: [F.col(f"{t}.{pos}").alias(f"pos{n}"), *[F.col(f"{t}.{c}").alias(f"{c}{n}") for c in others]]
    return both.select(F.col(f"a.{structure}").alias(structure), *side("a", 1), *side("b", 2))


def residue_points(atoms: DataFrame, pos: str = "pos") -> DataFrame:
    """Per residue the side-chain heavy atoms' points, or all heavy atoms' where it has none (glycine)."""
    point = F.struct("x", "y", "z")
    heavy = ~F.startswith("atom", F.lit("H"))
    side = heavy & ~F.col("atom").isin("N", "CA", "C", "O")
    rows = atoms.groupBy("structure", pos).agg(F.min("resname").alias("resname"), F.collect_list(F.when(side, point)).alias("side"), F.collect_list(F.when(heavy, point)).alias("all"))
    return rows.select("structure", pos, "resname", F.when(F.size("side") > 0, F.col("side")).otherwise(F.col("all")).alias("points"))


def least_distances(pairs: DataFrame, scale: float = 1.0) -> DataFrame:
    """value: the least distance between the points of two residues, in scaled units."""
    square = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]) + (p["z"] - q["z"]) * (p["z"] - q["z"])
    least = F.array_min(F.flatten(F.transform("points1", lambda p: F.transform("points2", lambda q: square(p, q)))))
    return pairs.withColumn("value", F.sqrt(least) * scale).drop("points1", "points2")


def distance_features(rows: DataFrame, reference: DataFrame, residues: DataFrame, names: DataFrame | None = None, zipped: Callable[[DataFrame, DataFrame], DataFrame] = al.zip_with_reference, scale: float = 1.0) -> DataFrame:
    """The long feature table: every pair of aligned residues of a structure and their least distance.

    rows: name, aligned. residues: structure, index (0-based in the structure), points,
    resname. `zipped` replaces the alignment step by a transform of one's own. All
    exchanges are by structure.
    """
    at = al.residue_index(zipped(rows, reference)).select(F.col("name").alias("structure"), F.col("ref_pos").alias("pos"), "index")
    own = residues.select("structure", "index", "points", "resname").join(at, ["structure", "index"]).drop("index")
    if names is not None:
        own = own.drop("resname").join(F.broadcast(names.select(F.col("ref_pos").alias("pos"), "resname")), "pos", "left").withColumn("resname", F.coalesce("resname", F.concat(F.lit("Res"), F.col("pos"))))
    return least_distances(residue_pairs(own), scale)


def pair_dictionary(long: DataFrame) -> DataFrame:
    """Distinct ordered pairs with their index: one row per feature."""
    pairs = long.select(F.least("pos1", "pos2").alias("pos1"), F.greatest("pos1", "pos2").alias("pos2")).distinct()
    return pairs.withColumn("feature", F.row_number().over(Window.orderBy("pos1", "pos2")) - 1)


def feature_medians(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Exact median per feature over all rows, labelled or not."""
    named = long.select(feature).distinct()
    return named.join(group_quantiles(long, feature, value).withColumnRenamed("quantile", "median"), feature, "left")


def densified(long: DataFrame, structures: DataFrame, features: DataFrame, on: tuple[str, str] = ("structure", "feature")) -> DataFrame:
    """A row for every structure and feature, with value null where there is none.

    features has a row per feature, bounded by the pairs of reference positions.
    """
    grid = structures.select(on[0]).distinct().crossJoin(F.broadcast(features.select(on[1]).distinct()))
    return grid.join(long.select(*on, "value"), list(on), "left")


def imputed(dense: DataFrame, strategy: str = "median", feature: str = "feature") -> DataFrame:
    """dense with missing values filled per feature by median, mean or zero; flag `imputed`."""
    if strategy == "zero":
        stat = dense.select(feature).distinct().withColumn("fill", F.lit(0.0))
    elif strategy == "mean":
        stat = dense.groupBy(feature).agg(F.avg("value").alias("fill"))
    else:
        stat = group_quantiles(dense, feature, "value").withColumnRenamed("quantile", "fill")
    out = dense.join(stat, feature, "left").withColumn("imputed", F.col("value").isNull())
    return out.withColumn("value", F.coalesce("value", "fill")).drop("fill")


def imputation_summary(filled: DataFrame) -> DataFrame:
    return filled.agg(F.count("*").alias("total"), F.count_if(~F.col("imputed")).alias("measured"), F.count_if("imputed").alias("imputed"), (100 * F.avg(F.col("imputed").cast("int"))).alias("imputed_pct"))


def feature_matrix(long: DataFrame, impute: bool = True) -> DataFrame:
    """Labelled structures x all features, missing cells filled from medians over all rows (or left null)."""
    labels = long.where(F.col("label").isNotNull() & (F.col("label") != -1)).select("structure", "label").distinct()
    dense = densified(long, labels, long).join(labels, "structure")
    if not impute:
        return dense.withColumn("imputed", F.lit(False))
    out = dense.join(feature_medians(long), "feature", "left").withColumn("imputed", F.col("value").isNull())
    return out.withColumn("value", F.coalesce("value", "median")).drop("median")


def complete_structures(rows: DataFrame, required: DataFrame, pos: str = "pos") -> DataFrame:
    """Structures that have every required position."""
    need = required.select(pos).distinct()
    held = rows.join(F.broadcast(need), pos, "left_semi").groupBy("structure").agg(F.countDistinct(pos).alias("n"))
    return held.crossJoin(F.broadcast(need.agg(F.count("*").alias("need")))).where("n = need").select("structure")


def symmetric_matrix(long: DataFrame, structures: DataFrame | None = None) -> DataFrame:
    """structure, i, j, value both ways with a zero diagonal."""
    own = long.join(structures, "structure", "left_semi") if structures is not None else long
    there = own.select("structure", F.col("pos1").alias("i"), F.col("pos2").alias("j"), "value")
    back = own.select("structure", F.col("pos2").alias("i"), F.col("pos1").alias("j"), "value")
    diagonal = there.select("structure", "i").union(back.select("structure", "i")).distinct().select("structure", "i", F.col("i").alias("j"), F.lit(0.0).alias("value"))
    return there.unionByName(back).unionByName(diagonal)


def heat_scale(long: DataFrame) -> DataFrame:
    """low, the least value, and high, the 95 % quantile (exact, interpolated)."""
    long = written(long.select("value"))
    (high,) = quantiles(long, "value", [0.95], stored=True)
    return long.agg(F.min("value").alias("low")).withColumn("high", F.lit(high).cast("double"))
