"""Quartile fences, terminal distances and two-stage curation of structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions.text import distance
from residua.operators.graph import written
from residua.operators.ranges import quantiles


def tukey_fences(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """rows with q1, q3, iqr, lower, upper and outlier (strictly outside); quartiles are exact, interpolated."""
    q1, q3 = quantiles(df, value, [0.25, 0.75])
    iqr = None if q1 is None else q3 - q1
    ends = {"q1": q1, "q3": q3, "iqr": iqr, "lower": iqr if iqr is None else q1 - k * iqr, "upper": iqr if iqr is None else q3 + k * iqr}
    rows = df.withColumns({c: F.lit(v).cast("double") for c, v in ends.items()})
    return rows.withColumn("outlier", (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))


def atom_counts(atoms: DataFrame, atom: str = "CA") -> DataFrame:
    return atoms.where(F.col("atom") == atom).groupBy("structure").agg(F.count("*").alias("n_atoms"))


def count_summary(counts: DataFrame, value: str = "n_atoms") -> DataFrame:
    (median,) = quantiles(counts, value, [0.5])
    return counts.agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")).withColumn("median", F.lit(median).cast("double"))


def end_points(points: DataFrame, ord_: str = "ord") -> DataFrame:
    """first and last point (struct of x, y, z) of each structure, by order."""
    xyz = F.struct("x", "y", "z")
    return points.groupBy("structure").agg(F.min_by(xyz, ord_).alias("first"), F.max_by(xyz, ord_).alias("last"))


def kth_point(points: DataFrame, structure: str, k: int, ord_: str = "ord") -> DataFrame:
    """x, y, z of the 0-based k-th point of one structure (the anchors are parameters; nothing is corrected)."""
    own = points.where(F.col("structure") == structure).orderBy(ord_).limit(k + 1)
    return own.orderBy(F.desc(ord_)).limit(1).select("x", "y", "z")


def terminal_distances(points: DataFrame, first_anchor: DataFrame, last_anchor: DataFrame) -> DataFrame:
    """Distance of each structure's first and last point from two one-row anchors, and the larger one."""
    ref = first_anchor.select(F.struct("x", "y", "z").alias("a")).crossJoin(last_anchor.select(F.struct("x", "y", "z").alias("b")))
    rows = end_points(points).crossJoin(F.broadcast(ref))
    out = rows.select("structure", distance(F.col("first"), F.col("a")).alias("first_distance"), distance(F.col("last"), F.col("b")).alias("last_distance"))
    return out.withColumn("max_distance", F.greatest("first_distance", "last_distance"))


def within_distance(distances: DataFrame, cutoff: float = 3.0) -> DataFrame:
    """Both distances at most the cutoff; rows with a missing one are in neither set."""
    return distances.where((F.col("first_distance") <= cutoff) & (F.col("last_distance") <= cutoff))


def distance_outliers(distances: DataFrame, cutoff: float = 3.0) -> DataFrame:
    """Either distance over the cutoff, farthest first."""
    far = distances.where((F.col("first_distance") > cutoff) | (F.col("last_distance") > cutoff))
    return far.orderBy(F.desc("max_distance"), "structure")


def distance_summary(distances: DataFrame) -> DataFrame:
    columns = ("first_distance", "last_distance")
    distances = written(distances.select(*columns))
    medians = {f"median_{c}": F.lit(quantiles(distances, c, [0.5], stored=True)[0]).cast("double") for c in columns}
    out = distances.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns]).withColumns(medians)
    return out.select(*[f"{n}_{c}" for c in columns for n in ("mean", "median")])


def curate(points: DataFrame, first_anchor: DataFrame, last_anchor: DataFrame, k: float = 1.5, cutoff: float = 3.0) -> DataFrame:
    """A row per structure: n_points, the fences' verdict, the distances, and the set it ends in.

    Sets: count_outlier, distance_outlier, unknown (no distance), final.
    """
    counts = points.groupBy("structure").agg(F.count("*").alias("n_points"))
    judged = tukey_fences(counts, "n_points", k).select("structure", "n_points", "outlier")
    rows = judged.join(terminal_distances(points, first_anchor, last_anchor), "structure", "left")
    near = (F.col("first_distance") <= cutoff) & (F.col("last_distance") <= cutoff)
    verdict = F.when(F.col("outlier"), "count_outlier").when(near.isNull(), "unknown").when(near, "final").otherwise("distance_outlier")
    return rows.withColumn("verdict", verdict)
