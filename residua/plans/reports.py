"""End-to-end compositions: from resampled paths to clusters, labels and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import cluster, labels, reduce, report


def reduction_report(rows: DataFrame, components: int = 8, clusters: int = 2, gamma: float = 1.0) -> dict[str, DataFrame]:
    """rows: structure, coords. Explained variance, profiles, the first two components, both clusterings and their sizes."""
    model, projected = reduce.principal_components(rows, components)
    plane = projected.select("structure", F.get("pc", F.lit(0)).alias("z1"), F.get("pc", F.lit(1)).alias("z2"))
    ward = cluster.hierarchical(plane, clusters)
    numbered = plane.withColumn("id", F.xxhash64("structure"))
    spectral = numbered.join(cluster.spectral(numbered, clusters, gamma), "id").select("structure", "z1", "z2", "cluster")
    sizes = lambda name, df: report.value_counts(df, "cluster").select(F.lit(name).alias("method"), F.col("value").alias("cluster"), "n", "share")
    return {
        "explained": reduce.explained_percent(model, rows), "profile": reduce.loading_profile(model, projected), "plane": plane,
        "ward": ward, "spectral": spectral, "sizes": sizes("ward", ward).unionByName(sizes("spectral", spectral)),
    }


def label_integration(clusters: DataFrame, assignments: DataFrame, prefix: int = 6, threshold: float = 10.0) -> dict[str, DataFrame]:
    """clusters (structure, cluster) with assignments (pdb_code, ...): merged rows, cross-tabulation, percentages, enrichment of active ones."""
    merged = labels.annotate_assignments(labels.join_by_prefix(clusters, assignments, "structure", "pdb_code", prefix))
    known = merged.where(F.col("activation").isin("Active", "Inactive"))
    return {
        "merged": merged, "crosstab": report.crosstab(merged, "cluster", "activation"), "percentages": report.percentages(known, "cluster", "activation"),
        "enrichment": report.enrichment(known, "cluster", F.col("activation") == "Active", threshold),
    }
