"""Clustering of projected points: Ward, spectral and density, with what is told about their labels."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators.density import density, density_sweep, nearest_core  # noqa: F401
from residua.operators.spectral import spectral  # noqa: F401
from residua.operators.ward import hierarchical  # noqa: F401


def silhouette(rows: DataFrame, labels: DataFrame) -> float | None:
    """Mean silhouette (squared distances), noise counted as a cluster; null for fewer than two clusters."""
    both = rows.join(labels, "id").withColumn("_v", array_to_vector(F.array("z1", "z2")))
    if both.select("cluster").distinct().count() < 2:
        return None
    return ClusteringEvaluator(featuresCol="_v", predictionCol="cluster").evaluate(both)
