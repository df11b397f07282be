"""Principal components of resampled paths, their profiles, and the linear encode-decode error."""

from __future__ import annotations

from pyspark.ml.feature import PCA, PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def principal_components(rows: DataFrame, k: int = 8, coords: str = "coords") -> tuple[PCAModel, DataFrame]:
    """The fitted model, and rows with `pc` (array of k). The data are centred, not scaled."""
    vectors = rows.withColumn("_v", array_to_vector(F.col(coords)))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    return model, model.transform(centred).withColumn("pc", vector_to_array("_p")).drop("_v", "_p").withColumnRenamed("_c", "centred")


def explained_percent(model: PCAModel, rows: DataFrame) -> DataFrame:
    """pc (from 1) and its percentage of the variance."""
    ratios = [float(x) for x in model.explainedVariance.toArray()]
    return rows.sparkSession.createDataFrame([(i + 1, 100 * x) for i, x in enumerate(ratios)], "pc int, percent double")


def loadings(model: PCAModel, rows: DataFrame) -> DataFrame:
    """dimension, pc, loading: one row per entry of the model's matrix."""
    m = model.pc.toArray()
    return rows.sparkSession.createDataFrame([(i, j + 1, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "dimension int, pc int, loading double")


def loading_profile(model: PCAModel, rows: DataFrame) -> DataFrame:
    """pc, point, score: length of the loading's three coordinates of a point times the component's variance."""
    spread = rows.select(F.posexplode("pc").alias("i", "v")).groupBy("i").agg(F.var_samp("v").alias("variance"))
    parts = loadings(model, rows).groupBy("pc", F.floor(F.col("dimension") / 3).cast("int").alias("point")).agg(F.sqrt(F.sum(F.col("loading") * F.col("loading"))).alias("size"))
    return parts.join(F.broadcast(spread), F.col("pc") == F.col("i") + 1).select("pc", "point", (F.col("size") * F.col("variance")).alias("score"))


def component_values(rows: DataFrame, i: int) -> DataFrame:
    return rows.select("structure", F.get("pc", F.lit(i - 1)).alias("value"))


def reconstruction_errors(model: PCAModel, rows: DataFrame) -> DataFrame:
    """structure, the first two components, and the root mean square distance per point of the decoded from the given path."""
    m = model.pc.toArray()
    back = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m])
    decoded = F.transform(back, lambda w: F.aggregate(F.zip_with(w, F.col("pc"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    gap = F.zip_with(decoded, vector_to_array("centred"), lambda a, b: (a - b) * (a - b))
    error = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.lit(m.shape[0] / 3))
    return rows.select("structure", F.get("pc", F.lit(0)).alias("z1"), F.get("pc", F.lit(1)).alias("z2"), error.alias("rmsd"))


def error_landscape(errors: DataFrame, cells: int = 30) -> DataFrame:
    """gx, gy, n, mean and largest rmsd on a cells x cells grid over the latent plane; empty cells have n = 0."""
    box = errors.agg(*[f(c).alias(f"{n}_{c}") for c in ("z1", "z2") for n, f in (("low", F.min), ("high", F.max))])

    def cell(c: str):
        width = (F.col(f"high_{c}") - F.col(f"low_{c}")) / cells
        return F.when(width > 0, F.least(F.floor((F.col(c) - F.col(f"low_{c}")) / width), F.lit(cells - 1))).otherwise(0).cast("int")

    found = errors.crossJoin(F.broadcast(box)).groupBy(cell("z1").alias("gx"), cell("z2").alias("gy")).agg(F.count("*").alias("n"), F.avg("rmsd").alias("mean_rmsd"), F.max("rmsd").alias("max_rmsd"))
    axis = errors.sparkSession.range(cells)
    grid = axis.select(F.col("id").cast("int").alias("gx")).crossJoin(axis.select(F.col("id").cast("int").alias("gy")))
    return grid.join(found, ["gx", "gy"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
