"""Spectral clustering with a Gaussian affinity, by landmarks: no affinities are listed.

The affinity of two points is approximated through landmarks at the centres of occupied
cells and of the cells around them (Nystroem). What the landmarks miss of a point, its
residual 1 - |features|^2, is computed for every point, and the error of any affinity is at
most the root of the product of its points' residuals, so the largest residual bounds all
errors. Degrees, and the leading vectors of the normalised affinities, then come from one
small matrix that is summed over the points.

Workers take the points a slice at a time, so what they hold is bounded by the landmarks,
whatever the size of the batches that Spark hands them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.operators.graph import written

#: Most landmarks; a wider plane gets a coarser grid (and a larger bound).
MOST = 1024
#: Parts in which the partitions' sums are added up before the last sum.
PARTS = 32
#: Points whose affinities with the landmarks a worker holds at once.
SLICE = 512


@dataclass
class Spectrum:
    """rows: id and vector (the leading vectors at the point, over the root of its degree). error: largest error of an affinity."""

    rows: DataFrame
    values: np.ndarray
    landmarks: int
    error: float


def _landmarks(rows: DataFrame, gamma: float, side: float, around: int) -> tuple[np.ndarray, float]:
    """Centres of occupied cells and of those around them, and the cells' side."""
    side /= gamma**0.5
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-around, around + 1) for j in range(-around, around + 1)]))
    while True:
        cell = rows.select(F.floor(F.col("z1") / side).alias("x"), F.floor(F.col("z2") / side).alias("y")).distinct()
        all_ = cell.select("x", "y", offsets.alias("o")).select((F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y")).distinct()
        found = all_.limit(MOST + 1).collect()
        if len(found) <= MOST:
            return (np.array(sorted((r.x, r.y) for r in found), float).reshape(-1, 2) + 0.5) * side, side
        side *= 1.5


def _slices(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """Ids and places of at most SLICE points at a time."""
    for pdf in frames:
        for i in range(0, len(pdf), SLICE):
            some = pdf.iloc[i : i + SLICE]
            yield some.id, some[["z1", "z2"]].to_numpy(float)


def _near(x: np.ndarray, marks: np.ndarray, gamma: float) -> np.ndarray:
    """Affinities of places and landmarks."""
    out, other = (np.subtract.outer(x[:, i], marks[:, i]) for i in (0, 1))
    out *= out
    other *= other
    out += other
    out *= -gamma
    return np.exp(out, out=out)


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """Sum over all slices of part(places), a matrix of `size` rows; added up row by row, in two steps."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for _, x in _slices(frames):
            m = part(x)
            total = m if total is None else np.add(total, m, out=total)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf.i.iloc[:1], "v": [np.sum(np.stack(pdf.v.to_list()), axis=0)]})

    parts = written(rows.mapInPandas(partial, "i int, v array<double>").withColumn("p", F.spark_partition_id() % PARTS))
    some = parts.groupBy("i", "p").applyInPandas(add, "i int, v array<double>")
    out = some.groupBy("i").applyInPandas(add, "i int, v array<double>").collect()  # a row per feature
    if not out:
        return np.zeros((size, 0))
    return np.array([r.v for r in sorted(out, key=lambda r: r.i)])


def spectrum(rows: DataFrame, k: int, gamma: float = 1.0, side: float = 0.5, around: int = 2) -> Spectrum:
    """The k leading vectors of the normalised affinities of rows (id, z1, z2); each point's affinity with itself counts."""
    points = written(rows.where("z1 is not null and z2 is not null and not isnan(z1) and not isnan(z2)").select("id", "z1", "z2"))
    marks, side = _landmarks(points, gamma, side, around)
    if not len(marks):
        return Spectrum(points.select("id").withColumn("vector", F.array().cast("array<double>")), np.zeros(0), 0, 0.0)
    values, vectors = np.linalg.eigh(_near(marks, marks, gamma))
    use = values > 1e-11 * values[-1]
    root = vectors[:, use] / np.sqrt(values[use])
    size = int(use.sum())
    features = lambda x: _near(x, marks, gamma) @ root

    def degrees(x: np.ndarray) -> np.ndarray:
        return features(x).sum(axis=0)[:, None]

    total = _summed(points, degrees, size)[:, 0]

    def gram(x: np.ndarray) -> np.ndarray:
        f = features(x)
        return f.T @ (f / (f @ total)[:, None])

    g = _summed(points, gram, size)
    values_, leading = np.linalg.eigh((g + g.T) / 2)
    order = np.argsort(-values_)[:k]
    values_, leading = values_[order], leading[:, order]
    leading = leading * np.sign(leading[np.abs(leading).argmax(axis=0), np.arange(leading.shape[1])])

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for id_, x in _slices(frames):
            f = features(x)
            v = (f @ leading) / np.sqrt(np.maximum(values_, 1e-300)) / (f @ total)[:, None]
            yield pd.DataFrame({"id": id_, "vector": list(v), "gap": np.clip(1 - np.square(f).sum(axis=1), 0, None)})

    out = written(points.mapInPandas(project, f"{points.select('id').schema.simpleString()[7:-1].replace(':', ' ')}, vector array<double>, gap double"))
    gap = out.agg(F.max("gap")).first()[0] or 0.0
    return Spectrum(out.select("id", "vector"), values_, len(marks), float(gap))


def spectral(rows: DataFrame, k: int = 2, gamma: float = 1.0, seed: int = 1) -> DataFrame:
    """id, cluster: k-means over the k leading vectors; clusters are numbered by their smallest id, points without a place are -1."""
    found = spectrum(rows, k, gamma)
    lost = rows.where("z1 is null or z2 is null or isnan(z1) or isnan(z2)").select("id", F.lit(-1).alias("cluster"))
    if not len(found.values):
        return lost
    # Vectors have a length of one over all points: scaled by their spread they suit k-means' tolerance.
    n = max(len(found.values), 1)
    spread = found.rows.agg(*[F.max(F.abs(F.get("vector", F.lit(i)))).alias(str(i)) for i in range(n)]).first()
    largest = max((x for x in spread if x), default=1.0)
    rows_ = found.rows.select("id", array_to_vector(F.transform("vector", lambda x: x / largest)).alias("v"))
    told = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="c", maxIter=100, tol=1e-8).fit(rows_).transform(rows_).select("id", "c")
    number = told.groupBy("c").agg(F.min("id").alias("first")).withColumn("cluster", F.row_number().over(Window.orderBy("first")) - 1)  # a row per cluster
    return told.join(F.broadcast(number), "c").select("id", "cluster").unionByName(lost)
