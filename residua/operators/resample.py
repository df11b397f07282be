"""Paths resampled to a fixed number of points: a NumPy kernel over batches of structures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a resampled path, and steps of its grid per unit of index.
POINTS, GRID = 27, 0.1


def cubic_through(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at x of the cubic splines through (0, y0), (1, y1), ...; the third derivative is continuous next to the ends.

    y: paths of equal length (at least four points) x points x dimensions. The system for the
    second derivatives is tridiagonal but for its ends, where the second derivative is
    linear over the first (last) three points; eliminating these leaves a tridiagonal
    system, solved for all paths at once in a number of steps that is linear in the points.
    """
    paths, n, _ = y.shape
    rhs = 6 * (y[:, :-2] - 2 * y[:, 1:-1] + y[:, 2:])  # of the inner points
    bend = np.empty_like(y, dtype=float)
    # Row i of the inner points is (1, 4, 1); with bend[0] = 2 bend[1] - bend[2] the first becomes (6, 0), the last (0, 6).
    low, mid, high = np.ones(n - 2), np.full(n - 2, 4.0), np.ones(n - 2)
    mid[0] = mid[-1] = 6.0
    high[0] = low[-1] = 0.0
    d = rhs.astype(float).copy()
    c = np.empty(n - 2)
    c[0] = high[0] / mid[0]
    d[:, 0] /= mid[0]
    for i in range(1, n - 2):
        w = mid[i] - low[i] * c[i - 1]
        c[i] = high[i] / w
        d[:, i] = (d[:, i] - low[i] * d[:, i - 1]) / w
    for i in range(n - 4, -1, -1):
        d[:, i] -= c[i] * d[:, i + 1]
    bend[:, 1:-1] = d
    bend[:, 0] = 2 * bend[:, 1] - bend[:, 2]
    bend[:, -1] = 2 * bend[:, -2] - bend[:, -3]
    i = np.clip(np.floor(x).astype(int), 0, n - 2)
    t = (x - i)[None, :, None]
    slope = y[:, i + 1] - y[:, i] - (2 * bend[:, i] + bend[:, i + 1]) / 6
    return y[:, i] + t * (slope + t * (bend[:, i] / 2 + t * (bend[:, i + 1] - bend[:, i]) / 6))


def evenly_spaced(y: np.ndarray, points: int = POINTS, step: float = GRID) -> np.ndarray:
    """Points of each spline at the grid places nearest to equal shares of its length.

    y: paths x points x dimensions. The grid ends one step before the last point and the
    table of lengths one step earlier, so the last point taken lies short of the path's
    end; the first of equally near places wins.
    """
    x = np.arange(0, y.shape[1] - 1, step)
    path = cubic_through(y, x)
    speed = np.sqrt(np.square(np.gradient(path, axis=1)).sum(axis=2))
    pieces = (speed[:, 1:] + speed[:, :-1]) / 2 * np.diff(x)
    length = np.concatenate([np.zeros((len(y), 1)), np.cumsum(pieces, axis=1)], axis=1)
    out = np.empty((len(y), points, y.shape[2]))
    for r in range(len(y)):
        wanted = np.linspace(0, length[r, -1], points)
        table = length[r, :-1]
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        below = np.maximum(at - 1, 0)
        at = np.where(np.abs(table[below] - wanted) <= np.abs(table[at] - wanted), below, at)
        # Of equal lengths (a path that stands still) the first place counts.
        out[r] = path[r, np.searchsorted(table, table[at])]
    return out


def resample(points: DataFrame, template: DataFrame | None = None, k: int = POINTS) -> tuple[DataFrame, DataFrame]:
    """(structure, k, x, y, z) of each structure's path; and the structures with fewer than four points.

    template (k, resname, resseq) names the points. One exchange gathers each structure's
    points in order; the kernel then takes many structures at once, those of equal length
    together.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "x", "y", "z")))
    paths = points.groupBy("structure").agg(ordered.alias("p"))
    paths = paths.select("structure", F.flatten(F.transform("p", lambda r: F.array(r["x"].cast("double"), r["y"].cast("double"), r["z"].cast("double")))).alias("xyz"), F.size("p").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            flat, ends = batch.column("xyz").flatten().to_numpy(zero_copy_only=False), np.cumsum(3 * sizes)
            for n in np.unique(sizes).tolist():
                # Long paths go a few at a time, to bound the grid's memory.
                rows, many = np.flatnonzero(sizes == n), max(1, 200_000 // (n * 10))
                for at in range(0, len(rows), many):
                    part = rows[at : at + many]
                    y = np.stack([flat[ends[r] - 3 * n : ends[r]].reshape(n, 3) for r in part])
                    out = evenly_spaced(y, k).reshape(-1, 3)
                    names = batch.column("structure").take(pa.array(np.repeat(part, k)))
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(k, dtype=np.int32), len(part))), *(pa.array(out[:, c]) for c in range(3))], ["structure", "k", "x", "y", "z"])

    kind = points.schema["structure"].dataType.simpleString()
    rows = paths.where("n >= 4").mapInArrow(run, f"structure {kind}, k int, x double, y double, z double")
    return (rows.join(F.broadcast(template), "k") if template is not None else rows), paths.where("n < 4").select("structure")


def path_lengths(points: DataFrame, ord_: str = "ord") -> DataFrame:
    """Cumulative and total length of the polyline through each structure's points."""
    from pyspark.sql import Window

    order = Window.partitionBy("structure").orderBy(ord_)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(order)) * (F.col(c) - F.lag(c).over(order)) for c in "xyz"), F.lit(0.0)))
    rows = points.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return rows.withColumns({"length": F.sum("_step").over(order), "total": F.sum("_step").over(Window.partitionBy("structure"))}).drop("_step")


def flattened(points: DataFrame) -> DataFrame:
    """structure, coords: x, y, z of all points in order as one array."""
    ordered = F.array_sort(F.collect_list(F.struct("k", "x", "y", "z")))
    rows = points.groupBy("structure").agg(ordered.alias("r"))
    return rows.select("structure", F.flatten(F.transform("r", lambda p: F.array(p["x"], p["y"], p["z"]))).alias("coords"))
