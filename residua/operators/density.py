"""Density clustering of points in the plane by a grid, without listing pairs of points.

Cells have a side of radius / sqrt(2), so all points of a cell are within the radius of
each other. Hence a cell of min_samples points has only core points, and core points of a
cell are one cluster. What is left to find:

* the neighbours of points in cells of fewer points: each such point is asked of the
  leaves of the 24 cells around it; a leaf that is inside the radius as a whole answers
  with its number of points, the others count in a task that holds one leaf;
* whether two cells are linked: by the nearest leaves first, and by the rest only if these
  do not settle it. One pair of points within the radius is enough.

Equal points are one spot with a weight. A cell of very many spots is cut into k-d leaves
(`planar.kd_leaves`), of which it has at most the square root of its spots, so neither rows
nor pairs of leaves grow faster than the points. One grid serves all settings of a sweep.

Points with a null or NaN coordinate are noise. Core points only are put in clusters;
points near them that are not core themselves stay noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.operators.graph import components, written
from residua.operators.planar import kd_leaves

#: Spots of a leaf, about, where a cell has fewer than the square of it.
LEAF = 2048
#: Pairs of leaves, nearest first, that are tried for a pair of cells before all others.
FEW = 2
#: Distances that a task computes at once.
STEP = 1 << 20


@dataclass
class Grid:
    """places: id, z1, z2, cx, cy. spots: cx, cy, leaf, z1, z2, weight, first (least id), n (points of the cell), near (neighbours, itself included; at least `most` where n is)."""

    places: DataFrame
    spots: DataFrame
    radius: float
    most: int


def _low(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Least distance of two intervals."""
    return F.greatest(b1 - a2, a1 - b2, F.lit(0.0))


def _high(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.abs(b2 - a1), F.abs(a2 - b1))


def _around(forward: bool, own: bool = False) -> Column:
    """Offsets of cells that may hold points within the radius: all 24, or one of each two opposite ones; and the own cell."""
    cells = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if ((i, j) > (0, 0) if forward else (i, j) != (0, 0)) or own and (i, j) == (0, 0)]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in cells]))


def _boxes(spots: DataFrame, *more: Column) -> DataFrame:
    return spots.groupBy("cx", "cy", "leaf").agg(F.min("z1").alias("l1"), F.max("z1").alias("h1"), F.min("z2").alias("l2"), F.max("z2").alias("h2"), F.sum("weight").alias("points"), *more)


def _answers(spots: DataFrame, asked: DataFrame, tell: Column, answer, schema: str) -> DataFrame:
    """What `answer` says of the points asked (cx, cy, leaf, of, x, y), leaf by leaf.

    A task holds the spots of one leaf (x, y and the number `tell`, in that number's order)
    and streams the points that are asked of it. answer takes squared distances (points by
    spots), the spots' numbers and the points' `of`, and gives columns.
    """
    held = spots.join(asked.select("cx", "cy", "leaf").distinct(), ["cx", "cy", "leaf"], "left_semi")
    left = held.select("cx", "cy", "leaf", F.lit(0).alias("side"), F.col("z1").alias("x"), F.col("z2").alias("y"), tell.cast("long").alias("w"))
    right = asked.select("cx", "cy", "leaf", F.lit(1).alias("side"), "x", "y", F.col("of").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cx", "cy", "leaf", "side", "x", "y", "w")]
            change = np.zeros(batch.num_rows, bool)
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            cuts = np.r_[0, np.flatnonzero(change), batch.num_rows] if batch.num_rows else np.zeros(1, int)
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                now = tuple(int(c[a]) for c in cols[:3])
                if now != key:
                    key, held = now, []
                part = [c[a:b] for c in cols[4:]]
                if cols[3][a] == 0:
                    held.append(part)
                    continue
                if len(held) > 1:
                    held = [[np.concatenate(x) for x in zip(*held)]]
                x, y, w = held[0]
                step = max(1, STEP // len(x))
                for at in range(0, b - a, step):
                    d1, d2 = part[0][at : at + step, None] - x, part[1][at : at + step, None] - y
                    out.append(answer(d1 * d1 + d2 * d2, w, part[2][at : at + step]))
            if out:
                yield pa.RecordBatch.from_pydict({k: np.concatenate([o[k] for o in out]) for k in out[0]})

    both = left.unionByName(right).repartition("cx", "cy", "leaf").sortWithinPartitions("cx", "cy", "leaf", "side", "w")
    return both.mapInArrow(run, schema)


def _cells(rows: DataFrame, radius: float) -> DataFrame:
    """Rows that have a place, with the cell it is in."""
    side = radius / 2**0.5 * (1 - 1e-9)
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    good = ~(F.col("z1").isNull() | F.col("z2").isNull() | F.isnan("z1") | F.isnan("z2"))
    plain = rows.where(good).withColumns({"z1": F.col("z1").cast("double"), "z2": F.col("z2").cast("double")})
    return plain.withColumns({"cx": cell("z1"), "cy": cell("z2")})


def _leaved(spots: DataFrame, leaf: int) -> DataFrame:
    """spots (cx, cy, z1, z2, weight, ...), a written table, with the points of their cell (n) and their leaf in it."""
    cells = written(spots.groupBy("cx", "cy").agg(F.sum("weight").alias("n"), F.count("*").alias("spots")))
    large = cells.where(F.col("spots") > leaf).select("cx", "cy")
    plain = spots.join(cells.where(F.col("spots") <= leaf).select("cx", "cy", "n"), ["cx", "cy"]).withColumn("leaf", F.lit(0).cast("long"))
    if not large.isEmpty():
        cut = kd_leaves(spots.join(large, ["cx", "cy"], "left_semi"), leaf, "cx", "cy").withColumn("leaf", F.shiftleft("strip", 32) + F.col("leaf")).drop("strip")
        plain = plain.unionByName(cut.join(cells.select("cx", "cy", "n"), ["cx", "cy"]).select(plain.columns))
    return plain


def _reach(points: DataFrame, leaves: DataFrame, own: bool) -> DataFrame:
    """of, x, y, cx, cy, leaf, points, low and high (squares of the nearest and farthest that the leaf's box can be): points (of, z1, z2, cx, cy) with the leaves of the cells around."""
    asking = points.select("of", "z1", "z2", F.col("cx").alias("ox"), F.col("cy").alias("oy"), _around(False, own).alias("o"))
    asking = asking.select("of", F.col("z1").alias("x"), F.col("z2").alias("y"), (F.col("ox") + F.col("o.i")).alias("cx"), (F.col("oy") + F.col("o.j")).alias("cy"))
    square = lambda f: F.pow(f(F.col("l1"), F.col("h1"), F.col("x"), F.col("x")), F.lit(2)) + F.pow(f(F.col("l2"), F.col("h2"), F.col("y"), F.col("y")), F.lit(2))
    return asking.join(leaves, ["cx", "cy"]).select("of", "x", "y", "cx", "cy", "leaf", "points", square(_low).alias("low"), square(_high).alias("high"))


def grid(rows: DataFrame, radius: float, most: int, leaf: int = LEAF) -> Grid:
    """The grid of rows (id, z1, z2), good for every min_samples up to `most`."""
    places = _cells(rows.select("id", "z1", "z2"), radius)
    spots = written(places.groupBy("cx", "cy", "z1", "z2").agg(F.count("*").alias("weight"), F.min("id").alias("first")))
    known = written(_leaved(spots, leaf).withColumn("of", F.xxhash64("z1", "z2", "cx", "cy")))
    square, slack = radius * radius, 1e-9
    met = _reach(known.where(F.col("n") < most), _boxes(known), False).where(F.col("low") <= square * (1 + slack))
    met = written(met.withColumn("whole", F.col("high") <= square * (1 - slack)).drop("low", "high"))
    within = lambda d, w, of: {"of": of, "points": ((d <= square) @ w).astype(np.int64)}
    counted = _answers(known, met.where("not whole"), F.col("weight"), within, "of long, points long")
    counts = met.where("whole").select("of", "points").unionByName(counted).groupBy("of").agg(F.sum("points").alias("others"))
    near = known.join(counts, "of", "left").withColumn("near", F.col("n") + F.coalesce("others", F.lit(0))).drop("others", "of")
    return Grid(places, written(near), radius, most)


def _linked(pairs: DataFrame, leaves: DataFrame, radius: float) -> DataFrame:
    """a, b of those pairs (a, b and a leaf of each) that hold two points within the radius."""
    square = radius * radius

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = lambda s: (np.array([p["z1"] for p in s]), np.array([p["z2"] for p in s]))
        for batch in batches:
            found = []
            for a, b, p, q in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "p", "q"))):
                (x, y), (u, v) = points(p), points(q)
                step = max(1, STEP // len(u))
                for at in range(0, len(x), step):
                    d1, d2 = x[at : at + step, None] - u, y[at : at + step, None] - v
                    if (d1 * d1 + d2 * d2 <= square).any():
                        found.append((a, b))
                        break
            if found:
                yield pa.RecordBatch.from_pydict({"a": np.array([f[0] for f in found]), "b": np.array([f[1] for f in found])})

    end = lambda k, name: leaves.select(F.col("node").alias(k), F.col("leaf").alias(f"{k}_leaf"), F.col("held").alias(name))
    both = pairs.select("a", "a_leaf", "b", "b_leaf").join(end("a", "p"), ["a", "a_leaf"]).join(end("b", "q"), ["b", "b_leaf"])
    return both.select("a", "b", "p", "q").mapInArrow(near, "a long, b long").distinct()


def _of_core(g: Grid, min_samples: int) -> DataFrame:
    """Core cells (cx, cy, points) with their component, the least id of a core point that they are connected with."""
    core = g.spots.where((F.col("n") >= min_samples) | (F.col("near") >= min_samples))
    cells = core.groupBy("cx", "cy").agg(F.min("first").alias("first"), F.sum("weight").alias("points")).withColumn("node", F.xxhash64("cx", "cy"))
    cells = written(cells)
    leaves = written(_boxes(core, F.collect_list(F.struct("z1", "z2")).alias("held")).withColumn("node", F.xxhash64("cx", "cy")))
    boxes = leaves.select("cx", "cy", "leaf", "node", "l1", "h1", "l2", "h2")
    left = boxes.select(F.col("node").alias("a"), F.col("leaf").alias("a_leaf"), *[F.col(c).alias(f"a_{c}") for c in ("l1", "h1", "l2", "h2")], "cx", "cy", _around(True).alias("o"))
    left = left.withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o")
    pairs = left.join(boxes.withColumnsRenamed({"node": "b", "leaf": "b_leaf"}), ["cx", "cy"])
    side = lambda f, k: F.pow(f(F.col(f"a_l{k}"), F.col(f"a_h{k}"), F.col(f"l{k}"), F.col(f"h{k}")), F.lit(2))
    square, slack = g.radius * g.radius, 1e-9
    pairs = written(pairs.withColumns({"low": side(_low, 1) + side(_low, 2), "high": side(_high, 1) + side(_high, 2)}).where(F.col("low") <= square * (1 + slack)).select("a", "a_leaf", "b", "b_leaf", "low", "high"))
    sure = pairs.where(F.col("high") <= square * (1 - slack)).select("a", "b").distinct()
    open_ = pairs.join(sure, ["a", "b"], "left_anti")
    order = Window.partitionBy("a", "b").orderBy("low", "high", "a_leaf", "b_leaf")
    first = written(_linked(open_.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= FEW), leaves, g.radius).unionByName(sure))
    rest = open_.join(first, ["a", "b"], "left_anti").withColumn("_k", F.row_number().over(order)).where(F.col("_k") > FEW)
    links = first.unionByName(_linked(rest, leaves, g.radius))
    joined = components(links)
    one = cells.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = one.groupBy("component").agg(F.min("first").alias("least"))
    return one.join(least, "component").select("cx", "cy", "points", F.col("least").alias("component"))


def _labels(g: Grid, rows: DataFrame, cells: DataFrame, min_samples: int, min_cluster_size: int) -> DataFrame:
    big = cells.groupBy("component").agg(F.sum("points").alias("n")).where(F.col("n") >= min_cluster_size)
    number = big.withColumn("cluster", F.row_number().over(Window.orderBy("component")) - 1)  # a row per cluster
    named = cells.join(number, "component").select("cx", "cy", "cluster")
    core = g.spots.where((F.col("n") >= min_samples) | (F.col("near") >= min_samples)).select("cx", "cy", "z1", "z2").join(named, ["cx", "cy"])
    told = g.places.join(core, ["cx", "cy", "z1", "z2"], "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    lost = rows.where("z1 is null or z2 is null or isnan(z1) or isnan(z2)").select("id", F.lit(-1).alias("cluster"))
    return told.unionByName(lost)


def density(rows: DataFrame, radius: float, min_samples: int, min_cluster_size: int, leaf: int = LEAF) -> DataFrame:
    """id, cluster: points with min_samples neighbours (themselves included) within the radius, linked; others -1.

    A component below min_cluster_size is noise. Clusters are numbered by their smallest id.
    """
    g = grid(rows, radius, min_samples, leaf)
    return _labels(g, rows, _of_core(g, min_samples), min_samples, min_cluster_size)


def density_sweep(rows: DataFrame, radius: float, min_samples: list[int], min_sizes: list[int]) -> DataFrame:
    """min_samples, min_size, clusters, noise and silhouette of each setting, over one grid."""
    from residua.operators.cluster import silhouette

    g, out = grid(rows, radius, max(min_samples)), []
    for s in min_samples:
        cells = written(_of_core(g, s))
        for m in min_sizes:
            labels = written(_labels(g, rows, cells, s, m))
            r = labels.agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"), F.count_if(F.col("cluster") < 0).alias("noise")).first()
            out.append((s, m, r.k, r.noise, silhouette(rows, labels)))
    return rows.sparkSession.createDataFrame(out, "min_samples int, min_size int, clusters long, noise long, silhouette double")


def nearest_core(rows: DataFrame, fitted: DataFrame, radius: float, leaf: int = LEAF) -> DataFrame:
    """id, cluster of new points: that of the nearest clustered point within the radius (ties: the least id), else -1.

    fitted: id (a number), z1, z2, cluster. New points are asked of the leaves around them,
    as in counting neighbours.
    """
    core = _cells(fitted.where("cluster >= 0"), radius).groupBy("cx", "cy", "z1", "z2").agg(F.count("*").alias("weight"), F.min("id").alias("first"))
    known = written(_leaved(written(core), leaf))
    new = _cells(rows.select("id", "z1", "z2"), radius).withColumn("of", F.xxhash64("z1", "z2"))
    places = new.groupBy("of", "z1", "z2", "cx", "cy").agg(F.count("*").alias("rows"))
    square = radius * radius
    met = written(_reach(places, _boxes(known), True).where(F.col("low") <= square * (1 + 1e-9)))

    def near(d: np.ndarray, w: np.ndarray, of: np.ndarray) -> dict[str, np.ndarray]:
        best = d.argmin(axis=1)  # spots are in the order of their ids
        least = d[np.arange(len(of)), best]
        ok = least <= square
        return {"of": of[ok], "d": least[ok], "first": w[best[ok]]}

    best = _answers(known, met, F.col("first"), near, "of long, d double, first long").groupBy("of").agg(F.min(F.struct("d", "first")).alias("r")).select("of", "r.first")
    told = new.join(best, "of").join(fitted.select(F.col("id").alias("first"), "cluster"), "first").select("id", "cluster")
    return rows.select("id").join(told, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
