"""Ward clustering of any number of points: reciprocal nearest neighbours merged leaf by leaf.

Ward's criterion is reducible: two clusters that are nearest to each other stay so whatever
else is merged, so all such pairs may merge at once and the tree is that of merging one
closest pair at a time. The plane is cut into leaves of a bounded number of clusters; a
task merges the pairs of its leaf that are nearest to each other and nearer than anything
outside can ever be (centres of merged clusters never leave their leaf). What is near a
border waits for the next round, where leaves are cut anew along the other axis. Rounds
shrink quickly, and the last few thousand clusters are one leaf without borders.

Heights never fall along the tree, so k clusters are what is left without its k-1 highest
merges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.operators.graph import written
from residua.operators.planar import kd_leaves

#: Clusters of one leaf, about; a task holds the square of it in distances.
LEAF = 2048


def growth(x: np.ndarray, w: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Growth of the squared error when clusters at x and y with weights w and v merge: a matrix."""
    d = np.square(x[:, None, 0] - y[None, :, 0]) + np.square(x[:, None, 1] - y[None, :, 1])
    return d * (w[:, None] * v[None] / (w[:, None] + v[None]))


def merge_leaf(node: np.ndarray, x: np.ndarray, w: np.ndarray, box: tuple[float, float, float, float], least: float) -> tuple[list, np.ndarray]:
    """Merges (kept node, other node, height) of one leaf, and which of its clusters are left; x and w are changed in place.

    box: how far the leaf's own ground reaches (left, right, below, above); all centres
    outside lie beyond it, with weights of at least `least`.
    """
    alive = np.arange(len(node))
    cost = growth(x, w, x, w)
    np.fill_diagonal(cost, np.inf)
    merges = []
    while len(alive) > 1:
        p, v = x[alive], w[alive]
        edge = np.clip(np.minimum.reduce([p[:, 0] - box[0], box[1] - p[:, 0], p[:, 1] - box[2], box[3] - p[:, 1]]), 0, None)
        outside = edge * edge * (v * least / (v + least))
        nearest = cost.argmin(axis=1)
        own = np.arange(len(alive))
        least_cost = cost[own, nearest]
        mutual = (nearest[nearest] == own) & (own < nearest) & (least_cost <= np.minimum(outside, outside[nearest]))
        i = np.flatnonzero(mutual)
        if not len(i):
            break
        j = nearest[i]
        a, b = alive[i], alive[j]
        swap = node[a] > node[b]
        merges += zip(np.where(swap, node[b], node[a]).tolist(), np.where(swap, node[a], node[b]).tolist(), least_cost[i].tolist())
        total = w[a] + w[b]
        x[a] = (x[a] * w[a, None] + x[b] * w[b, None]) / total[:, None]
        w[a], node[a] = total, np.minimum(node[a], node[b])
        left = np.ones(len(alive), bool)
        left[j] = False
        place = np.cumsum(left) - 1
        alive, cost = alive[left], cost[np.ix_(left, left)]
        fresh = growth(x[a], w[a], x[alive], w[alive])
        at = place[i]
        fresh[np.arange(len(at)), at] = np.inf
        cost[at], cost[:, at] = fresh, fresh.T
    return merges, alive


STATE = "kind int, node long, z1 double, z2 double, w double, other long, height double, strip long, leaf long"


def _merged(dealt: DataFrame) -> DataFrame:
    """kind 0: clusters that are left; kind 1: merges of `other` into node at a height."""
    import pandas as pd

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node, x, w = pdf.node.to_numpy(copy=True), pdf[["z1", "z2"]].to_numpy(dtype=float, copy=True), pdf.w.to_numpy(dtype=float, copy=True)
        box = tuple(float(pdf[c].iloc[0]) for c in ("left", "right", "below", "above"))
        merges, alive = merge_leaf(node, x, w, box, float(pdf.least.iloc[0]))
        own = pd.DataFrame({"kind": 0, "node": node[alive], "z1": x[alive, 0], "z2": x[alive, 1], "w": w[alive], "other": -1, "height": 0.0})
        done = pd.DataFrame(merges, columns=["node", "other", "height"]).assign(kind=1, z1=0.0, z2=0.0, w=0.0)
        both = pd.concat([own, done[own.columns]]) if len(done) else own
        return both.astype({"kind": "int32", "node": "int64", "other": "int64"}).assign(strip=pdf.strip.iloc[0], leaf=pdf.leaf.iloc[0])

    return dealt.groupBy("strip", "leaf").applyInPandas(leaf, STATE)


def _with_borders(state: DataFrame, size: int, turned: bool) -> DataFrame:
    """Clusters dealt to leaves, with how far the ground around each leaf is free of others' centres."""
    one, two = ("z2", "z1") if turned else ("z1", "z2")
    dealt = written(kd_leaves(state.select("node", F.col(one).alias("z1"), F.col(two).alias("z2"), "w"), size))
    ends = lambda c: [F.min(c).alias("low"), F.max(c).alias("high")]
    before, after = lambda c, over: F.coalesce(F.lag(c).over(over), F.lit(float("-inf"))), lambda c, over: F.coalesce(F.lead(c).over(over), F.lit(float("inf")))
    row = Window.orderBy("strip")  # a row per strip
    strips = dealt.groupBy("strip").agg(*ends("z1")).select("strip", before("high", row).alias("left"), after("low", row).alias("right"))
    column = Window.partitionBy("strip").orderBy("leaf")  # a row per leaf
    leaves = dealt.groupBy("strip", "leaf").agg(*ends("z2")).select("strip", "leaf", before("high", column).alias("below"), after("low", column).alias("above"))
    both = dealt.join(leaves, ["strip", "leaf"]).join(strips, "strip").crossJoin(F.broadcast(dealt.agg(F.min("w").alias("least"))))
    if not turned:
        return both
    turn = {"z1": "z2", "z2": "z1", "left": "below", "below": "left", "right": "above", "above": "right"}
    return both.select([F.col(turn.get(c, c)).alias(c) for c in both.columns])


def ward_rounds(spots: DataFrame, leaf: int = LEAF) -> list[DataFrame]:
    """Per round its merges (node, other, height, strip, leaf), down to one cluster. spots: node, z1, z2, w, one row per place.

    Should a round merge fewer than a tenth of its clusters, leaves double, so that
    borders matter less.
    """
    state, merges, turned = spots.select("node", "z1", "z2", F.col("w").cast("double").alias("w")), [], False
    n = state.count()
    while n > 1:
        if n <= leaf:
            plain = state.withColumns({"strip": F.lit(0), "leaf": F.lit(0), "least": F.lit(1.0)} | {c: F.lit(v) for c, v in (("left", float("-inf")), ("below", float("-inf")), ("right", float("inf")), ("above", float("inf")))})
            merges.append(written(_merged(plain)).where("kind = 1"))
            break
        out = written(_merged(_with_borders(state, leaf, turned)))
        merges.append(out.where("kind = 1"))
        state, turned, was = out.where("kind = 0").select("node", "z1", "z2", "w"), not turned, n
        n = state.count()
        leaf = 2 * leaf if n > 0.9 * was else leaf
    return [m.select("node", "other", "height", "strip", "leaf") for m in merges]


def _roots(merges: DataFrame, cut: set[int]) -> DataFrame:
    """other, root: what each cluster that a round merged away has become at its end, without the merges that are cut."""
    import pandas as pd

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        into = {o: n for n, o in zip(pdf.node.tolist(), pdf.other.tolist()) if o not in cut}
        # Heights never fall towards the root: from the highest merge down, what a cluster went into is known already.
        for o in pdf.sort_values("height", ascending=False, kind="stable").other.tolist():
            at, path = o, []
            while at in into:
                path.append(at)
                at = into[at]
            into.update(dict.fromkeys(path, at))
        return pd.DataFrame({"other": list(into), "root": list(into.values())}, dtype="int64")

    return merges.groupBy("strip", "leaf").applyInPandas(leaf, "other long, root long")


def hierarchical(rows: DataFrame, k: int = 2, leaf: int = LEAF) -> DataFrame:
    """rows (z1, z2, ...) with `cluster`: the k clusters of Ward's method over all points, exactly.

    Places are told by a 64-bit hash of their coordinates; between merges of equal cost the
    choice is by that hash. Clusters are numbered in the order of their first place by
    (z1, z2). Rows without a place get null. Fewer than k different places are clusters of
    their own.
    """
    spark = rows.sparkSession
    places = rows.where("z1 is not null and z2 is not null and not isnan(z1) and not isnan(z2)").groupBy("z1", "z2").agg(F.count("*").alias("w"))
    spots = written(places.withColumn("node", F.xxhash64("z1", "z2")))
    rounds = ward_rounds(spots, leaf)
    every = spark.createDataFrame([], "node long, other long, height double, strip long, leaf long")
    for m in rounds:
        every = every.unionByName(m)
    cut = {r.other for r in every.orderBy(F.desc("height"), F.desc("other")).limit(max(k - 1, 0)).collect()}  # k rows
    # What a round's clusters become at the very end, from the last round back: each is a small part of the one before.
    final = None
    for m in reversed(rounds):
        here = _roots(m, cut)
        if final is not None:
            later = final.select(F.col("other").alias("root"), F.col("root").alias("end"))
            here = here.join(later, "root", "left").select("other", F.coalesce("end", "root").alias("root")).unionByName(final)
        final = written(here) if len(rounds) > 1 else here
    named = spots.select("node", "z1", "z2")
    if final is not None:
        named = named.join(final.withColumnRenamed("other", "node"), "node", "left").withColumn("node", F.coalesce("root", "node")).drop("root")
    named = written(named)
    number = named.groupBy("node").agg(F.min(F.struct("z1", "z2")).alias("first")).select("node", (F.row_number().over(Window.orderBy("first")) - 1).alias("cluster"))  # a row per cluster
    return rows.join(named.join(F.broadcast(number), "node").drop("node"), ["z1", "z2"], "left").select(*rows.columns, "cluster")
