"""Random-forest classification, importances, permutation scores and additive attributions."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators.graph import written
from residua.operators.ranges import least_by_hash, numbered_by_range


def split_rows(rows: DataFrame, train: float = 0.9, seed: int = 42, key: str = "structure") -> tuple[DataFrame, DataFrame]:
    """Train and validation rows: exactly the rounded share, by a seeded hash order of the key."""
    n = rows.count()
    held = least_by_hash(rows, n - round(n * train), key, seed=seed)
    return rows.join(held.select(key), key, "left_anti"), held


def index_maps(train: DataFrame, held: DataFrame, key: str = "structure") -> DataFrame:
    """name, part, loop_index (place in its part) and source_index (place among all), both by name order."""
    both = train.select(key, F.lit("train").alias("part")).unionByName(held.select(key, F.lit("valid").alias("part")))
    whole = numbered_by_range(both, key, number="source_index")
    parts = [numbered_by_range(whole.where(F.col("part") == p), key, number="loop_index") for p in ("train", "valid")]
    return parts[0].unionByName(parts[1]).select(key, "part", "loop_index", "source_index")


def wide(long: DataFrame) -> DataFrame:
    """structure, label, x: values in feature order. long: structure, label, feature, value (complete)."""
    ordered = F.array_sort(F.collect_list(F.struct("feature", "value")))
    rows = long.groupBy("structure", "label").agg(ordered.alias("r"))
    return rows.select("structure", "label", F.transform("r", lambda c: c["value"]).alias("x"))


def train_forest(rows: DataFrame, trees: int = 100, seed: int = 42, **options) -> RandomForestClassificationModel:
    """rows: label, x (array). Options go to the learner."""
    learner = RandomForestClassifier(**({"numTrees": trees, "seed": seed, "maxDepth": 10, "featureSubsetStrategy": "sqrt", "featuresCol": "_v", "labelCol": "label"} | options))
    return learner.fit(rows.withColumn("_v", array_to_vector("x")))


def predict(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    """rows with prediction (int) and probability (array)."""
    out = model.transform(rows.withColumn("_v", array_to_vector("x")))
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability").alias("probability"))


def tree_importances(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    """feature, importance, and its standard deviation and standard error over the trees."""
    each = [(t, i, float(v)) for t, tree in enumerate(model.trees) for i, v in enumerate(tree.featureImportances.toArray())]
    table = rows.sparkSession.createDataFrame(each, "tree int, feature int, importance double")
    out = table.groupBy("feature").agg(F.stddev_pop("importance").alias("std"), (F.stddev_samp("importance") / F.sqrt(F.count("*"))).alias("sem"))
    whole = rows.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())], "feature int, importance double")
    return whole.join(out, "feature")


class LeafSets:
    """A tree whose leaves are found by sets: the leaves that the splits on one feature leave open, for each range of its values.

    A row's leaf is the first one that all features leave open, so a changed value of one
    feature needs that feature's set and the others' common set only. Sets are bits in
    64-bit words, leaves from left to right.
    """

    def __init__(self, tree: dict[str, np.ndarray]):
        left, right, feature = tree["left"], tree["right"], tree["feature"]
        leaves, spans = [], {}

        def walk(node: int) -> tuple[int, int]:
            if feature[node] < 0:
                leaves.append(node)
                spans[node] = (len(leaves) - 1, len(leaves))
            else:
                spans[node] = (walk(left[node])[0], walk(right[node])[1])
            return spans[node]

        walk(0)
        self.value = tree["value"][leaves]
        words = -(-len(leaves) // 64)
        splits: dict[int, list] = {}
        for node in np.flatnonzero(feature >= 0):
            splits.setdefault(int(feature[node]), []).append((float(tree["threshold"][node]), spans[left[node]]))
        self.features = sorted(splits)
        self.thresholds, self.open = [], []
        for f in self.features:
            splits[f].sort()
            sets = np.full((len(splits[f]) + 1, words * 64), True)
            for k, (_, (begin, end)) in enumerate(splits[f]):
                sets[k + 1] = sets[k]
                sets[k + 1, begin:end] = False  # a value above the threshold closes what is to the left of the split
            self.thresholds.append(np.array([t for t, _ in splits[f]]))
            self.open.append(np.packbits(sets, axis=1, bitorder="little").view(np.uint64))
        self.words = words

    def sets(self, x: np.ndarray) -> list[np.ndarray]:
        """For each of the tree's features the sets of all rows."""
        return [o[np.searchsorted(t, x[:, f])] for f, t, o in zip(self.features, self.thresholds, self.open)]

    def leaf(self, sets: np.ndarray) -> np.ndarray:
        word = (sets != 0).argmax(axis=1)
        bits = sets[np.arange(len(sets)), word]
        lowest = bits & (~bits + np.uint64(1))
        return word * 64 + np.log2(lowest.astype(np.float64)).astype(np.int64)

    def swapped(self, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Class shares of the rows x, and for each of the tree's features those with its values from v."""
        own, new = self.sets(x), self.sets(v)
        full = np.full((len(x), self.words), ~np.uint64(0))
        before = [full]
        for s in own:
            before.append(before[-1] & s)
        shares, after = [None] * len(own), full
        for k in range(len(own) - 1, -1, -1):
            shares[k] = self.value[self.leaf(before[k] & after & new[k])]
            after = after & own[k]
        return self.value[self.leaf(before[-1])], shares


def swapped_hits(forest: list[LeafSets], x: np.ndarray, v: np.ndarray, label: np.ndarray, n_features: int) -> tuple[int, np.ndarray]:
    """Right predictions for the rows x, and for each feature with its values from v; only trees that split on it are scored again."""
    each = [t.swapped(x, v) for t in forest]
    whole = sum(own for own, _ in each)
    right = lambda shares: int((np.round(shares, 9).argmax(axis=1) == label).sum())  # noqa: E731  equal shares: the first class
    changes: dict[int, np.ndarray] = {}
    for t, (own, new) in zip(forest, each):
        for f, shares in zip(t.features, new):
            changes[f] = changes.get(f, 0.0) + (shares - own)
    base = right(whole)
    return base, np.array([right(whole + changes[f]) if f in changes else base for f in range(n_features)])


def permutation_importance(model: RandomForestClassificationModel, rows: DataFrame, repeats: int = 10, seed: int = 42, features: int | None = None) -> DataFrame:
    """feature, mean and std of the loss in accuracy when its values are dealt anew among rows.

    Rows are numbered by range. A repeat deals them by a one-to-one map of numbers,
    (a * i + b) mod n with a seeded a that has no divisor in common with n, so each row's
    donor is a row of the same table, found by one join per repeat. A row and its donor are
    scored together: per feature only the trees that split on it, from sets of open leaves
    (`LeafSets`). No row is copied per feature; a batch gives one count per feature.
    """
    spark = rows.sparkSession
    n_features = features or model.numFeatures
    n = rows.count()
    numbered = written(numbered_by_range(rows.select("structure", "label", "x"), "structure"))
    forest = spark.sparkContext.broadcast([LeafSets(t) for t in forest_arrays(model)])
    dice, told = random.Random(seed), None

    def score(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                x, v = (np.stack([np.asarray(r, float) for r in part[c]]) for c in ("x", "v"))
                base, hits = swapped_hits(forest.value, x, v, part.label.to_numpy(), n_features)
                yield pd.DataFrame({"repeat": part["repeat"].iloc[0], "feature": np.arange(n_features, dtype=np.int32), "lost": base - hits, "n": len(part)})

    for k in range(repeats):
        a, b = 1, dice.randrange(max(1, n))
        while n > 2 and (a == 1 or math.gcd(a, n) > 1):
            a = dice.randrange(2, max(3, min(n, 1 << 30)))
            if n <= 4:
                a = n - 1
        donor = F.pmod(F.col("number") * a + b, F.lit(n))
        given = numbered.select(F.col("number").alias("from"), F.col("x").alias("v"))
        pairs = numbered.withColumn("from", donor).join(given, "from").select("label", "x", "v", F.lit(k).alias("repeat"))
        one = pairs.mapInPandas(score, "repeat int, feature int, lost long, n long")
        told = one if told is None else told.unionByName(one)
    loss = told.groupBy("feature", "repeat").agg((F.sum("lost") / F.sum("n")).alias("loss"))
    return loss.groupBy("feature").agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std"))


def forest_arrays(model: RandomForestClassificationModel) -> list[dict[str, np.ndarray]]:
    """Trees as arrays: feature, threshold, left, right, cover and class shares per node."""
    out = []
    for tree in model.trees:
        nodes: list[tuple] = []

        def walk(node, nodes=nodes) -> int:
            at = len(nodes)
            stats = np.array(node.impurityStats().stats())
            nodes.append(None)
            if node.subtreeDepth() == 0:
                nodes[at] = (-1, 0.0, -1, -1, stats.sum(), stats / max(stats.sum(), 1e-300))
            else:
                split = node.split()
                left, right = walk(node.leftChild()), walk(node.rightChild())
                nodes[at] = (split.featureIndex(), split.threshold(), left, right, stats.sum(), stats / max(stats.sum(), 1e-300))
            return at

        walk(tree._call_java("rootNode"))
        f, t, left, right, cover, value = zip(*nodes)
        out.append({"feature": np.array(f), "threshold": np.array(t), "left": np.array(left), "right": np.array(right), "cover": np.array(cover), "value": np.stack(value)})
    return out


def tree_attributions(tree: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base value (classes) and additive contributions (rows x features x classes) of many rows along their path-dependent game.

    For every leaf, the features on its path form a game whose value is the leaf's share
    times, per feature, 1 or 0 where the row decides and the covers' ratio where it does
    not. Its Shapley values are integrals over t in [0, 1] of the product of the factors
    zero (1 - t) + one t without the feature's own: polynomials of a degree under the path's
    length, so a Gauss rule of half as many points is exact. The product is carried down the
    path at these points; what a feature adds at an edge is the sum of all products below,
    divided by the feature's factor there, less the same with its factor further up. Work
    is in proportion to the tree's nodes and the points.
    """
    n, classes = len(x), tree["value"].shape[1]
    phi = np.zeros((n, x.shape[1], classes))
    base = np.zeros(classes)
    points, weights = np.polynomial.legendre.leggauss(max(1, (_depth(tree) + 1) // 2))
    points, weights = (points + 1) / 2, weights / 2

    def below(node: int, product: np.ndarray, share: float, path: dict) -> np.ndarray:
        """Sum of the products of all leaves below times their values: rows x points x classes."""
        f = tree["feature"][node]
        if f < 0:
            nonlocal base
            base = base + share * tree["value"][node]
            return product[:, :, None] * tree["value"][node]
        goes = x[:, f] <= tree["threshold"][node]
        one, zero, factor = path.get(f, (np.ones(n), 1.0, None))
        was = 0.0 if factor is None else (one - zero)[:, None] / factor
        rest = product if factor is None else product / factor
        total = np.zeros((n, len(points), classes))
        for child, hot in ((tree["left"][node], goes), (tree["right"][node], ~goes)):
            part = tree["cover"][child] / max(tree["cover"][node], 1e-300)
            hot, cold = one * hot, zero * part
            own = cold * (1 - points) + hot[:, None] * points
            sums = below(child, rest * own, share * part, path | {f: (hot, cold, own)})
            phi[:, f, :] += np.einsum("nk,nkc->nc", ((hot - cold)[:, None] / own - was) * weights, sums)
            total += sums
        return total

    below(0, np.ones((n, len(points))), 1.0, {})
    return base, phi


def _depth(tree: dict[str, np.ndarray], node: int = 0) -> int:
    return 0 if tree["feature"][node] < 0 else 1 + max(_depth(tree, tree["left"][node]), _depth(tree, tree["right"][node]))


def attributions(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    """structure, feature, class, phi and base: contributions to each class's share, summing to the prediction.

    The forest, a model-sized table, is broadcast; rows are scored where they are.
    """
    trees = rows.sparkSession.sparkContext.broadcast(forest_arrays(model))

    def score(batches):
        for whole in batches:
            for at in range(0, len(whole), 512):
                pdf = whole.iloc[at : at + 512]
                x = np.stack([np.asarray(v, float) for v in pdf.x])
                both = [tree_attributions(t, x) for t in trees.value]
                base, phi = sum(b for b, _ in both) / len(both), sum(p for _, p in both) / len(both)
                n, features, classes = phi.shape
                structure = pd.Series(np.repeat(pdf.structure.to_numpy(object), features * classes), dtype=object)
                _, f, c = (v.ravel() for v in np.indices(phi.shape))
                yield pd.DataFrame({"structure": structure, "feature": f, "class": c, "phi": phi.ravel(), "base": np.tile(base, n * features)})

    kind = rows.schema["structure"].dataType.simpleString()
    return rows.select("structure", "x").mapInPandas(score, f"structure {kind}, feature int, class int, phi double, base double")


def attribution_ranking(phis: DataFrame, n: int = 20) -> DataFrame:
    """The n features of largest mean |phi| over rows and classes."""
    return phis.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance")).orderBy(F.desc("importance"), "feature").limit(n)


def classification_report(long: DataFrame, train: float = 0.9, trees: int = 100, seed: int = 42, repeats: int = 10, **options) -> dict[str, DataFrame]:
    """Split, model, metrics, confusion, importances, permutation scores and attributions, as tables."""
    from residua.operators import report

    rows = wide(long)
    fit, held = split_rows(rows, train, seed)
    model = train_forest(fit, trees, seed, **options)
    told = predict(model, held)
    phis = attributions(model, held)
    return {
        "predictions": told, "metrics": report.class_metrics(told), "confusion": report.confusion(told), "importances": tree_importances(model, rows),
        "permutation": permutation_importance(model, held, repeats, seed), "attributions": phis, "ranking": attribution_ranking(phis),
    }
