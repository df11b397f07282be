"""Forest scoring by leaf sets and attributions by path products, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest

from residua.operators import classify


def grown(rng, features=5, depth=6, classes=3):
    """A random tree as arrays; a feature may come more than once on a path."""
    nodes = []

    def walk(level, cover):
        at = len(nodes)
        nodes.append(None)
        if level == depth or (level and rng.random() < 0.25):
            nodes[at] = (-1, 0.0, -1, -1, cover, rng.dirichlet(np.ones(classes)))
        else:
            part = rng.uniform(0.1, 0.9)
            f, t = int(rng.integers(features)), float(rng.integers(-3, 4)) / 2
            left, right = walk(level + 1, cover * part), walk(level + 1, cover * (1 - part))
            nodes[at] = (f, t, left, right, cover, np.zeros(classes))
        return at

    walk(0, 100.0)
    return {k: np.array(v) if k != "value" else np.stack(v) for k, v in zip(("feature", "threshold", "left", "right", "cover", "value"), zip(*nodes))}


def shares(tree, row):
    node = 0
    while tree["feature"][node] >= 0:
        node = tree["left"][node] if row[tree["feature"][node]] <= tree["threshold"][node] else tree["right"][node]
    return tree["value"][node]


def expected(tree, row, known, node=0):
    """Value of the game in which the features of `known` are decided by the row."""
    f = tree["feature"][node]
    if f < 0:
        return tree["value"][node]
    left, right = tree["left"][node], tree["right"][node]
    if f in known:
        return expected(tree, row, known, left if row[f] <= tree["threshold"][node] else right)
    part = tree["cover"][left] / tree["cover"][node]
    return part * expected(tree, row, known, left) + (1 - part) * expected(tree, row, known, right)


@pytest.mark.parametrize("seed", range(4))
def test_attributions_are_shapley_values(seed):
    rng = np.random.default_rng(seed)
    tree, m = grown(rng), 5
    x = rng.integers(-4, 5, (6, m)) / 2.0
    base, phi = classify.tree_attributions(tree, x)
    for n, row in enumerate(x):
        assert np.allclose(base, expected(tree, row, ()))
        assert np.allclose(base + phi[n].sum(axis=0), shares(tree, row))
        for f in range(m):
            others, want = [g for g in range(m) if g != f], 0.0
            for size in range(m):
                for s in itertools.combinations(others, size):
                    want = want + (expected(tree, row, {*s, f}) - expected(tree, row, {*s})) / (m * math.comb(m - 1, size))
            assert np.allclose(phi[n, f], want, atol=1e-12)


@pytest.mark.parametrize("seed", range(3))
def test_leaf_sets_score_as_the_trees_do(seed):
    rng = np.random.default_rng(seed)
    trees = [grown(rng, depth=d) for d in (0, 2, 6, 9)]  # the last has over 64 leaves
    forest = [classify.LeafSets(t) for t in trees]
    x, v = rng.integers(-4, 5, (2, 300, 5)) / 2.0
    label = rng.integers(0, 3, 300)
    told = lambda rows: np.array([np.round(sum(shares(t, r) for t in trees), 9).argmax() for r in rows])
    base, hits = classify.swapped_hits(forest, x, v, label, 5)
    assert base == (told(x) == label).sum()
    for f in range(5):
        swapped = x.copy()
        swapped[:, f] = v[:, f]
        assert hits[f] == (told(swapped) == label).sum()


def test_permutation_importance_is_that_of_copied_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 4))
    rows = spark.createDataFrame([(i, int(v[0] + 0.5 * v[1] + 0.3 * rng.normal() > 0), v.tolist()) for i, v in enumerate(x)], "structure long, label int, x array<double>")
    model = classify.train_forest(rows, trees=7, maxDepth=4)
    label = np.array([r.label for r in rows.orderBy("structure").collect()])
    trees, n = classify.forest_arrays(model), len(x)
    told = lambda a: np.array([np.round(sum(shares(t, r) for t in trees), 9).argmax() for r in a])
    assert (told(x) == np.array([r.prediction for r in classify.predict(model, rows).orderBy("structure").collect()])).all()
    dice, losses = random.Random(42), []
    for _ in range(2):
        a, b = 1, dice.randrange(n)
        while a == 1 or math.gcd(a, n) > 1:
            a = dice.randrange(2, n)
        donors = (np.arange(n) * a + b) % n
        one = []
        for f in range(4):
            swapped = x.copy()
            swapped[:, f] = x[donors, f]
            one.append((told(x) == label).mean() - (told(swapped) == label).mean())
        losses.append(one)
    got = {r.feature: (r["mean"], r["std"]) for r in classify.permutation_importance(model, rows, repeats=2).collect()}
    for f in range(4):
        assert got[f] == pytest.approx((np.mean(losses, axis=0)[f], np.std(losses, axis=0)[f]), abs=1e-12)
