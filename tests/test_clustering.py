"""Exact clustering against plain versions over all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua.operators import cluster, density, planar, spectral, ward


def frame(spark, points, more=()):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(len(points) + k, *p) for k, p in enumerate(more)]
    return spark.createDataFrame(rows, "id long, z1 double, z2 double").repartition(3)


def clumps(seed, n, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.uniform(-3, 3, (5, 2))
    points = [centres[i % 5] + r.normal(0, spread, 2) for i in range(n * 2 // 3)] + list(r.uniform(-4, 4, (n - n * 2 // 3, 2)))
    return np.array(points)


def density_labels(points, radius, min_samples, min_size):
    near = np.square(points[:, None] - points[None]).sum(axis=2) <= radius * radius
    core = near.sum(axis=1) >= min_samples
    label, number = np.full(len(points), -1), 0
    seen = ~core
    for i in range(len(points)):
        if seen[i]:
            continue
        group, stack = [], [i]
        seen[i] = True
        while stack:
            p = stack.pop()
            group.append(p)
            for q in np.flatnonzero(near[p] & core & ~seen):
                seen[q] = True
                stack.append(q)
        if len(group) >= min_size:
            label[group] = number
            number += 1
    return label


def of(df):
    return np.array([r.cluster for r in df.orderBy("id").collect()])


@pytest.mark.parametrize("seed, leaf, settings", [(1, 2048, [(0.3, 5, 10)]), (2, 8, [(0.6, 40, 5)])])
def test_density_is_that_of_all_pairs(spark, seed, leaf, settings):
    """Also with cells that are cut into leaves, and a spot that very many points share."""
    points = np.concatenate([clumps(seed, 420), np.tile(clumps(seed, 1), (60, 1)), np.random.default_rng(seed).normal(6, 0.05, (150, 2))])
    for radius, samples, size in settings:
        got = of(cluster.density(frame(spark, points), radius, samples, size, leaf))
        assert (got == density_labels(points, radius, samples, size)).all()


def test_density_of_points_on_borders(spark):
    """Points exactly a radius apart are neighbours; coordinates without a value are noise."""
    points = np.array([(x * 0.5, y * 0.5) for x in range(7) for y in range(7)])
    got = of(cluster.density(frame(spark, points, [(None, 1.0), (float("nan"), 0.0)]), 0.5, 5, 1))
    assert (got[:49] == density_labels(points, 0.5, 5, 1)).all() and (got[49:] == -1).all()
    assert cluster.density(frame(spark, []), 0.5, 5, 1).count() == 0


def test_nearest_core_is_that_of_all_pairs(spark):
    points, new = clumps(6, 500), clumps(6, 300)[::-1] + 0.01
    labels = density_labels(points, 0.3, 5, 5)
    fitted = spark.createDataFrame([(i, float(x), float(y), int(c)) for i, ((x, y), c) in enumerate(zip(points, labels))], "id long, z1 double, z2 double, cluster int")
    got = of(cluster.nearest_core(frame(spark, new, [(None, 0.0)]), fitted, 0.3, 20))
    d = np.square(new[:, None] - points[labels >= 0][None]).sum(axis=2)
    want = np.where(d.min(axis=1) <= 0.09, labels[labels >= 0][d.argmin(axis=1)], -1)
    assert (got[:-1] == want).all() and got[-1] == -1 and len(set(want)) > 2


def test_leaf_pairs_do_not_grow_with_the_square(spark):
    """Two full cells side by side: a few pairs of leaves settle the link, and no step makes a row per pair of points."""
    points = np.random.default_rng(4).uniform(0, 0.2, (4000, 2)) + np.repeat([[0, 0], [0.21, 0]], 2000, axis=0)
    g = density.grid(frame(spark, points), 0.3, 5, leaf=50)
    leaves = g.spots.groupBy("cx", "cy", "leaf").count()
    assert leaves.agg(F.max("count")).first()[0] <= 51 and leaves.count() <= 200
    assert set(of(cluster.density(frame(spark, points), 0.3, 5, 5, 50))) == {0}


def test_density_sweep_shares_a_grid(spark):
    points = clumps(5, 300)
    got = {(r.min_samples, r.min_size): (r.clusters, r.noise) for r in cluster.density_sweep(frame(spark, points), 0.3, [3, 6], [12]).collect()}
    for (samples, size), (n, noise) in got.items():
        want = density_labels(points, 0.3, samples, size)
        assert (n, noise) == (want.max() + 1, (want < 0).sum())


def greedy_ward(x, w, k):
    """One closest pair at a time."""
    x, w, label = x.copy(), w.astype(float), np.arange(len(x))
    d = ward.growth(x, w, x, w)
    np.fill_diagonal(d, np.inf)
    for _ in range(len(x) - k):
        i, j = sorted(divmod(int(d.argmin()), len(x)))
        x[i] = (x[i] * w[i] + x[j] * w[j]) / (w[i] + w[j])
        w[i] += w[j]
        label[label == j] = i
        d[j], d[:, j] = np.inf, np.inf
        open_ = np.isfinite(d[i])
        fresh = ward.growth(x[i : i + 1], w[i : i + 1], x, w)[0]
        d[i, open_] = d[open_, i] = fresh[open_]
    return label


def same_groups(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("n, leaf, k", [(1500, 100, 9), (700, 2048, 2), (1, 64, 3)])
def test_ward_is_that_of_one_pair_at_a_time(spark, n, leaf, k):
    points = clumps(n + k, n) if n > 1 else np.zeros((1, 2))
    points = np.concatenate([points, points[: n // 10]])  # some places twice
    got = of(ward.hierarchical(frame(spark, points), k, leaf))
    places, at, weight = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    want = greedy_ward(places, weight, min(k, len(places)))[at.ravel()]
    assert same_groups(got, want)
    assert got.min() == 0 and got[np.lexsort((points[:, 1], points[:, 0]))[0]] == 0  # numbered by place


def test_a_leaf_merges_only_what_nothing_outside_can_disturb():
    x = np.array([[0.0, 0.0], [0.1, 0.0], [1.0, 0.0], [1.3, 0.0]])
    merges, alive = ward.merge_leaf(np.arange(4), x.copy(), np.ones(4), (-np.inf, 1.4, -np.inf, np.inf), 1.0)
    assert [m[:2] for m in merges] == [(0, 1)] and list(alive) == [0, 2, 3]
    merges, alive = ward.merge_leaf(np.arange(4), x.copy(), np.ones(4), (-np.inf, np.inf, -np.inf, np.inf), 1.0)
    assert len(merges) == 3 and sorted(m[2] for m in merges) == [m[2] for m in merges]


def test_leaves_of_the_plane(spark):
    points = clumps(3, 500)
    rows = frame(spark, points).withColumn("g", F.col("id") % 2)
    cut = planar.kd_leaves(rows, 20, "g")
    assert cut.count() == 500 and cut.groupBy("g", "strip", "leaf").count().agg(F.max("count")).first()[0] <= 21
    boxes = [tuple(r)[3:] for r in cut.where("g = 0").groupBy("g", "strip", "leaf").agg(F.min("z1"), F.max("z1"), F.min("z2"), F.max("z2")).collect()]
    apart = lambda a, b: a[1] < b[0] or b[1] < a[0] or a[3] < b[2] or b[3] < a[2]
    assert all(apart(a, b) for i, a in enumerate(boxes) for b in boxes[:i])


def test_spectral_agrees_with_dense_matrices(spark):
    r = np.random.default_rng(2)
    points = np.concatenate([r.normal((0, 0), 0.5, (120, 2)), r.normal((3.2, 0.5), 0.5, (90, 2)), [[8.0, 8.0], [-6.0, 3.0]]])
    found = spectral.spectrum(frame(spark, points), 4)
    k = np.exp(-np.square(points[:, None] - points[None]).sum(axis=2))
    assert found.error < 1e-3 and found.landmarks < 1024
    d = k.sum(axis=1)
    values, vectors = np.linalg.eigh(k / np.sqrt(d[:, None] * d[None]))
    assert np.allclose(found.values, values[::-1][:4], atol=len(points) * found.error / d.min())
    assert np.allclose(found.values, values[::-1][:4], atol=1e-4)
    got = np.array([x.vector for x in found.rows.orderBy("id").collect()])
    want = vectors[:, ::-1][:, :4] / np.sqrt(d)[:, None]
    # Leading values of 1 have a common space: compare the spaces.
    q = np.linalg.qr(want * np.sqrt(d)[:, None])[0]
    own = got * np.sqrt(d)[:, None]
    assert np.allclose(q @ (q.T @ own), own, atol=1e-3)


def test_spectral_clusters_rings_of_density(spark):
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal((0, 0), 0.4, (80, 2)), r.normal((4, 0), 0.4, (50, 2))])
    got = of(cluster.spectral(frame(spark, points, [(None, 0.0)]), 2))
    assert (got[:80] == 0).all() and (got[80:130] == 1).all() and got[130] == -1
    assert cluster.spectral(frame(spark, []), 2).count() == 0


def test_spectral_holds_a_slice_of_a_batch_at_a_time(spark):
    """A partition of 20,000 points comes in two batches; workers make no matrix of a batch's points."""
    rows = spark.range(20_000, numPartitions=1).select("id", (F.col("id") % 100 / 25).alias("z1"), (F.col("id") % 7 / 5).alias("z2"))
    sizes = spectral._summed(rows, lambda x: np.array([[len(x), len(x) > 600]], float), 1)
    assert sizes.tolist() == [[20_000, 0]]
    found = spectral.spectrum(rows, 2)
    assert found.rows.select("id").distinct().count() == 20_000 and abs(found.values[0] - 1) < 1e-4


def test_spectral_affinities_of_a_slice():
    x, marks = np.random.default_rng(5).normal(size=(300, 2)), np.random.default_rng(6).normal(size=(90, 2))
    assert (spectral._near(x, marks, 0.7) == np.exp(-0.7 * np.square(x[:, None] - marks[None]).sum(axis=2))).all()
    frames = [pd.DataFrame({"id": range(n), "z1": 1.0, "z2": range(n)}) for n in (0, 10_000, 3)]
    cut = list(spectral._slices(frames))
    assert max(len(x) for _, x in cut) == spectral.SLICE and sum(len(x) for _, x in cut) == 10_003
    assert [i for ids, _ in cut for i in ids] == [v for _, x in cut for v in x[:, 1]] == [*range(10_000), 0, 1, 2]
