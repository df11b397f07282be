"""Grouped quantiles and correlations by blocks against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.operators import ranges, selection


def test_group_quantiles_are_exact(spark):
    """Groups that are counted whole, and one of more values than its sketch keeps."""
    r = np.random.default_rng(1)
    groups = {0: r.normal(size=6000), 1: r.integers(0, 3, 5000).astype(float), 2: r.normal(size=7), 3: np.array([2.5]), 4: np.array([1.0, 2.0]), 5: np.full(4500, 7.0)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(2, None), (9, None)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(5)
    for share in (0.5, 0.0, 0.95, 1.0):
        got = {x.g: x.quantile for x in ranges.group_quantiles(df, "g", "v", share, accuracy=500).collect()}
        assert got.keys() == groups.keys()
        assert all(got[g] == pytest.approx(np.quantile(v, share), abs=1e-12) for g, v in groups.items())


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_quantiles_by_brackets(spark, kind):
    """Brackets that are drawn several times, values that very many rows share, and a handful of rows."""
    r = np.random.default_rng(2)
    values = {"spread": r.normal(size=9000), "ties": np.concatenate([np.full(5000, 1.0), r.integers(0, 4, 4000)]), "few": np.array([3.0, 1.0, 2.0])}[kind]
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "v double").repartition(4)
    shares = [0.25, 0.5, 0.75, 0.95, 0.0, 1.0]
    assert ranges.quantiles(df, "v", shares, most=40, accuracy=300) == pytest.approx([np.quantile(values, s) for s in shares], abs=1e-12)
    assert ranges.quantiles(df.where("v is null"), "v", [0.5]) == [None]


def table(spark, values):
    rows = [(s, f, None if np.isnan(v) else float(v)) for s, row in enumerate(values) for f, v in enumerate(row)]
    return spark.createDataFrame(rows, "structure long, feature long, value double").repartition(3)


def correlated(values, threshold):
    filled = np.where(np.isnan(values), np.nanmedian(values, axis=0), values)
    with np.errstate(all="ignore"):
        r = np.corrcoef(filled.T)
    return {(i, j): r[i, j] for i in range(len(r)) for j in range(i + 1, len(r)) if r[i, j] > threshold}


@pytest.mark.parametrize("block", [4, 512])
def test_correlations_by_blocks(spark, block):
    r = np.random.default_rng(block)
    base = r.normal(size=(90, 5))
    values = np.concatenate([base + r.normal(0, s, (90, 5)) for s in (0.05, 0.2, 0.6)] + [np.full((90, 1), 3.0), -base[:, :1]], axis=1)
    values[r.random(values.shape) < 0.05] = np.nan
    got = {(x.a, x.b): x.r for x in selection.gram_pairs(table(spark, values), 0.8, block).collect()}
    want = correlated(values, 0.8)
    assert got.keys() == want.keys() and len(want) >= 5
    assert all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


def test_ruled_out_blocks_hold_no_correlations():
    """Blocks of features around one direction each; the angles leave few pairs of blocks, and all that matter."""
    r = np.random.default_rng(3)
    centres = np.linalg.qr(r.normal(size=(40, 6)))[0].T
    z = np.concatenate([c + r.normal(0, 0.03, (8, 40)) for c in centres])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    pivots = z[::12]
    order = [(k, list(np.arccos(np.clip(z[k] @ pivots.T, -1, 1)))) for k in range(len(z))]
    open_ = selection.open_blocks(order, 8, 0.9)
    high = z @ z.T > 0.9
    assert {(i // 8, j // 8) for i, j in zip(*np.nonzero(high)) if i <= j} <= set(open_)
    assert len(open_) <= 8 < 21


def test_odd_tables_by_blocks(spark):
    assert selection.gram_pairs(table(spark, np.zeros((0, 0))), 0.5).count() == 0
    assert selection.gram_pairs(table(spark, np.ones((5, 3))), 0.5).count() == 0
    assert selection.gram_pairs(table(spark, np.arange(10.0).reshape(5, 2)).withColumn("feature", F.col("feature").cast("string")), 0.5).select("a", "b").collect() == [("0", "1")]
