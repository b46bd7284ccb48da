"""Trees of the regression forest: grown to the end, over values rather than bins, bounded nodes in a task."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import forest, models
from tessera.plans import studies


def brute(x, y, n, depth):
    gains = np.zeros(len(x))
    if depth == 0 or y.min() == y.max():
        return gains
    total, best = (n * y).sum(), None
    for f in range(len(x)):
        for v in np.unique(x[f])[:-1]:
            left = x[f] <= v
            a, b = (n * y)[left].sum(), n[left].sum()
            gain = a * a / b + (total - a) ** 2 / (n.sum() - b)
            if best is None or gain > best[0]:
                best = (gain, f, left)
    if best is None:
        return gains
    gain, f, left = best
    gains[f] = gain - total ** 2 / n.sum()
    for side in (left, ~left):
        gains += brute(x[:, side], y[side], n[side], depth - 1)
    return gains


def data(rows=300):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3, rows))
    x[1] = np.round(x[1], 1)
    return x, x[0] * x[1] + rng.normal(size=rows), rng.integers(1, 4, rows).astype(np.uint8)


def test_growing_is_the_greedy_search():
    x, y, n = data()
    for depth in (1, 2, 4):
        got, want = forest.grow(x, y, n, depth, np.random.default_rng(0)), brute(x, y, n.astype(float), depth)
        assert got.sum() == pytest.approx(want.sum())
        assert depth > 1 or got == pytest.approx(want)  # deeper, several features may be as good
    whole = forest.grow(x, y, n, None, np.random.default_rng(0))
    assert whole.sum() == pytest.approx((n * (y - np.average(y, weights=n)) ** 2).sum())  # every leaf is pure
    assert not forest.grow(np.zeros((2, 5)), np.arange(5.0), np.ones(5, np.uint8), None, np.random.default_rng(0)).any()


def test_the_ranking_has_no_depth_limit():
    assert inspect.signature(studies.feature_ranking).parameters["forest_depth"].default is None
    assert models.forest_regressor(["a"], "y")[-1].max_depth is None


def test_details_below_depth_twelve_count(spark):
    # y changes sign from row to row of "a": a tree of depth 12 is blind to it, one grown to the end is not
    d = spark.range(0, 20000, numPartitions=3).select(F.col("id").cast("double").alias("a"), (F.xxhash64("id") % 2).cast("double").alias("b"),
                                                      (F.col("id") % 2 + (F.col("id") > 9999).cast("double") / 10).alias("y"))
    cut = models.fit_pipeline(d, models.forest_regressor(["a", "b"], "y", 2, max_depth=3)).stages[-1].featureImportances
    whole = models.fit_pipeline(d, models.forest_regressor(["a", "b"], "y", 2)).stages[-1].featureImportances
    assert sum(whole) == pytest.approx(1.0) and whole[0] > 0.9 and sum(cut) == pytest.approx(1.0)


def test_large_nodes_are_split_by_all_tasks(spark, monkeypatch):
    x, _, _ = data(6000)
    y = 3 * x[0] + 2 * x[1] + x[2] / 2
    d = spark.createDataFrame([(*map(float, c), float(v)) for c, v in zip(x.T, y)], "a double, b double, c double, y double").repartition(3)
    alone = models.fit_pipeline(d, models.forest_regressor(["a", "b", "c"], "y", 3)).stages[-1].featureImportances.toArray()
    held = []
    grow_nodes = forest._grow_nodes
    monkeypatch.setattr(forest, "NODE_VALUES", 3000)
    monkeypatch.setattr(forest, "HISTOGRAM_BYTES", 4 * 2 * 3 * forest.BINS * 8)  # four nodes at once
    monkeypatch.setattr(forest, "_grow_nodes", lambda w, tops, *a: held.append(sum(e == 0 and f < 0 for e, f in zip(tops[0].end, tops[0].feature))) or grow_nodes(w, tops, *a))
    cut = models.fit_pipeline(d, models.forest_regressor(["a", "b", "c"], "y", 3)).stages[-1].featureImportances.toArray()
    assert min(held) >= 6 and cut == pytest.approx(alone, abs=0.03)
    assert models.fit_pipeline(d, models.forest_regressor(["a", "b", "c"], "y", 3)).stages[-1].featureImportances.toArray() == pytest.approx(cut, abs=1e-9)
    shallow = models.fit_pipeline(d, models.forest_regressor(["a", "b", "c"], "y", 3, max_depth=2)).stages[-1].featureImportances.toArray()
    assert shallow.sum() == pytest.approx(1.0)


def test_unknown_values(spark):
    d = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (float("nan"), 2.0), (3.0, 5.0)] * 30, "a double, y double")
    assert models.fit_pipeline(d, models.forest_regressor(["a"], "y", 3)).stages[-1].featureImportances.toArray().tolist() == [1.0]
    with pytest.raises(ValueError):
        models.fit_pipeline(d.withColumn("y", F.lit(None).cast("double")), models.forest_regressor(["a"], "y", 3))


def test_draws_are_poisson():
    n = forest.bootstrap(np.arange(200_000), 1, 42)
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02
    assert abs(np.corrcoef(n, forest.bootstrap(np.arange(200_000), 2, 42))[0, 1]) < 0.01
