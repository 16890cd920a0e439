"""Forests whose nodes are split across blocks and finished in tasks, against plain trees."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from fleetgauge.operators import boosting, forest
from fleetgauge.plans import models

FEATURES = ["a", "b", "c"]


def table(spark, n, seed, classes=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    y = 3 * x[:, 0] + np.abs(x[:, 1]) * (x[:, 2] > 0) + rng.normal(size=n)
    if classes:
        y = (y > 1).astype(float)
    rows = [(i, *[None if rng.random() < 0.03 else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3)


def plain(bins, y, w, options, tree, node=0):
    """{node: (feature, border, value)}, row by row; feature -1 at a leaf."""
    level = (node + 1).bit_length() - 1
    n, total = w.sum(), (w * y).sum()
    best = (1e-9, -1, 0)
    if level < options.depth and len(set(y)) > 1:
        tried = forest.drawn(options, len(bins), tree, level)[node - (2**level - 1)]
        for f in np.flatnonzero(tried):
            for border in range(forest.BINS - 1):
                left = bins[f] <= border
                a, b = w[left].sum(), w[~left].sum()
                if a and b:
                    gain = (w * y)[left].sum() ** 2 / a + (w * y)[~left].sum() ** 2 / b - total**2 / n
                    if gain > best[0] + 1e-9:
                        best = (gain, f, border)
    out = {node: (best[1], best[2], total / n)}
    if best[1] >= 0:
        left = bins[best[1]] <= best[2]
        for side, own in ((1, left), (2, ~left)):
            out |= plain(bins[:, own], y[own], w[own], options, tree, 2 * node + side)
    return out


@pytest.mark.parametrize("tried", [2, 3])
def test_a_grown_tree_equals_a_plain_one(monkeypatch, tried):
    monkeypatch.setattr(forest, "NODES", 3)
    rng = np.random.default_rng(6)
    bins = rng.integers(0, 9, (3, 120)).astype(np.uint8)
    y, w = rng.normal(size=120) + bins[0], rng.integers(1, 4, 120).astype(float)
    options = forest.Options(1, 3, tried, 1)  # below, small nodes have equal splits
    found = forest.grow(options, 0, 0, bins, y, w)
    expected = plain(bins, y, w, options, 0)
    assert sorted(found.node.tolist()) == sorted(expected)
    for node, feature, border, value in zip(found.node, found.feature, found.border, found.value):
        assert feature == expected[node][0] and value == pytest.approx(expected[node][2])
        assert feature < 0 or border == expected[node][1]


@pytest.mark.parametrize("classes", [False, True])
def test_large_nodes_split_across_blocks_give_the_same_trees(spark, monkeypatch, classes):
    monkeypatch.setattr(forest, "BLOCK", 20)
    df = table(spark, 400, 7, classes)
    borders, options = boosting.bin_borders(df, FEATURES), forest.Options(5, 7, 2, 3)
    whole = forest.fit_forest(df, FEATURES, borders, "y", options, "id")
    monkeypatch.setattr(forest, "LOCAL", 30)
    monkeypatch.setattr(forest, "TREES_A_JOB", 2)
    parts = forest.fit_forest(df, FEATURES, borders, "y", options, "id")
    for one, other in zip(whole, parts, strict=True):
        reached = one.value != 0
        assert np.array_equal(one.feature, other.feature) and np.array_equal(one.border[one.feature >= 0], other.border[one.feature >= 0])
        assert np.allclose(one.value[reached], other.value[reached]) and np.allclose(one.gains, other.gains)


def test_missing_values_one_value_and_null_labels(spark):
    df = spark.range(30).select("id", F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("b"), F.lit(float("nan")).alias("c"), F.lit(5.0).alias("y"))
    borders, options = boosting.bin_borders(df, FEATURES), forest.Options(4, 3, 3, 1)
    trees = forest.fit_forest(df, FEATURES, borders, "y", options, "id")
    model = forest.Forest.of(FEATURES, borders, False, trees)
    assert model.transform(df).select("prediction").distinct().first()[0] == 5.0
    with pytest.raises(Exception, match="holds null"):
        forest.fit_forest(df.withColumn("y", F.when(F.col("id") > 3, 1.0)), FEATURES, borders, "y", options, "id")


def test_a_saved_forest_scores_as_before(spark, tmp_path):
    df = table(spark, 300, 8, classes=True)
    borders = boosting.bin_borders(df, FEATURES)
    trees = forest.fit_forest(df, FEATURES, borders, "y", forest.Options(6, 5, 2, 1), "id")
    model = PipelineModel([forest.Forest.of(FEATURES, borders, True, trees)])
    model.write().save(str(tmp_path / "m"))
    scores = [sorted(map(str, m.transform(df).select("id", "probability", "prediction").collect())) for m in (model, PipelineModel.load(str(tmp_path / "m")))]
    assert scores[0] == scores[1] and model.stages[0].getNumTrees == 6
    assert model.stages[0].featureImportances.toArray().sum() == pytest.approx(1.0)


def test_a_hundred_deep_trees_take_no_minutes(spark):
    """Spark ML's forest took over 150 seconds for a fit on 100,000 rows."""
    columns = {c: F.rand(i) * 1000 for i, c in enumerate(models.S.RISK_FEATURES)}
    df = spark.range(0, 40_000).select(F.col("id").cast("string").alias("firmware_version"), *[v.alias(c) for c, v in columns.items()])
    df = df.withColumn("error_rate_per_10k", F.col("code_churn_score") + F.rand(9) * 300)
    began = time.monotonic()
    assert models.train_rf_regressor(df).stages[-1].getNumTrees == 100
    assert time.monotonic() - began < 60


def test_a_classifier_fits_on_all_rows(spark, monkeypatch):
    """It took 200,000 of them by a hash of the key."""
    seen, fit = [], forest.fit_forest
    monkeypatch.setattr(forest, "fit_forest", lambda df, *rest: seen.append(df.count()) or fit(df, *rest))
    columns = [(F.col("id") % (k + 2)).cast("double").alias(c) for k, c in enumerate(models.S.RISK_FEATURES)]
    df = spark.range(200_500).select(F.col("id").cast("string").alias("firmware_version"), *columns, (F.col("id") % 2).alias("label"))
    model = models.train_rf_classifier(df, trees=2, depth=3).stages[-1]
    assert seen == [200_500] and model.getNumTrees == 2


def test_blocks_hold_every_row_and_a_hot_cell_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 50)
    hot = F.col("id") < 900
    df = spark.range(1000).select("id", *[F.when(hot, 1.0).otherwise(F.col("id") % k).alias(c) for c, k in zip(FEATURES, (7, 5, 3))], (F.col("id") % 4).cast("double").alias("y"))
    packed, rows, cells = forest._blocks(df, FEATURES, boosting.bin_borders(df, FEATURES), "y", "id")
    blocks = [(np.frombuffer(r.n, np.int64), np.frombuffer(r.y, float)) for r in packed.collect()]
    assert rows == sum(n.sum() for n, _ in blocks) == 1000 and 1 < cells <= 101
    assert sum((n * y).sum() for n, y in blocks) == 1500 and max(n.sum() for n, _ in blocks) < 200


def test_trees_grown_on_cells_equal_those_on_rows():
    rng = np.random.default_rng(9)
    bins = rng.integers(0, 4, (3, 500)).astype(np.uint8)
    y, w = rng.normal(size=500) + bins[0], rng.integers(1, 4, 500).astype(float)
    cells, place = np.unique(bins, axis=1, return_inverse=True)
    n, total = np.bincount(place.ravel(), w), np.bincount(place.ravel(), w * y)
    options = forest.Options(1, 4, 2, 5)
    rows, summed = forest.grow(options, 0, 0, bins, y, w), forest.grow(options, 0, 0, cells, total / n, n)
    assert all(np.allclose(a, b) for a, b in zip(rows, summed, strict=True))


def test_weights_are_poisson_draws():
    n = np.array([1] * 400_000 + [3] * 100_000)
    w = forest.poisson(np.random.default_rng(1), n)
    for own, mean in ((w[:400_000], 1), (w[400_000:], 3)):
        assert own.mean() == pytest.approx(mean, rel=0.01) and own.var() == pytest.approx(mean, rel=0.02)
    share = np.random.default_rng(2).random(400_000)
    assert np.array_equal(forest.poisson(np.random.default_rng(2), n[:400_000]), np.searchsorted(forest.ONCE, share, "right"))


def test_scores_kept_from_earlier_batches_are_those_of_each_row(monkeypatch):
    monkeypatch.setattr(boosting, "CELLS", 30)
    rng = np.random.default_rng(4)
    bins, y = rng.integers(0, 5, (3, 300)).astype(np.uint8), rng.normal(size=300)
    options, heap = forest.Options(1, 4, 3, 1), 2**5 - 1
    tree = forest.Tree(np.full(heap, -1, np.int8), np.zeros(heap, np.uint8), np.zeros(heap), np.zeros(3))
    grown = forest.grow(options, 0, 0, bins, y + bins[0], np.ones(300))
    tree.feature[grown.node], tree.border[grown.node], tree.value[grown.node] = grown.feature, grown.border, grown.value
    sides = forest.full([tree])
    borders = [[0.5, 1.5, 2.5, 3.5]] * 3
    batches = [[pd.Series(c) for c in rng.integers(0, 5, (3, 40)).astype(float)] for _ in range(5)]
    batches[2][1][7] = np.nan
    for columns, found in zip(batches, boosting.by_cell(iter(batches), borders, lambda b: boosting.walked(b, *sides)), strict=True):
        for row, got in enumerate(found):
            node, own = 0, [0 if np.isnan(c[row]) else 1 + int(c[row]) for c in columns]
            while tree.feature[node] >= 0:
                node = 2 * node + 1 + (own[tree.feature[node]] > tree.border[node])
            assert got == pytest.approx(tree.value[node])
