"""Trees grown by tasks: whole forests and boosted ensembles, against brute force and Spark ML's own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from strideframe.operators import learn, trees
from strideframe.plans.registry import Tables, load_all


def _data(spark, n=300):
    rng = np.random.default_rng(3)
    y = np.arange(n) % 3
    x = rng.normal(size=(n, 4)) + (y[:, None] == np.arange(4)) * 2.0
    df = spark.createDataFrame([(*map(float, r), float(c)) for r, c in zip(x, y)], "a double, b double, c double, d double, label_idx double")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df.withColumn("weight", F.lit(1.0)))


def _accuracy(model, df):
    return model.transform(df).agg(F.avg((F.col("prediction") == F.col("label_idx")).cast("double"))).first()[0]


def test_whole_forest_grows_in_tasks(spark, monkeypatch):
    """Spark ML would shuffle a table of statistics for every node of 200 trees of depth 12."""
    df = _data(spark)
    theirs = RandomForestClassifier(numTrees=20, maxDepth=5, minInstancesPerNode=2, labelCol="label_idx", weightCol="weight", seed=42).fit(df)

    def never(self, rows):
        raise AssertionError("Spark ML was asked")

    monkeypatch.setattr(RandomForestClassifier, "_fit", never)
    model = learn.forest().fit(df)
    assert model.trees == 200
    row = model.transform(df).select("rawPrediction", "probability", "prediction").first()
    assert abs(sum(row.rawPrediction) - 200) < 1e-3 and abs(sum(row.probability) - 1) < 1e-5 and row.prediction == float(np.argmax(row.rawPrediction))
    assert _accuracy(model, df) > 0.9
    assert _accuracy(learn.forest(20, 5).fit(df), df) > _accuracy(theirs, df) - 0.05


def test_rows_too_many_for_a_task_go_to_spark_ml(spark, monkeypatch):
    monkeypatch.setattr(trees, "MOST_BYTES", 100)
    df = _data(spark, 60)
    assert isinstance(learn.forest(2, 2).fit(df), RandomForestClassificationModel)
    assert isinstance(learn.boosted(1, 1).fit(df), OneVsRestModel)


def test_comparison_boosts_in_full(spark, monkeypatch):
    """200 rounds of depth 8, as the reference fits them; three rounds of depth 3 were fitted before."""
    seen = {}
    monkeypatch.setattr(learn, "compare", lambda df, features, label, keys, models: seen.update(models))
    load_all()["o10_model_comparison"].plan(Tables(spark, "/root/testdata/sf0.001"))
    assert (seen["boosted"].rounds, seen["boosted"].depth) == (200, 8)
    assert (seen["forest"].getNumTrees(), seen["forest"].getMaxDepth()) == (200, 12)
    df = _data(spark)
    model = learn.boosted(5, 3).fit(df)
    theirs = OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=3, seed=42), labelCol="label_idx").fit(df)
    assert model.trees == 15 and abs(_accuracy(model, df) - _accuracy(theirs, df)) < 0.03


@pytest.mark.parametrize("least", [1, 4])
def test_both_split_searches_agree(least):
    rng = np.random.default_rng(5)
    n, m, classes = 400, 7, 3
    node, bins, y = rng.integers(0, m, n), rng.integers(0, trees.BINS, n), rng.integers(0, classes, n)
    node[:m] = np.arange(m)
    copies = rng.integers(1, 4, n).astype(float)
    w = copies * 0.5
    total = np.bincount(node * classes + y, w, m * classes).reshape(m, classes)
    args = (node * trees.BINS + bins, y, w, copies, m, total, total.sum(1), least)
    one, two = trees._table_gains(*args), trees._sorted_gains(*args)
    assert np.allclose(one[0], two[0])
    for i in range(m):
        best = 0.0
        for c in range(trees.BINS):
            a, b = (node == i) & (bins <= c), (node == i) & (bins > c)
            if copies[a].sum() >= least and copies[b].sum() >= least:
                best = max(best, sum((np.bincount(y[s], w[s], classes) ** 2).sum() / w[s].sum() for s in (a, b)))
        assert np.isclose(one[0][i], best)


def test_mean_tree_splits_as_brute_force():
    rng = np.random.default_rng(7)
    x, g = rng.integers(0, trees.BINS, (3, 200)).astype(np.uint8), rng.normal(size=200)
    tree, where = trees.grow_mean_tree(x, g, 3)
    assert (tree.leaves(x) == where).all()
    at = {0: np.arange(200)}
    for i in range(len(tree.feature)):
        rows = at[i]
        assert np.isclose(tree.value[i], g[rows].mean())
        gain = {}
        for f in range(3):
            for c in range(trees.BINS):
                lo = x[f, rows] <= c
                if lo.any() and not lo.all():
                    gain[f, c] = g[rows[lo]].sum() ** 2 / lo.sum() + g[rows[~lo]].sum() ** 2 / (~lo).sum()
        if tree.feature[i] >= 0:
            assert np.isclose(gain[tree.feature[i], tree.cut[i]], max(gain.values()))
            lo = x[tree.feature[i], rows] <= tree.cut[i]
            at[tree.left[i]], at[tree.left[i] + 1] = rows[lo], rows[~lo]
