"""A forest that the driver cannot hold at once is fitted in parts, which vote together."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import learn


def test_forest_in_parts(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"), (F.col("id") % 2).cast("double").alias("x"))
    parts = learn._parts(learn.forest(trees=3, depth=2), 60, 16)
    assert [p.getNumTrees() for p in parts] == [2, 1] and len({p.getSeed() for p in parts}) == 2
    out = learn.out_of_fold(df, ["x"], "label", ["id"], learn.forest(trees=3, depth=2), 2, nodes=16)
    rows = out.select("id", "label", "fold", "predicted", "confidence").collect()
    assert sorted(r.id for r in rows) == list(range(60))
    assert all(r.predicted == r.label and 0.5 < r.confidence <= 1.0 for r in rows)


def test_cross_validation_reads_a_written_table(spark, monkeypatch):
    """Each fold and tree level reads rows, not the joins and windows behind them."""
    plans = []

    def fit(self, rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return type("Fitted", (), {"avgMetrics": [1.0]})()

    monkeypatch.setattr(learn.CrossValidator, "fit", fit)
    df = spark.range(40).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"), F.col("id").cast("double").alias("x"))
    assert learn.compare(df, ["x"], "label", ["id"], {"forest": learn.forest(2, 2)}).first().accuracy == 1.0
    assert len(plans) == 1 and not any(word in plans[0] for word in ("Join", "Window", "Aggregate"))
