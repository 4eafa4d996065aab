"""The inverted-list index against all pairs, and merged states against exact figures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import lists, sketches


@pytest.mark.parametrize("tile, probes", [(2_048, 4), (16, 1)])
def test_index_search_is_exact(spark, monkeypatch, tile, probes):
    monkeypatch.setattr(lists, "TILE", tile)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 3
    v = np.concatenate([centres[0] + rng.normal(size=(120, 8)) * 0.1, *(c + rng.normal(size=(30, 8)) for c in centres)]).astype(np.float32)
    v[5] = v[6]
    n = len(v)
    bad = [(n, None), (n + 1, [0.0] * 8), (n + 2, [1.0] * 7), (n + 3, [float("nan")] + [1.0] * 7), (n + 4, [None] * 8)]
    df = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), *bad], "vid long, vec array<float>")
    index = lists.VectorLists(df, "vid", "vec", 8)
    assert index.sizes.sum() == n and index.members.filter("list = 0").count() == index.sizes[0]
    got: dict = {}
    for r in index.search(df.withColumnRenamed("vid", "q"), "q", "vec", 5, probes).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.item_id)
    x = v.astype(float)
    score = x @ x.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None] + 1e-9)
    want = np.argsort(-score, axis=1, kind="stable")[:, :5]
    same = [np.allclose(score[q, got[q]], score[q, want[q]], atol=1e-12, rtol=0) for q in range(n)]
    assert set(got) == set(range(n)) and all(same)


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "vid long, vec array<float>")
    index = lists.VectorLists(none, "vid", "vec", 8)
    assert index.search(none.withColumnRenamed("vid", "q"), "q", "vec", 3).count() == 0


def test_merged_states_are_near_the_truth(spark):
    rows = spark.range(60_000).select((F.col("id") % 30).cast("int").alias("day"), F.pmod(F.xxhash64("id"), F.lit(5_000)).alias("who"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) / 1e6).alias("x"))
    states = sketches.daily_states(rows, ["day"], "who", "x").withColumn("month", F.lit(1))
    assert states.count() == 30
    one = sketches.estimates(sketches.merged_states(states, ["month"]), (0.1, 0.5, 0.99)).first()
    assert abs(one["distinct"] - 5_000) < 0.06 * 5_000 and abs(one.q10 - 0.1) < 0.02 and abs(one.q50 - 0.5) < 0.02 and abs(one.q99 - 0.99) < 0.02
