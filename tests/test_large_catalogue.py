"""Work that must not grow with rows that share a name or a class."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions.mathx import cosine
from strideframe.operators import names, vectors


def test_fuzzy_lookup_matches_each_name_once(spark, monkeypatch):
    """A thousand rows of one name were each exploded into their substrings and paired with every needle."""
    seen = []
    whole = names.contained
    monkeypatch.setattr(names, "contained", lambda needles, needle, hay, name: seen.append(hay.count()) or whole(needles, needle, hay, name))
    catalogue = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "red squat").otherwise("low squat").alias("title"))
    asked = spark.createDataFrame([("squat",), ("low squat",), ("none",)], "asked string")
    got = {r.asked: (r.id, r.title, r.exact) for r in names.lookup_fuzzy(asked, catalogue, "asked", "title", [F.desc("id")]).collect()}
    assert got == {"squat": (999, "low squat", False), "low squat": (999, "low squat", True)}
    assert seen == [2]


def test_scored_pairs_meet_as_blocks(spark):
    """Every pair carried both vectors; only blocks do now, and with ``k`` no more than a user's best become rows."""
    users = spark.createDataFrame([(1, ["a", "b"], "beginner", [1.0, 2.0]), (2, [], "advanced", [0.0, 1.0]), (3, ["a"], "advanced", None), (4, ["b"], None, [1.0, None])], "user_id long, equipment array<string>, level string, qv array<float>")
    items = spark.range(300).select(
        F.col("id").alias("exercise_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("自重"))).alias("equipment"), F.lit("intermediate").alias("difficulty"),
        F.array(F.col("id") % 7 + 1, F.col("id") % 5).cast("array<float>").alias("ev"), (F.col("id") % 4 / 10).alias("bonus"))
    pairs = vectors.eligible(users, items)
    assert sorted(map(tuple, pairs.collect())) == [(u, i) for u in (1, 2, 3, 4) for i in range(300) if (i % 3 == 0) == (u != 2)]
    want = pairs.join(users, "user_id").join(items, "exercise_id").select("user_id", "exercise_id", cosine(F.col("qv"), F.col("ev")).alias("similarity")).join(items.select("exercise_id", "bonus"), "exercise_id")
    want = {(r.user_id, r.exercise_id): (r.similarity, None if r.similarity is None else r.similarity + r.bonus) for r in want.collect()}
    got = {(r.user_id, r.exercise_id): (r.similarity, r.score) for r in vectors.scored(users, items, "qv", "ev", [F.col("bonus")]).collect()}
    assert got == want
    few = vectors.scored(users, items, "qv", "ev", [F.col("bonus")], 3)
    assert few.count() == 12
    best = [tuple(r) for r in few.filter("user_id < 3").orderBy("user_id", F.desc("score"), "exercise_id").select("user_id", "exercise_id").collect()]
    assert best == [(u, i) for u in (1, 2) for i in sorted((i for v, i in want if v == u), key=lambda i: (-want[u, i][1], i))[:3]]
