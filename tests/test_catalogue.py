"""Name resolution, text rules, plan checks and learning on hand-made cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strideframe.functions import text, timex
from strideframe.functions.sqlfuncs import register_sql
from strideframe.operators import catalog, learn, names, vectors

CATALOGUE = ["平板卧推", "上斜卧推", "史密斯深蹲", "史密斯机深蹲", "跑步", "跑步机慢跑", "高位下拉", "引体向上", "绳索夹胸", "卷腹", "悬垂举腿", "哑铃卧推"]
CASES = {
    "史密斯深蹲": "史密斯深蹲", "史密斯机深蹲": "史密斯机深蹲", "杠铃平板卧推": "平板卧推", "跑步机": "跑步", "卧推": "平板卧推", "高位下拉机": "高位下拉", "绳索夹胸训练": "绳索夹胸", "腹部卷腹": "卷腹", "龙门架飞鸟": "龙门架飞鸟",
}


def test_nine_name_cases(spark):
    cat = spark.createDataFrame(list(enumerate(CATALOGUE)), "ord int, cn string")
    got = {r.n: r.matched for r in names.resolve(spark.createDataFrame([(n,) for n in CASES], "n string"), cat, "n", "cn", "ord").collect()}
    assert got == CASES


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_resolution_equals_all_pairs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
    cat, seen = [word() for _ in range(25)], sorted({word() for _ in range(60)})
    got = {r.n: r.matched for r in names.resolve(spark.createDataFrame([(n,) for n in seen], "n string"), spark.createDataFrame(list(enumerate(cat)), "ord int, c string"), "n", "c", "ord").collect()}
    for n in seen:
        part = [c for c in cat if (n in c or c in n) and abs(len(n) - len(c)) <= 3]
        near = min(cat, key=lambda c: (levenshtein(n, c), cat.index(c)))
        want = n if n in cat else part[0] if part else near if levenshtein(n, near) <= 2 else n
        assert got[n] == want


def test_alias_parts_and_order(spark):
    m = spark.createDataFrame([("ex_1", "健身车/动感单车", 1), ("ex_2", "单车", 2), ("ex_3", "划船", 3)], "id string, title string, o int")
    seen = spark.createDataFrame([("动感单车",), ("ex_3",), ("坐姿划船",), ("车",), ("",)], "n string")
    got = {r.n: r.id for r in names.resolve_alias(seen, names.alias_table(m, "id", "title", "o"), "n", "id", "title").collect()}
    assert got == {"动感单车": "ex_1", "ex_3": "ex_3", "坐姿划船": "ex_3", "车": "ex_1", "": None}


def test_text_rules(spark):
    df = spark.createDataFrame([("10 12 8",), ("",), (None,), ("x 5",), ("abc",)], "r string")
    got = [tuple(r) for r in df.select(text.reps_sets(F.col("r")), text.reps_sum(F.col("r"))).collect()]
    assert got == [(3, 30), (None, None), (None, None), (1, 5), (None, None)]
    df = spark.createDataFrame([("Unknown_bike",), (" 未知动作 ",), (None,), ("row",)], "s string")
    assert [r[0] for r in df.select(text.is_unknown(F.col("s"))).collect()] == [True, True, True, False]
    clocks = spark.createDataFrame([("01:02:03",), ("2:30.5",), ("7",), ("x",)], "s string")
    assert [r[0] for r in clocks.select(timex.clock_to_sec(F.col("s"))).collect()] == [3723.0, 150.5, 7.0, None]
    ids = spark.createDataFrame([(["abdominals_obliques", "lats?", "zzz", "lats"],)], "a array<string>")
    valid = F.array(*[F.lit(x) for x in ("abdominals", "obliques", "lats")])
    assert ids.select(text.split_ids(F.col("a"), valid)).first()[0] == ["abdominals", "obliques", "lats"]


def test_equipment_tags(spark):
    want = {"Barbell Bench Press": ["杠铃", "训练凳"], "Push-Up": ["自重"], "Cable Fly": ["缆绳机", "训练凳"], "Dumbbell Curl": ["哑铃"], "Plank With Band": ["自重", "弹力带"], "Incline Walk": ["自重", "训练凳"]}
    df = spark.createDataFrame([(k,) for k in want], "n string")
    assert {r.n: r.e for r in df.select("n", catalog.equipment_of(F.col("n")).alias("e")).collect()} == want


def test_plan_rules(spark):
    good = [("p", d, ph, 3, 90, True, pat, kind, m, "advanced", 1, 45, 60) for d, ph, pat, kind, m in [(1, "热身", "a", "x", "w"), (1, "main", "push", "compound", "chest"), (1, "main", "pull", "x", "back"), (1, "main", "hinge", "x", "legs"), (1, "拉伸", "a", "x", "w")]]
    bad = [("q", d, "main", 9, 10, True, "push", "x", "chest", "beginner", 4, 45, 1) for d in (1, 2)]
    cols = "plan string, day int, phase string, sets int, rest_sec int, heavy boolean, pattern string, exercise_type string, muscle string, level string, wanted_days int, work_sec int, budget_min int"
    got = {r.plan: r for r in vectors.check_plans(spark.createDataFrame(good + bad, cols), ["plan"]).collect()}
    assert got["p"].legal and got["p"].issues == []
    assert set(got["q"].issues) == {"sets_range", "rest_floor", "no_warmup", "no_stretch", "main_count", "sets_over_level", "few_patterns", "no_compound", "adjacent_muscle", "day_count", "over_budget"}


def test_sql_functions(spark):
    assert set(register_sql(spark)) >= {"circular_distance", "interval_iou", "hms_to_sec", "vec_cosine", "gyro_label", "windows"}
    row = spark.sql("SELECT circular_distance(-170D, 180D) a, interval_iou(0D, 10D, 5D, 15D) b, hms_to_sec('1:00:05') c, vec_cosine(array(1F, 0F), array(2F, 0F)) d").first()
    assert (row.a, row.b, row.c) == (10.0, pytest.approx(1 / 3), 3605.0) and row.d == pytest.approx(1.0)
    assert [tuple(r) for r in spark.sql("SELECT * FROM windows(25D, 10D, 2D)").collect()] == [(0, 0.0, 10.0), (1, 8.0, 18.0), (2, 16.0, 25.0)]


def test_forest_learns_and_folds_are_even(spark):
    rng = random.Random(0)
    rows = [(i, float(i % 2) * 3 + rng.random(), rng.random() if i % 10 else float("nan"), "ab"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, x double, y double, label string")
    folds = learn.stratified_folds(df, "label", ["id"], 4).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds} == {10}
    model = learn.train(df, ["x", "y"], "label", learn.forest(trees=5, depth=3))
    out = learn.score(model, df, ["x", "y"])
    assert out.filter("predicted = label").count() >= 78 and out.agg(F.min("confidence")).first()[0] >= 0.5
    table = learn.compare(df, ["x", "y"], "label", ["id"], {"forest": learn.forest(trees=3, depth=2)}, most=2).collect()
    assert table[0].model == "forest" and table[0].accuracy > 0.9
    assert learn.cross_validate(df.filter("id < 3"), ["x", "y"], "label", ["id"]) == 0.0
