"""Small islands, large islands and composed maps against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_ordered_decisions import SEG, naive_keep, random_segments

from strideframe.operators import decisions
from strideframe.operators import evaluation as ev
from strideframe.operators import segments as sg


@pytest.mark.parametrize("most", [4, 128])
@pytest.mark.parametrize("confident", [False, True])
def test_kept_segments_do_not_depend_on_the_way(spark, most, confident):
    rows = random_segments(21, 80)
    got = sg.keep_first_overlaps(spark.createDataFrame(rows, SEG), ["rec"], ["chunk", "seg"], prefer_confident=confident, most=most).collect()
    want = [k for rec in (0, 1) for k in naive_keep([r for r in rows if r[0] == rec], confident)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("most", [3, 128])
def test_steps_do_not_depend_on_the_way(spark, most):
    rng = random.Random(18)
    rows = [(rec, i * 1.25, "rise" if (i // 37) % 2 else "drop", rng.choice([rng.uniform(-9, 9), 5.0, -5.0])) for rec in range(2) for i in range(150)]
    got = sg.merge_steps(spark.createDataFrame(rows, "rec int, t double, kind string, delta double"), ["rec"], "t", "kind", "delta", most=most).orderBy("rec", "t").collect()
    kept = []
    for r in rows:
        if kept and r[0] == kept[-1][0] and r[2] == kept[-1][2] and r[1] - kept[-1][1] < 3:
            kept[-1] = r if abs(r[3]) > abs(kept[-1][3]) else kept[-1]
        else:
            kept.append(r)
    assert [tuple(r) for r in got] == kept


def test_a_long_chain_is_followed_by_doubling(spark):
    """Every hit is larger than the one before: one chain of all rows, of which the last of each reach stays."""
    rows = spark.range(20_000).select(F.lit(1).alias("rec"), F.col("id").cast("double").alias("t"), F.lit("rise").alias("kind"), F.when(F.col("id") % 10 == 9, 50.0).otherwise(F.col("id") % 10 + 1.0).alias("delta"))
    got = sg.merge_steps(rows, ["rec"], "t", "kind", "delta", apart=3.0)
    want, kept = 0, None
    for i in range(20_000):
        d = 50.0 if i % 10 == 9 else i % 10 + 1.0
        if kept is None or i - kept[0] >= 3:
            want, kept = want + 1, (i, d)
        elif d > kept[1]:
            kept = (i, d)
    assert got.count() == want


@pytest.mark.parametrize("most", [2, 128])
def test_matching_does_not_depend_on_the_way(spark, most):
    rng = random.Random(5)
    spans = lambda n, a: [(rec, i, s, s + rng.choice([4.0, 9.0])) for rec in range(2) for i in range(n) for s in [rng.uniform(0, a)]]
    truth = spark.createDataFrame(spans(25, 150), "recording_id int, gt_id int, gt_start double, gt_end double")
    pred = spark.createDataFrame([("v", *r) for r in spans(30, 150)], "version string, recording_id int, pred_id int, pred_start double, pred_end double")
    pairs = ev.candidates(truth, pred, 5.0)
    want, used = set(), set()
    for r in sorted(pairs.collect(), key=lambda r: (-r.iou, r.gt_id, r.pred_id)):
        if not {(r.recording_id, "g", r.gt_id), (r.recording_id, "p", r.pred_id)} & used:
            used |= {(r.recording_id, "g", r.gt_id), (r.recording_id, "p", r.pred_id)}
            want.add((r.recording_id, r.gt_id, r.pred_id))
    assert {(r.recording_id, r.gt_id, r.pred_id) for r in ev.match_greedy(pairs, most).collect()} == want and want


@pytest.mark.parametrize("block", [2, 7, 512])
def test_clamps_compose_over_blocks(spark, block):
    rng = random.Random(9)
    rows, want = [], {}
    for key in (1, None, 3):
        x = None
        for i in range(1, 120 if key == 1 else 3):
            hi = rng.uniform(0, 100)
            lo = hi if i == 1 or rng.random() < 0.1 else hi - rng.uniform(0, 60)
            x = hi if x is None else min(hi, max(lo, x))
            rows.append((key, i, lo, hi, f"r{i}"))
            want[key, i] = x
    got = decisions.clamped(spark.createDataFrame(rows, "k int, pos long, lo double, hi double, name string"), ["k"], "pos", "lo", "hi", "x", block).collect()
    assert {(r.k, r.pos): r.x for r in got} == want and all(r.name == f"r{r.pos}" for r in got)


@pytest.mark.parametrize("block", [3, 512])
def test_growth_over_blocks(spark, block):
    rng = random.Random(13)
    rows, t = [], 0.0
    for i in range(150):
        d = rng.choice([0.0, 5.0, 20.0, 60.0])
        rows.append((1, i, t - rng.choice([0.0, 3.0]) * (d > 4), t + d, rng.choice(["EXERCISE", "EXERCISE", "REST"]), rng.choice([None, 0.0, 3.0, 30.0, 200.0]), rng.choice([None, 0.0, 4.0, 40.0, 200.0])))
        t += d
    cols = "rec int, seg int, start_sec double, end_sec double, state string, before_sec double, after_sec double"
    rows.sort(key=lambda r: (r[2], r[1]))
    got = sg.expand_boundaries(spark.createDataFrame(rows, cols), ["rec"], ["start_sec", "seg"], spark.createDataFrame([(1, t - 1)], "rec int, total_sec double"), block).collect()
    a, z = [r[2] for r in rows], [r[3] for r in rows]
    for i, r in enumerate(rows):
        before, after = r[5] or 0.0, r[6] or 0.0
        if r[4] != "EXERCISE":
            continue
        if before > 0 and i > 0:
            new = max(a[i - 1], a[i] - before)
            if new < z[i] and new < a[i]:
                a[i], z[i - 1] = new, min(z[i - 1], new)
        if after > 0 and i + 1 < len(rows):
            new = min(z[i + 1], z[i] + after)
            if new > a[i] and new > z[i]:
                z[i], a[i + 1] = new, max(a[i + 1], new)
    a[0], z[-1] = max(0.0, a[0]), min(t - 1, z[-1])
    assert {r.seg: (r.start_sec, r.end_sec) for r in got} == {r[1]: (x, y) for r, x, y in zip(rows, a, z)}


def test_first_kept_by_rounds(spark):
    rng = random.Random(2)
    conflicts = [(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.1]
    kept: list[int] = []
    for i in range(60):
        if not any((k, i) in conflicts for k in kept):
            kept.append(i)
    got = decisions.first_kept_by_rounds(spark.range(60).withColumnRenamed("id", "_id"), spark.createDataFrame(conflicts, "_a long, _b long"))
    assert sorted(r._id for r in got.collect()) == kept
