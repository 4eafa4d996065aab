"""Costly expressions stand once in the optimized plan: each copy would be evaluated again for every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import evaluation, frames as fr, load, segments
from strideframe.plans import q_frames
from strideframe.plans.registry import Tables


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clashes_of_a_row_are_searched_once(spark):
    rows = [(1, i, float(10 * i), float(10 * i + 12), (37 * i % 100) / 100) for i in range(6)]
    segs = spark.createDataFrame(rows, "k long, seq long, start_sec double, end_sec double, confidence double")
    kept = segments.keep_first_overlaps(segs, ["k"], ["seq"], prefer_confident=True)
    assert optimized(kept).count("array_position") == 1
    assert sorted(r.seq for r in kept.collect()) == list(range(6))


def _pictures(spark):
    box = "struct<bbox:array<int>,confidence:double,label:string>"
    hand, gear, person = ([20, 60, 50, 78], 0.9, "hand"), ([40, 50, 80, 80], 0.5, "bar"), ([0, 0, 90, 50], 0.7, "person")
    rows = [(1, 1, 0.0, [hand], [gear, gear], [person], 0.5, 0.5), (1, 2, 1.0, [], [], [], 0.5, 0.5), (1, 3, 2.0, [hand], [gear], [], 0.5, 0.5)]
    return spark.createDataFrame(rows, f"k long, frame long, t double, hands array<{box}>, equipment array<{box}>, persons array<{box}>, sharpness double, motion double")


def test_a_hand_is_scored_once(spark):
    p = fr.FrameParams(height=100.0, width=200.0)
    scored = _pictures(spark).select(F.transform("hands", lambda h: fr.hand_score(h["bbox"], F.col("equipment"), F.col("persons"), p)).alias("s"))
    assert str(scored._jdf.queryExecution().analyzed().toString()).count("array_min") == 1
    assert [len(r.s) for r in scored.collect()] == [1, 0, 1]


def test_equipment_bonus_counts_every_frame(spark):
    """The frame without equipment counts in the total, and the one with two pieces of a label once."""
    p = fr.FrameParams(height=100.0, width=200.0)
    frames = _pictures(spark).withColumn("hands", F.transform("hands", lambda h: F.struct(h["bbox"].alias("bbox"), h["confidence"].alias("confidence"), F.lit(0.9).alias("score"), F.lit(True).alias("own"))))
    own = F.array(F.struct(F.array(*[F.lit(x) for x in (20, 60, 50, 78)]).alias("bbox")))
    plain = frames.filter("frame = 3").select(fr.equipment_score(F.col("equipment")[0], own, p)).first()[0]
    got = {r.frame: [e.score for e in r.equipment] for r in fr.score_equipment(frames, ["k"], p).collect()}
    want = min(1.0, plain + min(0.15, 3 / 3 * 0.2))
    assert got == {1: [want, want], 2: [], 3: [want]}
    table = {r.label: r.visible_share for r in fr.equipment_summary(fr.score_equipment(frames, ["k"], p), ["k"]).collect()}
    assert table == {"bar": 1.0}


def test_frames_go_along_with_their_scored_hands(spark):
    """Other columns are carried through the blocks: the frames are not computed once more to be joined back."""
    scored = fr.score_hands(_pictures(spark), ["k"], fr.FrameParams(height=100.0, width=200.0))
    assert "Join" not in optimized(scored)
    rows = {r.frame: r for r in scored.collect()}
    assert sorted(rows) == [1, 2, 3]
    assert [len(rows[i].hands) for i in (1, 2, 3)] == [1, 0, 1]
    assert [len(rows[i].equipment) for i in (1, 2, 3)] == [2, 0, 1] and rows[3].t == 2.0


def test_useful_frames_are_scored_before_they_are_filtered(spark):
    """The steps that choose frames read their scores from a table; the filter would else repeat every score below it."""
    chosen = optimized(q_frames._useful(Tables(spark, "/root/testdata/sf0.001")))
    assert "lambdafunction" not in chosen and "isnull(filter_reason" in chosen


def test_pairs_are_joined_before_their_islands_are_sampled(spark, monkeypatch):
    """The range shuffle samples its input first, so the pairs are read from a table, not joined twice."""
    plans, islands = [], evaluation.decisions.islands
    monkeypatch.setattr(evaluation.decisions, "islands", lambda spans, *a, **k: plans.append(optimized(spans)) or islands(spans, *a, **k))
    truth = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 10.0, 20.0)], "recording_id long, gt_id long, gt_start double, gt_end double")
    pred = spark.createDataFrame([("v", 1, 7, 1.0, 11.0)], "version string, recording_id long, pred_id long, pred_start double, pred_end double")
    got = evaluation.match_greedy(evaluation.candidates(truth, pred, 10.0)).collect()
    assert [(r.gt_id, r.pred_id) for r in got] == [(1, 7)]
    assert len(plans) == 1 and "Join" not in plans[0]


def test_rows_are_not_dealt_out_by_muscle(spark):
    """A handful of muscles would put a sixth of all sessions into one task."""
    done = spark.createDataFrame([(1, 1, 60.0), (1, 2, 30.0)], "session_id long, exercise_id long, duration_sec double")
    moves = spark.createDataFrame([(1, "a", "b", ""), (2, "b", None, "")], "exercise_id long, primary_muscle string, secondary_muscle string, side string")
    groups = spark.createDataFrame([("a", "x"), ("b", "y")], "muscle string, muscle_group string")
    out = load.muscle_seconds(done, moves, groups, ["session_id"])
    assert "hashpartitioning(muscle#" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.muscle_group: r.seconds for r in out.collect()} == {"x": 60.0, "y": 60.0}
