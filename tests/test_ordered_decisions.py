"""Order-dependent operators against straightforward single-list versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import evaluation as ev
from strideframe.operators import frames as fr
from strideframe.operators import segments as sg
from strideframe.operators import vectors as vec

SEG = "rec int, chunk int, seg int, start_sec double, end_sec double, state string, equipment string, confidence double"


def random_segments(seed, n=60):
    rng = random.Random(seed)
    out = []
    for rec in range(2):
        for i in range(n):
            s = rng.uniform(0, 300)
            out.append((rec, i // 15, i, s, s + rng.choice([0.3, 4.0, 9.0, 20.0]), rng.choice(["EXERCISE", "rest"]), rng.choice(["bar", "bike"]), round(rng.random(), 3)))
    return out


def naive_keep(rows, confident):
    kept = []
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        hit = None
        for j, k in enumerate(kept):
            if (min(r[4], k[4]) - max(r[3], k[3])) / max(r[4] - r[3], 1) > 0.5:
                hit = j
                break
        if hit is None:
            kept.append(r)
        elif confident and r[7] > kept[hit][7]:
            kept[hit] = r
    return kept


@pytest.mark.parametrize("confident", [False, True])
def test_overlap_dedupe(spark, confident):
    rows = random_segments(11)
    got = sg.keep_first_overlaps(spark.createDataFrame(rows, SEG), ["rec"], ["chunk", "seg"], prefer_confident=confident).collect()
    want = [k for rec in (0, 1) for k in naive_keep([r for r in rows if r[0] == rec], confident)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_snap_gaps(spark):
    rows = [(1, 0, 1, 0.0, 10.0, "EXERCISE", "bar", 0.9), (1, 0, 2, 13.0, 20.0, "EXERCISE", "bar", 0.8), (1, 0, 3, 26.0, 30.0, "rest", "", 0.7), (1, 0, 4, 28.0, 40.0, "rest", "", 0.6)]
    df = spark.createDataFrame(rows, SEG)
    assert [r.start_sec for r in sg.snap_gaps(df, ["rec"], "seg").orderBy("seg").collect()] == [0.0, 10.0, 26.0, 30.0]
    assert [r.start_sec for r in sg.snap_gaps(df, ["rec"], "seg", overlaps=False).orderBy("seg").collect()] == [0.0, 10.0, 26.0, 28.0]


def test_window_merge_joins_equal_neighbours(spark):
    rows = [(1, 0, 1, 0.0, 10.0, "EXERCISE", "bar", 0.9), (1, 0, 2, 13.0, 20.0, "exercise", "bar", 0.5), (1, 1, 3, 13.5, 20.0, "EXERCISE", "bar", 0.8), (1, 1, 4, 23.0, 30.0, "rest", "", 0.7)]
    got = sg.merge_windows(spark.createDataFrame(rows, SEG), ["rec"], ["chunk", "seg"], "seg").orderBy("start_sec").collect()
    assert [(r.start_sec, r.end_sec, r.state, r.confidence) for r in got] == [(0.0, 20.0, "EXERCISE", 0.8), (20.0, 30.0, "rest", 0.7)]


def test_boundary_expansion(spark):
    rng = random.Random(3)
    rows, t = [], 0.0
    for i in range(60):
        d = rng.choice([5.0, 20.0, 60.0])
        rows.append((1, i, t - 2.0 if i == 0 else t, t + d, rng.choice(["EXERCISE", "REST"]), rng.choice([0.0, 3.0, 30.0]), rng.choice([0.0, 4.0, 40.0])))
        t += d
    cols = "rec int, seg int, start_sec double, end_sec double, state string, before_sec double, after_sec double"
    got = sg.expand_boundaries(spark.createDataFrame(rows, cols), ["rec"], ["seg"], spark.createDataFrame([(1, t - 1)], "rec int, total_sec double")).orderBy("seg").collect()
    a, z = [r[2] for r in rows], [r[3] for r in rows]
    for i, r in enumerate(rows):
        if r[4] != "EXERCISE":
            continue
        if r[5] > 0 and i > 0:
            new = max(a[i - 1], a[i] - r[5])
            if new < z[i] and new < a[i]:
                a[i], z[i - 1] = new, min(z[i - 1], new)
        if r[6] > 0 and i + 1 < len(rows):
            new = min(z[i + 1], z[i] + r[6])
            if new > a[i] and new > z[i]:
                z[i], a[i + 1] = new, max(a[i + 1], new)
    a[0], z[-1] = max(0.0, a[0]), min(t - 1, z[-1])
    assert [(r.start_sec, r.end_sec) for r in got] == list(zip(a, z))


def test_step_merge(spark):
    rng = random.Random(8)
    rows = [(1, i * rng.choice([1.0, 1.5]), rng.choice(["rise", "drop"]), rng.uniform(-9, 9)) for i in range(50)]
    rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: r[1])
    got = sg.merge_steps(spark.createDataFrame(rows, "rec int, t double, kind string, delta double"), ["rec"], "t", "kind", "delta").orderBy("t").collect()
    kept = []
    for r in rows:
        if kept and r[2] == kept[-1][2] and r[1] - kept[-1][1] < 3:
            kept[-1] = max(kept[-1], r, key=lambda x: (abs(x[3]), x is kept[-1]))
        else:
            kept.append(r)
    assert [tuple(r) for r in got] == kept


@pytest.mark.parametrize("seed", range(3))
def test_greedy_matching(spark, seed):
    rng = random.Random(seed)
    pairs = [("v", rec, g, p, rng.choice([0.3, 0.5, 0.5, 0.8])) for rec in range(3) for g in range(8) for p in range(8) if rng.random() < 0.4]
    got = {tuple(r)[:4] for r in ev.match_greedy(spark.createDataFrame(pairs, "version string, recording_id int, gt_id int, pred_id int, iou double")).collect()}
    want = set()
    for v, rec, g, p, _ in sorted(pairs, key=lambda x: (-x[4], x[2], x[3])):
        if not any(w[1] == rec and (w[2] == g or w[3] == p) for w in want):
            want.add((v, rec, g, p))
    assert got == want


def test_evaluation_counts_and_edges(spark):
    truth = spark.createDataFrame([("a", 1, 0.0, 10.0, "squat", 2, 20), ("a", 2, 20.0, 30.0, "row", 1, None), ("a", 3, 50.0, 60.0, "press", 1, 8)], "recording_id string, gt_id int, gt_start double, gt_end double, gt_action string, gt_sets int, gt_reps int")
    pred = spark.createDataFrame([("v1", "a", 1, 1.0, 10.0, "squat", 2, 21), ("v1", "a", 2, 21.0, 30.0, "curl", 1, 5), ("v1", "a", 3, 80.0, 90.0, "row", 1, 5), ("v1", "b", 1, 0.0, 5.0, "row", 1, 3)], "version string, recording_id string, pred_id int, pred_start double, pred_end double, pred_action string, pred_sets int, pred_reps int")
    matched = ev.match_greedy(ev.candidates(truth, pred, 5.0))
    details = ev.detail_rows(ev.verdicts(matched, truth, pred), truth, pred)
    kinds = sorted(r.error_type for r in details.collect())
    assert kinds == ["extra_action", "extra_action", "fully_correct", "missed_action", "wrong_action"]
    c = {r.recording_id: r for r in ev.counts(details).collect()}
    assert (c["a"].action_tp, c["a"].action_fp, c["a"].action_fn, c["a"].rep_ok_count) == (1, 2, 2, 2)
    assert (c["b"].gt_count, c["b"].action_fp, c["b"].set_ok_count) == (0, 1, 0)
    top = ev.scores(ev.counts(details)).filter("level = 1").first()
    assert top.action_precision == pytest.approx(1 / 4) and top.action_recall == pytest.approx(1 / 3) and top.macro_action_f1 == pytest.approx(1 / 3)


def test_matching_without_candidates(spark):
    empty = spark.createDataFrame([], "version string, recording_id int, gt_id int, pred_id int, iou double")
    assert ev.match_greedy(empty).isEmpty()


def test_diverse_selection(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(12, 6))
    rel = np.sort(rng.random(12))[::-1]
    rows = [(1, i, float(rel[i]), i + 1, v[i].tolist()) for i in range(12)]
    got = [r.item for r in vec.diversify(spark.createDataFrame(rows, "u int, item int, score double, rank int, v array<double>"), "u", "item", "v", 5).orderBy("pick").collect()]
    cos = lambda i, j: v[i] @ v[j] / (np.linalg.norm(v[i]) * np.linalg.norm(v[j]) + 1e-9)
    chosen = [0]
    while len(chosen) < 5:
        chosen.append(max((i for i in range(12) if i not in chosen), key=lambda i: 0.6 * rel[i] - 0.4 * max(cos(i, j) for j in chosen)))
    assert got == chosen


def test_nearest_equals_all_pairs_over_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(i, v[i].tolist(), 0.01 * (i % 3)) for i in range(50)], "id long, v array<double>, bonus double")
    got = {}
    for r in vec.nearest(df.withColumnRenamed("id", "q"), df, 4, "q", "id", "v", bonus="bonus", block=7).collect():
        got.setdefault(r.q, {})[r["rank"]] = r.id
    f = v.astype(np.float32).astype(np.float64)
    unit = f / np.linalg.norm(f, axis=1)[:, None]
    score = unit @ unit.T + 0.01 * (np.arange(50) % 3)[None, :]
    for q in range(50):
        assert [got[q][k] for k in (1, 2, 3, 4)] == list(np.argsort(-score[q], kind="stable")[:4])


def test_lsh_ranks_near_items_and_copies(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.99, 0.05]), (2, [0.0, 1.0])] + [(10 + i, [0.0, 1.0]) for i in range(20)], "id long, v array<double>")
    out = vec.approximate_nearest(df.withColumnRenamed("id", "q"), df, 3, "q", "id", "v", 0.3).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.q, []).append(r.id)
    assert got[0][0] == 0 and got[1][0] == 1 and set(got[0]) <= {0, 1}
    assert all(got[q] == [2, 10, 11] for q in [2, *range(10, 30)])


def test_filled_lsh_keeps_every_query(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(200, 64)).astype(np.float32)
    v[7] = v[8]
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(200)], "id long, v array<float>")
    got = {}
    for r in vec.approximate_nearest(df.withColumnRenamed("id", "q"), df, 5, "q", "id", "v", 1.2, fill=True).collect():
        got.setdefault(r.q, []).append(r.id)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    best = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :5]
    assert set(got) == set(range(200)) and all(len(x) == 5 for x in got.values())
    assert sum(len(set(got[q]) & set(best[q].tolist())) for q in range(200)) >= 0.9 * 1000


def test_near_duplicate_frames(spark):
    rng = random.Random(6)
    rows = [(1, i, i * 0.2, rng.choice([0, 7, -1, 2**40, 2**40 + 3, 255 << 20])) for i in range(40)]
    got = [r.frame for r in fr.drop_near_duplicates(spark.createDataFrame(rows, "rec int, frame int, t double, phash long"), ["rec"]).orderBy("frame").collect()]
    kept = []
    for r in rows:
        if all(abs(r[2] - k[2]) >= 0.3 and bin((r[3] ^ k[3]) & (2**64 - 1)).count("1") >= 6 for k in kept):
            kept.append(r)
    assert got == [k[1] for k in kept]


def test_hand_boost_follows_the_frame_before(spark):
    p = fr.FrameParams(height=100.0, width=200.0, own_hand=0.55)
    hand = lambda x, y: {"bbox": [x, y, x + 30, y + 30], "confidence": 0.9, "label": "hand"}
    gear = [{"bbox": [60, 70, 90, 99], "confidence": 0.9, "label": "bar"}]
    # Frame 1 is clearly own; 2 and 3 are a little too weak on their own and follow it in turn.
    rows = [(1, 0, [hand(150, 5)], gear), (1, 1, [hand(60, 70)], gear), (1, 2, [hand(70, 46)], gear), (1, 3, [hand(70, 44)], gear), (1, 4, [hand(10, 2)], gear)]
    det = "array<struct<bbox:array<int>,confidence:double,label:string>>"
    df = spark.createDataFrame(rows, f"rec int, frame int, hands {det}, equipment {det}").withColumn("persons", F.array().cast(det))
    first = {r.frame: r.s for r in df.select("frame", fr.hand_score(F.col("hands")[0]["bbox"], F.col("equipment"), F.col("persons"), p).alias("s")).collect()}
    got = {r.frame: r.hands[0] for r in fr.score_hands(df, ["rec"], p).collect()}
    own = {f: s > 0.55 for f, s in first.items()}
    score = dict(first)
    for f in (1, 2, 3):
        near = [g for g in (f - 1, f + 1) if own[g]]
        reach = any(abs(rows[f][2][0]["bbox"][0] - rows[g][2][0]["bbox"][0]) ** 2 + abs(rows[f][2][0]["bbox"][1] - rows[g][2][0]["bbox"][1]) ** 2 < 400 for g in near)
        if not own[f] and reach:
            score[f] = min(1.0, score[f] + 0.15)
            own[f] = score[f] > 0.55
    assert {f: h.score for f, h in got.items()} == pytest.approx(score) and {f: h.own for f, h in got.items()} == own


def test_key_frames_fill_up_to_the_minimum(spark):
    rows = [(1, i, i * 0.05, 0.5 + i / 100, i * 1_000_003 * 7919, float(i % 7), None if i % 9 else "blur") for i in range(40)]
    df = spark.createDataFrame(rows, "rec int, frame int, t double, info_score double, phash long, y double, filter_reason string")
    got = fr.assemble(df, ["rec"], ["y"], least=12).collect()
    assert len(got) == len({r.frame for r in got}) == 12 and all(rows[r.frame][6] is None for r in got) and "fill" in {r.reason for r in got}


def test_hashed_search_in_small_blocks(spark):
    """Blocks of 20 rows find what all pairs find among shared buckets; a zero vector is near nothing."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(120, 6))
    v[5] = 0.0
    v[9] = v[10]
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(120)], "id long, v array<double>")
    got = {}
    for r in vec.approximate_nearest(df.filter("id % 4 = 1").withColumnRenamed("id", "q"), df, 4, "q", "id", "v", 1.2, tables=12, bucket=50.0, block=20).collect():
        got.setdefault(r.q, {})[r["rank"]] = r.id
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    score = unit @ unit.T
    assert 5 not in got
    for q in range(1, 120, 4):
        if q != 5:
            best = [i for i in np.argsort(-np.round(score[q], 12), kind="stable")[:4] if score[q, i] > 1 - 1.2**2 / 2]
            assert [got[q][n + 1] for n in range(len(best))] == best
