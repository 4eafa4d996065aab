"""Block operators against plain loops, with blocks small enough to cross many edges."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import rhythm, sensor
from strideframe.operators.intervals import asof_nearest, overlap_join, points_in
from strideframe.operators.labels import smooth_mode
from strideframe.operators.sequence import fill_last, frame, gap_islands, index_rows, running
from strideframe.operators.stats import exact_quantiles, mode_first


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for rec in range(3):
        t = 0.0
        for i in range(40 if rec else 1):
            t += rng.choice([0.0, 1.0, 2.5, 40.0])
            out.append((rec, t, i, rng.choice("abc"), rng.choice([None, 1.0, 4.0, 7.5])))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "rec int, t double, id int, lab string, v double")


def by_rec(rows):
    return {r: sorted((x for x in rows if x[0] == r), key=lambda x: (x[1], x[2])) for r in {x[0] for x in rows}}


@pytest.mark.parametrize("width", [None, 3.0, 1000.0])
def test_index_rows(df, rows, width):
    got = {(r.rec, r.id): r for r in index_rows(df, ["rec"], ["t", "id"], label="lab", lag=["v", "lab"], lead=["t"], total=True, width=width).collect()}
    for rec, seq in by_rec(rows).items():
        run = 0
        for i, x in enumerate(seq):
            run += i == 0 or seq[i - 1][3] != x[3]
            r = got[(rec, x[2])]
            assert (r.pos, r.run_id, r.n_rows) == (i + 1, run, len(seq))
            assert (r.lag_v, r.lag_lab) == ((seq[i - 1][4], seq[i - 1][3]) if i else (None, None))
            assert r.lead_t == (seq[i + 1][1] if i + 1 < len(seq) else None)


@pytest.mark.parametrize("size", [4, 7, 1000])
def test_frame_sees_across_blocks(df, rows, size):
    placed = index_rows(df, ["rec"], ["t", "id"], width=5.0)
    got = {(r.rec, r.id): r.near for r in frame(placed, ["rec"], "pos", 2, 3, lambda w: {"near": F.collect_list("id").over(w.rowsBetween(-2, 3))}, rows=size).collect()}
    for rec, seq in by_rec(rows).items():
        for i, x in enumerate(seq):
            assert got[(rec, x[2])] == [y[2] for y in seq[max(0, i - 2) : i + 4]]


@pytest.mark.parametrize("inclusive", [True, False])
def test_running(df, rows, inclusive):
    out = running(df, ["rec"], ["t", "id"], {"s": ("sum", "v"), "m": ("max", "t")}, inclusive=inclusive, width=4.0)
    got = {(r.rec, r.id): (r.s, r.m) for r in out.collect()}
    for rec, seq in by_rec(rows).items():
        for i, x in enumerate(seq):
            past = seq[: i + 1] if inclusive else seq[:i]
            vs = [y[4] for y in past if y[4] is not None]
            assert got[(rec, x[2])] == (sum(vs) if vs else None, max((y[1] for y in past), default=None))


def test_fill_last(df, rows):
    one = {(r, t): v for r, t, _, _, v in rows}
    flat = df.sparkSession.createDataFrame([(r, t, v) for (r, t), v in one.items()], "rec int, t double, v double")
    got = {(r.rec, r.t): (r.prev_v, r.next_v) for r in fill_last(flat, ["rec"], ["t"], ["v"], width=6.0).collect()}
    for (rec, t), _ in one.items():
        before = [(x, v) for (r, x), v in one.items() if r == rec and x <= t and v is not None]
        after = [(x, v) for (r, x), v in one.items() if r == rec and x >= t and v is not None]
        assert got[(rec, t)] == (max(before)[1] if before else None, min(after)[1] if after else None)


@pytest.mark.parametrize("label", [None, "lab"])
def test_gap_islands(df, rows, label):
    spans = df.withColumn("e", F.col("t") + F.coalesce("v", F.lit(0.0)))
    got = {(r.rec, r.id): r for r in gap_islands(spans, ["rec"], "t", "e", 2.0, tie=["id"], label=label, width=3.0).collect()}
    for rec, seq in by_rec(rows).items():
        reach, island, last = None, 0, None
        for x in seq:
            if label and x[3] != last:
                reach, island = None, 0
            if reach is None or x[1] - reach > 2.0:
                island += 1
            reach = max(reach if reach is not None else -1.0, x[1] + (x[4] or 0.0))
            last = x[3]
            assert got[(rec, x[2])].island_id == island


def test_mode_smoothing_ties_and_ends(spark):
    labs = list("aabbccbba")
    df = spark.createDataFrame([(1, float(i), c) for i, c in enumerate(labs)], "rec int, t double, lab string")
    got = [r.smooth for r in smooth_mode(df, ["rec"], ["t"], "lab", 1, width=2.0).orderBy("t").collect()]
    want = labs[:]
    for i in range(1, len(labs) - 1):
        near = labs[i - 1 : i + 2]
        want[i] = max(near, key=lambda c: (near.count(c), -near.index(c)))
    assert got == want


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(k, float(v)) for k, n in ((1, 1), (2, 500), (3, 64)) for v in np.round(rng.normal(size=n) ** 3, 2)] + [(4, 2.0)] * 9 + [(5, None)]
    df = spark.createDataFrame(data, "k int, v double")
    got = {r.k: (r.m, r.p) for r in exact_quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.95}, bins=16).collect()}
    assert set(got) == {1, 2, 3, 4}
    for k, (m, p) in got.items():
        v = [x for g, x in data if g == k]
        assert m == pytest.approx(np.percentile(v, 50)) and p == pytest.approx(np.percentile(v, 95))
    whole = exact_quantiles(df, [], "v", {"m": 0.5}).first().m
    assert whole == pytest.approx(np.median([v for _, v in data if v is not None]))


def test_mode_first_tie(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 1, "y"), (1, 2, "x"), (1, 4, "y")], "k int, o int, v string")
    assert mode_first(df, ["k"], "v", ["o"]).first()[:] == (1, "y", 2)


def test_range_joins_equal_brute_force(spark):
    rng = random.Random(9)
    spans = [(rng.randint(0, 1), i, rng.uniform(0, 50), rng.uniform(0, 30)) for i in range(40)]
    a = spark.createDataFrame([(k, i, s, s + d) for k, i, s, d in spans[:20]], "k int, a int, s1 double, e1 double")
    b = spark.createDataFrame([(k, i, s, s + d) for k, i, s, d in spans[20:]], "k int, b int, s2 double, e2 double")
    want = {(x[1], y[1]) for x in spans[:20] for y in spans[20:] if x[0] == y[0] and min(x[2] + x[3], y[2] + y[3]) > max(x[2], y[2])}
    for width in (1.0, 7.3, 500.0):
        got = [(r.a, r.b) for r in overlap_join(a, b, ["k"], ("s1", "e1"), ("s2", "e2"), width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    points = spark.createDataFrame([(k, i, s) for k, i, s, _ in spans], "k int, p int, t double")
    hits = {(r.p, r.b) for r in points_in(points, b, ["k"], "t", ("s2", "e2"), 4.0, pad=1.5).collect()}
    assert hits == {(x[1], y[1]) for x in spans for y in spans[20:] if x[0] == y[0] and y[2] - 1.5 <= x[2] <= y[2] + y[3] + 1.5}


def test_asof_nearest_prefers_earlier(spark):
    rows = spark.createDataFrame([(1, 0.0, 1), (1, 10.0, 2), (1, 10.0, 3), (1, 21.0, 4)], "k int, t double, id int")
    goals = spark.createDataFrame([(1, 5.0), (1, 10.0), (1, 16.0), (1, 99.0), (1, -3.0)], "k int, t double")
    got = {r.t: r.id for r in asof_nearest(goals, rows, ["k"], "t", "id", ["id"]).collect()}
    assert got == {5.0: 1, 10.0: 2, 16.0: 4, 99.0: 4, -3.0: 1}


@pytest.mark.parametrize("size", [1, 4, 5])
def test_moving_average_is_zero_padded(spark, size):
    x = np.arange(9.0) ** 2
    df = spark.createDataFrame([(1, float(i), float(v)) for i, v in enumerate(x)], "k int, t double, v double")
    got = [r.g_v for r in sensor.moving_average(df, ["k"], ["t"], ["v"], size, width=2.0).orderBy("t").collect()]
    assert got == pytest.approx(np.convolve(x, np.ones(size) / size, mode="same"))


def test_rhythm_finds_the_frequency(spark):
    t = np.arange(0, 8, 0.1)
    sig = spark.createDataFrame([(np.sin(2 * np.pi * 1.25 * t).tolist(),), ([0.5] * 80,), ([1.0, 2.0],)], "s array<double>")
    got = [r.p for r in sig.select(rhythm.periodicity(F.col("s"), F.lit(10.0), 8, 1.0).alias("p")).collect()]
    assert got[0].freq == pytest.approx(1.25) and got[0].score > 0.8
    assert (got[1].freq, got[1].score, got[2].score) == (0.0, 0.0, 0.0)
    assert got[0].period == pytest.approx(0.8) and got[0].reps == pytest.approx(10.0) and got[1].period is None
    steps = [r[0] for r in sig.select(rhythm.step_frequency("s", F.lit(8.0))).collect()]
    assert steps[0] == pytest.approx(1.25, abs=0.01) and steps[1:] == [0.0, 0.0]


def test_rhythm_equals_direct_sums():
    rng = np.random.default_rng(3)
    x = rng.normal(size=40) + 2 * np.sin(np.arange(40) * 0.9)
    gaps = [None if i in (0, 7, 8, 39) else float(v) for i, v in enumerate(x)]
    full = rhythm.filled(gaps)
    assert full[0] == x[1] and full[7] == pytest.approx(x[6] + (x[9] - x[6]) / 3) and full[39] == x[38]
    got = rhythm.rhythm(pd.Series([gaps, gaps[:12], [None] * 20]), pd.Series([10.0] * 3), 16, 1.5)
    z = (full - full.mean()) / full.std()
    i = np.arange(40)
    power = {k: abs(sum(z * (0.5 - 0.5 * np.cos(2 * np.pi * i / 39)) * np.exp(-2j * np.pi * k * i / 40))) ** 2 for k in range(1, 13)}
    best = max(power, key=power.get)
    echo = max(sum(z[: 40 - lag] * z[lag:]) for lag in range(3, 39)) / sum(z * z)
    want = (best / 4, min(1, 0.55 * echo + 0.45 * min(1, 3 * power[best] / sum(power.values()))), 4 / best, float(best))
    assert got.loc[0].tolist() == pytest.approx(want, rel=1e-6)
    assert got.loc[1].tolist() == [0, 0, None, 0] == got.loc[2].tolist()


def test_posture_windows_use_gravity_and_tilt(spark):
    rows = [("a", i, i * 0.1, 0.0, 0.0, 1.0 + 0.3 * np.sin(2 * np.pi * i / 10), 5.0, 180.0, 10.0) for i in range(100)]
    rows += [("b", i, i * 0.1, 0.0, 0.0, -1.0, 0.0, 90.0, 10.0 + i) for i in range(100)]
    df = spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows], "rec string, row_id int, t double, ax double, ay double, az double, gyro double, angle_z double, angle_x double")
    base = spark.createDataFrame([("a", 180.0), ("b", 180.0)], "rec string, baseline double")
    out = sensor.posture_windows(df, ["rec"], "t", "row_id", base, 10.0, 4.0, 2.0, forward="+Z").orderBy("rec", "k").collect()
    a, b = [r for r in out if r.rec == "a"], [r for r in out if r.rec == "b"]
    assert len(a) == len(b) == 4
    # a swing on one axis has two maxima of its magnitude
    assert a[1].freq == pytest.approx(2.0) and a[1].score > 0.5 and a[1].tilt == 0 and a[1].motion > 0 and a[1].reps == pytest.approx(8.0)
    assert b[1].rule == "supine" and b[1].tilt == 90 and b[1].score == 0 and b[2].drift > b[1].drift > 15


def test_nothing_is_cut_after_many_rows(spark):
    from strideframe.operators.names import numbered
    from strideframe.plans.q_relational import _windows
    from strideframe.plans.q_sensor import _segments
    from strideframe.sources.readers import numbered_frames

    names = spark.range(1001).select(F.lit("x").alias("slug"), "id")
    ids = [r[0] for r in numbered(names, "slug", ["id"], "out", width=100).select("out").collect()]
    assert len(set(ids)) == 1001 and "x_001" in ids and "x_1001" in ids
    path = F.format_string("/frames/1/frame_%08d.jpg", F.col("id") + 123_456_780)
    assert numbered_frames(spark.range(30).select(F.lit(1).alias("rec"), path.alias("path")), ["rec"], "path", 1).select("index").distinct().count() == 30

    class Long:
        """A recording of 45 days."""

        events = spark.range(46).selectExpr("id AS event_id", "1L AS user_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, int(id)) AS ts", "'a' AS event_type", "1.0D AS value", "'{\"k\": 1}' AS props")

    assert _windows(Long).count() == 45 and _segments(Long).count() == 15
