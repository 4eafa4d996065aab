"""Readers on real files, sinks, and streams against their batch twins."""

from __future__ import annotations

import json
import random
import tempfile
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strideframe.sources import readers, writers
from strideframe.sources.snapshots import LatestRows, run_latest
from strideframe.streaming import monitors as mon


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="strideframe-test-"))


def put(path: Path, body: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body, encoding="utf-8")
    return str(path)


def test_imu_text(spark, folder):
    good = "2026-06-17 18:57:3{}.5\tdev\t0.1\t0.2\t-0.9\t1\t2\t3\t10\t20\t-179.5\tx"
    body = "\n".join(["时间\t设备\tax\tay\taz\tgx\tgy\tgz\t角度X", good.format(4), good.format(5).replace("0.2", "null"), "short\tline", good.format(7).replace("20\t", "null\t"), "bad\t" + good.format(8)[22:]])
    rows = readers.read_imu(spark, put(folder / "r1" / "IMU.txt", body)).orderBy("t_rel").collect()
    assert [(r.recording_id, r.t_rel, r.angle_y) for r in rows] == [("r1", 0.0, 20.0), ("r1", 3.0, None)]


def test_flexible_headers(spark, folder):
    a = put(folder / "a" / "s.csv", "Time,Acc_X,acc_y,accZ,Pitch,extra\n2026-01-01 00:00:00,1,2,3,4,5\n")
    b = put(folder / "b" / "s.csv", "时间,加速度X(g),加速度Y(g),加速度Z(g),角度Z(°),气压(kPa)\n2026-01-01 00:00:01,1,x,3,4,99\n")
    rows = readers.read_sensor_flexible(spark, [a, b]).orderBy("time").collect()
    assert (rows[0].ax, rows[0].angle_z, rows[0].pressure, rows[1].ay, rows[1].pressure) == (1.0, 4.0, None, None, 99.0)
    with pytest.raises(ValueError, match="angle_z"):
        readers.resolve_columns(["time", "ax", "ay", "az"])


def test_hr_csv(spark, folder):
    p = put(folder / "hr.csv", "﻿Timestamp,BPM\n2026-01-01T10:00:00,80.7\n60,91\noops,90\n70,none\n")
    rows = readers.read_hr_csv(spark, p, "2026-01-01").orderBy("ts").collect()
    assert [(str(r.ts), r.heart_rate) for r in rows] == [("2026-01-01 00:01:00", 91), ("2026-01-01 10:00:00", 80)]


def test_recognition_periods_truth_and_plans(spark, folder):
    put(folder / "v1" / "r1" / "exercise_result.json", json.dumps({"results": [{"segmentId": "e1", "startTime": 1, "endTime": 9, "result": {"exercise": "row", "confidence": "0.8", "sets": [{"reps": 10}, {"reps": 12}]}}]}))
    put(folder / "v2" / "r1" / "exercise_result.json", json.dumps([{"seg_idx": 4, "startTime": 1, "endTime": 9, "result": {"exercise": "row", "sets": 3, "reps": 31}}]))
    rows = {r.version: r for r in readers.read_recognition(spark, str(folder)).collect()}
    assert (rows["v1"].segment_id, rows["v1"].total_sets, rows["v1"].total_reps, rows["v1"].confidence) == ("e1", 2, 22, 0.8)
    assert (rows["v2"].segment_id, rows["v2"].total_sets, rows["v2"].total_reps, [s.reps for s in rows["v2"].sets]) == ("seg_4", 3, 31, [10, 10, 10])

    put(folder / "p" / "r1" / "period_result.json", json.dumps({"segments": [{"start_time": "00:01:00", "end_time": "00:02:00", "state": "REST"}]}))
    put(folder / "p" / "r2" / "period_result.json", json.dumps({"segments": [{"start_sec": 1, "end_sec": 2, "state": "REST"}]}))
    put(folder / "p" / "r2" / "period_result_adjusted.json", json.dumps({"segments": [{"start_sec": 5, "end_sec": 6, "state": "EXERCISE"}]}))
    got = {r.recording_id: (r.segment_id, r.start_sec, r.end_sec, r.state) for r in readers.read_periods(spark, str(folder / "p")).collect()}
    assert got == {"r1": ("seg_0", 60.0, 120.0, "REST"), "r2": ("seg_0", 5.0, 6.0, "EXERCISE")}

    put(folder / "g" / "r1" / "ground_truth.json", '[{"start": 0, "end": 10, "label": "深蹲", "type": "exercise", "reps": "10 8"}, {"start": 10, "end": 20, "label": "过渡"}, {"start": 20, "end": TOTAL, "label": "拉伸", "type": "exercise"},]')
    truth = readers.read_truth(spark, str(folder / "g"))
    assert [(r.type, r.end_sec, r.sets, r.reps) for r in truth.orderBy("start_sec").collect()] == [("exercise", 10.0, 2, 18), ("transition", 20.0, 1, None), ("exercise", 20.0, 1, None)]
    assert [r.label for r in readers.exercise_truth(truth).collect()] == ["深蹲"]

    plan = {"generated_at": "2026", "plan": {"weekly_schedule": [{"day": 1, "theme": "x", "exercises": [{"exercise_id": "a", "sets": 3}, {"exercise_id": "b", "sets": 2}]}]}}
    put(folder / "c" / "v4_user-1.json", json.dumps(plan))
    assert [(r.version, r.user_id, r.exercise_id, r.position) for r in readers.read_plans(spark, str(folder / "c")).orderBy("position").collect()] == [("v4", "user-1", "a", 0), ("v4", "user-1", "b", 1)]
    assert {r.folder for r in readers.discover(spark, str(folder), "exercise_result.json").collect()} == {"r1"}


def test_mapping_series_and_frames(spark, folder):
    p = put(folder / "map.json", json.dumps({"e1": {"cn": "划船"}, "e2": {"cn": "跑步"}}))
    assert {(r.key, r.cn) for r in readers.read_mapping(spark, p, "struct<cn:string>").collect()} == {("e1", "划船"), ("e2", "跑步")}
    put(folder / "s" / "r9" / "frames_meta.json", json.dumps([{"index": 0, "timestamp": 0.0, "path": "a"}, {"index": 3, "timestamp": 1.5, "path": "b"}]))
    assert [(r.recording_id, r["index"]) for r in readers.read_series(spark, str(folder / "s"), "frames_meta.json", readers.FRAME_ITEM).orderBy("index").collect()] == [("r9", 0), ("r9", 3)]
    names = spark.createDataFrame([("r", f"/x/frame_{i:04d}{s}.jpg") for i in range(6) for s in ("", "_b")] + [("r", "/x/cover.jpg")], "rec string, path string")
    assert [r["index"] for r in readers.numbered_frames(names, ["rec"], "path", 2).orderBy("index").collect()] == [0, 2, 4]


def test_user_day_replacement_is_idempotent(spark, folder):
    out = str(folder / "bio")
    day = "date'2026-01-0{}'"

    def rows(*items):
        return spark.createDataFrame(items, "user_id string, d int, hr int").selectExpr("user_id", "make_date(2026, 1, d) AS day", "hr")

    writers.replace_user_days(spark, rows(("u1", 1, 80), ("u1", 1, 81), ("u2", 1, 70), ("u1", 2, 60)), out, buckets=1)
    for _ in range(2):
        writers.replace_user_days(spark, rows(("u1", 1, 99)), out, buckets=1)
        got = sorted((r.user_id, str(r.day), r.hr) for r in spark.read.parquet(out).collect())
        assert got == [("u1", "2026-01-01", 99), ("u1", "2026-01-02", 60), ("u2", "2026-01-01", 70)], day


def test_snapshot_and_result_sinks(spark, folder):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, n string, v double")
    new = spark.createDataFrame([(2, "B", None), (3, "c", 3.0)], "k int, n string, v double")
    writers.next_snapshot(old, new, ["k"], str(folder / "s1"), ["v"])
    assert sorted(map(tuple, spark.read.parquet(str(folder / "s1")).collect())) == [(1, "a", 1.0), (2, "B", 2.0), (3, "c", 3.0)]
    writers.next_snapshot(old, new, ["k"], str(folder / "s2"), only_absent=True)
    assert sorted(map(tuple, spark.read.parquet(str(folder / "s2")).collect())) == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)]
    for kind in ("csv", "json"):
        writers.write_result(old, str(folder / kind), kind)
        assert spark.read.option("header", True).format(kind).load(str(folder / kind)).count() == 2


T0 = datetime(2026, 1, 1)


def as_stream(df, folder: Path, parts: int = 1):
    """The rows in event order as files that a stream reads one per batch."""
    src = folder / "in"
    rows = df.orderBy("ts").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.parquet(str(src / f"p{i}"))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(src))


def test_idle_alert_stream_equals_twin(spark, folder):
    rng = random.Random(4)
    rows, t = [], 0
    for i in range(200):
        t += rng.choice([10, 40])
        rows.append(("u1" if i % 3 else "u2", T0 + timedelta(seconds=t), i, 0.1 if rng.random() < 0.85 else 0.9))
    df = spark.createDataFrame(rows, "user_id string, ts timestamp, id int, motion double")
    flat = df.withColumn("t", F.unix_micros("ts") / 1e6)
    want = sorted(map(tuple, mon.idle_alerts(flat, ["user_id"], "t", "id", "motion").collect()))
    got = mon.run_available(mon.idle_alert_stream(as_stream(df, folder, 4), "user_id", "motion"), str(folder))
    assert want and sorted(map(tuple, got.collect())) == want


def test_exactly_180_seconds_is_no_alert(spark):
    df = spark.createDataFrame([(1, 0.0, 1, 0.1), (1, 180.0, 2, 0.1), (2, 0.0, 3, 0.1), (2, 180.5, 4, 0.1)], "u int, t double, id int, m double")
    assert [tuple(r) for r in mon.idle_alerts(df, ["u"], "t", "id", "m").collect()] == [(2, 0.0, 180.5)]


def near(row) -> tuple:
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


def test_window_and_session_streams(spark, folder):
    rng = random.Random(2)
    rows = [("u", T0 + timedelta(seconds=i * 0.5), 1.0 + (rng.random() if 60 <= i < 90 else 0.0), 5.0, -0.9) for i in range(200)] + [("u", T0 + timedelta(seconds=5000), 1.0, 5.0, -0.9)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp, acc double, gyro double, az double")
    stream = as_stream(df, folder, 2)
    cases = {
        "tumble": lambda d: mon.tumbling_monitor(d, "user_id"),
        "rest": lambda d: mon.rest_monitor(d, "user_id"),
        "sessions": lambda d: mon.activity_sessions(d, "user_id"),
    }
    for name, op in cases.items():
        want = {near(r) for r in op(df).collect()}
        got = {near(r) for r in mon.run_available(op(stream), str(folder / name)).collect()}
        assert got and got <= want, name
        # Only what the last reading has not closed may still be open.
        assert all(r[1] >= T0 + timedelta(seconds=4000) for r in want - got), name


def test_equipment_choice(spark):
    states = spark.createDataFrame([("a", T0, False, 2), ("a", T0 + timedelta(seconds=1), True, 3), ("b", T0, True, 2), ("c", T0, True, 9)], "equipment_id string, ts timestamp, occupied boolean, queue_count int")
    alt = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "z", 1)], "equipment_id string, alternative string, priority int")
    last = mon.equipment_latest(states)
    assert {(r.equipment_id, r.available, r.congested) for r in last.collect()} == {("a", False, True), ("b", False, False), ("c", False, True)}
    assert {tuple(r) for r in mon.wait_or_switch(last, alt).collect()} == {("a", False, "y"), ("b", True, None), ("c", True, None)}


def test_biometric_append_replaces_days_and_quarantines_late(spark, folder):
    out, bad = str(folder / "out"), str(folder / "late")
    handle = mon.append_biometrics(out, bad, 60.0, lambda df, path: writers.replace_user_days(spark, df.withColumn("day", F.to_date("ts")), path, buckets=2))

    def batch(*items):
        return spark.createDataFrame([("u", T0 + timedelta(seconds=s), hr) for s, hr in items], "user_id string, ts timestamp, heart_rate int")

    handle(batch((1000, 80), (1000, 80), (1010, 81)), 0)
    for _ in range(2):  # a batch that runs again changes nothing
        handle(batch((86400 + 5, 70), (100, 60)), 1)
    assert sorted(r.heart_rate for r in spark.read.parquet(out).collect()) == [70, 80, 81]
    assert [r.heart_rate for r in spark.read.parquet(bad).collect()] == [60]


def test_live_calories_stream(spark, folder):
    rows = [(1, 10, 3600.0, T0), (1, 11, 1800.0, T0 + timedelta(seconds=9)), (2, 10, 3600.0, T0)]
    df = spark.createDataFrame(rows, "session_id int, exercise_id int, duration_sec double, ts timestamp")
    cat = spark.createDataFrame([(10, 5.0)], "exercise_id int, met double")
    people = spark.createDataFrame([(1, 60.0, "female", 30), (2, 80.0, "male", 20)], "session_id int, weight double, gender string, age int")
    query = mon.live_calories(as_stream(df, folder), cat, people).writeStream.outputMode("complete").format("memory").queryName("live_kcal").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.session_id: r.kcal for r in spark.sql("SELECT * FROM live_kcal").collect()}
    assert got[1] == pytest.approx((5 * 60 + 4 * 60 * 0.5) * 0.9 * 0.95) and got[2] == pytest.approx(400.0)


def test_latest_rows_replay_fold_and_half_written_batches(spark, folder):
    frame = lambda *rows: spark.createDataFrame(rows, "k string, v int, note string")
    kept = LatestRows(spark, str(folder / "latest"), ["k"], frame(("a", 1, "")).schema, every=3)
    state = lambda: {tuple(r) for r in kept.read().collect()}
    assert state() == set()
    handle, batches = kept.handler(), [[("a", 1, "x"), ("b", 1, None)], [("a", 2, "y"), (None, 5, "n")], [("b", 0, "z")], [], [("a", 0, "w")], [("c", 1, "")], [(None, 4, "n")]]
    want: dict = {}
    for i, rows in enumerate(batches):
        want |= {r[0]: r for r in rows}
        for _ in range(2):  # each batch runs twice
            handle(frame(*rows) if rows else frame(("a", 1, "")).limit(0), i)
        assert state() == set(want.values()), i
    assert kept._whole("base") == [2, 5] and kept._whole("changes") == [3, 4, 5, 6]
    put(folder / "latest" / "changes" / f"{7:012d}" / "part-0.parquet", "half a file")
    assert state() == set(want.values())


def test_equipment_state_in_update_mode(spark, folder):
    rows = [(f"e{i % 3}", T0 + timedelta(seconds=i), i % 2 == 0, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "equipment_id string, ts timestamp, occupied boolean, queue_count int")
    got = run_latest(mon.equipment_latest(as_stream(df, folder, 6)), str(folder / "run"), ["equipment_id"], every=2)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in mon.equipment_latest(df).collect()}
