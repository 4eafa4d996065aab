"""Batch twins of the streaming operators, and streams run over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strideframe.functions.mathx import fix, magnitude
from strideframe.plans import bindings as b
from strideframe.plans.bindings import DAY, fx, sql
from strideframe.plans.registry import Tables, query
from strideframe.session import scratch_root
from strideframe.sources.snapshots import run_latest
from strideframe.streaming import monitors as mon

_IDLE = """SELECT recording_id, min(t_rel) AS since, min(t_rel) FILTER (t_rel - s0 > 86400) AS alert_at FROM (SELECT *, min(t_rel) OVER (PARTITION BY recording_id, run) AS s0 FROM (
      SELECT *, sum(c) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS run FROM (SELECT *, value < 40 AS low, CASE WHEN (value < 40) = lag(value < 40) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) THEN 0 ELSE 1 END AS c FROM samples)) WHERE low)
    GROUP BY recording_id, run HAVING count(*) FILTER (t_rel - s0 > 86400) > 0"""


@query("p01_idle_alerts", sql(_IDLE, "samples"))
def p01(t):
    s = b.samples(t).select("recording_id", "t_rel", "row_id", (F.col("value") / 200).alias("motion"))
    return mon.idle_alerts(s, ["recording_id"], "t_rel", "row_id", "motion", 0.2, DAY)


def _stream(t):
    """The event table as a stream, with its times as timestamps."""
    reader = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 16)
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    return reader.parquet(t.folder).select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (v / 200).alias("motion"), magnitude(v / 250.0 - 1.0, (k - 50) / 100.0, v / 400.0 - 1.0).alias("acc"), (v / 5).alias("gyro"), (v / 400.0 - 1.0).alias("az"))


@query("p01_idle_alert_stream", sql("SELECT recording_id AS user_id, CAST(count(*) AS BIGINT) AS alerts FROM (" + _IDLE + ") GROUP BY ALL", "samples"))
def p01s(t):
    out = mon.run_available(mon.idle_alert_stream(_stream(t), "user_id", "motion", 0.2, DAY, forget_sec=90 * DAY), scratch_root(t.spark))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("alerts"))


@query("p02_recovery_status", "SELECT event_id, CASE WHEN f > 7 OR h < 35 THEN 'low_recovery' WHEN f > 5 OR h < 50 THEN 'moderate_recovery' ELSE 'ready' END AS status, CASE WHEN f > 7 OR h < 35 THEN '-30%' WHEN f > 5 OR h < 50 THEN '-10%' ELSE '0%' END AS adjustment FROM (SELECT event_id, value AS h, CAST(json_extract_string(props, '$.k') AS INT) / 10 AS f FROM events)")
def p02(t):
    status, adjustment = mon.recovery_status(F.col("value"), F.get_json_object("props", "$.k").cast("int") / 10)
    return t.events.select("event_id", status.alias("status"), adjustment.alias("adjustment"))


_EQ = """SELECT user_id AS equipment_id, ts, occupied, queue_count, NOT occupied AS available, queue_count > 2 AS congested FROM (SELECT *, value > 60 AS occupied, CAST(json_extract_string(props, '$.k') AS INT) % 6 AS queue_count,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(json_extract_string(props, '$.k') AS INT) % 6 DESC) AS rn FROM events) WHERE rn = 1"""


def _arriving(t, table):
    """One of the tables as a stream of its files."""
    return t.spark.readStream.schema(t.read(table).schema).option("pathGlobFilter", f"{table}.parquet").option("maxFilesPerTrigger", 16).parquet(t.folder)


def _latest(t, stream, keys):
    return run_latest(stream, f"{scratch_root(t.spark).rstrip('/')}/latest-{uuid.uuid4().hex}", keys)


def _equipment(events):
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(F.col("user_id").alias("equipment_id"), "ts", (F.col("value") > 60).alias("occupied"), (k % 6).alias("queue_count"))


@query("p03_equipment_state", _EQ)
def p03(t):
    return mon.equipment_latest(_equipment(t.events))


@query("p03_equipment_stream", _EQ)
def p03s(t):
    return _latest(t, mon.equipment_latest(_equipment(_arriving(t, "events"))), ["equipment_id"])


@query("p04_wait_or_switch", f"SELECT equipment_id, NOT (queue_count > 2 AND equipment_id % 3 <> 0) AS should_wait, CASE WHEN queue_count > 2 AND equipment_id % 3 <> 0 THEN equipment_id + 1 END AS suggested FROM ({_EQ})")
def p04(t):
    two = F.explode(F.array(F.lit(1), F.lit(2)))
    alt = t.events.select(F.col("user_id").alias("equipment_id")).distinct().filter("equipment_id % 3 <> 0").withColumn("priority", two).withColumn("alternative", F.col("equipment_id") + F.col("priority"))
    return mon.wait_or_switch(mon.equipment_latest(_equipment(t.events)), alt)


_P05 = f"""SELECT user_id, CAST(start AS VARCHAR) AS start, n, {fx('acc_std')} AS acc_std, {fx('gyro_mean')} AS gyro_mean, gyro_max, CASE WHEN az > -0.35 THEN '仰卧' WHEN az > -0.78 THEN '俯身' WHEN az > -0.88 THEN '坐姿' ELSE '站姿' END AS posture,
      CASE WHEN acc_std > 0.35 THEN '高' WHEN acc_std > 0.15 THEN '中高' WHEN acc_std > 0.05 THEN '低' ELSE '静止' END AS intensity
    FROM (SELECT recording_id AS user_id, date_trunc('day', ts) AS start, count(*) AS n, stddev_pop(acc) AS acc_std, avg(az) AS az, avg(value / 5) AS gyro_mean, max(value / 5) AS gyro_max FROM samples GROUP BY ALL)"""


def _p05(df):
    out = mon.tumbling_monitor(df, "user_id", "1 day", "1 hour")
    return out


def _shown(df):
    return df.withColumns({"start": F.date_format("start", "yyyy-MM-dd HH:mm:ss"), "acc_std": fix(F.col("acc_std")), "gyro_mean": fix(F.col("gyro_mean"))})


@query("p05_tumbling_monitor", sql(_P05, "samples"))
def p05(t):
    s = b.samples(t).select(F.col("recording_id").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "acc", (F.col("value") / 5).alias("gyro"), "az")
    return _shown(_p05(s))


@query("p05_tumbling_stream", sql(_P05 + " WHERE start < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM samples)", "samples"))
def p05s(t):
    return _shown(mon.run_available(_p05(_stream(t)), scratch_root(t.spark)))


@query("p06_rest_monitor", sql("""SELECT user_id, CAST(min(ws) AS VARCHAR) AS rest_start, CAST(max(we) AS VARCHAR) AS rest_end FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ws) AS s FROM (
      SELECT *, CASE WHEN ws - lag(ws) OVER (PARTITION BY user_id ORDER BY ws) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS c FROM (
        SELECT recording_id AS user_id, TIMESTAMP '2024-01-01' + to_hours(12 * CAST(k AS INT)) AS ws, TIMESTAMP '2024-01-01' + to_hours(12 * CAST(k AS INT) + 24) AS we FROM (
          SELECT *, unnest([floor(h / 12), floor(h / 12) - 1]) AS k FROM (SELECT *, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / 3.6e9 AS h FROM samples)) GROUP BY recording_id, k HAVING count(*) >= 2 AND stddev_pop(acc) < 0.5)))
    GROUP BY user_id, s HAVING max(we) - min(ws) >= INTERVAL 36 HOUR""".replace("SELECT *, unnest([floor(h / 12)", "SELECT recording_id, acc, unnest([floor(h / 12)"), "samples"))
def p06(t):
    s = b.samples(t).select(F.col("recording_id").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "acc")
    out = mon.rest_monitor(s, "user_id", "24 hours", "12 hours", 0.5, 1.5 * DAY, min_rows=2)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("rest_start", "rest_end")})


_P07 = """SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, s"""


def _start(df):
    at = F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.select("user_id", F.regexp_replace(F.regexp_replace(at, r"0+$", ""), r"\.$", "").alias("start"), "n")


@query("p07_activity_sessions", _P07)
def p07(t):
    return _start(mon.activity_sessions(t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "12 hours"))


_P10 = sql(f"""SELECT session_id, {fx('''sum(coalesce(x.met, 4.0::DOUBLE) * u.weight * (e.duration_sec / 3600) * CASE WHEN u.gender = 'female' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END * greatest(0.75::DOUBLE, 1.0::DOUBLE - greatest(0, u.age - 20) * 0.005::DOUBLE))''', 3)} AS kcal, count(*) AS executions
    FROM executions e LEFT JOIN exercises x USING (exercise_id) JOIN sessions s USING (session_id) JOIN users u USING (user_id) GROUP BY session_id""", "executions", "exercises", "sessions", "users")


def _people(t):
    return b.sessions(t).select("session_id", "user_id").join(b.users(t).select("user_id", "weight", "gender", "age"), "user_id").drop("user_id")


@query("p10_live_calories", _P10)
def p10(t):
    return mon.live_calories(b.executions(t), b.exercises(t), _people(t)).withColumn("kcal", fix(F.col("kcal"), 3))


@query("p10_live_calories_stream", _P10)
def p10s(t):
    arriving = Tables(t.spark, t.folder)
    arriving.lineitem = _arriving(t, "lineitem")
    live = mon.live_calories(b.executions(arriving), b.exercises(t), _people(t))
    return _latest(t, live, ["session_id"]).withColumn("kcal", fix(F.col("kcal"), 3))
