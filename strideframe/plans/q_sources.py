"""Source parsers over text that Spark derives from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strideframe.functions.mathx import fix
from strideframe.operators.keyed import prefer
from strideframe.plans import bindings as b
from strideframe.plans.bindings import DAY, fx, sql
from strideframe.plans.registry import query
from strideframe.session import scratch_root
from strideframe.sources import readers, writers
from strideframe.sources.versions import Store


@query("a01_sensor_lines", f"""SELECT user_id AS recording_id, count(*) AS n, {fx('sum(value)', 4)} AS total, {fx('max(CAST(epoch_us(ts) - t0 AS DOUBLE) / 1e6)')} AS last_sec FROM (SELECT *, min(epoch_us(ts)) FILTER (event_id % 10 <> 0) OVER (PARTITION BY user_id) AS t0 FROM events) WHERE event_id % 10 NOT IN (0, 1, 2) GROUP BY ALL""")
def a01(t):
    m = F.col("event_id") % 10
    cells = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("dev"), F.when(m == 1, "null").otherwise(F.col("value").cast("string")), F.lit("0.1"), F.lit("-0.9"), F.lit("1"), F.when(m == 2, "x").otherwise("2"), F.lit("3")]
    line = F.when(m == 0, F.concat_ws("\t", *cells[:5])).otherwise(F.concat_ws("\t", *cells, F.lit("null")))
    rows = readers.parse_sensor_lines(t.events.select(F.col("user_id").alias("recording_id"), line.alias("value")))
    return rows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), fix(F.sum("ax"), 4).alias("total"), fix(F.max("t_rel")).alias("last_sec"))


@query("a02_header_resolution", sql("SELECT row_id, ax, az, angle_z FROM samples", "samples"))
def a02(t):
    raw = b.samples(t).select("row_id", F.col("ts").alias("Time Stamp"), F.col("ax").alias("Acc-X"), F.col("ay").alias("加速度Y(g)"), F.col("az").alias("raw acc_z value"), F.col("angle_z").alias("Pitch"))
    names = readers.resolve_columns(raw.columns[1:])
    return raw.select("row_id", *[F.col(f"`{names[c]}`").alias(c) for c in ("ax", "az", "angle_z")])


@query("a03_hr_rows", """SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN ts ELSE TIMESTAMP '2024-01-01' + to_microseconds(CAST(value * 1e6 AS BIGINT)) END AS VARCHAR) AS at, CAST(trunc(value) AS INT) AS heart_rate FROM events WHERE event_id % 5 <> 0""")
def a03(t):
    m = F.col("event_id")
    time = F.when(m % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.col("value").cast("string"))
    raw = t.events.select("event_id", time.alias("Time"), F.when(m % 5 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("Heart Rate"))
    rows = readers.parse_hr(raw, *readers.hr_columns(raw.columns), F.lit("2024-01-01 00:00:00"))
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return rows.select("event_id", F.regexp_replace(F.regexp_replace(at, r"0+$", ""), r"\.$", "").alias("at"), "heart_rate")


@query("a04_recognition_json", sql("""SELECT session_id, line % 2 AS side, count(*) AS results, CAST(sum(CASE WHEN line % 3 = 0 THEN sets ELSE 2 END) AS BIGINT) AS total_sets, CAST(sum(CASE WHEN line % 3 = 0 THEN reps ELSE reps + 4 END) AS BIGINT) AS total_reps FROM executions GROUP BY ALL""", "executions"))
def a04(t):
    e = b.executions(t)
    two = F.to_json(F.array(F.struct(F.lit(1).alias("set_number"), F.col("reps").alias("reps")), F.struct(F.lit(2).alias("set_number"), F.lit(4).alias("reps"))))
    sets = F.when(F.col("line") % 3 == 0, F.concat(F.col("sets").cast("string"), F.lit(',"reps":'), F.col("reps").cast("string"))).otherwise(two)
    item = F.concat(F.lit('{"seg_idx":'), F.col("line").cast("string"), F.lit(',"startTime":0,"endTime":9,"result":{"exercise":"x","confidence":"0.9","sets":'), sets, F.lit("}}"))
    side = F.col("line") % 2
    value = F.when(side == 0, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.concat(F.lit('{"results":['), item, F.lit("]}")))
    rows = readers.parse_recognition(e.select("session_id", side.alias("side"), value.alias("value")), "session_id", "side")
    return rows.groupBy("session_id", "side").agg(F.count(F.lit(1)).alias("results"), F.sum("total_sets").alias("total_sets"), F.sum("total_reps").alias("total_reps"))


@query("a05_periods_prefer_adjusted", sql("SELECT recording_id, run_id, CASE WHEN run_id % 4 = 0 THEN floor(start_sec) + 5 ELSE floor(start_sec) END AS start_sec, upper(label) AS state FROM label_runs", "label_runs"))
def a05(t):
    r = b.label_runs(t).select("recording_id", "run_id", "start_sec", "label")

    def doc(shift: int):
        s = F.floor("start_sec") + shift
        time = F.when(F.col("run_id") % 2 == 0, F.concat(F.lit('"start_sec":'), s.cast("string"))).otherwise(F.concat(F.lit('"start_time":"'), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60), F.lit('"')))
        return F.concat(F.lit('{"segments":[{'), time, F.lit(',"state":"'), F.upper("label"), F.lit('"}]}'))

    raw = r.select("recording_id", "run_id", doc(0).alias("value"))
    adjusted = r.filter("run_id % 4 = 0").select("recording_id", "run_id", doc(5).alias("value"))
    segs = readers.parse_periods(prefer([adjusted, raw], ["recording_id", "run_id"]), "recording_id", "run_id")
    return segs.select("recording_id", "run_id", "start_sec", "state")


@query("a06_ground_truth", sql("""SELECT recording_id, kind AS type, count(*) AS n, CAST(sum(sets) AS BIGINT) AS sets, CAST(sum(reps) AS BIGINT) AS reps, max(e) AS last_end FROM (SELECT * EXCLUDE (reps), CASE label WHEN 'view' THEN 'transition' WHEN 'error' THEN 'rest' ELSE 'exercise' END AS kind,
      CASE WHEN run_id % 9 = 0 THEN max(CASE WHEN run_id % 9 <> 0 THEN floor(end_sec / 100) END) OVER (PARTITION BY recording_id) ELSE floor(end_sec / 100) END AS e, CASE WHEN run_id % 2 = 0 THEN 2 ELSE 1 END AS sets, CASE WHEN run_id % 2 = 0 THEN n + 8 END AS reps FROM label_runs) GROUP BY ALL""", "label_runs"))
def a06(t):
    r = b.label_runs(t)
    name = F.when(F.col("label") == "view", "transition").when(F.col("label") == "error", "Rest").otherwise(F.col("label"))
    end = F.when(F.col("run_id") % 9 == 0, "TOTAL").otherwise(F.floor(F.col("end_sec") / 100).cast("string"))
    reps = F.when(F.col("run_id") % 2 == 0, F.concat(F.lit('"8 x '), F.col("n").cast("string"), F.lit('"'))).otherwise("null")
    item = F.concat(F.lit('[{"start":'), F.floor(F.col("start_sec") / 100).cast("string"), F.lit(',"end":'), end, F.lit(',"label":"'), name, F.lit('","reps":'), reps, F.lit("},]"))
    rows = readers.parse_truth(r.select("recording_id", item.alias("value")), "recording_id")
    return rows.groupBy("recording_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("sets").alias("sets"), F.sum("reps").alias("reps"), F.max("end_sec").alias("last_end"))


@query("a07_mapping", "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS title, p_brand AS gear FROM part")
def a07(t):
    entry = F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("gear"))
    docs = t.part.groupBy(F.floor(F.col("p_partkey") / 100).alias("chunk")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), entry)))).alias("value"))
    return readers.parse_mapping(docs, "struct<title:string,gear:string>")


@query("a08_flow_series", sql(f"SELECT recording_id, count(*) AS n, {fx('sum(value)', 4)} AS flow, max(label) AS last_direction FROM samples GROUP BY ALL", "samples"))
def a08(t):
    rec = F.struct(F.col("t_rel").alias("time_sec"), F.col("value").alias("avg_flow"), F.col("label").alias("dominant_direction"))
    docs = b.samples(t).groupBy("recording_id", F.floor(F.col("t_rel") / 60.0).alias("_m")).agg(F.to_json(F.collect_list(rec)).alias("value"))
    rows = readers.parse_series(docs, readers.FLOW_ITEM, "recording_id")
    return rows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), fix(F.sum("avg_flow"), 4).alias("flow"), F.max("dominant_direction").alias("last_direction"))


@query("a10_plan_documents", sql("SELECT session_id, count(DISTINCT line % 3) AS days, count(*) AS entries, CAST(sum(sets) AS BIGINT) AS sets FROM executions GROUP BY ALL", "executions"))
def a10(t):
    item = F.struct(F.col("exercise_id").cast("string").alias("exercise_id"), F.lit("main").alias("phase"), F.col("sets").alias("sets"))
    days = b.executions(t).select("session_id", (F.col("line") % 3).alias("day"), F.array(item).alias("exercises"))
    plan = F.struct(F.lit("2024-01-01").alias("generated_at"), F.struct(F.array(F.struct("day", "exercises")).alias("weekly_schedule")).alias("plan"))
    rows = readers.parse_plans(days.select("session_id", F.to_json(plan).alias("value")), "session_id")
    return rows.groupBy("session_id").agg(F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("entries"), F.sum("sets").alias("sets"))


@query("a12_numbered_frames", 'SELECT recording_id, "index" FROM (SELECT recording_id, "index", row_number() OVER (PARTITION BY recording_id ORDER BY "index") AS rn FROM (SELECT DISTINCT user_id AS recording_id, event_id // 2 AS "index" FROM events)) WHERE (rn - 1) % 3 = 0')
def a12(t):
    path = F.concat(F.lit("/frames/"), F.col("user_id").cast("string"), F.lit("/frame_"), F.format_string("%08d", F.floor(F.col("event_id") / 2)), F.when(F.col("event_id") % 2 == 0, ".jpg").otherwise("_copy.jpg"))
    names = t.events.select(F.col("user_id").alias("recording_id"), path.alias("path"))
    return readers.numbered_frames(names, ["recording_id"], "path", 3).select("recording_id", "index")


@query("a13_written_results", sql(f"SELECT day, count(*) AS sessions, {fx('sum(calories)', 2)} AS calories FROM sessions GROUP BY ALL", "sessions"))
def a13(t):
    """Daily totals written as CSV and as Parquet by month, and read back from both."""
    root = scratch_root(t.spark).rstrip("/") + "/" + uuid.uuid4().hex
    days = b.sessions(t).groupBy("day").agg(F.count(F.lit(1)).alias("sessions"), fix(F.sum("calories"), 2).alias("calories"))
    writers.write_result(days, f"{root}/csv", "csv")
    back = t.spark.read.schema(days.schema).option("header", True).csv(f"{root}/csv")
    writers.write_result(back.withColumn("month", F.date_format("day", "yyyy-MM")), f"{root}/parquet", "parquet", ["month"])
    return t.spark.read.parquet(f"{root}/parquet").drop("month")


_PULSES = "SELECT user_id, CAST(ts AS DATE) AS day, value FROM events"


@query("a14_user_day_replacement", sql(f"""SELECT 'sessions' AS tbl, user_id, count(*) AS n, {fx('sum(minutes)', 2)} AS total FROM (SELECT user_id, minutes FROM sessions WHERE user_id % 7 <> 0 UNION ALL SELECT user_id, arg_min(minutes, session_id) FROM sessions WHERE user_id % 7 = 0 GROUP BY user_id, day) GROUP BY ALL
    UNION ALL SELECT 'executions', user_id, count(*), {fx('sum(reps)', 2)} FROM executions JOIN sessions USING (session_id) WHERE user_id % 7 <> 0 GROUP BY ALL
    UNION ALL SELECT 'pulses', user_id, count(*), {fx('sum(CASE WHEN user_id % 7 = 0 THEN value + 1 ELSE value END)', 2)} FROM pulses GROUP BY ALL""", "sessions", "executions", pulses=_PULSES))
def a14(t):
    """All three tables of some users replaced in one step and read back."""
    store = Store(t.spark, scratch_root(t.spark).rstrip("/") + "/" + uuid.uuid4().hex)
    sessions = b.sessions(t).select("user_id", "day", "session_id", "minutes")
    executions = b.executions(t).join(sessions.select("session_id", "user_id", "day"), "session_id").select("user_id", "day", "session_id", "reps")
    pulses = t.events.select("user_id", F.to_date("ts").alias("day"), "value")
    store.replace({"sessions": sessions, "executions": executions, "pulses": pulses})
    some = F.col("user_id") % 7 == 0
    first = sessions.filter(some).groupBy("user_id", "day").agg(F.min_by(F.struct("session_id", "minutes"), "session_id").alias("_s")).select("user_id", "day", "_s.*")
    store.replace({"sessions": first, "pulses": pulses.filter(some).withColumn("value", F.col("value") + 1)})
    parts = [store.read(table).groupBy(F.lit(table).alias("tbl"), "user_id").agg(F.count(F.lit(1)).alias("n"), fix(F.sum(c).cast("double"), 2).alias("total")) for table, c in (("sessions", "minutes"), ("executions", "reps"), ("pulses", "value"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
