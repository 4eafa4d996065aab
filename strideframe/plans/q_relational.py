"""Filters, joins, aggregations, ordering and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from strideframe.functions import text
from strideframe.functions.ladders import (ACC_STD, AZ_POSTURE, COMPLETION, FLOW, GYRO, PERCENT, SECONDS_RATIO, direction, intensity, ladder)
from strideframe.functions.mathx import fix
from strideframe.operators import intervals, keyed, names, sketches, stats
from strideframe.operators.sequence import index_rows
from strideframe.plans import bindings as b
from strideframe.plans.bindings import DAY, HOUR, fx, sql
from strideframe.plans.registry import query
from strideframe.session import written

_DAYS = (date(1997, 1, 1), date(1997, 12, 31))


@query("a11_table_source", "SELECT count(*) AS n, count(DISTINCT p_brand) AS brands FROM part")
def a11(t):
    return t.part.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("b01_user_filter", sql("SELECT user_id, session_id, calories FROM sessions WHERE completion = 0.92", "sessions"))
def b01(t):
    return b.sessions(t).filter(F.col("completion") == 0.92).select("user_id", "session_id", "calories")


@query("b02_date_range", sql("SELECT user_id, session_id, day FROM sessions WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'", "sessions"))
def b02(t):
    return b.sessions(t).filter(F.col("day").between(*_DAYS)).select("user_id", "session_id", "day")


@query("b03_in_list", sql("SELECT exercise_id, equipment FROM exercises WHERE equipment IN ('Brand#1', 'Brand#4', 'Brand#23')", "exercises"))
def b03(t):
    return b.exercises(t).filter(F.col("equipment").isin("Brand#1", "Brand#4", "Brand#23")).select("exercise_id", "equipment")


@query("b04_like", sql("SELECT exercise_id, name FROM exercises WHERE name LIKE '%gear%' OR name ILIKE '%RING%'", "exercises"))
def b04(t):
    n = F.col("name")
    return b.exercises(t).filter(n.contains("gear") | n.ilike("%RING%")).select("exercise_id", "name")


@query("b05_array_overlap", sql("SELECT exercise_id, equipment FROM exercises WHERE list_has_any([equipment, difficulty], ['Brand#7', 'advanced'])", "exercises"))
def b05(t):
    have = F.array("equipment", "difficulty")
    return b.exercises(t).filter(F.arrays_overlap(have, F.array(F.lit("Brand#7"), F.lit("advanced")))).select("exercise_id", "equipment")


@query("b06_empty_fields", "SELECT count(*) FILTER (quality IS NULL) AS no_quality, count(*) FILTER (text IS NULL OR trim(text) = '') AS no_text FROM documents LEFT JOIN labels USING (doc_id)")
def b06(t):
    rows = t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left")
    return rows.agg(F.count_if(text.is_empty(rows, "quality")).alias("no_quality"), F.count_if(text.is_empty(rows, "text")).alias("no_text"))


@query("b07_valid_duration", sql("SELECT count(*) AS n FROM executions JOIN sessions USING (session_id) WHERE duration_sec > 300 OR (minutes IS NOT NULL AND minutes > 60)", "executions", "sessions"))
def b07(t):
    rows = b.executions(t).join(b.sessions(t), "session_id")
    return rows.filter((F.col("duration_sec") > 300) | (F.col("minutes").isNotNull() & (F.col("minutes") > 60))).agg(F.count(F.lit(1)).alias("n"))


@query("b08_coalesce_default", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def b08(t):
    return keyed.lookup(t.documents.select("doc_id"), t.labels, ["doc_id"], {"quality": -1, "toxic": 0}).select("doc_id", "quality", "toxic")


def _case(col: str, steps, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} {op} {v} THEN '{lab}'" for op, v, lab in steps) + f" ELSE '{default}' END"


@query("b09_threshold_ladders", sql(f"""SELECT row_id, {_case('gyro / 10', *GYRO)} AS gyro_label, {_case('acc / 5', *ACC_STD)} AS acc_label, {_case('az', *AZ_POSTURE)} AS posture,
      {_case('value / 10', *FLOW)} AS flow, CASE WHEN angle_z >= 315 OR angle_z < 45 THEN 'RIGHT' WHEN angle_z < 135 THEN 'DOWN' WHEN angle_z < 225 THEN 'LEFT' ELSE 'UP' END AS dir,
      CASE WHEN k / 100 >= 0.6 THEN 'high' WHEN k / 100 >= 0.25 THEN 'medium' WHEN k / 100 > 0 THEN 'low' ELSE 'none' END AS intensity,
      {_case('k', *PERCENT)} AS pct_level, {_case('k / 100', *SECONDS_RATIO)} AS sec_level, {_case('k / 100', *COMPLETION)} AS done FROM samples""", "samples"))
def b09(t):
    k = F.col("k") / 100
    return b.samples(t).select(
        "row_id", ladder(F.col("gyro") / 10, GYRO).alias("gyro_label"), ladder(F.col("acc") / 5, ACC_STD).alias("acc_label"),
        ladder(F.col("az"), AZ_POSTURE).alias("posture"), ladder(F.col("value") / 10, FLOW).alias("flow"), direction(F.col("angle_z")).alias("dir"),
        intensity(F.col("k"), F.lit(100)).alias("intensity"), ladder(F.col("k"), PERCENT).alias("pct_level"),
        ladder(k, SECONDS_RATIO).alias("sec_level"), ladder(k, COMPLETION).alias("done"))


@query("b10_unknown_values", "SELECT source, count(*) AS n FROM (SELECT CASE WHEN length(text) % 3 = 0 THEN ' Unknown_' || source WHEN length(text) % 3 = 1 THEN '' ELSE source END AS v, source FROM documents) WHERE v IS NULL OR trim(v) = '' OR lower(trim(v)) LIKE 'unknown%' GROUP BY ALL")
def b10(t):
    n = F.length("text") % 3
    v = F.when(n == 0, F.concat(F.lit(" Unknown_"), "source")).when(n == 1, "").otherwise(F.col("source"))
    return t.documents.filter(text.is_unknown(v)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("c01_inner_join", sql("SELECT user_id, day, exercise_id, CAST(sum(sets) AS BIGINT) AS sets, max(confidence) AS confidence FROM sessions JOIN executions USING (session_id) GROUP BY ALL", "sessions", "executions"))
def c01(t):
    rows = b.sessions(t).join(b.executions(t), "session_id")
    return rows.groupBy("user_id", "day", "exercise_id").agg(F.sum("sets").alias("sets"), F.max("confidence").alias("confidence"))


@query("c02_left_join_counts", sql("SELECT u.user_id, count(s.session_id) AS session_count, max(s.day) AS last_day FROM users u LEFT JOIN sessions s USING (user_id) GROUP BY ALL", "users", "sessions"))
def c02(t):
    s = b.sessions(t).groupBy("user_id").agg(F.count("session_id").alias("c"), F.max("day").alias("last_day"))
    return b.users(t).select("user_id").join(s, "user_id", "left").select("user_id", F.coalesce("c", F.lit(0)).alias("session_count"), "last_day")


@query("c03_left_join_sum", sql("SELECT s.session_id, CAST(coalesce(sum(e.sets), 0) AS BIGINT) AS total_sets FROM sessions s LEFT JOIN executions e USING (session_id) GROUP BY ALL", "sessions", "executions"))
def c03(t):
    e = b.executions(t).groupBy("session_id").agg(F.sum("sets").alias("total_sets"))
    return keyed.lookup(b.sessions(t).select("session_id"), e, ["session_id"], {"total_sets": 0})


@query("c04_lookup_default", sql("SELECT session_id, line, coalesce(x.met, 4.0::DOUBLE) AS met, count(*) AS n FROM executions e LEFT JOIN (SELECT * FROM exercises WHERE exercise_type = 'compound') x USING (exercise_id) GROUP BY ALL", "executions", "exercises"))
def c04(t):
    dim = b.exercises(t).filter("exercise_type = 'compound'").select("exercise_id", "met")
    return keyed.lookup(b.executions(t).select("session_id", "line", "exercise_id"), dim, ["exercise_id"], {"met": 4.0}).groupBy("session_id", "line", "met").agg(F.count(F.lit(1)).alias("n"))


_ASKED = """SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) ELSE 'TRX' || split_part(p_name, ' ', 1) END AS asked FROM part"""


def _asked(t):
    k, words = F.col("p_partkey") % 3, F.split("p_name", " ")
    return t.part.select(F.when(k == 0, F.col("p_name")).when(k == 1, F.get(words, F.lit(1))).otherwise(F.concat(F.lit("TRX"), F.get(words, F.lit(0)))).alias("asked")).distinct()


def _catalogue(t):
    return b.exercises(t).select("exercise_id", "name", F.expr("exercise_id % 10 = 1").cast("int").alias("suffix"))


_FUZZY = """SELECT asked, exercise_id, name, exact FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY exact DESC, exercise_id % 10 = 1, length(name), exercise_id) AS rn
    FROM (SELECT asked, exercise_id, name, asked = name AS exact FROM asked, exercises WHERE NEEDLE)) WHERE rn = 1"""


@query("c05_exact_then_substring", sql(_FUZZY.replace("NEEDLE", "contains(name, asked)"), "exercises", asked=_ASKED))
def c05(t):
    rank = ["suffix", F.length("name"), "exercise_id"]
    return names.lookup_fuzzy(_asked(t), _catalogue(t), "asked", "name", rank).select("asked", "exercise_id", "name", "exact")


@query("c06_prefix_stripped_lookup", sql(_FUZZY.replace("NEEDLE", "asked = name OR (length(core) >= 2 AND contains(name, core))"), "exercises",
    asked=f"SELECT *, trim(regexp_replace(asked, '^(TRX|small|red)', '')) AS core FROM ({_ASKED})"))
def c06(t):
    rank = ["suffix", F.length("name"), "exercise_id"]
    core = text.strip_prefixes(F.col("asked"), ["TRX", "small", "red"])
    return names.lookup_fuzzy(_asked(t), _catalogue(t), "asked", "name", rank, core, 2).select("asked", "exercise_id", "name", "exact")


def _windows(t):
    k = F.explode(F.sequence(F.lit(0), F.floor(F.col("total") / DAY).cast("int")))
    w = b.samples(t).groupBy("recording_id").agg(F.max("t_rel").alias("total")).withColumn("k", k)
    return w.filter(F.col("k") * DAY < F.col("total")).select("recording_id", "k", (F.col("k") * DAY).alias("ws"), (F.col("k") * DAY + DAY).alias("we"))


_WIN = f"SELECT recording_id, k, k * {DAY}::DOUBLE AS ws, k * {DAY}::DOUBLE + {DAY}::DOUBLE AS we FROM (SELECT *, CAST(unnest(generate_series(0, CAST(floor(total / {DAY}::DOUBLE) AS BIGINT))) AS INT) AS k FROM (SELECT recording_id, max(t_rel) AS total FROM samples GROUP BY ALL)) WHERE k * {DAY} < total"


@query("c07_window_label_by_overlap", sql("""SELECT recording_id, k, label FROM (
      SELECT *, row_number() OVER (PARTITION BY recording_id, k ORDER BY ov DESC, run_id) AS rn FROM (
        SELECT w.recording_id, w.k, r.label, r.run_id, least(we, end_sec) - greatest(ws, start_sec) AS ov FROM win w JOIN label_runs r ON r.recording_id = w.recording_id AND r.start_sec < we AND r.end_sec > ws AND r.end_sec > r.start_sec))
    WHERE rn = 1 AND ov / 86400.0::DOUBLE >= 0.6""", "samples", "label_runs", win=_WIN))
def c07(t):
    out = intervals.label_by_overlap(_windows(t), b.label_runs(t), ["recording_id"], ("ws", "we"), ("start_sec", "end_sec"), "label", "run_id", DAY / 2, window_keys=["k"], out="win_label")
    return out.select("recording_id", "k", F.col("win_label").alias("label"))


@query("c09_point_in_interval", sql(f"""SELECT r.recording_id, r.run_id, count(*) AS n, {fx('sum(s.value)', 4)} AS total FROM label_runs r JOIN samples s
      ON s.recording_id = r.recording_id AND s.t_rel >= r.start_sec - {HOUR} AND s.t_rel <= r.end_sec + {HOUR} GROUP BY ALL""", "samples", "label_runs"))
def c09(t):
    pts = b.samples(t).select("recording_id", "t_rel", "value")
    pairs = intervals.points_in(pts, b.label_runs(t), ["recording_id"], "t_rel", ("start_sec", "end_sec"), DAY / 2, pad=HOUR)
    return pairs.groupBy("recording_id", "run_id").agg(F.count(F.lit(1)).alias("n"), fix(F.sum("value"), 4).alias("total"))


@query("c10_map_join", sql("SELECT r.recording_id, r.run_id, r.label, p.pred_action, p.pred_sets FROM label_runs r LEFT JOIN (SELECT * FROM predictions WHERE version = 'v1' AND pred_action <> 'other') p ON p.recording_id = r.recording_id AND p.pred_id = r.run_id", "label_runs", "predictions"))
def c10(t):
    p = b.predictions(t).filter("version = 'v1' AND pred_action <> 'other'").select("recording_id", F.col("pred_id").alias("run_id"), "pred_action", "pred_sets")
    return b.label_runs(t).select("recording_id", "run_id", "label").join(p, ["recording_id", "run_id"], "left")


@query("c11_generated_segment_id", sql("SELECT recording_id, run_id, 'seg_' || (row_number() OVER (PARTITION BY recording_id ORDER BY run_id) - 1) AS seg_id FROM label_runs", "label_runs"))
def c11(t):
    rows = index_rows(b.label_runs(t).select("recording_id", "run_id"), ["recording_id"], ["run_id"], width=50_000)
    return rows.select("recording_id", "run_id", F.concat(F.lit("seg_"), (F.col("pos") - 1).cast("string")).alias("seg_id"))


@query("c11_exercise_id_text", sql("SELECT recording_id, run_id, printf('exercise_%03d', row_number() OVER (PARTITION BY recording_id ORDER BY run_id)) AS seg_id FROM label_runs WHERE label = 'click'", "label_runs"))
def c11b(t):
    rows = b.label_runs(t).filter("label = 'click'").select("recording_id", "run_id")
    out = index_rows(rows, ["recording_id"], ["run_id"], width=50_000)
    return out.select("recording_id", "run_id", F.format_string("exercise_%03d", "pos").alias("seg_id"))


@query("c12_anti_joins", "SELECT 'no_label' AS side, doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT 'no_document', doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)")
def c12(t):
    docs, labs = t.documents.select("doc_id"), t.labels.select("doc_id")
    left = keyed.missing(docs, labs, ["doc_id"]).select(F.lit("no_label").alias("side"), "doc_id")
    return left.unionByName(keyed.missing(labs, docs, ["doc_id"]).select(F.lit("no_document").alias("side"), "doc_id"))


@query("c13_semi_join", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def c13(t):
    plan = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return keyed.present(t.part.select("p_partkey", "p_name"), plan, ["p_partkey"])


@query("c15_nearest_in_time", sql("""SELECT recording_id, k, row_id FROM (SELECT w.recording_id, w.k, s.row_id, row_number() OVER (PARTITION BY w.recording_id, w.k ORDER BY abs(s.t_rel - w.ws), s.t_rel, s.row_id) AS rn
    FROM win w JOIN samples s USING (recording_id)) WHERE rn = 1""", "samples", win=_WIN))
def c15(t):
    goals = _windows(t).select("recording_id", "k", F.col("ws").alias("t_rel"))
    near = intervals.asof_nearest(goals, b.samples(t).select("recording_id", "t_rel", "row_id"), ["recording_id"], "t_rel", "row_id", ["row_id"])
    return near.select("recording_id", "k", "row_id")


@query("d01_keyed_aggregates", sql("SELECT user_id, count(*) AS n, max(calories) AS top, min(day) AS first_day, CAST(sum(minutes) AS BIGINT) AS minutes FROM sessions GROUP BY ALL", "sessions"))
def d01(t):
    return b.sessions(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("calories").alias("top"), F.min("day").alias("first_day"), F.sum("minutes").alias("minutes"))


@query("d02_global_stats", f"SELECT count(*) AS n, count(quality) AS with_quality, min(n_chars) AS lo, max(n_chars) AS hi, {fx('avg(n_chars)')} AS mean FROM documents LEFT JOIN labels USING (doc_id)")
def d02(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("with_quality"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), fix(F.avg("n_chars")).alias("mean"))


@query("d03_frequency_table", "SELECT p_name, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_name")
def d03(t):
    return t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_name")


@query("d04_distribution", f"SELECT user_id, event_type, n, {fx('n / sum(n) OVER (PARTITION BY user_id)')} AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def d04(t):
    return stats.distribution(t.events, ["user_id"], "event_type").withColumn("share", fix(F.col("share")))


@query("d05_aggregate_by_name", sql(f"""SELECT session_id, name, CAST(sum(sets) AS BIGINT) AS sets, max(reps) AS reps, min(line) AS first_line, max(line) AS last_line, {fx('sum(duration_sec)')} AS duration_sec, max(confidence) AS confidence
    FROM executions JOIN exercises USING (exercise_id) GROUP BY ALL""", "executions", "exercises"))
def d05(t):
    rows = b.executions(t).join(b.exercises(t).select("exercise_id", "name"), "exercise_id")
    return rows.groupBy("session_id", "name").agg(
        F.sum("sets").alias("sets"), F.max("reps").alias("reps"), F.min("line").alias("first_line"), F.max("line").alias("last_line"),
        fix(F.sum("duration_sec")).alias("duration_sec"), F.max("confidence").alias("confidence"))


@query("d06_mode_first_seen", sql("""SELECT recording_id, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY votes DESC, seen) AS rn FROM (
      SELECT recording_id, label, count(*) AS votes, min((t_rel, row_id)) AS seen FROM samples GROUP BY recording_id, label)) WHERE rn = 1""", "samples"))
def d06(t):
    return stats.mode_first(b.samples(t), ["recording_id"], "label", ["t_rel", "row_id"])


@query("d07_distinct_counts", sql("SELECT user_id, count(DISTINCT day) AS days, count(DISTINCT exercise_id) AS exercises FROM sessions JOIN executions USING (session_id) GROUP BY ALL", "sessions", "executions"))
def d07(t):
    rows = b.sessions(t).join(b.executions(t), "session_id")
    return rows.groupBy("user_id").agg(F.count_distinct("day").alias("days"), F.count_distinct("exercise_id").alias("exercises"))


@query("d08_weighted_mean", sql(f"SELECT session_id, {fx('CASE WHEN sum(sets) = 0 THEN 0 ELSE sum(confidence * sets) / sum(sets) END')} AS confidence FROM executions GROUP BY ALL", "executions"))
def d08(t):
    return b.executions(t).groupBy("session_id").agg(fix(stats.weighted_mean(F.col("confidence"), F.col("sets"))).alias("confidence"))


@query("d09_std_both_forms", f"SELECT user_id, {fx('stddev_pop(value)')} AS pop, {fx('stddev_samp(value)')} AS samp FROM events GROUP BY ALL")
def d09(t):
    return t.events.groupBy("user_id").agg(fix(F.stddev_pop("value")).alias("pop"), fix(F.stddev_samp("value")).alias("samp"))


@query("d10_median", f"SELECT user_id, {fx('quantile_cont(value, 0.5)')} AS median FROM events GROUP BY ALL")
def d10(t):
    return stats.exact_quantiles(t.events, ["user_id"], "value", {"median": 0.5}).withColumn("median", fix(F.col("median")))


@query("d11_percentile_95", f"SELECT event_type, {fx('quantile_cont(value, 0.95)')} AS p95, {fx('quantile_cont(value, 0.5)')} AS p50 FROM events GROUP BY ALL")
def d11(t):
    out = stats.exact_quantiles(t.events, ["event_type"], "value", {"p95": 0.95, "p50": 0.5})
    return out.withColumns({"p95": fix(F.col("p95")), "p50": fix(F.col("p50"))})


@query("d12_circular_mean", sql(f"SELECT recording_id, {fx('degrees(atan2(avg(sin(radians(angle_z))), avg(cos(radians(angle_z)))))', 5)} AS mean_angle FROM samples GROUP BY ALL", "samples"))
def d12(t):
    return b.samples(t).groupBy("recording_id").agg(fix(stats.circular_mean(F.col("angle_z")), 5).alias("mean_angle"))


@query("d13_conditional_ratio", f"SELECT user_id, count(*) FILTER (value > 50) AS high, {fx('avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS share FROM events GROUP BY ALL")
def d13(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("high"), fix(F.avg((F.col("value") > 50).cast("double"))).alias("share"))


@query("d14_best_by_key", sql("SELECT name, max(confidence) AS best FROM executions JOIN exercises USING (exercise_id) GROUP BY ALL", "executions", "exercises"))
def d14(t):
    best = b.executions(t).groupBy("exercise_id").agg(F.max("confidence").alias("best"))
    return best.join(b.exercises(t).select("exercise_id", "name"), "exercise_id").groupBy("name").agg(F.max("best").alias("best"))


@query("d15_completeness", "SELECT field, n_empty FROM (SELECT unnest(['quality', 'toxic', 'lang']) AS field, unnest([count(*) FILTER (quality IS NULL), count(*) FILTER (toxic IS NULL), count(*) FILTER (lang IS NULL OR trim(lang) = '')]) AS n_empty FROM documents LEFT JOIN labels USING (doc_id))")
def d15(t):
    return stats.count_empty(t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left"), ["quality", "toxic", "lang"])


@query("d16_long_to_wide", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS active, " + fx("avg(value)") + " AS mean_score, string_agg(DISTINCT CAST(user_id % 5 AS VARCHAR), ',' ORDER BY CAST(user_id % 5 AS VARCHAR)) AS classes FROM events GROUP BY ALL")
def d16(t):
    return t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("active"), fix(F.avg("value")).alias("mean_score"),
        F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 5).cast("string"))), ",").alias("classes"))


@query("f01_ordering", sql("SELECT exercise_id, difficulty, met FROM exercises ORDER BY CASE difficulty WHEN 'advanced' THEN 1 WHEN 'intermediate' THEN 2 ELSE 3 END, met DESC NULLS LAST, exercise_id", "exercises"))
def f01(t):
    rank = F.when(F.col("difficulty") == "advanced", 1).when(F.col("difficulty") == "intermediate", 2).otherwise(3)
    return b.exercises(t).select("exercise_id", "difficulty", "met").orderBy(rank, F.desc_nulls_last("met"), "exercise_id")


@query("f02_limit_offset", sql("SELECT session_id, calories FROM sessions ORDER BY calories DESC, session_id LIMIT 20 OFFSET 10", "sessions"))
def f02(t):
    return b.sessions(t).select("session_id", "calories").orderBy(F.desc("calories"), "session_id").offset(10).limit(20)


@query("f03_last_three_per_user", sql("SELECT user_id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC, session_id DESC) AS rn FROM sessions) WHERE rn <= 3", "sessions"))
def f03(t):
    return keyed.latest(b.sessions(t).select("user_id", "day", "session_id"), ["user_id"], ["day", "session_id"], 3).drop("day")


@query("f04_distinct_on", sql("SELECT DISTINCT ON (name) name, exercise_id, met FROM exercises ORDER BY name, CASE WHEN equipment LIKE 'Brand#1%' THEN 0 ELSE 1 END, exercise_id", "exercises"))
def f04(t):
    first = F.when(F.col("equipment").startswith("Brand#1"), 0).otherwise(1)
    return keyed.pick_first(b.exercises(t), ["name"], [first, "exercise_id"]).select("name", "exercise_id", "met")


@query("f05_pick_first", sql("SELECT recording_id, label, row_id FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, label ORDER BY value DESC, row_id) AS rn FROM samples) WHERE rn = 1", "samples"))
def f05(t):
    return keyed.pick_first(b.samples(t), ["recording_id", "label"], [F.desc("value"), "row_id"]).select("recording_id", "label", "row_id")


@query("f09_first_seen_dedupe", "SELECT p_name AS name, min(p_partkey) AS first_id FROM part GROUP BY ALL")
def f09(t):
    return keyed.pick_first(t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("first_id")), ["name"], ["first_id"])


@query("g01_concatenate", "SELECT kind, count(*) AS n FROM (SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) GROUP BY ALL")
def g01(t):
    both = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).unionByName(t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("g02_precedence_union", "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE 'default' END AS origin FROM labels l FULL OUTER JOIN documents d USING (doc_id)")
def g02(t):
    labelled = t.labels.select("doc_id", "quality", F.lit("labelled").alias("origin"))
    return keyed.prefer([labelled, t.documents.select("doc_id", F.lit(-1).alias("quality"), F.lit("default").alias("origin"))], ["doc_id"])


@query("g03_set_difference", sql("SELECT user_id, muscle FROM (SELECT DISTINCT user_id FROM users), (SELECT DISTINCT primary_muscle AS muscle FROM exercises) EXCEPT SELECT user_id, primary_muscle FROM sessions JOIN executions USING (session_id) JOIN exercises USING (exercise_id)", "users", "sessions", "executions", "exercises"))
def g03(t):
    wanted = b.users(t).select("user_id", F.explode(F.array(*[F.lit(m) for m in b.MUSCLES])).alias("muscle"))
    ex = b.exercises(t).select("exercise_id", F.col("primary_muscle").alias("muscle"))
    done = b.executions(t).join(b.sessions(t), "session_id").select("user_id", "exercise_id").distinct().join(ex, "exercise_id")
    return keyed.missing(wanted, done, ["user_id", "muscle"])


@query("g04_set_intersection", sql("SELECT exercise_id, (list_has_any([exercise_type, difficulty], ['compound', 'advanced'])) AS hit FROM exercises", "exercises"))
def g04(t):
    return b.exercises(t).select("exercise_id", F.arrays_overlap(F.array("exercise_type", "difficulty"), F.array(F.lit("compound"), F.lit("advanced"))).alias("hit"))


@query("g05_timeline_merge", "SELECT clock, event_type, min(origin) AS origin FROM (SELECT strftime(ts, '%H:%M:%S') AS clock, event_type, CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS origin FROM events) GROUP BY ALL ORDER BY clock, event_type")
def g05(t):
    from strideframe.functions.timex import clock_to_sec

    e = t.events.select(F.date_format("ts", "HH:mm:ss").alias("clock"), "event_type", (F.col("user_id") % 2).cast("int").alias("origin"))
    halves = [e.filter("origin = 0"), e.filter("origin = 1")]
    return keyed.prefer(halves, ["clock", "event_type"]).orderBy(clock_to_sec(F.col("clock")), "event_type")


@query("a15_upsert_keep_old", """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE o.c_name END AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal
    FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) o FULL OUTER JOIN (SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0) n USING (c_custkey)""")
def a15(t):
    cols = ["c_custkey", "c_name", "c_acctbal"]
    old = t.customer.filter("c_custkey % 3 <> 0").select(cols)
    new = t.customer.filter("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return keyed.upsert(old, new, ["c_custkey"], keep_old_if_null=["c_acctbal"])


@query("a16_insert_if_absent", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def a16(t):
    return keyed.insert_absent(t.labels.select("doc_id", "quality"), t.documents.select("doc_id", F.lit(-1).alias("quality")), ["doc_id"])


@query("a17_resume_missing", sql("SELECT recording_id, run_id FROM label_runs r WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.version = 'v1' AND p.pred_action <> 'other' AND p.recording_id = r.recording_id AND p.pred_id = r.run_id)", "label_runs", "predictions"))
def a17(t):
    done = b.predictions(t).filter("version = 'v1' AND pred_action <> 'other'").select("recording_id", F.col("pred_id").alias("run_id"))
    return keyed.resume(done, b.label_runs(t).select("recording_id", "run_id"), ["recording_id", "run_id"])


@query("d07_merged_states", sql("""SELECT month, people, true AS people_within, true AS median_within, true AS p95_within FROM (SELECT strftime(day, '%Y-%m') AS month, count(DISTINCT user_id) AS people FROM sessions GROUP BY ALL)""", "sessions"))
def d07b(t):
    """Distinct users and load quantiles of each month from stored states of its days, held against the rows."""
    month = F.date_format("day", "yyyy-MM").alias("month")
    rows = b.sessions(t).select("day", "user_id", "calories", month)
    states = written(sketches.daily_states(rows, ["month", "day"], "user_id", "calories"))
    est = sketches.estimates(sketches.merged_states(states, ["month"]), (0.5, 0.95))
    share = lambda q, op: F.avg(op(F.col("calories"), F.col(q)).cast("double"))
    near = lambda q, x: (share(q, lambda a, b: a < b) <= x + 0.03) & (share(q, lambda a, b: a <= b) >= x - 0.03)
    held = rows.join(est, "month").groupBy("month").agg(F.count_distinct("user_id").alias("people"), F.any_value("distinct").alias("_e"), near("q50", 0.5).alias("median_within"), near("q95", 0.95).alias("p95_within"))
    return held.select("month", "people", (F.abs(F.col("_e") - F.col("people")) <= 0.08 * F.col("people") + 1).alias("people_within"), "median_within", "p95_within")
