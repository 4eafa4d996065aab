"""Workout, muscle-load, energy, balance and heart-rate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions.ladders import SCORE, ladder
from strideframe.functions.mathx import fix
from strideframe.operators import heart, load
from strideframe.operators.stats import distribution
from strideframe.plans import bindings as b
from strideframe.plans.bindings import DAY, HOUR, fx, sql
from strideframe.plans.registry import query

_TYPES = ", ".join(f"('{m}')" for m in b.MUSCLES)


def _user_exec(t):
    return b.executions(t).join(b.sessions(t).select("session_id", "user_id", "day"), "session_id")


_USER_EXEC = "SELECT e.*, s.user_id, s.day FROM executions e JOIN sessions s USING (session_id)"


def _work_sql(keys: str, value: str, w1: float, w2: float, source: str = "executions") -> str:
    return f"""SELECT {keys}, m AS muscle, side || m AS body_key, v * w AS score FROM (
        SELECT {keys}, exercise_id, sum({value}) AS v FROM {source} GROUP BY {keys}, exercise_id) q
        JOIN (SELECT exercise_id, side, primary_muscle AS m, {w1}::DOUBLE AS w FROM exercises
              UNION ALL SELECT exercise_id, side, secondary_muscle, {w2}::DOUBLE FROM exercises) x USING (exercise_id)"""


@query("l01_daily_summary", sql("""SELECT user_id, day, session_id, minutes, calories, completion FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY start_time, session_id) AS rn FROM sessions) WHERE rn = 1""", "sessions"))
def l01(t):
    return load.daily_summary(b.sessions(t)).select("user_id", "day", "session_id", "minutes", "calories", "completion")


_MET = """coalesce(x.met, 4.0::DOUBLE) * u.weight * (e.sec / 3600) * CASE WHEN u.gender = 'female' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END"""
_MET_FROM = """FROM (SELECT session_id, exercise_id, sum(duration_sec) AS sec FROM executions WHERE duration_sec > 0 GROUP BY ALL) e
    LEFT JOIN exercises x USING (exercise_id) JOIN sessions s USING (session_id) JOIN users u USING (user_id) GROUP BY session_id"""


def _people(t):
    return b.sessions(t).select("session_id", "user_id").join(b.users(t).select("user_id", "weight", "gender", "age"), "user_id")


@query("l02_met_calories", sql(f"""SELECT session_id, {fx(f"sum({_MET} * greatest(0.75::DOUBLE, 1.0::DOUBLE - greatest(0, u.age - 20) * 0.005::DOUBLE))", 3)} AS kcal {_MET_FROM}""",
    "executions", "exercises", "sessions", "users"))
def l02(t):
    return load.calories(b.executions(t), b.exercises(t), _people(t), ["session_id"]).withColumn("kcal", fix(F.col("kcal"), 3))


@query("l03_met_calories_no_age", sql(f"SELECT session_id, {fx(f'sum({_MET})', 3)} AS kcal {_MET_FROM}", "executions", "exercises", "sessions", "users"))
def l03a(t):
    return load.calories(b.executions(t), b.exercises(t), _people(t), ["session_id"], use_age=False).withColumn("kcal", fix(F.col("kcal"), 3))


@query("l03_hr_calories", sql(f"""SELECT session_id, {fx('''greatest(0.0::DOUBLE, CASE WHEN gender = 'female'
      THEN (-20.4022::DOUBLE + hr * 0.4472::DOUBLE + weight * -0.1263::DOUBLE + age * 0.0740::DOUBLE) / 4.184::DOUBLE
      ELSE (-55.0969::DOUBLE + hr * 0.6309::DOUBLE + weight * 0.1988::DOUBLE + age * 0.2017::DOUBLE) / 4.184::DOUBLE END) * minutes''')} AS kcal
    FROM (SELECT *, CAST(80 + session_id % 100 AS DOUBLE) AS hr FROM sessions) JOIN users USING (user_id)""", "sessions", "users"))
def l03b(t):
    s = b.sessions(t).withColumn("hr", (F.col("session_id") % 100 + 80).cast("double")).join(b.users(t), "user_id")
    per_min = load.hr_kcal_per_minute(F.col("hr"), F.col("weight"), F.col("gender"), F.col("age"))
    return s.select("session_id", fix(per_min * F.col("minutes")).alias("kcal"))


@query("l04_label_calories", sql(f"""SELECT recording_id, label, frames, {fx('seconds')} AS seconds, met, {fx('met * 65.0::DOUBLE * (seconds / 3600.0::DOUBLE)')} AS kcal FROM (
    SELECT c.*, frames * gap_sec AS seconds, coalesce(met, 4.0::DOUBLE) AS met FROM (SELECT recording_id, label, count(*) AS frames FROM samples GROUP BY ALL) c
    JOIN (SELECT recording_id, max(t_rel) AS gap_sec FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS rn FROM samples) WHERE rn = 2 GROUP BY ALL) USING (recording_id)
    LEFT JOIN (VALUES ('view', 3.5::DOUBLE), ('click', 5.0::DOUBLE), ('purchase', 6.0::DOUBLE)) m(label, met) USING (label))""", "samples"))
def l04(t):
    s = b.samples(t)
    from strideframe.operators.keyed import top_k

    gap = top_k(s, ["recording_id"], ["t_rel", "row_id"], 2, "_rn").filter("_rn = 2").select("recording_id", F.col("t_rel").alias("gap_sec"))
    mets = t.spark.createDataFrame([("view", 3.5), ("click", 5.0), ("purchase", 6.0)], "label string, met double")
    out = load.label_calories(s, ["recording_id"], gap, mets)
    return out.withColumns({"seconds": fix(F.col("seconds")), "kcal": fix(F.col("kcal"))})


@query("l05_session_muscle_score", sql(f"SELECT session_id, muscle, sum(score) AS score FROM ({_work_sql('session_id', 'sets', 2, 1)}) GROUP BY ALL", "executions", "exercises"))
def l05(t):
    return load.muscle_scores(b.executions(t), b.exercises(t), ["session_id"])


@query("l05_session_body_score", sql(f"SELECT session_id, body_key, sum(score) AS score FROM ({_work_sql('session_id', 'sets', 2, 1)}) GROUP BY ALL", "executions", "exercises"))
def l05b(t):
    return load.muscle_scores(b.executions(t), b.exercises(t), ["session_id"], by="body_key")


_USER_SCORE = f"SELECT user_id, muscle, sum(score) AS score FROM ({_work_sql('user_id', 'sets', 2, 1, 'ue')}) GROUP BY ALL"


def _user_scores(t):
    return load.muscle_scores(_user_exec(t), b.exercises(t), ["user_id"])


@query("l06_group_share", sql(f"SELECT user_id, muscle, score, {fx('score / sum(score) OVER (PARTITION BY user_id) * 100')} AS share_pct FROM us WHERE score > 0",
    "executions", "exercises", "sessions", ue=_USER_EXEC, us=_USER_SCORE))
def l06(t):
    return load.share_of_total(_user_scores(t), ["user_id"]).withColumn("share_pct", fix(F.col("share_pct")))


@query("l06_relative_heatmap", sql(f"""SELECT user_id, muscle, score, {fx('CASE WHEN max(score) OVER w = 0 THEN 0 ELSE score / max(score) OVER w END * 100')} AS relative_pct
    FROM (SELECT u.user_id, m.muscle, coalesce(us.score, 0) AS score FROM (SELECT DISTINCT user_id FROM us) u CROSS JOIN (VALUES {_TYPES}) m(muscle)
    LEFT JOIN us USING (user_id, muscle)) WINDOW w AS (PARTITION BY user_id)""", "executions", "exercises", "sessions", ue=_USER_EXEC, us=_USER_SCORE))
def l06b(t):
    out = load.share_of_top(_user_scores(t), ["user_id"], "muscle", b.MUSCLES)
    return out.withColumn("relative_pct", fix(F.col("relative_pct")))


@query("l07_group_ranking", sql("""SELECT user_id, muscle, CASE WHEN score <= 0 THEN 'missing' WHEN score >= max(score) OVER (PARTITION BY user_id) * 0.5 THEN 'primary' ELSE 'secondary' END AS rank
    FROM us""", "executions", "exercises", "sessions", ue=_USER_EXEC, us=_USER_SCORE))
def l07(t):
    return load.rank_groups(_user_scores(t), ["user_id"]).drop("score")


@query("l08_muscle_seconds", sql(f"""SELECT session_id, muscle_group, {fx('seconds')} AS seconds, {fx('seconds / top * 100')} AS pct,
      CASE WHEN seconds / top >= 0.6 THEN 'high' WHEN seconds / top >= 0.3 THEN 'medium' ELSE 'low' END AS level
    FROM (SELECT *, max(seconds) OVER (PARTITION BY session_id) AS top FROM (
      SELECT session_id, g AS muscle_group, max(seconds) AS seconds FROM (SELECT session_id, muscle, sum(score) AS seconds FROM ({_work_sql('session_id', 'duration_sec', 1, 0.5)}) GROUP BY ALL)
      JOIN (VALUES ('ECONOMY', 'a'), ('LARGE', 'a'), ('MEDIUM', 'b'), ('PROMO', 'b'), ('SMALL', 'c'), ('STANDARD', 'c')) z(muscle, g) USING (muscle) GROUP BY ALL)) WHERE seconds > 0""",
    "executions", "exercises"))
def l08(t):
    groups = t.spark.createDataFrame(list(zip(b.MUSCLES, "aabbcc")), "muscle string, muscle_group string")
    out = load.muscle_seconds(b.executions(t), b.exercises(t), groups, ["session_id"])
    return out.withColumns({"seconds": fix(F.col("seconds")), "pct": fix(F.col("pct"))})


@query("l09_weighted_muscles", sql(f"""SELECT recording_id, muscle, {fx('sum(seconds * w)', 4)} AS weighted_sec, string_agg(label, ',' ORDER BY label) AS actions,
      CASE WHEN sum(seconds * w) >= 60 THEN '高' WHEN sum(seconds * w) >= 30 THEN '中' ELSE '低' END AS level
    FROM (SELECT recording_id, label, sum(value) AS seconds FROM samples GROUP BY ALL)
    JOIN (VALUES ('view', 'chest', 1.0::DOUBLE), ('view', 'back', 0.5::DOUBLE), ('click', 'back', 0.25::DOUBLE), ('error', 'legs', 0.125::DOUBLE)) m(label, muscle, w) USING (label)
    GROUP BY ALL""", "samples"))
def l09(t):
    w = t.spark.createDataFrame(
        [("view", "chest", 1.0), ("view", "back", 0.5), ("click", "back", 0.25), ("error", "legs", 0.125)], "action string, muscle string, weight double")
    acts = b.samples(t).groupBy("recording_id", F.col("label").alias("action")).agg(F.sum("value").alias("seconds"))
    out = load.weighted_muscles(acts, w, ["recording_id"])
    return out.withColumns({"weighted_sec": fix(F.col("weighted_sec"), 4), "actions": F.array_join("actions", ",")})


def _balance_sql() -> str:
    exps, aggs, dev = [], [], []
    for i, (m, share) in enumerate(b.SHARE_TARGETS.items()):
        one, two = f"(primary_muscle = '{m}')", f"(secondary_muscle = '{m}')"
        exps.append(f"sum(CASE WHEN {one} THEN unit * conf ELSE 0 END + CASE WHEN {two} THEN unit * conf * 0.5 ELSE 0 END) AS e{i}, max(CASE WHEN {one} OR {two} THEN 1 ELSE 0 END) AS c{i}")
        aggs.append(f"sum(e{i}) AS e{i}, max(c{i}) AS c{i}")
        dev.append(f"abs(e{i} / ex - {share}::DOUBLE)")
    n = len(b.SHARE_TARGETS)
    e = " + ".join(f"e{i}" for i in range(n))
    c = " + ".join(f"c{i}" for i in range(n))
    body = f"""SELECT user_id, ref_day, strength_days, covered, {fx('g', 8)} AS score_g, {fx('s', 8)} AS score_s, {fx('e', 8)} AS score_e, {fx('c', 8)} AS score_c,
      {fx('least(score, 100)', 8)} AS score, CASE WHEN score > 0 THEN 'active' ELSE 'insufficient_data' END AS status
    FROM (SELECT *, CASE WHEN strength_days = 0 THEN 0 ELSE g * 0.15::DOUBLE + s * 0.4::DOUBLE + e * 0.2::DOUBLE + c * 0.25::DOUBLE END AS score FROM (
      SELECT user_id, ref_day, strength_days, covered, least(strength_days / 2, 1.0::DOUBLE, covered / {n}) * 100 AS g,
        CASE WHEN ex > 0 THEN greatest(1.0::DOUBLE - ({' + '.join(dev)}) * 0.5::DOUBLE, 0) * 100 ELSE 0 END AS s,
        CASE WHEN coalesce(units, 0) = 0 THEN 0 ELSE proof * 100 / units END AS e,
        CASE WHEN strength_days = 0 THEN 0 ELSE (least(strength_days / 4, 1.0::DOUBLE) * 0.6::DOUBLE + least(coalesce(units, 0) / 8, 1.0::DOUBLE) * 0.4::DOUBLE) * 100 END AS c
      FROM (SELECT *, {e} AS ex, coalesce({c}, 0) AS covered FROM (
        SELECT user_id, ref_day, count(day) AS strength_days, sum(units) AS units, sum(proof) AS proof, {', '.join(aggs)}
        FROM (SELECT DISTINCT user_id, day AS ref_day FROM sessions) r LEFT JOIN days d USING (user_id) WHERE d.day IS NULL OR d.day BETWEEN ref_day - 6 AND ref_day GROUP BY ALL
        UNION ALL SELECT user_id, ref_day, 0, NULL, NULL, {', '.join('NULL, NULL' for _ in range(n))} FROM (SELECT DISTINCT user_id, day AS ref_day FROM sessions) r
          WHERE EXISTS (SELECT 1 FROM days d WHERE d.user_id = r.user_id) AND NOT EXISTS (SELECT 1 FROM days d WHERE d.user_id = r.user_id AND d.day BETWEEN ref_day - 6 AND ref_day)))))"""
    days = f"""SELECT user_id, day, sum(unit) AS units, sum((conf * 0.35::DOUBLE + 0.25::DOUBLE * 0.7::DOUBLE + least(unit / 2, 1.0::DOUBLE) * 0.25::DOUBLE) * unit) AS proof, {', '.join(exps)}
      FROM (SELECT user_id, day, exercise_id, CAST(least(sum(sets), 4) AS DOUBLE) AS unit, max(confidence) AS conf FROM ue GROUP BY ALL HAVING sum(sets) > 0)
      LEFT JOIN exercises USING (exercise_id) GROUP BY user_id, day"""
    return sql(body, "executions", "exercises", "sessions", ue=_USER_EXEC, days=days)


@query("l10_balance_score", _balance_sql())
def l10(t):
    out = load.balance(b.sessions(t), b.executions(t), b.exercises(t), b.SHARE_TARGETS)
    return out.withColumns({c: fix(F.col(c), 8) for c in ("score_g", "score_s", "score_e", "score_c", "score")})


_DAYS = """SELECT user_id, day, count(*) AS sessions, CAST(sum(coalesce(x, 0)) AS BIGINT) AS sets, sum(calories) AS kcal, CAST(sum(minutes) AS BIGINT) AS minutes
    FROM sessions LEFT JOIN (SELECT session_id, sum(sets) AS x FROM executions GROUP BY ALL) USING (session_id) GROUP BY ALL"""
_WEEK = "(day - CAST(dayofweek(day) AS INT))"
_WEEKS = f"""SELECT user_id, {_WEEK} AS week_start, CAST(sum(sets) AS BIGINT) AS sets, sum(kcal) AS kcal, CAST(sum(minutes) AS BIGINT) AS minutes,
    count(*) FILTER (minutes > 0) AS training_days FROM days GROUP BY ALL"""


@query("l11_week_totals", sql(f"""SELECT w.user_id, w.week_start, w.sets, {fx('w.kcal', 2)} AS kcal, w.minutes, w.training_days,
      {fx('CASE WHEN coalesce(p.sets, 0) = 0 THEN 0 ELSE (w.sets - p.sets) / p.sets * 100 END', 4)} AS sets_trend_pct,
      {fx('CASE WHEN coalesce(p.kcal, 0) = 0 THEN 0 ELSE (w.kcal - p.kcal) / p.kcal * 100 END', 4)} AS kcal_trend_pct
    FROM weeks w LEFT JOIN weeks p ON p.user_id = w.user_id AND p.week_start = w.week_start - 7""", "sessions", "executions", days=_DAYS, weeks=_WEEKS))
def l11(t):
    out = load.weekly(load.user_days(b.sessions(t), b.executions(t)))
    return out.withColumns({"kcal": fix(F.col("kcal"), 2), "sets_trend_pct": fix(F.col("sets_trend_pct"), 4), "kcal_trend_pct": fix(F.col("kcal_trend_pct"), 4)})


@query("l11_week_grid", sql(f"""SELECT g.user_id, g.week_start, g.day, coalesce(d.sets, 0) AS sets, coalesce(d.minutes, 0) AS minutes FROM (
      SELECT user_id, week_start, week_start + i AS day FROM (SELECT DISTINCT user_id, {_WEEK} AS week_start FROM days), (VALUES (0), (1), (2), (3), (4), (5), (6)) n(i)) g
    LEFT JOIN days d USING (user_id, day)""", "sessions", "executions", days=_DAYS))
def l11b(t):
    return load.week_grid(load.user_days(b.sessions(t), b.executions(t)))


@query("l11_week_coverage", sql(f"""SELECT user_id, week_start, muscle, {fx('score / sum(score) OVER (PARTITION BY user_id, week_start) * 100')} AS pct FROM (
      SELECT user_id, week_start, muscle, sum(score) AS score FROM ({_work_sql('user_id, week_start', 'sets', 2, 1, 'uw')}) GROUP BY ALL) WHERE score > 0""",
    "executions", "exercises", "sessions", ue=_USER_EXEC, uw=f"SELECT *, {_WEEK} AS week_start FROM ue"))
def l11c(t):
    from strideframe.functions.timex import week_start

    weeks = _user_exec(t).withColumn("week_start", week_start(F.col("day")))
    scores = load.muscle_scores(weeks, b.exercises(t), ["user_id", "week_start"])
    return load.share_of_total(scores, ["user_id", "week_start"], out="pct").withColumn("pct", fix(F.col("pct"))).drop("score")


@query("l12_calendar", sql("""SELECT user_id, day, CASE WHEN completion >= 0.95 THEN 'full' ELSE 'partial' END AS status FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY start_time DESC, session_id DESC) AS rn FROM sessions) WHERE rn = 1
    UNION ALL SELECT v.user_id, v.day, 'video' FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) v
      WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.user_id = v.user_id AND s.day = v.day)""", "sessions"))
def l12(t):
    videos = t.events.select("user_id", F.to_date("ts").alias("day"))
    return load.calendar(b.sessions(t), videos)


@query("l13_range_heatmap", sql(f"""SELECT user_id, body_key, score, {fx('score / max(score) OVER (PARTITION BY user_id) * 100')} AS pct FROM (
      SELECT user_id, body_key, sum(score) AS score FROM ({_work_sql('user_id', 'sets', 2, 1, "(SELECT * FROM ue WHERE day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31')")}) GROUP BY ALL) WHERE score > 0""",
    "executions", "exercises", "sessions", ue=_USER_EXEC))
def l13(t):
    s = b.sessions(t).filter(F.col("day").between(F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date")))
    rows = b.executions(t).join(s.select("session_id", "user_id"), "session_id")
    scores = load.muscle_scores(rows, b.exercises(t), ["user_id"], by="body_key")
    from pyspark.sql import Window

    top = F.max("score").over(Window.partitionBy("user_id"))
    return scores.filter("score > 0").withColumn("pct", fix(F.col("score") / top * 100))


@query("l14_day_detail", sql(f"""SELECT user_id, day, d.sessions, d.sets, coalesce(e.exercises, 0) AS exercises, coalesce(e.lines, 0) AS lines, {fx('coalesce(e.seconds, 0)')} AS seconds
    FROM days d LEFT JOIN (SELECT user_id, day, count(DISTINCT exercise_id) AS exercises, count(*) AS lines, sum(duration_sec) AS seconds FROM ue GROUP BY ALL) e USING (user_id, day)""",
    "sessions", "executions", ue=_USER_EXEC, days=_DAYS))
def l14(t):
    e = _user_exec(t).groupBy("user_id", "day").agg(
        F.count_distinct("exercise_id").alias("exercises"), F.count(F.lit(1)).alias("lines"), F.sum("duration_sec").alias("seconds"))
    d = load.user_days(b.sessions(t), b.executions(t)).select("user_id", "day", "sessions", "sets")
    out = d.join(e, ["user_id", "day"], "left").fillna(0, ["exercises", "lines", "seconds"])
    return out.withColumn("seconds", fix(F.col("seconds")))


_SS = f"SELECT session_id, muscle, score, floor(score / sum(score) OVER (PARTITION BY session_id) * 100 + 0.5::DOUBLE) AS share FROM (SELECT session_id, muscle, sum(score) AS score FROM ({_work_sql('session_id', 'sets', 2, 1)}) GROUP BY ALL) WHERE score > 0"
_PREV = """SELECT user_id, day, last_session, lag(last_session) OVER (PARTITION BY user_id ORDER BY day) AS prev_session FROM (
    SELECT user_id, day, arg_max(session_id, (start_time, session_id)) AS last_session FROM sessions GROUP BY ALL)"""


@query("l15_trend_arrows", sql("""SELECT last_session AS session_id, muscle, CASE WHEN c > p THEN 'up' WHEN c < p THEN 'down' ELSE 'flat' END AS trend FROM (
      SELECT last_session, muscle, coalesce(max(c), 0) AS c, coalesce(max(p), 0) AS p FROM (
        SELECT last_session, muscle, share AS c, NULL AS p FROM prev JOIN ss ON session_id = last_session
        UNION ALL SELECT last_session, muscle, NULL, share FROM prev JOIN ss ON session_id = prev_session) GROUP BY ALL)""",
    "executions", "exercises", "sessions", ss=_SS, prev=_PREV))
def l15(t):
    shares = load.share_of_total(load.muscle_scores(b.executions(t), b.exercises(t), ["session_id"]), ["session_id"]).select(
        "session_id", "muscle", F.floor(F.col("share_pct") + 0.5).alias("share"))
    prev = load.previous_training_day(b.sessions(t))
    cur = prev.select(F.col("last_session").alias("session_id")).join(shares, "session_id")
    old = prev.select("last_session", F.col("prev_session").alias("session_id")).join(shares, "session_id").select(
        F.col("last_session").alias("session_id"), "muscle", "share")
    return load.trends(cur, old, ["session_id"], "muscle", "share")


@query("l16_category_seconds", sql("""SELECT session_id, coalesce(category, '力量') AS category, CAST(sum(floor(duration_sec + 0.5::DOUBLE)) AS BIGINT) AS seconds FROM executions
    LEFT JOIN (SELECT exercise_id, CASE WHEN name LIKE '%ring%' THEN '有氧' WHEN name LIKE '%bolt%' THEN '核心' ELSE '热身/拉伸' END AS category FROM exercises
      WHERE name LIKE '%ring%' OR name LIKE '%bolt%' OR name LIKE '%gear%') USING (exercise_id) GROUP BY ALL""", "executions", "exercises"))
def l16(t):
    n = F.col("name")
    cats = b.exercises(t).filter(n.contains("ring") | n.contains("bolt") | n.contains("gear")).select(
        "exercise_id", F.when(n.contains("ring"), "有氧").when(n.contains("bolt"), "核心").otherwise("热身/拉伸").alias("category"))
    return load.category_seconds(b.executions(t), cats, ["session_id"])


@query("l17_rolling_insights", sql(f"""SELECT user_id, day, CAST(sum(sessions) OVER w AS BIGINT) AS sessions_30d, {fx('avg(sets) OVER w')} AS mean_score, {fx('sum(sessions) OVER w / 4.3::DOUBLE')} AS per_week,
      CAST(sum(minutes) OVER w AS BIGINT) AS minutes_30d, {fx('minutes / greatest(1, max(minutes) OVER w)')} AS relative_load
    FROM days WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)""", "sessions", "executions", days=_DAYS))
def l17(t):
    out = load.rolling_insights(load.user_days(b.sessions(t), b.executions(t)), "sets")
    return out.withColumns({c: fix(F.col(c)) for c in ("mean_score", "per_week", "relative_load")})


@query("l18_zone_levels", sql(f"""SELECT user_id, back, zone, CASE max(CASE WHEN pct >= 65 THEN 3 WHEN pct >= 30 THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'med' ELSE 'low' END AS level FROM (
      SELECT user_id, starts_with(body_key, 'b-') AS back, regexp_replace(body_key, '^b-', '') AS muscle, score / max(score) OVER (PARTITION BY user_id) * 100 AS pct
      FROM (SELECT user_id, body_key, sum(score) AS score FROM ({_work_sql('user_id', 'sets', 2, 1, 'ue')}) GROUP BY ALL)) WHERE_POS
    JOIN (VALUES ('ECONOMY', 'upper'), ('LARGE', 'upper'), ('MEDIUM', 'core'), ('PROMO', 'core'), ('SMALL', 'legs'), ('STANDARD', 'legs')) z(muscle, zone) USING (muscle)
    WHERE pct > 0 GROUP BY ALL""".replace("WHERE_POS", "h"), "executions", "exercises", "sessions", ue=_USER_EXEC))
def l18(t):
    from pyspark.sql import Window

    scores = load.muscle_scores(_user_exec(t), b.exercises(t), ["user_id"], by="body_key")
    heat = scores.withColumn("relative_pct", F.col("score") / F.max("score").over(Window.partitionBy("user_id")) * 100)
    zones = t.spark.createDataFrame(list(zip(b.MUSCLES, ["upper", "upper", "core", "core", "legs", "legs"])), "muscle string, zone string")
    return load.zone_levels(heat, zones, ["user_id"])


@query("l18_session_type", sql("""SELECT user_id, CASE WHEN bool_or(muscle IN ('SMALL', 'STANDARD')) THEN 'Lower Body' WHEN bool_or(muscle = 'MEDIUM') THEN 'Back + Arms'
      WHEN bool_or(muscle = 'LARGE') THEN 'Chest + Shoulders' ELSE 'Strength Training' END AS workout_type,
      CASE WHEN max(score) >= 75 THEN 'Moderate–High' WHEN max(score) >= 50 THEN 'Moderate' ELSE 'Light' END AS intensity
    FROM (SELECT *, max(score) OVER (PARTITION BY user_id) AS top FROM us) WHERE score > 0 AND score >= top * 0.5 GROUP BY ALL""",
    "executions", "exercises", "sessions", ue=_USER_EXEC, us=_USER_SCORE))
def l18b(t):
    top = load.rank_groups(_user_scores(t), ["user_id"]).filter("rank = 'primary'")
    m = F.col("muscle")
    return top.groupBy("user_id").agg(
        F.when(F.bool_or(m.isin("SMALL", "STANDARD")), "Lower Body").when(F.bool_or(m == "MEDIUM"), "Back + Arms")
        .when(F.bool_or(m == "LARGE"), "Chest + Shoulders").otherwise("Strength Training").alias("workout_type"),
        ladder(F.max("score"), SCORE).alias("intensity"))


def _hr(t):
    return b.samples(t).select("recording_id", "row_id", "t_rel", (F.col("value") % 120 + 60).alias("hr"), F.lit(185.0).alias("max_hr"))


_HR = "SELECT recording_id, row_id, t_rel, value % 120 + 60 AS hr FROM samples"


@query("l19_hr_zones", sql(f"""SELECT recording_id, CASE WHEN p < 60 THEN 'low' WHEN p < 75 THEN 'moderate' WHEN p < 90 THEN 'high' ELSE 'maximal' END AS zone,
      {fx('sum(held)', 3)} AS seconds, max(hr) AS peak, {fx('CASE WHEN sum(held) = 0 THEN 0 ELSE sum(hr * held) / sum(held) END', 4)} AS mean_hr
    FROM (SELECT *, hr / 185.0::DOUBLE * 100 AS p, lead(t_rel) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) - t_rel AS held FROM hr) WHERE held IS NOT NULL GROUP BY ALL""", "samples", hr=_HR))
def l19a(t):
    out = heart.zone_times(_hr(t), ["recording_id"], "t_rel", "hr", "max_hr", "row_id")
    return out.withColumns({"seconds": fix(F.col("seconds"), 3), "mean_hr": fix(F.col("mean_hr"), 4)})


@query("l19_low_activity", sql("""SELECT recording_id, min(t_rel) AS start_sec, max(t_rel) AS end_sec FROM (
      SELECT *, sum(c) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS run FROM (
        SELECT *, CASE WHEN lag(low) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) = low THEN 0 ELSE 1 END AS c FROM (SELECT *, hr < 100 AS low FROM hr)))
    WHERE low GROUP BY recording_id, run HAVING max(t_rel) - min(t_rel) > 300""", "samples", hr=_HR))
def l19b(t):
    return heart.low_activity_spans(_hr(t), ["recording_id"], "t_rel", "hr", "row_id", 100.0, 300.0)


@query("l19_recovery", sql(f"""SELECT recording_id, end_at, max(hr) FILTER (name = 'e') - max(hr) FILTER (name = 'a') AS drop_hr_1, max(hr) FILTER (name = 'e') - max(hr) FILTER (name = 'b') AS drop_hr_2,
      CASE WHEN max(hr) FILTER (name = 'e') - max(hr) FILTER (name = 'a') > 30 THEN 'excellent' WHEN max(hr) FILTER (name = 'e') - max(hr) FILTER (name = 'a') >= 15 THEN 'normal'
        WHEN max(hr) FILTER (name = 'e') - max(hr) FILTER (name = 'a') IS NOT NULL THEN 'poor' END AS recovery
    FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, end_at, name ORDER BY abs(t_rel - goal), t_rel, row_id) AS rn FROM (
      SELECT r.recording_id, r.end_sec AS end_at, n.name, r.end_sec + n.delay AS goal, h.t_rel, h.hr, h.row_id FROM label_runs r, (VALUES ('e', 0.0::DOUBLE), ('a', {HOUR}::DOUBLE), ('b', {2 * HOUR}::DOUBLE)) n(name, delay), hr h
      WHERE h.recording_id = r.recording_id AND r.label = 'purchase' AND h.t_rel >= (r.end_sec + n.delay) - {12 * HOUR}::DOUBLE AND h.t_rel <= (r.end_sec + n.delay) + {12 * HOUR}::DOUBLE)) WHERE rn = 1 GROUP BY ALL""",
    "label_runs", hr=_HR))
def l19c(t):
    ends = b.label_runs(t).filter("label = 'purchase'").select("recording_id", "end_sec").distinct()
    return heart.recovery(ends, _hr(t), ["recording_id"], "end_sec", "t_rel", "hr", "row_id", {"hr_1": HOUR, "hr_2": 2 * HOUR}, 12 * HOUR)


@query("l19_rest_gaps", sql(f"""SELECT recording_id, count(*) AS rests, {fx('avg(rest)', 4)} AS mean_rest, count(*) FILTER (rest > {DAY}) AS long_rests FROM (
      SELECT recording_id, greatest(0.0::DOUBLE, start_sec - lag(end_sec) OVER (PARTITION BY recording_id ORDER BY start_sec, run_id)) AS rest, lag(end_sec) OVER (PARTITION BY recording_id ORDER BY start_sec, run_id) AS p
      FROM label_runs WHERE label IN ('purchase', 'click')) WHERE p IS NOT NULL GROUP BY ALL""", "label_runs"))
def l19d(t):
    sets = b.label_runs(t).filter(F.col("label").isin("purchase", "click"))
    out = heart.rest_gaps(sets, ["recording_id"], "start_sec", "end_sec", "run_id", DAY)
    return out.withColumn("mean_rest", fix(F.col("mean_rest"), 4))


@query("l19_fatigue_point", sql("""SELECT recording_id, min(t_rel) AS fatigue_at FROM (
      SELECT *, max(m) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS best FROM (
        SELECT *, avg(hr) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id ROWS 4 PRECEDING) AS m, row_number() OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS rn FROM hr) WHERE rn >= 5)
    WHERE m < best * (1 - 0.2::DOUBLE) GROUP BY ALL""", "samples", hr=_HR))
def l19e(t):
    return heart.fatigue_point(_hr(t), ["recording_id"], "t_rel", "hr", "row_id", 5, 0.2)


@query("l19_load_trend", sql(f"""SELECT user_id, count(*) AS n, CASE WHEN NOT isnan(regr_slope(minutes, d)) THEN {fx('regr_slope(minutes, d)', 6)} END AS slope FROM (SELECT *, CAST(day - DATE '1970-01-01' AS DOUBLE) AS d FROM sessions) GROUP BY ALL""", "sessions"))
def l19f(t):
    s = b.sessions(t).withColumn("d", F.unix_date("day").cast("double"))
    return heart.load_trend(s, ["user_id"], "d", "minutes").withColumn("slope", fix(F.col("slope"), 6))


@query("l20_user_list", sql("""SELECT user_id, CASE WHEN gender = 'female' THEN '女' ELSE '男' END || ' ' || age || '岁' AS label, session_count, last_workout FROM users
    LEFT JOIN (SELECT user_id, count(*) AS c, max(day) AS last_workout FROM sessions GROUP BY ALL) USING (user_id), LATERAL (SELECT coalesce(c, 0) AS session_count)""", "users", "sessions"))
def l20(t):
    s = b.sessions(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("session_count"), F.max("day").alias("last_workout"))
    label = F.concat_ws(" ", F.when(load.is_female(F.col("gender")), "女").otherwise("男"), F.concat("age", F.lit("岁")))
    return b.users(t).join(s, "user_id", "left").select("user_id", label.alias("label"), F.coalesce("session_count", F.lit(0)).alias("session_count"), "last_workout")


@query("l21_time_breakdown", sql(f"""SELECT recording_id, kind, {fx('seconds', 4)} AS seconds, {fx('CASE WHEN sum(seconds) OVER w = 0 THEN 0 ELSE seconds * 100 / sum(seconds) OVER w END')} AS pct FROM (
      SELECT recording_id, CASE WHEN label IN ('purchase', 'click') THEN 'exercise' WHEN label = 'view' THEN 'rest' ELSE 'transition' END AS kind, sum(end_sec - start_sec) AS seconds FROM label_runs GROUP BY ALL)
    WINDOW w AS (PARTITION BY recording_id)""", "label_runs"))
def l21(t):
    lab = F.col("label")
    runs = b.label_runs(t).withColumn("kind", F.when(lab.isin("purchase", "click"), "exercise").when(lab == "view", "rest").otherwise("transition"))
    out = load.time_breakdown(runs, ["recording_id"], "kind", "start_sec", "end_sec")
    return out.withColumns({"seconds": fix(F.col("seconds"), 4), "pct": fix(F.col("pct"))})


@query("l22_activity_weeks", sql(f"""SELECT user_id, week_start, minutes, {fx('minutes / 7')} AS day_mean, best_day, goal_days, {fx('CASE WHEN follows AND pm > 0 THEN (minutes - pm) / pm * 100 ELSE 0 END')} AS change_pct,
      CAST(row_number() OVER (PARTITION BY user_id, grp ORDER BY week_start) AS INT) AS streak
    FROM (SELECT *, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY week_start) AS grp FROM (
      SELECT *, coalesce(week_start - lag(week_start) OVER w = 7, false) AS follows, lag(minutes) OVER w AS pm FROM (
        SELECT user_id, {_WEEK} AS week_start, CAST(sum(minutes) AS BIGINT) AS minutes, arg_min(day, (-minutes, day)) AS best_day, count(*) FILTER (minutes >= 60) AS goal_days FROM days GROUP BY ALL)
      WINDOW w AS (PARTITION BY user_id ORDER BY week_start)))""", "sessions", "executions", days=_DAYS))
def l22(t):
    out = load.activity_weeks(load.user_days(b.sessions(t), b.executions(t)), 60)
    return out.withColumns({"day_mean": fix(F.col("day_mean")), "change_pct": fix(F.col("change_pct"))})


@query("l22_activity_mix", sql(f"""SELECT user_id, week_start, status, n, {fx('n / sum(n) OVER (PARTITION BY user_id, week_start)')} AS share FROM (
      SELECT user_id, {_WEEK} AS week_start, CASE WHEN completion >= 0.95 THEN 'full' ELSE 'partial' END AS status, count(*) AS n FROM sessions GROUP BY ALL)""", "sessions"))
def l22b(t):
    from strideframe.functions.timex import week_start

    s = b.sessions(t).withColumns({"week_start": week_start(F.col("day")), "status": F.when(F.col("completion") >= 0.95, "full").otherwise("partial")})
    return distribution(s, ["user_id", "week_start"], "status").withColumn("share", fix(F.col("share")))
