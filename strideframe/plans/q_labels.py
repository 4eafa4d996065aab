"""Label sequence, segment and sequence-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions.mathx import fix
from strideframe.operators import intervals, labels, load, segments, sensor
from strideframe.operators.ranges import scan_islands, scan_rows
from strideframe.operators.sequence import index_rows
from strideframe.plans import bindings as b
from strideframe.plans.bindings import DAY, HOUR, fx, sql
from strideframe.plans.registry import query

K = ["recording_id"]
O = ["t_rel", "row_id"]


def _rows(t, *extra):
    return b.samples(t).select("recording_id", "row_id", "t_rel", "label", *extra)


@query("e01_lag_difference", sql("SELECT row_id, value - lag(value) OVER w AS diff, coalesce(abs(value - lag(value) OVER w), 0) AS jerk FROM samples WINDOW w AS (PARTITION BY recording_id ORDER BY t_rel, row_id)", "samples"))
def e01(t):
    rows = scan_rows(b.samples(t).select("recording_id", "row_id", "t_rel", "value"), K, O, lag=["value"])
    d = F.col("value") - F.col("lag_value")
    return rows.select("row_id", d.alias("diff"), F.coalesce(F.abs(d), F.lit(0.0)).alias("jerk"))


@query("e02_moving_average", sql(f"SELECT row_id, {fx('sum(value) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6')} AS smooth FROM samples", "samples"))
def e02(t):
    out = sensor.moving_average(b.samples(t).select("recording_id", "row_id", "t_rel", "value"), K, O, ["value"], 6)
    return out.select("row_id", fix(F.col("g_value")).alias("smooth"))


@query("e03_step_change", sql(f"SELECT row_id, {fx('avg(value) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) - avg(value) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS delta FROM samples", "samples"))
def e03(t):
    out = sensor.step_change(b.samples(t).select("recording_id", "row_id", "t_rel", "value"), K, O, "value")
    return out.select("row_id", fix(F.col("delta")).alias("delta"))


@query("e04_label_runs", sql("SELECT recording_id, run_id, label, start_sec, end_sec, n, reps, first_row FROM label_runs", "label_runs"))
def e04(t):
    return b.label_runs(t, scan_rows)


@query("e05_gap_islands", sql(f"""SELECT recording_id, label, CAST(island AS BIGINT) AS island, min(t_rel) AS start_sec, max(e) AS end_sec, count(*) AS n FROM (
      SELECT *, sum(CASE WHEN reach IS NULL OR t_rel - reach > {DAY / 2} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, run_id ORDER BY t_rel, row_id) AS island FROM (
        SELECT *, max(e) OVER (PARTITION BY recording_id, run_id ORDER BY t_rel, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT *, t_rel + k * 600 AS e FROM run_rows)))
    GROUP BY recording_id, label, run_id, island""", "run_rows"))
def e05(t):
    rows = _rows(t, (F.col("t_rel") + F.col("k") * 600).alias("e"))
    out = scan_islands(rows, K, "t_rel", "e", DAY / 2, tie=["row_id"], label="label", out="island")
    return out.groupBy("recording_id", "label", "run_id", "island").agg(F.min("t_rel").alias("start_sec"), F.max("e").alias("end_sec"), F.count(F.lit(1)).alias("n")).drop("run_id")


@query("e06_direction_reversals", sql("SELECT recording_id, count(*) AS n, count(*) FILTER (p IS NOT NULL AND p <> label) AS reversals, count(*) FILTER (p IS NOT NULL AND p <> label) > count(*) * 0.3 AS reciprocating FROM (SELECT *, lag(label) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS p FROM samples) GROUP BY ALL", "samples"))
def e06(t):
    out = sensor.flow_overview(_rows(t, "value", "acc"), K, O, "value", "label", "acc")
    return out.select("recording_id", "n", "reversals", "reciprocating")


_PEAK5 = """SELECT recording_id, k, count(*) FILTER (value > m + 5 AND value >= p1 AND value >= n1 AND value > p2 AND value > n2) AS peaks FROM (
      SELECT *, avg(value) OVER (PARTITION BY recording_id, k) AS m, lag(value, 1) OVER w AS p1, lag(value, 2) OVER w AS p2, lead(value, 1) OVER w AS n1, lead(value, 2) OVER w AS n2
      FROM (SELECT recording_id, row_id, t_rel, value, CAST(floor(t_rel / 864000.0::DOUBLE) AS BIGINT) AS k FROM samples) WINDOW w AS (PARTITION BY recording_id, k ORDER BY t_rel, row_id)) GROUP BY ALL"""


@query("e07_five_point_peaks", sql(_PEAK5, "samples"))
def e07(t):
    rows = b.samples(t).select("recording_id", "row_id", "t_rel", "value", F.floor(F.col("t_rel") / (10 * DAY)).alias("k"))
    return sensor.mark_peaks(rows, ["recording_id", "k"], O, "value", 5.0).groupBy("recording_id", "k").agg(F.sum("peak").alias("peaks"))


@query("e07_peaks_whole_recording", sql(_PEAK5.replace("recording_id, k,", "recording_id,").replace("CAST(floor(t_rel / 864000.0::DOUBLE) AS BIGINT)", "0").replace("PARTITION BY recording_id, k", "PARTITION BY recording_id"), "samples"))
def e07b(t):
    rows = b.samples(t).select("recording_id", "row_id", "t_rel", "value")
    return sensor.mark_peaks(rows, K, O, "value", 5.0).groupBy("recording_id").agg(F.sum("peak").alias("peaks"))


@query("e08_three_point_peaks", sql(f"""SELECT recording_id, k, count(*) FILTER (acc - m > sd * 0.3::DOUBLE AND acc > l AND acc > r) AS peak_count FROM (
      SELECT *, avg(acc) OVER (PARTITION BY recording_id, k) AS m, stddev_pop(acc) OVER (PARTITION BY recording_id, k) AS sd, lag(acc) OVER w AS l, lead(acc) OVER w AS r, count(*) OVER (PARTITION BY recording_id, k) AS n
      FROM (SELECT s.* EXCLUDE (k), CAST(floor(t_rel / {10 * DAY}::DOUBLE) AS BIGINT) AS k FROM samples s JOIN (SELECT recording_id, max(t_rel) AS total FROM samples GROUP BY ALL) USING (recording_id)
        WHERE floor(t_rel / {10 * DAY}::DOUBLE) * {10 * DAY}::DOUBLE + {10 * DAY}::DOUBLE <= total + 0.01) WINDOW w AS (PARTITION BY recording_id, k ORDER BY t_rel, row_id)) WHERE n >= 5 GROUP BY ALL""", "samples"))
def e08(t):
    s = b.samples(t)
    totals = s.groupBy("recording_id").agg(F.max("t_rel").alias("total_sec")).withColumn("fs", F.lit(10.0))
    return sensor.window_features(s, K, "t_rel", "row_id", totals, 10 * DAY, 10 * DAY).select("recording_id", "k", "peak_count")


@query("e09_neighbour_runs", sql("SELECT recording_id, run_id, lag(label) OVER w AS prev_label, lead(label) OVER w AS next_label, lag(n) OVER w AS prev_n FROM label_runs WINDOW w AS (PARTITION BY recording_id ORDER BY run_id)", "label_runs"))
def e09(t):
    rows = index_rows(b.label_runs(t).select("recording_id", "run_id", "label", "n"), K, ["run_id"], lag=["label", "n"], lead=["label"], width=50_000)
    return rows.select("recording_id", "run_id", F.col("lag_label").alias("prev_label"), F.col("lead_label").alias("next_label"), F.col("lag_n").alias("prev_n"))


@query("e10_previous_session", sql("SELECT user_id, day, last_session, lag(last_session) OVER (PARTITION BY user_id ORDER BY day) AS prev_session FROM (SELECT user_id, day, arg_max(session_id, (start_time, session_id)) AS last_session FROM sessions GROUP BY ALL)", "sessions"))
def e10(t):
    return load.previous_training_day(b.sessions(t))


@query("e11_row_numbers", sql("SELECT row_id, row_number() OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS pos FROM samples", "samples"))
def e11(t):
    return scan_rows(b.samples(t).select("recording_id", "row_id", "t_rel"), K, O).select("row_id", "pos")


def _mode_sql(k: int) -> str:
    n = 2 * k + 1
    return f"""SELECT row_id, CASE WHEN pos <= {k} OR pos > n - {k} THEN label ELSE
      list_sort(list_transform(list_distinct(near), lambda x: {{'c': -len(list_filter(near, lambda y: y = x)), 'p': list_position(near, x), 'v': x}}))[1].v END AS smooth
    FROM (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY recording_id) AS n, list(label) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS near
      FROM samples WINDOW w AS (PARTITION BY recording_id ORDER BY t_rel, row_id))"""


@query("j05_mode_smoothing", sql(_mode_sql(3), "samples"))
def j05(t):
    return labels.smooth_mode(_rows(t), K, O, "label", 3).select("row_id", "smooth")


@query("j06_short_run_fill", sql("""SELECT r.row_id, CASE WHEN q.n >= 2 THEN q.label WHEN pl IS NOT NULL AND nl IS NOT NULL THEN CASE WHEN pl = nl OR pn >= nn THEN pl ELSE nl END ELSE coalesce(pl, nl, q.label) END AS filled
    FROM run_rows r JOIN (SELECT *, lag(label) OVER w AS pl, lead(label) OVER w AS nl, lag(n) OVER w AS pn, lead(n) OVER w AS nn FROM label_runs WINDOW w AS (PARTITION BY recording_id ORDER BY run_id)) q USING (recording_id, run_id)""", "run_rows", "label_runs"))
def j06(t):
    return labels.fill_short_runs(_rows(t), K, O, "label", 2).select("row_id", "filled")


@query("j07_window_segments", sql(f"""SELECT recording_id, run_id, label, min(t_rel) AS start_sec, max(t_rel) AS end_sec, count(*) AS windows, {fx('avg(value)')} AS mean_value, {fx('stddev_pop(value)')} AS std_value, {fx('quantile_cont(value, 0.5)')} AS median_value
    FROM (SELECT *, CAST(run_id AS BIGINT) AS rid FROM run_rows) GROUP BY recording_id, run_id, label""".replace("recording_id, run_id, label, min", "recording_id, CAST(run_id AS BIGINT) AS run_id, label, min"), "run_rows"))
def j07(t):
    out = labels.window_segments(_rows(t, "value"), K, O, "label", "t_rel", "t_rel", ["value"], ["value"])
    return out.select("recording_id", "run_id", "label", "start_sec", "end_sec", "windows", fix(F.col("mean_value")).alias("mean_value"), fix(F.col("std_value")).alias("std_value"), fix(F.col("median_value")).alias("median_value"))


@query("j08_chained_segments", sql(f"SELECT recording_id, run_id, label, start_sec, end_sec, {fx('end_sec - start_sec')} AS duration_sec FROM label_runs WHERE end_sec - start_sec >= {HOUR}", "label_runs"))
def j08(t):
    out = labels.chained_segments(_rows(t), K, O, "label", "t_rel", "t_rel", HOUR)
    return out.withColumn("duration_sec", fix(F.col("duration_sec")))


@query("j08_segments_to_window_end", sql(f"""SELECT recording_id, run_id, label, start_sec, e AS end_sec FROM (SELECT *, coalesce(lead(start_sec) OVER (PARTITION BY recording_id ORDER BY run_id), last_sec + {HOUR}::DOUBLE) AS e FROM runs0) WHERE e - start_sec >= 1""", "runs0"))
def j08b(t):
    rows = _rows(t).withColumn("t_end", F.col("t_rel") + F.lit(HOUR))
    return labels.chained_segments(rows, K, O, "label", "t_rel", "t_end", 1.0).drop("duration_sec")


@query("j09_duration_shares", sql(f"""SELECT recording_id, label, {fx('sum(end_sec - start_sec)', 4)} AS seconds, count(*) AS segments, {fx('CASE WHEN total = 0 THEN 0 ELSE sum(end_sec - start_sec) * 100 / total END', 5)} AS pct
    FROM label_runs JOIN (SELECT recording_id, max(t_rel) AS total FROM samples GROUP BY ALL) USING (recording_id) WHERE end_sec - start_sec >= 1 GROUP BY recording_id, label, total""", "label_runs"))
def j09(t):
    segs = labels.chained_segments(_rows(t), K, O, "label", "t_rel", "t_rel")
    totals = b.samples(t).groupBy("recording_id").agg(F.max("t_rel").alias("total_sec"))
    out = labels.duration_shares(segs, K, "label", "duration_sec", totals)
    return out.withColumns({"seconds": fix(F.col("seconds"), 4), "pct": fix(F.col("pct"), 5)})


_RUNQ = """SELECT q.*, min(x.pos) AS from_pos, max(x.pos) AS to_pos, arg_min(x.k / 100, x.pos) AS first_conf, arg_max(x.k / 100, x.pos) AS last_conf FROM label_runs q JOIN pos_rows x USING (recording_id, run_id) GROUP BY ALL"""
_POS = "SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS pos FROM run_rows"


@query("j10_gap_bridging", sql(f"""SELECT row_id, CASE WHEN hit THEN pl ELSE x.label END AS label, {fx('CASE WHEN hit THEN least(pc, nc) * 0.8::DOUBLE ELSE x.k / 100 END')} AS confidence, coalesce(hit, false) AS bridged
    FROM pos_rows x JOIN (SELECT *, label = 'error' AND n <= 2 AND pl = nl AS hit FROM (SELECT *, lag(label) OVER w AS pl, lead(label) OVER w AS nl, lag(last_conf) OVER w AS pc, lead(first_conf) OVER w AS nc FROM rq WINDOW w AS (PARTITION BY recording_id ORDER BY run_id))) r USING (recording_id, run_id)""",
    "run_rows", "label_runs", pos_rows=_POS, rq=_RUNQ))
def j10(t):
    rows = _rows(t, (F.col("k") / 100).alias("confidence"))
    out = labels.bridge_gaps(rows, K, O, "label", "confidence", "error", 2)
    return out.select("row_id", "label", fix(F.col("confidence")).alias("confidence"), "bridged")


@query("j11_isolated_runs", sql(f"""SELECT row_id, CASE WHEN alone THEN 'error' ELSE x.label END AS label, {fx('CASE WHEN alone THEN least(x.k / 100, 0.4::DOUBLE) ELSE x.k / 100 END')} AS confidence, alone AS dropped
    FROM pos_rows x JOIN (SELECT r.recording_id, r.run_id, r.label <> 'error' AND r.n < 2 AND NOT EXISTS (SELECT 1 FROM pos_rows y WHERE y.recording_id = r.recording_id AND y.label = r.label AND ((y.pos >= r.from_pos - 3 AND y.pos < r.from_pos) OR (y.pos > r.to_pos AND y.pos <= r.to_pos + 3))) AS alone FROM rq r) z USING (recording_id, run_id)""",
    "run_rows", "label_runs", pos_rows=_POS, rq=_RUNQ))
def j11(t):
    rows = _rows(t, (F.col("k") / 100).alias("confidence"))
    out = labels.drop_isolated(rows, K, O, "label", "confidence", "error", 2, 3)
    return out.select("row_id", "label", fix(F.col("confidence")).alias("confidence"), "dropped")


_GROUPS = [("view", "a", 1.5, True), ("click", "a", 1.0, False), ("purchase", "b", 1.0, False), ("signup", "b", 1.0, False)]


@query("j12_group_consolidation", sql(f"""SELECT x.row_id, CASE WHEN w.win IS NOT NULL THEN w.win ELSE x.label END AS label, coalesce(w.win <> x.label, false) AS merged, {fx('CASE WHEN coalesce(w.win <> x.label, false) THEN x.k / 100 * 0.8::DOUBLE ELSE x.k / 100 END')} AS confidence FROM gr x LEFT JOIN (
      SELECT recording_id, run, win FROM (SELECT recording_id, run, label AS win, sum(n) OVER (PARTITION BY recording_id, run) AS total, count(*) OVER (PARTITION BY recording_id, run) AS kinds,
        row_number() OVER (PARTITION BY recording_id, run ORDER BY n * wt DESC, pref DESC, n DESC, seen) AS rn
        FROM (SELECT recording_id, run, label, count(*) AS n, min(pos) AS seen, any_value(wt) AS wt, any_value(pref) AS pref FROM gr WHERE grp IS NOT NULL GROUP BY ALL)) WHERE rn = 1 AND total >= 4 AND kinds >= 2) w USING (recording_id, run)""",
    "samples", g0="""SELECT s.*, m.grp, m.wt, m.pref, row_number() OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS pos FROM samples s LEFT JOIN
      (VALUES ('view', 'a', 1.5::DOUBLE, true), ('click', 'a', 1.0::DOUBLE, false), ('purchase', 'b', 1.0::DOUBLE, false), ('signup', 'b', 1.0::DOUBLE, false)) m(label, grp, wt, pref) USING (label)""",
    gr="SELECT *, sum(c) OVER (PARTITION BY recording_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN pos > 1 AND grp IS NOT DISTINCT FROM lag(grp) OVER (PARTITION BY recording_id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM g0)"))
def j12(t):
    rows = _rows(t, (F.col("k") / 100).alias("confidence"))
    groups = t.spark.createDataFrame(_GROUPS, "label string, grp string, weight double, preferred boolean")
    out = labels.consolidate(rows, K, O, "label", "confidence", groups, 4)
    return out.select("row_id", "label", "merged", fix(F.col("confidence")).alias("confidence"))


def _chunked(t):
    """Each run reported by two overlapping chunks, the second a little off."""
    r = b.label_runs(t).filter("end_sec > start_sec")
    copies = F.explode(F.array(*[F.struct(F.lit(i).alias("chunk"), F.lit(s).alias("shift")) for i, s in enumerate((0.0, 1800.0))]))
    return r.withColumn("_c", copies).select(
        "recording_id", F.col("_c.chunk").alias("chunk"), F.col("run_id").alias("seg"), (F.col("start_sec") + F.col("_c.shift")).alias("start_sec"), (F.col("end_sec") + F.col("_c.shift")).alias("end_sec"),
        F.when(F.col("label").isin("purchase", "click"), "EXERCISE").otherwise("REST").alias("state"), F.col("label").alias("equipment"), ((F.col("run_id") * 37 + F.col("_c.chunk") * 11) % 100 / 100).alias("confidence"))


_CHUNKED = """SELECT recording_id, c.chunk, run_id AS seg, start_sec + c.shift AS start_sec, end_sec + c.shift AS end_sec, CASE WHEN label IN ('purchase', 'click') THEN 'EXERCISE' ELSE 'REST' END AS state, label AS equipment,
      CAST((run_id * 37 + c.chunk * 11) % 100 AS DOUBLE) / 100 AS confidence FROM label_runs, (VALUES (0, 0.0::DOUBLE), (1, 1800.0::DOUBLE)) c(chunk, shift) WHERE end_sec > start_sec"""
_ARRIVAL = "SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY chunk, seg) AS i FROM chunked"
_ROW = "{'chunk': o.chunk, 'seg': o.seg, 'start_sec': o.start_sec, 'end_sec': o.end_sec, 'state': o.state, 'equipment': o.equipment, 'confidence': o.confidence}"
_CLASH = "(least(y.end_sec, o.end_sec) - greatest(y.start_sec, o.start_sec)) / greatest(o.end_sec - o.start_sec, 1) > 0.5"


def _kept(step: str, body: str, **more: str) -> str:
    """One segment a step, in the order of arrival, into the list of kept ones."""
    k = f"SELECT recording_id, i, [{_ROW}] AS kept FROM o WHERE i = 1 UNION ALL SELECT o.recording_id, o.i, {step} FROM k JOIN o ON o.recording_id = k.recording_id AND o.i = k.i + 1"
    rows = "SELECT recording_id, r.* FROM (SELECT recording_id, unnest(arg_max(kept, i)) AS r FROM k GROUP BY recording_id)"
    return sql(body, "label_runs", chunked=_CHUNKED, o=_ARRIVAL, k=k, kept_rows=rows, **more).replace("WITH ", "WITH RECURSIVE ", 1)


_FIRST_WINS = f"CASE WHEN len(list_filter(k.kept, lambda y: {_CLASH})) > 0 THEN k.kept ELSE list_append(k.kept, {_ROW}) END"
_CONFIDENT_WINS = f"""CASE WHEN len(list_filter(k.kept, lambda y: {_CLASH})) = 0 THEN list_append(k.kept, {_ROW})
      ELSE list_transform(k.kept, lambda y, j: CASE WHEN j = list_position(list_transform(k.kept, lambda y: {_CLASH}), true) AND o.confidence > y.confidence THEN {_ROW} ELSE y END) END"""


@query("j13_chunk_merge", _kept(_FIRST_WINS, """SELECT * REPLACE (CASE WHEN abs(start_sec - lag(end_sec) OVER w) <= 5 THEN lag(end_sec) OVER w ELSE start_sec END AS start_sec) FROM kept_rows WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec, seg)"""))
def j13(t):
    return segments.merge_chunks(_chunked(t), K, ["chunk", "seg"], "seg")


@query("j14_window_merge", _kept(_CONFIDENT_WINS, """SELECT * REPLACE (CASE WHEN start_sec - lag(end_sec) OVER w > 0 AND start_sec - lag(end_sec) OVER w <= 5 THEN lag(end_sec) OVER w ELSE start_sec END AS start_sec) FROM merged WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec, seg)""",
    opened="SELECT *, CASE WHEN upper(state) = lag(upper(state)) OVER w AND coalesce(equipment, '') = lag(coalesce(equipment, '')) OVER w AND start_sec - lag(end_sec) OVER w <= 5 THEN 0 ELSE 1 END AS o, row_number() OVER w AS pos FROM kept_rows WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec, seg)",
    grouped="SELECT *, sum(o) OVER (PARTITION BY recording_id ORDER BY pos) AS g FROM opened",
    merged="SELECT recording_id, arg_min(chunk, pos) AS chunk, arg_min(seg, pos) AS seg, arg_min(start_sec, pos) AS start_sec, arg_max(end_sec, pos) AS end_sec, arg_min(state, pos) AS state, arg_min(equipment, pos) AS equipment, min(confidence) AS confidence FROM grouped GROUP BY recording_id, g"))
def j14(t):
    return segments.merge_windows(_chunked(t), K, ["chunk", "seg"], "seg")


_GROWING = """SELECT recording_id, run_id, start_sec, end_sec, CASE WHEN label IN ('purchase', 'click') THEN 'EXERCISE' ELSE 'REST' END AS state, CASE WHEN run_id % 2 = 0 THEN 1200.0::DOUBLE ELSE 0.0::DOUBLE END AS before_sec, CASE WHEN run_id % 3 = 0 THEN 2400.0::DOUBLE ELSE 0.0::DOUBLE END AS after_sec,
      row_number() OVER w AS i, lead(start_sec) OVER w AS rs, lead(end_sec) OVER w AS re, (SELECT max(t_rel) FROM samples s WHERE s.recording_id = label_runs.recording_id) AS total FROM label_runs WHERE end_sec > start_sec WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec, run_id)"""
# One segment a step: s and e are its settled start and its end so far, pe the final end of the one before, ns the start that the next one is pushed to.
_GROW = "state = 'EXERCISE' AND after_sec > 0 AND re IS NOT NULL AND least(re, end_sec + after_sec) > greatest(s, end_sec)"
_STEP = f"""SELECT recording_id, i, s, CASE WHEN {_GROW} THEN least(re, end_sec + after_sec) ELSE end_sec END AS e, pe, CASE WHEN {_GROW} THEN greatest(rs, least(re, end_sec + after_sec)) ELSE rs END AS ns FROM"""
_WALK = f"""{_STEP} (SELECT *, start_sec AS s, NULL::DOUBLE AS pe FROM g WHERE i = 1) UNION ALL
      {_STEP} (SELECT *, CASE WHEN moved THEN greatest(ls, cs - before_sec) ELSE cs END AS s, CASE WHEN moved THEN least(le, greatest(ls, cs - before_sec)) ELSE le END AS pe FROM (
        SELECT g.*, w.s AS ls, w.e AS le, w.ns AS cs, g.state = 'EXERCISE' AND g.before_sec > 0 AND greatest(w.s, w.ns - g.before_sec) < least(w.ns, g.end_sec) AS moved FROM w JOIN g ON g.recording_id = w.recording_id AND g.i = w.i + 1))"""


@query("j15_boundary_expansion", sql("""SELECT recording_id, run_id, CASE WHEN i = 1 THEN greatest(0, s) ELSE s END AS start_sec, CASE WHEN fe IS NULL THEN least(total, e) ELSE fe END AS end_sec, state, before_sec, after_sec
    FROM (SELECT w.*, lead(pe) OVER (PARTITION BY recording_id ORDER BY i) AS fe FROM w) JOIN g USING (recording_id, i)""", "label_runs", "samples", g=_GROWING, w=_WALK).replace("WITH ", "WITH RECURSIVE ", 1))
def j15(t):
    rid = F.col("run_id")
    segs = b.label_runs(t).filter("end_sec > start_sec").select(
        "recording_id", "run_id", "start_sec", "end_sec", F.when(F.col("label").isin("purchase", "click"), "EXERCISE").otherwise("REST").alias("state"),
        F.when(rid % 2 == 0, 1200.0).otherwise(0.0).alias("before_sec"), F.when(rid % 3 == 0, 2400.0).otherwise(0.0).alias("after_sec"))
    totals = b.samples(t).groupBy("recording_id").agg(F.max("t_rel").alias("total_sec"))
    return segments.expand_boundaries(segs, K, ["start_sec", "run_id"], totals)


@query("j16_segment_kind", sql("SELECT label, CASE upper(label) WHEN 'CLICK' THEN 'exercise' ELSE 'transition' END AS kind, count(*) AS n FROM samples GROUP BY ALL", "samples"))
def j16(t):
    state = F.when(F.col("label") == "click", "exercise").otherwise(F.col("label"))
    return b.samples(t).groupBy("label", segments.segment_kind(state).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("j17_result_to_segment", sql("""SELECT session_id, line, CASE WHEN line % 3 = 0 THEN 1 ELSE 2 END AS sets_count, CAST(CASE WHEN line % 3 = 0 THEN 0 ELSE round_even((reps + reps + 3) / 2, 0) END AS BIGINT) AS reps_estimate, CASE WHEN session_id % 2 = 0 THEN 'lift' ELSE 'bench' END AS exercise_name, count(*) AS n FROM executions GROUP BY ALL""", "executions"))
def j17(t):
    two = F.array(F.struct("reps"), F.struct((F.col("reps") + 3).alias("reps")))
    sets = F.when(F.col("line") % 3 != 0, two).otherwise(F.slice(two, 1, 0))
    res = F.struct(sets.alias("sets"), F.when(F.col("session_id") % 2 == 0, "lift").otherwise("").alias("exercise"), F.lit("bench").alias("equipment"))
    rows = b.executions(t).withColumn("_r", res).select("session_id", "line", *[v.alias(k) for k, v in segments.result_fields(F.col("_r")).items()])
    return rows.groupBy("session_id", "line", "sets_count", "reps_estimate", "exercise_name").agg(F.count(F.lit(1)).alias("n"))


_WINLAB = """SELECT recording_id, k, gt, pred FROM (SELECT w.recording_id, w.k, r.gt_action AS gt, w.pred, row_number() OVER (PARTITION BY w.recording_id, w.k ORDER BY least(we, gt_end) - greatest(ws, gt_start) DESC, gt_id) AS rn, least(we, gt_end) - greatest(ws, gt_start) AS ov
    FROM win w JOIN truth r ON r.recording_id = w.recording_id AND r.gt_start < we AND r.gt_end > ws) WHERE rn = 1 AND ov / 21600.0::DOUBLE >= 0.6"""
_WIN6 = """SELECT recording_id, k, k * 21600.0::DOUBLE AS ws, k * 21600.0::DOUBLE + 21600.0::DOUBLE AS we, arg_min(label, (t_rel, row_id)) AS pred FROM (SELECT * EXCLUDE (k), CAST(floor(t_rel / 21600.0::DOUBLE) AS BIGINT) AS k FROM samples) GROUP BY ALL"""


def _six_hour(t):
    return b.samples(t).groupBy("recording_id", F.floor(F.col("t_rel") / 21600.0).alias("k")).agg(F.min_by("label", F.struct("t_rel", "row_id")).alias("pred")).withColumns(
        {"ws": F.col("k") * 21600.0, "we": F.col("k") * 21600.0 + 21600.0})


@query("j18_window_accuracy", sql(f"SELECT recording_id, count(*) AS total, count(*) FILTER (gt = pred) AS correct, {fx('avg(CASE WHEN gt = pred THEN 1.0::DOUBLE ELSE 0 END)')} AS accuracy FROM wl GROUP BY ALL", "samples", "truth", win=_WIN6, wl=_WINLAB))
def j18(t):
    best = intervals.label_by_overlap(_six_hour(t), b.truth(t), K, ("ws", "we"), ("gt_start", "gt_end"), "gt_action", "gt_id", DAY / 4, window_keys=["k"], out="gt")
    ok = F.col("gt") == F.col("pred")
    return best.groupBy("recording_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("correct"), fix(F.avg(ok.cast("double"))).alias("accuracy"))


@query("j18_interval_majority", sql("""SELECT recording_id, gt_id, pred FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, gt_id ORDER BY votes DESC, seen) AS rn FROM (
      SELECT r.recording_id, r.gt_id, w.pred, count(*) AS votes, min(w.k) AS seen FROM win w JOIN truth r ON r.recording_id = w.recording_id AND r.gt_start < we AND r.gt_end > ws GROUP BY ALL)) WHERE rn = 1""", "samples", "truth", win=_WIN6))
def j18b(t):
    from strideframe.operators.stats import mode_first

    pairs = intervals.overlap_join(_six_hour(t), b.truth(t).select("recording_id", "gt_id", "gt_start", "gt_end"), K, ("ws", "we"), ("gt_start", "gt_end"), DAY / 4)
    return mode_first(pairs, ["recording_id", "gt_id"], "pred", ["k"]).drop("votes")


@query("j19_clip_to_truth", sql("""SELECT p.recording_id, p.pred_id, greatest(pred_start, a) AS start_sec, least(pred_end, z) AS end_sec FROM predictions p JOIN (SELECT recording_id, min(gt_start) AS a, max(gt_end) AS z FROM truth WHERE gt_action = 'click' GROUP BY ALL) USING (recording_id)
    WHERE version = 'v1' AND pred_end > a AND pred_start < z""", "truth", "predictions"))
def j19(t):
    span = b.truth(t).filter("gt_action = 'click'").groupBy("recording_id").agg(F.min("gt_start").alias("a"), F.max("gt_end").alias("z"))
    p = b.predictions(t).filter("version = 'v1'").join(span, "recording_id").filter("pred_end > a AND pred_start < z")
    return p.select("recording_id", "pred_id", F.greatest("pred_start", "a").alias("start_sec"), F.least("pred_end", "z").alias("end_sec"))


@query("j20_fusion_classes", sql("""SELECT recording_id, k, CASE WHEN moving AND sd >= 80 THEN 'exercise_high' WHEN moving AND sd < 80 THEN 'exercise_low' WHEN NOT moving AND sd < 80 THEN 'rest' ELSE 'undecided' END AS fused
    FROM (SELECT recording_id, k, avg(value) > 100 AS moving, stddev_pop(value) AS sd FROM (SELECT * EXCLUDE (k), CAST(floor(t_rel / 86400.0::DOUBLE) AS BIGINT) AS k FROM samples) GROUP BY ALL)""", "samples"))
def j20(t):
    from strideframe.operators.posture import fuse

    w = b.samples(t).groupBy("recording_id", F.floor(F.col("t_rel") / DAY).alias("k")).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    moving = F.col("m") > 100
    return w.select("recording_id", "k", fuse(moving, F.when(F.col("sd") >= 80, "high").otherwise("low"), ~moving).alias("fused"))
