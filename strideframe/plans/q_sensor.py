"""Sensor window, feature, rhythm and alignment queries.

The event table has hours between rows, so window lengths here are days.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions.mathx import fix
from strideframe.operators import intervals, labels, posture, rhythm, sensor
from strideframe.operators.segments import merge_steps
from strideframe.plans import bindings as b
from strideframe.plans.bindings import DAY, HOUR, fx, sql
from strideframe.plans.registry import query
from strideframe.session import checkpointed

K = ["recording_id"]
O = ["t_rel", "row_id"]
_S = "SELECT * EXCLUDE (k), k AS kk FROM samples"
_TOT = "SELECT recording_id, max(t_rel) AS total FROM samples GROUP BY ALL"


def _totals(t):
    return b.samples(t).groupBy("recording_id").agg(F.max("t_rel").alias("total_sec"))


def _fixed(df, *cols, digits=6):
    return df.withColumns({c: fix(F.col(c), digits) for c in cols})


def _posture_sql(c: str) -> str:
    return f"CASE WHEN {c} > -0.35 THEN '仰卧' WHEN {c} > -0.78 THEN '俯身' WHEN {c} > -0.88 THEN '坐姿' ELSE '站姿' END"


def _intensity_sql(c: str) -> str:
    return f"CASE WHEN {c} > 0.35 THEN '高' WHEN {c} > 0.15 THEN '中高' WHEN {c} > 0.05 THEN '低' ELSE '静止' END"


def _peaks_sql(source: str, group: str) -> str:
    return f"""SELECT *, CASE WHEN acc > avg(acc) OVER (PARTITION BY {group}) + 0.15::DOUBLE AND acc >= lag(acc, 1) OVER w AND acc >= lead(acc, 1) OVER w AND acc > lag(acc, 2) OVER w AND acc > lead(acc, 2) OVER w THEN 1 ELSE 0 END AS peak
      FROM {source} WINDOW w AS (PARTITION BY {group} ORDER BY t_rel, row_id)"""


@query("i01_sample_rate", sql("""SELECT recording_id, coalesce(greatest(10.0::DOUBLE, least(100.0::DOUBLE, round_even(1.0::DOUBLE / m, 0))), 50.0::DOUBLE) AS fs FROM (SELECT DISTINCT recording_id FROM samples)
    LEFT JOIN (SELECT recording_id, quantile_cont(dt, 0.5) AS m FROM (SELECT recording_id, (t_rel - lag(t_rel) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id)) / 2000000 AS dt FROM samples) WHERE dt > 0 GROUP BY ALL) USING (recording_id)""", "samples"))
def i01(t):
    s = b.samples(t).select("recording_id", (F.col("t_rel") / 2000000).alias("t_rel"), "row_id")
    return sensor.sample_rate(s, K, "t_rel", "row_id", width=0.0001)


@query("i02_standardize", """SELECT user_id, ts, event_id, x FROM (SELECT user_id, ts, event_id, TRY_CAST(raw AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS rn
    FROM (SELECT user_id, date_trunc('day', ts) AS ts, event_id, CASE WHEN event_id % 4 = 0 THEN 'null' ELSE CAST(event_id AS VARCHAR) END AS raw FROM events) WHERE TRY_CAST(raw AS DOUBLE) IS NOT NULL) WHERE rn = 1""")
def i02(t):
    raw = t.events.select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "event_id", F.when(F.col("event_id") % 4 == 0, "null").otherwise(F.col("event_id").cast("string")).alias("x"))
    return sensor.standardize(raw, ["user_id"], "ts", ["x"], ["x"], "event_id")


@query("i03_resample", sql(f"""SELECT recording_id, bucket, {fx('''CASE WHEN v IS NOT NULL THEN v WHEN p IS NULL THEN n WHEN n IS NULL THEN p ELSE p + (n - p) * (bucket - pb) / (nb - pb) END''')} AS value FROM (
      SELECT *, last_value(v IGNORE NULLS) OVER b AS p, last_value(CASE WHEN v IS NOT NULL THEN bucket END IGNORE NULLS) OVER b AS pb, first_value(v IGNORE NULLS) OVER a AS n, first_value(CASE WHEN v IS NOT NULL THEN bucket END IGNORE NULLS) OVER a AS nb
      FROM (SELECT g.recording_id, g.bucket, m.v FROM (SELECT recording_id, unnest(range(lo, hi + 1)) AS bucket FROM (SELECT recording_id, min(bucket) AS lo, max(bucket) AS hi FROM m GROUP BY ALL)) g LEFT JOIN m USING (recording_id, bucket))
      WINDOW b AS (PARTITION BY recording_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY recording_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "samples", m=f"SELECT recording_id, CAST(floor(t_rel / {2 * HOUR}::DOUBLE) AS BIGINT) AS bucket, avg(value) AS v FROM samples GROUP BY ALL"))
def i03(t):
    out = sensor.resample(b.samples(t), K, "t_rel", ["value"], 2 * HOUR)
    return out.select("recording_id", "bucket", fix(F.col("value")).alias("value"))


@query("i04_unit_fix", sql(f"""SELECT row_id, {fx('gx / CASE WHEN m > 40 THEN 9.80665::DOUBLE ELSE 1 END')} AS gx FROM samples JOIN (SELECT recording_id, quantile_cont(sqrt(gx * gx + gy * gy), 0.5) AS m FROM samples GROUP BY ALL) USING (recording_id)""", "samples"))
def i04(t):
    out = sensor.to_g(b.samples(t).select("recording_id", "row_id", "gx", "gy"), K, ["gx", "gy"], 40.0)
    return out.select("row_id", fix(F.col("gx")).alias("gx"))


@query("i05_gravity_split", sql(f"SELECT row_id, {', '.join(f'''{fx(f'sum({a}) OVER w / 5')} AS g_{a}, {fx(f'{a} - sum({a}) OVER w / 5')} AS lin_{a}''' for a in ('ax', 'ay', 'az'))} FROM samples WINDOW w AS (PARTITION BY recording_id ORDER BY t_rel, row_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "samples"))
def i05(t):
    out = sensor.moving_average(b.samples(t).select("recording_id", "row_id", "t_rel", "ax", "ay", "az"), K, O, ["ax", "ay", "az"], 5)
    cols = {f"lin_{a}": F.col(a) - F.col(f"g_{a}") for a in ("ax", "ay", "az")}
    names = ["g_ax", "g_ay", "g_az", *cols]
    return _fixed(out.withColumns(cols).select("row_id", *names), *names)


def _grid(step: float) -> str:
    """SQL: the recordings with every step k up to their end."""
    return f"(SELECT *, CAST(unnest(generate_series(0, CAST(floor(total / {step}::DOUBLE) AS BIGINT))) AS INT) AS k FROM tot)"


def _windowed(rows: str, size: float, stride: float, at: str = "t_rel", name: str = "k") -> str:
    """SQL: the rows with every window of (size, stride) that holds them."""
    return f"(SELECT *, unnest(generate_series(greatest(0, CAST(floor(({at} - {size}::DOUBLE) / {stride}::DOUBLE) AS BIGINT)), CAST(floor({at} / {stride}::DOUBLE) AS BIGINT))) AS {name} FROM {rows})"


_TUMBLE = f"""SELECT t.recording_id, t.k, s.n, {fx('s.acc_std')} AS acc_std, {fx('s.gyro_mean')} AS gyro_mean, s.gyro_max, s.peaks, CASE WHEN s.n IS NULL THEN NULL ELSE {_posture_sql('s.az_mean')} END AS posture,
      CASE WHEN s.n IS NULL THEN 'no data' ELSE {_intensity_sql('s.acc_std')} END AS intensity, CASE WHEN s.n IS NULL THEN NULL WHEN s.acc_std > 0.15 AND s.peaks >= 3 THEN 'strength' WHEN s.acc_std > 0.05 AND {_posture_sql('s.az_mean')} = '站姿' THEN 'walking' WHEN s.acc_std <= 0.05 THEN 'resting' ELSE '' END AS hint
    FROM (SELECT * FROM {_grid(DAY)} WHERE k * {DAY} < total) t LEFT JOIN (SELECT recording_id, k, count(*) AS n, stddev_pop(acc) AS acc_std, avg(az) AS az_mean, avg(gyro) AS gyro_mean, max(gyro) AS gyro_max, CAST(sum(peak) AS BIGINT) AS peaks FROM p GROUP BY ALL) s
      ON s.recording_id = t.recording_id AND s.k = t.k"""


@query("i06_tumbling_summary", sql(_TUMBLE, "samples", tot=_TOT, q=f"SELECT * EXCLUDE (k), CAST(floor(t_rel / {DAY}::DOUBLE) AS BIGINT) AS k FROM samples", p=_peaks_sql("q", "recording_id, k")))
def i06(t):
    out = sensor.tumbling_summary(b.samples(t), K, "t_rel", "row_id", _totals(t), DAY)
    return _fixed(out.drop("az_mean"), "acc_std", "gyro_mean")


_SEG3 = f"SELECT recording_id, k AS seg, k * {3 * DAY}::DOUBLE AS start_sec, k * {3 * DAY}::DOUBLE + {2.5 * DAY}::DOUBLE AS end_sec FROM {_grid(3 * DAY)} WHERE k * {3 * DAY} < total"


def _segments(t):
    k = F.explode(F.sequence(F.lit(0), F.floor(F.col("total_sec") / (3 * DAY)).cast("int")))
    out = _totals(t).withColumn("seg", k).filter(F.col("seg") * (3 * DAY) < F.col("total_sec"))
    return out.select("recording_id", "seg", (F.col("seg") * (3 * DAY)).alias("start_sec"), (F.col("seg") * (3 * DAY) + 2.5 * DAY).alias("end_sec"))


@query("i07_segment_summary", sql(f"""SELECT recording_id, seg, count(*) AS n, {fx('avg(gyro)')} AS gyro_mean, max(gyro) AS gyro_max, {fx('avg(acc)')} AS acc_mean, {fx('stddev_pop(acc)')} AS acc_std, CAST(sum(peak) AS BIGINT) AS peaks, count(*) FILTER (la IS NOT NULL AND la <> above) AS crossings,
      {_posture_sql('avg(az)')} AS posture, {_intensity_sql('stddev_pop(acc)')} AS intensity, CASE WHEN count(*) FILTER (la IS NOT NULL AND la <> above) >= 4 THEN {fx('(any_value(end_sec) - any_value(start_sec)) / (count(*) FILTER (la IS NOT NULL AND la <> above) / 2)')} END AS period_sec
    FROM (SELECT *, lag(above) OVER (PARTITION BY recording_id, seg ORDER BY t_rel, row_id) AS la FROM (SELECT *, gyro > avg(gyro) OVER (PARTITION BY recording_id, seg) AS above FROM p)) GROUP BY recording_id, seg""",
    "samples", tot=_TOT, seg=_SEG3, x=f"SELECT s.recording_id, s.row_id, s.t_rel, s.acc, s.gyro, s.az, g.seg, g.start_sec, g.end_sec FROM samples s JOIN seg g ON g.recording_id = s.recording_id AND s.t_rel >= g.start_sec - {HOUR} AND s.t_rel <= g.end_sec + {HOUR}", p=_peaks_sql("x", "recording_id, seg")))
def i07(t):
    out = sensor.segment_summary(b.samples(t), _segments(t), K, "seg", "t_rel", "row_id", DAY, HOUR)
    cols = ["recording_id", "seg", "n", "gyro_mean", "gyro_max", "acc_mean", "acc_std", "peaks", "crossings", "posture", "intensity", "period_sec"]
    return _fixed(out.select(cols), "gyro_mean", "acc_mean", "acc_std", "period_sec")


@query("i08_sub_windows", sql(f"""SELECT recording_id, seg, sub, count(*) AS n, {fx('stddev_pop(acc)')} AS acc_std, CAST(sum(peak) AS BIGINT) AS peaks, {_posture_sql('avg(az)')} AS posture, {_intensity_sql('stddev_pop(acc)')} AS intensity FROM p GROUP BY ALL HAVING count(*) >= 2""",
    "samples", tot=_TOT, seg=_SEG3, x=f"""SELECT s.recording_id, s.row_id, s.t_rel, s.acc, s.az, g.seg, g.end_sec, CAST(floor((s.t_rel - g.start_sec) / {DAY}::DOUBLE) AS BIGINT) AS sub, count(*) OVER (PARTITION BY s.recording_id, g.seg) AS c FROM samples s JOIN seg g ON g.recording_id = s.recording_id AND s.t_rel >= g.start_sec AND s.t_rel <= g.end_sec""",
    y="SELECT * FROM x WHERE c > 4 AND t_rel < end_sec", p=_peaks_sql("y", "recording_id, seg, sub")))
def i08(t):
    out = sensor.sub_windows(b.samples(t), _segments(t), K, "seg", "t_rel", "row_id", DAY, DAY, 4, 2)
    return _fixed(out.drop("az_mean"), "acc_std")


_REST = f"""SELECT recording_id, seg, start_sec + min(k) * {DAY / 4}::DOUBLE AS rest_start, start_sec + max(k) * {DAY / 4}::DOUBLE + {DAY}::DOUBLE AS rest_end FROM (
      SELECT *, sum(c) OVER (PARTITION BY recording_id, seg ORDER BY k) AS run FROM (SELECT *, CASE WHEN still = lag(still) OVER (PARTITION BY recording_id, seg ORDER BY k) THEN 0 ELSE 1 END AS c FROM (
        SELECT recording_id, seg, start_sec, w.k, stddev_pop(acc) < 0.3 AS still FROM {_windowed('x', DAY, DAY / 4, 'rel')} w WHERE w.rel >= w.k * {DAY / 4} AND w.rel < w.k * {DAY / 4} + {DAY} AND w.k * {DAY / 4} + {DAY} <= end_sec - start_sec
        AND c >= 4 GROUP BY recording_id, seg, start_sec, w.k HAVING count(*) >= 2)))
    WHERE still GROUP BY recording_id, seg, start_sec, run HAVING (start_sec + max(k) * {DAY / 4}::DOUBLE + {DAY}::DOUBLE) - (start_sec + min(k) * {DAY / 4}::DOUBLE) >= {1.25 * DAY}"""
_RESTX = "SELECT s.recording_id, s.row_id, s.t_rel, s.acc, g.seg, g.start_sec, g.end_sec, s.t_rel - g.start_sec AS rel, count(*) OVER (PARTITION BY s.recording_id, g.seg) AS c FROM samples s JOIN seg g ON g.recording_id = s.recording_id AND s.t_rel >= g.start_sec AND s.t_rel <= g.end_sec"


def _rests(t):
    return sensor.rest_periods(b.samples(t), _segments(t), K, "seg", "t_rel", DAY, DAY, DAY / 4, 0.3, 1.25 * DAY, 4, 2)


@query("i09_rest_periods", sql(_REST, "samples", tot=_TOT, seg=_SEG3, x=_RESTX))
def i09(t):
    return _rests(t)


@query("i10_set_splitting", sql("""SELECT s.recording_id, s.seg, s.set_no, s.set_start, s.set_end, CAST(coalesce(sum(p.peak), 0) AS BIGINT) AS reps FROM sets s LEFT JOIN p USING (recording_id, seg, set_no) GROUP BY ALL""",
    "samples", tot=_TOT, seg=_SEG3, x=_RESTX, rests=_REST,
    edges="SELECT recording_id, seg, start_sec AS cut, start_sec AS until FROM seg UNION ALL SELECT recording_id, seg, end_sec, end_sec FROM seg UNION ALL SELECT recording_id, seg, rest_start, rest_end FROM rests",
    sets="SELECT * FROM (SELECT recording_id, seg, row_number() OVER w AS set_no, until AS set_start, lead(cut) OVER w AS set_end FROM edges WINDOW w AS (PARTITION BY recording_id, seg ORDER BY cut, until)) WHERE set_end > set_start",
    y="SELECT s.recording_id, s.row_id, s.t_rel, s.acc, g.seg, g.set_no FROM samples s JOIN sets g ON g.recording_id = s.recording_id AND s.t_rel >= g.set_start AND s.t_rel < g.set_end", p=_peaks_sql("y", "recording_id, seg, set_no")))
def i10(t):
    return sensor.split_sets(b.samples(t), _segments(t), checkpointed(_rests(t)), K, "seg", "t_rel", "row_id", DAY)


_W11 = f"""SELECT recording_id, w.k, count(*) AS n, avg(acc) AS acc_mean, stddev_samp(acc) AS acc_std, avg(gyro) AS gyro_mean, max(gyro) AS gyro_max, avg(az) AS az_mean, stddev_samp(az) AS az_std, avg(ax) AS ax_mean, avg(ay) AS ay_mean, avg(abs(ay)) AS ay_abs_mean,
      avg(sqrt(ax * ax + ay * ay)) AS horiz_g_mean, stddev_samp(angle_x) AS angle_x_std, stddev_samp(angle_y) AS angle_y_std, avg(angle_y) AS angle_y_mean, avg(jerk) AS jerk_mean
    FROM {_windowed('(SELECT s.*, total, coalesce(abs(acc - lag(acc) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id)), 0) AS jerk FROM s JOIN tot USING (recording_id))', 2 * DAY, DAY)} w
      WHERE t_rel >= w.k * {DAY}::DOUBLE AND t_rel < w.k * {DAY}::DOUBLE + {2 * DAY}::DOUBLE AND w.k * {DAY} < total GROUP BY ALL HAVING count(*) >= 3"""
_M11 = ("acc_mean", "acc_std", "gyro_mean", "az_mean", "az_std", "ax_mean", "ay_mean", "ay_abs_mean", "horiz_g_mean", "angle_x_std", "angle_y_std", "angle_y_mean", "jerk_mean")

# az moves in steps of 1/40000, whose means tie at six digits.
_D11 = {"az_mean": 9}


def _w11(t):
    return sensor.window_stats(b.samples(t).drop("k", "label", "value", "ts"), K, "t_rel", "row_id", _totals(t), 2 * DAY, DAY)


@query("i11_window_stats", sql(f"SELECT recording_id, k, n, gyro_max, {', '.join(f'{fx(c, _D11.get(c, 6))} AS {c}' for c in _M11)} FROM w", "samples", tot=_TOT, s=_S, w=_W11))
def i11(t):
    return _w11(t).withColumns({c: fix(F.col(c), _D11.get(c, 6)) for c in _M11})


_F12 = ("tilt_mean", "tilt_std", "tilt_range", "drift_mean", "turn", "acc_mean", "acc_std", "gyro_mean", "gyro_std", "vertical_energy")
_W12 = f"""SELECT recording_id, k, count(*) AS n, avg(z) AS tilt_mean, stddev_pop(z) AS tilt_std, max(z) - min(z) AS tilt_range, coalesce(avg(dx), 0) AS drift_mean, abs(arg_max(angle_y, (t_rel, row_id)) - arg_min(angle_y, (t_rel, row_id))) AS turn,
      avg(acc) AS acc_mean, stddev_pop(acc) AS acc_std, avg(gyro) AS gyro_mean, stddev_pop(gyro) AS gyro_std, var_pop(az) AS vertical_energy, count(*) FILTER (acc - m > sd * 0.3::DOUBLE AND acc > l AND acc > r) AS peak_count
    FROM (SELECT *, abs(((angle_z - 180 + 180) % 360 + 360) % 360 - 180) AS z, abs(angle_x - lag(angle_x) OVER w) AS dx, avg(acc) OVER (PARTITION BY recording_id, k) AS m, stddev_pop(acc) OVER (PARTITION BY recording_id, k) AS sd, lag(acc) OVER w AS l, lead(acc) OVER w AS r
      FROM (SELECT * FROM {_windowed('(SELECT s.*, total FROM s JOIN tot USING (recording_id))', 3 * DAY, DAY)} q WHERE t_rel >= q.k * {DAY}::DOUBLE AND t_rel < q.k * {DAY}::DOUBLE + {3 * DAY}::DOUBLE AND q.k * {DAY}::DOUBLE + {3 * DAY}::DOUBLE <= total + 0.01::DOUBLE)
      WINDOW w AS (PARTITION BY recording_id, k ORDER BY t_rel, row_id)) GROUP BY ALL HAVING count(*) >= 5"""


def _w12(t, frequency=False):
    totals = _totals(t).withColumn("fs", F.lit(10.0))
    s = b.samples(t).drop("k", "ts", "label", "value")
    return sensor.window_features(s, K, "t_rel", "row_id", totals, 3 * DAY, DAY, frequency=frequency)


@query("i12_window_features", sql(f"SELECT recording_id, k, n, peak_count, {', '.join(f'{fx(c)} AS {c}' for c in _F12)} FROM w", "samples", tot=_TOT, s=_S, w=_W12))
def i12(t):
    return _fixed(_w12(t), *_F12)


_SIG = "SELECT recording_id, k, list(acc ORDER BY t_rel, row_id) AS x, count(*) AS n, avg(acc) AS m, stddev_pop(acc) AS sd FROM {} WHERE t_rel >= k * {}::DOUBLE AND t_rel < k * {}::DOUBLE + {}::DOUBLE GROUP BY ALL"
_POINTS = "SELECT recording_id, k, n, i, (x[i + 1] - m) / DIV AS z FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM sig)"
_R13 = f"""SELECT s.recording_id, s.k, {fx('coalesce(p.freq, 0)')} AS freq, {fx('CASE WHEN p.freq IS NULL THEN 0 ELSE greatest(0, least(1, 0.55 * e.echo + 0.45 * least(1, 3 * p.share))) END')} AS score, {fx('1 / p.freq')} AS period, {fx('coalesce(s.n / 4.0 * p.freq, 0)')} AS reps FROM sig s
    LEFT JOIN (SELECT recording_id, k, arg_max(f * 4.0 / n, p) AS freq, max(p) / (sum(p) + 1e-8) AS share FROM (
      SELECT recording_id, k, n, f, pow(sum(h * cos(2 * pi() * f * i / n)), 2) + pow(sum(h * sin(2 * pi() * f * i / n)), 2) AS p
      FROM (SELECT *, z * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS h, unnest(generate_series(1, n // 2)) AS f FROM pts WHERE n >= 16) WHERE f * 4.0 / n BETWEEN 0.2 AND 3 GROUP BY ALL) GROUP BY ALL) p USING (recording_id, k)
    LEFT JOIN (SELECT recording_id, k, max(v) AS echo FROM (SELECT a.recording_id, a.k, l, sum(a.z * b.z) / (any_value(a.n) + 1e-8) AS v FROM (SELECT *, unnest(generate_series(1, least(n - 1, 20) - 1)) AS l FROM pts) a JOIN pts b ON b.recording_id = a.recording_id AND b.k = a.k AND b.i = a.i + a.l GROUP BY ALL) GROUP BY ALL) e USING (recording_id, k)"""


@query("i13_periodicity", sql(_R13, "samples", sig=_SIG.format(_windowed("(SELECT * EXCLUDE (k) FROM samples)", 12 * DAY, 3 * DAY), 3 * DAY, 3 * DAY, 12 * DAY), pts=_POINTS.replace("DIV", "sd").replace("FROM sig", "FROM sig WHERE n >= 16 AND sd >= 1e-6")))
def i13(t):
    sig = sensor.window_signal(b.samples(t), K, "t_rel", "row_id", "acc", 12 * DAY, 3 * DAY)
    p = rhythm.periodicity(F.col("signal"), F.lit(4.0))
    return _fixed(sig.select("recording_id", "k", p.alias("p")).select("recording_id", "k", "p.*"), "freq", "score", "period", "reps")


def _ac_sql() -> str:
    lags = ", ".join(f"{{'v': list_sum(list_transform(range(1, 21 - {g}), lambda i: c[i] * c[i + {g}])) / z, 'l': -{g}}}" for g in range(2, 11))
    return f"""SELECT recording_id, w, first_row, NOT flat AND top.v > 0.3 AS periodic, CASE WHEN NOT flat AND top.v > 0.3 THEN -top.l END AS period_rows, {fx('CASE WHEN flat THEN 0 ELSE top.v END')} AS strength
      FROM (SELECT *, sd < 0.1 AS flat, list_sort([{lags}], 'DESC')[1] AS top FROM (SELECT *, list_sum(list_transform(c, lambda x: x * x)) + 1e-8 AS z FROM (
        SELECT recording_id, w, w * 10 AS first_row, list_transform(list(value ORDER BY pos), lambda x: x - avg(value)) AS c, stddev_pop(value) AS sd
        FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) - 1 AS pos, count(*) OVER (PARTITION BY recording_id) AS n FROM samples) x, unnest(generate_series(greatest(0, (pos - 20) // 10), pos // 10)) AS q(w)
          WHERE pos >= w * 10 AND pos < w * 10 + 20 AND w * 10 < n - 20 GROUP BY recording_id, w)))"""


@query("i14_flow_periodicity", sql(_ac_sql(), "samples"))
def i14(t):
    return _fixed(sensor.flow_periodicity(b.samples(t), K, O, "value"), "strength")


_R15 = """SELECT s.recording_id, s.k, CASE WHEN best.v >= 0.25 THEN round_even((s.n / 2.0) / best.l, 2) ELSE 0 END AS step_freq FROM sig s LEFT JOIN (
      SELECT recording_id, k, arg_max({'v': v, 'l': l}, v) AS best FROM (SELECT a.recording_id, a.k, a.l, sum(a.z * b.z) / (any_value(e.ac0) + 1e-9) AS v
        FROM (SELECT *, unnest(generate_series(greatest(1, CAST(floor(0.3 * (n / 2.0)) AS BIGINT)), least(n - 1, CAST(floor(1.5 * (n / 2.0)) AS BIGINT)) - 1)) AS l FROM pts WHERE n >= 10) a
        JOIN pts b ON b.recording_id = a.recording_id AND b.k = a.k AND b.i = a.i + a.l JOIN (SELECT recording_id, k, sum(z * z) AS ac0 FROM pts GROUP BY ALL) e ON e.recording_id = a.recording_id AND e.k = a.k GROUP BY ALL) GROUP BY ALL) USING (recording_id, k)"""


@query("i15_step_frequency", sql(_R15, "samples", sig=_SIG.format(_windowed("(SELECT * EXCLUDE (k) FROM samples)", 10 * DAY, 5 * DAY), 5 * DAY, 5 * DAY, 10 * DAY), pts=_POINTS.replace("DIV", "1")))
def i15(t):
    sig = sensor.window_signal(b.samples(t), K, "t_rel", "row_id", "acc", 10 * DAY, 5 * DAY)
    return sig.select("recording_id", "k", rhythm.step_frequency("signal", F.lit(2.0)).alias("step_freq"))


_HITS = """SELECT recording_id, row_id, t_rel, CASE WHEN d > 0 THEN 'rise' ELSE 'drop' END AS kind, d AS delta FROM (SELECT *, avg(value) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
      - avg(value) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS d, row_number() OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS pos, count(*) OVER (PARTITION BY recording_id) AS n FROM samples) WHERE pos > 3 AND pos < n AND abs(d) >= 60"""
# One hit a step: a new one is kept after a change of kind or enough time, a larger one takes the place of the last.
_STEPS = sql(f"""SELECT recording_id, kt AS t_rel, kind, {fx('kd')} AS delta FROM (SELECT *, lead(fresh) OVER (PARTITION BY recording_id ORDER BY i) AS then_fresh FROM st) WHERE coalesce(then_fresh, true)""", "samples", hits=_HITS,
    h="SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_rel, kind, delta) AS i FROM hits",
    st=f"""SELECT recording_id, i, kind, t_rel AS kt, delta AS kd, true AS fresh FROM h WHERE i = 1 UNION ALL
      SELECT recording_id, i, kind, CASE WHEN f OR abs(delta) > abs(kd) THEN t_rel ELSE kt END, CASE WHEN f OR abs(delta) > abs(kd) THEN delta ELSE kd END, f
      FROM (SELECT h.*, kt, kd, h.kind <> st.kind OR h.t_rel - kt >= {DAY} AS f FROM st JOIN h ON h.recording_id = st.recording_id AND h.i = st.i + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)  # fmt: skip


@query("i16_step_changes", _STEPS)
def i16(t):
    hits = sensor.step_hits(b.samples(t).select("recording_id", "row_id", "t_rel", "value"), K, O, "value", 3, 60.0)
    return merge_steps(hits.select("recording_id", "t_rel", "kind", "delta"), K, "t_rel", "kind", "delta", DAY).withColumn("delta", fix(F.col("delta")))


@query("i16_step_hits", sql(f"SELECT row_id, kind, {fx('delta')} AS delta FROM hits", "samples", hits=_HITS))
def i16b(t):
    hits = sensor.step_hits(b.samples(t).select("recording_id", "row_id", "t_rel", "value"), K, O, "value", 3, 60.0)
    return hits.select("row_id", "kind", fix(F.col("delta")).alias("delta"))


@query("i17_flow_chunks", sql(f"""SELECT recording_id, chunk, start_sec, end_sec, {fx('avg_flow')} AS avg_flow, max_energy, label, CASE WHEN avg_flow < 1 THEN '极低' WHEN avg_flow < 3 THEN '低' WHEN avg_flow < 6 THEN '中' WHEN avg_flow < 10 THEN '高' ELSE '极高' END AS level FROM
      (SELECT recording_id, chunk, min(t_rel) AS start_sec, max(t_rel) AS end_sec, avg(value) AS avg_flow, max(acc) AS max_energy FROM c GROUP BY ALL) JOIN
      (SELECT recording_id, chunk, label FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, chunk ORDER BY votes DESC, seen) AS rn FROM (SELECT recording_id, chunk, label, count(*) AS votes, min(pos) AS seen FROM c GROUP BY ALL)) WHERE rn = 1) USING (recording_id, chunk)""",
    "samples", c="SELECT *, CAST(floor((pos - 1) / 5) AS BIGINT) AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS pos FROM samples)"))
def i17(t):
    s = b.samples(t).select("recording_id", "row_id", "t_rel", "value", "label", "acc")
    return _fixed(sensor.row_chunks(s, K, O, 5, "value", "label", "acc", "t_rel"), "avg_flow")


@query("i18_flow_overview", sql(f"""SELECT recording_id, n, {fx('avg_flow')} AS avg_flow, {fx('avg_energy')} AS avg_energy, reversals, reversals > n * 0.3 AS reciprocating FROM (
      SELECT recording_id, count(*) AS n, avg(value) AS avg_flow, avg(acc) AS avg_energy, count(*) FILTER (p IS NOT NULL AND p <> label) AS reversals FROM (SELECT *, lag(label) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS p FROM samples) GROUP BY ALL)""", "samples"))
def i18(t):
    return _fixed(sensor.flow_overview(b.samples(t), K, O, "value", "label", "acc"), "avg_flow", "avg_energy")


_B19 = f"""SELECT recording_id, candidates, CASE WHEN candidates >= 3 THEN b ELSE 180 END AS baseline, CASE WHEN candidates >= 3 THEN 'stable_windows_near_180' ELSE 'default_180' END AS source FROM (
      SELECT recording_id, count(*) FILTER (st) AS candidates, degrees(atan2(avg(sin(radians(z))) FILTER (st), avg(cos(radians(z))) FILTER (st))) AS b FROM (
        SELECT *, abs(a - 1) < 0.15 AND sd < 0.1 AND g < 25 AND abs(((z - 180 + 180) % 360 + 360) % 360 - 180) < 25 AS st FROM (
          SELECT recording_id, w, avg(acc / 1.1) AS a, stddev_pop(acc) / 5 AS sd, avg(gyro) / 4 AS g, degrees(atan2(avg(sin(radians(angle_z))), avg(cos(radians(angle_z))))) AS z FROM (
            SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) - 1 AS pos, count(*) OVER (PARTITION BY recording_id) AS n FROM samples) x, unnest(generate_series(greatest(0, (pos - 6) // 2), pos // 2)) AS q(w)
            WHERE pos >= w * 2 AND pos < w * 2 + 6 AND (w = 0 OR w * 2 + 6 <= n) GROUP BY recording_id, w)) GROUP BY ALL)"""


def _base(t):
    s = b.samples(t).select("recording_id", "row_id", "t_rel", (F.col("acc") / 1.1).alias("acc"), F.col("acc").alias("_raw"), (F.col("gyro") / 4).alias("gyro"), "angle_z")
    wins = sensor.row_windows(s, K, O, 6, 2)
    return sensor.upright_baseline(wins.withColumn("acc", F.col("acc")), K)


@query("i19_upright_baseline", sql(f"SELECT recording_id, candidates, {fx('baseline', 4)} AS baseline, source FROM b", "samples", b=_B19.replace("stddev_pop(acc) / 5", "stddev_pop(acc / 1.1)")))
def i19(t):
    return _fixed(_base(t), "baseline", digits=4)


@query("i20_posture_windows")
def i20(t):
    rows = b.samples(t).select("recording_id", "row_id", "t_rel", "ax", "ay", "az", "gyro", "angle_z", "angle_x")
    out = sensor.posture_windows(rows, K, "t_rel", "row_id", _base(t), 10.0, 3 * DAY, DAY, forward="+Z", right="+X", lead_in=2 * DAY)
    return labels.fill_short_runs(out.select("recording_id", "k", "posture", "confidence", "rule"), K, ["k"], "posture", 2, width=50_000)


@query("i21_clock_offset", sql("SELECT version, recording_id, v - s AS offset_sec FROM (SELECT recording_id, max(t_rel) AS s FROM samples GROUP BY ALL) JOIN (SELECT version, recording_id, max(pred_end) AS v FROM predictions GROUP BY ALL) USING (recording_id)", "samples", "predictions"))
def i21(t):
    p = b.predictions(t).select("version", "recording_id", "pred_end")
    return sensor.clock_offset(b.samples(t), p, K, "t_rel", "pred_end", ["version"])


@query("i22_shifted_segment_stats", sql(f"""SELECT g.recording_id, g.run_id, start_sec + 4.5::DOUBLE AS video_start, end_sec + 4.5::DOUBLE AS video_end, {fx('coalesce(avg(gyro), 0)')} AS gyro_mean, {fx('coalesce(avg(az), 0)', 9)} AS az_mean, {fx('stddev_samp(acc)')} AS acc_std
    FROM label_runs g LEFT JOIN samples s ON s.recording_id = g.recording_id AND s.t_rel >= g.start_sec AND s.t_rel < g.end_sec GROUP BY ALL""", "label_runs"))
def i22(t):
    segs = b.label_runs(t).select("recording_id", "run_id", "start_sec", "end_sec")
    offs = b.samples(t).select("recording_id").distinct().withColumn("offset_sec", F.lit(4.5))
    out = sensor.shifted_stats(b.samples(t), segs, offs, K, "run_id", "t_rel", DAY / 2)
    out = out.select("recording_id", "run_id", "video_start", "video_end", "gyro_mean", fix(F.col("az_mean"), 9).alias("az_mean"), "acc_std")
    return _fixed(out, "gyro_mean", "acc_std")


@query("i23_truth_seconds", sql("""SELECT row_id, start_sec, end_sec FROM (SELECT row_id, greatest(0, least(CASE row_id % 3 WHEN 0 THEN t_rel WHEN 1 THEN t_rel ELSE k END, total)) AS start_sec, greatest(0, least(t_rel + 60, total)) AS end_sec
      FROM (SELECT s.row_id, s.k, CASE WHEN row_id % 3 = 1 THEN CAST(epoch_us(s.ts) - epoch_us(f.first) AS DOUBLE) / 1e6 ELSE t_rel END AS t_rel, total FROM samples s JOIN (SELECT recording_id, min(ts) AS first, max(t_rel) AS total FROM samples GROUP BY ALL) f USING (recording_id))) WHERE end_sec > start_sec""", "samples"))
def i23(t):
    s = b.samples(t).join(b.samples(t).groupBy("recording_id").agg(F.min("ts").alias("first"), F.max("t_rel").alias("total")), "recording_id")
    m = F.col("row_id") % 3
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+08:00"))
    value = F.when(m == 0, F.col("t_rel").cast("string")).when(m == 1, iso).otherwise("n/a")
    start = sensor.truth_seconds(value, F.col("first"), F.col("k").cast("double"))
    a, z = sensor.clip_interval(start, F.col("t_rel") + 60, F.col("total"))
    return s.select("row_id", a.alias("start_sec"), z.alias("end_sec")).filter("end_sec > start_sec")


@query("i24_axis_profile", sql(f"""SELECT recording_id, CASE WHEN x >= y AND x >= z THEN 'x' WHEN y >= z THEN 'y' ELSE 'z' END AS main_axis, {fx('greatest(x, y, z) / (x + y + z)')} AS axis_share, {fx('axr')} AS angle_x_range, {fx('ayr')} AS angle_y_range FROM (
      SELECT recording_id, var_pop(ax) AS x, var_pop(ay) AS y, var_pop(az) AS z, max(angle_x) - min(angle_x) AS axr, max(angle_y) - min(angle_y) AS ayr FROM samples GROUP BY ALL)""", "samples"))
def i24(t):
    return _fixed(sensor.axis_profile(b.samples(t), K, "t_rel"), "axis_share", "angle_x_range", "angle_y_range")


@query("i24_peak_rhythm", sql(f"""SELECT recording_id, count(*) AS peaks, {fx('avg(g)', 4)} AS mean_gap, {fx('stddev_pop(g)', 4)} AS std_gap FROM (SELECT recording_id, t_rel - lag(t_rel) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id) AS g FROM p WHERE peak = 1) GROUP BY ALL""", "samples", p=_peaks_sql("samples", "recording_id")))
def i24b(t):
    rows = sensor.mark_peaks(b.samples(t).select("recording_id", "row_id", "t_rel", "acc"), K, O, "acc")
    return _fixed(sensor.peak_rhythm(rows.filter("peak = 1"), K, "t_rel", "row_id"), "mean_gap", "std_gap", digits=4)


@query("i25_cover_windows", sql(f"""SELECT recording_id, k, k * {4 * DAY}::DOUBLE AS ws, least(k * {4 * DAY}::DOUBLE + {5 * DAY}::DOUBLE, total) AS we FROM {_grid(4 * DAY)} WHERE k * {4 * DAY} < total AND (k = 0 OR (k - 1) * {4 * DAY} + {5 * DAY} < total)""", "samples", tot=_TOT))
def i25(t):
    w = _totals(t).withColumn("k", F.explode(intervals.cover_windows(F.col("total_sec"), 5 * DAY, DAY)))
    return w.select("recording_id", "k", (F.col("k") * (4 * DAY)).alias("ws"), F.least(F.col("k") * (4 * DAY) + 5 * DAY, F.col("total_sec")).alias("we"))


@query("i26_frame_motion", sql("SELECT row_id, coalesce(abs(v - lag(v) OVER (PARTITION BY recording_id ORDER BY t_rel, row_id)), 0) AS motion FROM (SELECT *, CASE WHEN k % 10 <> 0 THEN value END AS v FROM samples)", "samples"))
def i26(t):
    s = b.samples(t).select("recording_id", "row_id", "t_rel", F.when(F.col("k") % 10 != 0, F.col("value")).alias("v"))
    return sensor.frame_motion(s, K, O, "v").select("row_id", "motion")


_TH2 = """CASE WHEN az_mean > -0.35 AND gyro_mean < 15 THEN 'lying' WHEN gyro_mean < 6 AND acc_std < 0.04 THEN CASE WHEN az_mean < -0.75 THEN 'still' ELSE 'still_nonvert' END WHEN gyro_mean < 15 AND acc_std < 0.10 THEN 'slight'
    WHEN az_mean > -0.78 AND az_mean < -0.35 AND ay_abs_mean > 0.25 AND gyro_mean < 25 THEN 'bending' WHEN gyro_max > 100 OR acc_std > 0.35 THEN 'vigorous'
    WHEN acc_std BETWEEN 0.05 AND 0.35 AND gyro_mean <= 55 AND az_mean < -0.78 AND n % 3 = 0 THEN CASE WHEN n > 5 THEN 'running' ELSE 'walking' END
    WHEN acc_std BETWEEN 0.05 AND 0.35 AND gyro_mean <= 55 AND az_mean < -0.78 AND gyro_mean < 30 THEN 'walking'
    WHEN az_mean < -0.75 AND gyro_mean > 10 AND gyro_mean < 60 AND acc_std < 0.25 THEN 'squat_sit' WHEN gyro_mean >= 15 THEN 'active' ELSE 'unknown' END"""


@query("j02_chest_activity", sql(f"SELECT recording_id, k, {_TH2} AS activity FROM (SELECT * REPLACE (gyro_mean / 2 AS gyro_mean, acc_std AS acc_std) FROM w)", "samples", tot=_TOT, s=_S, w=_W11))
def j02(t):
    n = F.col("n")
    steps = F.when(n % 3 == 0, F.when(n > 5, 3.0).otherwise(2.0)).otherwise(0.0)
    label = posture.chest_activity(F.col("acc_std"), F.col("gyro_mean") / 2, F.col("gyro_max"), F.col("az_mean"), F.col("ay_abs_mean"), steps)
    return _w11(t).select("recording_id", "k", label.alias("activity"))


@query("j03_angle_activity", sql("""SELECT recording_id, k, CASE WHEN abs(az_mean) < 0.4 AND g < 12 THEN 'lying' WHEN g < 6 AND acc_std < 0.04 THEN CASE WHEN abs(az_mean) > 0.8 THEN 'still' ELSE 'still_nonvert' END WHEN g < 15 AND acc_std < 0.1 THEN CASE WHEN angle_y_std > 8 THEN 'bending' ELSE 'slight' END
    WHEN gyro_max / 3 > 100 OR acc_std > 0.35 THEN 'vigorous' WHEN acc_std BETWEEN 0.05 AND 0.35 AND g <= 55 THEN 'walking' WHEN angle_y_std > 8 AND acc_std < 0.25 AND g < 50 THEN 'bending' WHEN angle_x_std > 6 AND acc_std < 0.25 AND g > 10 AND g < 60 THEN 'squat_sit' WHEN g >= 15 THEN 'active' ELSE 'unknown' END AS activity
    FROM (SELECT *, gyro_mean / 4 AS g FROM w)""", "samples", tot=_TOT, s=_S, w=_W11))
def j03(t):
    label = posture.angle_activity(F.col("acc_std"), F.col("gyro_mean") / 4, F.col("gyro_max") / 3, F.col("az_mean"), F.col("angle_x_std"), F.col("angle_y_std"))
    return _w11(t).select("recording_id", "k", label.alias("activity"))


_T1 = """CASE WHEN tilt >= 70 THEN CASE WHEN ch <= -0.6 THEN 'supine' WHEN ch >= 0.6 THEN 'prone' WHEN abs(si) >= 0.6 THEN CASE WHEN si > 0 THEN 'right_side' ELSE 'left_side' END ELSE 'horizontal' END
    WHEN tilt >= 35 THEN CASE WHEN ch <= -0.35 THEN 'reclined' WHEN ch >= 0.25 THEN 'bent' WHEN abs(si) >= 0.55 THEN 'leaning' ELSE 'tilted' END
    WHEN tilt >= 20 THEN CASE WHEN per >= 0.58 AND fr BETWEEN 0.2 AND 1.6 THEN 'slight_periodic' ELSE 'slight' END
    WHEN per >= 0.6 AND fr BETWEEN 0.2 AND 1.6 THEN 'squats' WHEN per >= 0.65 AND fr BETWEEN 0.8 AND 2.8 THEN 'upright_periodic' WHEN acc < 0.5 AND gyro < 30 THEN 'upright_still' ELSE 'upright_moving' END"""


@query("j01_tilt_posture", sql(f"""SELECT row_id, rule, {fx('greatest(0.05::DOUBLE, least(0.98::DOUBLE, c * CASE WHEN dr > 25 THEN 0.65::DOUBLE WHEN dr > 15 THEN 0.8::DOUBLE ELSE 1 END))')} AS confidence FROM (
      SELECT row_id, {_T1} AS rule, dr FROM (SELECT *, value / 3 AS tilt, CASE WHEN row_id % 3 <> 0 THEN ay * 2 END AS ch, CASE WHEN row_id % 5 <> 0 THEN ax END AS si, k / 100 AS per, k / 30 AS fr, CASE WHEN row_id % 7 <> 0 THEN gy / 3 END AS dr FROM samples))
    JOIN (VALUES ('supine', 0.92::DOUBLE), ('prone', 0.92), ('right_side', 0.88), ('left_side', 0.88), ('horizontal', 0.68), ('reclined', 0.84), ('bent', 0.84), ('leaning', 0.76), ('tilted', 0.65), ('slight_periodic', 0.68), ('slight', 0.62), ('squats', 0.74), ('upright_periodic', 0.70), ('upright_still', 0.72), ('upright_moving', 0.68)) v(rule, c) USING (rule)""", "samples"))
def j01(t):
    c, r = F.col, F.col("row_id")
    _, conf, rule = posture.tilt_posture(c("value") / 3, F.when(r % 3 != 0, c("ay") * 2), F.when(r % 5 != 0, c("ax")), c("acc") * 0.16, c("gyro") * 0.4, c("k") / 100, c("k") / 30, F.when(r % 7 != 0, c("gy") / 3))
    return b.samples(t).select("row_id", rule.alias("rule"), fix(conf).alias("confidence"))


@query("j04_pseudo_labels", sql("""SELECT recording_id, k, CASE WHEN t >= 70 THEN CASE WHEN acc_std < 0.08 AND g < 15 THEN 'supine' ELSE 'side_lying' END WHEN t >= 35 THEN CASE WHEN acc_std < 0.1 THEN 'incline_lying' ELSE 'bending_forward' END
      WHEN t >= 20 THEN CASE WHEN cyc THEN 'upright_periodic' ELSE 'bending_forward' END WHEN cyc THEN 'upright_periodic' WHEN acc_std < 0.04 AND g < 8 THEN 'standing_like' WHEN p >= 0.5 AND f >= 1.5 THEN 'standing_like' WHEN g > 40 AND vertical_energy > 0.02 THEN 'squatting' ELSE 'standing_like' END AS label
    FROM (SELECT *, tilt_mean - 60 AS t, gyro_mean / 2 AS g, n % 4 / 3 AS p, n % 5 / 2 AS f, n % 4 / 3 >= 0.55 AND n % 5 / 2 BETWEEN 0.2 AND 1.8 AS cyc FROM w)""", "samples", tot=_TOT, s=_S, w=_W12))
def j04(t):
    n = F.col("n")
    label, _ = posture.pseudo_label(F.col("tilt_mean") - 60, F.col("acc_std"), F.col("gyro_mean") / 2, n % 4 / 3, n % 5 / 2, F.col("vertical_energy"))
    return _w12(t).select("recording_id", "k", label.alias("label"))
