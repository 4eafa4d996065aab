"""Frame scoring, key-frame selection and window classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions.mathx import fix
from strideframe.operators import frames as fr
from strideframe.operators import intervals, labels, learn, nearhash, sensor
from strideframe.plans import bindings as b
from strideframe.plans.bindings import DAY, HOUR, fx, sql
from strideframe.plans.registry import query
from strideframe.session import written

K = ["recording_id"]
P = fr.FrameParams(height=100.0, width=200.0)


def _box(x, y, w, h):
    return F.array(x.cast("int"), y.cast("int"), (x + w).cast("int"), (y + h).cast("int"))


def _hash60(text):
    """The first 60 bits of the MD5 digest: the same number in SQL."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _frames(t):
    """Every event as a picture with up to two hands, two machines and one person."""
    k, v, i = F.col("k"), F.floor("value").cast("int"), F.col("row_id")
    det = lambda box, c, lab: F.struct(box.alias("bbox"), c.alias("confidence"), lab.alias("label"))
    hand1 = det(_box(k + 20, F.pmod(v, F.lit(80)), 30, 18), F.lit(0.9), F.lit("hand"))
    hand2 = det(_box(F.lit(170) - k, F.pmod(v + k, F.lit(80)), 24, 20), F.lit(0.8), F.lit("hand"))
    eq1 = det(_box(k + 40, F.pmod(v, F.lit(60)), 40, 30), k / 100, F.col("label"))
    eq2 = det(_box(F.lit(10), F.lit(10), 8, 8), F.lit(0.5), F.lit("rack"))
    person = det(_box(F.lit(0), F.lit(0), k + 60, F.pmod(v, F.lit(90)) + 10), F.lit(0.7), F.lit("person"))
    none = F.array().cast("array<struct<bbox:array<int>,confidence:double,label:string>>")
    return b.samples(t).select(
        "recording_id", i.alias("frame"), F.col("t_rel").alias("t"),
        F.when(i % 7 == 0, none).when(i % 2 == 0, F.array(hand1, hand2)).otherwise(F.array(hand1)).alias("hands"),
        F.when(i % 5 == 0, none).when(i % 3 == 0, F.array(eq1, eq2)).otherwise(F.array(eq1)).alias("equipment"),
        F.when(i % 4 == 0, F.array(person)).otherwise(none).alias("persons"),
        (k / 100).alias("sharpness"), F.least(F.lit(1.0), F.col("value") / 200).alias("motion"), _hash60(F.concat_ws(" ", k % 17, v % 5)).alias("phash"))


def _hand(t):
    return fr.score_hands(_frames(t), K, P)


def _plain_hands(t):
    """Hands scored from their own picture only, before their neighbours lift them."""
    f = _frames(t)
    made = F.transform("hands", lambda h: fr.hand_score(h["bbox"], F.col("equipment"), F.col("persons"), P))
    return f.withColumn("_s", made).withColumn(
        "hands", F.zip_with("hands", "_s", lambda h, s: F.struct(h["bbox"].alias("bbox"), h["confidence"].alias("confidence"), s.alias("score"), (s > P.own_hand).alias("own")))).drop("_s")


def _scored(t):
    return fr.score_frames(fr.score_equipment(_hand(t), K, P), P).withColumn("filter_reason", fr.filter_reason(P))


_FR = """SELECT recording_id, row_id AS frame, t_rel AS t, k, v, label, k / 100 AS sharpness, least(1.0::DOUBLE, value / 200) AS motion,
    CASE WHEN row_id % 7 = 0 THEN [] WHEN row_id % 2 = 0 THEN [[k + 20, v % 80, k + 50, v % 80 + 18], [170 - k, (v + k) % 80, 194 - k, (v + k) % 80 + 20]] ELSE [[k + 20, v % 80, k + 50, v % 80 + 18]] END AS hands,
    CASE WHEN row_id % 5 = 0 THEN [] WHEN row_id % 3 = 0 THEN [{'b': [k + 40, v % 60, k + 80, v % 60 + 30], 'c': k / 100, 'l': label}, {'b': [10, 10, 18, 18], 'c': 0.5::DOUBLE, 'l': 'rack'}] ELSE [{'b': [k + 40, v % 60, k + 80, v % 60 + 30], 'c': k / 100, 'l': label}] END AS eqs,
    CASE WHEN row_id % 4 = 0 THEN [0, 0, k + 60, v % 90 + 10] END AS person FROM (SELECT *, CAST(floor(value) AS INT) AS v FROM samples)"""
_DIST = "sqrt(pow((({a}[1] + {a}[3]) / 2 - ({b}[1] + {b}[3]) / 2), 2) + pow((({a}[2] + {a}[4]) / 2 - ({b}[2] + {b}[4]) / 2), 2))"
_DIAG = "sqrt(50000.0::DOUBLE)"
_HROW = f"""SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.25::DOUBLE * greatest(0, least(1, ((h[2] + h[4]) / 2 / 100 - 0.3::DOUBLE) / 0.5::DOUBLE)) + 0.2::DOUBLE * least(1.0::DOUBLE, (h[3] - h[1]) * (h[4] - h[2]) / 20000 / 0.05::DOUBLE)
      + 0.2::DOUBLE * coalesce(greatest(0, 1 - list_min(list_transform(eqs, lambda e: {_DIST.format(a='h', b='e.b')})) / ({_DIAG} * 0.3::DOUBLE)), 0) + 0.075::DOUBLE
      + 0.1::DOUBLE * CASE WHEN (h[1] + h[3]) / 2 / 200 < 0.1 OR (h[1] + h[3]) / 2 / 200 > 0.9 OR (h[2] + h[4]) / 2 / 100 > 0.9 THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END + 0.05::DOUBLE
      - 0.3::DOUBLE * CASE WHEN person IS NOT NULL AND greatest(0, least(h[3], person[3]) - greatest(h[1], 0)) * greatest(0, least(h[4], person[4]) - greatest(h[2], 0)) / ((h[3] - h[1]) * (h[4] - h[2])) >= 0.5 THEN 1 ELSE 0 END)) AS score
    FROM (SELECT *, unnest(hands) AS h, generate_subscripts(hands, 1) AS i FROM fr)"""


_BOOST = f"""WITH RECURSIVE q AS MATERIALIZED (SELECT recording_id, frame, row_number() OVER w AS pos, count(*) OVER (PARTITION BY recording_id) AS n, hs, own, coalesce(lead(own) OVER w, []) AS nxt FROM (
      SELECT f.recording_id, f.frame, coalesce(p.hs, []) AS hs, list_transform(list_filter(coalesce(p.hs, []), lambda x: x.s > 0.55), lambda x: x.h) AS own FROM fr f LEFT JOIN (SELECT recording_id, frame, list({{'h': h, 's': score}} ORDER BY i) AS hs FROM hr0 GROUP BY ALL) p USING (recording_id, frame))
      WINDOW w AS (PARTITION BY recording_id ORDER BY frame)),
    r AS (SELECT recording_id, frame, pos, hs, own FROM q WHERE pos = 1 UNION ALL SELECT recording_id, frame, pos, hs, list_transform(list_filter(hs, lambda x: x.s > 0.55), lambda x: x.h) FROM (
      SELECT q.recording_id, q.frame, q.pos, list_transform(q.hs, lambda x: {{'h': x.h, 's': CASE WHEN q.pos < q.n AND x.s <= 0.55 AND len(list_filter(list_concat(r.own, q.nxt), lambda e: {_DIST.format(a='x.h', b='e')} < 20)) > 0 THEN least(1.0::DOUBLE, x.s + 0.15::DOUBLE) ELSE x.s END}}) AS hs
      FROM r JOIN q ON q.recording_id = r.recording_id AND q.pos = r.pos + 1)) SELECT * FROM r"""
_HR = "SELECT f.*, x.h AS h, x.s AS score, i FROM fr f JOIN (SELECT recording_id, frame, unnest(hs) AS x, generate_subscripts(hs, 1) AS i FROM boost) USING (recording_id, frame)"
_HANDS = dict(fr=_FR, hr0=_HROW, boost=_BOOST, hr=_HR)


@query("o01_hand_scores", sql(f"SELECT recording_id, frame, i - 1 AS i, {fx('score')} AS score, score > 0.55 AS own FROM hr", "samples", **_HANDS))
def o01(t):
    rows = _hand(t).select("recording_id", "frame", F.posexplode_outer("hands").alias("i", "h")).filter(F.col("h").isNotNull())
    return rows.select("recording_id", "frame", F.col("i").cast("long").alias("i"), fix(F.col("h.score")).alias("score"), "h.own")


@query("o01_single_frame_scores", sql(f"SELECT recording_id, frame, count(*) AS hands, {fx('max(score)')} AS best, count(*) FILTER (score > 0.55) AS own FROM hr GROUP BY ALL", "samples", fr=_FR, hr=_HROW))
def o01b(t):
    h = _plain_hands(t).select("recording_id", "frame", F.explode_outer("hands").alias("h")).filter(F.col("h").isNotNull())
    return h.groupBy("recording_id", "frame").agg(F.count(F.lit(1)).alias("hands"), fix(F.max("h.score")).alias("best"), F.count_if(F.col("h.own")).alias("own"))


_OWN = "SELECT f.*, coalesce(o.own, []) AS own, coalesce(o.hs, 0) AS hand_score FROM fr f LEFT JOIN (SELECT recording_id, frame, list(h ORDER BY i) AS own, max(score) AS hs FROM hr WHERE score > 0.55 GROUP BY ALL) o USING (recording_id, frame)"
_EROW = f"""SELECT recording_id, frame, e, least(1.0::DOUBLE, base + least(0.15::DOUBLE, n / total * 0.2::DOUBLE)) AS score FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.3::DOUBLE * e.c
      + 0.25::DOUBLE * coalesce(greatest(0, 1 - list_min(list_transform(own, lambda h: {_DIST.format(a='e.b', b='h')})) / ({_DIAG} * 0.25::DOUBLE)), 0) + 0.1::DOUBLE + 0.075::DOUBLE
      + 0.1::DOUBLE * greatest(0, 1 - (abs((e.b[1] + e.b[3]) / 2 / 200 - 0.5::DOUBLE) * 2 + abs((e.b[2] + e.b[4]) / 2 / 100 - 0.5::DOUBLE) * 2) / 2)
      - 0.2::DOUBLE * CASE WHEN area < 0.02 THEN greatest(0, 1 - area / 0.02::DOUBLE) ELSE 0 END)) AS base
    FROM (SELECT *, (e.b[3] - e.b[1]) * (e.b[4] - e.b[2]) / 20000 AS area, count(*) OVER (PARTITION BY recording_id, e.l) AS n FROM (SELECT *, unnest(eqs) AS e FROM own))
    JOIN (SELECT recording_id, count(*) AS total FROM fr GROUP BY ALL) USING (recording_id))"""


@query("o02_equipment_scores", sql(f"SELECT recording_id, frame, e.l AS label, {fx('score')} AS score, score > 0.55 AS active FROM er", "samples", **_HANDS, own=_OWN, er=_EROW))
def o02(t):
    e = fr.score_equipment(_hand(t), K, P).select("recording_id", "frame", F.explode_outer("equipment").alias("e")).filter(F.col("e").isNotNull())
    return e.select("recording_id", "frame", "e.label", fix(F.col("e.score")).alias("score"), "e.active")


_INT = f"""SELECT o.*, coalesce(a.act, []) AS act, coalesce(a.es, 0) AS equipment_score, coalesce(a.idle, 0) AS idle, CASE WHEN person IS NULL THEN 0 ELSE person[3] * person[4] / 20000 END AS person_area FROM own o
    LEFT JOIN (SELECT recording_id, frame, list(e.b) FILTER (score > 0.55) AS act, max(score) FILTER (score > 0.55) AS es, avg(CASE WHEN score > 0.55 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS idle FROM er GROUP BY ALL) a USING (recording_id, frame)"""
_INT2 = f"""SELECT *, CASE WHEN len(own) = 0 OR len(act) = 0 THEN 0 WHEN list_max(ious) > 0.01 THEN 1 ELSE greatest(0, 1 - list_min(gaps) / ({_DIAG} * 0.2::DOUBLE)) END AS interaction FROM (SELECT *,
      flatten(list_transform(own, lambda h: list_transform(act, lambda e: {_DIST.format(a='h', b='e')}))) AS gaps,
      flatten(list_transform(own, lambda h: list_transform(act, lambda e: greatest(0, least(h[3], e[3]) - greatest(h[1], e[1])) * greatest(0, least(h[4], e[4]) - greatest(h[2], e[2])) / ((h[3] - h[1]) * (h[4] - h[2]) + (e[3] - e[1]) * (e[4] - e[2]) - greatest(0, least(h[3], e[3]) - greatest(h[1], e[1])) * greatest(0, least(h[4], e[4]) - greatest(h[2], e[2])))))) AS ious FROM i1)"""
_INFO = """SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, hand_score * 0.3::DOUBLE + equipment_score * 0.25::DOUBLE + interaction * 0.2::DOUBLE + motion * 0.1::DOUBLE + sharpness * 0.1::DOUBLE + 0.025::DOUBLE - pn * 0.25::DOUBLE - bn * 0.15::DOUBLE)) AS info_score,
      CASE WHEN person_area > 0.45 AND hand_score < 0.2 THEN 'person_dominant_hard' WHEN person_area > 0.25 AND hand_score < 0.3 AND equipment_score < 0.3 THEN 'person_dominant_soft' WHEN person_area > 0.25 AND hand_score < 0.1 AND equipment_score < 0.1 THEN 'coach_demo' WHEN sharpness < 0.15 THEN 'blur' END AS filter_reason
    FROM (SELECT *, CASE WHEN hand_score > 0.5 THEN person_area * 0.3::DOUBLE ELSE person_area END AS pn, CASE WHEN equipment_score > 0.5 THEN idle * 0.3::DOUBLE ELSE idle END AS bn FROM i2)"""
_ALL = _HANDS | dict(own=_OWN, er=_EROW, i1=_INT, i2=_INT2, info=_INFO)


@query("o03_filter_reasons", sql("SELECT recording_id, frame, filter_reason FROM info", "samples", **_ALL))
def o03(t):
    return _scored(t).select("recording_id", "frame", "filter_reason")


@query("o04_interaction", sql(f"SELECT recording_id, frame, {fx('interaction')} AS interaction FROM info", "samples", **_ALL))
def o04(t):
    return _scored(t).select("recording_id", "frame", fix(F.col("interaction")).alias("interaction"))


@query("o05_frame_scores", sql(f"SELECT recording_id, frame, {fx('info_score')} AS info_score FROM info", "samples", **_ALL))
def o05(t):
    return _scored(t).select("recording_id", "frame", fix(F.col("info_score")).alias("info_score"))


@query("o06_segment_summary", sql(f"""SELECT recording_id, count(*) AS frames, {fx('avg(CASE WHEN hand_score > 0.3 THEN 1.0::DOUBLE ELSE 0 END)')} AS hand_visible, {fx('avg(CASE WHEN len(own) >= 2 THEN 1.0::DOUBLE ELSE 0 END)')} AS both_visible, {fx('avg(hand_score)')} AS mean_hand_score,
      count(*) FILTER (filter_reason LIKE '%person%') AS person_removed, count(*) FILTER (bn > 0.5) AS background_downweighted, CASE WHEN count(y) = 0 THEN 'unknown' WHEN max(y) - min(y) > 50 THEN 'vertical' ELSE 'horizontal' END AS motion_axis
    FROM (SELECT *, CASE WHEN len(own) > 0 THEN list_avg(list_transform(own, lambda h: (h[2] + h[4]) / 2)) END AS y FROM info) GROUP BY ALL""", "samples", **_ALL))
def o06(t):
    out = fr.summarize(_scored(t), K).drop("low_visibility")
    return out.withColumns({c: fix(F.col(c)) for c in ("hand_visible", "both_visible", "mean_hand_score")})


@query("o06_equipment_summary", sql(f"SELECT recording_id, e.l AS label, {fx('avg(score)')} AS mean_score, bool_or(score > 0.55) AS active, {fx('count(*) / any_value(total)')} AS visible_share FROM er JOIN (SELECT recording_id, count(*) AS total FROM fr GROUP BY ALL) USING (recording_id) GROUP BY ALL", "samples", **_ALL))
def o06b(t):
    out = fr.equipment_summary(_scored(t), K)
    return out.withColumns({c: fix(F.col(c)) for c in ("mean_score", "visible_share")})


_METRICS = ["hand_y", "equipment_y", "hand_distance"]


def _useful(t):
    """Scored frames that no filter drops; scores are fixed, so that both engines order them alike."""
    rows = fr.endpoint_metrics(_scored(t))
    rows = rows.select("recording_id", "frame", "t", "phash", "filter_reason", *[fix(F.col(c)).alias(c) for c in ("info_score", *_METRICS)])
    # written before the filter, which would be pushed below the scores and compute them once more, and read by every step after it
    return written(rows).filter("filter_reason IS NULL")


_USE = f"""SELECT recording_id, frame, t, {fx('info_score')} AS info_score, CAST('0x' || substring(md5(concat_ws(' ', k % 17, v % 5)), 1, 15) AS BIGINT) AS phash,
      {fx('CASE WHEN len(own) > 0 THEN list_avg(list_transform(own, lambda h: (h[2] + h[4]) / 2)) END')} AS hand_y, {fx('CASE WHEN len(act) > 0 THEN list_avg(list_transform(act, lambda h: (h[2] + h[4]) / 2)) END')} AS equipment_y,
      {fx(f"CASE WHEN len(own) > 1 THEN {_DIST.format(a='own[1]', b='own[2]')} END")} AS hand_distance FROM info WHERE filter_reason IS NULL"""
_TOP = "SELECT recording_id, frame, t, phash FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, floor((t - t0) / {0}::DOUBLE) ORDER BY info_score DESC, t, frame) AS rn FROM (SELECT *, min(t) OVER (PARTITION BY recording_id) AS t0 FROM useful)) WHERE rn <= 2"


@query("f06_window_top_k", sql("SELECT recording_id, frame FROM top", "samples", **_ALL, useful=_USE, top=_TOP.format(DAY)))
def f06(t):
    return fr.window_top(_useful(t), K, DAY, 2).select("recording_id", "frame")


_ENDS = " UNION ALL ".join(
    f"SELECT recording_id, frame, '{m}_{end}' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY {m} {way}, t, frame) AS rn FROM useful WHERE {m} IS NOT NULL) WHERE rn = 1" for m in _METRICS for end, way in (("max", "DESC"), ("min", "ASC"))
)


@query("f07_extremes", sql(_ENDS, "samples", **_ALL, useful=_USE))
def f07(t):
    return fr.extremes(_useful(t), K, _METRICS)


@query("f08_anchor_frames", sql("""SELECT recording_id, frame, 'anchor_' || CAST(round(p * 100) AS INT) || '%' AS reason FROM (SELECT s.recording_id, s.frame, p, row_number() OVER (PARTITION BY s.recording_id, p ORDER BY abs(s.t - (z.a + (z.b - z.a) * p)), s.t, s.frame) AS rn
    FROM useful s JOIN (SELECT recording_id, min(t) AS a, max(t) AS b FROM useful GROUP BY ALL) z USING (recording_id), (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) v(p)) WHERE rn = 1""", "samples", **_ALL, useful=_USE))
def f08(t):
    return fr.anchors(_useful(t), K)


_GREEDY = f"""WITH RECURSIVE q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t, frame) AS pos FROM top),
    r AS (SELECT recording_id, pos, frame, true AS good, [{{'t': t, 'h': phash}}] AS kept FROM q WHERE pos = 1 UNION ALL SELECT recording_id, pos, frame, good, CASE WHEN good THEN list_append(kept, me) ELSE kept END FROM (
      SELECT q.recording_id, q.pos, q.frame, r.kept, {{'t': q.t, 'h': q.phash}} AS me, len(list_filter(r.kept, lambda x: abs(x.t - q.t) < {HOUR} OR bit_count(xor(x.h, q.phash)) < 6)) = 0 AS good FROM r JOIN q ON q.recording_id = r.recording_id AND q.pos = r.pos + 1))
    SELECT recording_id, frame FROM r WHERE good"""


@query("f10_near_duplicates", sql("SELECT recording_id, frame FROM greedy", "samples", **_ALL, useful=_USE, top=_TOP.format(6 * HOUR), greedy=_GREEDY))
def f10(t):
    chosen = fr.window_top(_useful(t), K, 6 * HOUR, 2)
    return fr.drop_near_duplicates(chosen.select("recording_id", "frame", "t", "phash"), K, HOUR, 6).select("recording_id", "frame")


# Hashes near each other: one of the pictures' hashes with one bit turned.
_NEAR = "SELECT row_id AS frame, xor(CAST('0x' || substring(md5(concat_ws(' ', k % 17, CAST(floor(value) AS INT) % 5)), 1, 15) AS BIGINT), CAST(1 AS BIGINT) << CAST(row_id % 61 AS INT)) AS phash FROM samples"


@query("f10_corpus_duplicates", sql("SELECT frame, coalesce(m, phash) AS group_hash, count(*) OVER (PARTITION BY coalesce(m, phash)) AS copies FROM near LEFT JOIN least_hash ON phash = a", "samples", near=_NEAR, h="SELECT DISTINCT phash AS h FROM near",
    link="SELECT x.h AS a, y.h AS b FROM h x JOIN h y ON bit_count(xor(x.h, y.h)) < 6", closed="SELECT a, b FROM link UNION SELECT c.a, l.b FROM closed c JOIN link l ON l.a = c.b", least_hash="SELECT a, min(b) AS m FROM closed GROUP BY a").replace("WITH ", "WITH RECURSIVE ", 1))
def f10b(t):
    k, v, i = F.col("k"), F.floor("value").cast("int"), F.col("row_id")
    turned = F.call_function("shiftleft", F.lit(1).cast("long"), (i % 61).cast("int"))
    frames = b.samples(t).select(i.alias("frame"), _hash60(F.concat_ws(" ", k % 17, v % 5)).bitwiseXOR(turned).alias("phash"))
    return nearhash.duplicate_groups(frames, "phash", 6).drop("phash")


_SPOTS = """SELECT recording_id, frame, 'anchor_' || CAST(round(p * 100) AS INT) || '%' AS reason FROM (SELECT s.recording_id, s.frame, p, row_number() OVER (PARTITION BY s.recording_id, p ORDER BY abs(s.t - (z.a + (z.b - z.a) * p)), s.t, s.frame) AS rn
    FROM useful s JOIN (SELECT recording_id, min(t) AS a, max(t) AS b FROM useful GROUP BY ALL) z USING (recording_id), (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) v(p)) WHERE rn = 1"""
_KEYED = dict(
    top=_TOP.format(DAY), ends=_ENDS, spots=_SPOTS,
    every_one="SELECT recording_id, frame, 'window_topk' AS reason, 0 AS src FROM top UNION ALL SELECT *, 1 FROM ends UNION ALL SELECT *, 2 FROM spots",
    named="SELECT recording_id, frame, reason FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, frame ORDER BY src DESC, reason DESC) AS rn FROM every_one) WHERE rn = 1",
    chosen="SELECT u.*, reason FROM useful u JOIN named USING (recording_id, frame)", greedy=_GREEDY.replace("FROM top", "FROM chosen"),
    best="SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY recording_id ORDER BY info_score DESC, t, frame) AS rn FROM chosen c JOIN greedy USING (recording_id, frame)) WHERE rn <= 36",
    rest="SELECT u.*, row_number() OVER (PARTITION BY recording_id ORDER BY info_score DESC, t, frame) AS rn FROM useful u ANTI JOIN best USING (recording_id, frame)",
)


@query("o12_key_frames", sql("""SELECT recording_id, frame, t, info_score, reason FROM best UNION ALL
    SELECT recording_id, frame, t, info_score, 'fill' FROM rest JOIN (SELECT recording_id, count(*) AS have FROM best GROUP BY ALL) USING (recording_id) WHERE rn <= 12 - have""", "samples", **_ALL, useful=_USE, **_KEYED))
def o12(t):
    return fr.assemble(_useful(t), K, _METRICS, size=DAY, min_gap=HOUR)


_FEATS = ["tilt_mean", "tilt_std", "tilt_range", "drift_mean", "turn", "acc_mean", "acc_std", "gyro_mean", "gyro_std", "vertical_energy", "dominant_freq", "periodic_score", "peak_count"]


def _windows(t):
    totals = b.samples(t).groupBy("recording_id").agg(F.max("t_rel").alias("total_sec")).withColumn("fs", F.lit(10.0))
    s = b.samples(t).drop("k", "ts", "label", "value")
    w = sensor.window_features(s, K, "t_rel", "row_id", totals, 3 * DAY, DAY, frequency=True)
    return w.withColumns({"ws": F.col("k") * DAY, "we": F.col("k") * DAY + 3 * DAY})


def _dataset(t, windows=None):
    truth = b.truth(t).select("recording_id", "gt_id", "gt_start", "gt_end", "gt_action")
    return intervals.label_by_overlap(windows or _windows(t), truth, K, ("ws", "we"), ("gt_start", "gt_end"), "gt_action", "gt_id", DAY, window_keys=["k"], threshold=0.1, out="label")


@query("o11_labelled_windows")
def o11(t):
    return _dataset(t).select("recording_id", "k", "label", *_FEATS)


def _vectors(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.col("label").cast("string").alias("label"), *[e[i].cast("double").alias(f"x{i}") for i in range(64)])


_X = [f"x{i}" for i in range(64)]


@query("o08_stratified_folds")
def o08(t):
    return learn.stratified_folds(_vectors(t).select("vec_id", "label"), "label", ["vec_id"], 5)


@query("o07_forest_predictions")
def o07(t):
    return learn.out_of_fold(_vectors(t), _X, "label", ["vec_id"]).select("vec_id", "label", "fold", "predicted", "confidence")


@query("o09_scored_segments")
def o09(t):
    windows = written(_windows(t))  # a forest reads its rows dozens of times
    rows = written(_dataset(t, windows).select("label", *_FEATS))
    model = learn.train(rows, _FEATS, "label", learn.forest())
    scored = learn.score(model, windows, _FEATS).select("recording_id", "k", "ws", "we", "predicted")
    smooth = labels.smooth_mode(scored, K, ["ws"], "predicted", 2, "posture", width=DAY)
    return labels.chained_segments(smooth, K, ["ws"], "posture", "ws", "we", 1.0, width=DAY)


@query("o10_model_comparison")
def o10(t):
    models = {"forest": learn.forest(), "boosted": learn.boosted()}
    return learn.compare(_vectors(t), _X, "label", ["vec_id"], models)
