"""Evaluation of recognition versions against ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions.mathx import fix
from strideframe.operators import evaluation as ev
from strideframe.operators.ranges import scan_rows
from strideframe.plans import bindings as b
from strideframe.plans.bindings import DAY, fx, sql
from strideframe.plans.registry import query

_W = DAY / 2


@query("k01_action_names", """SELECT name, coalesce(a.c, x.c, bare) AS action FROM (SELECT DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN '（v' || p_partkey % 3 || '）' ELSE '' END AS name, p_name AS bare FROM part)
    LEFT JOIN (VALUES ('red bolt', 'bolt'), ('small ring（v0）', 'mini ring'), ('hot gear', 'gear')) a(k, c) ON a.k = name LEFT JOIN (VALUES ('red bolt', 'bolt'), ('small ring（v0）', 'mini ring'), ('hot gear', 'gear')) x(k, c) ON x.k = bare""")
def k01(t):
    aliases = t.spark.createDataFrame([("red bolt", "bolt"), ("small ring（v0）", "mini ring"), ("hot gear", "gear")], "alias string, canonical string")
    tag = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("（v"), (F.col("p_partkey") % 3).cast("string"), F.lit("）"))).otherwise("")
    return ev.normalize_actions(t.part.select(F.concat("p_name", tag).alias("name")).distinct(), "name", aliases)


def _coarse(t):
    """Every prediction; rare actions share one name, so that neighbours meet."""
    return b.predictions(t).withColumn("pred_action", F.when(F.col("pred_action").isin("view", "click"), F.col("pred_action")).otherwise("rest"))


_COARSE = "SELECT * REPLACE (CASE WHEN pred_action IN ('view', 'click') THEN pred_action ELSE 'rest' END AS pred_action) FROM predictions"
_MERGE = f"""SELECT version, recording_id, arg_min(pred_id, (pred_start, pred_id)) AS pred_id, min(pred_start) AS pred_start, max(pred_end) AS pred_end, any_value(pred_action) AS pred_action, CAST(sum(pred_sets) AS BIGINT) AS pred_sets, CAST(sum(pred_reps) AS BIGINT) AS pred_reps FROM (
      SELECT *, sum(o) OVER (PARTITION BY version, recording_id, run ORDER BY pred_start, pred_id) AS part FROM (
        SELECT *, CASE WHEN pred_start - max(pred_end) OVER (PARTITION BY version, recording_id, run ORDER BY pred_start, pred_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {DAY} THEN 0 ELSE 1 END AS o FROM (
          SELECT *, sum(c) OVER (PARTITION BY version, recording_id ORDER BY pred_start, pred_id) AS run FROM (SELECT *, CASE WHEN pred_action = lag(pred_action) OVER (PARTITION BY version, recording_id ORDER BY pred_start, pred_id) THEN 0 ELSE 1 END AS c FROM sp))))
    GROUP BY version, recording_id, run, part"""


@query("k02_merge_predictions", sql(_MERGE, "predictions", sp=_COARSE))
def k02(t):
    return ev.merge_predictions(_coarse(t), DAY)


_PAIRS = """SELECT *, CASE WHEN u <= 0 THEN 0 ELSE overlap / u END AS iou, CASE WHEN g <= 0 THEN 0 ELSE overlap / g END AS coverage, overlap / p AS purity FROM (SELECT *, p + g - overlap AS u FROM (
      SELECT version, t.recording_id, gt_id, pred_id, least(pred_end, gt_end) - greatest(pred_start, gt_start) AS overlap, pred_end - pred_start AS p, gt_end - gt_start AS g
      FROM truth t JOIN predictions p ON p.recording_id = t.recording_id AND p.pred_start < t.gt_end AND p.pred_end > t.gt_start))"""


@query("k03_overlap_measures", sql(f"SELECT version, recording_id, gt_id, pred_id, {fx('overlap', 4)} AS overlap, {fx('iou')} AS iou, {fx('coverage')} AS coverage, {fx('purity')} AS purity FROM ({_PAIRS})", "truth", "predictions"))
def k03(t):
    from strideframe.operators.intervals import overlap_join

    pairs = overlap_join(b.predictions(t), b.truth(t), ["recording_id"], ("pred_start", "pred_end"), ("gt_start", "gt_end"), _W)
    out = ev.overlap_measures(pairs).select("version", "recording_id", "gt_id", "pred_id", "overlap", "iou", "coverage", "purity")
    return out.withColumns({"overlap": fix(F.col("overlap"), 4), **{c: fix(F.col(c)) for c in ("iou", "coverage", "purity")}})


@query("c08_match_candidates", sql(f"SELECT version, recording_id, gt_id, pred_id FROM ({_PAIRS}) WHERE iou >= 0.3 OR coverage >= 0.5", "truth", "predictions"))
def c08(t):
    return ev.candidates(b.truth(t), b.predictions(t), _W).select("version", "recording_id", "gt_id", "pred_id")


def _inputs(t):
    """Truth and predictions are read many times below, so the runs behind them are written once."""
    b.settle_runs(t)
    return b.truth(t), b.predictions(t)


def _judged(t):
    truth, pred = _inputs(t)
    matched = ev.match_greedy(ev.candidates(truth, pred, _W))
    return ev.verdicts(matched, truth, pred), truth, pred


# The greedy order as a recursion: one accepted pair per step and (version, recording).
_GREEDY = """WITH RECURSIVE {ctes}, cand AS MATERIALIZED (SELECT version, recording_id, gt_id, pred_id, iou, row_number() OVER (PARTITION BY version, recording_id ORDER BY iou DESC, gt_id, pred_id) AS rk FROM ({pairs}) WHERE iou >= 0.3 OR coverage >= 0.5),
    step AS (SELECT version, recording_id, rk, gt_id, pred_id, iou, [gt_id] AS gs, [pred_id] AS ps FROM cand WHERE rk = 1
      UNION ALL SELECT version, recording_id, rk, gt_id, pred_id, iou, gs, ps FROM (
        SELECT c.version, c.recording_id, c.rk, c.gt_id, c.pred_id, c.iou, list_append(s.gs, c.gt_id) AS gs, list_append(s.ps, c.pred_id) AS ps, row_number() OVER (PARTITION BY c.version, c.recording_id ORDER BY c.rk) AS rn
        FROM step s JOIN cand c ON c.version = s.version AND c.recording_id = s.recording_id AND c.rk > s.rk AND NOT list_contains(s.gs, c.gt_id) AND NOT list_contains(s.ps, c.pred_id)) WHERE rn = 1),
    matched AS MATERIALIZED (SELECT version, recording_id, gt_id, pred_id, iou FROM step)"""
_JUDGED = """SELECT m.*, gt_action, pred_action, gt_sets, pred_sets, gt_reps, pred_reps, gt_action = pred_action AS action_ok, gt_sets = pred_sets AS set_ok, abs(pred_reps - gt_reps) <= 1 AS rep_ok FROM matched m JOIN truth USING (recording_id, gt_id) JOIN predictions USING (version, recording_id, pred_id)"""
_DETAILS = """SELECT version, recording_id, gt_id, pred_id, gt_action, pred_action, gt_sets, pred_sets, gt_reps, pred_reps, iou, action_ok, set_ok, rep_ok, set_ok AND rep_ok AS count_ok, action_ok AND set_ok AND rep_ok AS joint_ok,
      CASE WHEN action_ok AND set_ok AND rep_ok THEN 'fully_correct' WHEN NOT action_ok THEN 'wrong_action' WHEN NOT set_ok THEN 'set_error' ELSE 'rep_error' END AS error_type FROM judged
    UNION ALL SELECT v.version, t.recording_id, gt_id, NULL, gt_action, NULL, gt_sets, NULL, gt_reps, NULL, 0, false, false, false, false, false, 'missed_action' FROM truth t JOIN (SELECT DISTINCT version, recording_id FROM predictions) v USING (recording_id)
      WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.version = v.version AND m.recording_id = t.recording_id AND m.gt_id = t.gt_id)
    UNION ALL SELECT p.version, p.recording_id, NULL, pred_id, NULL, pred_action, NULL, pred_sets, NULL, pred_reps, 0, false, false, false, false, false, 'extra_action' FROM predictions p
      WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.version = p.version AND m.recording_id = p.recording_id AND m.pred_id = p.pred_id)"""
_COUNTS = """SELECT version, recording_id, count(*) FILTER (action_ok) AS action_tp, count(*) FILTER (pred_id IS NOT NULL AND NOT action_ok) AS action_fp, count(*) FILTER (gt_id IS NOT NULL AND NOT action_ok) AS action_fn,
      count(*) FILTER (joint_ok) AS joint_tp, count(*) FILTER (pred_id IS NOT NULL AND NOT joint_ok) AS joint_fp, count(*) FILTER (gt_id IS NOT NULL AND NOT joint_ok) AS joint_fn,
      count(*) FILTER (rep_ok) AS rep_ok_count, count(*) FILTER (set_ok) AS set_ok_count, count(*) FILTER (count_ok) AS count_ok_count, count(gt_id) AS gt_count, count(pred_id) AS pred_count, count(*) FILTER (gt_id IS NOT NULL AND pred_id IS NOT NULL) AS matched,
      CAST(coalesce(sum(gt_reps), 0) AS BIGINT) AS gt_reps, CAST(coalesce(sum(pred_reps), 0) AS BIGINT) AS pred_reps, CAST(coalesce(sum(abs(pred_reps - gt_reps)), 0) AS BIGINT) AS rep_error FROM details GROUP BY ALL"""
_NUM = "action_tp action_fp action_fn joint_tp joint_fp joint_fn rep_ok_count set_ok_count count_ok_count gt_count pred_count matched gt_reps pred_reps rep_error".split()


def _chain(body: str, *more: str) -> str:
    text = sql("", "truth", "predictions")
    ctes = text[len("WITH "):].rstrip()
    return ", ".join([_GREEDY.format(ctes=ctes, pairs=_PAIRS), *more]) + " " + body


_D = (f"judged AS MATERIALIZED ({_JUDGED})", f"details AS MATERIALIZED ({_DETAILS})")
_C = (*_D, f"counts AS ({_COUNTS})")


@query("k04_greedy_matching", _chain(f"SELECT version, recording_id, gt_id, pred_id, {fx('iou')} AS iou FROM matched"))
def k04(t):
    truth, pred = _inputs(t)
    return ev.match_greedy(ev.candidates(truth, pred, _W)).withColumn("iou", fix(F.col("iou")))


@query("k05_pair_verdicts", _chain("SELECT version, recording_id, gt_id, pred_id, action_ok, set_ok, rep_ok, joint_ok, error_type FROM details WHERE gt_id IS NOT NULL AND pred_id IS NOT NULL", *_D))
def k05(t):
    return _judged(t)[0].select("version", "recording_id", "gt_id", "pred_id", "action_ok", "set_ok", "rep_ok", "joint_ok", "error_type")


def _details(t):
    judged, truth, pred = _judged(t)
    return ev.detail_rows(judged, truth, pred)


@query("c12_unmatched_events", _chain("SELECT version, recording_id, gt_id, pred_id, error_type FROM details WHERE error_type IN ('missed_action', 'extra_action')", *_D))
def c12(t):
    return _details(t).filter(F.col("error_type").isin("missed_action", "extra_action")).select("version", "recording_id", "gt_id", "pred_id", "error_type")


@query("k06_confusion_counts", _chain("SELECT * FROM counts", *_C))
def k06(t):
    return ev.counts(_details(t))


_SC = ("action_precision", "action_recall", "action_f1", "joint_f1", "set_acc", "rep_acc", "rep_mae")
_R = "CASE WHEN {d} = 0 THEN 0 ELSE CAST({n} AS DOUBLE) / {d} END"
_SCORES = ", ".join(
    _R.format(n=n, d=d) + f" AS {name}"
    for name, n, d in (
        ("action_precision", "action_tp", "(action_tp + action_fp)"), ("action_recall", "action_tp", "(action_tp + action_fn)"), ("action_f1", "action_tp * 2", "(action_tp * 2 + action_fp + action_fn)"),
        ("joint_f1", "joint_tp * 2", "(joint_tp * 2 + joint_fp + joint_fn)"), ("set_acc", "set_ok_count", "gt_count"), ("rep_acc", "rep_ok_count", "gt_count"), ("rep_mae", "rep_error", "matched"),
    )
)
_V = (*_C, f"rec AS (SELECT *, {_SCORES} FROM counts)", f"ver AS (SELECT *, {_SCORES} FROM (SELECT version, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _NUM)} FROM counts GROUP BY ALL))")


@query("k07_version_scores", _chain(f"""SELECT v.version, v.action_tp, v.action_fp, v.action_fn, {', '.join(f'{fx("v." + c)} AS {c}' for c in _SC)}, {fx('m.a')} AS macro_action_f1, {fx('m.j')} AS macro_joint_f1, {fx('m.r')} AS macro_rep_acc
    FROM ver v JOIN (SELECT version, avg(action_f1) AS a, avg(joint_f1) AS j, avg(rep_acc) AS r FROM rec WHERE gt_count > 0 GROUP BY ALL) m USING (version)""", *_V))
def k07(t):
    s = ev.scores(ev.counts(_details(t))).filter("level = 1")
    names = [*_SC, "macro_action_f1", "macro_joint_f1", "macro_rep_acc"]
    return s.select("version", "action_tp", "action_fp", "action_fn", *[fix(F.col(c)).alias(c) for c in names])


@query("k08_count_errors", _chain(f"SELECT version, recording_id, rep_error, {fx('rep_mae')} AS rep_mae, {fx('set_acc')} AS set_acc, {fx('joint_f1')} AS joint_f1 FROM rec", *_V))
def k08(t):
    s = ev.scores(ev.counts(_details(t))).filter("level = 0")
    return s.select("version", "recording_id", "rep_error", *[fix(F.col(c)).alias(c) for c in ("rep_mae", "set_acc", "joint_f1")])


@query("k09_version_comparison", _chain(f"""SELECT version, {fx('action_f1')} AS action_f1, {fx('joint_f1')} AS joint_f1, gt_count, pred_count, {fx('CASE WHEN gt_reps = 0 THEN 0 ELSE CAST((pred_reps - gt_reps) * 100 AS DOUBLE) / gt_reps END')} AS rep_deviation_pct,
      {fx('CASE WHEN gt_count = 0 THEN 0 ELSE CAST((pred_count - gt_count) * 100 AS DOUBLE) / gt_count END')} AS action_deviation_pct FROM ver""", *_V))
def k09(t):
    out = ev.compare_versions(ev.scores(ev.counts(_details(t))))
    return out.withColumns({c: fix(F.col(c)) for c in ("action_f1", "joint_f1", "rep_deviation_pct", "action_deviation_pct")})


@query("k10_detail_rows", _chain(f"SELECT * REPLACE ({fx('iou')} AS iou) FROM details", *_D))
def k10(t):
    return _details(t).withColumn("iou", fix(F.col("iou")))


def _guess(t):
    return b.samples(t).withColumn("guess", F.when(F.col("value") > 80, "view").when(F.col("k") > 60, "click").when(F.col("k") > 30, "error").otherwise("signup"))


_GUESS = "SELECT *, CASE WHEN value > 80 THEN 'view' WHEN k > 60 THEN 'click' WHEN k > 30 THEN 'error' ELSE 'signup' END AS guess FROM samples"


@query("k11_class_report", sql(f"""SELECT c AS class, s AS support, {fx('CASE WHEN p = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / p END')} AS precision, {fx('CASE WHEN s = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / s END')} AS recall, {fx('CASE WHEN s + p = 0 THEN 0 ELSE CAST(tp * 2 AS DOUBLE) / (s + p) END')} AS f1 FROM (
      SELECT c, count(*) FILTER (c = label) AS s, count(*) FILTER (c = guess) AS p, count(*) FILTER (c = label AND c = guess) AS tp FROM g, (SELECT DISTINCT label AS c FROM g UNION SELECT DISTINCT guess FROM g) GROUP BY ALL)""", "samples", g=_GUESS))
def k11(t):
    out = ev.class_report(_guess(t), "label", "guess")
    return out.withColumns({c: fix(F.col(c)) for c in ("precision", "recall", "f1")})


@query("k11_confusion_matrix", sql("SELECT label, guess, count(*) AS n FROM g GROUP BY ALL", "samples", g=_GUESS))
def k11b(t):
    return ev.confusion(_guess(t), "label", "guess")


@query("k12_drift_check", sql(f"""SELECT row_id, {fx('z', 5)} AS z, abs(z) > 2 AS out_of_range FROM (SELECT s.row_id, (s.value - m) / (sd + 1e-8) AS z FROM samples s LEFT JOIN (SELECT label, avg(value) AS m, stddev_samp(value) AS sd FROM samples WHERE recording_id % 2 = 0 GROUP BY ALL) USING (label))""", "samples"))
def k12(t):
    s = b.samples(t).select("recording_id", "row_id", "label", "value")
    out = ev.drift(s, s.filter("recording_id % 2 = 0"), "label", "value")
    return out.select("row_id", fix(F.col("z"), 5).alias("z"), "out_of_range")


@query("k13_side_by_side", sql("""SELECT coalesce(a.version, z.version) AS version, coalesce(a.recording_id, z.recording_id) AS recording_id, coalesce(a.pos, z.pos) AS pos, a.gt_id, z.pred_id
    FROM (SELECT version, recording_id, gt_id, row_number() OVER (PARTITION BY version, recording_id ORDER BY gt_start, gt_id) AS pos FROM truth JOIN (SELECT DISTINCT version, recording_id FROM predictions) USING (recording_id)) a
    FULL OUTER JOIN (SELECT version, recording_id, pred_id, row_number() OVER (PARTITION BY version, recording_id ORDER BY pred_start, pred_id) AS pos FROM predictions) z ON a.version = z.version AND a.recording_id = z.recording_id AND a.pos = z.pos""", "truth", "predictions"))
def k13(t):
    pred, keys = b.predictions(t).select("version", "recording_id", "pred_id", "pred_start"), ["version", "recording_id"]
    truth = b.truth(t).select("recording_id", "gt_id", "gt_start").join(pred.select(*keys).distinct(), "recording_id")
    left = scan_rows(truth, keys, ["gt_start", "gt_id"]).select(*keys, "pos", "gt_id")
    right = scan_rows(pred, keys, ["pred_start", "pred_id"]).select(*keys, "pos", "pred_id")
    return left.join(right, [*keys, "pos"], "full_outer")
