"""Accuracy of recognition results against ground truth, for all versions and recordings at once.

Truth rows: (recording, gt_id, gt_start, gt_end, gt_action, gt_sets, gt_reps).
Predictions: (version, recording, pred_id, pred_start, pred_end, pred_action, pred_sets, pred_reps).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.functions.text import drop_brackets
from strideframe.operators import decisions
from strideframe.operators.intervals import overlap_join, overlap_seconds
from strideframe.operators.ranges import scan_islands
from strideframe.operators.stats import ratio
from strideframe.session import written

GT, PRED = ["recording_id", "gt_id"], ["recording_id", "pred_id"]


@dataclass(frozen=True)
class MatchParams:
    iou: float = 0.3
    coverage: float = 0.5
    rep_tolerance: int = 1
    require_sets: bool = True
    merge_gap: float = 120.0


def normalize_actions(df: DataFrame, name: str, aliases: DataFrame, out: str = "action") -> DataFrame:
    """Canonical action name: alias of the name, of the name without brackets, else the bare name.
    ``aliases`` has (alias, canonical)."""
    a = aliases.select(F.col("alias").alias("_a1"), F.col("canonical").alias("_c1"))
    b = aliases.select(F.col("alias").alias("_a2"), F.col("canonical").alias("_c2"))
    full, bare = F.trim(F.col(name)), drop_brackets(F.trim(F.col(name)))
    found = df.withColumns({"_full": full, "_bare": bare}).join(a, F.col("_full") == F.col("_a1"), "left").join(b, F.col("_bare") == F.col("_a2"), "left")
    return found.withColumn(out, F.coalesce("_c1", "_c2", "_bare", F.lit(""))).drop("_full", "_bare", "_a1", "_a2", "_c1", "_c2")


def merge_predictions(pred: DataFrame, gap: float = 120.0) -> DataFrame:
    """Join consecutive predictions of one action at most ``gap`` seconds apart."""
    keys = ["version", "recording_id"]
    parts = scan_islands(pred, keys, "pred_start", "pred_end", gap, tie=["pred_id"], label="pred_action", out="_part")
    return parts.groupBy(*keys, "run_id", "_part").agg(
        F.min_by("pred_id", F.struct("pred_start", "pred_id")).alias("pred_id"), F.min("pred_start").alias("pred_start"), F.max("pred_end").alias("pred_end"),
        F.any_value("pred_action").alias("pred_action"), F.sum("pred_sets").alias("pred_sets"), F.sum(F.coalesce("pred_reps", F.lit(0))).alias("pred_reps"),
    ).drop("run_id", "_part")


def overlap_measures(pairs: DataFrame) -> DataFrame:
    """overlap, IoU, share of the truth covered and share of the prediction used."""
    common = overlap_seconds(F.col("pred_start"), F.col("pred_end"), F.col("gt_start"), F.col("gt_end"))
    p, g = F.col("pred_end") - F.col("pred_start"), F.col("gt_end") - F.col("gt_start")
    return pairs.withColumn("overlap", common).withColumns(
        {"iou": ratio(F.col("overlap"), p + g - F.col("overlap")), "coverage": ratio(F.col("overlap"), g), "purity": ratio(F.col("overlap"), p)}
    )


def candidates(truth: DataFrame, pred: DataFrame, width: float, p: MatchParams = MatchParams()) -> DataFrame:
    """Truth and prediction pairs that may match: IoU or coverage high enough."""
    pairs = overlap_join(pred, truth, ["recording_id"], ("pred_start", "pred_end"), ("gt_start", "gt_end"), width)
    return overlap_measures(pairs).filter((F.col("iou") >= p.iou) | (F.col("coverage") >= p.coverage))


def match_greedy(pairs: DataFrame, most: int = decisions.MOST) -> DataFrame:
    """One-to-one matching by falling IoU, ties by (gt_id, pred_id).

    Pairs that share a truth or a prediction overlap in time.  Islands of overlapping pairs are
    matched in arrays; one of more than ``most`` pairs by rounds, and so are pairs that come without their
    four ends (:func:`candidates` gives them).
    """
    ids = ["version", "recording_id", "gt_id", "pred_id"]
    if not {"pred_start", "pred_end", "gt_start", "gt_end"} <= set(pairs.columns):
        return _match_by_rounds(pairs.select(*ids, "iou"))
    spans = pairs.select(*ids, "iou", F.least("pred_start", "gt_start").alias("_s"), F.greatest("pred_end", "gt_end").alias("_e"))
    spans = written(spans)  # the ranges of the islands are sampled first, which would run the join behind the pairs twice
    small, large, name = decisions.islands(spans, ["version", "recording_id"], "_s", "_e", tie=["gt_id", "pred_id"], most=most)
    same = lambda k, x: (k["gt_id"] == x["gt_id"]) | (k["pred_id"] == x["pred_id"])
    out = decisions.first_kept(small, name, [-F.col("iou"), F.col("gt_id"), F.col("pred_id")], [*ids, "iou"], same)
    out = written(out)  # read by every step that judges the pairs
    return out if large is None else out.unionByName(_match_by_rounds(large.select(*ids, "iou")))


def _match_by_rounds(pairs: DataFrame) -> DataFrame:
    """The same matching for islands of any size.

    A pair that is the best of both its truth and its prediction is what the greedy order
    would take, so all of those are taken at once and their rivals removed, until none is
    left.  Each round settles at least the best pair of every connected group.
    """
    ids = ["version", "recording_id", "gt_id", "pred_id"]
    g, q = ["version", *GT], ["version", *PRED]
    rank = F.struct(F.col("iou").alias("i"), (-F.col("gt_id")).alias("g"), (-F.col("pred_id")).alias("p"))
    open_pairs, taken = written(pairs), None
    while not open_pairs.isEmpty():
        best_g = open_pairs.groupBy(*g).agg(F.max_by("pred_id", rank).alias("pred_id"))
        best_p = open_pairs.groupBy(*q).agg(F.max_by("gt_id", rank).alias("gt_id"))
        won = written(open_pairs.join(best_g, [*g, "pred_id"]).join(best_p, [*q, "gt_id"]).select(*ids, "iou"))
        taken = won if taken is None else taken.unionByName(won)
        open_pairs = written(open_pairs.join(won.select(*g), g, "left_anti").join(won.select(*q), q, "left_anti"))
    return open_pairs if taken is None else taken


def verdicts(matched: DataFrame, truth: DataFrame, pred: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Right action, sets and reps of each matched pair, and the kind of error."""
    rows = matched.join(truth, GT).join(pred, ["version", *PRED])
    action = (F.col("gt_action") != "") & (F.col("gt_action") == F.col("pred_action"))
    sets = F.coalesce(F.col("gt_sets") == F.col("pred_sets"), F.lit(False))
    reps = F.col("gt_reps").isNull() | (F.abs(F.col("pred_reps") - F.col("gt_reps")) <= p.rep_tolerance)
    count = (sets & reps) if p.require_sets else reps
    named = rows.withColumns({"action_ok": F.coalesce(action, F.lit(False)), "set_ok": sets, "rep_ok": F.coalesce(reps, F.lit(False))}).withColumn("count_ok", F.coalesce(count, F.lit(False)))
    return named.withColumn("joint_ok", F.col("action_ok") & F.col("count_ok")).withColumn(
        "error_type", F.when(F.col("joint_ok"), "fully_correct").when(~F.col("action_ok"), "wrong_action").when(~F.col("set_ok") & F.lit(p.require_sets), "set_error").otherwise("rep_error")
    )


def detail_rows(judged: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Judged pairs plus missed truth and extra predictions, one row each."""
    cols = ["version", "recording_id", "gt_id", "pred_id", "gt_action", "pred_action", "gt_sets", "pred_sets", "gt_reps", "pred_reps"]
    flags = ["iou", "action_ok", "set_ok", "rep_ok", "count_ok", "joint_ok", "error_type"]
    wrong = {"iou": F.lit(0.0), **{c: F.lit(False) for c in flags[1:-1]}}
    versions = pred.select("version", "recording_id").distinct()
    missed = truth.join(versions, "recording_id").join(judged.select("version", *GT), ["version", *GT], "left_anti").withColumns({**wrong, "error_type": F.lit("missed_action")})
    extra = pred.join(judged.select("version", *PRED), ["version", *PRED], "left_anti").withColumns({**wrong, "error_type": F.lit("extra_action")})
    return judged.select(*cols, *flags).unionByName(missed, allowMissingColumns=True).unionByName(extra, allowMissingColumns=True).select(*cols, *flags)


def counts(details: DataFrame) -> DataFrame:
    """True and false positives and negatives per recording; a wrong action is both."""
    matched, has_gt, has_pred = F.col("gt_id").isNotNull() & F.col("pred_id").isNotNull(), F.col("gt_id").isNotNull(), F.col("pred_id").isNotNull()
    a, j = F.col("action_ok"), F.col("joint_ok")
    reps = F.coalesce(F.abs(F.col("pred_reps") - F.col("gt_reps")), F.lit(0))
    return details.groupBy("version", "recording_id").agg(
        F.count_if(a).alias("action_tp"), F.count_if(has_pred & ~a).alias("action_fp"), F.count_if(has_gt & ~a).alias("action_fn"),
        F.count_if(j).alias("joint_tp"), F.count_if(has_pred & ~j).alias("joint_fp"), F.count_if(has_gt & ~j).alias("joint_fn"),
        F.count_if(matched & F.col("rep_ok")).alias("rep_ok_count"), F.count_if(matched & F.col("set_ok")).alias("set_ok_count"), F.count_if(matched & F.col("count_ok")).alias("count_ok_count"),
        F.count_if(has_gt).alias("gt_count"), F.count_if(has_pred).alias("pred_count"), F.count_if(matched).alias("matched"),
        F.coalesce(F.sum("gt_reps"), F.lit(0)).alias("gt_reps"), F.coalesce(F.sum("pred_reps"), F.lit(0)).alias("pred_reps"),
        F.sum(F.when(matched, reps).otherwise(0)).alias("rep_error"),
    )


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(tp * 2, tp * 2 + fp + fn)


def scores(per_recording: DataFrame) -> DataFrame:
    """Micro scores per recording, per version and over all (``rollup``), with the macro
    means of the recordings that have truth on the version rows."""
    names = [c for c in per_recording.columns if c not in ("version", "recording_id")]
    rolled = per_recording.rollup("version", "recording_id").agg(F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in names]).filter(F.col("level") < 3)
    c = {n: F.col(n) for n in names}
    micro = rolled.withColumns(
        {
            "action_precision": ratio(c["action_tp"], c["action_tp"] + c["action_fp"]), "action_recall": ratio(c["action_tp"], c["action_tp"] + c["action_fn"]),
            "action_f1": _f1(c["action_tp"], c["action_fp"], c["action_fn"]), "joint_f1": _f1(c["joint_tp"], c["joint_fp"], c["joint_fn"]),
            "set_acc": ratio(c["set_ok_count"], c["gt_count"]), "rep_acc": ratio(c["rep_ok_count"], c["gt_count"]), "rep_mae": ratio(c["rep_error"], c["matched"]),
        }
    )
    with_gt = micro.filter((F.col("level") == 0) & (F.col("gt_count") > 0))
    macro = with_gt.groupBy("version").agg(F.avg("action_f1").alias("macro_action_f1"), F.avg("joint_f1").alias("macro_joint_f1"), F.avg("rep_acc").alias("macro_rep_acc"))
    tops = micro.filter(F.col("level") == 1).join(macro, "version", "left")
    return micro.filter(F.col("level") == 0).unionByName(tops, allowMissingColumns=True)


def compare_versions(version_scores: DataFrame) -> DataFrame:
    """Deviation of predicted reps and actions from the truth, in percent, per version."""
    return version_scores.filter(F.col("level") == 1).select(
        "version", "action_f1", "joint_f1", "gt_count", "pred_count",
        ratio((F.col("pred_reps") - F.col("gt_reps")) * 100, F.col("gt_reps")).alias("rep_deviation_pct"),
        ratio((F.col("pred_count") - F.col("gt_count")) * 100, F.col("gt_count")).alias("action_deviation_pct"),
    )


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from one count of (label, prediction)."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    side = F.explode(F.array(F.struct(F.col("l").alias("c"), F.lit(True).alias("t")), F.struct(F.col("p").alias("c"), F.lit(False).alias("t"))))
    rows = cells.withColumn("_s", side).groupBy(F.col("_s.c").alias("class")).agg(
        F.sum(F.when(F.col("_s.t") & (F.col("l") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_s.t"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("_s.t"), F.col("n")).otherwise(0)).alias("predicted"),
    )
    return rows.select(
        "class", "support", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(F.col("tp") * 2, F.col("support") + F.col("predicted")).alias("f1")
    )


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def drift(rows: DataFrame, training: DataFrame, label: str, feature: str, limit: float = 2.0) -> DataFrame:
    """z-score of a feature against the training rows of the same label (sample spread)."""
    base = training.groupBy(label).agg(F.avg(feature).alias("train_mean"), F.stddev_samp(feature).alias("train_std"))
    z = (F.col(feature) - F.col("train_mean")) / (F.col("train_std") + 1e-8)
    return rows.join(base, label, "left").withColumn("z", z).withColumn("out_of_range", F.abs("z") > limit)
