"""Frame scoring and key-frame selection from detection boxes.

A frame row has the keys, ``frame`` (index), ``t`` (seconds), ``hands``, ``equipment`` and
``persons`` (arrays of ``(bbox, confidence, label)``, bounded by one picture), ``sharpness``
and ``motion``.  Arrays are scored with higher-order functions; only choices between
frames need windows, and those are over fixed time windows; what one frame hands to the next is composed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from strideframe.functions.mathx import box_area, box_center, box_distance, box_inside, box_iou, center_distance, clip, let
from strideframe.operators import decisions
from strideframe.operators.intervals import asof_nearest
from strideframe.operators.keyed import pick_first, top_k
from strideframe.operators.nearhash import MOST, first_come
from strideframe.operators.sequence import ROWS, index_rows
from strideframe.operators.stats import ratio
from strideframe.session import written


@dataclass(frozen=True)
class FrameParams:
    height: float = 1080.0
    width: float = 1920.0
    own_hand: float = 0.55
    active_equipment: float = 0.55
    boost: float = 0.15
    boost_reach: float = 0.2
    person_area: float = 0.25
    person_area_hard: float = 0.45
    min_hand: float = 0.30
    min_equipment: float = 0.30
    min_sharpness: float = 0.15


def _diagonal(p: FrameParams) -> float:
    return float(np.hypot(p.width, p.height))


def hand_score(box: Column, equipment: Column, persons: Column, p: FrameParams = FrameParams()) -> Column:
    """How likely a hand belongs to the camera wearer, from one picture."""
    x, y = box_center(box)
    inside = F.when(F.exists(persons, lambda q: box_inside(box, q["bbox"], 0.5)), 1.0).otherwise(0.0)
    size = F.least(F.lit(1.0), box_area(box) / (p.height * p.width) / 0.05)

    def raw(c: Column, nearest: Column) -> Column:
        cx, cy = c["x"], c["y"]
        position = let((cy / p.height - 0.3) / 0.5, lambda v: clip(v, 0, 1))
        close = F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - nearest / (_diagonal(p) * 0.3)), F.lit(0.0))
        edge = F.when((cx / p.width < 0.1) | (cx / p.width > 0.9) | (cy / p.height > 0.9), 0.8).otherwise(0.3)
        return position * 0.25 + size * 0.20 + F.when(nearest.isNull(), 0.0).otherwise(close) * 0.20 + 0.15 * 0.5 + edge * 0.10 + 0.10 * 0.5 - inside * 0.30

    gap = lambda c: F.array_min(F.transform(equipment, lambda e: center_distance(c["x"], c["y"], e["bbox"])))
    return let(let(F.struct(x.alias("x"), y.alias("y")), lambda c: let(gap(c), lambda n: raw(c, n))), lambda v: clip(v, 0, 1))


def score_hands(frames: DataFrame, keys: Sequence[str], p: FrameParams = FrameParams(), block: int = decisions.BLOCK) -> DataFrame:
    """Adds ``hands`` with score and own flag, after the neighbour-frame boost.

    A doubtful hand gains ``boost`` when an own hand is close to it in the frame before
    (already boosted) or after; the first and last frame of a key stay.  Whether a hand becomes own is "yes", or
    "if one of these hands of the frame before is", so the frames of a key compose (:func:`decisions.lit_masks`) and are never walked in
    one task.  At most 63 hands a frame.
    """
    scored = F.transform(
        "hands", lambda h: F.struct(h["bbox"].alias("bbox"), h["confidence"].alias("confidence"), hand_score(h["bbox"], F.col("equipment"), F.col("persons"), p).alias("score"))
    )
    # the other columns go along: the table of blocks keeps them, and nothing is computed a second time to be joined back
    rest = [c for c in frames.columns if c not in {*keys, "frame", "hands"}]
    first = frames.select(*keys, "frame", scored.alias("hands"), *rest)
    slim = index_rows(first, keys, ["frame"], lag=["hands"], lead=["hands"], width=ROWS)
    inner = F.col("lag_hands").isNotNull() & F.col("lead_hands").isNotNull()
    near = lambda h, e: box_distance(h["bbox"], e["bbox"]) < p.height * p.boost_reach

    def term(h: Column) -> Column:
        """Reached from the frame after, the near hands of the frame before as bits, and what that means for being own."""
        weak = inner & (h["score"] <= p.own_hand)
        after = weak & F.exists("lead_hands", lambda e: (e["score"] > p.own_hand) & near(h, e))
        bits = F.transform("lag_hands", lambda e, k: F.when(near(h, e), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
        mask = F.when(weak, F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))).otherwise(F.lit(0).cast("long"))
        lifted = h["score"] + p.boost > p.own_hand
        return let(
            F.struct(after.alias("after"), mask.alias("mask")),
            lambda v: F.struct(v["after"].alias("after"), v["mask"].alias("mask"), ((h["score"] > p.own_hand) | (v["after"] & lifted)).alias("c"), F.when(lifted, v["mask"]).otherwise(F.lit(0).cast("long")).alias("m")),
        )

    marked = slim.withColumn("_all", F.transform("hands", term)).select(*keys, "pos", "frame", "hands", *rest, "_all", F.transform("_all", lambda t: F.struct(t["c"].alias("c"), t["m"].alias("m"))).alias("_terms"))
    lit = decisions.lit_masks(marked, keys, "pos", "_terms", "_own", block)
    ahead = F.coalesce("before__own", F.lit(0).cast("long"))

    def settled(h: Column, t: Column) -> Column:
        score = F.when(t["after"] | (ahead.bitwiseAND(t["mask"]) != 0), F.least(F.lit(1.0), h["score"] + p.boost)).otherwise(h["score"])
        return let(score, lambda v: F.struct(h["bbox"].alias("bbox"), h["confidence"].alias("confidence"), v.alias("score"), (v > p.own_hand).alias("own")))

    return lit.select(*keys, "frame", *rest, F.zip_with("hands", "_all", settled).alias("hands"))


def own_hands() -> Column:
    return F.filter("hands", lambda h: h["own"])


def equipment_score(e: Column, own: Column, p: FrameParams = FrameParams()) -> Column:
    """How likely a piece of equipment is in use, before the frequency bonus."""
    x, y = box_center(e["bbox"])
    share = box_area(e["bbox"]) / (p.height * p.width)

    def raw(c: Column, nearest: Column) -> Column:
        cx, cy = c["x"], c["y"]
        close = F.when(nearest.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - nearest / (_diagonal(p) * 0.25)))
        center = F.greatest(F.lit(0.0), F.lit(1.0) - (F.abs(cx / p.width - 0.5) * 2 + F.abs(cy / p.height - 0.5) * 2) / 2)
        far = F.when(c["share"] < 0.02, F.greatest(F.lit(0.0), F.lit(1.0) - c["share"] / 0.02)).otherwise(0.0)
        return e["confidence"] * 0.30 + close * 0.25 + 0.20 * 0.5 + 0.15 * 0.5 + center * 0.10 - far * 0.20

    gap = lambda c: F.array_min(F.transform(own, lambda h: center_distance(c["x"], c["y"], h["bbox"])))
    return let(let(F.struct(x.alias("x"), y.alias("y"), share.alias("share")), lambda c: let(gap(c), lambda n: raw(c, n))), lambda v: clip(v, 0, 1))


def score_equipment(frames: DataFrame, keys: Sequence[str], p: FrameParams = FrameParams()) -> DataFrame:
    """Adds score and active flag to ``equipment``: the picture score plus a bonus for labels
    seen often in the segment (0.2 times the share of frames, at most 0.15)."""
    # one pass for labels and frames: a frame is counted at its first piece of equipment, or at the row that stands for none
    seen = frames.select(*keys, F.posexplode_outer("equipment").alias("_i", "e")).groupBy(*keys, F.col("e.label").alias("label")).agg(
        F.count("_i").alias("n"), F.count_if(F.coalesce("_i", F.lit(0)) == 0).alias("_frames")
    )
    counts = seen.groupBy(*keys).agg(F.collect_list(F.when(F.col("n") > 0, F.struct("label", "n"))).alias("_n"), F.sum("_frames").alias("_total"))
    freq = counts.select(*keys, F.map_from_entries(F.transform("_n", lambda x: F.struct(x["label"].alias("label"), (x["n"] / F.col("_total")).alias("f")))).alias("_freq"))
    joined = frames.join(freq, list(keys), "left").withColumn("_hands", own_hands())
    bonus = lambda e: F.least(F.lit(0.15), F.try_element_at("_freq", e["label"]) * 0.2)
    made = F.transform(
        "equipment",
        lambda e: F.struct(e["bbox"].alias("bbox"), e["confidence"].alias("confidence"), e["label"].alias("label"), F.least(F.lit(1.0), equipment_score(e, F.col("_hands"), p) + bonus(e)).alias("score")),
    )
    flagged = joined.withColumn("equipment", made).withColumn(
        "equipment", F.transform("equipment", lambda e: F.struct(e["bbox"].alias("bbox"), e["confidence"].alias("confidence"), e["label"].alias("label"), e["score"].alias("score"), (e["score"] > p.active_equipment).alias("active")))
    )
    return flagged.drop("_freq", "_hands")


def interaction(own: Column, active: Column, p: FrameParams = FrameParams()) -> Column:
    """1 when a hand touches active equipment, else how near they are."""

    def met(own: Column, active: Column) -> Column:
        touch = F.exists(own, lambda h: F.exists(active, lambda e: box_iou(h["bbox"], e["bbox"]) > 0.01))
        gaps = F.flatten(F.transform(own, lambda h: F.transform(active, lambda e: box_distance(h["bbox"], e["bbox"]))))
        near = F.greatest(F.lit(0.0), F.lit(1.0) - F.array_min(gaps) / (_diagonal(p) * 0.2))
        return F.when((F.size(own) == 0) | (F.size(active) == 0), 0.0).when(touch, 1.0).otherwise(near)

    return let(F.struct(own.alias("own"), active.alias("active")), lambda v: met(v["own"], v["active"]))


def score_frames(frames: DataFrame, p: FrameParams = FrameParams()) -> DataFrame:
    """Information score of each frame and the scores behind it (hands and equipment scored before)."""
    own, active = own_hands(), F.filter("equipment", lambda e: e["active"])
    area = F.coalesce(F.array_max(F.transform("persons", lambda q: box_area(q["bbox"]) / (p.height * p.width))), F.lit(0.0))
    base = frames.withColumns(
        {
            "hand_score": F.coalesce(F.array_max(F.transform(own, lambda h: h["score"])), F.lit(0.0)),
            "equipment_score": F.coalesce(F.array_max(F.transform(active, lambda e: e["score"])), F.lit(0.0)),
            "interaction": interaction(own, active, p), "person_area": area,
        }
    )
    idle = ratio(F.size(F.filter("equipment", lambda e: ~e["active"])), F.size("equipment"))
    noise = base.withColumns(
        {
            "person_noise": F.when(F.col("hand_score") > 0.5, F.col("person_area") * 0.3).otherwise(F.col("person_area")),
            "background_noise": F.when(F.col("equipment_score") > 0.5, idle * 0.3).otherwise(idle),
        }
    )
    score = (
        F.col("hand_score") * 0.30 + F.col("equipment_score") * 0.25 + F.col("interaction") * 0.20 + F.col("motion") * 0.10 + F.col("sharpness") * 0.10 + 0.05 * 0.5
        - F.col("person_noise") * 0.25 - F.col("background_noise") * 0.15
    )
    return noise.withColumn("info_score", clip(score, 0, 1))


def filter_reason(p: FrameParams = FrameParams()) -> Column:
    """Why a scored frame is of low value; NULL for a useful one.  The first rule wins."""


    def rules(v: Column) -> Column:
        area, hand, eq = v["person_area"], v["hand_score"], v["equipment_score"]
        return (
            F.when((area > p.person_area_hard) & (hand < 0.20), "person_dominant_hard")
            .when((area > p.person_area) & (hand < p.min_hand) & (eq < p.min_equipment), "person_dominant_soft")
            .when((area > p.person_area) & (hand < 0.1) & (eq < 0.1), "coach_demo")
            .when(v["sharpness"] < p.min_sharpness, "blur")
        )

    return let(F.struct("person_area", "hand_score", "equipment_score", "sharpness"), rules)


def window_top(frames: DataFrame, keys: Sequence[str], size: float = 2.0, k: int = 2) -> DataFrame:
    """The best ``k`` frames of each time window counted from the first frame."""
    first = frames.groupBy(*keys).agg(F.min("t").alias("_t0"))
    placed = frames.join(first, list(keys)).withColumn("_w", F.floor((F.col("t") - F.col("_t0")) / F.lit(float(size))))
    return top_k(placed, [*keys, "_w"], [F.desc("info_score"), "t", "frame"], k).drop("_w", "_t0")


def mean_height(boxes: Column) -> Column:
    """Mean height of the centres of boxes; NULL without a box."""
    return F.when(F.size(boxes) > 0, F.aggregate(boxes, F.lit(0.0), lambda a, x: a + box_center(x["bbox"])[1]) / F.size(boxes))


def endpoint_metrics(frames: DataFrame) -> DataFrame:
    """Adds ``hand_y``, ``equipment_y`` (mean heights of own hands and of active equipment) and ``hand_distance`` (between the first two own hands) to scored frames."""
    own, active = own_hands(), F.filter("equipment", lambda e: e["active"])
    apart = F.when(F.size(own) > 1, box_distance(F.get(own, F.lit(0))["bbox"], F.get(own, F.lit(1))["bbox"]))
    return frames.withColumns({"hand_y": mean_height(own), "equipment_y": mean_height(active), "hand_distance": apart})


def extremes(frames: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """For each metric, the first frame at its maximum and at its minimum, with the reason: one aggregate for all."""
    ends = []
    for m in metrics:
        for name, value in (("max", F.col(m)), ("min", -F.col(m))):
            rank = F.when(F.col(m).isNotNull(), F.struct(value.alias("v"), (-F.col("t")).alias("t"), (-F.col("frame")).alias("f")))
            ends.append((f"{m}_{name}", F.max_by("frame", rank)))
    found = frames.groupBy(*keys).agg(*[chosen.alias(f"_{name}") for name, chosen in ends])
    rows = F.inline(F.array(*[F.struct(F.col(f"_{name}").alias("frame"), F.lit(name).alias("reason")) for name, _ in ends]))
    return found.select(*keys, rows).filter(F.col("frame").isNotNull())


def anchors(frames: DataFrame, keys: Sequence[str], positions: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """The frame nearest to each relative position of the segment's time span."""
    span = frames.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    spots = F.explode(F.array(*[F.lit(float(x)) for x in positions]))
    goals = span.withColumn("position", spots).select(*keys, "position", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("position")).alias("t"))
    return asof_nearest(goals, frames.select(*keys, "t", "frame"), keys, "t", "frame", ["frame"]).select(*keys, "frame", F.concat(F.lit("anchor_"), F.round(F.col("position") * 100).cast("int").cast("string"), F.lit("%")).alias("reason"))


def drop_near_duplicates(selected: DataFrame, keys: Sequence[str], min_gap: float = 0.3, min_distance: int = 6, most: int = MOST) -> DataFrame:
    """In time order, keep a frame that is ``min_gap`` after and ``min_distance`` bits away
    from every kept frame; a segment of more than ``most`` frames is settled by rounds over a Hamming index."""
    return first_come(selected, keys, "t", "frame", "phash", min_gap, min_distance, most)


def assemble(frames: DataFrame, keys: Sequence[str], metrics: Sequence[str], *, size: float = 2.0, k: int = 2, most: int = 36, least: int = 12, min_gap: float = 0.3, min_distance: int = 6) -> DataFrame:
    """Key frames of a segment: window winners, extremes and anchors (a frame chosen twice
    keeps the last reason), near-duplicates dropped, the best ``most`` kept, and filled up
    with the best other unfiltered frames when fewer than ``least``."""
    useful = frames.filter(F.col("filter_reason").isNull())
    # read by every step below, and it stands for the whole scoring: settled once (a checkpoint would compute it twice)
    slim = written(useful.select(*keys, "frame", "t", "phash", "info_score", *metrics))
    won = window_top(slim, keys, size, k).select(*keys, "frame", F.lit("window_topk").alias("reason"), F.lit(0).alias("_src"))
    ends = extremes(slim, keys, metrics).withColumn("_src", F.lit(1))
    spots = anchors(slim, keys).withColumn("_src", F.lit(2))
    every = won.unionByName(ends).unionByName(spots)
    named = pick_first(every, [*keys, "frame"], [F.desc("_src"), F.desc("reason")]).drop("_src")
    chosen = drop_near_duplicates(slim.select(*keys, "frame", "t", "phash", "info_score").join(named, [*keys, "frame"]), keys, min_gap, min_distance)
    best = top_k(chosen, keys, [F.desc("info_score"), "t", "frame"], most, "_r")
    have = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"))
    rest = slim.join(best.select(*keys, "frame"), [*keys, "frame"], "left_anti")
    ranked = top_k(rest, keys, [F.desc("info_score"), "t", "frame"], least, "_r").join(have, list(keys))
    fill = ranked.filter(F.col("_r") <= F.lit(least) - F.col("_have")).withColumn("reason", F.lit("fill"))
    cols = [*keys, "frame", "t", "info_score", "reason"]
    return best.select(*cols).unionByName(fill.select(*cols))


def summarize(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Visibility, noise and hand-motion figures of each segment."""
    own = own_hands()
    rows = frames.withColumn("_y", mean_height(own))
    span = F.max("_y") - F.min("_y")
    visible = F.avg((F.col("hand_score") > 0.3).cast("double"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), visible.alias("hand_visible"), F.avg((F.size(own) >= 2).cast("double")).alias("both_visible"), F.avg("hand_score").alias("mean_hand_score"), (visible < 0.2).alias("low_visibility"),
        F.count_if(F.col("filter_reason").contains("person")).alias("person_removed"), F.count_if(F.col("background_noise") > 0.5).alias("background_downweighted"),
        F.when(F.count("_y") == 0, "unknown").when(span > 50, "vertical").otherwise("horizontal").alias("motion_axis"),
    )


def equipment_summary(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per label: share of frames, mean score and whether it was ever active."""
    totals = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # not F.explode: its inner form filters by the size of the array, below which Spark scores everything once more
    pieces = frames.select(*keys, F.explode_outer("equipment").alias("e")).filter(F.col("e").isNotNull())
    seen = pieces.groupBy(*keys, F.col("e.label").alias("label")).agg(
        F.count(F.lit(1)).alias("_c"), F.avg("e.score").alias("mean_score"), F.max(F.col("e.active").cast("int")).cast("boolean").alias("active")
    )
    return seen.join(totals, list(keys)).withColumn("visible_share", F.col("_c") / F.col("_n")).drop("_c", "_n")
