"""Rule classifiers for posture and activity windows, as single expressions.

Thresholds are parameters; the order of the rules is part of their meaning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from strideframe.functions.mathx import clip

# Labels of the tilt rules with their base confidence.
TILT_LABELS = {
    "supine": ("平躺", 0.92), "prone": ("俯卧", 0.92), "right_side": ("右侧身", 0.88), "left_side": ("左侧身", 0.88), "horizontal": ("水平姿态", 0.68),
    "reclined": ("斜躺", 0.84), "bent": ("俯身", 0.84), "leaning": ("侧倾", 0.76), "tilted": ("明显倾斜", 0.65),
    "slight_periodic": ("轻度倾斜周期运动", 0.68), "slight": ("轻度倾斜", 0.62),
    "squats": ("下蹲/蹲起周期", 0.74), "upright_periodic": ("竖直周期运动", 0.70), "upright_still": ("竖直静止", 0.72), "upright_moving": ("竖直运动", 0.68),
    "unknown": ("未知姿态", 0.35),
}


def tilt_posture(tilt: Column, chest: Column, side: Column, motion: Column, gyro: Column, periodic: Column, freq: Column, drift: Column) -> tuple[Column, Column, Column]:
    """Label, confidence and rule name from the torso tilt.

    ``chest``, ``side`` and ``drift`` may be NULL; a large drift lowers the confidence.
    """
    squat = (periodic >= 0.60) & (freq >= 0.2) & (freq <= 1.6)
    walk = (periodic >= 0.65) & (freq >= 0.8) & (freq <= 2.8)
    sway = (periodic >= 0.58) & (freq >= 0.2) & (freq <= 1.6)
    flat, steep, mild = tilt >= 70, (tilt >= 35) & (tilt < 70), (tilt >= 20) & (tilt < 35)
    rule = (
        F.when(flat & (chest <= -0.60), "supine")
        .when(flat & (chest >= 0.60), "prone")
        .when(flat & (side >= 0.60), "right_side")
        .when(flat & (side <= -0.60), "left_side")
        .when(flat, "horizontal")
        .when(steep & (chest <= -0.35), "reclined")
        .when(steep & (chest >= 0.25), "bent")
        .when(steep & (F.abs(side) >= 0.55), "leaning")
        .when(steep, "tilted")
        .when(mild & sway, "slight_periodic")
        .when(mild, "slight")
        .when((tilt < 20) & squat, "squats")
        .when((tilt < 20) & walk, "upright_periodic")
        .when((tilt < 20) & (motion < 0.08) & (gyro < 12), "upright_still")
        .when(tilt < 20, "upright_moving")
        .otherwise("unknown")
    )
    names, confs = [], []
    for key, (label, conf) in TILT_LABELS.items():
        names += [F.lit(key), F.lit(label)]
        confs += [F.lit(key), F.lit(conf)]
    penalty = F.when(drift > 25, 0.65).when(drift > 15, 0.80).otherwise(1.0)
    label = F.element_at(F.create_map(*names), rule)
    return label, clip(F.element_at(F.create_map(*confs), rule) * penalty, 0.05, 0.98), rule


@dataclass(frozen=True)
class ChestRules:
    """Thresholds for a chest-worn sensor, in g and degrees per second."""

    still_gyro: float = 6.0
    still_acc: float = 0.04
    slight_gyro: float = 15.0
    slight_acc: float = 0.10
    walk_gyro: float = 55.0
    walk_acc_lo: float = 0.05
    walk_acc_hi: float = 0.35
    vigorous_gyro: float = 100.0
    vigorous_acc: float = 0.35
    lying_az: float = -0.35
    lying_gyro: float = 15.0
    bend_az_lo: float = -0.78
    bend_az_hi: float = -0.35
    bend_ay: float = 0.25
    bend_gyro: float = 25.0
    upright_az: float = -0.75
    squat_gyro_lo: float = 10.0
    squat_gyro_hi: float = 60.0
    squat_acc: float = 0.25
    run_freq: float = 2.5
    walk_gyro_no_steps: float = 30.0


def chest_activity(acc_std: Column, gyro_mean: Column, gyro_max: Column, az: Column, ay_abs: Column, step_freq: Column, p: ChestRules = ChestRules()) -> Column:
    """Eleven activity labels; the first rule that holds wins."""
    walkable = (acc_std >= p.walk_acc_lo) & (acc_std <= p.walk_acc_hi) & (gyro_mean <= p.walk_gyro) & (az < p.bend_az_lo)
    return (
        F.when((az > p.lying_az) & (gyro_mean < p.lying_gyro), "lying")
        .when((gyro_mean < p.still_gyro) & (acc_std < p.still_acc), F.when(az < p.upright_az, "still").otherwise("still_nonvert"))
        .when((gyro_mean < p.slight_gyro) & (acc_std < p.slight_acc), "slight")
        .when((az > p.bend_az_lo) & (az < p.bend_az_hi) & (ay_abs > p.bend_ay) & (gyro_mean < p.bend_gyro), "bending")
        .when((gyro_max > p.vigorous_gyro) | (acc_std > p.vigorous_acc), "vigorous")
        .when(walkable & (step_freq > p.run_freq), "running")
        .when(walkable & ((step_freq > 0) | (gyro_mean < p.walk_gyro_no_steps)), "walking")
        .when((az < p.upright_az) & (gyro_mean > p.squat_gyro_lo) & (gyro_mean < p.squat_gyro_hi) & (acc_std < p.squat_acc), "squat_sit")
        .when(gyro_mean >= p.slight_gyro, "active")
        .otherwise("unknown")
    )


def angle_activity(acc_std: Column, gyro_mean: Column, gyro_max: Column, az: Column, angle_x_std: Column, angle_y_std: Column) -> Column:
    """The older rule set, which reads the spread of the angles instead of |ay|."""
    upright = F.abs(az)
    return (
        F.when((upright < 0.40) & (gyro_mean < 12), "lying")
        .when((gyro_mean < 6) & (acc_std < 0.04), F.when(upright > 0.80, "still").otherwise("still_nonvert"))
        .when((gyro_mean < 15) & (acc_std < 0.10), F.when(angle_y_std > 8, "bending").otherwise("slight"))
        .when((gyro_max > 100) | (acc_std > 0.35), "vigorous")
        .when((acc_std >= 0.05) & (acc_std <= 0.35) & (gyro_mean <= 55), "walking")
        .when((angle_y_std > 8) & (acc_std < 0.25) & (gyro_mean < 50), "bending")
        .when((angle_x_std > 6) & (acc_std < 0.25) & (gyro_mean > 10) & (gyro_mean < 60), "squat_sit")
        .when(gyro_mean >= 15, "active")
        .otherwise("unknown")
    )


def pseudo_label(tilt: Column, acc_std: Column, gyro_mean: Column, periodic: Column, freq: Column, energy: Column) -> tuple[Column, Column]:
    """Weak training label and its confidence from window features."""
    cyclic = (periodic >= 0.55) & (freq >= 0.2) & (freq <= 1.8)
    flat, steep, mild, up = tilt >= 70, (tilt >= 35) & (tilt < 70), (tilt >= 20) & (tilt < 35), tilt < 20
    rules = [
        (flat & (acc_std < 0.08) & (gyro_mean < 15), "supine", 0.85),
        (flat, "side_lying", 0.65),
        (steep & (acc_std < 0.10), "incline_lying", 0.75),
        (steep, "bending_forward", 0.65),
        (mild & cyclic, "upright_periodic", 0.60),
        (mild, "bending_forward", 0.55),
        (up & cyclic, "upright_periodic", 0.70),
        (up & (acc_std < 0.04) & (gyro_mean < 8), "standing_like", 0.80),
        (up & (periodic >= 0.50) & (freq >= 1.5), "standing_like", 0.60),
        (up & (gyro_mean > 40) & (energy > 0.02), "squatting", 0.55),
        (up, "standing_like", 0.60),
    ]
    label, conf = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for test, name, c in rules[1:]:
        label, conf = label.when(test, name), conf.when(test, c)
    return label.otherwise("unknown"), conf.otherwise(0.30)


def fuse(flow_moving: Column, sensor_level: Column, flow_unclear: Column) -> Column:
    """Confidence class from optical motion and sensor activity (high, low or other)."""
    return (
        F.when(flow_moving & (sensor_level == "high"), "exercise_high")
        .when(flow_moving & (sensor_level == "low"), "exercise_low")
        .when(flow_unclear & (sensor_level == "low"), "rest")
        .otherwise("undecided")
    )
