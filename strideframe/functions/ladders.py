"""Threshold ladders that turn a number into a label.

Each ladder is data: (comparison, bound, label) steps tried in order, then a default.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
Step = tuple[str, float, str]

# Bounds, strictness and label texts.
GYRO: tuple[list[Step], str] = ([(">", 30, "高强度运动"), (">", 10, "中等运动"), (">", 3, "轻微运动")], "静止/休息")
ACC_STD: tuple[list[Step], str] = ([(">", 0.35, "高"), (">", 0.15, "中高"), (">", 0.05, "低")], "静止")
AZ_POSTURE: tuple[list[Step], str] = ([(">", -0.35, "仰卧"), (">", -0.78, "俯身"), (">", -0.88, "坐姿")], "站姿")
FLOW: tuple[list[Step], str] = ([("<", 1.0, "极低"), ("<", 3.0, "低"), ("<", 6.0, "中"), ("<", 10.0, "高")], "极高")
DIRECTION: tuple[list[Step], str] = ([(">=", 315, "RIGHT"), ("<", 45, "RIGHT"), ("<", 135, "DOWN"), ("<", 225, "LEFT")], "UP")
INTENSITY: tuple[list[Step], str] = ([(">=", 0.6, "high"), (">=", 0.25, "medium"), (">", 0, "low")], "none")
SECONDS_RATIO: tuple[list[Step], str] = ([(">=", 0.6, "high"), (">=", 0.3, "medium")], "low")
PERCENT: tuple[list[Step], str] = ([(">=", 65, "high"), (">=", 30, "med")], "low")
SECONDS: tuple[list[Step], str] = ([(">=", 60, "高"), (">=", 30, "中")], "低")
COMPLETION: tuple[list[Step], str] = ([(">=", 0.95, "full")], "partial")
SCORE: tuple[list[Step], str] = ([(">=", 75, "Moderate–High"), (">=", 50, "Moderate")], "Light")
RECOVERY_BPM: tuple[list[Step], str] = ([(">", 30, "excellent"), (">=", 15, "normal")], "poor")


def ladder(c: Column, spec: tuple[Sequence[Step], str]) -> Column:
    steps, default = spec
    out = None
    for op, bound, label in steps:
        test = _OPS[op](c, F.lit(float(bound)))
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def direction(deg: Column) -> Column:
    return ladder(F.pmod(deg, F.lit(360.0)), DIRECTION)


def intensity(score: Column, top: Column) -> Column:
    return F.when(top == 0, F.lit("none")).otherwise(ladder(score / top, INTENSITY))
