"""Heart-rate analytics over ``(user_id, at, heart_rate)`` rows, ``at`` in seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.functions.ladders import RECOVERY_BPM, ladder
from strideframe.operators.sequence import frame, index_rows
from strideframe.operators.stats import ratio

# Zone bounds in percent of the maximum heart rate.
ZONES = ((60.0, 75.0, "moderate"), (75.0, 90.0, "high"))


def zone(hr: Column, max_hr: Column) -> Column:
    pct = hr / max_hr * 100
    return F.when(pct < 60, "low").when(pct < 75, "moderate").when(pct < 90, "high").otherwise("maximal")


def zone_times(hr: DataFrame, keys: Sequence[str], at: str, value: str, max_hr: str, tie: str) -> DataFrame:
    """Seconds per zone: a reading holds until the next one."""
    rows = index_rows(hr, keys, [at, tie], lead=[at])
    held = F.col(f"lead_{at}") - F.col(at)
    return (
        rows.filter(held.isNotNull())
        .groupBy(*keys, zone(F.col(value), F.col(max_hr)).alias("zone"))
        .agg(F.sum(held).alias("seconds"), F.max(value).alias("peak"), ratio(F.sum(F.col(value) * held), F.sum(held)).alias("mean_hr"))
    )


def low_activity_spans(hr: DataFrame, keys: Sequence[str], at: str, value: str, tie: str, below: float, min_sec: float) -> DataFrame:
    """Spans of consecutive low readings that last longer than ``min_sec``."""
    rows = index_rows(hr.withColumn("_low", (F.col(value) < below).cast("int")), keys, [at, tie], label="_low")
    spans = rows.filter(F.col("_low") == 1).groupBy(*keys, "run_id").agg(F.min(at).alias("start_sec"), F.max(at).alias("end_sec"))
    return spans.filter(F.col("end_sec") - F.col("start_sec") > min_sec).drop("run_id")


def recovery(ends: DataFrame, hr: DataFrame, keys: Sequence[str], end_at: str, at: str, value: str, tie: str, offsets: dict[str, float], tolerance: float) -> DataFrame:
    """Fall of the heart rate at fixed delays after the end of a session."""
    from strideframe.operators.intervals import nearest_in_time

    wanted = {"_end": 0.0, **offsets}
    at_each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("delay")) for n, s in wanted.items()]))
    targets = ends.withColumn("_w", at_each).select(
        *keys, F.col(end_at).alias("end_at"), F.col("_w.name").alias("_name"), (F.col(end_at) + F.col("_w.delay")).alias("_goal")
    )
    near = nearest_in_time(targets, hr.select(*keys, at, value, tie), keys, "_goal", at, tie, tolerance, target_keys=["end_at", "_name"])
    picks = [F.max(F.when(F.col("_name") == n, F.col(value))).alias(n) for n in wanted]
    wide = near.groupBy(*keys, "end_at").agg(*picks)
    drops = {f"drop_{n}": F.col("_end") - F.col(n) for n in offsets}
    first = next(iter(offsets))
    return wide.withColumns(drops).withColumn("recovery", F.when(F.col(f"drop_{first}").isNotNull(), ladder(F.col(f"drop_{first}"), RECOVERY_BPM))).drop("_end", *offsets)


def rest_gaps(sets: DataFrame, keys: Sequence[str], start: str, end: str, tie: str, target_max: float) -> DataFrame:
    """Mean rest between consecutive sets and how much of it exceeds a target."""
    rows = index_rows(sets, keys, [start, tie], lag=[end])
    rest = F.greatest(F.lit(0.0), F.col(start) - F.col(f"lag_{end}"))
    return rows.filter(F.col(f"lag_{end}").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rests"), F.avg(rest).alias("mean_rest"), F.count_if(rest > target_max).alias("long_rests")
    )


def fatigue_point(hr: DataFrame, keys: Sequence[str], at: str, value: str, tie: str, width: int, fall: float) -> DataFrame:
    """First time the trailing mean of ``width`` readings is ``fall`` (share) under its best so far."""
    from strideframe.operators.sequence import running

    placed = index_rows(hr, keys, [at, tie])
    means = frame(placed, keys, "pos", width - 1, 0, lambda w: {"_m": F.avg(value).over(w.rowsBetween(-(width - 1), 0))}).filter(F.col("pos") >= width)
    best = running(means, keys, [at, tie], {"_best": ("max", "_m")})
    return best.filter(F.col("_m") < F.col("_best") * (1 - fall)).groupBy(*keys).agg(F.min(at).alias("fatigue_at"))


def load_trend(sessions: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope of heart rate over time for sessions of equal load."""
    return sessions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"))
