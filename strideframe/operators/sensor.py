"""Motion-sensor windows, features and summaries over ``(keys, t_rel, channels)`` rows.

Windows start at each recording's own zero.  A window of fixed length holds a number
of rows bounded by the sampling rate, so window features aggregate freely; anything
ordered over a whole recording goes through :mod:`strideframe.operators.sequence`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.functions.ladders import ACC_STD, AZ_POSTURE, FLOW, GYRO, ladder
from strideframe.functions.mathx import circular_delta, circular_distance, clip, magnitude, unit_axis
from strideframe.operators.intervals import into_windows, points_in
from strideframe.operators.keyed import pick_first
from strideframe.operators.posture import tilt_posture
from strideframe.operators.rhythm import periodicity
from strideframe.operators.sequence import ROWS, SECONDS, fill_last, frame, index_rows
from strideframe.operators.stats import circular_mean, exact_quantiles, mode_first, ratio

GRAVITY = 9.80665


def standardize(df: DataFrame, keys: Sequence[str], at: str, numeric: Sequence[str], required: Sequence[str], tie: str) -> DataFrame:
    """Numbers from text, rows without a required value dropped, first row of each time kept."""
    typed = df.withColumns({c: F.col(c).try_cast("double") for c in numeric})
    return pick_first(typed.dropna(subset=[at, *required]), [*keys, at], [tie])


def sample_rate(df: DataFrame, keys: Sequence[str], at: str, tie: str, lo: float = 10, hi: float = 100, default: float = 50, width: float = SECONDS) -> DataFrame:
    """Rounded inverse of the median positive time step, clipped; a default where there is none."""
    steps = index_rows(df.select(*keys, at, tie), keys, [at, tie], lag=[at], width=width).withColumn("_dt", F.col(at) - F.col(f"lag_{at}"))
    med = exact_quantiles(steps.filter(F.col("_dt") > 0), keys, "_dt", {"_m": 0.5})
    rate = F.coalesce(clip(F.rint(1.0 / F.col("_m")), lo, hi), F.lit(float(default)))
    return df.select(*keys).distinct().join(med, list(keys), "left").select(*keys, rate.alias("fs"))


def resample(df: DataFrame, keys: Sequence[str], at: str, cols: Sequence[str], step: float) -> DataFrame:
    """Mean per step of a fixed grid; empty steps are interpolated, the edges filled."""
    means = df.withColumn("bucket", F.floor(F.col(at) / F.lit(float(step)))).groupBy(*keys, "bucket").agg(*[F.avg(c).alias(c) for c in cols])
    ends = means.groupBy(*keys).agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_b"))
    grid = ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias("bucket"))
    full = grid.join(means, [*keys, "bucket"], "left")
    near = fill_last(full, keys, ["bucket"], cols, width=ROWS)
    outs = []
    for c in cols:
        p, pa, n, na = F.col(f"prev_{c}"), F.col(f"prev_at_{c}"), F.col(f"next_{c}"), F.col(f"next_at_{c}")
        between = p + (n - p) * (F.col("bucket") - pa) / (na - pa)
        outs.append(F.when(p.isNull(), n).when(n.isNull() | (na == pa), p).otherwise(between).alias(c))
    return near.select(*keys, "bucket", (F.col("bucket") * F.lit(float(step))).alias(at), *outs)


def to_g(df: DataFrame, keys: Sequence[str], axes: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Divide by standard gravity where the median magnitude says the unit is m/s²."""
    mags = df.select(*keys, magnitude(*[F.col(a) for a in axes]).alias("_mag"))
    med = exact_quantiles(mags, keys, "_mag", {"_med": 0.5})
    scale = F.when(F.col("_med") > limit, GRAVITY).otherwise(1.0)
    return df.join(med, list(keys)).withColumns({a: F.col(a) / scale for a in axes}).drop("_med")


def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], size: int, prefix: str = "g_", width: float = SECONDS) -> DataFrame:
    """Centred mean with zero padding at the ends; an even size looks one row further back."""
    placed = index_rows(df, keys, order, width=width)
    back, ahead = size // 2, (size - 1) // 2
    out = frame(placed, keys, "pos", back, ahead, lambda w: {f"{prefix}{c}": F.sum(c).over(w.rowsBetween(-back, ahead)) / size for c in cols})
    return out.drop("pos")


def step_change(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, span: int = 3, width: float = SECONDS) -> DataFrame:
    """Mean of the ``span`` rows from here on minus the mean of the ``span`` before."""
    placed = index_rows(df, keys, order, total=True, width=width)
    return frame(
        placed, keys, "pos", span, span - 1,
        lambda w: {"before": F.avg(value).over(w.rowsBetween(-span, -1)), "after": F.avg(value).over(w.rowsBetween(0, span - 1))},
    ).withColumn("delta", F.col("after") - F.col("before"))


def step_hits(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, span: int = 3, threshold: float = 3.0, width: float = SECONDS) -> DataFrame:
    """Rows where the mean jumps by at least ``threshold``; the first ``span`` rows and the last are skipped."""
    rows = step_change(df, keys, order, value, span, width)
    hit = rows.filter((F.col("pos") > span) & (F.col("pos") < F.col("n_rows")) & (F.abs("delta") >= threshold))
    return hit.withColumn("kind", F.when(F.col("delta") > 0, "rise").otherwise("drop")).drop("n_rows", "pos")


def mark_peaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, prominence: float = 0.15) -> DataFrame:
    """``peak``: a local maximum over five rows, ``prominence`` above the group mean.

    Neighbours come from position blocks and the mean from an aggregate joined back, so a
    crowded group (window, segment, recording) is spread over tasks.
    """
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    near = frame(
        index_rows(df, keys, order), keys, "pos", 2, 2,
        lambda w: {"_p1": F.lag(value, 1).over(w), "_p2": F.lag(value, 2).over(w), "_n1": F.lead(value, 1).over(w), "_n2": F.lead(value, 2).over(w)},
    ).drop("pos")
    v = F.col(value)
    top = (v > F.col("_mean") + prominence) & (v >= F.col("_p1")) & (v >= F.col("_n1")) & (v > F.col("_p2")) & (v > F.col("_n2"))
    return near.join(means, list(keys)).withColumn("peak", F.coalesce(top, F.lit(False)).cast("int")).drop("_p1", "_p2", "_n1", "_n2", "_mean")


def _hint(std: Column, posture: Column, peaks: Column) -> Column:
    return (
        F.when((std > 0.15) & (peaks >= 3), "strength").when((std > 0.05) & (posture == "站姿"), "walking").when(std <= 0.05, "resting").otherwise("")
    )


def tumbling_summary(df: DataFrame, keys: Sequence[str], at: str, tie: str, totals: DataFrame, size: float = 30.0) -> DataFrame:
    """One row per window of the whole recording: intensity, posture, peaks, gyro and a hint.

    Needs ``acc``, ``gyro`` and ``az``; ``totals`` has (keys, total_sec).  A window
    without rows keeps NULL measures and the intensity ``no data``.
    """
    rows = df.filter(F.col(at) >= 0).withColumn("k", F.floor(F.col(at) / F.lit(float(size))))
    stats = mark_peaks(rows.select(*keys, "k", at, tie, "acc", "gyro", "az"), [*keys, "k"], [at, tie], "acc").groupBy(*keys, "k").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("acc").alias("acc_std"), F.avg("az").alias("az_mean"),
        F.avg("gyro").alias("gyro_mean"), F.max("gyro").alias("gyro_max"), F.sum("peak").alias("peaks"),
    )
    last = F.ceil(F.col("total_sec") / F.lit(float(size))) - 1
    grid = totals.filter(F.col("total_sec") > 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    full = grid.join(stats, [*keys, "k"], "left")
    posture = F.when(F.col("n").isNotNull(), ladder(F.col("az_mean"), AZ_POSTURE))
    intensity = F.when(F.col("n").isNull(), "no data").otherwise(ladder(F.col("acc_std"), ACC_STD))
    return full.withColumns({"posture": posture, "intensity": intensity}).withColumn(
        "hint", F.when(F.col("n").isNotNull(), _hint(F.col("acc_std"), F.col("posture"), F.col("peaks")))
    )


def segment_summary(df: DataFrame, segments: DataFrame, keys: Sequence[str], seg_id: str, at: str, tie: str, width: float, pad: float = 5.0) -> DataFrame:
    """Statistics of each padded segment, with peak count and a period estimate from
    crossings of the mean rotation (at least four of them)."""
    rows = points_in(df.select(*keys, at, tie, "acc", "gyro", "az"), segments.select(*keys, seg_id, "start_sec", "end_sec"), keys, at, ("start_sec", "end_sec"), width, pad=pad)
    group = [*keys, seg_id]
    mean = rows.groupBy(*group).agg(F.avg("gyro").alias("_g"))
    sided = rows.join(mean, group).withColumn("_above", (F.col("gyro") > F.col("_g")).cast("int")).drop("_g")
    flips = index_rows(sided, group, [at, tie], lag=["_above"]).drop("pos")
    peaks = mark_peaks(flips, group, [at, tie], "acc")
    out = peaks.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.any_value("start_sec").alias("start_sec"), F.any_value("end_sec").alias("end_sec"),
        F.avg("gyro").alias("gyro_mean"), F.max("gyro").alias("gyro_max"), F.avg("acc").alias("acc_mean"), F.max("acc").alias("acc_max"),
        F.stddev_pop("acc").alias("acc_std"), F.avg("az").alias("az_mean"), F.sum("peak").alias("peaks"),
        F.count_if(F.col("_above") != F.col("lag__above")).alias("crossings"),
    )
    span = F.col("end_sec") - F.col("start_sec")
    return out.withColumns(
        {
            "posture": ladder(F.col("az_mean"), AZ_POSTURE), "intensity": ladder(F.col("acc_std"), ACC_STD), "rotation": ladder(F.col("gyro_mean"), GYRO),
            "period_sec": F.when((F.col("crossings") >= 4) & (span > 0), span / (F.col("crossings") / 2)),
        }
    )


def sub_windows(df: DataFrame, segments: DataFrame, keys: Sequence[str], seg_id: str, at: str, tie: str, width: float, size: float = 10.0, min_rows: int = 20, min_each: int = 3) -> DataFrame:
    """Fixed windows inside each segment that is longer than 1.5 windows and has more than
    ``min_rows`` rows; windows with fewer than ``min_each`` rows are left out."""
    long = segments.filter(F.col("end_sec") - F.col("start_sec") > size * 1.5).select(*keys, seg_id, "start_sec", "end_sec")
    rows = points_in(df.select(*keys, at, tie, "acc", "az"), long, keys, at, ("start_sec", "end_sec"), width)
    group = [*keys, seg_id]
    busy = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_rows).select(*group)
    inside = rows.join(busy, group, "left_semi").filter(F.col(at) < F.col("end_sec")).withColumn("sub", F.floor((F.col(at) - F.col("start_sec")) / F.lit(float(size))))
    out = mark_peaks(inside, [*group, "sub"], [at, tie], "acc").groupBy(*group, "sub").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("acc").alias("acc_std"), F.avg("az").alias("az_mean"), F.sum("peak").alias("peaks")
    )
    return out.filter(F.col("n") >= min_each).withColumns({"posture": ladder(F.col("az_mean"), AZ_POSTURE), "intensity": ladder(F.col("acc_std"), ACC_STD)})


def rest_periods(
    df: DataFrame, segments: DataFrame, keys: Sequence[str], seg_id: str, at: str, width: float,
    size: float = 3.0, stride: float = 1.0, threshold: float = 0.05, min_rest: float = 10.0, min_rows: int = 10, min_each: int = 3,
) -> DataFrame:
    """Stretches inside a segment where consecutive evaluated windows are still."""
    group = [*keys, seg_id]
    rows = points_in(df.select(*keys, at, "acc"), segments.select(*keys, seg_id, "start_sec", "end_sec"), keys, at, ("start_sec", "end_sec"), width)
    enough = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows).select(*group)
    rel = rows.join(enough, group, "left_semi").withColumn("_rel", F.col(at) - F.col("start_sec"))
    wins = into_windows(rel, "_rel", size, stride).filter(F.col("k") * stride + F.lit(float(size)) <= F.col("end_sec") - F.col("start_sec"))
    scored = wins.groupBy(*group, "k").agg(F.any_value("start_sec").alias("start_sec"), F.stddev_pop("acc").alias("_std"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_each)
    flagged = scored.select(*group, "k", "start_sec", (F.col("_std") < threshold).cast("int").alias("still"))
    runs = index_rows(flagged, group, ["k"], label="still", width=ROWS).filter(F.col("still") == 1)
    spans = runs.groupBy(*group, "run_id").agg(
        (F.any_value("start_sec") + F.min("k") * F.lit(float(stride))).alias("rest_start"), (F.any_value("start_sec") + F.max("k") * F.lit(float(stride)) + F.lit(float(size))).alias("rest_end")
    )
    return spans.filter(F.col("rest_end") - F.col("rest_start") >= min_rest).drop("run_id")


def split_sets(df: DataFrame, segments: DataFrame, rests: DataFrame, keys: Sequence[str], seg_id: str, at: str, tie: str, width: float) -> DataFrame:
    """The parts of a segment between its rests are sets; the peaks of a part are its reps."""
    group = [*keys, seg_id]
    edges = segments.select(*group, F.col("start_sec").alias("_cut"), F.col("start_sec").alias("_until")).unionByName(
        segments.select(*group, F.col("end_sec").alias("_cut"), F.col("end_sec").alias("_until"))
    ).unionByName(rests.select(*group, F.col("rest_start").alias("_cut"), F.col("rest_end").alias("_until")))
    ordered = index_rows(edges, group, ["_cut", "_until"], lead=["_cut"])
    sets = ordered.select(*group, F.col("pos").alias("set_no"), F.col("_until").alias("set_start"), F.col("lead__cut").alias("set_end")).filter(F.col("set_end") > F.col("set_start"))
    rows = points_in(df.select(*keys, at, tie, "acc"), sets, keys, at, ("set_start", "set_end"), width, closed=False)
    reps = mark_peaks(rows, [*group, "set_no"], [at, tie], "acc").groupBy(*group, "set_no").agg(F.sum("peak").alias("reps"))
    return sets.join(reps, [*group, "set_no"], "left").withColumn("reps", F.coalesce("reps", F.lit(0)))


def _in_order(at: str, tie: str, **values: Column) -> Column:
    """The rows of a window, sorted by time: means that meet a threshold exactly depend on the order of their sum."""
    return F.array_sort(F.collect_list(F.struct(at, tie, *[c.alias(n) for n, c in values.items()]))).alias("_rows")


def _mean_in_order(name: str) -> Column:
    rows = F.col("_rows")
    return F.aggregate(rows, F.lit(0.0), lambda total, r: total + F.coalesce(r[name], F.lit(0.0))) / F.nullif(F.size(F.filter(rows, lambda r: r[name].isNotNull())), F.lit(0))


def window_stats(df: DataFrame, keys: Sequence[str], at: str, tie: str, totals: DataFrame, size: float = 1.5, stride: float = 0.75, min_each: int = 3, width: float = SECONDS) -> DataFrame:
    """Fourteen statistics per sliding window; windows start before the recording ends."""
    rows = index_rows(df, keys, [at, tie], lag=["acc"], width=width).withColumns(
        {"_jerk": F.coalesce(F.abs(F.col("acc") - F.col("lag_acc")), F.lit(0.0)), "_hg": magnitude(F.col("ax"), F.col("ay"))}
    )
    wins = into_windows(rows, at, size, stride).join(totals, list(keys)).filter(F.col("k") * stride < F.col("total_sec"))
    return wins.groupBy(*keys, "k").agg(
        F.count(F.lit(1)).alias("n"), F.avg("acc").alias("acc_mean"), F.stddev_samp("acc").alias("acc_std"), F.avg("gyro").alias("gyro_mean"), F.max("gyro").alias("gyro_max"),
        F.lit(None).cast("double").alias("az_mean"), F.stddev_samp("az").alias("az_std"), F.avg("ax").alias("ax_mean"), F.avg("ay").alias("ay_mean"), F.lit(None).cast("double").alias("ay_abs_mean"),
        F.avg("_hg").alias("horiz_g_mean"), F.stddev_samp("angle_x").alias("angle_x_std"), F.stddev_samp("angle_y").alias("angle_y_std"), F.avg("angle_y").alias("angle_y_mean"), F.avg("_jerk").alias("jerk_mean"),
        _in_order(at, tie, az=F.col("az").cast("double"), ay=F.abs("ay").cast("double")),
    ).filter(F.col("n") >= min_each).withColumns({"az_mean": _mean_in_order("az"), "ay_abs_mean": _mean_in_order("ay")}).drop("_rows")


def window_features(df: DataFrame, keys: Sequence[str], at: str, tie: str, totals: DataFrame, size: float = 2.0, stride: float = 0.5, slack: float = 0.01, frequency: bool = False) -> DataFrame:
    """Feature vector per sliding window that ends inside the recording.

    ``totals`` has (keys, total_sec, fs).  A window needs max(5, fs // 2) rows.  With
    ``frequency`` the dominant frequency and the periodic score are added.
    """
    # Neighbours are taken once per row, before rows are copied into their windows; one that
    # lies outside a window does not count there.
    near = index_rows(df, keys, [at, tie], lag=["angle_x", "acc", at], lead=["acc", at])
    inside = F.col("k") * stride + F.lit(float(size)) <= F.col("total_sec") + slack
    wins = into_windows(near, at, size, stride).join(totals, list(keys)).filter(inside)
    before = F.col(f"lag_{at}") >= F.col("k") * stride
    after = F.col(f"lead_{at}") < F.col("k") * stride + F.lit(float(size))
    level = wins.groupBy(*keys, "k").agg(F.avg("acc").alias("_m"), F.stddev_pop("acc").alias("_sd"))
    rows = wins.join(level, [*keys, "k"]).withColumns(
        {"_z": circular_distance(F.col("angle_z"), 180.0), "_dx": F.when(before, F.abs(F.col("angle_x") - F.col("lag_angle_x")))}
    )
    higher = before & after & (F.col("acc") > F.col("lag_acc")) & (F.col("acc") > F.col("lead_acc"))
    top = (F.col("acc") - F.col("_m") > F.col("_sd") * 0.3) & higher
    aggs = [
        F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("tilt_mean"), F.stddev_pop("_z").alias("tilt_std"), (F.max("_z") - F.min("_z")).alias("tilt_range"),
        F.coalesce(F.avg("_dx"), F.lit(0.0)).alias("drift_mean"),
        F.abs(F.max_by("angle_y", F.struct(at, tie)) - F.min_by("angle_y", F.struct(at, tie))).alias("turn"),
        F.avg("acc").alias("acc_mean"), F.stddev_pop("acc").alias("acc_std"), F.avg("gyro").alias("gyro_mean"), F.stddev_pop("gyro").alias("gyro_std"),
        F.var_pop("az").alias("vertical_energy"), F.count_if(top).alias("peak_count"), F.any_value("fs").alias("fs"),
        _in_order(at, tie, z=F.col("_z"), **({"acc": F.col("acc")} if frequency else {})),
    ]
    out = rows.groupBy(*keys, "k").agg(*aggs).filter(F.col("n") >= F.greatest(F.lit(5), F.floor(F.col("fs") / 2)))
    out = out.withColumn("tilt_mean", _mean_in_order("z"))
    if frequency:
        out = out.withColumn("_f", periodicity(F.transform("_rows", lambda s: s["acc"]), F.col("fs"), 8, 1.0)).withColumns(
            {"dominant_freq": F.col("_f.freq"), "periodic_score": F.col("_f.score")}
        ).drop("_f")
    return out.drop("fs", "_rows")


def window_signal(df: DataFrame, keys: Sequence[str], at: str, tie: str, value: str, size: float, stride: float) -> DataFrame:
    """The ordered samples of each sliding window as an array (bounded by rate times size)."""
    wins = into_windows(df.select(*keys, at, tie, value), at, size, stride)
    return wins.groupBy(*keys, "k").agg(F.transform(F.array_sort(F.collect_list(F.struct(at, tie, value))), lambda s: s[value]).alias("signal"))


def posture_windows(
    df: DataFrame, keys: Sequence[str], at: str, tie: str, baseline: DataFrame, rate: float, size: float = 2.0, stride: float = 0.5, low_pass: float = 0.6, forward: str | None = None, right: str | None = None, lead_in: float = 2.0, width: float = SECONDS
) -> DataFrame:
    """Posture of each sliding window by the torso's tilt against the upright ``baseline`` (keys, baseline).

    Gravity is the centred mean of the acceleration over ``low_pass`` seconds; motion is the spread of what is left.
    The rhythm is that of 0.55 z(linear acceleration) + 0.45 z(tilt) within the window.  Chest and
    side scores are the direction of gravity along the body axes, NULL where an axis is not given; the drift of angle_x
    counts from its circular mean over the first ``lead_in`` seconds.  Only windows that end inside the recording are rated.
    """
    axes = ("ax", "ay", "az")
    rows = moving_average(df.select(*keys, at, tie, *axes, "gyro", "angle_z", "angle_x"), keys, [at, tie], axes, max(3, int(low_pass * rate)), width=width)
    start = rows.filter(F.col(at) < lead_in).groupBy(*keys).agg(circular_mean(F.col("angle_x")).alias("_x0"))
    ends = rows.groupBy(*keys).agg(F.max(at).alias("_end"))
    rows = rows.join(baseline.select(*keys, "baseline"), list(keys)).select(
        *keys, at, tie, "gyro", "angle_z", "angle_x", "g_ax", "g_ay", "g_az", "baseline", magnitude(*[F.col(a) - F.col(f"g_{a}") for a in axes]).alias("_lin"), circular_distance(F.col("angle_z"), F.col("baseline")).alias("_tilt")
    )
    wins = into_windows(rows, at, size, stride).groupBy(*keys, "k").agg(
        F.count(F.lit(1)).alias("n"), F.first("baseline").alias("baseline"), circular_mean(F.col("angle_z")).alias("_z"), circular_mean(F.col("angle_x")).alias("_x"), *[F.avg(f"g_{a}").alias(f"_{a}") for a in axes],
        F.stddev_pop("_lin").alias("motion"), F.coalesce(F.avg("gyro"), F.lit(0.0)).alias("gyro_mean"), F.avg("_lin").alias("_lm"), F.avg("_tilt").alias("_tm"), F.stddev_pop("_tilt").alias("_ts"),
        F.array_sort(F.collect_list(F.struct(F.col(at), F.col(tie), F.col("_lin"), F.col("_tilt")))).alias("_rows"),
    )

    def z(x: Column, mean: str, sd: str) -> Column:
        return F.when(F.col(sd) < 1e-6, 0.0).otherwise((x - F.col(mean)) / F.col(sd))

    wins = wins.join(start, list(keys), "left").join(ends, list(keys)).filter((F.col("n") >= 5) & (F.col("k") * stride + F.lit(float(size)) <= F.col("_end") + 1.0 / rate))
    signal = F.transform("_rows", lambda r: 0.55 * z(r["_lin"], "_lm", "motion") + 0.45 * z(r["_tilt"], "_tm", "_ts"))
    wins = wins.withColumn("_f", periodicity(signal, F.lit(float(rate))))
    norm = F.sqrt(F.col("_ax") ** 2 + F.col("_ay") ** 2 + F.col("_az") ** 2)

    def along(axis: str | None) -> Column:
        if axis is None:
            return F.lit(None).cast("double")
        return sum((unit_axis(F.lit(axis))[i] * F.col(f"_{a}") / norm for i, a in enumerate(axes)), F.lit(0.0))

    tilt, drift = circular_distance(F.col("_z"), F.col("baseline")), F.abs(circular_delta(F.col("_x"), F.col("_x0")))
    label, conf, rule = tilt_posture(tilt, along(forward), along(right), F.col("motion"), F.col("gyro_mean"), F.col("_f.score"), F.col("_f.freq"), drift)
    return wins.select(
        *keys, "k", label.alias("posture"), conf.alias("confidence"), rule.alias("rule"), tilt.alias("tilt"), drift.alias("drift"), "motion", "gyro_mean", F.col("_f.freq").alias("freq"), F.col("_f.score").alias("score"), F.col("_f.period").alias("period"), F.col("_f.reps").alias("reps")
    )


def flow_periodicity(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int = 20, min_lag: int = 2, width: float = SECONDS) -> DataFrame:
    """Autocorrelation per window of ``size`` rows, half overlapping: period in rows and strength."""
    step = max(1, size // 2)
    rows = index_rows(df.select(*keys, *order, value), keys, order, total=True, width=width)
    p = F.col("pos") - 1
    first = F.greatest(F.lit(0).cast("long"), F.floor((p - size) / step) + 1)
    spread = rows.withColumn("w", F.explode(F.sequence(first, F.floor(p / step)))).filter(
        (F.col("w") * step < F.col("n_rows") - size) & (p < F.col("w") * step + size)
    )
    sig = spread.groupBy(*keys, "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias("s"), F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"))
    c = F.transform("s", lambda x: x - F.col("m"))

    def product(lag: Column | int) -> Column:
        n = F.size("c") - lag
        return F.aggregate(F.zip_with(F.slice("c", 1, n), F.slice("c", F.lit(1) + lag, n), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)

    max_lag = min(size // 2, size - 1)
    scored = sig.withColumn("c", c).withColumn("z", product(F.lit(0)) + F.lit(1e-8)).withColumn(
        "ac", F.transform(F.sequence(F.lit(min_lag), F.lit(max_lag)), lambda lag: F.struct((product(lag) / F.col("z")).alias("v"), (-lag).alias("l")))
    )
    peak, flat = F.array_max("ac"), F.col("sd") < 0.1
    strong = ~flat & (peak["v"] > 0.3)
    return scored.select(
        *keys, "w", (F.col("w") * step).alias("first_row"), strong.alias("periodic"), F.when(strong, -peak["l"]).alias("period_rows"), F.when(flat, 0.0).otherwise(peak["v"]).alias("strength")
    )


def row_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, value: str, direction: str, energy: str, at: str, width: float = SECONDS) -> DataFrame:
    """Mean, peak and main direction of every ``size`` consecutive rows."""
    rows = index_rows(df, keys, order, width=width).withColumn("chunk", F.floor((F.col("pos") - 1) / size))
    sums = rows.groupBy(*keys, "chunk").agg(F.min(at).alias("start_sec"), F.max(at).alias("end_sec"), F.avg(value).alias("avg_flow"), F.max(energy).alias("max_energy"))
    main = mode_first(rows, [*keys, "chunk"], direction, ["pos"]).drop("votes")
    return sums.join(main, [*keys, "chunk"]).withColumn("level", ladder(F.col("avg_flow"), FLOW))


def flow_overview(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, direction: str, energy: str, width: float = SECONDS) -> DataFrame:
    """Means per group and whether the direction flips often (over 30 % of its rows)."""
    rows = index_rows(df.select(*keys, *order, value, direction, energy), keys, order, lag=[direction], width=width)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_flow"), F.avg(energy).alias("avg_energy"),
        F.count_if(F.col(f"lag_{direction}").isNotNull() & (F.col(direction) != F.col(f"lag_{direction}"))).alias("reversals"),
    )
    return out.withColumn("reciprocating", F.col("reversals") > F.col("n") * 0.3)


def row_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, stride: int, width: float = SECONDS) -> DataFrame:
    """One row per (row, window) for windows of ``size`` rows every ``stride`` rows; a last
    window that does not fit is left out, except that a short recording has one."""
    rows = index_rows(df, keys, order, total=True, width=width)
    p = F.col("pos") - 1
    first = F.greatest(F.lit(0).cast("long"), F.floor((p - size) / stride) + 1)
    fits = (F.col("k") == 0) | (F.col("k") * stride + size <= F.col("n_rows"))
    return rows.withColumn("k", F.explode(F.sequence(first, F.floor(p / stride)))).filter(fits & (p >= F.col("k") * stride) & (p < F.col("k") * stride + size))


def upright_baseline(wins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upright angle per recording from stable windows near 180 degrees, if there are three."""
    stats = wins.groupBy(*keys, "k").agg(F.avg("acc").alias("_a"), F.stddev_pop("acc").alias("_s"), F.avg("gyro").alias("_g"), circular_mean(F.col("angle_z")).alias("_z"))
    stable = (F.abs(F.col("_a") - 1.0) < 0.15) & (F.col("_s") < 0.10) & (F.col("_g") < 25.0) & (circular_distance(F.col("_z"), 180.0) < 25.0)
    out = stats.groupBy(*keys).agg(F.count_if(stable).alias("candidates"), circular_mean(F.when(stable, F.col("_z"))).alias("_b"))
    enough = F.col("candidates") >= 3
    return out.select(*keys, "candidates", F.when(enough, F.col("_b")).otherwise(180.0).alias("baseline"), F.when(enough, "stable_windows_near_180").otherwise("default_180").alias("source"))


def clock_offset(samples: DataFrame, truth: DataFrame, keys: Sequence[str], at: str, end: str, per: Sequence[str] = ()) -> DataFrame:
    """Video end minus sensor duration, per recording and, if the videos have more keys, per those."""
    a = samples.groupBy(*keys).agg(F.max(at).alias("_s"))
    b = truth.groupBy(*keys, *per).agg(F.max(end).alias("_v"))
    return a.join(b, list(keys)).select(*per, *keys, (F.col("_v") - F.col("_s")).alias("offset_sec"))


def shifted_stats(samples: DataFrame, segments: DataFrame, offsets: DataFrame, keys: Sequence[str], seg_id: str, at: str, width: float) -> DataFrame:
    """Segments moved to video time, with rotation, az and acceleration spread (0 when empty)."""
    rows = points_in(samples.select(*keys, at, "gyro", "az", "acc"), segments.select(*keys, seg_id, "start_sec", "end_sec"), keys, at, ("start_sec", "end_sec"), width, closed=False)
    stats = rows.groupBy(*keys, seg_id).agg(F.avg("gyro").alias("gyro_mean"), F.avg("az").alias("az_mean"), F.stddev_samp("acc").alias("acc_std"))
    out = segments.join(offsets, list(keys)).join(stats, [*keys, seg_id], "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("gyro_mean", "az_mean")}
    return out.withColumns({"video_start": F.col("start_sec") + F.col("offset_sec"), "video_end": F.col("end_sec") + F.col("offset_sec"), **zero})


def truth_seconds(value: Column, first: Column, offset: Column) -> Column:
    """Sensor seconds of a ground-truth time: a number as is, else an ISO time (its zone
    dropped, not converted) minus the recording's first time, else the stored offset."""
    local = F.regexp_replace(value, r"(Z|[+-]\d{2}:?\d{2})$", "")
    stamp = F.try_to_timestamp(F.regexp_replace(local, "T", " ")).cast("timestamp")
    return F.coalesce(value.try_cast("double"), (F.unix_micros(stamp) - F.unix_micros(first.cast("timestamp"))) / 1e6, offset)


def clip_interval(start: Column, end: Column, total: Column) -> tuple[Column, Column]:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(start, total)), F.greatest(zero, F.least(end, total))


def axis_profile(df: DataFrame, keys: Sequence[str], at: str, peaks: DataFrame | None = None) -> DataFrame:
    """Axis with the largest variance, its share, and the angle ranges per group."""
    v = df.groupBy(*keys).agg(F.var_pop("ax").alias("x"), F.var_pop("ay").alias("y"), F.var_pop("az").alias("z"), (F.max("angle_x") - F.min("angle_x")).alias("angle_x_range"), (F.max("angle_y") - F.min("angle_y")).alias("angle_y_range"))
    top = F.greatest("x", "y", "z")
    axis = F.when(F.col("x") == top, "x").when(F.col("y") == top, "y").otherwise("z")
    return v.select(*keys, axis.alias("main_axis"), ratio(top, F.col("x") + F.col("y") + F.col("z")).alias("axis_share"), "angle_x_range", "angle_y_range")


def peak_rhythm(peaks: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """Mean and population spread of the time between consecutive peaks."""
    rows = index_rows(peaks.select(*keys, at, tie), keys, [at, tie], lag=[at])
    gap = F.col(at) - F.col(f"lag_{at}")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("peaks"), F.avg(gap).alias("mean_gap"), F.stddev_pop(gap).alias("std_gap"))


def frame_motion(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Absolute change from the previous row; 0 for the first row and beside a missing one."""
    rows = index_rows(df, keys, order, lag=[value])
    return rows.withColumn("motion", F.coalesce(F.abs(F.col(value) - F.col(f"lag_{value}")), F.lit(0.0))).drop(f"lag_{value}", "pos")
