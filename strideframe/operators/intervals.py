"""Interval and point-in-interval joins.

A range predicate alone would be a nested loop over all pairs of a recording.
Both sides are spread over time buckets and meet on (keys, bucket); a pair that
shares several buckets is emitted only in the bucket where its overlap starts, so
no distinct is needed.  The width is a parameter in the unit of the columns;
about the usual interval length is a good choice.  It changes cost, not results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.operators.keyed import pick_first
from strideframe.operators.sequence import fill_last


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the common part, never negative."""
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def _bucket(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(float(width)))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: float,
) -> DataFrame:
    """All (left, right) pairs of one key whose intervals share more than a point.

    Column names other than the keys must differ between the two sides.
    """
    (ls, le), (rs, re_) = left_span, right_span
    lx = left.filter(F.col(le) > F.col(ls)).withColumn(
        "_bk", F.explode(F.sequence(_bucket(F.col(ls), width), _bucket(F.col(le), width)))
    )
    rx = right.filter(F.col(re_) > F.col(rs)).withColumn(
        "_bk", F.explode(F.sequence(_bucket(F.col(rs), width), _bucket(F.col(re_), width)))
    )
    home = F.col("_bk") == _bucket(F.greatest(F.col(ls), F.col(rs)), width)
    meets = F.least(F.col(le), F.col(re_)) > F.greatest(F.col(ls), F.col(rs))
    return lx.join(rx, [*keys, "_bk"]).filter(home & meets).drop("_bk")


def points_in(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    at: str,
    span: tuple[str, str],
    width: float,
    *,
    pad: float = 0.0,
    closed: bool = True,
) -> DataFrame:
    """Pairs of a point and an interval that holds it, after widening by ``pad``.

    The interval is closed at both ends, or half-open when ``closed`` is false.
    """
    s, e = F.col(span[0]) - F.lit(float(pad)), F.col(span[1]) + F.lit(float(pad))
    sx = spans.filter(e >= s).withColumn("_bk", F.explode(F.sequence(_bucket(s, width), _bucket(e, width))))
    px = points.withColumn("_bk", _bucket(F.col(at), width))
    inside = (F.col(at) >= s) & ((F.col(at) <= e) if closed else (F.col(at) < e))
    return px.join(sx, [*keys, "_bk"]).filter(inside).drop("_bk")


def label_by_overlap(
    windows: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    window: tuple[str, str],
    interval: tuple[str, str],
    label: str,
    order: str,
    width: float,
    *,
    window_keys: Sequence[str],
    threshold: float = 0.6,
    out: str = "interval_label",
) -> DataFrame:
    """Label of the interval that covers a window most, if it covers ``threshold`` of it.

    Equal overlaps go to the interval that comes first by ``order``.  Windows with no
    such interval are dropped.
    """
    ws, we = window
    right = intervals.select(
        *keys,
        F.col(interval[0]).alias("_is"),
        F.col(interval[1]).alias("_ie"),
        F.col(label).alias(out),
        F.col(order).alias("_ord"),
    )
    pairs = overlap_join(windows, right, keys, window, ("_is", "_ie"), width).withColumn(
        "_ov", overlap_seconds(F.col(ws), F.col(we), F.col("_is"), F.col("_ie"))
    )
    best = pick_first(pairs, [*keys, *window_keys], [F.col("_ov").desc(), "_ord"])
    enough = F.col("_ov") / (F.col(we) - F.col(ws)) >= threshold
    return best.filter(enough).withColumn("overlap", F.col("_ov")).drop("_is", "_ie", "_ord", "_ov")


def nearest_in_time(
    targets: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    target_at: str,
    row_at: str,
    tie: str,
    reach: float,
    *,
    target_keys: Sequence[str],
) -> DataFrame:
    """For each target, the row nearest in time within ``reach``; the earlier tie wins."""
    pairs = points_in(
        rows,
        targets.withColumn("_t", F.col(target_at)),
        keys,
        row_at,
        ("_t", "_t"),
        max(reach, 1e-9),
        pad=reach,
    )
    gap = F.abs(F.col(row_at) - F.col("_t"))
    return pick_first(pairs, [*keys, *target_keys], [gap, row_at, tie]).drop("_t")


def asof_nearest(
    targets: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    payload: Sequence[str],
) -> DataFrame:
    """For each target, the row nearest in time however far; the earlier one wins a tie.

    Both sides carry ``at``.  They are put in one order and each target looks at the
    closest row before and after it, so nothing is paired that is not a neighbour.
    """
    first = pick_first(rows, [*keys, at], [tie]).select(*keys, at, F.struct(at, *payload).alias("_row"))
    goals = targets.withColumn("_goal", F.lit(True))
    both = goals.unionByName(first, allowMissingColumns=True).withColumn("_kind", F.col("_goal").isNotNull().cast("int"))
    seen = fill_last(both, keys, [at, "_kind"], ["_row"]).filter(F.col("_goal"))
    before, after = F.col("prev__row"), F.col("next__row")
    take_after = before.isNull() | (F.abs(after[at] - F.col(at)) < F.abs(F.col(at) - before[at]))
    chosen = seen.withColumn("_pick", F.when(after.isNotNull() & take_after, after).otherwise(before))
    return chosen.select(*targets.columns, F.col(f"_pick.{at}").alias(f"row_{at}"), *[F.col(f"_pick.{c}").alias(c) for c in payload])


def sliding_windows(at: Column, size: float, stride: float, first: int = 0) -> Column:
    """Indices ``k`` of the windows ``[k*stride, k*stride + size)`` that hold a time."""
    lo = F.greatest(F.lit(first).cast("long"), F.floor((at - F.lit(float(size))) / F.lit(float(stride))) + 1)
    hi = F.floor(at / F.lit(float(stride)))
    return F.sequence(lo, hi)


def into_windows(df: DataFrame, at: str, size: float, stride: float, out: str = "k") -> DataFrame:
    """One row per (row, window); each row is in about ``size / stride`` windows."""
    lo_hi = sliding_windows(F.col(at), size, stride)
    exact = (F.col(at) >= F.col(out) * stride) & (F.col(at) < F.col(out) * stride + size)
    return df.filter(F.col(at) >= 0).withColumn(out, F.explode(lo_hi)).filter(exact)


def cover_windows(total: Column, size: float, overlap: float) -> Column:
    """Start index list of windows of ``size`` that overlap by ``overlap`` and cover ``total``.

    Stops at the first window that reaches the end.
    """
    step = float(size - overlap)
    n = F.when(total <= 0, F.lit(0)).otherwise(F.ceil(F.greatest(F.lit(0.0), total - F.lit(float(size))) / F.lit(step)) + 1)
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
