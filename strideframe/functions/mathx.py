"""Numeric, angular, box and vector expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Sensor axis names.
AXES = {"+X": (1.0, 0.0, 0.0), "-X": (-1.0, 0.0, 0.0), "+Y": (0.0, 1.0, 0.0), "-Y": (0.0, -1.0, 0.0), "+Z": (0.0, 0.0, 1.0), "-Z": (0.0, 0.0, -1.0)}


def fix(c: Column, digits: int = 6) -> Column:
    """Round half up on the binary value; for display and comparison only."""
    m = float(10**digits)
    return F.floor(c * m + 0.5) / F.lit(m)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression that is named several times is copied, and evaluated, as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def magnitude(*xs: Column) -> Column:
    total = None
    for x in xs:
        total = x * x if total is None else total + x * x
    return F.sqrt(total)


def clip(c: Column, lo: float, hi: float) -> Column:
    """NULL stays NULL (``least`` and ``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def wrap180(deg: Column) -> Column:
    """Signed angle in [-180, 180).

    The turn is added to every remainder, not only to negative ones, so that one within rounding of 360 becomes 0 whatever its sign.
    """
    turn = F.lit(360.0)
    return ((deg + F.lit(180.0)) % turn + turn) % turn - F.lit(180.0)


def circular_distance(a: Column, target: Column | float = 180.0) -> Column:
    t = F.lit(float(target)) if isinstance(target, (int, float)) else target
    return F.abs(wrap180(a - t))


def circular_delta(a: Column, base: Column) -> Column:
    return wrap180(a - base)


def trend_pct(cur: Column, prev: Column) -> Column:
    """Change in percent, 0 when there is no earlier value."""
    return F.when(F.coalesce(prev, F.lit(0.0)) == 0, F.lit(0.0)).otherwise((cur - prev) / prev * 100)


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def unit_axis(text: Column) -> Column:
    """Unit vector of an axis name such as ``+X``; NULL for an unknown name."""
    pairs = []
    for name, v in AXES.items():
        pairs += [F.lit(name), F.array(*[F.lit(x) for x in v])]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.trim(text)))


def box_center(b: Column) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def box_area(b: Column) -> Column:
    zero = F.lit(0)
    return (F.greatest(zero, b[2] - b[0]) * F.greatest(zero, b[3] - b[1])).cast("double")


def box_common(a: Column, b: Column) -> Column:
    zero = F.lit(0)
    w = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return (w * h).cast("double")


def box_iou(a: Column, b: Column) -> Column:
    common = box_common(a, b)
    union = box_area(a) + box_area(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def box_distance(a: Column, b: Column) -> Column:
    return center_distance(*box_center(a), b)


def center_distance(x: Column, y: Column, b: Column) -> Column:
    """Distance of a point from the centre of a box; each difference is computed once."""
    bx, by = box_center(b)
    return F.sqrt(F.aggregate(F.array(x - bx, y - by), F.lit(0.0), lambda s, d: s + d * d))


def box_inside(inner: Column, outer: Column, threshold: float = 0.6) -> Column:
    area = box_area(inner)
    return F.when(area > 0, box_common(inner, outer) / area >= threshold).otherwise(F.lit(False))
