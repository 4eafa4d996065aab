"""Aggregations whose built-in form is ambiguous, or unbounded on a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den`` with a default for an empty denominator."""
    return F.when((den == 0) | den.isNull(), F.lit(default)).otherwise(num.cast("double") / den.cast("double"))


def weighted_mean(x: Column, w: Column) -> Column:
    """Aggregate: weighted mean, 0 for no weight."""
    return ratio(F.sum(x * w), F.sum(w))


def circular_mean(deg: Column) -> Column:
    """Aggregate: mean direction in degrees."""
    rad = F.radians(deg)
    return F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad))))


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count and share of each value in its group."""
    if not keys:
        return distribution(df.withColumn("_all", F.lit(1)), ["_all"], value).drop("_all")
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return counts.join(totals, list(keys)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def mode_first(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Most frequent value per key; the one seen first wins a tie."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct(*order)).alias("_seen"))
    rank = F.struct((-F.col("votes")).alias("v"), F.col("_seen").alias("s"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(F.col(value), F.col("votes")), rank).alias("_m")).select(
        *keys, F.col(f"_m.{value}").alias(value), F.col("_m.votes").alias("votes")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], bins: int = 1024
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, without holding a key in one task.

    ``percentile`` keeps every distinct value of a group in one buffer.  This counts
    values in ``bins`` equal ranges per key, finds the ranges that hold the wanted
    ranks, and sorts only the distinct values of those ranges.
    """
    if not keys:
        whole = exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, quantiles, bins)
        return whole.drop("_all")
    keys = list(keys)
    v = F.col(value).cast("double")
    data = df.filter(F.col(value).isNotNull()).select(*keys, v.alias("_v"))
    spans = data.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(F.col("_hi") <= F.col("_lo"), F.lit(0).cast("long")).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1).cast("long"))
    )
    placed = data.join(spans, keys).withColumn("_slot", slot)
    counts = placed.groupBy(*keys, "_n", "_slot").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), pick((F.col("_n") - 1) * F.lit(p)).cast("long").alias("rank"))
            for name, p in quantiles.items()
            for side, pick in (("lo", F.floor), ("hi", F.ceil))
        ]
    )
    targets = (
        ranked.withColumn("_w", F.explode(wanted))
        .filter((F.col("_w.rank") >= F.col("_before")) & (F.col("_w.rank") < F.col("_before") + F.col("_c")))
        .select(*keys, "_slot", "_before", F.col("_w.q").alias("_q"), F.col("_w.side").alias("_side"), F.col("_w.rank").alias("_rank"))
    )
    slots = targets.select(*keys, "_slot", "_before").distinct()
    # only rows of wanted slots are counted and shuffled
    values = placed.select(*keys, "_slot", "_v").join(slots, [*keys, "_slot"]).groupBy(*keys, "_slot", "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
    inner = Window.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    inside = values.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_c").over(inner), F.lit(0))).drop("_before")
    hit = inside.join(targets.drop("_before"), [*keys, "_slot"]).filter(
        (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_c"))
    )
    outs = []
    for name in quantiles:
        lo = F.max(F.when((F.col("_q") == name) & (F.col("_side") == "lo"), F.col("_v")))
        hi = F.max(F.when((F.col("_q") == name) & (F.col("_side") == "hi"), F.col("_v")))
        outs += [lo.alias(f"_lo_{name}"), hi.alias(f"_hi_{name}")]
    found = hit.groupBy(*keys).agg(*outs)
    withn = found.join(spans.select(*keys, "_n"), keys)
    result = []
    for name, p in quantiles.items():
        at = (F.col("_n") - 1) * F.lit(p)
        part = at - F.floor(at)
        result.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * part).alias(name))
    return withn.select(*keys, *result)


def count_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per column that are NULL, blank text, or an empty array or map."""
    from strideframe.functions.text import is_empty

    row = df.agg(*[F.count_if(is_empty(df, c)).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return row.selectExpr(f"stack({len(columns)}, {pairs}) as (field, n_empty)")
