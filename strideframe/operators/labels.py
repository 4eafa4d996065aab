"""Label sequences: smoothing, run repair, consolidation, and segments from windows.

Input rows carry keys, an order and a label.  Everything works on runs of equal
labels found by :func:`index_rows`; run tables are ordered by run number, cut every
``ROWS`` runs, so no key is ever sorted whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.operators.ranges import scan_rows
from strideframe.operators.sequence import ROWS, SECONDS, frame, index_rows
from strideframe.operators.stats import exact_quantiles, ratio


def first_mode(values: Column) -> Column:
    """Most frequent element of an array; the one that appears first wins a tie."""
    scored = F.transform(
        F.array_distinct(values),
        lambda x: F.struct(
            F.size(F.filter(values, lambda y: y == x)).alias("n"), (-F.array_position(values, x)).alias("p"), x.alias("v")
        ),
    )
    return F.array_max(scored)["v"]


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float | None, label: str | None = None) -> DataFrame:
    """Positions (and run numbers) over sampled ranges, or over blocks of ``width`` where the caller knows the density."""
    return scan_rows(df, keys, order, label=label) if width is None else index_rows(df, keys, order, label=label, width=width)


def smooth_mode(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, k: int, out: str = "smooth", width: float | None = None) -> DataFrame:
    """Majority label of the ``k`` rows on either side; the first and last ``k`` rows stay."""
    voted = frame(
        _placed(df, keys, order, width), keys, "pos", k, k,
        lambda w: {"_near": F.collect_list(label).over(w.rowsBetween(-k, k)), "_n": F.count(F.lit(1)).over(w.rowsBetween(-k, k))},
    )
    inner = F.col("_n") == 2 * k + 1
    return voted.withColumn(out, F.when(inner, first_mode(F.col("_near"))).otherwise(F.col(label))).drop("_near", "_n", "pos")


def _run_table(indexed: DataFrame, keys: Sequence[str], label: str, *aggs: Column) -> DataFrame:
    return indexed.groupBy(*keys, "run_id").agg(
        F.any_value(label).alias(label), F.count(F.lit(1)).alias("run_len"), F.min("pos").alias("from_pos"), F.max("pos").alias("to_pos"), *aggs
    )


def fill_short_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, min_run: int = 2, out: str = "filled", width: float | None = None) -> DataFrame:
    """A run shorter than ``min_run`` takes its neighbours' common label, else the longer
    neighbour's (the earlier on a tie), else the only neighbour's.  Neighbours are original runs."""
    indexed = _placed(df, keys, order, width, label)
    runs = _run_table(indexed, keys, label)
    near = index_rows(runs.select(*keys, "run_id", label, "run_len"), keys, ["run_id"], lag=[label, "run_len"], lead=[label, "run_len"], width=ROWS)
    prev, nxt = F.col(f"lag_{label}"), F.col(f"lead_{label}")
    pick = (
        F.when((prev == nxt) | (F.col("lag_run_len") >= F.col("lead_run_len")), prev)
        .when(prev.isNotNull() & nxt.isNotNull(), nxt)
        .otherwise(F.coalesce(prev, nxt, F.col(label)))
    )
    fixed = near.select(*keys, "run_id", F.when(F.col("run_len") >= min_run, F.col(label)).otherwise(pick).alias(out))
    return indexed.join(fixed, [*keys, "run_id"]).drop("run_id", "pos")


def bridge_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, confidence: str, other: str, max_gap: int, factor: float = 0.8, width: float | None = SECONDS) -> DataFrame:
    """An ``other`` run of at most ``max_gap`` rows between equal labels becomes that label."""
    indexed = index_rows(df, keys, order, label=label, width=width)
    runs = _run_table(indexed, keys, label, F.min_by(confidence, "pos").alias("first_conf"), F.max_by(confidence, "pos").alias("last_conf"))
    near = index_rows(
        runs.select(*keys, "run_id", label, "run_len", "first_conf", "last_conf"), keys, ["run_id"],
        lag=[label, "last_conf"], lead=[label, "first_conf"], width=ROWS,
    )
    hit = (F.col(label) == other) & (F.col("run_len") <= max_gap) & (F.col(f"lag_{label}") == F.col(f"lead_{label}"))
    patch = near.filter(hit).select(
        *keys, "run_id", F.col(f"lag_{label}").alias("_new"), (F.least("lag_last_conf", "lead_first_conf") * factor).alias("_conf")
    )
    out = indexed.join(patch, [*keys, "run_id"], "left")
    return out.withColumns(
        {"bridged": F.col("_new").isNotNull(), label: F.coalesce("_new", label), confidence: F.coalesce("_conf", confidence)}
    ).drop("_new", "_conf", "run_id", "pos")


def drop_isolated(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, confidence: str, other: str, min_run: int, support: int = 3, cap: float = 0.4, width: float | None = SECONDS) -> DataFrame:
    """A short run whose label does not occur within ``support`` rows of either side becomes ``other``."""
    indexed = index_rows(df, keys, order, label=label, width=width)
    runs = _run_table(indexed, keys, label).select(*keys, "run_id", label, "run_len", "from_pos", "to_pos")
    same = index_rows(runs, [*keys, label], ["from_pos"], lag=["to_pos"], lead=["from_pos"], width=ROWS)
    left = F.coalesce(F.col("from_pos") - F.col("lag_to_pos") <= support, F.lit(False))
    right = F.coalesce(F.col("lead_from_pos") - F.col("to_pos") <= support, F.lit(False))
    alone = same.filter((F.col(label) != other) & (F.col("run_len") < min_run) & ~(left | right)).select(*keys, "run_id", F.lit(True).alias("_alone"))
    out = indexed.join(alone, [*keys, "run_id"], "left")
    gone = F.coalesce("_alone", F.lit(False))
    return out.withColumns(
        {"dropped": gone, label: F.when(gone, other).otherwise(F.col(label)), confidence: F.when(gone, F.least(F.col(confidence), F.lit(cap))).otherwise(F.col(confidence))}
    ).drop("_alone", "run_id", "pos")


def consolidate(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, confidence: str, groups: DataFrame, min_rows: int = 5, factor: float = 0.8, width: float | None = SECONDS) -> DataFrame:
    """In each stretch of one visual group with several labels, the weighted winner takes all.

    ``groups`` has (label, grp, weight, preferred); labels without a group are left alone.
    Ties go to preferred labels, then raw counts, then the label seen first.
    """
    known = df.join(groups, label, "left")
    indexed = index_rows(known, keys, order, label="grp", width=width)
    votes = indexed.filter(F.col("grp").isNotNull()).groupBy(*keys, "run_id", label).agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("seen"), F.max(F.coalesce("weight", F.lit(1.0))).alias("w"), F.max(F.coalesce("preferred", F.lit(False))).alias("p")
    )
    rank = F.struct((F.col("n") * F.col("w")).alias("a"), F.col("p").alias("b"), F.col("n").alias("c"), (-F.col("seen")).alias("d"))
    won = votes.groupBy(*keys, "run_id").agg(F.max_by(label, rank).alias("_win"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    won = won.filter((F.col("_n") >= min_rows) & (F.col("_k") >= 2)).select(*keys, "run_id", "_win")
    out = indexed.join(won, [*keys, "run_id"], "left")
    changed = F.coalesce(F.col("_win") != F.col(label), F.lit(False))
    return out.withColumns(
        {"merged": changed, confidence: F.when(changed, F.col(confidence) * factor).otherwise(F.col(confidence)), label: F.coalesce("_win", label)}
    ).select(*df.columns, "merged")


def window_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, start: str, end: str, means: Sequence[str] = (), medians: Sequence[str] = (), width: float | None = SECONDS) -> DataFrame:
    """Runs of equal window labels as segments, with mean, population std and exact medians."""
    indexed = index_rows(df.select(*keys, *order, label, *{start, end, *means, *medians} - set(order)), keys, order, label=label, width=width)
    stats = [F.avg(c).alias(f"mean_{c}") for c in means] + [F.stddev_pop(c).alias(f"std_{c}") for c in means]
    segs = indexed.groupBy(*keys, "run_id").agg(
        F.any_value(label).alias(label), F.min(start).alias("start_sec"), F.max(end).alias("end_sec"), F.count(F.lit(1)).alias("windows"), *stats
    )
    for c in medians:
        med = exact_quantiles(indexed, [*keys, "run_id"], c, {f"median_{c}": 0.5})
        segs = segs.join(med, [*keys, "run_id"], "left")
    return segs.withColumn("duration_sec", F.col("end_sec") - F.col("start_sec"))


def chained_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, start: str, last_end: str, min_sec: float = 1.0, width: float | None = SECONDS) -> DataFrame:
    """Segments that end where the next label starts; the last one ends at ``last_end`` of its
    last row.  Shorter ones than ``min_sec`` are dropped (after numbering, neighbours keep their ends)."""
    need = list(dict.fromkeys([*keys, *order, label, start, last_end]))
    indexed = index_rows(df.select(*need), keys, order, label=label, lead=[start], width=width)
    segs = indexed.groupBy(*keys, "run_id").agg(
        F.any_value(label).alias(label), F.min(start).alias("start_sec"), F.max(F.coalesce(f"lead_{start}", last_end)).alias("end_sec")
    )
    return segs.withColumn("duration_sec", F.col("end_sec") - F.col("start_sec")).filter(F.col("duration_sec") >= min_sec)


def duration_shares(segments: DataFrame, keys: Sequence[str], label: str, duration: str, totals: DataFrame) -> DataFrame:
    """Seconds, share of the recording length and segment count per label.  ``totals`` has (keys, total_sec)."""
    sums = segments.groupBy(*keys, label).agg(F.sum(duration).alias("seconds"), F.count(F.lit(1)).alias("segments"))
    return sums.join(totals, list(keys)).withColumn("pct", ratio(F.col("seconds") * 100, F.col("total_sec"))).drop("total_sec")
