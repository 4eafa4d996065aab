"""Order-dependent segment repair, cut into the smallest independent pieces.

Each step below depends on earlier decisions, but only between segments that touch or overlap, or through a value
that a neighbour hands on.  :mod:`decisions` cuts the rows into islands and settles small ones in arrays and
large ones by rounds, pointer doubling or composed maps; no task holds a recording.
Segments have ``start_sec <= end_sec``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.functions.mathx import let
from strideframe.functions.timex import sec_to_clock
from strideframe.operators import decisions
from strideframe.operators.chains import settle_chains
from strideframe.operators.intervals import overlap_join, points_in
from strideframe.operators.ranges import scan_rows
from strideframe.operators.sequence import ROWS, index_rows, running
from strideframe.session import written


def _clash(kept: Column, row: Column, share: float) -> Column:
    common = F.least(kept["end_sec"], row["end_sec"]) - F.greatest(kept["start_sec"], row["start_sec"])
    return common / F.greatest(row["end_sec"] - row["start_sec"], F.lit(1.0)) > share


def _swap_weaker(share: float):
    """Add a row that clashes with none; a more confident one takes the place of the first kept one that it clashes with."""

    def step(acc: Column, x: Column) -> Column:
        first = F.coalesce(F.array_position(F.transform(acc, lambda k: _clash(k, x, share)), True), F.lit(0))

        def placed(at: Column) -> Column:
            return F.when(at == 0, F.concat(acc, F.array(x))).otherwise(F.transform(acc, lambda k, i: F.when((i + 1 == at) & (x["confidence"] > k["confidence"]), x).otherwise(k)))

        # searched once a row; named in the inner lambda, it would be searched once for every kept row
        return let(first, placed)

    return step


def keep_first_overlaps(segments: DataFrame, keys: Sequence[str], order: Sequence[str], *, prefer_confident: bool = False, share: float = 0.5, most: int = decisions.MOST) -> DataFrame:
    """Drop a segment that overlaps an already kept one by more than ``share`` of its own
    length (at least 1 s).  With ``prefer_confident`` the newcomer's values replace the
    kept ones when its confidence is higher.  ``order`` is the arrival order, total in a key.

    Islands of overlapping segments above ``most`` rows are decided by rounds over their conflicts.
    With ``prefer_confident`` a decision also changes later conflicts, so such an island is one ordered pass of one task.
    """
    small, large, name = decisions.islands(segments, keys, "start_sec", "end_sec", tie=order, most=most)
    arrival, columns = [F.col(c) for c in order], segments.columns
    if prefer_confident:
        kept = decisions.fold_list(F.col("_rows"), _swap_weaker(share))
        out = decisions.unfolded(decisions.gathered(small, name, arrival, columns), kept, columns)
    else:
        out = decisions.first_kept(small, name, arrival, columns, lambda k, x: _clash(k, x, share))
    if large is None:
        return out
    if prefer_confident:

        def settle(rows: list[dict]) -> list[dict]:
            kept: list[dict] = []
            for row in rows:
                length = max(row["end_sec"] - row["start_sec"], 1.0)
                clash = next((k for k in kept if (min(row["end_sec"], k["end_sec"]) - max(row["start_sec"], k["start_sec"])) / length > share), None)
                if clash is None:
                    kept.append(row)
                elif row["confidence"] > clash["confidence"]:
                    clash.update(row)
            return kept

        return out.unionByName(settle_chains(large, name, order, settle, segments.schema))
    rows = large.withColumn("_id", F.struct(*keys, *order))
    spans = [rows.select(*name, F.col("_id").alias(i), F.struct(*order).alias(f"{i}o"), F.struct("start_sec", "end_sec").alias(f"{i}r"), F.col("start_sec").alias(f"{i}s"), F.col("end_sec").alias(f"{i}e")) for i in ("_a", "_b")]
    width = large.agg(F.avg(F.col("end_sec") - F.col("start_sec"))).first()[0] or 1.0
    pairs = overlap_join(*spans, name, ("_as", "_ae"), ("_bs", "_be"), width).filter((F.col("_ao") < F.col("_bo")) & _clash(F.col("_ar"), F.col("_br"), share))
    kept = decisions.first_kept_by_rounds(rows, pairs)
    return out.unionByName(rows.join(kept, "_id").select(*columns))


def snap_gaps(segments: DataFrame, keys: Sequence[str], tie: str, max_gap: float = 5.0, *, overlaps: bool = True) -> DataFrame:
    """Move a start to the previous end when they are at most ``max_gap`` apart.
    Overlapping starts are moved too, unless ``overlaps`` is false."""
    rows = index_rows(segments, keys, ["start_sec", tie], lag=["end_sec"])
    gap = F.col("start_sec") - F.col("lag_end_sec")
    near = (F.abs(gap) <= max_gap) if overlaps else (gap > 0) & (gap <= max_gap)
    return rows.withColumn("start_sec", F.when(F.coalesce(near, F.lit(False)), F.col("lag_end_sec")).otherwise(F.col("start_sec"))).select(*segments.columns)


def merge_chunks(segments: DataFrame, keys: Sequence[str], order: Sequence[str], tie: str) -> DataFrame:
    """Join the segment lists of overlapping chunks: first kept wins, then gaps are snapped."""
    return snap_gaps(keep_first_overlaps(segments, keys, order), keys, tie)


def merge_windows(segments: DataFrame, keys: Sequence[str], order: Sequence[str], tie: str, max_gap: float = 5.0) -> DataFrame:
    """Join window results: the more confident wins, then neighbours of equal state and
    equipment at most ``max_gap`` apart become one (lowest confidence), then gaps are snapped."""
    # Written once here (a checkpoint would compute it twice): the three ordered steps that follow would triple the plan before it.
    kept = written(keep_first_overlaps(segments, keys, order, prefer_confident=True)).withColumn("_same", F.struct(F.upper("state").alias("s"), F.coalesce("equipment", F.lit("")).alias("e")))
    rows = index_rows(kept, keys, ["start_sec", tie], lag=["_same", "end_sec"])
    opens = ~F.coalesce((F.col("_same") == F.col("lag__same")) & (F.col("start_sec") - F.col("lag_end_sec") <= max_gap), F.lit(False))
    marked = rows.select(*segments.columns, "pos", opens.cast("long").alias("_open"))
    grouped = running(marked, keys, ["pos"], {"_seg": ("sum", "_open")}, width=ROWS)
    first = [F.min_by(c, "pos").alias(c) for c in segments.columns if c not in {*keys, "end_sec", "confidence"}]
    merged = grouped.groupBy(*keys, "_seg").agg(*first, F.max_by("end_sec", "pos").alias("end_sec"), F.min("confidence").alias("confidence"))
    return snap_gaps(merged.select(*segments.columns), keys, tie, max_gap, overlaps=False)


def expand_boundaries(segments: DataFrame, keys: Sequence[str], order: Sequence[str], totals: DataFrame, block: int = decisions.BLOCK) -> DataFrame:
    """Grow exercise segments into their neighbours as their results ask.

    ``before_sec`` and ``after_sec`` hold the wanted growth; a neighbour shrinks to make
    room but never disappears, and edits cascade in order.  The first
    start and last end are clipped to [0, ``total_sec``].

    Ends grow by the neighbour's own end, so the start that a segment is pushed to is known from one neighbour.  From there it
    moves back, at most to the settled start ahead of it: ``start = min(pushed, max(pushed - before, start ahead))``, a
    clamp of the value handed on, which :func:`decisions.clamped` composes over blocks of any number.
    """
    before, after = F.coalesce("before_sec", F.lit(0.0)), F.coalesce("after_sec", F.lit(0.0))
    exercise = F.upper("state") == "EXERCISE"
    wanted = segments.withColumns({"_before": F.when(exercise, before).otherwise(0.0), "_after": F.when(exercise, after).otherwise(0.0)})
    rows = scan_rows(wanted, keys, order, lag=["end_sec", "_after"], lead=["end_sec"])

    def grown(end: Column, by: Column, limit: Column) -> Column:
        return F.when(by > 0, F.greatest(end, F.least(limit, end + by))).otherwise(end)

    reached = grown(F.col("lag_end_sec"), F.col("lag__after"), F.col("end_sec"))
    pushed = F.when(reached > F.col("lag_end_sec"), F.greatest("start_sec", reached)).otherwise(F.col("start_sec"))
    back = F.when((F.col("_before") > 0) & (F.col("pos") > 1), F.col("_pushed") - F.col("_before")).otherwise(F.col("_pushed"))
    ready = rows.withColumn("_pushed", pushed.cast("double")).withColumns({"_lo": back, "_end": F.coalesce(grown(F.col("end_sec"), F.col("_after"), F.col("lead_end_sec")), "end_sec")})
    kept = ["pos", "_pushed", "_lo", "_end", "lead_end_sec", *[c for c in segments.columns if c not in {*keys, "start_sec", "end_sec"}]]
    placed = decisions.clamped(ready.select(*keys, *kept), list(keys), "pos", "_lo", "_pushed", "_start", block)
    moved = placed.filter(F.col("_start") < F.col("_pushed")).select(*keys, (F.col("pos") - 1).alias("pos"), F.col("_start").alias("_cut"))
    joined = placed.join(moved, [*keys, "pos"], "left").join(totals, list(keys))
    end = F.least("_end", "_cut")  # skips a NULL
    return joined.withColumns(
        {
            "start_sec": F.when(F.col("pos") == 1, F.greatest(F.lit(0.0), F.col("_start"))).otherwise(F.col("_start")),
            "end_sec": F.when(F.col("lead_end_sec").isNull(), F.least(F.col("total_sec"), end)).otherwise(end),
        }
    ).select(*segments.columns)


def merge_steps(hits: DataFrame, keys: Sequence[str], at: str, kind: str, size: str, apart: float = 3.0, most: int = decisions.MOST) -> DataFrame:
    """Of same-kind hits closer than ``apart`` to the last kept one, keep the largest.

    Hits are taken by (``at``, ``kind``, ``size``).  A long run of close hits is a forest: the kept hit of the moment is followed by the first later one
    that is ``apart`` from it (a new one) or larger (in its place), and :func:`decisions.on_path` follows those links.
    """
    near = math.nextafter(apart, -math.inf)
    small, large, name = decisions.islands(hits, keys, at, at, near, tie=[kind, size], label=kind, most=most)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fresh = F.coalesce(x[at] - last[at] >= apart, F.lit(True))
        return F.when(fresh, F.concat(acc, F.array(x))).when(F.abs(x[size]) > F.abs(last[size]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc)

    kept = decisions.fold_list(F.col("_rows"), step)
    order, columns = [F.col(at), F.col(kind), F.col(size)], hits.columns
    out = decisions.unfolded(decisions.gathered(small, name, order, columns), kept, columns)
    if large is None:
        return out
    rows = scan_rows(large, name, [at, size])
    # within an island neighbours are less than ``apart`` from each other, so a new hit is less than twice that away
    later = rows.select(*name, F.col(at).alias("_at"), F.col("pos").alias("_p"), F.abs(size).alias("_s"))
    spans = rows.select(*name, "pos", F.col(at).alias("_from"), (F.col(at) + 2 * apart).alias("_to"), F.abs(size).alias("_mine"))
    fresh = F.col("_at") - F.col("_from") >= apart
    links = points_in(later, spans, name, "_at", ("_from", "_to"), 2 * apart).filter((F.col("_p") > F.col("pos")) & (fresh | (F.col("_s") > F.col("_mine"))))
    links = links.groupBy(*name, "pos").agg(F.min(F.struct("_p", fresh.alias("new"))).alias("_n"))
    links = links.select(F.struct(*name, "pos").alias("_id"), F.struct(*name, F.col("_n._p").alias("pos")).alias("_next"), F.col("_n.new").alias("_new"))
    ids = rows.withColumn("_id", F.struct(*name, "pos"))
    path = decisions.on_path(links, ids.filter("pos = 1"))
    replaced = links.filter("not _new").select("_id")
    return out.unionByName(ids.join(path, "_id").join(replaced, "_id", "left_anti").select(*columns))


def segment_kind(state):
    """exercise, rest or transition from a state text."""
    s = F.upper(state)
    return F.when(s == "EXERCISE", "exercise").when(s == "REST", "rest").otherwise("transition")


def result_fields(result) -> dict:
    """Set count, mean reps and name of a recognition result with ``sets`` of (reps)."""
    sets = result["sets"]
    n = F.coalesce(F.size(sets), F.lit(0))
    reps = F.aggregate(sets, F.lit(0.0), lambda a, s: a + F.coalesce(s["reps"], F.lit(0)).cast("double"))
    return {
        "sets_count": F.when(n > 0, n).otherwise(1),
        "reps_estimate": F.when(n > 0, F.rint(reps / n)).otherwise(0.0).cast("long"),
        "exercise_name": F.coalesce(F.nullif(result["exercise"], F.lit("")), F.nullif(result["equipment"], F.lit("")), F.lit("")),
    }


def with_clock(segments: DataFrame) -> DataFrame:
    return segments.withColumns({"start_time": sec_to_clock(F.col("start_sec")), "end_time": sec_to_clock(F.col("end_sec"))})


