"""Decisions that depend on earlier ones, without a whole key in one task.

Rows that can influence each other touch in time, so they are first cut into islands by one
range scan.  Nearly all islands are small: their rows are put into an array and settled there by
higher-order functions.  Islands above ``MOST`` rows take a distributed way:

* :func:`first_kept` decides by rounds over conflicts (a row wins if no undecided earlier
  rival is left);
* :func:`on_path` follows next-kept links by pointer doubling, log-many joins for any length;
* :func:`composed` composes the transition maps of blocks, then replays the blocks.

Intermediate tables are written, so a lost executor repeats one step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.operators.ranges import scan_islands
from strideframe.session import written

MOST, BLOCK = 128, 512


def islands(rows: DataFrame, keys: Sequence[str], start: str, end: str, gap: float = 0.0, *, tie: Sequence[str] = (), label: str | None = None, most: int = MOST) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Rows of small islands, rows of large ones (None if there are none), and the columns that name an island."""
    name = [*keys, *(["run_id"] if label else []), "_island"]
    numbered = scan_islands(rows, keys, start, end, gap, tie=tie, label=label, out="_island")
    large = written(numbered.groupBy(*name).count().filter(F.col("count") > most).select(*name))
    if large.isEmpty():
        return numbered, None, name
    same = [numbered[c].eqNullSafe(large[c]) for c in name]
    return numbered.join(large, same, "left_anti"), numbered.join(large, same, "left_semi"), name


def gathered(small: DataFrame, name: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row per island with ``_rows``, its rows as an array of structs in order."""
    row = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("_row"))
    return small.groupBy(*name).agg(F.sort_array(F.collect_list(row)).alias("_sorted")).select(*name, F.transform("_sorted", lambda r: r["_row"]).alias("_rows"))


def fold_list(rows: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold an array of structs into an array of the same kind; ``step`` gets the list so far and the next row."""
    return F.aggregate(rows, F.slice(rows, 1, 0), step)


def unfolded(lists: DataFrame, kept: Column, columns: Sequence[str], at: str = "_k") -> DataFrame:
    """The structs of the array ``kept`` as rows.

    ``F.explode`` would filter by the size of the array first, and Spark would fold it once more for that.
    """
    rows = lists.select(F.explode_outer(kept).alias("_k")).filter(F.col("_k").isNotNull())
    return rows.select(*[F.col(f"{at}.{c}").alias(c) for c in columns])


def first_kept(small: DataFrame, name: Sequence[str], order: Sequence[Column], columns: Sequence[str], conflict: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows of small islands that conflict with no kept row ahead of them in ``order``."""
    kept = fold_list(F.col("_rows"), lambda acc, x: F.when(F.exists(acc, lambda k: conflict(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return unfolded(gathered(small, name, order, columns), kept, columns)


def first_kept_by_rounds(ids: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The same decision for rows of any number: ``ids`` has ``_id``, ``conflicts`` has ``_a`` (ahead) and ``_b``.

    A round keeps every undecided row without an undecided rival ahead of it and drops those behind
    kept rows.  The number of rounds is the longest alternation of kept and dropped rows.
    """
    open_ids, rivals, kept = written(ids.select("_id")), written(conflicts.select("_a", "_b").distinct()), None
    while not open_ids.isEmpty():
        won = written(open_ids.join(rivals, F.col("_id") == F.col("_b"), "left_anti"))
        kept = won if kept is None else kept.unionByName(won)
        lost = rivals.join(won, F.col("_a") == F.col("_id"), "left_semi").select(F.col("_b").alias("_id")).distinct()
        gone = written(won.unionByName(lost))
        open_ids = written(open_ids.join(gone, "_id", "left_anti"))
        rivals = written(rivals.join(gone, F.col("_a") == F.col("_id"), "left_anti").join(gone, F.col("_b") == F.col("_id"), "left_anti"))
    return open_ids if kept is None else kept


def on_path(links: DataFrame, heads: DataFrame) -> DataFrame:
    """``_id`` of all rows that are reached from ``heads`` (``_id``) over links (``_id``, ``_next``), heads included.

    ``levels[k]`` leads 2**k links on; a row at any distance is reached by falling powers of
    two, so a chain of n rows takes log n joins, each over all chains at once.
    """
    levels = [written(links.filter("_next is not null").select("_id", "_next"))]
    while True:
        far = levels[-1].select(F.col("_id").alias("_next"), F.col("_next").alias("_far"))
        twice = written(levels[-1].join(far, "_next").select("_id", F.col("_far").alias("_next")))
        if twice.isEmpty():
            break
        levels.append(twice)
    reached = written(heads.select("_id"))
    for level in reversed(levels):
        reached = written(reached.unionByName(reached.join(level, "_id").select(F.col("_next").alias("_id"))))
    return reached


def composed(rows: DataFrame, keys: Sequence[str], pos: str, act: str, kind: str, compose: Callable[[Column, Column], Column], apply: Callable[[Column, Column], Column], out: str, block: int = BLOCK) -> DataFrame:
    """A value handed from row to row: ``out`` is ``apply(value ahead, act)`` over dense positions (from 1) of each key.

    ``act`` is what a row does to the value, and ``compose(first, then)`` is the act of two rows in turn,
    no larger than one of them.  A block of rows is folded to one act, the same recurrence runs over the blocks, which are
    ``block`` times fewer, and rows are replayed from the value that enters their block.  The first row of a key must not
    depend on the value ahead of it, which is NULL.  ``kind`` is the type of the value; ``before_<out>`` is the value ahead.
    """
    rest = [c for c in rows.columns if c not in {*keys, pos, act}]
    item = F.struct(F.col(pos).alias("p"), F.col(act).alias("act"), F.struct(F.lit(True).alias("_"), *rest).alias("rest"))
    blocks = rows.withColumn("_blk", F.floor((F.col(pos) - 1) / block) + 1).groupBy(*keys, "_blk").agg(F.array_sort(F.collect_list(item), lambda x, y: (x["p"] - y["p"]).cast("int")).alias("_rows"))
    whole = F.aggregate(F.slice("_rows", 2, block), F.col("_rows")[0]["act"], lambda a, x: compose(a, x["act"]))
    blocks = written(blocks.withColumn("_act", whole))
    if blocks.filter("_blk > 1").isEmpty():
        entered = blocks.withColumn("_in", F.lit(None).cast(kind))
    else:
        ends = composed(blocks.select(*keys, F.col("_blk").alias("_nth"), "_act"), keys, "_nth", "_act", kind, compose, apply, "_in", block)
        ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_nth") + 1).alias("_at"), "_in")
        entered = blocks.join(ends, [*[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_blk") == F.col("_at")], "left")
    made = F.aggregate("_rows", F.array(F.col("_in")), lambda acc, x: F.concat(acc, F.array(apply(F.element_at(acc, F.lit(-1)), x["act"]))))
    flat = entered.withColumn("_made", made).select(*keys, F.col("_made").alias("_m"), F.posexplode("_rows").alias("_i", "_r"))
    return flat.select(*keys, F.col("_r.p").alias(pos), F.col("_r.act").alias(act), *[F.col(f"_r.rest.{c}").alias(c) for c in rest], F.get("_m", F.col("_i")).alias(f"before_{out}"), F.get("_m", F.col("_i") + 1).alias(out))


def _clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(hi, F.greatest(lo, x))


def clamped(rows: DataFrame, keys: Sequence[str], pos: str, lo: str, hi: str, out: str, block: int = BLOCK) -> DataFrame:
    """The recurrence ``x[i] = min(hi[i], max(lo[i], x[i-1]))``; ``lo <= hi``, and the first row of a key has ``lo == hi``.

    Clamps compose to clamps.
    """
    # greatest and least skip the NULL ahead of the first row
    both = lambda a, x: F.struct(_clamp(a["lo"], x["lo"], x["hi"]).alias("lo"), _clamp(a["hi"], x["lo"], x["hi"]).alias("hi"))
    acts = rows.withColumn("_clamp", F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi")))
    return composed(acts, keys, pos, "_clamp", "double", both, lambda v, x: _clamp(v, x["lo"], x["hi"]), out, block).drop("_clamp", f"before_{out}")


def lit_masks(rows: DataFrame, keys: Sequence[str], pos: str, terms: str, out: str, block: int = BLOCK) -> DataFrame:
    """Which items of each row are lit, as a bit mask ``out``, when lit items of the row ahead light others.

    ``terms`` has one (``c``, ``m``) per item: it is lit if ``c``, or if an item of the row ahead whose bit is in
    ``m`` is lit.  These are matrices over (or, and), which compose; at most 63 items a row.
    """

    def compose(a: Column, x: Column) -> Column:
        def one(t: Column) -> Column:
            asked = F.transform(a, lambda v, k: F.struct(v["c"].alias("c"), v["m"].alias("m"), (F.call_function("shiftright", t["m"], k).bitwiseAND(F.lit(1)) == 1).alias("on")))
            return F.aggregate(F.filter(asked, lambda v: v["on"]), F.struct(t["c"].alias("c"), F.lit(0).cast("long").alias("m")), lambda acc, v: F.struct((acc["c"] | v["c"]).alias("c"), acc["m"].bitwiseOR(v["m"]).alias("m")))

        return F.transform(x, one)

    def apply(v: Column, x: Column) -> Column:
        lit = F.transform(x, lambda t, j: F.when(t["c"] | (F.coalesce(v, F.lit(0).cast("long")).bitwiseAND(t["m"]) != 0), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(lit, F.lit(0).cast("long"), lambda acc, y: acc.bitwiseOR(y))

    return composed(rows, keys, pos, terms, "long", compose, apply, out, block)
