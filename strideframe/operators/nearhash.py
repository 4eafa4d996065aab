"""Near-equal 64-bit hashes: a banded index, groups over it, and first-come selection.

Two hashes that differ in fewer than ``within`` bits agree on at least one of ``within`` bands,
so near pairs meet in equality joins on band values.  A pair is compared in the first band on
which it agrees and nowhere else.  A band value that holds more than ``HOT`` hashes
is split again: its hashes agree on that band, so the other bits are cut into
``within`` bands in turn and the joins are on both values.  Only distinct hashes are
indexed; copies, however many, share one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.operators.decisions import unfolded
from strideframe.session import written

HOT, MOST = 2_000, 512


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _masks(bits: Sequence[int], bands: int) -> list[int]:
    """Bit masks (as signed 64-bit numbers) that share out ``bits`` evenly."""
    edges = [round(len(bits) * i / bands) for i in range(bands + 1)]
    whole = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def _first_equal(x: Column, masks: Sequence[int]) -> Column:
    """Number of the first band on which two hashes agree, from their difference ``x``."""
    out = F.lit(None).cast("int")
    for i in range(len(masks) - 1, -1, -1):
        out = F.when(x.bitwiseAND(F.lit(masks[i])) == 0, F.lit(i)).otherwise(out)
    return out


def _banded(df: DataFrame, masks: Sequence[int], band: str, value: str) -> DataFrame:
    return df.select("*", F.posexplode(F.array(*[F.col("hash").bitwiseAND(F.lit(m)) for m in masks])).alias(band, value))


def near_pairs(hashes: DataFrame, keys: Sequence[str], within: int, hot: int = HOT) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct hashes (column ``hash``) of one key that differ in fewer than ``within`` bits."""
    keys, masks = list(keys), _masks(range(64), within)
    banded = written(_banded(hashes.select(*keys, "hash"), masks, "_band", "_value"))
    at = [*keys, "_band", "_value"]
    crowded = written(banded.groupBy(*at).count().filter(F.col("count") > hot).select(*at))

    def met(rows: DataFrame, on: list[str]) -> DataFrame:
        near = rows.withColumnRenamed("hash", "a").join(rows.withColumnRenamed("hash", "b"), on).filter("a < b")
        return near.withColumn("_x", F.col("a").bitwiseXOR(F.col("b"))).filter((F.bit_count("_x") < within) & (F.col("_band") == _first_equal(F.col("_x"), masks)))

    if crowded.isEmpty():
        return met(banded, at).select(*keys, "a", "b")
    out = met(banded.join(crowded, at, "left_anti"), at).select(*keys, "a", "b")
    held = banded.join(crowded, at, "left_semi")
    for i, mask in enumerate(masks):
        other = _masks([b for b in range(64) if not mask >> b & 1], within)
        inner = met(_banded(held.filter(F.col("_band") == i), other, "_inner", "_part"), [*at, "_inner", "_part"])
        out = out.unionByName(inner.filter(F.col("_inner") == _first_equal(F.col("_x"), other)).select(*keys, "a", "b"))
    return out


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``comp``, the least id that links (``a``, ``b``) lead to, for every linked id.

    Alternates two star steps: every node sends its greater neighbours, then its
    lesser ones, to the least of its neighbourhood; stars are left after about log n rounds.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b")))
        small = written(small.filter("a <> b").distinct())
        if small.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(small, ["a", "b"], "left_anti").isEmpty():
            break
        edges = small
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(roots)


def duplicate_groups(frames: DataFrame, phash: str, within: int, hot: int = HOT) -> DataFrame:
    """Adds ``group_hash`` and ``copies``: the least hash that near pairs lead to, and how many frames of all keys are in that group.

    The corpus-wide form: near-equal frames meet whatever recording they are from.  NULL hashes have no group.
    """
    distinct = frames.filter(F.col(phash).isNotNull()).groupBy(F.col(phash).alias("hash")).agg(F.count(F.lit(1)).alias("_n"))
    distinct = written(distinct)
    comps = components(near_pairs(distinct, [], within, hot))
    named = distinct.join(comps, F.col("hash") == F.col("id"), "left").select("hash", "_n", F.coalesce("comp", "hash").alias("group_hash"))
    sizes = named.groupBy("group_hash").agg(F.sum("_n").alias("copies"))
    return frames.join(named.join(sizes, "group_hash").select(F.col("hash").alias("_h"), "group_hash", "copies"), F.col(phash) == F.col("_h"), "left").drop("_h")


def first_come(selected: DataFrame, keys: Sequence[str], at: str, tie: str, phash: str, min_gap: float, within: int, most: int = MOST, hot: int = HOT) -> DataFrame:
    """In time order, keep a row that is ``min_gap`` after and ``within`` bits away from every kept row of its key.

    Keys of up to ``most`` rows are settled in arrays.  Larger ones go by rounds over all of
    them at once: the first undecided row of each hash wins if no near hash has an earlier
    undecided row and none is closer than ``min_gap`` ahead of it; what it rules out is dropped.
    """
    keys = list(keys)
    sizes = selected.groupBy(*keys).count()
    large = written(sizes.filter(F.col("count") > most).select(*keys))
    row = F.struct(F.col(at).alias("t"), F.col(tie).alias("f"), F.col(phash).alias("h"), F.struct(*selected.columns).alias("_row"))
    clash = lambda k, x: (x["t"] - k["t"] < min_gap) | (hamming(k["h"], x["h"]) < within)
    small = selected if large.isEmpty() else selected.join(large, keys, "left_anti")
    lists = small.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    kept = F.aggregate("_rows", F.slice("_rows", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: clash(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    out = unfolded(lists, kept, selected.columns, "_k._row")
    if large.isEmpty():
        return out
    rows = selected.join(large, keys, "left_semi")
    won = _rounds(rows.select(*keys, F.col(at).alias("t"), F.col(tie).alias("f"), F.col(phash).alias("hash")), keys, min_gap, within, hot)
    return out.unionByName(rows.join(won.select(*keys, F.col("f").alias(tie)), [*keys, tie], "left_semi"))


def _rounds(rows: DataFrame, keys: list[str], min_gap: float, within: int, hot: int) -> DataFrame:
    """Kept rows (keys, t, f, hash) of :func:`first_come`."""
    block = lambda c: F.floor(c / F.lit(max(min_gap, 1e-9)))
    place = F.struct("t", "f")
    open_rows = written(rows)
    pairs = near_pairs(open_rows.select(*keys, "hash").distinct(), keys, within, hot)
    rivals = written(pairs.unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(open_rows.select(*keys, F.col("hash").alias("a"), F.col("hash").alias("b")).distinct()))
    won_all = None

    def close(ahead: DataFrame, behind: DataFrame) -> DataFrame:
        """Rows of ``behind`` less than ``min_gap`` after a row of ``ahead``; both orders of rounding meet in a block or the next."""
        a = ahead.select(*keys, F.col("t").alias("_t"), F.col("f").alias("_f"), F.explode(F.array(block(F.col("t")), block(F.col("t")) + 1, block(F.col("t")) + 2)).alias("_bk"))
        b = behind.withColumn("_bk", block(F.col("t")))
        return b.join(a, [*keys, "_bk"]).filter((F.struct("_t", "_f") < place) & (F.col("t") - F.col("_t") < min_gap)).select(*keys, "f").distinct()

    while not open_rows.isEmpty():
        heads = written(open_rows.groupBy(*keys, "hash").agg(F.min(place).alias("_h")).select(*keys, "hash", F.col("_h.t").alias("t"), F.col("_h.f").alias("f")))
        other = heads.select(*keys, F.col("hash").alias("b"), F.struct("t", "f").alias("_o"))
        mine = heads.select(*keys, F.col("hash").alias("a"), "t", "f")
        blocked = rivals.join(mine, [*keys, "a"]).join(other, [*keys, "b"]).filter(F.col("_o") < place).select(*keys, "f").distinct()
        free = heads.join(blocked, [*keys, "f"], "left_anti")
        won = written(free.join(close(open_rows, free), [*keys, "f"], "left_anti").select(*keys, "t", "f", "hash"))
        won_all = won if won_all is None else won_all.unionByName(won)
        ruled = rivals.join(won.select(*keys, F.col("hash").alias("a"), place.alias("_w")), [*keys, "a"]).groupBy(*keys, F.col("b").alias("hash")).agg(F.min("_w").alias("_w"))
        left = open_rows.join(ruled, [*keys, "hash"], "left").filter(F.col("_w").isNull() | (place < F.col("_w"))).select(*keys, "t", "f", "hash")
        open_rows = written(left.join(close(won, left), [*keys, "f"], "left_anti"))
    return open_rows if won_all is None else won_all
