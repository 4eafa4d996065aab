"""Per-key selection, set operations with precedence, and snapshot upserts.

None of these collects a group.  ``top_k`` filters ``row_number() <= k``, which
Spark turns into a map-side group limit, so a hot key sends at most ``k`` rows
per input partition through the shuffle.  Joins carry no broadcast hint: Spark
broadcasts a side only while its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and sort-merges (with the adaptive skew
split) beyond it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key under a total ``order``."""
    out = rank or "_rank"
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*_cols(order))))
    kept = ranked.filter(F.col(out) <= k)
    return kept if rank else kept.drop(out)


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first under ``order`` (``DISTINCT ON``)."""
    return top_k(df, keys, order, 1)


def latest(df: DataFrame, keys: Sequence[str], when: Sequence[str], n: int = 1) -> DataFrame:
    """The newest ``n`` rows of every key."""
    return top_k(df, keys, [F.col(c).desc() for c in when], n)


def lookup(fact: DataFrame, dim: DataFrame, on: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left lookup where an absent key or value takes a default."""
    joined = fact.join(dim, list(on), "left")
    for name, value in defaults.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return joined


def missing(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with no partner in ``right``."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def present(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with a partner in ``right``."""
    return left.join(right.select(*on).distinct(), list(on), "left_semi")


def prefer(sources: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union in which an earlier source wins every key it has."""
    tagged = None
    for rank, source in enumerate(sources):
        part = source.withColumn("_source", F.lit(rank))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    return pick_first(tagged, keys, ["_source", *order]).drop("_source")


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows plus the new rows whose key is not there yet."""
    return old.unionByName(missing(new, old, keys))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old_if_null: Sequence[str] = ()) -> DataFrame:
    """The next snapshot of a keyed table.

    New rows replace old ones; a column of ``keep_old_if_null`` keeps the stored
    value when the new one is NULL.  Keys are unique on both sides.
    """
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("_old"))
    n = new.select(*keys, F.struct(*values).alias("_new"))
    both = o.join(n, list(keys), "full_outer")

    def pick(c: str) -> Column:
        fresh, stored = F.col(f"_new.{c}"), F.col(f"_old.{c}")
        if c in keep_old_if_null:
            return F.coalesce(fresh, stored).alias(c)
        return F.when(F.col("_new").isNull(), stored).otherwise(fresh).alias(c)

    return both.select(*keys, *[pick(c) for c in values]).select(*old.columns)


def resume(done: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The part of ``wanted`` that still has to be computed."""
    return missing(wanted, done, keys)
