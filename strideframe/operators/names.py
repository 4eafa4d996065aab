"""Name resolution without pairing every name with every catalogue entry.

A substring match is an equality between one name and a substring of the other; an
edit distance of at most two means that both names share a string left after at
most two deletions each.  Both give hash-joinable keys, found exactly.  Names are
short (titles, not texts); the work per name is quadratic in its length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.operators.keyed import pick_first
from strideframe.operators.sequence import index_rows


def substrings(s: Column, shortest: Column) -> Column:
    """Distinct substrings of at least ``shortest`` characters."""
    n = F.length(s)
    lo = F.greatest(F.lit(1), shortest)
    pieces = F.flatten(
        F.transform(F.sequence(lo, n), lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(s, i, size)))
    )
    return F.when(n >= lo, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def _without_one(s: Column) -> Column:
    n = F.length(s)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def deletions(s: Column) -> Column:
    """The string with up to two characters removed, in every way."""
    one = _without_one(s)
    two = F.flatten(F.transform(one, _without_one))
    return F.array_distinct(F.concat(F.array(s), one, two))


def contained(needles: DataFrame, needle: str, hay: DataFrame, name: str, max_extra: int | None = None) -> DataFrame:
    """Pairs where ``needle`` is part of ``name``, optionally at most ``max_extra`` shorter."""
    shortest = F.lit(1) if max_extra is None else F.length(name) - max_extra
    parts = hay.withColumn("_part", F.explode(substrings(F.col(name), shortest)))
    return needles.join(parts, F.col(needle) == F.col("_part")).drop("_part")


def resolve(names: DataFrame, catalogue: DataFrame, name: str, target: str, order: str) -> DataFrame:
    """Catalogue name for each distinct name.

    Exact match, else mutual substring with a length difference up to three (first in
    catalogue order), else the smallest edit distance up to two (ties in catalogue
    order), else unchanged.  Adds ``matched`` and ``stage``.
    """
    left = names.select(name).distinct().filter(F.col(name) != "")
    right = catalogue.filter(F.col(target) != "").groupBy(target).agg(F.min(order).alias("_ord"))
    left_in_right = contained(left, name, right, target, 3)
    right_in_left = contained(right, target, left, name, 3)
    near = (
        left.withColumn("_d", F.explode(deletions(F.col(name))))
        .join(right.withColumn("_d", F.explode(deletions(F.col(target)))), "_d")
        .select(name, target, "_ord")
        .distinct()
        .withColumn("_dist", F.levenshtein(name, target))
        .filter(F.col("_dist") <= 2)
    )
    part = left_in_right.select(name, target, "_ord").unionByName(right_in_left.select(name, target, "_ord")).distinct()
    found = part.withColumns({"_stage": F.when(F.col(name) == F.col(target), 1).otherwise(2), "_dist": F.lit(0)}).unionByName(
        near.withColumn("_stage", F.lit(3))
    )
    best = found.groupBy(name).agg(F.min_by(F.struct(target, "_stage"), F.struct("_stage", "_dist", "_ord")).alias("_b"))
    return names.join(best, name, "left").withColumns(
        {"matched": F.coalesce(F.col(f"_b.{target}"), F.col(name)), "stage": F.coalesce(F.col("_b._stage"), F.lit(0))}
    ).drop("_b")


def substitutions(resolved: DataFrame, name: str) -> DataFrame:
    """The distinct replacements made by :func:`resolve`."""
    return resolved.filter(F.col(name) != F.col("matched")).select(name, "matched").distinct()


def lookup_fuzzy(names: DataFrame, catalogue: DataFrame, name: str, target: str, rank: list[Column | str], core: Column | None = None, min_core: int = 1) -> DataFrame:
    """Exact catalogue row, else the best row whose name holds the (stripped) name.

    ``rank`` orders the candidates of the second step.  Unmatched names are dropped.
    A catalogue name is matched once, by its best row: the rows behind it could only lose to that one.
    """
    left = names.select(name).distinct()
    best = pick_first(catalogue.filter(F.col(target).isNotNull()), [target], rank)
    exact = left.join(best, F.col(name) == F.col(target))
    rest = left.join(exact.select(name), name, "left_anti").withColumn("_core", F.col(name) if core is None else core)
    pairs = contained(rest.filter(F.length("_core") >= min_core), "_core", best, target).drop("_core")
    fuzzy = pick_first(pairs, [name], rank)
    return exact.withColumn("exact", F.lit(True)).unionByName(fuzzy.withColumn("exact", F.lit(False)))


def alias_table(mapping: DataFrame, key: str, title: str, order: str) -> DataFrame:
    """Aliases of each entry: every part of its title between slashes, the title, and the key.

    A repeated alias keeps its first place and points to the last entry that has it.
    """
    parts = F.filter(F.transform(F.split(title, "/"), F.trim), lambda p: p != "")
    every = F.concat(parts, F.array(F.col(title)), F.array(F.col(key).cast("string")))
    rows = mapping.select(key, title, F.posexplode(every).alias("_i", "alias"), F.col(order).alias("_o"))
    place = F.struct("_o", "_i")
    return rows.groupBy("alias").agg(F.min(place).alias("place"), F.max_by(F.struct(key, title), place).alias("_t")).select(
        "alias", "place", f"_t.{key}", f"_t.{title}"
    )


def resolve_alias(names: DataFrame, aliases: DataFrame, name: str, key: str, title: str) -> DataFrame:
    """Entry of each name: exact alias, else the first alias that holds it or is held by it."""
    left = names.select(name).distinct()
    held = contained(left, name, aliases, "alias").select(name, "alias", "place", key, title)
    holds = contained(aliases, "alias", left, name).select(name, "alias", "place", key, title)
    rank = F.struct((F.col(name) != F.col("alias")).alias("inexact"), "place")
    best = held.unionByName(holds).groupBy(name).agg(F.min_by(F.struct(key, title), rank).alias("_b"))
    return names.join(best, name, "left").withColumns(
        {key: F.col(f"_b.{key}"), "standard_name": F.coalesce(F.col(f"_b.{title}"), F.col(name))}
    ).drop("_b")


def numbered(df: DataFrame, name: str, order: Sequence[str], out: str, digits: int = 3, width: int = 50_000) -> DataFrame:
    """``out``: the name, an underscore and the row's number among equal names, with at least ``digits`` digits and never cut."""
    rows = index_rows(df, [name], order, width=width)
    return rows.withColumn(out, F.concat(name, F.lit("_"), F.format_string(f"%0{digits}d", "pos"))).drop("pos")
