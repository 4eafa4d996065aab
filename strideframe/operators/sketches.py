"""Mergeable states: distinct counts and quantiles of any range of days from one small row a day.

A day's rows are folded once into a HyperLogLog state and a KLL state; the table of states is written and
kept.  A question about a range merges the states of its days and never reads the rows
again.  Both merge in any order, on the map side first, so a hot day or key is no
bottleneck.  NULLs are in neither state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

LOG_SIZE, ROUGHNESS = 12, 400


def daily_states(df: DataFrame, keys: Sequence[str], who: str, value: str) -> DataFrame:
    """One row per ``keys`` (a day among them): ``people`` and ``numbers``, the states of the distinct ``who`` and of ``value``."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(who, LOG_SIZE).alias("people"), F.kll_sketch_agg_double(F.col(value).cast("double"), ROUGHNESS).alias("numbers"))


def merged_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The states of coarser ``keys``, from finer ones."""
    return states.groupBy(*keys).agg(F.hll_union_agg("people").alias("people"), F.kll_merge_agg_double("numbers", ROUGHNESS).alias("numbers"))


def estimates(states: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """``distinct`` (standard error about 1.04 / 2**(LOG_SIZE / 2), here 1.6 %) and ``q<percent>`` (rank error below 1 % with 99 % confidence) of each state."""
    made = {f"q{round(q * 100)}": F.kll_sketch_get_quantile_double("numbers", F.lit(float(q))) for q in quantiles}
    return states.withColumns({"distinct": F.hll_sketch_estimate("people"), **made}).drop("people", "numbers")
