"""Settle order-dependent chains of rows in streaming passes over partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, types as T


def settle_chains(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], settle: Callable[[list[dict]], list[dict]], schema: T.StructType
) -> DataFrame:
    """Apply ``settle`` to the ordered rows of each chain.

    Rows are shuffled by the chain keys and sorted, then each task walks its Arrow batches
    and holds one batch and the chain that crosses its end - so thousands of short chains
    cost one Python pass, and a task never holds more than that.
    """
    keys = list(keys)
    names = schema.fieldNames()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[dict] = []

        def id_of(row: dict) -> tuple:
            return tuple(row[k] for k in keys)

        for pdf in batches:
            out: list[dict] = []
            for chain, rows in groupby(pdf.to_dict("records"), id_of):
                if waiting and id_of(waiting[0]) != chain:
                    out.extend(settle(waiting))
                    waiting = []
                waiting.extend(rows)
            yield pd.DataFrame(out, columns=names)
        if waiting:
            yield pd.DataFrame(settle(waiting), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(walk, schema)
