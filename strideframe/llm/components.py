"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.scratch import settled


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least reachable node of each of n nodes under links i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """id, comp: the least id reachable from each id of ``links`` (columns a and b).

    Each round every id takes the least label among itself and its neighbours, then the label of its
    label, so that long chains shrink by halves.  Rounds are settled in the shared folder and end
    when no label changes; only that count reaches the driver.
    """
    edges = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), folder, f"{name}_edges")
    labels = settled(edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("comp")), folder, f"{name}_0")
    step = 0
    while True:
        step += 1
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("comp").alias("near"))
        hooked = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        hooked = settled(hooked, folder, f"{name}_{step}_hooked")
        roots = hooked.select(F.col("id").alias("root"), F.col("comp").alias("up"))
        jumped = settled(hooked.join(roots, F.col("comp") == F.col("root")).select("id", "was", F.least("comp", "up").alias("comp")), folder, f"{name}_{step}")
        labels = jumped.select("id", "comp")
        if jumped.where("was <> comp").isEmpty():
            return labels
