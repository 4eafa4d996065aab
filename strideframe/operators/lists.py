"""A stored inverted-list index for vectors, with bounds that make its answers exact.

Items are put into the list of their nearest centroid and written partitioned by list, so a search reads the lists
that it probes and no others.  Each list keeps the greatest angle between its centroid and an item; the
angle between a query and any item of the list is at least its angle to the centroid less that.  A search
probes the ``PROBES`` lists with the nearest centroids, takes the k-th best score found, and then only the lists whose bound
can still beat it - so what it returns is what a comparison with every item returns.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors by a hash of the id); all items are indexed.  Lists are compared in tiles
of about ``TILE`` items, so a list with a third of all items is no single task, and a tile keeps k rows a query.

Vectors that are NULL, zero, of another length than most (``size``), or hold NULL or non-finite components are neither indexed nor answered.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strideframe.operators.keyed import top_k
from strideframe.session import scratch_root, written

SAMPLE, ROUNDS, LISTS, PROBES, TILE, SLACK = 20_000, 8, 4_096, 4, 2_048, 1e-6
Batches = Iterator[pa.RecordBatch]


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(df: DataFrame, row_id: str, vec: str, size: int) -> DataFrame:
    v = F.col(vec).cast("array<float>")
    fine = F.size(v).eqNullSafe(size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(row_id).cast("long").alias("id"), v.alias("v")).filter(fine)


def _centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """Unit centroids after a few rounds of spherical k-means."""
    rng = np.random.default_rng(7)
    centres = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        some = np.linalg.norm(sums, axis=1) > 1e-12
        centres = np.where(some[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), centres)
    return centres


class VectorLists:
    """The index of ``items``: its folder, its centroids and the bounds of its lists."""

    def __init__(self, items: DataFrame, item_id: str, vec: str, size: int, path: str | None = None):
        self.spark, self.size = items.sparkSession, size
        rows = _usable(items, item_id, vec, size)
        n = rows.count()
        share = SAMPLE / max(1, n)
        sample = rows if share >= 1 else rows.filter(F.shiftrightunsigned(F.xxhash64("id"), 1) < int(share * 2**63))
        fitted = _unit(_rows(sample.select("v").toArrow().column(0).combine_chunks())) if n else np.zeros((0, size))
        self.centres = _centroids(fitted, min(LISTS, max(1, math.isqrt(n)))) if len(fitted) else np.zeros((0, size))
        centres = self.centres

        def assign(batches: Batches) -> Batches:
            for batch in batches:
                near = _unit(_rows(batch.column("v"))) @ centres.T if batch.num_rows else np.zeros((0, 1))
                angle = np.arccos(np.clip(near.max(1), -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.argmax(1).astype(np.int32)), pa.array(angle)], ["id", "v", "list", "angle"])

        self.path = path or f"{scratch_root(self.spark).rstrip('/')}/lists-{uuid.uuid4().hex}"
        (rows.mapInArrow(assign, "id long, v array<float>, list int, angle double") if len(centres) else rows.withColumns({"list": F.lit(0), "angle": F.lit(0.0)})).write.partitionBy("list").parquet(self.path)
        self.members = self.spark.read.schema("id long, v array<float>, angle double, list int").parquet(self.path)
        self.bounds, self.sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in self.members.groupBy("list").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():  # at most LISTS rows
            self.bounds[r["list"]], self.sizes[r["list"]] = r["angle"], r["n"]

    def search(self, queries: DataFrame, query_id: str, vec: str, k: int, probes: int = PROBES) -> DataFrame:
        """``query_id``, ``item_id``, ``score``, ``rank``: the k items with the greatest cosine, equal ones by the smaller id."""
        asked = written(_usable(queries, query_id, vec, self.size).withColumn("least", F.lit(None).cast("double")))
        first = written(self._met(asked, k, probes, False))
        kth = first.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        rest = self._met(asked.drop("least").join(kth, F.col("id") == F.col("q"), "left").select("id", "v", "least"), k, probes, True)
        out = top_k(first.unionByName(rest), ["q"], [F.desc("score"), "i"], k, "rank")
        return out.select(F.col("q").alias(query_id), F.col("i").alias("item_id"), "score", "rank")

    def _met(self, asked: DataFrame, k: int, probes: int, beyond: bool) -> DataFrame:
        """The best k of the nearest ``probes`` lists, or of all other lists that may hold better ones."""
        centres, bounds, sizes = self.centres, self.bounds, self.sizes

        def choose(batches: Batches) -> Batches:
            for batch in batches:
                rows, lists = np.zeros(0, np.int64), np.zeros(0, np.int32)
                if batch.num_rows and len(centres):
                    near = np.where(sizes > 0, _unit(_rows(batch.column("v"))) @ centres.T, -2)
                    order = np.argsort(-near, axis=1, kind="stable")
                    take = np.zeros(near.shape, bool)
                    np.put_along_axis(take, order[:, :probes], True, 1)
                    if beyond:
                        least = np.nan_to_num(batch.column("least").to_numpy(zero_copy_only=False).astype(float), nan=-2)
                        reach = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - bounds))
                        take = ~take & (reach >= least[:, None] - SLACK)
                    rows, lists = np.nonzero(take & (sizes > 0))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows)) for c in ("id", "v")] + [pa.array(lists.astype(np.int32))], ["id", "v", "list"])

        def tile(batches: Batches) -> Batches:
            key, held = None, []
            best: tuple | None = None
            for batch in batches:
                at, salt, role, ids = (batch.column(c).to_numpy() for c in ("list", "salt", "role", "id"))
                x = _rows(batch.column("v"))
                edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (salt[1:] != salt[:-1]) | (role[1:] != role[:-1]), True])
                out: list[list[np.ndarray]] = [[], [], []]
                for lo, hi in zip(edges, edges[1:]):
                    if key != (at[lo], salt[lo]):
                        key, held, best = (at[lo], salt[lo]), [], None
                    if role[lo] == 0:
                        held.append((ids[lo:hi], x[lo:hi]))
                    elif held or best:
                        if best is None:
                            own, vectors = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                            up = np.argsort(own, kind="stable")
                            best, held = (own[up], vectors[up], np.linalg.norm(vectors[up], axis=1)), []
                        for a in range(lo, hi, TILE):
                            q = x[a : min(hi, a + TILE)]
                            score = q @ best[1].T / (np.linalg.norm(q, axis=1)[:, None] * best[2][None] + 1e-9)
                            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                            for part, made in zip(out, (np.repeat(ids[a : a + len(q)], top.shape[1]), best[0][top].ravel(), np.take_along_axis(score, top, 1).ravel())):
                                part.append(made)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*o, np.zeros(0, kind)])) for o, kind in zip(out, (np.int64, np.int64, float))], ["q", "i", "score"])

        chosen = written(asked.mapInArrow(choose, "id long, v array<float>, list int"))
        tiles = self.spark.createDataFrame([(i, -(-int(n) // TILE)) for i, n in enumerate(sizes) if n] or [(0, 1)], "list int, tiles int")  # at most LISTS rows
        needed = chosen.select("list").distinct()
        stored = self.members.join(F.broadcast(needed), "list", "left_semi").join(F.broadcast(tiles), "list").select("list", F.pmod(F.xxhash64("id"), "tiles").cast("int").alias("salt"), F.lit(0).alias("role"), "id", "v")
        probing = chosen.join(F.broadcast(tiles), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("salt"), F.lit(1).alias("role"), "id", "v")
        met = stored.unionByName(probing).repartition("list", "salt").sortWithinPartitions("list", "salt", "role")
        return top_k(met.mapInArrow(tile, "q long, i long, score double"), ["q"], [F.desc("score"), "i"], k, "_r").drop("_r")
