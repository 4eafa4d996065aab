"""Tree ensembles whose trees grow whole inside tasks.

Spark ML grows all trees level by level and sends one table of statistics per tree node through a shuffle: with deep trees those
tables are far larger than the rows.  Here the rows are binned to one byte a value, as Spark ML bins them, and broadcast; a task then
grows its trees alone.  Rows that need more than ``MOST_BYTES`` are left to Spark ML, with the same parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

BINS = 32
#: Values of a feature that stand for those of one Arrow batch when quantiles are sought: at most one in a thousand of its ranks off.
POINTS = 1_000
#: Binned rows up to this size are held by the driver and by each task; more are fitted by Spark ML.
MOST_BYTES = 256 << 20


@dataclass
class Rows:
    """``x`` holds one row of bin numbers per feature."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    edges: list[np.ndarray]
    classes: int


@dataclass
class Tree:
    """Nodes in order of levels: a row goes to ``left`` if its bin is at most ``cut``, else to the node after it; leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``bins`` (features by rows)."""
        at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        while len(rows):
            f = self.feature[at[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            node = at[rows]
            at[rows] = self.left[node] + (bins[f, rows] > self.cut[node])
        return at


def bins_of(edges: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Bin numbers, features by rows, of a matrix of rows by features; a value on an edge is below it."""
    out = np.empty((values.shape[1], values.shape[0]), np.uint8)
    for f, e in enumerate(edges):
        out[f] = np.searchsorted(e, values[:, f], side="left")
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _points(values: np.ndarray) -> np.ndarray:
    """The sorted values of each column, or ``POINTS`` evenly spaced ranks of them; features by values."""
    n = len(values)
    ranks = np.arange(n) if n <= POINTS else ((np.arange(POINTS) + 0.5) * n / POINTS).astype(np.int64)
    return np.sort(values, axis=0)[ranks].T


def _edges(parts: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Distinct quantiles of one feature, from the points of all batches and the rows that each stands for."""
    values = np.concatenate(parts)
    order = np.argsort(values, kind="stable")
    rank = np.cumsum(weights[order])
    return np.unique(values[order][np.searchsorted(rank, rank[-1] * np.arange(1, BINS) / BINS)])


def binned(df: DataFrame, features: str, label: str, weight: str | None = None) -> Rows | None:
    """All rows of ``df``, binned by quantiles of all rows; None if they need more than ``MOST_BYTES``."""
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    n, one = df.count(), rows.first()
    width = len(one.x) if one else 0
    if not n or n * (width + 9) > MOST_BYTES:
        return None

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                points = np.ascontiguousarray(_points(_matrix(b.column(0))))
                yield pa.RecordBatch.from_arrays([pa.array([points.tobytes()], pa.binary()), pa.array([b.num_rows], pa.int64()), pa.array([b.column(1).to_numpy(zero_copy_only=False).max()])], ["x", "n", "y"])

    seen = rows.mapInArrow(summary, "x binary, n long, y double").collect()
    classes = int(max(p.y for p in seen)) + 1
    if classes > 256:
        return None
    points = [np.frombuffer(p.x).reshape(width, -1) for p in seen]
    weights = np.concatenate([np.full(v.shape[1], p.n / v.shape[1]) for p, v in zip(seen, points)])
    edges = [_edges([v[f] for v in points], weights) for f in range(width)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = bins_of(edges, _matrix(b.column(0)))
                y, w = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y.astype(np.uint8), w)], ["x", "y", "w"])

    parts = rows.mapInArrow(pack, "x binary, y binary, w binary").collect()
    y = np.concatenate([np.frombuffer(p.y, np.uint8) for p in parts])
    x = np.concatenate([np.frombuffer(p.x, np.uint8).reshape(width, -1) for p in parts], axis=1)
    return Rows(x, y, np.concatenate([np.frombuffer(p.w) for p in parts]), edges, classes)


class _Growing:
    """Lists of a tree's nodes while it grows."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.value = [np.array([-1])], [np.zeros(1, np.uint8)], [np.zeros(1, np.int64)], []
        self.n = 1

    def split(self, chosen: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Splits the ``chosen`` nodes of the newest level; the number of each one's left child within the next level."""
        k = int(chosen.sum())
        child = np.cumsum(chosen) * 2 - 2
        f, c, left = self.feature[-1], self.cut[-1], self.left[-1]
        f[chosen], c[chosen], left[chosen] = feature[chosen], cut[chosen], self.n + child[chosen]
        if k:
            self.feature.append(np.full(2 * k, -1)), self.cut.append(np.zeros(2 * k, np.uint8)), self.left.append(np.zeros(2 * k, np.int64))
            self.n += 2 * k
        return child

    def done(self) -> Tree:
        return Tree(np.concatenate(self.feature).astype(np.int16), np.concatenate(self.cut), np.concatenate(self.left).astype(np.int32), np.concatenate(self.value))


def _table_gains(key: np.ndarray, y: np.ndarray, w: np.ndarray, copies: np.ndarray, m: int, total: np.ndarray, all_: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest sum of squared class weights over weights of both sides, and its bin, per node, from a table of all bins."""
    classes = total.shape[1]
    below = np.bincount(key * classes + y, w, m * BINS * classes).reshape(m, BINS, classes).cumsum(1)
    number = np.bincount(key, copies, m * BINS).reshape(m, BINS).cumsum(1)
    lw = below.sum(2)
    left = (below**2).sum(2) / np.maximum(lw, 1e-300)
    right = ((total[:, None, :] - below) ** 2).sum(2) / np.maximum(all_[:, None] - lw, 1e-300)
    gain = np.where((number >= least) & (number[:, -1:] - number >= least), left + right, 0.0)
    top = gain.argmax(1)
    return gain[np.arange(m), top], top


def _sorted_gains(key: np.ndarray, y: np.ndarray, w: np.ndarray, copies: np.ndarray, m: int, total: np.ndarray, all_: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_table_gains` for nodes of few rows: only bins that hold rows are looked at."""
    order = np.argsort(key.astype(np.uint16) if m * BINS <= 1 << 16 else key, kind="stable")
    key, copies = key[order], copies[order]
    node = key // BINS
    sums = np.zeros((len(key), total.shape[1]))
    sums[np.arange(len(key)), y[order]] = w[order]
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
    sums = np.add.reduceat(sums, np.append(0, last[:-1] + 1), axis=0)
    number = np.add.reduceat(copies, np.append(0, last[:-1] + 1))
    node, bin_ = node[last], key[last] % BINS
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    below, number = sums.cumsum(0), number.cumsum()
    before, start = below[first] - sums[first], np.append(0.0, number[first[1:] - 1])
    below, number = below - before[node], number - start[node]
    lw = below.sum(1)
    left = (below**2).sum(1) / np.maximum(lw, 1e-300)
    right = ((total[node] - below) ** 2).sum(1) / np.maximum(all_[node] - lw, 1e-300)
    ends = np.append(first[1:] - 1, len(node) - 1)
    gain = np.where((number >= least) & (number[ends][node] - number >= least), left + right, 0.0)
    most = np.maximum.reduceat(gain, first)
    at = np.minimum.reduceat(np.where(gain == most[node], np.arange(len(gain)), len(gain)), first)
    return most, bin_[at]


def grow_class_tree(rows: Rows, depth: int, least: int, rng: np.random.Generator, subset: int) -> Tree:
    """One tree of a random forest: a Poisson bootstrap, Gini gain, ``subset`` features drawn for each node."""
    copies = rng.poisson(1.0, rows.x.shape[1])
    at = np.flatnonzero(copies)
    copies, y, w = copies[at].astype(np.float64), rows.y[at].astype(np.int64), (rows.w[at] * copies[at])
    node, m, classes, grown = np.zeros(len(at), np.int64), 1, rows.classes, _Growing()
    for level in range(depth + 1):
        total = np.bincount(node * classes + y, w, m * classes).reshape(m, classes)
        all_ = total.sum(1)
        grown.value.append((total / np.maximum(all_, 1e-300)[:, None]).astype(np.float32))
        if level == depth or not len(at):
            break
        parent = (total**2).sum(1) / np.maximum(all_, 1e-300)
        best, feature, cut = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        drawn = rng.random((m, rows.x.shape[0]), np.float32).argpartition(min(subset, rows.x.shape[0]) - 1, axis=1)[:, :subset]
        gains = _sorted_gains if len(at) < m * BINS // 2 else _table_gains
        for j in range(drawn.shape[1]):
            value, top = gains(node * BINS + rows.x[drawn[node, j], at], y, w, copies, m, total, all_, least)
            better = value - parent > best
            best[better], feature[better], cut[better] = (value - parent)[better], drawn[better, j], top[better]
        chosen = best > 1e-9 * np.maximum(all_, 1e-300)
        child = grown.split(chosen, feature, cut.astype(np.uint8))
        stay = chosen[node]
        at, node, copies, y, w = at[stay], node[stay], copies[stay], y[stay], w[stay]
        node, m = child[node] + (rows.x[feature[node], at] > cut[node]), 2 * int(chosen.sum())
        if not m:
            break
    return grown.done()


def grow_mean_tree(x: np.ndarray, target: np.ndarray, depth: int) -> tuple[Tree, np.ndarray]:
    """One regression tree by variance over all rows and features, and the leaf of each row.

    Of two sister nodes the rows of the smaller one are summed; the other is what remains of their parent.
    """
    n, grown = x.shape[1], _Growing()
    at, node, m = np.arange(n), np.zeros(n, np.int64), 1
    where, first, lighter, counts, sums = np.zeros(n, np.int64), 0, None, None, None
    for level in range(depth + 1):
        g = target[at]
        number, total = np.bincount(node, minlength=m).astype(np.float64), np.bincount(node, g, m)
        grown.value.append(total / number)
        where[at] = first + node
        first += m
        if level == depth:
            break
        if level:
            second = number[1::2] < number[0::2]
            few = second[node // 2] == (node % 2 == 1)
            lighter, base, g = at[few], node[few] // 2 * BINS, g[few]
            counts, sums = counts[:, chosen], sums[:, chosen]
        else:
            base = node
        size, parents = (m // 2 if level else 1) * BINS, np.arange(m // 2)
        if level:
            light, heavy = 2 * parents + second, 2 * parents + 1 - second
        new_counts, new_sums = np.empty((len(x), m, BINS)), np.empty((len(x), m, BINS))
        parent = total**2 / number
        best, feature, cut = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        for f in range(len(x)):
            key = base + (x[f, lighter] if level else x[f])
            k, s = np.bincount(key, minlength=size).reshape(-1, BINS), np.bincount(key, g, size).reshape(-1, BINS)
            if level:
                new_counts[f, light], new_counts[f, heavy] = k, counts[f] - k
                new_sums[f, light], new_sums[f, heavy] = s, sums[f] - s
            else:
                new_counts[f], new_sums[f] = k, s
            k, s = new_counts[f, :, :-1].cumsum(1), new_sums[f, :, :-1].cumsum(1)
            # a cut that leaves one side empty gains nothing
            gain = s * s / np.maximum(k, 1.0)
            gain += (total[:, None] - s) ** 2 / np.maximum(number[:, None] - k, 1.0)
            top = gain.argmax(1)
            value = gain[np.arange(m), top] - parent
            better = value > best
            best[better], feature[better], cut[better] = value[better], f, top[better]
        counts, sums = new_counts, new_sums
        chosen = best > 1e-12 * number
        child = grown.split(chosen, feature, cut.astype(np.uint8))
        stay = chosen[node]
        at, node = at[stay], node[stay]
        node, m = child[node] + (x[feature[node], at] > cut[node]), 2 * int(chosen.sum())
        if not m:
            break
    return grown.done(), where


def boost(x: np.ndarray, positive: np.ndarray, rounds: int, depth: int, rate: float) -> list[Tree]:
    """Gradient boosting for two classes with the loss and the step sizes of Spark ML; the leaves hold weighted values."""
    y = np.where(positive, 1.0, -1.0)
    total, out = np.zeros(len(y)), []
    for r in range(rounds):
        tree, where = grow_mean_tree(x, y if r == 0 else 4.0 * y / (1.0 + np.exp(2.0 * y * total)), depth)
        tree.value = tree.value * (1.0 if r == 0 else rate)
        total += tree.value[where]
        out.append(tree)
    return out


class TreesModel(Model):
    """Votes of trees (``group`` None) or one sum of trees per class, as ``rawPrediction`` and ``prediction``; votes give ``probability`` too."""

    def __init__(self, trees: list[Tree], group: list[int] | None, edges: list[np.ndarray], classes: int, features: str, context) -> None:
        super().__init__()
        self.trees, self.classes, self.features, self.votes = len(trees), classes, features, group is None
        self.held = context.broadcast((trees, group, edges))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held, classes = self.held, self.classes

        def raw(column: pa.Array) -> pa.Array:
            trees, group, edges = held.value
            bins = bins_of(edges, _matrix(column)) if len(column) else np.zeros((len(edges), 0), np.uint8)
            out = np.zeros((len(column), classes))
            for i, t in enumerate(trees):
                if group is None:
                    out += t.value[t.leaves(bins)]
                else:
                    out[:, group[i]] += t.value[t.leaves(bins)]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * classes, pa.int32()), pa.array(out.ravel()))

        scored = dataset.withColumn("_raw", F.arrow_udf(raw, "array<double>")(vector_to_array(self.features)))
        best = (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double")
        cols = {"rawPrediction": array_to_vector("_raw"), "prediction": best}
        if self.votes:
            cols["probability"] = array_to_vector(F.transform("_raw", lambda v: v / F.lit(float(self.trees))))
        return scored.withColumns(cols).drop("_raw")


def _spread(context, jobs: int) -> int:
    return max(1, min(jobs, 4 * context.defaultParallelism))


class Forest(RandomForestClassifier):
    """A random forest classifier whose trees are grown by tasks."""

    def _fit(self, dataset: DataFrame):
        rows = binned(dataset, self.getFeaturesCol(), self.getLabelCol(), self.getWeightCol() if self.isDefined(self.weightCol) else None)
        if rows is None:
            return super()._fit(dataset)
        context = dataset.sparkSession.sparkContext
        held, trees, edges, classes = context.broadcast(rows), self.getNumTrees(), rows.edges, rows.classes
        depth, least, seed, subset = self.getMaxDepth(), self.getMinInstancesPerNode(), self.getSeed(), int(np.ceil(np.sqrt(rows.x.shape[0])))
        del rows
        grow = lambda i: grow_class_tree(held.value, depth, least, np.random.default_rng([seed % 2**32, i]), subset)
        grown = context.parallelize(range(trees), _spread(context, trees)).map(grow).collect()
        held.destroy()
        return TreesModel(grown, None, edges, classes, self.getFeaturesCol(), context)


class Boosted(Estimator):
    """Boosted trees, one ensemble against the rest per class; each is grown by one task."""

    def __init__(self, rounds: int, depth: int, seed: int, rate: float = 0.1, features: str = "features", label: str = "label_idx") -> None:
        super().__init__()
        self.rounds, self.depth, self.seed, self.rate, self.features, self.label = rounds, depth, seed, rate, features, label

    def _fit(self, dataset: DataFrame):
        rows = binned(dataset, self.features, self.label)
        if rows is None:
            one = GBTClassifier(maxIter=self.rounds, maxDepth=self.depth, stepSize=self.rate, seed=self.seed)
            return OneVsRest(classifier=one, featuresCol=self.features, labelCol=self.label, parallelism=4).fit(dataset)
        context = dataset.sparkSession.sparkContext
        held, edges, classes, rounds, depth, rate = context.broadcast(rows), rows.edges, rows.classes, self.rounds, self.depth, self.rate
        del rows
        grow = lambda c: (c, boost(held.value.x, held.value.y == c, rounds, depth, rate))
        found = context.parallelize(range(classes), classes).map(grow).collect()
        held.destroy()
        return TreesModel([t for _, ts in found for t in ts], [c for c, ts in found for _ in ts], edges, classes, self.features, context)
