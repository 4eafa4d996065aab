"""Document quality by co-training of a text view and a metadata view.

* The **text view** is computed from the whole text: word and line statistics, shares of letters, capitals, digits and
  signs, and how much of the text repeats itself.
* The **metadata view** is what stands beside the text: language, source and length class.

Each view has a logistic regression.  In each of ``ROUNDS`` rounds both judge every unlabelled row in the cluster, and a view
hands its most confident judgements (``SHARED`` of each class, at calibrated probability ``SURE`` or more; ties by a hash) to the
*other* view as pseudo-labels, and both are fitted again.  Platt scaling on labelled rows that no fit has seen calibrates each view; a last regression on
the two calibrated log odds combines them.  Fits use about ``SAMPLE`` labelled rows, chosen by a hash of the id; the views of
all rows that are not held out are computed once and written, each round reads that narrow table and keeps ``SHARED`` rows a task
and class, and every document is scored in one pass without a shuffle.

Defined cases: null and empty texts have zero statistics and are scored; null metadata is a value of its own;
rows with crc32(doc_id) mod 5 = 0 are held out of all fits; null labels count as unlabelled; without labels of both classes
the score is the smoothed share of good rows; repeated rows score alike; only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.registry import query, table
from strideframe.llm.scratch import run_folder, settled
from strideframe.llm.textkit import slices, words_of

SAMPLE, ROUNDS, SHARED, SURE, META = 20_000, 4, 400, 0.95, 64
Batches = Iterator[pa.RecordBatch]

_CLASS = np.zeros(256, np.int64)  # 0 other signs, 1 small letters, 2 capitals, 3 digits, 4 white space, 5 stops, 6 bytes of other letters
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 6 if _b >= 0x80 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c in ".,;:!?'\"-()" else 0
TEXT_NAMES = ("words", "word_length", "small", "capital", "digit", "sign", "stop", "other", "pipe", "bang", "lines", "distinct", "same_next", "top_word", "short")


def text_view(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    words, n = words_of(texts), len(texts)
    size = np.array([len((t or "").encode()) for t in texts.to_pylist()])
    owner = np.repeat(np.arange(n), size)
    byte = np.bincount(owner * 7 + _CLASS[words.data], minlength=7 * n).reshape(n, 7).astype(float)
    count = lambda mask: np.bincount(owner[mask], minlength=n)
    solid = np.maximum(byte.sum(1) - byte[:, 4], 1)
    n_words, whose = words.counts, words.owner()
    some = np.maximum(n_words, 1)
    same = np.concatenate([(words.code[1:] == words.code[:-1]) & (whose[1:] == whose[:-1]), [False]]) if len(whose) else np.zeros(0, bool)
    order = np.lexsort((words.code, whose))
    code, own = words.code[order], whose[order]
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (own[1:] != own[:-1])])) if len(own) else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate([first, [len(own)]]))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, own[first], runs)
    return np.stack([
        np.log1p(n_words), np.log1p(byte.sum(1) / some), byte[:, 1] / solid, byte[:, 2] / solid, byte[:, 3] / solid, np.sqrt(byte[:, 0] / solid), byte[:, 5] / solid, byte[:, 6] / solid,
        np.sqrt(count(words.data == 0x7C) / some), np.sqrt(count(words.data == 0x21) / some), count(words.data == 0x0A) / some, np.bincount(own[first], minlength=n) / np.sqrt(some),
        np.sqrt(np.bincount(whose[same], minlength=n) / some), top / some, (n_words < 8).astype(float),
    ], 1)


def meta_view(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """One-hot hashes of the values of each column; numbers by their order of magnitude."""
    out = np.zeros((batch.num_rows, META))
    for c in columns:
        for i, v in enumerate(batch.column(c).to_pylist()):
            token = f"{c}=null" if v is None else f"{c}~{math.frexp(v)[1]}" if isinstance(v, (int, float)) and math.isfinite(v) else f"{c}={v}"
            out[i, zlib.crc32(token.encode()) % META] = 1
    return out


class Logistic:
    """Standardised logistic regression by Newton steps, with a ridge penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self._z(x)
        weight = np.ones(len(y)) if weight is None else weight
        self.w = np.zeros(z.shape[1])
        share = ((weight * y).sum() + 1) / (weight.sum() + 2)
        self.w[-1] = math.log(share / (1 - share))
        if 0 < y.mean() < 1:
            ridge = penalty * np.eye(z.shape[1])
            ridge[-1, -1] = 0
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
                step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge + 1e-9 * np.eye(len(ridge)), z.T @ (weight * (y - p)) - ridge @ self.w)
                self.w = self.w + step
                if np.abs(step).max() < 1e-8:
                    break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.w, -30, 30)


def platt(odds: np.ndarray, y: np.ndarray) -> Logistic:
    """Platt scaling that never turns a view round: a slope below zero becomes the share of good rows for all."""
    scale = Logistic(odds[:, None], y, penalty=0.1)
    if scale.w[0] < 0:
        scale.w = np.array([0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    return scale


class Judges:
    """The two calibrated models of a round: log odds of each view."""

    def __init__(self, models: list[Logistic], scales: list[Logistic]):
        self.models, self.scales = models, scales

    def odds(self, k: int, x: np.ndarray) -> np.ndarray:
        return self.scales[k].odds(self.models[k].odds(x)[:, None])


def surest(judges: Judges, taken: list[set[int]], parts: Iterator[tuple[np.ndarray, list[np.ndarray]]]) -> list[tuple[int, int, int, float, np.ndarray]]:
    """(view, class, key, -|odds|, row of the other view) of the ``SHARED`` surest new keys of each view and class in ``parts`` of (keys, views)."""
    best: dict[tuple[int, int], dict[int, tuple[float, np.ndarray]]] = {(k, c): {} for k in (0, 1) for c in (0, 1)}
    for keys, views in parts:
        for k in (0, 1):
            odds = judges.odds(k, views[k])
            for c, sign in ((0, -1), (1, 1)):
                held = best[k, c]
                sure = np.flatnonzero(sign * odds >= math.log(SURE / (1 - SURE)))
                held.update((int(keys[i]), (-sign * odds[i], views[1 - k][i])) for i in sure if int(keys[i]) not in taken[1 - k])
                if len(held) > SHARED:
                    best[k, c] = dict(sorted(held.items(), key=lambda x: (x[1][0], x[0]))[:SHARED])
    return [(k, c, key, *value) for (k, c), held in best.items() for key, value in held.items()]


class CoTrained:
    """Both views after the exchange of pseudo-labels, their calibration and their combination.

    ``pool`` gives the rows of :func:`surest` over all unlabelled rows for the judges of a round and the keys that each view holds."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, pool: Callable[[Judges, list[set[int]]], list[tuple]]):
        fit = np.arange(len(y)) % 4 != 3
        self.views = [Logistic(v[fit], y[fit]) for v in views]
        taken: list[set[int]] = [set(), set()]
        own = [(v[fit], y[fit], np.ones(fit.sum())) for v in views]
        self.exchanged = [0, 0]
        scaled = lambda: [platt(m.odds(v[~fit]), y[~fit]) for m, v in zip(self.views, views)]
        for _ in range(ROUNDS if 0 < y.mean() < 1 else 0):
            found = pool(Judges(self.views, scaled()), taken)
            for k in (0, 1):
                other = 1 - k
                new = [r for r in found if r[0] == k]
                if new:
                    taken[other].update(r[2] for r in new)
                    self.exchanged[other] += len(new)
                    x, label, weight = own[other]
                    own[other] = (np.vstack([x, *(np.asarray(r[4])[None] for r in new)]), np.concatenate([label, [float(r[1]) for r in new]]), np.concatenate([weight, np.full(len(new), 0.5)]))
            if not found:
                break
            self.views = [Logistic(*o) for o in own]
        self.scales = scaled()
        self.last = Logistic(self._calibrated([v[~fit] for v in views]), y[~fit], penalty=0.1)

    def _calibrated(self, views: list[np.ndarray]) -> np.ndarray:
        return np.stack([s.odds(m.odds(v)[:, None]) for s, m, v in zip(self.scales, self.views, views)], 1)

    def scores(self, views: list[np.ndarray]) -> np.ndarray:
        """Columns: combined, text and metadata probability."""
        each = self._calibrated(views)
        return 1 / (1 + np.exp(-np.column_stack([self.last.odds(each), each])))


def _views(columns: list[str]):
    def run(batches: Batches) -> Batches:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            both = [text_view(batch.column("text")), meta_view(batch, columns)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), *(pa.array(list(v), pa.list_(pa.float64())) for v in both)], ["key", "y", "text_view", "meta_view"])

    return run


_FOUND = "view int, class int, key long, rank double, other array<double>"


def _table_pool(rows: DataFrame, folder: str):
    """The pool of a settled table of views: the surest rows of each task, then of all tasks."""
    spark, rounds = rows.sparkSession, count()

    def pool(judges: Judges, taken: list[set[int]]) -> list[tuple]:
        told = spark.sparkContext.broadcast((judges, taken))

        def run(batches: Batches) -> Batches:
            stacked = lambda b, c, width: b.column(c).flatten().to_numpy().reshape(-1, width)
            parts = ((b.column("key").to_numpy(), [stacked(b, "text_view", len(TEXT_NAMES)), stacked(b, "meta_view", META)]) for b in batches if b.num_rows)
            found = list(zip(*surest(*told.value, parts))) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.float64()), pa.array(list(found[4]), pa.list_(pa.float64()))], ["view", "class", "key", "rank", "other"])

        some = settled(rows.mapInArrow(run, _FOUND), folder, f"round{next(rounds)}")
        out: dict[tuple[int, int, int], tuple] = {}
        for k in (0, 1):
            for c in (0, 1):  # SHARED rows of each, merged from the tasks' best
                for r in some.where((F.col("view") == k) & (F.col("class") == c)).orderBy("rank", "key").limit(SHARED).collect():
                    out.setdefault((k, c, r.key), tuple(r))
        return list(out.values())

    return pool


def _score(model, columns: list[str]):
    def run(batches: Batches) -> Batches:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            p = model.value.scores([text_view(batch.column("text")), meta_view(batch, columns)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(3))], ["doc_id", "score", "text_score", "meta_score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, meta: tuple[str, ...] = ("lang", "source", "n_chars"), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, text_score, meta_score, keep."""
    spark, columns = docs.sparkSession, list(meta)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"m_{c}") for c in columns])
    columns = [f"m_{c}" for c in columns]
    id_kind = dict(source.dtypes)["doc_id"]
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    drawn = lambda most, of: F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= min(int(most / max(1, of) * 2**63), 2**63 - 1)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.where(~held & drawn(SAMPLE, known.count()))
    # about SAMPLE narrow rows, whatever the size of the tables; labels beyond them count as none
    rows = source.join(F.broadcast(chosen), "doc_id", "left").where(~held).select(F.xxhash64("doc_id", "text").alias("key"), "y", "text", *columns)
    folder = run_folder(spark)
    rows = settled(rows.mapInArrow(_views(columns), "key long, y double, text_view array<double>, meta_view array<double>"), folder, "views")
    found = rows.where("y is not null").orderBy("key", "y").toPandas()
    views = [np.array(list(found[c])).reshape(-1, width) for c, width in (("text_view", len(TEXT_NAMES)), ("meta_view", META))]
    y = found["y"].to_numpy(float)
    if len(y) < 8:
        views, y = [np.vstack([v, np.zeros((8, v.shape[1]))]) for v in views], np.concatenate([y, np.tile([0.0, 1.0], 4)])
    model = spark.sparkContext.broadcast(CoTrained(views, y, _table_pool(rows.where("y is null"), folder)))
    out = source.mapInArrow(_score(model, columns), f"doc_id {id_kind}, score double, text_score double, meta_score double")
    return out.select("doc_id", held.alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= 0.5).alias("keep"))


@query("op8_quality")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, by the labels that are not held out."""
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
