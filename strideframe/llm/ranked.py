"""Ranked lexical search with presence masks.

Each query item is a set of terms.  One pass over the texts counts their terms and keeps, for each document, the
vocabulary terms that it holds (number and frequency); statistics come from all documents by group-bys.  The second
pass reads that table in blocks of documents.  In a block, bitmap operations give each document the mask of an
item's terms that it holds; documents with one mask are a group.  A mask bounds the score of its group by the greatest
impact of its terms in the block, so distinct masks are evaluated by falling bound until the item's
k-th best score, carried from block to block of a task, is above the next bound.  Tasks give at most k rows
an item; these are merged in two steps, first by (item, slice), so that no task sees the candidates of all others.

Scores are exact: a term's weight is ``floor(1000 * ln((2N + 2) / (2 df + 1)))`` in doubles, all else 64-bit integers.
Vocabularies beyond ``VOCABULARY`` terms are worked off in several passes of whole items, so what is sent
to the tasks is bounded.

Defined cases: null, empty and sign-only texts have no terms, count in no statistic and match nothing; a null or sign-only item matches nothing
and has no rows; rows that repeat an item id are one item with the terms of all; a null item id is an item;
repeated documents are ranked one by one; equal scores go by ascending doc_id (null first), then by nothing else; only
the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideframe.llm.registry import query, table
from strideframe.llm.scratch import run_folder, settled
from strideframe.llm.textkit import SLICE_BYTES

BEST, BLOCK, VOCABULARY, SLICES = 50, 4096, 500_000, 64
Batches = Iterator[pa.RecordBatch]

#: Letters, digits and all bytes above ASCII stay, A-Z as a-z; the rest is white space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in order."""
    return text.translate(_FOLD).split()


def _counted(text: bytes) -> Counter:
    """How often each term occurs; a very long text is read in pieces, cut between terms."""
    if len(text) <= 2 * SLICE_BYTES:
        return Counter(terms(text))
    out: Counter = Counter()
    at = 0
    while at < len(text):
        to = min(len(text), at + SLICE_BYTES)
        while to < len(text) and _FOLD[text[to]] != 32:
            to += 1
        out.update(terms(text[at:to]))
        at = to
    return out


def _postings(vocabulary) -> object:
    """doc_id, n and the vocabulary terms (numbers and frequencies) of each document that has terms."""

    def run(batches: Batches) -> Batches:
        number = vocabulary.value
        for batch in batches:
            rows, lengths, ends, words, counts = [], [], [0], [], []
            for i, text in enumerate(batch.column("text")):
                held = _counted(text.as_buffer().to_pybytes()) if text.is_valid else None
                if held:
                    found = sorted((number[t], c) for t, c in held.items() if t in number)
                    rows.append(i)
                    lengths.append(held.total())
                    words.extend(f[0] for f in found)
                    counts.extend(f[1] for f in found)
                    ends.append(len(words))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((words, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return run


def _grouped(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a matrix of 64-bit mask words, and each row's group."""
    _, first, group = np.unique(masks[:, 0], return_index=True, return_inverse=True)
    for c in range(1, masks.shape[1]):
        _, code = np.unique(masks[:, c], return_inverse=True)
        _, first, group = np.unique(group * (int(code.max()) + 1) + code, return_index=True, return_inverse=True)
    return masks[first], group


class _Best:
    """The k best (score, doc_id) of one item so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 0

    def add(self, scores: np.ndarray, at: np.ndarray, ids: list) -> None:
        new = [(s, ids[i]) for s, i in zip(scores.tolist(), at.tolist())]
        self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is not None, r[1]))[: self.k]


def _impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _search(model, kind: pa.DataType, k: int):
    """item, doc_id, score: the best k of each item among the documents of a task."""

    def block(best: list[_Best], ids: list, m: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, items: list, weight: np.ndarray) -> None:
        order = np.argsort(term, kind="stable")
        owner, term, tf = owner[order], term[order], tf[order]
        impact = _impacts(tf, m[owner])
        held, start = np.unique(term, return_index=True)
        stop = np.append(start[1:], len(term))
        place = {t: i for i, t in enumerate(held.tolist())}
        bound = np.maximum.reduceat(impact, start) * weight[held] if len(held) else held
        for item, mine in enumerate(items):
            here = [place[t] for t in mine if t in place]
            if not here:
                continue
            masks = np.zeros((len(ids), (len(here) + 63) // 64), np.uint64)
            worth = np.zeros((len(here), len(ids)), np.int64)
            for bit, p in enumerate(here):
                at = owner[start[p] : stop[p]]
                masks[at, bit >> 6] |= np.uint64(1 << (bit & 63))
                worth[bit, at] = impact[start[p] : stop[p]]
            w = weight[held[here]]
            distinct, group = _grouped(masks)
            bits = np.unpackbits(np.ascontiguousarray(distinct).view(np.uint8).reshape(len(distinct), -1), axis=1, bitorder="little")[:, : len(here)]
            most = bits.astype(np.int64) @ bound[here]
            falling = np.argsort(-most, kind="stable")
            members = np.argsort(group, kind="stable")
            edges = np.append(0, np.cumsum(np.bincount(group, minlength=len(distinct))))
            done, step = 0, 16
            while done < len(falling) and most[falling[done]] > 0 and most[falling[done]] >= best[item].floor():
                chosen = falling[done : done + step]
                chosen = chosen[most[chosen] >= best[item].floor()]
                at = np.concatenate([members[edges[g] : edges[g + 1]] for g in chosen])
                scores = w @ worth[:, at]
                fine = (scores > 0) & (scores >= best[item].floor())
                best[item].add(scores[fine], at[fine], ids)
                done, step = done + step, step * 2

    def run(batches: Batches) -> Batches:
        items, weight, n_docs, n_terms = model.value
        best = [_Best(k) for _ in items]
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                n = batch.column("n").to_numpy()
                m = 100 - 50 + np.array([(50 * x * n_docs) // n_terms for x in n.tolist()], np.int64)
                lists = batch.column("terms")
                owner = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
                block(best, batch.column("doc_id").to_pylist(), m, owner, lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy(), items, weight)
        rows = [(item, i, s) for item, b in enumerate(best) for s, i in b.rows]
        for at in range(0, len(rows), BLOCK):
            part = rows[at : at + BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], kind), pa.array([r[2] for r in part], pa.int64())], ["item", "doc_id", "score"])

    return run


def _item_passes(items: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """Items with their distinct terms and a pass number; each pass has about ``VOCABULARY`` terms at most (one larger item has a pass of its own size)."""

    def split(batches: Batches) -> Batches:
        for batch in batches:
            found = [sorted(set(terms(t.as_buffer().to_pybytes()))) if t.is_valid else [] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = dict(items.dtypes)["item_id"]
    one = items.mapInArrow(split, f"item_id {kind}, terms array<binary>").select("item_id", F.explode("terms").alias("t")).groupBy("item_id").agg(F.collect_set("t").alias("terms"))
    one = settled(one.withColumn("size", F.size("terms").cast("long")), folder, "items")
    total = one.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return one, max(1, math.ceil(total / VOCABULARY))


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    near = found.withColumn("slice", F.spark_partition_id() % SLICES)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "slice").orderBy(*order))).where(F.col("r") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    wanted, passes = _item_passes(items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").cast("binary").alias("text")), folder)
    kind, item_kind = dict(source.dtypes)["doc_id"], dict(wanted.dtypes)["item_id"]
    arrow = pa.schema(spark.createDataFrame([], f"doc_id {kind}").toArrow().schema).field(0).type
    parts = []
    for p in range(passes):
        mine = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()  # about VOCABULARY terms
        number = {t: i for i, t in enumerate(sorted({bytes(t) for r in mine for t in r["terms"]}))}
        vocabulary = spark.sparkContext.broadcast(number)
        held = settled(source.mapInArrow(_postings(vocabulary), f"doc_id {kind}, n long, terms array<int>, counts array<long>"), folder, f"postings_{p}")
        n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(number), np.int64)
        for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a vocabulary term
            weight[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
        sets = [[number[bytes(t)] for t in r["terms"]] for r in mine]
        model = spark.sparkContext.broadcast((sets, weight, n_docs, n_terms))
        found = held.where(F.size("terms") > 0).mapInArrow(_search(model, arrow, k), f"item int, doc_id {kind}, score long")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], f"item int, item_id {item_kind}")
        parts.append(_merged(found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"), k))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}') AS t FROM documents),
i AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS t FROM benchmark),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
o AS MATERIALIZED (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM o, g GROUP BY t),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score FROM i JOIN o USING (t) JOIN w USING (t), g GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {BEST}
"""


@query("op13_ranked_search", ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """All documents for each benchmark item."""
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
