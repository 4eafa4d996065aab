"""Removal of repeated passages with prefix-partitioned suffix trees.

A window is ``WIDTH`` consecutive words; a word goes when a window that covers it also starts
elsewhere.  Two suffixes of the corpus share a window exactly when their leaves lie below one internal node of
word depth ``WIDTH``, so the trees are built to that depth only.

* **Prefixes.** Each window is filed under its least ``PREFIX``-word run (by hash), an anchor: equal
  windows have equal anchors, and neighbouring windows with one anchor form a *stretch* that travels as
  one row.  An anchor is the short prefix under which suffixes are partitioned.  Anchors that occur once
  cannot hold a repeat and are dropped by a pre-aggregated count.
* **Copies.** Equal stretches (128 bits: anchor and whole stretch) are merged by a pre-aggregated
  count, so thousands of copies put one stretch into a tree.  An anchor with a single stretch is
  decided by the count alone.
* **Trees.** All other stretches of an anchor meet in one task, which splits their suffixes top down, word by
  word; nodes that reach depth ``WIDTH`` with two leaves are the repeats.  A group over ``GROUP`` stretches
  gets the longest prefix instead, all ``WIDTH`` words: its nodes are then counted by a
  pre-aggregated group-by over the whole cluster, and no task holds the group.

Rows are identified by (doc_id, hash of text), so rows that repeat a document count as further
places of its windows.  Defined cases: null or empty texts have no words; texts shorter than the width lose
nothing; a text may repeat itself; very long texts cost memory for their word hashes only (8 bytes a word);
ids may be null; only the named columns are read; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.llm.registry import query, table
from strideframe.llm.scratch import free_name, run_folder, settled
from strideframe.llm.textkit import U64, run_hashes, second_hashes, signed, slices, words_of

WIDTH, PREFIX, GROUP = 35, 8, 2000
_PLACE = 32  # a stretch has at most WIDTH - PREFIX + 1 = 28 windows: place = first word * 32 + windows - 1
Batches = Iterator[pa.RecordBatch]


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The position of the first least value of each ``span`` neighbours."""
    at, best, reach = np.arange(len(values)), values, 1

    def join(step: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        return np.where(take, at[step:], at[: len(at) - step]), np.where(take, right, left)

    while reach * 2 <= span:
        at, best = join(reach)
        reach *= 2
    if reach < span:
        at, best = join(span - reach)
    return at


def _stretches(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, first word in the row, windows, anchor and stretch hash of all stretches."""
    n = len(code)
    if n < WIDTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    at = np.arange(n - PREFIX + 1)
    runs = run_hashes(code, at, at + PREFIX)
    least = _least(runs, WIDTH - PREFIX + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(np.arange(WIDTH, n + 1) <= first[row[: n - WIDTH + 1] + 1])
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    anchor = least[start]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[start[1:]] != row[start[:-1]])])
    begin = np.flatnonzero(new)
    windows = np.diff(np.concatenate([begin, [len(start)]]))
    head = start[begin]
    whole = second_hashes(code, head, head + windows + WIDTH - 1)
    return row[head], head - first[row[head]], windows, runs[anchor[begin]], whole


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("h_text"), F.col(text).cast("string").alias("text"))


def _anchors(batches: Batches) -> Batches:
    for batch in (part for whole in batches for part in slices(whole, "text")):
        words = words_of(batch.column("text"))
        anchor, n = np.unique(_stretches(words.code, words.first)[3], return_counts=True)
        yield pa.RecordBatch.from_arrays([signed(anchor), pa.array(n.astype(np.int64))], ["anchor", "n"])


def _places(batches: Batches) -> Batches:
    for batch in (part for whole in batches for part in slices(whole, "text")):
        words = words_of(batch.column("text"))
        row, head, windows, anchor, stretch = _stretches(words.code, words.first)
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("h_text").take(row), pa.array(head * _PLACE + windows - 1), signed(anchor), signed(stretch)], ["doc_id", "h_text", "place", "anchor", "stretch"])


def _payloads(batches: Batches) -> Batches:
    """The word hashes of each wanted stretch, or for a crowded anchor the hashes of its windows."""
    names = ["anchor", "stretch", "many", "k", "node", "node2", "words"]
    for batch in (part for whole in batches for part in slices(whole, "text")):
        words = words_of(batch.column("text"))
        out: list[list] = [[] for _ in names]
        for row, wanted in enumerate(batch.column("wanted").to_pylist()):
            code = words.code[words.first[row] : words.first[row + 1]]
            for w in wanted:
                head, windows = w["place"] // _PLACE, w["place"] % _PLACE + 1
                part = code[head : head + windows + WIDTH - 1]
                if w["crowded"]:
                    at = np.arange(windows)
                    rows = zip(at.tolist(), run_hashes(part, at, at + WIDTH).view(np.int64).tolist(), second_hashes(part, at, at + WIDTH).view(np.int64).tolist(), [None] * windows)
                else:
                    rows = [(None, None, None, part.tobytes())]
                for r in rows:
                    for column, value in zip(out, (w["anchor"], w["stretch"], w["many"], *r)):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names)


def deep_leaves(group: np.ndarray, words: np.ndarray, start: np.ndarray, owner: np.ndarray, many: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes lie below a node of word depth ``depth`` with two leaves.

    ``words[start:]`` is a suffix of stretch ``owner`` in tree ``group``; ``many`` says that the stretch stands for several
    places, so that its suffixes are leaves of such a node by themselves.  The trees are
    split top down, one word at a time; a node with one leaf is cut off at once.
    """
    found, live, node = np.zeros(len(start), bool), np.arange(len(start)), group
    for level in range(depth):
        word = words[start[live] + level]
        order = np.lexsort((word, node))
        live, word, node = live[order], word[order], node[order]
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (word[1:] != word[:-1])])
        node = np.cumsum(new) - 1
        keep = (np.bincount(node)[node] > 1) | many[live]
        live, node = live[keep], node[keep]
        if not len(live):
            return found
    nodes = int(node.max()) + 1
    low, high, twice = np.full(nodes, np.iinfo(np.int64).max), np.full(nodes, -1), np.zeros(nodes, bool)
    np.minimum.at(low, node, owner[live])
    np.maximum.at(high, node, owner[live])
    np.logical_or.at(twice, node, many[live])
    found[live] = ((low != high) | twice)[node]
    return found


def _tree_masks(anchor: np.ndarray, stretch: np.ndarray, many: np.ndarray, payload: list[bytes]) -> pa.RecordBatch:
    length = np.array([len(p) // 8 for p in payload])
    windows = length - WIDTH + 1
    owner = np.repeat(np.arange(len(payload)), windows)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = np.repeat(np.cumsum(length) - length, windows) + k
    found = deep_leaves(np.unique(anchor, return_inverse=True)[1][owner], np.frombuffer(b"".join(payload), U64), start, owner, many[owner], WIDTH)
    mask = np.zeros(len(payload), np.int64)
    np.bitwise_or.at(mask, owner[found], np.int64(1) << k[found])
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(stretch), pa.array(mask)], ["anchor", "stretch", "mask"])


def _trees(batches: Batches) -> Batches:
    """Rows come sorted by anchor and stretch: whole groups are taken together, the last waits for its end."""
    held: list[tuple] = []

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        rows = list(dict.fromkeys(rows))  # a document row that occurs twice brings its stretches twice
        return _tree_masks(*(np.array(c) for c in list(zip(*rows))[:3]), [r[3] for r in rows])

    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            held += zip(*(part.column(c).to_pylist() for c in ("anchor", "stretch", "many", "words")))
            last = held[-1][0]
            if len(held) >= 2048 and held[0][0] != last:
                done = [r for r in held if r[0] != last]
                held = [r for r in held if r[0] == last]
                yield flush(done)
    if held:
        yield flush(held)


def repeated_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h_text, spots: per document with repeats, its (first word, mask of windows from there) pairs."""
    source = _source(docs, doc_id, text)
    kind = next(t for c, t in source.dtypes if c == "doc_id")
    folder = run_folder(docs.sparkSession)
    texts = source.select("text").where("text is not null")
    anchors = texts.mapInArrow(_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    anchors = settled(anchors, folder, "anchors")  # so that both sides of the join are plain shuffles, whose hot keys Spark splits
    places = source.where("text is not null").mapInArrow(_places, f"doc_id {kind}, h_text long, place long, anchor long, stretch long")
    places = settled(places.join(anchors, "anchor", "left_semi"), folder, "places")
    stretches = settled(places.groupBy("anchor", "stretch").agg((F.count("*") > 1).alias("many"), F.min(F.struct("doc_id", "h_text", "place")).alias("spot")), folder, "stretches")
    crowd = settled(stretches.groupBy("anchor").agg(F.count("*").alias("n")), folder, "crowds")
    sized = stretches.join(crowd, "anchor")
    lone = sized.where("n = 1").select("anchor", "stretch", F.expr(f"shiftleft(1L, cast(spot.place % {_PLACE} + 1 as int)) - 1").alias("mask"))
    wanted = sized.where("n > 1").groupBy(F.col("spot.doc_id").alias("doc_id"), F.col("spot.h_text").alias("h_text")).agg(
        F.collect_list(F.struct("anchor", "stretch", "many", F.col("spot.place").alias("place"), (F.col("n") > GROUP).alias("crowded"))).alias("wanted")
    )
    same = [F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), F.col("d.h_text") == F.col("w.h_text")]
    fetched = source.alias("d").join(wanted.alias("w"), same).select("d.text", "w.wanted")
    payload = settled(fetched.mapInArrow(_payloads, "anchor long, stretch long, many boolean, k int, node long, node2 long, words binary"), folder, "suffixes")
    trees = payload.where("k is null").select("anchor", "stretch", "many", "words").repartition("anchor").sortWithinPartitions("anchor", "stretch").mapInArrow(_trees, "anchor long, stretch long, mask long")
    heavy = payload.where("k is not null").select("anchor", "stretch", "many", "k", "node", "node2")
    nodes = heavy.groupBy("node", "node2").agg(F.min("stretch").alias("a"), F.max("stretch").alias("b"), F.max("many").alias("m")).where("a <> b or m").select("node", "node2")
    crowded = heavy.join(nodes, ["node", "node2"], "left_semi").groupBy("anchor", "stretch").agg(F.expr("bit_or(shiftleft(1L, k))").alias("mask"))
    masks = lone.unionByName(trees).unionByName(crowded).where("mask <> 0")
    hits = places.join(masks, ["anchor", "stretch"]).select("doc_id", "h_text", F.shiftright("place", 5).alias("head"), "mask")
    return hits.groupBy("doc_id", "h_text").agg(F.collect_list(F.struct("head", "mask")).alias("spots"))


def _strip(text: str, spots: str, names: Sequence[str]):
    def run(batches: Batches) -> Batches:
        for batch in (part for whole in batches for part in slices(whole, text)):
            words = words_of(batch.column(text))
            change = np.zeros(len(words.code) + 1, np.int64)
            lists = batch.column(spots)
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), [len(x) if x.is_valid else 0 for x in lists])
            head, mask = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for k in range(WIDTH - PREFIX + 1):
                on = (mask >> k) & 1 == 1
                at = words.first[owner[on]] + head[on] + k
                np.add.at(change, at, 1)
                np.add.at(change, at + WIDTH, -1)
            keep = np.cumsum(change[:-1]) == 0
            removed = np.bincount(words.owner()[~keep], minlength=batch.num_rows).astype(np.int64)
            own = [c for c in batch.schema.names if c != spots]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(words.counts.astype(np.int64)), pa.array(removed), pa.array(words.joined(keep), pa.binary()).cast(pa.string())], [*own, *names])

    return run


MADE = ("_n_words", "_n_removed", "_kept")


def strip_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", names: Sequence[str] = MADE) -> DataFrame:
    """All rows and columns, and (called ``names``) the number of words, how many were removed, and the words that stay joined by one space.

    Columns that have one of these names already are replaced.
    """
    docs = docs.drop(*names)
    places, spots = repeated_places(docs, doc_id, text), free_name(docs, "_spots")
    same = [F.col(f"d.{doc_id}").eqNullSafe(F.col("p.doc_id")), F.xxhash64(F.col(f"d.{text}").cast("string")) == F.col("p.h_text")]
    joined = docs.alias("d").join(places.alias("p"), same, "left").select("d.*", F.col("p.spots").alias(spots))
    more = [T.StructField(n, kind) for n, kind in zip(names, (T.LongType(), T.LongType(), T.StringType()))]
    return joined.mapInArrow(_strip(text, spots, names), T.StructType([*docs.schema.fields, *more]))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out; a text that loses nothing stays as it is."""
    names = _, n_removed, kept = [free_name(docs, n) for n in MADE]
    less = F.col(n_removed) > 0
    changed = {"text": F.when(less, F.col(kept)).otherwise(F.col("text"))} | ({"n_chars": F.when(less, F.length(kept)).otherwise(F.col("n_chars")).cast("long")} if "n_chars" in docs.columns else {})
    return strip_repeats(docs, names=names).withColumns(changed).select(docs.columns)


ORACLE = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WIDTH - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {WIDTH - 1})) AS i FROM w)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {WIDTH - 1})) AS p FROM win SEMI JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op3_substring", ORACLE)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """All documents; the digest of the words that stay."""
    out = strip_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None]) -> list[tuple[int, int, str]]:
    """The contract on a small list, for tests."""
    import re
    from collections import Counter

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + WIDTH]) for w in words for i in range(len(w) - WIDTH + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - WIDTH + 1) if seen[tuple(w[i : i + WIDTH])] > 1 for j in range(i, i + WIDTH)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out
