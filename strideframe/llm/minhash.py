"""Near-duplicate documents with HyperMinHash.

A document's set is its distinct ``SHINGLE``-word runs after lower-casing A-Z; with fewer words the whole
sequence is one element.  Each element falls into one of ``BUCKETS`` buckets, whose register keeps
the leading-zero count of the least value and ``MANTISSA`` bits after it.  Empty buckets borrow the
register of another one, along a fixed random sequence of buckets, so that short sets keep the
collision probability of long ones.  ``BANDS`` bands of ``ROWS`` registers give the candidates.

* Documents with equal sets become one class first, by a pre-aggregated group-by.
* In each band bucket every class is compared with one pivot, the class that shares most buckets
  with others.  Pairs whose Jaccard estimate, corrected for chance collisions of registers, lies
  ``MARGIN`` standard errors below the threshold are dropped; the rest is confirmed on full sets.
* Classes of one bucket that are still in different components are then compared with each other, so
  nothing rests on the choice of the pivot; pairs inside a component need no comparison.  Up to ``SMALL`` classes meet pair by
  pair under the same estimate.  Larger buckets are dealt in tiles of two blocks of about ``BLOCK`` classes, which compare
  full sets by matrix products and give a spanning forest of the links, never the pairs.
* A pivot's partners are dealt over tasks in slices of ``SLICE``; no task holds a group.

A pair at the threshold misses all bands with probability 8e-7 and the estimate with 1e-6.

Defined cases: null texts and texts without words have no element, link with nothing and keep
their own id; rows that repeat a document are members of one class; a null id links like any other but
never names a component that has another id, and is never ``kept``; very long texts cost memory for
their word hashes; only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.components import components, roots
from strideframe.llm.registry import query, table
from strideframe.llm.scratch import free_name, run_folder, settled, without_keys
from strideframe.llm.textkit import U64, mixed, run_hashes, signed, slices, words_of

SHINGLE, BUCKETS, MANTISSA, BANDS, ROWS, SLICE, MARGIN, SMALL, BLOCK = 5, 128, 10, 24, 5, 256, 5.0, 32, 400
Batches = Iterator[pa.RecordBatch]
_DONORS = np.random.default_rng(20_011).integers(0, BUCKETS, (4096, BUCKETS))


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all texts, sorted within each text, and where each text's begin."""
    words = words_of(texts, lower=True)
    n, size = len(words.code), words.counts
    owner = words.owner()
    at = np.arange(n)
    stop = np.minimum(at + SHINGLE, words.first[owner + 1])
    full = (stop - at == SHINGLE) | ((at == words.first[owner]) & (size[owner] < SHINGLE))
    at, stop, owner = at[full], stop[full], owner[full]
    code = run_hashes(words.code, at, stop)
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    if len(code):
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])])
        code, owner = code[new], owner[new]
    return code, np.searchsorted(owner, np.arange(len(size) + 1))


def registers(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of registers for each set (at least one element each)."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    value = mixed(code ^ U64(0x5851F42D4C957F2D))
    slot = (value >> U64(57)).astype(np.int64) if BUCKETS == 128 else (value % U64(BUCKETS)).astype(np.int64)
    least = np.full((len(first) - 1) * BUCKETS, np.iinfo(np.int64).max)
    rest = (mixed(value) >> U64(1)).view(np.int64)
    np.minimum.at(least, owner * BUCKETS + slot, rest)
    least = least.reshape(-1, BUCKETS)
    exponent = np.frexp(np.maximum(least, 1).astype(float))[1]
    zeros = 63 - exponent
    shift = np.maximum(exponent - 1 - MANTISSA, 0)
    out = (zeros << MANTISSA) | ((least >> shift) & ((1 << MANTISSA) - 1))
    empty = least == np.iinfo(np.int64).max
    full, bare = out.copy(), np.flatnonzero(empty.any(1))
    todo = empty[bare]
    for donors in _DONORS:
        if not len(bare):
            break
        take = todo & ~empty[bare][:, donors]
        full[bare] = np.where(take, out[bare][:, donors], full[bare])
        todo = todo & ~take
        live = todo.any(1)
        bare, todo = bare[live], todo[live]
    if len(bare):
        full[bare] = np.where(todo, out[bare, np.argmin(empty[bare], 1)][:, None], full[bare])
    return full


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key for each band of each row of registers."""
    part = regs[:, : BANDS * ROWS].astype(U64).reshape(len(regs), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), (len(regs), BANDS))
    for i in range(ROWS):
        key = mixed(key * U64(0x9E3779B97F4A7C15) + part[:, :, i])
    return key


def chance() -> float:
    """The probability that registers of two unlike sets of about one size are equal: that two exponential values share binade and mantissa."""
    lo = np.concatenate([2.0**k * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) for k in range(-24, 6)])
    edges = np.concatenate([lo, [64.0]])
    return float((np.diff(-np.exp(-edges)) ** 2).sum())


def _sketch(batches: Batches) -> Batches:
    names = ["doc_id", "h_text", "n", "set_id", "regs", "bands"]
    for batch in (part for whole in batches for part in slices(whole, "text")):
        code, first = _sets(batch.column("text"))
        n = np.diff(first)
        some = np.flatnonzero(n)
        edge = np.concatenate([[0], np.cumsum(n[some])])
        regs, bands = np.zeros((len(n), BUCKETS), np.int16), np.zeros((len(n), BANDS), np.int64)
        identity = np.zeros(len(n), U64)
        if len(some):
            r = registers(code, edge)
            regs[some], bands[some] = r.astype(np.uint16).view(np.int16), band_keys(r).view(np.int64)
            identity[some] = run_hashes(code, edge[:-1], edge[1:])
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (regs, bands)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h_text"), pa.array(n.astype(np.int64)), signed(identity), *lists], names)


def _confirm(least_percent: int):
    """Rows come sorted by (a, slice, role): the pivot's text, then its partners'."""

    def run(batches: Batches) -> Batches:
        pivot, pivot_set = None, np.zeros(0, U64)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            code, first = _sets(batch.column("text"))
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            out: list[tuple[int, int]] = []
            for i, role in enumerate(batch.column("role").to_pylist()):
                own = code[first[i] : first[i + 1]]
                if role == 0:
                    pivot, pivot_set = a[i], own
                elif pivot == a[i]:
                    both = len(np.intersect1d(pivot_set, own, assume_unique=True))
                    if 100 * both >= least_percent * (len(pivot_set) + len(own) - both):
                        out.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections."""
    owner, flat = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times[column] > 1
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, 4096):
        part = (column >= at) & (column < at + 4096)
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[part], column[part] - at] = 1
        out += held @ held.T
    return out.astype(np.int64)


def _tiles(least_percent: int):
    """Rows come sorted by (band, tile): the classes of two blocks with their texts."""

    def links(ids: list[int], comps: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        both, size = _shared(sets), np.array([len(x) for x in sets])
        comp, ids = np.array(comps), np.array(ids)
        good = (100 * both >= least_percent * (size[:, None] + size[None] - both)) & (comp[:, None] != comp[None])
        i, j = np.nonzero(good)
        root = ids[roots(len(ids), i, j)]
        return ids[root != ids], root[root != ids]

    def run(batches: Batches) -> Batches:
        key, held = None, ([], [], [])
        for batch in (part for whole in batches for part in slices(whole, "text")):
            code, first = _sets(batch.column("text"))
            out = []
            for i, (band, tile, ident, comp) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("band", "tile", "set_id", "comp")))):
                if key != (band, tile):
                    if held[0]:
                        out.append(links(*held))
                    key, held = (band, tile), ([], [], [])
                for column, value in zip(held, (ident, comp, code[first[i] : first[i + 1]])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64)) for k in (0, 1)], ["a", "b"])
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(*held)], ["a", "b"])

    return run


def _likely(left: Column, right: Column, least_percent: int) -> Column:
    """The corrected Jaccard estimate is not ``MARGIN`` standard errors below the threshold."""
    j, c = least_percent / 100, chance()
    least = BUCKETS * (j + (1 - j) * c) - MARGIN * math.sqrt(BUCKETS * j * (1 - j))
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) >= least


def _texts(ids: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """set_id, text of the named classes."""
    spots = classes.join(ids, "set_id", "left_semi").select("set_id", F.col("spot.doc_id").alias("doc_id"), F.col("spot.h_text").alias("h_text"))
    same = [F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), F.col("d.h_text") == F.col("s.h_text")]
    return source.alias("d").join(spots.alias("s"), same).select("s.set_id", "d.text")


def _links(pairs: DataFrame, classes: DataFrame, source: DataFrame, least_percent: int, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select(F.col("b").alias("set_id"))).distinct()
    texts = settled(_texts(ids, classes, source), folder, f"{name}_texts")
    sliced = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLICE).alias("n"))
    partners = pairs.join(sliced, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("n").cast("long")).alias("slice"), F.lit(1).alias("role")).join(texts, F.col("b") == F.col("set_id")).drop("set_id")
    pivots = sliced.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("slice"), F.lit(0).alias("role")).join(texts, F.col("a") == F.col("set_id")).drop("set_id")
    dealt = partners.unionByName(pivots).repartition("a", "slice").sortWithinPartitions("a", "slice", "role")
    return settled(dealt.mapInArrow(_confirm(least_percent), "a long, b long").distinct(), folder, name)


def near_duplicates(docs: DataFrame, least_percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, h_text, n_shingles, component_id, kept and group, the component as a number. Links have at least ``least_percent`` hundredths of Jaccard similarity."""
    folder = run_folder(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("h_text"), F.col(text).cast("string").alias("text"))
    kind = next(t for c, t in source.dtypes if c == "doc_id")
    sketches = settled(source.mapInArrow(_sketch, f"doc_id {kind}, h_text long, n long, set_id long, regs array<short>, bands array<long>"), folder, "sketches")
    classes = settled(
        sketches.where("n > 0").groupBy("set_id").agg(F.min(F.struct("doc_id", "h_text")).alias("spot"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")), folder, "classes"
    )
    rows = classes.select("set_id", "n", F.explode("bands").alias("band"))
    # settled before the join: then both its sides are plain shuffles, whose hot keys Spark splits
    crowds = settled(rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), folder, "crowds")
    shared = settled(rows.join(crowds, "band"), folder, "shared")
    known = shared.groupBy("set_id").agg(F.sum("size").alias("met"))
    pivots = shared.join(known, "set_id").groupBy("band").agg(F.max(F.struct("met", "set_id", "n")).alias("p")).select("band", F.col("p.set_id").alias("a"), F.col("p.n").alias("n_a"))
    pivots = settled(pivots, folder, "pivots")
    fits = lambda x, y: 100 * F.least(x, y) >= least_percent * F.greatest(x, y)
    star = shared.join(pivots, "band").where("set_id <> a").where(fits(F.col("n"), F.col("n_a"))).select("a", F.col("set_id").alias("b")).distinct()
    regs = lambda end: classes.select(F.col("set_id").alias(end), F.col("regs").alias(f"regs_{end}"))
    likely = lambda pairs: pairs.join(regs("a"), "a").join(regs("b"), "b").where(_likely(F.col("regs_a"), F.col("regs_b"), least_percent)).select("a", "b")
    star = settled(likely(star), folder, "star")
    links = _links(star, classes, source, least_percent, folder, "links")
    labels = components(links, folder, "first")
    marked = shared.join(labels, F.col("set_id") == F.col("id"), "left").select("band", "set_id", "n", F.coalesce("comp", "set_id").alias("comp"))
    split = marked.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("band", "size")
    open_ = settled(marked.join(split, "band"), folder, "open")
    side = open_.where(F.col("size") <= SMALL).join(classes.select("set_id", "regs"), "set_id")
    x, y = side.alias("x"), side.alias("y")
    rest = x.join(y, [F.col("x.band") == F.col("y.band"), F.col("x.set_id") < F.col("y.set_id"), F.col("x.comp") != F.col("y.comp"), fits(F.col("x.n"), F.col("y.n")), _likely(F.col("x.regs"), F.col("y.regs"), least_percent)])
    rest = rest.select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _links(settled(rest.join(tried, ["a", "b"], "left_anti"), folder, "rest"), classes, source, least_percent, folder, "more")
    large = open_.where(F.col("size") > SMALL).withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
    # a tile is a pair of blocks, named by both; a bucket of one block is one tile
    partners = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: (F.col("blocks") == 1) | (k != F.col("block")))
    tiles = large.select("band", "set_id", "comp", "blocks", "block", F.explode(partners).alias("k")).select("band", "set_id", "comp", (F.least("block", "k") * F.col("blocks") + F.greatest("block", "k")).alias("tile"))
    dealt = tiles.join(_texts(large.select("set_id").distinct(), classes, source), "set_id").repartition("band", "tile").sortWithinPartitions("band", "tile", "set_id")
    forest = settled(dealt.mapInArrow(_tiles(least_percent), "a long, b long").distinct(), folder, "forest")
    more = more.unionByName(forest)
    if not more.isEmpty():
        labels = components(links.unionByName(more), folder, "second")
    named = classes.select("set_id", "least_id").join(labels, F.col("set_id") == F.col("id"), "left").select("set_id", "least_id", F.coalesce("comp", "set_id").alias("comp"))
    heads = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(heads, "comp").select("set_id", "component_id", F.col("comp").alias("group"))
    out = sketches.select("doc_id", "h_text", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")).join(of_class, "set_id", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "h_text", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"), "group")


def one_of_each(docs: DataFrame, least_percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates (the least id), and all without words; with all their columns.

    Of rows that repeat a document's id and text one stays.
    """
    judged = settled(near_duplicates(docs, least_percent).where("group is not null"), run_folder(docs.sparkSession), "judged")
    rank = lambda: F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h_text")
    heads = judged.groupBy("group").agg(F.min(rank()).alias("head"))
    losers = judged.join(heads, "group").where(~F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h_text").eqNullSafe(F.col("head"))).select("doc_id", "h_text").distinct()
    out = without_keys(docs, settled(losers, run_folder(docs.sparkSession), "losers"))
    if judged.groupBy("doc_id", "h_text").count().where("count > 1").isEmpty():
        return out
    digest = free_name(docs, "_hash")
    return out.withColumn(digest, F.xxhash64("text")).dropDuplicates(["doc_id", digest]).drop(digest)


ORACLE = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - {SHINGLE - 1}))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM meet JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
closed(a, b) AS (SELECT a, b FROM link UNION SELECT c.a, l.b FROM closed c JOIN link l ON l.a = c.b),
least_id AS (SELECT a AS doc_id, min(b) AS m FROM closed GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""


@query("op10_minhash", ORACLE)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """All documents at Jaccard 0.85."""
    return near_duplicates(table(spark, folder, "documents"), 85).drop("h_text", "group")


def brute_force(rows: list[tuple[int, str | None]], least_percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id) by comparing all pairs, for tests."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, by = [], {}
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        met: dict[int, int] = {}
        for g in s:
            for k in by.setdefault(g, []):
                met[k] = met.get(k, 0) + 1
            by[g].append(i)
        for k, both in met.items():
            if 100 * both >= least_percent * (len(s) + len(sets[k]) - both):
                up[root(i)] = root(k)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}
