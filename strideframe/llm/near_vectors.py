"""Near-duplicate vectors with a subspace pigeonhole join.

Unit vectors with cosine >= c have a squared distance of at most 2 - 2c.  A randomised Hadamard rotation
spreads it over all coordinates, which are split into ``BLOCKS`` blocks; a pair within the distance is
within a proportional share of it in at least one block.  Each block is range-joined on a grid as
wide as its radius over its first coordinates: a vector lives in one cell and probes that cell and, of the
later half of its neighbours, those that the ball of the block's budget reaches, so two vectors meet once per block.  A pair counts in the first
block that admits it and is confirmed by its cosine in double precision on the stored components.

* Equal vectors are one class first, by a pre-aggregated group-by.
* Cells are dealt in tiles of about ``TILE`` vectors; probes visit all tiles of a cell.  Tiles compare with matrix
  products and give one row per vector that has links: the number of its links and a tile-wide root.
  Pairs are never written, however many there are in a group.
* The number of grid coordinates grows with the logarithm of the number of classes, from 2 to at most 5.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing,
have no links and keep their own id; vectors of different lengths never link; repeated rows are linked
vectors of one class; ids may be null (a null id names no component that has another id, and is never kept); only the
named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.components import components, roots
from strideframe.llm.registry import query, table
from strideframe.llm.scratch import run_folder, settled

BLOCKS, TILE, PROBES, PAIRS, SLACK, MARGIN = 4, 4096, 1024, 50_000, 1e-9, 1e-5
Batches = Iterator[pa.RecordBatch]


def rotated(unit: np.ndarray) -> np.ndarray:
    """Random signs and a Walsh-Hadamard transform: a rotation made of sums only, so every row gives the same result in any batch."""
    size = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), size))
    x[:, : unit.shape[1]] = unit * np.random.default_rng(64).choice([-1.0, 1.0], unit.shape[1])
    half = 1
    while half < size:
        y = x.reshape(len(x), -1, 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), size)
        half *= 2
    return x / math.sqrt(size)


def _blocks(size: int, tau: float) -> list[tuple[slice, float]]:
    """Coordinates and squared-distance budget of each block."""
    edges = [round(size * i / min(BLOCKS, size)) for i in range(min(BLOCKS, size) + 1)]
    return [(slice(a, b), tau * (b - a) / size) for a, b in zip(edges, edges[1:])]


def _units(raw: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _identify(kind: type):
    """raw bytes and a 128-bit identity of each usable vector; nulls for the others."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            raw: list[bytes | None] = []
            for v in batch.column("v"):
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid and len(v.values) and v.values.null_count == 0 else None
                fine = x is not None and np.isfinite(x).all()
                norm = float((x.astype(float) ** 2).sum()) if fine else 0.0
                raw.append(x.tobytes() if fine and 0 < norm < math.inf else None)
            keys = [hashlib.blake2b(r, digest_size=16).digest() if r is not None else None for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary()), *(pa.array([None if k is None else int.from_bytes(k[i : i + 8], "little", signed=True) for k in keys], pa.int64()) for i in (0, 8))], ["vec_id", "raw", "cid", "cid2"])

    return run


def _lists(owner: list[np.ndarray], code: list[np.ndarray], n: int) -> pa.Array:
    """One list of codes per row."""
    rows, codes = np.concatenate([*owner, np.zeros(0, np.int64)]), np.concatenate([*code, np.zeros(0, np.int64)])
    order = np.argsort(rows, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(rows, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(codes[order]))


def _cells(kind: type, tau: float, axes: int):
    """The home cell of each vector, and the later neighbour cells that the ball of its block's budget reaches."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            homes, probes = ([], []), ([], [])
            for length in {len(r) for r in raw}:
                rows = np.array([i for i, r in enumerate(raw) if len(r) == length])
                turned = rotated(_units([raw[i] for i in rows], kind))
                for b, (part, budget) in enumerate(_blocks(turned.shape[1], tau)):
                    g, width = min(axes, part.stop - part.start), math.sqrt(budget + SLACK)
                    scaled = turned[:, part.start : part.start + g] / width
                    at = np.floor(scaled).astype(np.int64)
                    below = (scaled - at) ** 2
                    above = (1 - scaled + at) ** 2
                    head = (length * BLOCKS + b) << 40
                    code = lambda x: head + ((x + 128) << (8 * np.arange(x.shape[1]))).sum(1)  # noqa: B023, E731
                    homes[0].append(rows)
                    homes[1].append(code(at))
                    for step in itertools.product((-1, 0, 1), repeat=g):
                        if step > (0,) * g:
                            way = np.array(step)
                            near = (below * (way < 0) + above * (way > 0)).sum(1) <= 1 + SLACK
                            probes[0].append(rows[near])
                            probes[1].append(code(at[near] + way))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), _lists(*homes, len(raw)), _lists(*probes, len(raw))], ["cid", "homes", "probes"])

    return run


def _tile(kind: type, least: float, tau: float):
    """Rows come sorted by (cell, salt, role): homes (0), probes of the own cell (1) and of neighbours (2)."""
    turns: dict[int, np.ndarray] = {}

    def loaded(raw: list[bytes], part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors, their coordinates of a block in single precision, and the squares of these."""
        unit = _units(raw, kind)
        d = unit.shape[1]
        if d not in turns:
            turns[d] = rotated(np.eye(d)).astype(np.float32)
        x = unit.astype(np.float32) @ turns[d][:, part]
        return unit, x, np.einsum("ij,ij->i", x, x)

    def met(block: int, homes: tuple, probes: tuple, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (probe, home) of linked pairs that count in this block.

        A single-precision product with a margin finds the pairs; the budgets and the cosine of those are taken in double precision.
        """
        (id_h, (unit_h, h, h2)), (id_p, (unit_p, p, p2)) = homes, probes
        parts = _blocks(1 << max(0, unit_h.shape[1] - 1).bit_length(), tau)
        part, budget = parts[block]
        gap = p @ h.T
        gap *= -2
        gap += h2
        gap += p2[:, None]
        x, y = np.nonzero(gap <= np.float32(budget + MARGIN))
        if own:
            first = id_p[x] < id_h[y]
            x, y = x[first], y[first]
        for at in range(0, len(x), PAIRS):
            i, j = x[at : at + PAIRS], y[at : at + PAIRS]
            (some_p, of_p), (some_h, of_h) = (np.unique(k, return_inverse=True) for k in (i, j))
            gaps = (rotated(unit_p[some_p])[of_p] - rotated(unit_h[some_h])[of_h]) ** 2
            keep = gaps[:, part].sum(1) <= budget + SLACK
            for before, share in parts[:block]:
                keep &= gaps[:, before].sum(1) > share + SLACK
            i, j = i[keep], j[keep]
            keep = (unit_p[i] * unit_h[j]).sum(1) >= least
            yield i[keep], j[keep]

    def run(batches: Batches) -> Batches:
        key, parts = None, []
        homes: tuple | None = None
        for batch in batches:
            cell, salt, role, cid, many = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "salt", "role", "cid", "many"))
            raw = batch.column("raw").to_pylist()
            edges = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1]) | (role[1:] != role[:-1]), [True]]))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(edges, edges[1:]):
                if key != (cell[lo], salt[lo]):
                    key, parts, homes = (cell[lo], salt[lo]), [], None
                if role[lo] == 0:
                    parts.append((cid[lo:hi], many[lo:hi], raw[lo:hi]))
                    continue
                if not parts and homes is None:
                    continue
                block, length = int(cell[lo] >> 40) % BLOCKS, len(raw[lo]) // np.dtype(kind).itemsize
                part = _blocks(1 << max(0, length - 1).bit_length(), tau)[block][0]
                if homes is None:
                    homes, weight = (np.concatenate([p[0] for p in parts]), loaded([r for p in parts for r in p[2]], part)), np.concatenate([p[1] for p in parts])
                for at in range(lo, hi, PROBES):
                    to = min(hi, at + PROBES)
                    found = list(met(block, homes, (cid[at:to], loaded(raw[at:to], part)), role[lo] == 1))
                    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
                    if len(i):
                        n = to - at
                        ids = np.concatenate([cid[at:to], homes[0]])
                        links = np.concatenate([np.bincount(i, weights=weight[j], minlength=n), np.bincount(j, weights=many[at:to][i], minlength=len(homes[0]))]).astype(np.int64)
                        root = ids[roots(len(ids), i, j + n)]
                        some = links > 0
                        out.append((ids[some], links[some], root[some]))
            columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "links", "b"])

    return run


def _axes(n: int) -> int:
    """Grid coordinates per block: a cell of isotropic vectors holds about 0.4**axes of them, and should hold a few tiles."""
    axes = 2
    while axes < 5 and n * 0.4**axes > 8 * TILE:
        axes += 1
    return axes


def near_vectors(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    folder, tau = run_folder(vectors.sparkSession), 2 - 2 * least
    double = "double" in dict(vectors.dtypes)[vector]
    kind = np.float64 if double else np.float32
    source = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>" if double else "array<float>").alias("v"))
    id_kind = dict(source.dtypes)["vec_id"]
    rows = settled(source.mapInArrow(_identify(kind), f"vec_id {id_kind}, raw binary, cid long, cid2 long"), folder, "rows")
    classes = rows.where("cid is not null").groupBy("cid", "cid2").agg(F.count("*").alias("many"), F.min("vec_id").alias("least_id"), F.first("raw").alias("raw"))
    classes = settled(classes, folder, "classes")
    axes = _axes(classes.count())
    cells = settled(classes.select("cid", "raw").mapInArrow(_cells(kind, tau, axes), "cid long, homes array<long>, probes array<long>"), folder, "cells")
    homes = cells.select("cid", F.explode("homes").alias("cell"))
    tiles = homes.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("long").alias("n"))
    visits = homes.withColumn("role", F.lit(1)).unionByName(cells.select("cid", F.explode("probes").alias("cell"), F.lit(2).alias("role")))
    dealt = homes.join(tiles, "cell").select("cid", "cell", F.pmod(F.xxhash64("cid"), "n").alias("salt"), F.lit(0).alias("role")).unionByName(
        visits.join(tiles, "cell").select("cid", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("salt"), "role")
    )
    loaded = dealt.join(classes.select("cid", "many", "raw"), "cid").repartition("cell", "salt").sortWithinPartitions("cell", "salt", "role")
    found = settled(loaded.mapInArrow(_tile(kind, least, tau), "a long, links long, b long"), folder, "found")
    labels = components(found.where("a <> b").select("a", "b").distinct(), folder, "joined")
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "many", "least_id").join(labels, F.col("cid") == F.col("id"), "left").join(counts, F.col("cid") == F.col("a"), "left")
    named = named.select("cid", F.coalesce("comp", "cid").alias("comp"), (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least_id")
    heads = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(heads, "comp").select("cid", "n_links", "component_id")
    out = rows.select("vec_id", "cid").join(of_class, "cid", "left")
    own = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND x.norm > 0 AND y.norm > 0 AND list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.95),
closed(a, b) AS (SELECT a, b FROM link UNION SELECT c.a, l.b FROM closed c JOIN link l ON l.a = c.b),
least_id AS (SELECT a AS vec_id, min(b) AS m FROM closed GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN least_id USING (vec_id)
"""


@query("op1_near_vectors", ORACLE)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors at cosine 0.95."""
    return near_vectors(table(spark, folder, "embeddings"))
