"""The scan over sorted ranges against plain loops, with ranges that cut keys, runs and islands."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strideframe.operators import ranges
from strideframe.operators.ranges import scan_islands, scan_rows


def _rows(seed: int, n: int, keys: int):
    """A third of the rows in one key; ties in time; NULL keys, labels and values."""
    rng = random.Random(seed)
    out, t = [], 0.0
    for i in range(n):
        t += rng.choice([0.0, 1.0, 2.5, 40.0])
        key = 0 if i % 3 == 0 else rng.choice([None, *range(keys)])
        out.append((key, t, i, rng.choice("aaab") if i % 50 else None, rng.choice([None, 1.0, 4.0, 70.0])))
    rng.shuffle(out)
    return out


def _grouped(rows):
    by: dict = {}
    for r in sorted(rows, key=lambda x: (x[1], x[2])):
        by.setdefault(r[0], []).append(r)
    return by


CASES = [(1, 400, 3, 7), (2, 400, 90, 7), (3, 60, 1, 40), (4, 5, 2, 8), (5, 300, 1, 1)]


def _frame(spark, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    return spark.createDataFrame(rows, "rec int, t double, id int, lab string, v double").repartition(3)


@pytest.fixture(autouse=True)
def _restore(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")
    old = {n: spark.conf.get(n) for n in names}
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("seed, n, keys, parts", CASES)
def test_scan_rows(spark, seed, n, keys, parts):
    rows = _rows(seed, n, keys)
    out = scan_rows(_frame(spark, rows, parts), ["rec"], ["t", "id"], label="lab", lag=["v", "lab"], lead=["t", "v"])
    got = {r.id: r for r in out.collect()}
    assert len(got) == n
    for seq in _grouped(rows).values():
        run = 0
        for i, x in enumerate(seq):
            run += i == 0 or seq[i - 1][3] != x[3]
            r, was, then = got[x[2]], seq[i - 1] if i else (None,) * 5, seq[i + 1] if i + 1 < len(seq) else (None,) * 5
            assert (r.pos, r.run_id) == (i + 1, run)
            assert (r.lag_v, r.lag_lab, r.lead_t, r.lead_v) == (was[4], was[3], then[1], then[4])


@pytest.mark.parametrize("label", [None, "lab"])
@pytest.mark.parametrize("seed, n, keys, parts", CASES)
def test_scan_islands(spark, seed, n, keys, parts, label):
    rows = [(r[0], r[1], r[2], r[3], None if r[4] is None else r[1] + r[4]) for r in _rows(seed, n, keys)]
    got = {r.id: r for r in scan_islands(_frame(spark, rows, parts), ["rec"], "t", "v", 3.0, tie=["id"], label=label).collect()}
    for seq in _grouped(rows).values():
        run, island, reach = 0, 0, None
        for i, x in enumerate(seq):
            if label and i and seq[i - 1][3] == x[3] or not label and i:
                fresh = False
            else:
                fresh, run = True, run + 1
            island = 1 if fresh else island + (reach is None or x[1] - reach > 3.0)
            reach = x[4] if fresh or reach is None else max(reach, x[4]) if x[4] is not None else reach
            assert got[x[2]].island_id == island and (not label or got[x[2]].run_id == run)


def test_ranges_are_bounded_for_sparse_and_dense_keys(spark):
    """One key with a third of the rows, spread over a century or over a minute, and thousands of small ones."""
    for step in (1e5, 1e-3):
        rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("rec"), (F.col("id") * step).alias("t"), "id")
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        walked = ranges._walked(rows, ["t", "id"], ranges._Walk(["rec"]))
        sizes = [r["count"] for r in walked.groupBy("_range").count().collect()]
        assert len(sizes) == 20 and max(sizes) < 3 * 30_000 / 20
        assert walked.filter("_edge > 0").count() <= 4 * 20
        assert scan_rows(rows, ["rec"], ["t", "id"]).filter("rec = 0").agg(F.max("pos")).first()[0] == 10_000


def test_no_rows(spark):
    none = _frame(spark, [], 4)
    assert scan_rows(none, ["rec"], ["t", "id"], label="lab").count() == 0 and scan_islands(none, ["rec"], "t", "v", 1.0).count() == 0
