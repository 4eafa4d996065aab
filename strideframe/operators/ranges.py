"""Ordered operators as a scan over sorted ranges.

Rows are range-partitioned by (key, order): Spark samples split points from the data, so a
range holds about as many rows as any other, whether its key is sparse, dense or one of
thousands.  Each range is sorted and walked once in Arrow batches; the walk numbers rows and
runs, looks at neighbours and folds interval ends, all as if the range stood alone, and the
result is written as a table.  Only the first key of a range can go on from the range
before, so what crosses the edges is known from at most four rows per range: a scan over
those gives one carried row a range, and adding it to the walked rows is an expression.
No window ever holds a key; the windows below are over edge rows, whose number the shuffle
partitions bound, and so is the broadcast of carried rows.

Keys may be NULL (one key); the order has NULLs first and should be total, else equal rows are numbered in any
order.  Key and label columns are scalars.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from strideframe.session import written

_FIRST, _LAST, _KEY_END, _RUN_END = 1, 2, 4, 8
_FIELDS = "_range int, _edge int, _key0 boolean, _run0 boolean, _i long, _c long"


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before; NULLs are equal to each other, and so are NaNs."""
    a = column.combine_chunks()
    now, was = a.slice(1), a.slice(0, len(a) - 1)
    other = pc.fill_null(pc.not_equal(now, was), False)
    if pa.types.is_floating(a.type):
        other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(now), pc.is_nan(was)), False))
    other = pc.or_(other, pc.xor(pc.is_null(now), pc.is_null(was)))
    return np.append(True, other.to_numpy(zero_copy_only=False))


def _since(starts: np.ndarray, values: np.ndarray, carried: int) -> np.ndarray:
    """Running sums of ``values`` that begin anew at ``starts``; before the first start they go on from ``carried``."""
    total = np.cumsum(values)
    at = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), -1))
    return total - np.where(at >= 0, total[at] - values[at], -carried)


def _greatest(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running maximum of ``values`` in each of the ascending groups, taken over ranks so that one pass does for all."""
    held, rank = np.unique(values, return_inverse=True)
    return held[np.maximum.accumulate((group - group[0]) * len(held) + rank) % len(held)]


@dataclass(frozen=True)
class _Walk:
    """What one pass over a sorted range adds to its rows."""

    keys: list[str]
    label: str | None = None
    lag: list[str] = field(default_factory=list)
    lead: list[str] = field(default_factory=list)
    span: tuple[str, str] | None = None
    gap: float = 0.0

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"key": -1, "run": -1, "i": 0, "c": 0, "reach": -np.inf, "opened": 0}
        before = held = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                table = table if held is None else pa.concat_tables([held, table])
                if table.num_rows > 1:
                    yield from self._rows(before, table, state, False).to_batches()
                    before = table.slice(table.num_rows - 2, 1)
                held = table.slice(table.num_rows - 1)
        if held is not None:
            yield from self._rows(before, held, state, True).to_batches()

    def _rows(self, before: pa.Table | None, table: pa.Table, state: dict, last: bool) -> pa.Table:
        """``table`` with its marks, without its last row unless the range ends with it; ``before`` is the row ahead of it."""
        full = table if before is None else pa.concat_tables([before, table])
        skip, n = full.num_rows - table.num_rows, table.num_rows - (not last)
        key = np.logical_or.reduce([_differs(full.column(c)) for c in self.keys]) if self.keys else np.arange(full.num_rows) == 0
        run = key | _differs(full.column(self.label)) if self.label else key
        key, key_next = key[skip : skip + n], np.append(key[skip + 1 : skip + 1 + n], np.ones(int(last), bool))
        run, run_next = run[skip : skip + n], np.append(run[skip + 1 : skip + 1 + n], np.ones(int(last), bool))
        key_no, run_no = state["key"] + np.cumsum(key), state["run"] + np.cumsum(run)
        i, c = _since(key, np.ones(n, np.int64), state["i"]), _since(key, (run & ~key).astype(np.int64), state["c"])
        edge = np.where((key_no == 0) & key_next, _KEY_END, 0) | np.where((run_no == 0) & run_next, _RUN_END, 0)
        edge[0] |= _FIRST * (before is None)
        edge[-1] |= _LAST * last
        out = table.slice(0, n)
        marks = [pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(edge, pa.int32()), pa.array(key_no == 0), pa.array(run_no == 0), pa.array(i), pa.array(c)]
        for name, values in zip(("_range", "_edge", "_key0", "_run0", "_i", "_c"), marks):
            out = out.append_column(name, values)
        for c_, shift, cut in [*((x, -1, key) for x in self.lag), *((x, 1, key_next) for x in self.lead)]:
            at = np.arange(skip, skip + n) + shift
            cut = cut | (at < 0) | (at >= full.num_rows)
            taken = full.column(c_).take(pa.array(np.clip(at, 0, full.num_rows - 1), mask=cut))
            out = out.append_column(f"_{'lag' if shift < 0 else 'lead'}_{c_}", taken)
        if self.span:
            start, end = (out.column(x).cast(pa.float64()).to_numpy() for x in self.span)
            upto = _greatest(run_no, np.where(np.isnan(end), -np.inf, end))
            upto = np.where(run_no == state["run"], np.maximum(upto, state["reach"]), upto)
            ahead = np.where(run, -np.inf, np.append(state["reach"], upto[:-1]))
            opened = run | (start - ahead > self.gap)
            island = _since(run, opened.astype(np.int64), state["opened"])
            for name, values in (("_upto", upto), ("_open", opened), ("_island", island)):
                out = out.append_column(name, pa.array(values))
            state |= {"reach": upto[-1], "opened": int(island[-1])}
        state |= {"key": int(key_no[-1]), "run": int(run_no[-1]), "i": int(i[-1]), "c": int(c[-1])}
        return out

    def schema(self, df: DataFrame) -> T.StructType:
        fields = [*df.schema.fields, *T.StructType.fromDDL(_FIELDS).fields]
        fields += [T.StructField(f"_lag_{c}", df.schema[c].dataType) for c in self.lag] + [T.StructField(f"_lead_{c}", df.schema[c].dataType) for c in self.lead]
        return T.StructType([*fields, *(T.StructType.fromDDL("_upto double, _open boolean, _island long").fields if self.span else [])])


def _walked(df: DataFrame, order: Sequence[str], walk: _Walk) -> DataFrame:
    """The sorted ranges of ``df`` with the marks of ``walk``, written and read back."""
    by = [*walk.keys, *order]
    ranges = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(ranges.mapInArrow(walk, walk.schema(df)))


def _bit(mark: int) -> Column:
    return F.col("_edge").bitwiseAND(F.lit(mark)) > 0


def _carried(rows: DataFrame, walk: _Walk) -> DataFrame:
    """One row a range: what its first key goes on from, and what follows its last row."""
    keys, label = walk.keys, [walk.label] if walk.label else []
    ends = rows.filter(_bit(_KEY_END) | _bit(_LAST)).select("_range", *keys, _bit(_KEY_END).alias("_in"), _bit(_LAST).alias("_out"), "_i", "_c", F.struct(F.lit(True).alias("_"), *dict.fromkeys([*walk.lag, *label])).alias("_tail"))
    heads = rows.filter(_bit(_FIRST)).select(F.col("_range").alias("_r"), F.struct(F.lit(True).alias("_"), *dict.fromkeys([*walk.lead, *label])).alias("_head"))
    parts = ends.join(heads, (F.col("_range") == F.col("_r")) & F.col("_in"), "left").drop("_r")
    over = Window.partitionBy(*keys).orderBy("_range")
    ahead = over.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_prev": F.lag("_tail").over(over), "_next": F.lead("_head").over(over), "_off": F.coalesce(F.sum("_i").over(ahead), F.lit(0)), "_chg": F.coalesce(F.sum("_c").over(ahead), F.lit(0))})
    if label:
        crossing = F.col("_in") & F.col("_prev").isNotNull() & ~F.col(f"_prev.{walk.label}").eqNullSafe(F.col(f"_head.{walk.label}"))
        parts = parts.withColumn("_chg", F.col("_chg") + F.sum(crossing.cast("long")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    first = parts.filter("_in").select("_range", "_off", "_chg", "_prev")
    last = parts.filter("_out").select("_range", "_next")
    return first.join(last, "_range")


def scan_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, label: str | None = None, lag: Sequence[str] = (), lead: Sequence[str] = ()) -> DataFrame:
    """Row position per key, and optionally run number and neighbour values.

    Adds ``pos`` (1-based); ``run_id`` (1-based, grows when ``label`` differs from the
    previous row) when a label is given; ``lag_<c>`` and ``lead_<c>``.
    """
    walk = _Walk(list(keys), label, list(dict.fromkeys(lag)), list(dict.fromkeys(lead)))
    rows = _walked(df, order, walk)
    joined = rows.join(F.broadcast(_carried(rows, walk)), "_range")
    out = {"pos": F.col("_i") + F.when(F.col("_key0"), F.col("_off")).otherwise(0)}
    if label:
        out["run_id"] = F.col("_c") + F.when(F.col("_key0"), F.col("_chg")).otherwise(0) + 1
    for c in walk.lag:
        out[f"lag_{c}"] = F.when(F.col("_key0") & (F.col("_i") == 1), F.col(f"_prev.{c}")).otherwise(F.col(f"_lag_{c}"))
    for c in walk.lead:
        out[f"lead_{c}"] = F.when(_bit(_LAST), F.col(f"_next.{c}")).otherwise(F.col(f"_lead_{c}"))
    return joined.select(*df.columns, *[v.alias(k) for k, v in out.items()])


def scan_islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float, *, tie: Sequence[str] = (), label: str | None = None, out: str = "island_id") -> DataFrame:
    """Number the islands of intervals: a new one begins where ``start`` is more than ``gap``
    after every earlier end.  With a label, islands are numbered inside runs of equal labels,
    and ``run_id`` is added.

    One ordered pass.  A range that goes on with the run of the range before opens a row only if
    it would alone and if the carried end is far enough as well; starts ascend, so the
    rows that the carried end still reaches come first, and their openings are simply subtracted.
    """
    walk = _Walk(list(keys), label, span=(start, end), gap=float(gap))
    rows = _walked(df, [start, *tie], walk)
    carry = F.broadcast(_carried(rows, walk))
    run = F.col("_c") + F.when(F.col("_key0"), F.col("_chg")).otherwise(0) + 1
    ends = rows.filter(_bit(_RUN_END) | _bit(_LAST)).join(carry, "_range").select("_range", *walk.keys, run.alias("_run"), _bit(_RUN_END).alias("_in"), "_upto", "_island")
    over = Window.partitionBy(*walk.keys, "_run").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.broadcast(ends.withColumn("_reach", F.max("_upto").over(over)).filter("_in").select("_range", "_reach"))
    met = rows.filter("_run0 and _open").join(reach, "_range").filter(F.col(start) - F.col("_reach") <= float(gap))
    met = met.groupBy("_range").agg(F.count(F.lit(1)).alias("_met"))
    own = F.greatest(F.col("_island") - F.when(F.col("_in"), F.coalesce("_met", F.lit(0))).otherwise(0), F.lit(0))
    ahead = ends.join(F.broadcast(met), "_range", "left").withColumn("_own", own)
    ahead = ahead.withColumn("_ahead", F.coalesce(F.sum("_own").over(over), F.lit(0))).filter("_in").select("_range", F.coalesce("_met", F.lit(0)).alias("_met"), "_ahead")
    joined = rows.join(carry, "_range").join(F.broadcast(ahead), "_range")
    number = F.when(F.col("_run0"), F.greatest(F.col("_island") - F.col("_met"), F.lit(0)) + F.col("_ahead")).otherwise(F.col("_island"))
    return joined.select(*df.columns, *([run.alias("run_id")] if label else []), number.alias(out))
