"""Ordered operators on keyed rows that do not put a whole key into one task.

A window partitioned by recording or user would sort all of that key in a single
task.  Here each key is cut along its first order column into blocks of ``width``
(seconds for times, rows for dense positions).  Windows run inside (key, block);
what crosses a block edge - row offsets, the neighbouring row, running totals -
comes from a block table with one row per block, joined back.  The sampling rate
bounds a block and the calendar bounds the blocks of a key: at 100 Hz a 60 s block
has 6,000 rows and a month has 43,200 blocks.

The row branch and the block branch read the same shuffle: the block branch also
digests the columns it does not need, so both need the same columns, Spark sees
equal exchanges and runs the input once.  Pass only the columns that are used later:
an unused one is pruned from the row branch alone and the input runs twice.

Key columns and the first order column are not NULL, and the order is total.
``width=None`` keeps each key whole, for groups that are bounded by nature (the
days of a user, the frames of a window).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

SECONDS = 60.0
ROWS = 50_000
_BLOCK = "_blk"


def axis(df: DataFrame, name: str) -> Column:
    """A numeric view of an order column."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")) / F.lit(1e6)
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double") * F.lit(86400.0)
    return F.col(name).cast("double")


def with_blocks(df: DataFrame, order: Sequence[str], width: float | None) -> DataFrame:
    """Add the block number of each row."""
    zero = F.lit(0).cast("long")
    block = zero if width is None else F.coalesce(F.floor(axis(df, order[0]) / F.lit(float(width))), zero)
    return df.withColumn(_BLOCK, block)


def _digest(df: DataFrame) -> Column:
    return F.max(F.xxhash64(*[F.col(c) for c in df.columns])).alias("_digest")


def index_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    label: str | None = None,
    lag: Sequence[str] = (),
    lead: Sequence[str] = (),
    total: bool = False,
    width: float | None = SECONDS,
) -> DataFrame:
    """Row position per key, and optionally run number and neighbour values.

    Adds ``pos`` (1-based); ``run_id`` (1-based, grows when ``label`` differs from
    the previous row) when a label is given; ``lag_<c>`` and ``lead_<c>``; and
    ``n_rows`` per key when ``total`` is set.
    """
    keys, order = list(keys), list(order)
    lag, lead = list(dict.fromkeys(lag)), list(dict.fromkeys(lead))
    blocked = with_blocks(df, order, width)
    w = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {"_i": F.row_number().over(w)}
    for c in lag:
        added[f"_lag_{c}"] = F.lag(c).over(w)
    for c in lead:
        added[f"_lead_{c}"] = F.lead(c).over(w)
    local = blocked.withColumns(added)
    if label:
        changed = ~F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.col("_i") > 1)
        local = local.withColumn("_chg", changed.cast("long")).withColumn("_c", F.sum("_chg").over(running))

    edge = list(dict.fromkeys([*lag, *lead, *([label] if label else [])]))
    aggs = [F.count(F.lit(1)).alias("_n"), _digest(df)]
    if edge:
        aggs += [
            F.min_by(F.struct(*edge), "_i").alias("_first"),
            F.max_by(F.struct(*edge), "_i").alias("_last"),
        ]
    if label:
        aggs.append(F.sum("_chg").alias("_chgs"))
    over_key = Window.partitionBy(*keys).orderBy(_BLOCK)
    before = over_key.rowsBetween(Window.unboundedPreceding, -1)
    blocks = local.groupBy(*keys, _BLOCK).agg(*aggs)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if edge:
        blocks = blocks.withColumns({"_prev": F.lag("_last").over(over_key), "_next": F.lead("_first").over(over_key)})
    if label:
        crossing = F.col("_prev").isNotNull() & ~F.col(f"_prev.{label}").eqNullSafe(F.col(f"_first.{label}"))
        blocks = blocks.withColumn("_cross", crossing.cast("long")).withColumn(
            "_run_off",
            F.sum("_cross").over(over_key.rowsBetween(Window.unboundedPreceding, 0))
            + F.coalesce(F.sum("_chgs").over(before), F.lit(0)),
        )
    if total:
        blocks = blocks.withColumn("n_rows", F.sum("_n").over(Window.partitionBy(*keys)))
    blocks = blocks.filter(F.col("_digest").isNotNull()).drop("_first", "_last", "_chgs", "_cross", "_digest")

    joined = local.join(blocks, [*keys, _BLOCK])
    out = {"pos": F.col("_off") + F.col("_i")}
    if label:
        out["run_id"] = F.col("_run_off") + F.col("_c") + 1
    for c in lag:
        out[f"lag_{c}"] = F.when(F.col("_i") == 1, F.col(f"_prev.{c}")).otherwise(F.col(f"_lag_{c}"))
    for c in lead:
        out[f"lead_{c}"] = F.when(F.col("_i") == F.col("_n"), F.col(f"_next.{c}")).otherwise(F.col(f"_lead_{c}"))
    kept = [*df.columns, *(["n_rows"] if total else [])]
    return joined.select(*kept, *[v.alias(k) for k, v in out.items()])


def frame(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    before: int,
    after: int,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    rows: int = ROWS,
) -> DataFrame:
    """Columns over the ``before`` rows ahead of each row and the ``after`` behind it.

    ``pos`` is a dense position from :func:`index_rows`.  Rows are grouped into
    position blocks and every block also receives the rows its edges look at, so
    a task holds at most ``rows + before + after`` rows.
    """
    home = F.floor((F.col(pos) - 1) / rows)
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(pos) - 1 - after) / rows))
    last = F.floor((F.col(pos) - 1 + before) / rows)
    spread = df.withColumn("_home", home).withColumn("_rb", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_rb").orderBy(pos)
    made = dict(build(w))
    return spread.withColumns(made).filter(F.col("_rb") == F.col("_home")).drop("_rb", "_home")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Mapping[str, tuple[str, str]],
    *,
    inclusive: bool = True,
    width: float | None = SECONDS,
) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` per key; ``specs`` maps output name to (function, column)."""
    keys, order = list(keys), list(order)
    fns = {"sum": F.sum, "max": F.max, "min": F.min}
    merge = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}
    blocked = with_blocks(df, order, width)
    upto = Window.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    local = blocked.withColumns({f"_in_{o}": fns[f](c).over(upto) for o, (f, c) in specs.items()})
    blocks = local.groupBy(*keys, _BLOCK).agg(_digest(df), *[fns[f](c).alias(f"_b_{o}") for o, (f, c) in specs.items()])
    blocks = blocks.filter(F.col("_digest").isNotNull())
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *keys, _BLOCK, *[fns[f](f"_b_{o}").over(before).alias(f"_p_{o}") for o, (f, _) in specs.items()]
    )
    joined = local.join(blocks, [*keys, _BLOCK])
    return joined.select(
        *df.columns, *[merge[f](F.col(f"_p_{o}"), F.col(f"_in_{o}")).alias(o) for o, (f, _) in specs.items()]
    )


def fill_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], width: float | None = SECONDS) -> DataFrame:
    """Previous and next non-NULL value of each column, with where it was found.

    Adds ``prev_<c>``, ``prev_at_<c>``, ``next_<c>`` and ``next_at_<c>``; a row with
    a value is its own neighbour on both sides.
    """
    keys, order = list(keys), list(order)
    x = axis(df, order[0])
    packed = df.withColumns({f"_v_{c}": F.when(F.col(c).isNotNull(), F.struct(x.alias("at"), F.col(c).alias("v"))) for c in cols})
    blocked = with_blocks(packed, order, width)
    w = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    made = {}
    for c in cols:
        made[f"_b_{c}"] = F.last(f"_v_{c}", True).over(back)
        made[f"_a_{c}"] = F.first(f"_v_{c}", True).over(ahead)
    local = blocked.withColumns(made)
    aggs = [_digest(packed)]
    for c in cols:
        aggs += [F.max(f"_v_{c}").alias(f"_l_{c}"), F.min(f"_v_{c}").alias(f"_f_{c}")]
    over = Window.partitionBy(*keys).orderBy(_BLOCK)
    blocks = local.groupBy(*keys, _BLOCK).agg(*aggs).filter(F.col("_digest").isNotNull())
    carried = []
    for c in cols:
        carried.append(F.last(f"_l_{c}", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_pl_{c}"))
        carried.append(F.first(f"_f_{c}", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias(f"_nf_{c}"))
    joined = local.join(blocks.select(*keys, _BLOCK, *carried), [*keys, _BLOCK])
    outs = []
    for c in cols:
        p, n = F.coalesce(f"_b_{c}", f"_pl_{c}"), F.coalesce(f"_a_{c}", f"_nf_{c}")
        outs += [p["v"].alias(f"prev_{c}"), p["at"].alias(f"prev_at_{c}"), n["v"].alias(f"next_{c}"), n["at"].alias(f"next_at_{c}")]
    return joined.select(*df.columns, *outs)


def gap_islands(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    gap: float,
    *,
    tie: Sequence[str] = (),
    label: str | None = None,
    out: str = "island_id",
    width: float | None = SECONDS,
) -> DataFrame:
    """Number the islands of intervals: a new one begins where ``start`` is more than
    ``gap`` after every earlier end, or where the label changes."""
    keys, order = list(keys), [start, *tie]
    within, staged = keys, df
    if label:
        staged = index_rows(df, keys, order, label=label, width=width).withColumnRenamed("run_id", "_run").drop("pos")
        within = [*keys, "_run"]
    reach = running(staged, within, order, {"_reach": ("max", end)}, inclusive=False, width=width)
    opened = (F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > gap)).cast("long")
    numbered = running(reach.withColumn("_open", opened).drop("_reach"), within, order, {out: ("sum", "_open")}, width=width)
    return numbered.select(*df.columns, out)
