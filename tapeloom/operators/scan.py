"""Ordered scans that never put one whole key into one task.

A series is numbered (``number_rows``), cut into blocks of equal length by that
number, and worked on block by block:

* ``rolling``    bounded frames; each block also gets the few rows it needs from
                 its neighbours, and the copies are dropped afterwards;
* ``prefix``     running sum / max / min / count / last value; a scan inside the
                 block plus the carry of all earlier blocks;
* ``running``    the same by calendar chunks that a count finds short, without
                 numbering the rows first;
* ``recurrence`` y[t] = a*y[t-1] + x[t], 0 < a < 1, the same two levels.

So a symbol that holds a third of all rows is spread over as many tasks as it
has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.session import cut_lineage

BLOCK = 65_536
# Starts of keys in tasks that are sent to all tasks; more of them are joined.
FEW = 50_000
POS = "pos"


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None = None,
    pos: str = POS,
) -> DataFrame:
    """Add the 0-based position of every row in its key, by ``order``.

    ``chunk`` is a coarse, monotone image of the order (a month of bars, say)
    with a known bound of rows per (key, chunk): rows are numbered inside the
    chunk and shifted by the sizes of the earlier chunks. Without it the rows
    are range-partitioned on the full order, which balances any skew; the
    sampled bounds are fixed by a checkpoint before they are read twice.
    """
    keys, order = list(keys), list(order)
    if chunk is not None:
        inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
        sizes = df.groupBy(*keys, chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_size"))
        before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
            Window.unboundedPreceding, -1
        )
        starts = sizes.select(
            *keys, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
        )
        numbered = df.withColumn("_chunk", chunk).withColumn("_rn", F.row_number().over(inside))
        return (
            numbered.join(starts, [*keys, "_chunk"])
            .withColumn(pos, F.col("_start") + F.col("_rn") - 1)
            .drop("_chunk", "_rn", "_start")
        )

    by = [*keys, *order]
    spread = cut_lineage(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # One row per (task, key): tasks hold consecutive rows, so the start of a key
    # in a task is the count of that key in the tasks before it.
    parts = cut_lineage(spread.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first")
    ))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        *keys, "_part", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    # Few keys: the starts go to the rows, which are not shuffled once more.
    few = parts.count() <= FEW
    joined = spread.join(F.broadcast(starts) if few else starts, [*keys, "_part"])
    out = joined.withColumn(pos, F.col("_start") + F.col("_at") - F.col("_first")).drop(
        "_part", "_at", "_first", "_start"
    )
    out._stored = True
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a stored frame, unless it is one already.

    Two-level scans read their input twice; without this, chained scans would double
    the work at every step, and a small series would repeat the join it comes from.
    """
    if getattr(df, "_stored", False):
        return df
    out = cut_lineage(df)
    out._stored = True
    return out


def _block_of(pos: str, block: int) -> Column:
    return F.floor(F.col(pos) / F.lit(block)).cast("long")


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    lookback: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    lookahead: int = 0,
    pos: str = POS,
    block: int | None = None,
) -> DataFrame:
    """Run ``build(rows, window)`` on overlapping blocks of a numbered frame.

    ``lookback``/``lookahead`` is the total reach of all frames and lags used in
    ``build``. Frames at the start of a series are short, as in Spark; guard
    them with ``full``.
    """
    block = max(block or BLOCK, 4 * (lookback + lookahead), 1)
    own = _block_of(pos, block)
    at = F.col(pos) - own * F.lit(block)
    targets = [own]
    if lookback:
        targets.append(F.when(at >= block - lookback, own + 1))
    if lookahead:
        targets.append(F.when((at < lookahead) & (own > 0), own - 1))
    if len(targets) == 1:
        copies = df.withColumn("_blk", own)
    else:
        copies = df.withColumn("_blk", F.explode(F.array_compact(F.array(*targets))))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    return build(copies, w).filter(F.col("_blk") == own).drop("_blk")


def full(value: Column, n: int, over: Column, w: WindowSpec) -> Column:
    """``value`` where the frame ``w`` holds ``n`` non-null ``over``, else null."""
    return F.when(F.count(over).over(w) == n, value)


_INSIDE = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "count": F.count,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _join_carry(fn: str, carry: Column, here: Column) -> Column:
    if fn == "sum":
        return F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(carry + here)
    if fn == "count":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))
    if fn == "max":
        return F.greatest(carry, here)
    if fn == "min":
        return F.least(carry, here)
    return F.coalesce(here, carry)


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    specs: Mapping[str, tuple[str, Column]],
    pos: str = POS,
    block: int | None = None,
    inclusive: bool = True,
    reverse: bool = False,
) -> DataFrame:
    """Running aggregates over a numbered frame; ``specs`` maps name -> (fn, column).

    ``fn`` is sum, max, min, count or last (last non-null value). With
    ``inclusive=False`` the current row is left out; with ``reverse`` the scan
    runs from the end of the series.
    """
    keys, df, block = list(keys), stored(df), block or BLOCK
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    w = Window.partitionBy(*keys, "_blk").orderBy(direction(pos))
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    # The block number is the grouping key of both levels; the inputs are
    # evaluated once, before the split.
    base = df.withColumn("_blk", _block_of(pos, block)).withColumns(
        {f"_in_{k}": c for k, (_, c) in specs.items()}
    )
    inner = base.withColumns(
        {f"_in_{k}": _INSIDE[fn](F.col(f"_in_{k}")).over(frame) for k, (fn, _) in specs.items()}
    )
    at = F.col(pos)
    totals = []
    for k, (fn, _) in specs.items():
        c = F.col(f"_in_{k}")
        if fn == "last":
            edge = F.min_by if reverse else F.max_by
            totals.append(edge(c, F.when(c.isNotNull(), at)).alias(f"_bl_{k}"))
        else:
            totals.append(_INSIDE[fn](c).alias(f"_bl_{k}"))
    blocks = base.groupBy(*keys, "_blk").agg(*totals)
    wb = Window.partitionBy(*keys).orderBy(direction("_blk")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = blocks.select(
        *keys,
        "_blk",
        *[_INSIDE[fn](F.col(f"_bl_{k}")).over(wb).alias(f"_ca_{k}") if fn != "count"
          else F.sum(F.col(f"_bl_{k}")).over(wb).alias(f"_ca_{k}")
          for k, (fn, _) in specs.items()],
    )
    out = inner.join(carry, [*keys, "_blk"]).withColumns(
        {k: _join_carry(fn, F.col(f"_ca_{k}"), F.col(f"_in_{k}")) for k, (fn, _) in specs.items()}
    )
    return out.drop("_blk", *[f"_in_{k}" for k in specs], *[f"_ca_{k}" for k in specs])


def day_of(ts: str) -> Column:
    """The calendar chunk of an instant; rows without one come first, as they sort."""
    return F.coalesce(F.unix_date(F.to_date(ts)), F.lit(-(2**31)))


def chunk_cells(df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, Column]], chunk: Column, *finer: str) -> DataFrame:
    """Rows and totals of every key and chunk (and ``finer`` columns, if any), stored; what ``running`` carries."""
    return cut_lineage(df.groupBy(*keys, chunk.alias("_blk"), *finer).agg(
        F.count(F.lit(1)).alias("_size"), *[_INSIDE[fn](c).alias(f"_bl_{k}") for k, (fn, c) in specs.items()]))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Mapping[str, tuple[str, Column]],
    chunk: Column,
    inclusive: bool = True,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Running sums, maxima, minima or counts along the order of each key (no last values), without positions.

    ``chunk`` is a coarse, monotone image of the order (a day, say). If no chunk of a key has
    more than four blocks of rows, by count, rows are shuffled once, to their chunks, and the
    chunks before are a carry. Otherwise they are numbered and cut into blocks.
    ``cells`` are the ``chunk_cells`` of the frame where a caller has them.
    """
    keys = list(keys)
    cells = chunk_cells(df, keys, specs, chunk) if cells is None else cells
    both = {k: "sum" if fn == "count" else fn for k, (fn, _) in specs.items()}
    blocks = cells.groupBy(*keys, "_blk").agg(
        F.sum("_size").alias("_size"), *[_INSIDE[fn](F.col(f"_bl_{k}")).alias(f"_bl_{k}") for k, fn in both.items()])
    seen = blocks.agg(F.count(F.lit(1)).alias("many"), F.max("_size").alias("longest")).first()
    if (seen["longest"] or 0) > 4 * BLOCK:
        return prefix(number_rows(df, keys, order), keys, specs, inclusive=inclusive).drop(POS)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*keys, "_blk", *[_INSIDE[fn](F.col(f"_bl_{k}")).over(before).alias(f"_ca_{k}") for k, fn in both.items()])
    w = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = df.withColumn("_blk", chunk).withColumns({f"_in_{k}": _INSIDE[fn](c).over(w) for k, (fn, c) in specs.items()})
    out = inner.join(F.broadcast(carry) if seen["many"] <= FEW else carry, [*keys, "_blk"]).withColumns(
        {k: _join_carry(fn, F.col(f"_ca_{k}"), F.col(f"_in_{k}")) for k, (fn, _) in specs.items()})
    return out.drop("_blk", *[f"_{p}_{k}" for p in ("in", "ca") for k in specs])


def recurrence(
    df: DataFrame,
    keys: Sequence[str],
    specs: Mapping[str, tuple[float, Column]],
    pos: str = POS,
) -> DataFrame:
    """y[t] = a*y[t-1] + x[t] with y[-1] = 0; ``specs`` maps name -> (a, x).

    Inside a block of B rows y = a^i * sum(x * a^-i), with B chosen so that a^B
    is near 1e-13: the scaling stays far from overflow, and the ends of the
    blocks before give the carry to full double precision. Rates share the block
    of the slowest of them where it overflows for none; others get their own.
    """
    keys, df = list(keys), stored(df)
    inputs = {f"_x_{k}": F.coalesce(x, F.lit(0.0)) for k, (_, x) in specs.items()}
    df = df.withColumns(inputs)
    left = dict(sorted(((k, a) for k, (a, _) in specs.items()), key=lambda s: -s[1]))
    while left:
        slowest = next(iter(left.values()))
        block = max(1, min(max(8, math.ceil(math.log(1e-13) / math.log(slowest))), _longest(slowest)))
        some = {k: a for k, a in left.items() if block <= _longest(a)} or {next(iter(left)): slowest}
        df = _recurrence(df, keys, some, block, pos)
        left = {k: a for k, a in left.items() if k not in some}
    return df.select(*[c for c in df.columns if c not in inputs and c not in specs], *specs)


def _longest(rate: float) -> int:
    """Rows over which powers of a rate stay far from overflow."""
    return math.floor(math.log(1e-250) / math.log(rate))


def _recurrence(df: DataFrame, keys: list[str], rates: Mapping[str, float], block: int, pos: str) -> DataFrame:
    """One block length: the scan inside the blocks and the carry of the three before, which is all that counts."""
    i = (F.col(pos) - F.col("_blk") * F.lit(block)).cast("double")
    base = df.withColumn("_blk", _block_of(pos, block))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    inner = base.withColumns(
        {f"_y_{k}": F.pow(F.lit(a), i) * F.sum(F.col(f"_x_{k}") * F.pow(F.lit(a), -i)).over(w)
         for k, a in rates.items()}
    )
    ends = base.groupBy(*keys, "_blk").agg(
        *[F.sum(F.col(f"_x_{k}") * F.pow(F.lit(a), F.lit(block - 1.0) - i)).alias(f"_e_{k}")
          for k, a in rates.items()]
    )
    wb = Window.partitionBy(*keys).orderBy("_blk")
    carry = ends.select(
        *keys,
        "_blk",
        *[(F.coalesce(F.lag(f"_e_{k}", 1).over(wb), F.lit(0.0))
           + F.lit(a ** block) * F.coalesce(F.lag(f"_e_{k}", 2).over(wb), F.lit(0.0))
           + F.lit(a ** (2 * block)) * F.coalesce(F.lag(f"_e_{k}", 3).over(wb), F.lit(0.0))
           ).alias(f"_c_{k}")
          for k, a in rates.items()],
    )
    out = inner.join(carry, [*keys, "_blk"]).withColumns(
        {k: F.col(f"_y_{k}") + F.pow(F.lit(a), i + 1) * F.col(f"_c_{k}") for k, a in rates.items()}
    )
    return out.drop("_blk", *[f"_{p}_{k}" for p in ("y", "c") for k in rates])


def value_cells(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _v, _k, _from, _n): each distinct value, how often it occurs, how many rows of its key
    are smaller and how many there are; nulls are left out.

    Rows are counted before anything is ordered, so a value that most rows have is one cell,
    and only cells are range-partitioned. What comes before a task's cells is a sum over tasks.
    """
    keys = list(keys)
    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    spread = cut_lineage(cells.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    parts = spread.groupBy(*keys, "_part").agg(F.sum("_k").alias("_size"))
    of_key = Window.partitionBy(*keys)
    before = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(of_key).alias("_n"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    out = spread.join(starts, [*keys, "_part"])
    return out.withColumn("_from", F.col("_start") + F.coalesce(F.sum("_k").over(inside), F.lit(0))).drop("_part", "_start")


def value_at(place: Column) -> Column:
    """Aggregate over value cells: the value at a 0-based place of the sorted rows."""
    return F.max(F.when((F.col("_from") <= place) & (place < F.col("_from") + F.col("_k")), F.col("_v")))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles of each key, by place among its value cells."""
    last = F.col("_n") - 1
    parts = []
    for name, p in probs.items():
        h = last * F.lit(float(p))
        lo_v, hi_v = value_at(F.floor(h)), value_at(F.ceil(h))
        parts.append((lo_v + (hi_v - lo_v) * F.max(h - F.floor(h))).alias(name))
    return value_cells(df, keys, value).groupBy(*keys).agg(*parts)
