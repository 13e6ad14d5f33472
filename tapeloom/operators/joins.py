"""Time-aligned joins without pair explosions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.scan import POS, day_of, number_rows, prefix, running
from tapeloom.session import cut_lineage


def _stacked(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, tie: str,
             cols: Sequence[str], right_first: bool) -> DataFrame:
    """Both sides as one series; a right row carries ``_r``, a left row ``_l``."""
    one = left.select(
        *keys, F.col(on).alias("_on"), F.lit(1 if right_first else 0).alias("_side"),
        F.col(tie).alias("_tie"), F.struct(*left.columns).alias("_l"))
    two = right.select(
        *keys, F.col(on).alias("_on"), F.lit(0 if right_first else 1).alias("_side"),
        F.lit(None).cast(left.schema[tie].dataType).alias("_tie"),
        F.struct(F.col(on).alias("_at"), *cols).alias("_r"))
    return one.unionByName(two, allowMissingColumns=True)


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, tie: str,
    cols: Sequence[str], tolerance_us: int | None = None, strict: bool = False,
    chunk: Column | None = None,
) -> DataFrame:
    """Each left row with the last right row at or before it (before it if ``strict``).

    ``tie`` orders left rows of one instant. The two sides become one series and the
    last right value is carried along it, so no key has to fit into a task.
    """
    rows = _stacked(left, right, keys, on, tie, cols, right_first=not strict)
    rows = number_rows(rows, keys, ["_on", "_side", "_tie"], chunk)
    out = prefix(rows, keys, {"_m": ("last", F.col("_r"))}).filter(F.col("_l").isNotNull())
    hit = F.col("_m").isNotNull()
    if tolerance_us is not None:
        hit = hit & (F.unix_micros("_on") - F.unix_micros(F.col("_m._at")) <= tolerance_us)
    return out.select("_l.*", *[F.when(hit, F.col(f"_m.{c}")).alias(c) for c in cols],
                      F.when(hit, F.col("_m._at")).alias("matched_at"))


def nearest_within(
    left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, tie: str,
    cols: Sequence[str], window_us: int,
) -> DataFrame:
    """The right row nearest in time if it lies within the window, both ends included.

    Of two equally near the earlier one counts. Only the last row before and the
    first row after can be nearest, so two carried values replace the interval join.
    """
    rows = _stacked(left, right, keys, on, tie, cols, right_first=True)
    rows = number_rows(rows, keys, ["_on", "_side", "_tie"])
    rows = prefix(rows, keys, {"_b": ("last", F.col("_r"))})
    rows = prefix(rows, keys, {"_f": ("last", F.col("_r"))}, reverse=True)
    rows = rows.filter(F.col("_l").isNotNull())
    t = F.unix_micros("_on")
    back, ahead = t - F.unix_micros(F.col("_b._at")), F.unix_micros(F.col("_f._at")) - t
    near = F.when(ahead.isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_f"))
    dist = F.least(back, ahead)
    hit = dist <= window_us
    return rows.select(
        "_l.*", *[F.when(hit, near[c]).alias(c) for c in cols],
        F.when(hit, dist).alias("distance_us"))


def band_counts(left: DataFrame, right: DataFrame, on: str, window_us: int) -> DataFrame:
    """How many right instants lie within the window of each left row.

    Counted from running counts at both ends of the window instead of by pairs.
    """
    starts = left.select(*left.columns, F.explode(F.array(
        F.struct(F.lit(0).alias("w"), (F.unix_micros(on) - window_us - 1).alias("t")),
        F.struct(F.lit(1).alias("w"), (F.unix_micros(on) + window_us).alias("t")))).alias("_e"))
    probes = starts.select(F.col("_e.t").alias("_t"), F.lit(1).alias("_side"), F.col("_e.w").alias("_w"),
                           F.struct(*left.columns).alias("_l"), F.lit(0).alias("_one"))
    hits = right.select(F.unix_micros(on).alias("_t"), F.lit(0).alias("_side"), F.lit(1).alias("_one"))
    rows = number_rows(probes.unionByName(hits, allowMissingColumns=True), [], ["_t", "_side", "_w"])
    rows = prefix(rows, [], {"_n": ("sum", F.col("_one"))}).filter(F.col("_l").isNotNull())
    return rows.groupBy("_l").agg(
        F.sum(F.when(F.col("_w") == 1, F.col("_n")).otherwise(-F.col("_n"))).alias("n_near")
    ).select("_l.*", "n_near")


def outer_merge(frames: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of feature frames on their keys in one shuffle.

    Each frame has one row per key; the frames are stacked and grouped, rather
    than joined one after another.
    """
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    cols = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols])


def regular_grid(bars: DataFrame, step_minutes: int, ts: str, fill: Sequence[str]) -> DataFrame:
    """Every step from the first to the last bar of a symbol, gaps filled forward.

    The grid is made day by day, so no array spans a whole history.
    """
    step = step_minutes * 60_000_000
    day = 86_400_000_000
    us = F.unix_micros(ts)
    ends = bars.groupBy("symbol").agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    days = ends.select("symbol", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") / day), F.floor(F.col("hi") / day))).alias("d"))
    # First grid point of the day, counted from the first bar.
    start = F.greatest(F.col("lo"), F.col("lo") + F.ceil((F.col("d") * day - F.col("lo")) / step) * step)
    stop = F.least(F.col("hi"), (F.col("d") + 1) * day - 1)
    grid = days.withColumn("_s", start).withColumn("_t", stop).filter(F.col("_s") <= F.col("_t")).select(
        "symbol", F.explode(F.sequence(F.col("_s"), F.col("_t"), F.lit(step))).alias("_u")).select(
        "symbol", F.timestamp_micros("_u").alias(ts))
    d = grid.join(bars, ["symbol", ts], "left")
    d = number_rows(d, ["symbol"], [ts], chunk=F.trunc(ts, "MM"))
    return prefix(d, ["symbol"], {f"{c}_filled": ("last", F.col(c)) for c in fill})


def overlapping_adjacent(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trades entered before the exit of the trade just before them (numbered input)."""
    from tapeloom.operators.scan import rolling

    d = rolling(trades, keys, 1, lambda x, w: x.withColumn("_prev", F.lag("exit_ts").over(w)))
    return d.filter(F.col("entry_ts") < F.col("_prev")).drop("_prev")


def exits_and_cells(trades: DataFrame, keys: Sequence[str], amount: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """What ends at each instant of a key (_t, _k = 0, _d < 0) as one row, and the ``chunk_cells`` of a running sum
    ``name`` over single entries and these exits.

    Nothing is asked of exits one by one, so both are read from one stored table of sums by instant;
    only the entries themselves are shuffled with all their columns.
    """
    ends = F.explode(F.array(F.struct(F.col("entry_ts").alias("_t"), F.lit(1).alias("_k")),
                             F.struct(F.col("exit_ts").alias("_t"), F.lit(0).alias("_k"))))
    sums = cut_lineage(trades.select(*keys, amount.alias("_d"), ends.alias("_e")).groupBy(*keys, "_e._t", "_e._k").agg(
        F.sum("_d").alias("_d"), F.count(F.lit(1)).alias("_n")))
    sums = sums.withColumn("_d", F.when(F.col("_k") == 1, F.col("_d")).otherwise(-F.col("_d")))
    cells = sums.groupBy(*keys, day_of("_t").alias("_blk")).agg(
        F.sum(F.when(F.col("_k") == 1, F.col("_n")).otherwise(1)).alias("_size"), F.sum("_d").alias(f"_bl_{name}"))
    return sums.filter("_k = 0").drop("_n"), cells


def overlap_counts(trades: DataFrame, keys: Sequence[str], key_cols: Sequence[str]) -> DataFrame:
    """How many earlier trades of the key are still open at each entry.

    Running numbers of entries and exits replace the pairwise self-join.
    """
    one = F.lit(1).cast("long")
    ins = trades.select(*keys, *key_cols, F.col("entry_ts").alias("_t"), F.lit(1).alias("_k"), one.alias("_d"))
    outs, cells = exits_and_cells(trades, keys, one, "_open")
    rows = running(ins.unionByName(outs, allowMissingColumns=True), keys, ["_t", "_k", *key_cols],
                   {"_open": ("sum", F.col("_d"))}, day_of("_t"), inclusive=False, cells=cells)
    return rows.filter(F.col("_k") == 1).select(*keys, *key_cols, F.coalesce("_open", F.lit(0)).alias("open_before"))


def left_coalesce(left: DataFrame, right: DataFrame, keys: Sequence[str], out: str, cols: Sequence[str]) -> DataFrame:
    """Left join, then the first non-null of ``cols``."""
    return left.join(right, list(keys), "left").withColumn(out, F.coalesce(*cols))


def cross_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row with every cell of a parameter grid (a driver-made, fixed-size table)."""
    return df.crossJoin(F.broadcast(grid))
