"""Continuous series from contracts: front month, roll events, ratio adjustment.

The contract tables hold one row per (root, session[, contract]); a calendar
bounds them, so their windows run per root. Only the last join touches ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROOT = ["root"]


def trailing_volume(volume: DataFrame, sessions: int) -> DataFrame:
    w = Window.partitionBy("root", "contract_id").orderBy("session").rowsBetween(-(sessions - 1), 0)
    return volume.withColumn("trail", F.sum("volume").over(w))


def raw_front(volume: DataFrame, sessions: int) -> DataFrame:
    """Contract with the highest trailing volume of each session; ties to the smallest id."""
    t = trailing_volume(volume, sessions)
    return t.groupBy("root", "session").agg(
        F.min_by("contract_id", F.struct(-F.col("trail"), F.col("contract_id"))).alias("front"))


def persistence_guard(front: DataFrame, sessions: int) -> DataFrame:
    """Front that changes only once a challenger leads ``sessions`` in a row.

    Adds ``effective`` (back-dated to the start of the winning run), the run
    number and length, and ``rejected`` for runs too short to count.
    """
    w = Window.partitionBy(*ROOT).orderBy("session")
    d = front.withColumn("_new", (F.col("front") != F.lag("front").over(w)).cast("int"))
    d = d.withColumn("run", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("run_len", F.count(F.lit(1)).over(Window.partitionBy(*ROOT, "run")))
    counts = (F.col("run_len") >= sessions) | (F.col("run") == 0)
    d = d.withColumn("effective", F.last(F.when(counts, F.col("front")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    last_run = F.max("run").over(Window.partitionBy(*ROOT))
    return d.withColumn("rejected", ~counts & (F.col("front") != F.col("effective")) & (F.col("run") < last_run)
                        ).drop("_new")


def roll_events(effective: DataFrame) -> DataFrame:
    """Sessions at which the effective front changes."""
    w = Window.partitionBy(*ROOT).orderBy("session")
    d = effective.withColumns({"old": F.lag("effective").over(w), "prev_session": F.lag("session").over(w)})
    return d.filter(F.col("old") != F.col("effective")).select(
        "root", "session", "prev_session", "old", F.col("effective").alias("new"))


def roll_ratios(ticks: DataFrame, events: DataFrame, tie: str | None = None) -> DataFrame:
    """Open of the new contract at its first front session over the close of the old
    one at its last; null where an anchor is missing. Times are unique per contract,
    unless ``tie`` names a column that orders equal ones."""
    at = F.col("ts") if tie is None else F.struct("ts", tie)
    edge = ticks.groupBy("root", "contract_id", "session").agg(
        F.min_by("price", at).alias("o"), F.max_by("price", at).alias("c"))
    new = edge.select("root", F.col("contract_id").alias("new"), "session", F.col("o").alias("new_open"))
    old = edge.select("root", F.col("contract_id").alias("old"), F.col("session").alias("prev_session"),
                      F.col("c").alias("old_close"))
    return events.join(new, ["root", "new", "session"], "left").join(
        old, ["root", "old", "prev_session"], "left").withColumn(
        "ratio", F.try_divide(F.col("new_open"), F.col("old_close")))


def adjustment_factors(effective: DataFrame, ratios: DataFrame) -> DataFrame:
    """Product of all later ratios for every session; the newest contract has 1."""
    w = Window.partitionBy(*ROOT).orderBy(F.col("session").desc())
    d = effective.join(ratios.select("root", "session", "ratio"), ["root", "session"], "left")
    later = F.sum(F.log("ratio")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return d.select("root", "session", "effective", F.exp(F.coalesce(later, F.lit(0.0))).alias("factor"),
                    F.col("ratio").isNotNull().alias("roll_flag"))


def back_adjust(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Front-month bars with prices times the factor; volume is left as it is."""
    f = factors.withColumnRenamed("effective", "contract_id")
    d = bars.join(f, ["root", "session", "contract_id"])
    return d.withColumn("unadjusted_close", F.col("close")).withColumns(
        {c: F.col(c) * F.col("factor") for c in ("open", "high", "low", "close")}
    ).withColumnRenamed("factor", "adjustment_factor")


def continuous_series(ticks: DataFrame, contract_bars: DataFrame, sessions: int) -> dict[str, DataFrame]:
    """All steps: volume, raw front, guard, events, ratios, factors, adjusted bars."""
    vol = ticks.groupBy("root", "session", "contract_id").agg(F.sum("size").alias("volume"))
    eff = persistence_guard(raw_front(vol, sessions), sessions)
    ev = roll_events(eff)
    ratios = roll_ratios(ticks, ev)
    fac = adjustment_factors(eff, ratios)
    return {"effective": eff, "events": ev, "ratios": ratios, "factors": fac,
            "bars": back_adjust(contract_bars, fac)}
