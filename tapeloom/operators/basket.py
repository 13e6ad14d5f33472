"""Trend-following basket on daily closes (one row per session: calendar-bounded)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.numeric import log_ratio
from tapeloom.operators import trend
from tapeloom.operators.scan import number_rows

YEAR = 252


def daily_returns(closes: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("session")
    return closes.withColumn("r", log_ratio("close", F.lag("close").over(w)))


def tsmom(returns: DataFrame, lookback: int, out: str = "signal") -> DataFrame:
    """Sign of the log-returns of the ``lookback`` sessions before."""
    f = Window.partitionBy("symbol").orderBy("session").rowsBetween(-lookback, -1)
    return returns.withColumn(
        out, F.when(F.count("r").over(f) == lookback, F.signum(F.sum("r").over(f))).otherwise(0.0))


def ex_ante_vol(returns: DataFrame, com: float) -> DataFrame:
    """Volatility from an exponentially weighted mean of squared returns.

    The missing first return counts as 0.
    """
    d = returns.withColumn("_r0", F.coalesce("r", F.lit(0.0)))
    d = number_rows(d, ["symbol"], ["session"], chunk=F.trunc("session", "year"))
    return trend.ewma_vol(d, com, r="_r0").drop("_r0", "pos")


def vol_target_weight(signal: Column, vol: Column, target: Column, kelly: Column, cap: Column) -> Column:
    raw = F.when(vol > 0, F.try_divide(target, vol) * signal * kelly).otherwise(0.0)
    return F.greatest(-cap, F.least(cap, raw))


def session_index(returns: DataFrame) -> DataFrame:
    """Running number of each session that any symbol has (one row per day)."""
    days = returns.select("session").distinct()
    return days.withColumn("day", F.row_number().over(Window.orderBy("session")))


def basket(weighted: DataFrame, days: DataFrame, cell: list[str]) -> DataFrame:
    """Mean over the symbols of a day of yesterday's weight times today's return.

    A weight counts only if it is from the session just before; the first return
    of a symbol is 0.
    """
    d = weighted.join(F.broadcast(days), "session")
    w = Window.partitionBy(*cell, "symbol").orderBy("day")
    held = F.when(F.lag("day").over(w) == F.col("day") - 1, F.lag("weight").over(w)).otherwise(0.0)
    d = d.withColumn("_x", held * F.coalesce("r", F.lit(0.0)))
    return d.groupBy(*cell, "session", "day").agg(
        F.avg("_x").alias("ret"), F.count(F.lit(1)).alias("active"))


def equal_weight(returns: DataFrame) -> DataFrame:
    return returns.groupBy("session").agg(
        F.avg(F.coalesce("r", F.lit(0.0))).alias("ret"), F.count(F.lit(1)).alias("active"))
