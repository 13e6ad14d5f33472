"""Performance aggregates over ledgers and return series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.scan import POS, exact_quantiles, number_rows, prefix, rolling


def exit_histogram(trades: DataFrame, keys: Sequence[str], reasons: Sequence[str]) -> DataFrame:
    return trades.groupBy(*keys).agg(
        *[F.count_if(F.col("reason") == r).alias(r) for r in reasons],
        F.count_if(F.col("pnl") > 0).alias("wins"),
        F.count_if(F.col("pnl") < 0).alias("losses"),
        F.count_if(F.col("pnl") == 0).alias("zeros"))


def kpi_table(trades: DataFrame, equity: float) -> DataFrame:
    """KPIs by (config, symbol), and an equal-dollar basket row by config."""
    cells = trades.groupBy("config", "symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("pnl") > 0).alias("_w"),
        (F.sum("pnl") / equity).alias("_roi"), F.sum("r_multiple").alias("_r"))
    return cells.groupingSets(
        [[F.col("config"), F.col("symbol")], [F.col("config")]], F.col("config"), F.col("symbol")
    ).agg(
        F.sum("_n").alias("n"), F.sum("_w").alias("wins"), F.avg("_roi").alias("roi"),
        (F.sum("_r") / F.sum("_n")).alias("mean_r"),
    ).withColumn("symbol", F.coalesce("symbol", F.lit("basket")))


def equity_curve(df: DataFrame, keys: Sequence[str], order: Sequence[str], r: str,
                 chunk: Column | None = None) -> DataFrame:
    """Cumulated log-return, equity from 1, and drawdown against the running peak."""
    d = number_rows(df, keys, order, chunk)
    d = prefix(d, keys, {"cum": ("sum", F.col(r))})
    d = prefix(d, keys, {"_peak": ("max", F.col("cum"))})
    return d.withColumns({
        "equity": F.exp("cum"),
        "drawdown": 1 - F.exp(F.col("cum") - F.greatest(F.col("_peak"), F.lit(0.0)))}).drop("_peak")


def drawdown_summary(df: DataFrame, keys: Sequence[str], order: Sequence[str], r: str,
                     chunk: Column | None = None) -> DataFrame:
    return equity_curve(df, keys, order, r, chunk).groupBy(*keys).agg(
        F.sum(r).alias("total"), F.max("drawdown").alias("max_dd"), F.count(F.lit(1)).alias("n"),
        F.avg(r).alias("mean"))


def calmar(df: DataFrame, keys: Sequence[str], order: Sequence[str], r: str, per_year: int = 252,
           chunk: Column | None = None) -> DataFrame:
    """Annualised return over the deepest drawdown; infinite where there is none."""
    s = drawdown_summary(df, keys, order, r, chunk)
    ann = F.expm1(F.col("mean") * per_year)
    inf = F.lit(float("inf"))
    flat = F.when(ann > 0, inf).when(ann < 0, -inf).otherwise(F.lit(0.0))
    return s.select(*keys, "max_dd", ann.alias("ann_ret"),
                    F.when(F.col("max_dd") > 0, ann / F.col("max_dd")).otherwise(flat).alias("calmar"))


def reliability_slope(df: DataFrame, p: str, d: str, bins: int) -> DataFrame:
    """Slope of mean outcome on mean score over quantile bins of at least 5 rows."""
    ok = df.filter(F.col(p).isNotNull() & F.col(d).isNotNull()).select(p, d)
    edges = exact_quantiles(ok, [], p, {f"e{i}": i / bins for i in range(bins)})
    # One row of edges; ok to send to every task.
    x = ok.crossJoin(F.broadcast(edges))
    bin_of = sum((F.col(p) >= F.col(f"e{i}")).cast("int") for i in range(bins))
    g = x.groupBy(bin_of.alias("bin")).agg(
        F.avg(p).alias("_p"), F.avg(d).alias("_d"), F.count(F.lit(1)).alias("_n")).filter("_n >= 5")
    n = F.count(F.lit(1))
    return g.agg(F.when(n >= 3, F.regr_slope("_d", "_p")).alias("slope"), n.alias("bins"))


def brier_skill(df: DataFrame, keys: Sequence[str], p: str, d: str) -> DataFrame:
    """Mean squared score error, and its skill over the overall outcome rate."""
    clim = df.agg(F.avg(d).alias("_clim"))
    err, base = F.avg(F.pow(F.col(p) - F.col(d), 2)), F.avg(F.pow(F.col("_clim") - F.col(d), 2))
    return df.crossJoin(F.broadcast(clim)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), err.alias("brier"), (1 - err / base).alias("skill"))


def rule_competition(bars: DataFrame, rules: dict[str, int], horizon: int) -> DataFrame:
    """Squared error of each rule's side against the sign of the next ``horizon`` bars.

    ``rules`` maps a side column to the history it needs. Ties go to the first name.
    """
    d = rolling(bars, ["symbol"], 0, lambda x, w: x.withColumn(
        "_ahead", F.signum(F.log(F.lead("close", horizon).over(w)) - F.log("close"))), lookahead=horizon)
    d = d.filter(F.col("_ahead") != 0)
    scored = d.groupBy("symbol").agg(*[
        f for k, need in rules.items() for f in (
            F.avg(F.when(F.col(POS) >= need, F.pow(F.col(k) - F.col("_ahead"), 2))).alias(f"b_{k}"),
            F.count_if(F.col(POS) >= need).alias(f"n_{k}"))])
    long = scored.select("symbol", F.explode(F.array(*[
        F.struct(F.lit(k).alias("rule"), F.col(f"b_{k}").alias("brier"), F.col(f"n_{k}").alias("n"))
        for k in rules])).alias("s")).select("symbol", "s.*").filter("n > 0")
    best = long.groupBy("symbol").agg(F.min_by("rule", F.struct("brier", "rule")).alias("_best"))
    return long.join(best, "symbol").withColumn("best", F.col("rule") == F.col("_best")).drop("_best")
