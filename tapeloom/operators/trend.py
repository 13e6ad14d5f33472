"""Trend sides, channels, swing levels and the linear-recurrence indicators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.session import cut_lineage
from tapeloom.operators.scan import POS, full, prefix, recurrence, rolling

KEYS = ["symbol"]


def _side(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def ts_momentum(bars: DataFrame, n: int, tau: float, vol_n: int | None = None,
                out: str = "side_a") -> DataFrame:
    """Sign of the n-bar log-return where it exceeds tau * sigma * sqrt(n)."""
    v = max(n, 20) if vol_n is None else vol_n

    def build(d, w):
        p = F.log("close")
        d = d.withColumn("_r", p - F.lag(p).over(w))
        f = w.rowsBetween(-(v - 1), 0)
        sigma = F.when(F.count("_r").over(f) >= 2, F.stddev_samp("_r").over(f))
        move = p - F.lag(p, n).over(w)
        level = tau * math.sqrt(n) * sigma
        return d.withColumn(
            out, F.when((sigma > 0) & (F.abs(move) > level), F.signum(move).cast("int")).otherwise(0)
        ).drop("_r")
    return rolling(bars, KEYS, max(v, n) + 1, build)


def ma_cross(bars: DataFrame, short: int, long: int, tau: float, out: str = "side_d") -> DataFrame:
    def build(d, w):
        fs, fl = w.rowsBetween(-(short - 1), 0), w.rowsBetween(-(long - 1), 0)
        slow = full(F.avg("close").over(fl), long, F.col("close"), fl)
        d = d.withColumns({"_s": F.avg("close").over(fs), "_l": F.when(slow > 0, slow)})
        return d.withColumn(out, _side(F.col("_s") > F.col("_l") * (1 + tau),
                                       F.col("_s") < F.col("_l") * (1 - tau))).drop("_s", "_l")
    return rolling(bars, KEYS, long - 1, build)


def true_range(bars: DataFrame) -> DataFrame:
    def build(d, w):
        pc = F.lag("close").over(w)
        return d.withColumn("tr", F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))
    return rolling(bars, KEYS, 1, build)


def wilder(d: DataFrame, n: int, cols: list[str], first: int = 0) -> DataFrame:
    """Wilder smoothing of ``cols``, seeded with the mean of their first n values.

    As a recurrence its input is 0 before the seed, the mean at it, then x/n.
    """
    seed_at = first + n - 1

    def seeded(x, w):
        f = w.rowsBetween(-(n - 1), 0)
        return x.withColumns({
            f"_w_{c}": F.when(F.col(POS) < seed_at, 0.0).when(F.col(POS) == seed_at, F.avg(c).over(f))
            .otherwise(F.col(c) / n) for c in cols})

    d = rolling(d, KEYS, n - 1, seeded)
    d = recurrence(d, KEYS, {f"{c}_w": ((n - 1) / n, F.col(f"_w_{c}")) for c in cols})
    keep = F.col(POS) >= seed_at
    return d.withColumns({f"{c}_w": F.when(keep, F.col(f"{c}_w")) for c in cols}).drop(
        *[f"_w_{c}" for c in cols])


def atr(bars: DataFrame, n: int) -> DataFrame:
    return wilder(true_range(bars), n, ["tr"]).withColumnRenamed("tr_w", "atr")


def adx_side(bars: DataFrame, n: int, tau: float, out: str = "side_b") -> DataFrame:
    """Direction of the stronger directional index where ADX exceeds tau."""
    def moves(d, w):
        up = F.col("high") - F.lag("high").over(w)
        dn = F.lag("low").over(w) - F.col("low")
        return d.withColumns({
            "_pdm": F.when((up > dn) & (up > 0), up).otherwise(F.when(up.isNotNull(), 0.0)),
            "_mdm": F.when((dn > up) & (dn > 0), dn).otherwise(F.when(dn.isNotNull(), 0.0)),
        })
    d = cut_lineage(wilder(rolling(true_range(bars), KEYS, 1, moves), n, ["_pdm", "_mdm", "tr"], first=1))
    ok = F.col("tr_w") > 0
    d = d.withColumns({"_pdi": F.when(ok, 100 * F.col("_pdm_w") / F.col("tr_w")),
                       "_mdi": F.when(ok, 100 * F.col("_mdm_w") / F.col("tr_w"))})
    both = F.col("_pdi") + F.col("_mdi")
    d = d.withColumn("_dx", F.when(both > 0, 100 * F.abs(F.col("_pdi") - F.col("_mdi")) / both))
    # A missing DX leaves ADX as it is, so ADX is a recurrence over the bars that
    # have one; those are numbered on their own, from the first of them.
    have = F.col("_dx").isNotNull()
    d = prefix(d, KEYS, {"_k": ("count", F.when(have, F.lit(1)))})
    dense = d.filter(have).select(*KEYS, POS, "_dx", (F.col("_k") - 1).alias("_j"))
    dense = wilder(dense.withColumnRenamed(POS, "_bar").withColumnRenamed("_j", POS), n, ["_dx"])
    dense = dense.select(*KEYS, F.col("_bar").alias(POS), F.col("_dx_w").alias("_adx_at"))
    d = d.join(dense, [*KEYS, POS], "left")
    d = prefix(d, KEYS, {"adx": ("last", F.col("_adx_at"))})
    strong = F.col("adx") > tau
    return d.withColumn(out, _side(strong & (F.col("_pdi") > F.col("_mdi")),
                                   strong & (F.col("_mdi") > F.col("_pdi")))).drop(
        "_pdm", "_mdm", "_pdm_w", "_mdm_w", "tr_w", "_pdi", "_mdi", "_dx", "_k", "_adx_at")


def hac_slope_side(bars: DataFrame, n: int, tau: float, bandwidth: int | None = None,
                   out: str = "side_c") -> DataFrame:
    """Sign of the slope on n log prices where its HAC t-statistic exceeds tau.

    The residual autocovariances follow from lagged window sums of the centred
    prices, one bounded array per bar.
    """
    bw = max(1, math.ceil(4.0 * (n / 100.0) ** (2.0 / 9.0))) if bandwidth is None else bandwidth
    sxx = n * (n * n - 1) / 12.0

    def build(d, w):
        f = w.rowsBetween(-(n - 1), 0)
        d = d.withColumn("_p", F.log("close"))
        d = d.withColumn("_y", F.when(F.count("_p").over(f) == n, F.collect_list("_p").over(f)))
        d = d.withColumn("_m", F.avg("_p").over(f)).withColumn(
            "_b", F.regr_slope(F.col("_p"), F.col(POS).cast("double")).over(f))
        e = F.transform("_y", lambda y, i: y - F.col("_m") - F.col("_b") * (i - F.lit((n - 1) / 2.0)))
        d = d.withColumn("_e", e)

        def gamma(j):
            head = F.slice("_e", 1, n - j)
            tail = F.slice("_e", j + 1, n - j)
            prod = F.zip_with(head, tail, lambda a, b: a * b)
            return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x) / n

        lrv = gamma(0)
        for j in range(1, bw + 1):
            lrv = lrv + 2.0 * (1 - j / (bw + 1)) * gamma(j)
        d = d.withColumn("_t", F.when(lrv > 0, F.col("_b") / F.sqrt(lrv / sxx)))
        return d.withColumn(out, F.when(F.abs("_t") > tau, F.signum("_b").cast("int")).otherwise(0)).drop(
            "_p", "_y", "_m", "_b", "_e").withColumnRenamed("_t", f"{out}_t")
    return rolling(bars, KEYS, n - 1, build)


def body_overlap(bars: DataFrame, n: int, out: str = "rho") -> DataFrame:
    """Mean pairwise Jaccard index of the candle bodies of n bars."""
    def build(d, w):
        body = F.struct(F.least("open", "close").alias("lo"), F.greatest("open", "close").alias("hi"))
        d = d.withColumn("_body", body)
        # The pairs of the current bar with the n-1 before it; a pair k apart is in
        # n-k windows, so each bar's pair sums are reused by the windows after it.
        pairs = []
        for k in range(1, n):
            b = F.lag("_body", k).over(w)
            lo, hi = F.greatest(b["lo"], F.col("_body")["lo"]), F.least(b["hi"], F.col("_body")["hi"])
            union = F.greatest(b["hi"], F.col("_body")["hi"]) - F.least(b["lo"], F.col("_body")["lo"])
            same = ((b["lo"] == F.col("_body")["lo"]) & (b["hi"] == F.col("_body")["hi"])).cast("double")
            pairs.append(F.when(union > 0, F.greatest(F.lit(0.0), hi - lo) / union).otherwise(same))
        d = d.withColumns({f"_j{k}": p for k, p in enumerate(pairs, 1)})
        total = None
        for k in range(1, n):
            s = F.sum(f"_j{k}").over(w.rowsBetween(-(n - 1 - k), 0))
            total = s if total is None else total + s
        frame = w.rowsBetween(-(n - 1), 0)
        return d.withColumn(out, full(total / (n * (n - 1) / 2), n, F.col("close"), frame)).drop(
            "_body", *[f"_j{k}" for k in range(1, n)])
    return rolling(bars, KEYS, 2 * n, build)


def swing_pivots(bars: DataFrame, confirm: int = 5) -> DataFrame:
    """Swings: four strictly falling lows, then two higher lows within ``confirm`` bars;
    and the mirror image. Adds ``long_at``/``short_at``, the confirming position."""
    def build(d, w):
        def run(col, sign):
            x = [F.lag(col, k).over(w) * sign for k in (3, 2, 1, 0)]
            return (x[0] > x[1]) & (x[1] > x[2]) & (x[2] > x[3])

        ahead = w.rowsBetween(1, confirm)
        d = d.withColumns({
            "_dn": run("low", F.lit(1)), "_up": run("high", F.lit(-1)),
            "_nxt": F.collect_list(F.struct(POS, "low", "high")).over(ahead)})
        above = F.filter("_nxt", lambda b: b["low"] > F.col("low"))
        below = F.filter("_nxt", lambda b: b["high"] < F.col("high"))
        return d.withColumns({
            "long_at": F.when(F.col("_dn") & (F.size(above) >= 2), F.get(above, F.lit(1))[POS]),
            "short_at": F.when(F.col("_up") & (F.size(below) >= 2), F.get(below, F.lit(1))[POS]),
        }).drop("_dn", "_up", "_nxt")
    return rolling(bars, KEYS, 3, build, lookahead=confirm)


def pivot_setups(bars: DataFrame, confirm: int = 5) -> DataFrame:
    """One row per confirmed swing: side, swing bar, confirming bar, limit price."""
    p = swing_pivots(bars, confirm)
    one = p.filter(F.col("long_at").isNotNull()).select(
        *KEYS, F.lit(1).alias("side"), F.col(POS).alias("swing_pos"),
        F.col("long_at").alias("confirm_pos"), F.col("low").alias("limit_price"))
    two = p.filter(F.col("short_at").isNotNull()).select(
        *KEYS, F.lit(-1).alias("side"), F.col(POS).alias("swing_pos"),
        F.col("short_at").alias("confirm_pos"), F.col("high").alias("limit_price"))
    return one.unionByName(two)


def with_swing_levels(bars: DataFrame, confirm: int = 5) -> DataFrame:
    """Last confirmed swing low and high at every bar, this bar's confirmations included.

    Of several swings confirmed at one bar the latest swing bar counts.
    """
    lv = pivot_setups(bars, confirm).groupBy(*KEYS, F.col("confirm_pos").alias(POS)).agg(
        F.max_by("limit_price", F.when(F.col("side") == 1, F.col("swing_pos"))).alias("_lo"),
        F.max_by("limit_price", F.when(F.col("side") == -1, F.col("swing_pos"))).alias("_hi"))
    d = bars.join(lv, [*KEYS, POS], "left")
    return prefix(d, KEYS, {"swing_low": ("last", F.col("_lo")), "swing_high": ("last", F.col("_hi"))}
                  ).drop("_lo", "_hi")


def wick_reversals(levels: DataFrame, theta: float, body_floor: float = 1e-9) -> DataFrame:
    """Bars that puncture the last swing level and close back, with wick/body >= theta."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body = F.abs(c - o)
    down, up = F.least(o, c) - lo, h - F.greatest(o, c)
    long_ok = (lo < F.col("swing_low")) & (c >= F.col("swing_low")) & (down > 0) & (down >= theta * body)
    short_ok = (h > F.col("swing_high")) & (c <= F.col("swing_high")) & (up > 0) & (up >= theta * body)
    real = levels.filter(body >= body_floor)
    one = real.filter(long_ok).select(
        *KEYS, POS, F.lit(1).alias("side"), F.col("swing_low").alias("level"),
        lo.alias("limit_price"), F.try_divide(down, body).alias("ratio"))
    two = real.filter(short_ok).select(
        *KEYS, POS, F.lit(-1).alias("side"), F.col("swing_high").alias("level"),
        h.alias("limit_price"), F.try_divide(up, body).alias("ratio"))
    return one.unionByName(two)


def level_states(touches: DataFrame, r_max: int) -> DataFrame:
    """Exhaustion of levels from touch events (level, fold, pos, kind).

    ``kind`` is reject or penetrate. Adds the rejections so far, whether the level
    is dead, and whether an entry is still allowed. A reject after the kill is an
    error row.
    """
    keys = ["level", "fold"]
    d = prefix(touches, keys, {"_dead": ("count", F.when(F.col("kind") == "penetrate", 1))},
               inclusive=False)
    d = d.withColumn("error", (F.col("_dead") > 0) & (F.col("kind") == "reject"))
    d = prefix(d, keys, {"rejections": ("count", F.when((F.col("kind") == "reject") & ~F.col("error"), 1))})
    killed = (F.col("_dead") > 0) | (F.col("kind") == "penetrate")
    return d.withColumns({"killed": killed, "permitted": ~killed & (F.col("rejections") <= r_max)}).drop("_dead")


def first_fire(bars: DataFrame, h: int, event: str = "event", block: int = 16_384) -> DataFrame:
    """Keep an event only if more than h bars lie since the last kept one of its side.

    Keeping is sequential, but what a block needs from the past is only how far
    back the last kept event lies (1..h bars, or further). Each block is tried
    for each of these h+1 entries; chaining the exits fixes the real one.
    """
    ev = bars.filter(F.col(event) != 0).select(
        *KEYS, F.col(event).alias("side"), POS,
        F.floor(F.col(POS) / block).cast("long").alias("blk"))

    def kept(at: np.ndarray, since: int, start: int) -> tuple[np.ndarray, int]:
        out, last = [], start - since
        i = int(np.searchsorted(at, last + h, "right"))
        while i < len(at):
            last = int(at[i])
            out.append(last)
            i = int(np.searchsorted(at, last + h, "right"))
        return np.array(out, dtype="int64"), last

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["pos"].to_numpy())
        b = int(pdf["blk"].iloc[0])
        ends = []
        for since in range(1, h + 2):
            _, last = kept(at, since, b * block)
            ends.append(int(min((b + 1) * block - last, h + 1)))
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "side": [int(pdf["side"].iloc[0])],
                             "blk": [b], "ends": [ends]})

    maps = ev.groupBy(*KEYS, "side", "blk").applyInPandas(
        exits, "symbol string, side int, blk long, ends array<int>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entry state of every block: one short row per 16,384 bars of a side."""
        pdf = pdf.sort_values("blk")
        since, before, out = h + 1, -1, []
        for b, ends in zip(pdf["blk"], pdf["ends"]):
            since = since if b - before == 1 else h + 1
            out.append(since)
            since, before = int(ends[since - 1]), b
        return pd.DataFrame({"symbol": pdf["symbol"], "side": pdf["side"], "blk": pdf["blk"],
                             "since": np.array(out, dtype="int32")})

    entry = maps.groupBy(*KEYS, "side").applyInPandas(chain, "symbol string, side int, blk long, since int")

    def fire(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["pos"].to_numpy())
        out, _ = kept(at, int(pdf["since"].iloc[0]), int(pdf["blk"].iloc[0]) * block)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "pos": out,
                             "fired": int(pdf["side"].iloc[0])}).astype({"fired": "int32"})

    fires = ev.join(entry, [*KEYS, "side", "blk"]).groupBy(*KEYS, "side", "blk").applyInPandas(
        fire, "symbol string, pos long, fired int")
    return bars.join(fires, [*KEYS, POS], "left").withColumn("fired", F.coalesce("fired", F.lit(0)))


def agree(event: Column, side: Column) -> Column:
    """Drop an event that runs against the trend; no trend agrees with both."""
    return F.when((side == 0) | (event == side), event).otherwise(0)


def ewma_vol(daily: DataFrame, com: float, r: str = "r", per_year: int = 252) -> DataFrame:
    """Exponentially weighted volatility known one row earlier, annualised.

    The first value stands in for the row before it.
    """
    alpha = 1.0 / (1.0 + com)
    x = F.pow(F.col(r), 2)
    first = F.col(POS) == 0
    d = recurrence(daily, KEYS, {"_v": (1 - alpha, F.when(first, x).otherwise(alpha * x))})

    def shift(d, w):
        back = F.coalesce(F.lag("_v").over(w), F.when(first, F.col("_v")))
        return d.withColumn("vol", F.sqrt(back) * math.sqrt(per_year)).drop("_v")
    return rolling(d, KEYS, 1, shift)
