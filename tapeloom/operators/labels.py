"""Event outcomes as first-touch queries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.numeric import log_ratio
from tapeloom.operators.features import KEYS, log_return, yang_zhang
from tapeloom.operators.scan import POS, full, rolling


def label_horizon_bars(vertical_minutes: float, bar_minutes: float) -> int:
    return math.ceil(vertical_minutes / bar_minutes)


def triple_barrier(bars: DataFrame, pt: float, sl: float, horizon_minutes: int, bar_minutes: int,
                   vol_lookback: int) -> DataFrame:
    """First barrier touched after each bar, within the horizon (its end included).

    The bars ahead are a bounded array: at most horizon / bar width of them exist.
    """
    ahead = label_horizon_bars(horizon_minutes, bar_minutes)
    d = yang_zhang(bars, vol_lookback, "volatility")

    def build(x, w):
        x = x.withColumn("_f", F.collect_list(F.struct("bar_ts", "high", "low")).over(w.rowsBetween(1, ahead)))
        end = F.col("bar_ts") + F.make_dt_interval(mins=F.lit(horizon_minutes))
        x = x.withColumns({
            "_up": F.col("close") * F.exp(pt * F.col("volatility")),
            "_dn": F.col("close") * F.exp(-sl * F.col("volatility")),
            "_f": F.filter("_f", lambda b: b["bar_ts"] <= end)})
        hits = F.filter("_f", lambda b: (b["high"] >= F.col("_up")) | (b["low"] <= F.col("_dn")))
        x = x.withColumn("_h", F.get(hits, F.lit(0)))
        ok = F.coalesce(F.col("volatility") > 0, F.lit(False))
        up, dn = F.col("_h.high") >= F.col("_up"), F.col("_h.low") <= F.col("_dn")
        label = F.when(~ok | F.col("_h").isNull() | (up & dn), 0).when(up, 1).otherwise(-1)
        last = F.coalesce(F.array_max(F.transform("_f", lambda b: b["bar_ts"])), F.col("bar_ts"))
        return x.withColumns({
            "label": label,
            "horizon_end_ts": F.when(~ok, F.col("bar_ts")).otherwise(F.coalesce(F.col("_h.bar_ts"), last)),
            "barrier_hit": F.when(label == 1, "pt").when(label == -1, "sl").otherwise("vertical"),
        }).drop("_f", "_h", "_up", "_dn")
    return rolling(d, KEYS, 0, build, lookahead=ahead)


def triple_barrier_join(bars: DataFrame, pt: float, sl: float, horizon_minutes: int,
                        bucket_minutes: int, vol_lookback: int) -> DataFrame:
    """The same labels by a time-bucketed join, for horizons too long for arrays.

    Each event meets the bars of the buckets its horizon reaches; barrier hits
    are reduced per event before they meet again.
    """
    d = yang_zhang(bars, vol_lookback, "volatility").select(*KEYS, "bar_ts", "close", "high", "low", "volatility")
    width = bucket_minutes * 60_000_000
    us = F.unix_micros("bar_ts")
    reach = horizon_minutes * 60_000_000
    ev = d.select(*KEYS, "bar_ts", "close", "volatility", F.explode(F.sequence(
        F.floor(us / width), F.floor((us + reach) / width))).alias("_b"))
    px = d.select(*KEYS, F.col("bar_ts").alias("_t"), "high", "low", F.floor(us / width).alias("_b"))
    j = ev.join(px, [*KEYS, "_b"], "left").withColumn(
        "_in", (F.col("_t") > F.col("bar_ts")) & (F.unix_micros("_t") <= us + reach))
    up = F.col("high") >= F.col("close") * F.exp(pt * F.col("volatility"))
    dn = F.col("low") <= F.col("close") * F.exp(-sl * F.col("volatility"))
    hit = F.when(F.col("_in") & (up | dn), F.col("_t"))
    r = j.groupBy(*KEYS, "bar_ts", "volatility").agg(
        F.min(hit).alias("_ht"), F.min_by(F.when(up & dn, 0).when(up, 1).otherwise(-1), hit).alias("_hl"),
        F.max(F.when(F.col("_in"), F.col("_t"))).alias("_last"))
    ok = F.coalesce(F.col("volatility") > 0, F.lit(False))
    label = F.when(ok & F.col("_hl").isNotNull(), F.col("_hl")).otherwise(0)
    return r.select(*KEYS, "bar_ts", label.alias("label"),
                    F.when(ok, F.coalesce("_ht", "_last", "bar_ts")).otherwise(F.col("bar_ts")).alias("horizon_end_ts"),
                    F.when(label == 1, "pt").when(label == -1, "sl").otherwise("vertical").alias("barrier_hit"))


def opening_range(bars: DataFrame, session: Column, hhmm: Column, entry: str, time_stop: str, hard_close: str,
                  bars_to_close: int, vol_n: int, pt: float, sl: float, per_session: int) -> DataFrame:
    """One outcome per session: target, stop (both on closes), time stop or hard close."""
    d = rolling(bars, KEYS, 1, lambda x, w: x.withColumn("_r", log_return(w)))

    def vol(x, w):
        f = w.rowsBetween(-(vol_n - 1), 0)
        return x.withColumn("_sig", F.when(F.count("_r").over(f) >= 2, F.stddev_samp("_r").over(f)))
    d = rolling(d, KEYS, vol_n - 1, vol).withColumns({"session": session, "_hm": hhmm})
    ts = F.col("bar_ts")
    at = {k: F.when(F.col("_hm") >= v, ts) for k, v in (("e", entry), ("s", time_stop), ("c", hard_close))}
    k = [*KEYS, "session"]
    s = d.groupBy(*k).agg(
        F.min(at["e"]).alias("entry_ts"), F.min_by("close", at["e"]).alias("entry_price"),
        F.min_by("_sig", at["e"]).alias("_sig"), F.min(at["s"]).alias("_stop_ts"),
        F.coalesce(F.min(at["c"]), F.max(ts)).alias("_close_ts"), F.min(ts).alias("_first"))
    s = s.withColumn("_ok", F.coalesce(F.col("entry_ts").isNotNull() & (F.col("_sig") > 0), F.lit(False)))
    span = F.col("_sig") * math.sqrt(bars_to_close)
    s = s.withColumns({"pt_price": F.when(F.col("_ok"), F.col("entry_price") * F.exp(pt * span)),
                       "sl_price": F.when(F.col("_ok"), F.col("entry_price") * F.exp(-sl * span))})
    j = s.join(d.select(*k, ts.alias("_t"), F.col("close").alias("_c")), k)
    scan = (F.col("_t") > F.col("entry_ts")) & (F.col("_t") <= F.col("_close_ts"))
    why = (F.when(F.col("_c") >= F.col("pt_price"), "pt").when(F.col("_c") <= F.col("sl_price"), "sl")
           .when(F.col("_t") == F.col("_stop_ts"), "timestop"))
    hit = F.when(F.col("_ok") & scan & why.isNotNull(), F.col("_t"))
    out = j.groupBy(*k, *[c for c in s.columns if c not in k]).agg(
        F.min_by(F.struct(F.col("_t").alias("t"), F.col("_c").alias("c"), why.alias("w")), hit).alias("_x"),
        F.max(F.when(F.col("_t") == F.col("_close_ts"), F.col("_c"))).alias("_cc"))
    px = F.when(F.col("_ok"), F.coalesce(F.col("_x.c"), F.col("_cc")))
    return out.select(
        *k, F.when(F.col("_ok"), F.col("entry_ts")).otherwise(F.col("_first")).alias("entry_ts"),
        F.when(F.col("_ok"), F.col("entry_price")).alias("entry_price"),
        F.when(F.col("_ok"), F.col("_sig") * math.sqrt(252 * per_session)).alias("vol_at_entry"),
        F.when(F.col("_ok"), F.coalesce(F.col("_x.t"), F.col("_close_ts"))).otherwise(F.col("_first")).alias("exit_ts"),
        px.alias("exit_price"),
        F.when(~F.col("_ok"), "no_data").otherwise(F.coalesce(F.col("_x.w"), F.lit("hardclose"))).alias("exit_reason"),
        F.when(F.col("_ok"), log_ratio(px, "entry_price")).otherwise(0.0).alias("pnl_log"))


def forward_return(bars: DataFrame, h: int) -> DataFrame:
    def build(x, w):
        r = log_ratio(F.lead("close", h).over(w), "close")
        return x.withColumns({"fwd_ret": r, "fwd_sign": F.coalesce(F.signum(r), F.lit(0.0)).cast("int")})
    return rolling(bars, KEYS, 0, build, lookahead=h)


def _follow(setups: DataFrame, bars: DataFrame, start: str, reach: int, id_cols: Sequence[str]) -> DataFrame:
    """Each setup with the ``reach`` bars from position ``start`` on: an equi-join on
    (symbol, position), so no range comparison and no hot key."""
    wide = setups.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(reach - 1)))).withColumn(
        POS, F.col(start) + F.col("_k"))
    px = bars.select(*KEYS, POS, *[F.col(c).alias(f"_{c}") for c in ("open", "high", "low", "close")],
                     *[F.col(c) for c in bars.columns if c.startswith("_x")])
    return wide.join(px, [*KEYS, POS])


def bracket_outcomes(setups: DataFrame, bars: DataFrame, k: int, alpha: float, beta: float,
                     id_cols: Sequence[str]) -> DataFrame:
    """Limit fill within k bars of the confirmation, then target, stop or time stop.

    ``setups`` carries side, confirm_pos, limit_price and atr. A bar that reaches
    both prices counts as the stop; the time stop is the close k bars after the
    fill; a series that ends before closes at its last bar.
    """
    ids = [*KEYS, *id_cols]
    keep = [c for c in ("side", "confirm_pos", "limit_price", "atr") if c not in ids]
    p = _follow(setups, bars, "confirm_pos", 2 * k, id_cols)
    long = F.col("side") == 1
    touch = F.when(long, F.col("_low") <= F.col("limit_price")).otherwise(F.col("_high") >= F.col("limit_price"))
    fills = p.groupBy(*ids, *keep).agg(
        F.min(F.when(touch & (F.col("_k") < k), F.col(POS))).alias("fill_pos"))
    got = fills.filter(F.col("fill_pos").isNotNull())
    # No fill is at the series' last bar only if a later bar exists; such trades close there.
    q = _follow(got, bars, "fill_pos", k + 1, id_cols)
    tp = F.col("limit_price") + F.when(long, 1).otherwise(-1) * alpha * F.col("atr")
    stop = F.col("limit_price") - F.when(long, 1).otherwise(-1) * beta * F.col("atr")
    at_sl = F.when(long, F.col("_low") <= stop).otherwise(F.col("_high") >= stop)
    at_tp = F.when(long, F.col("_high") >= tp).otherwise(F.col("_low") <= tp)
    why = F.when(F.col("_k") == k, "time_stop").when(at_sl, "stop_loss").when(at_tp, "profit_target")
    price = F.when(F.col("_k") == k, F.col("_close")).when(at_sl, stop).when(at_tp, tp)
    hit = F.when((F.col("_k") > 0) & why.isNotNull(), F.col(POS))
    out = q.groupBy(*ids).agg(
        F.min_by(F.struct(F.col(POS).alias("p"), price.alias("px"), why.alias("w")), hit).alias("_e"),
        F.max(POS).alias("_lp"), F.max_by("_close", POS).alias("_lc"))
    r = fills.join(out, ids, "left")
    filled = F.col("fill_pos").isNotNull()
    px = F.coalesce(F.col("_e.px"), F.col("_lc"))
    pnl = F.when(filled, (px - F.col("limit_price")) * F.col("side")).otherwise(0.0)
    return r.select(
        *ids, *[c for c in keep if c in ("side", "confirm_pos")], "fill_pos",
        F.coalesce(F.col("_e.p"), F.col("_lp")).alias("exit_pos"), px.alias("exit_price"),
        F.when(~filled, "never_filled").otherwise(F.coalesce(F.col("_e.w"), F.lit("hard_close"))).alias("exit_reason"),
        pnl.alias("pnl"), F.when(F.col("atr") > 0, pnl / (beta * F.col("atr"))).otherwise(0.0).alias("r_multiple"))


def breakout_outcomes(bars: DataFrame, k_atr: float, max_bars: int, session: Column) -> DataFrame:
    """Outcome of every breakout on its own: gap through the stop, stop touch, opposite
    break, flat after max_bars, or session end.

    ``bars`` carries event and atr. Entry is the next open; the stop is k_atr ATRs away.
    """
    def mark(x, w):
        s = session
        return x.withColumns({
            "_xs": s, "_xe": F.col("event"),
            "_xlast": (F.lead(s, 1).over(w) != s) | F.lead(s, 1).over(w).isNull()})
    b = rolling(bars, KEYS, 0, mark, lookahead=1)
    entry = rolling(b, KEYS, 0, lambda x, w: x.withColumns({
        "entry_price": F.lead("open").over(w), "_es": F.lead("_xs").over(w)}), lookahead=1)
    ev = entry.filter((F.col("event") != 0) & F.col("atr").isNotNull() & F.col("entry_price").isNotNull()).select(
        *KEYS, F.col(POS).alias("event_pos"), F.col("event").alias("side"), "atr", "entry_price", "_es",
        (F.col(POS) + 1).alias("entry_pos"),
        (F.col("entry_price") - F.col("event") * k_atr * F.col("atr")).alias("stop_price"))
    q = _follow(ev, b, "entry_pos", max_bars + 1, ["event_pos"]).filter(F.col("_xs") == F.col("_es"))
    long = F.col("side") == 1
    gap = F.when(long, F.col("_open") < F.col("stop_price")).otherwise(F.col("_open") > F.col("stop_price"))
    touch = F.when(long, F.col("_low") <= F.col("stop_price")).otherwise(F.col("_high") >= F.col("stop_price"))
    why = (F.when(gap, "gap_through_stop").when(touch, "stop_hit")
           .when(F.col("_xe") == -F.col("side"), "opposite_break")
           .when(F.col("_k") == max_bars, "eod_flatten").when(F.col("_xlast"), "session_end"))
    px = F.when(gap, F.col("_open")).when(touch, F.col("stop_price")).otherwise(F.col("_close"))
    hit = F.when(why.isNotNull(), F.col(POS))
    out = q.groupBy(*KEYS, "event_pos", "side", "atr", "entry_price", "stop_price").agg(
        F.min_by(F.struct(F.col(POS).alias("p"), px.alias("px"), why.alias("w")), hit).alias("_e"))
    move = (F.col("_e.px") - F.col("entry_price")) * F.col("side")
    return out.select(*KEYS, "event_pos", "side", "entry_price", F.col("_e.p").alias("exit_pos"),
                      F.col("_e.px").alias("exit_price"), F.col("_e.w").alias("exit_reason"),
                      F.try_divide(move, k_atr * F.col("atr")).alias("r_multiple"))


def strategy_returns(d: DataFrame, yhat: str, y: str, train: Column, gate: Column, cost: float,
                     keys=KEYS) -> DataFrame:
    """Returns of trading the predicted sign, holding, and the sign of the train mean,
    with a gate and a cost whenever a position is held."""
    mean = d.filter(train).groupBy(*keys).agg(F.avg(y).alias("_m"))
    j = d.join(mean, list(keys), "left")
    side = F.when(gate, F.signum(F.col(yhat))).otherwise(0.0)
    side = F.coalesce(side, F.lit(0.0))
    return j.withColumns({
        "strategy": side * F.col(y) - F.abs(side) * cost,
        "passive": F.col(y),
        "train_mean": F.coalesce(F.signum("_m"), F.lit(0.0)) * F.col(y)}).drop("_m")
