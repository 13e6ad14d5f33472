"""Window features (section E)."""

import math

from pyspark.sql import functions as F

from tapeloom.operators import basket as bk
from tapeloom.operators import bars as ops
from tapeloom.operators import features as feat
from tapeloom.operators import rolls, trend
from tapeloom.operators.joins import nearest_within
from tapeloom.operators.metrics import equity_curve
from tapeloom.operators.scan import POS, number_rows, prefix, rolling
from tapeloom.plans.inputs import bars, daily, numbered_bars, returns, stored_bars, ticks
from tapeloom.plans.registry import cte, query
from tapeloom.plans.resampling import CONTRACT_SQL, SIGNED_SQL, contracts
from tapeloom.session import load

W = "PARTITION BY symbol ORDER BY bar_ts"


def _win(n, extra=""):
    return f"({W} ROWS {n - 1} PRECEDING)"


def pick(df, *cols):
    return df.select("symbol", "bar_ts", *cols)


@query("e1_rv_realized", cte("rets") + f"""
SELECT symbol, bar_ts, CASE WHEN count(r) OVER a = 12 THEN sum(r * r) OVER a END AS rv_v1
FROM rets WINDOW a AS {_win(12)}""", f8="rv_v1")
def e1(spark, sf):
    return pick(feat.rv_realized(numbered_bars(spark, sf), 12), "rv_v1")


@query("e2_rv_parkinson", cte("rets") + f"""
SELECT symbol, bar_ts, CASE WHEN count(*) OVER a = 12 THEN avg(pow(ln(high / low), 2)) OVER a / (4 * ln(2)) END AS parkinson_v1
FROM rets WINDOW a AS {_win(12)}""", f8="parkinson_v1")
def e2(spark, sf):
    return pick(feat.rv_parkinson(numbered_bars(spark, sf), 12), "parkinson_v1")


@query("e3_realized_skew", cte("rets", m=f"""SELECT symbol, bar_ts, count(r) OVER a AS k, avg(r) OVER a AS m1,
  avg(r * r) OVER a AS m2, avg(r * r * r) OVER a AS m3 FROM rets WINDOW a AS {_win(24)}""") + """
SELECT symbol, bar_ts, CASE WHEN k = 24 AND m2 - m1 * m1 > 0
  THEN (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(m2 - m1 * m1, 1.5) END AS skew_v1 FROM m""", f8="skew_v1")
def e3(spark, sf):
    return pick(feat.realized_skew(numbered_bars(spark, sf), 24), "skew_v1")


@query("e4_ofi_tickrule", SIGNED_SQL + f"""
SELECT symbol, bar_ts, CASE WHEN count(*) OVER a = 12 THEN sum(sgn * volume) OVER a / nullif(sum(volume) OVER a, 0) END AS ofi_v1
FROM signed WINDOW a AS {_win(12)}""", f8="ofi_v1")
def e4(spark, sf):
    return pick(feat.ofi_tick_rule(numbered_bars(spark, sf), 12), "ofi_v1")


FIVE_SQL = """SELECT symbol, bar_ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, seq) AS close, sum(size) AS volume FROM (
      SELECT *, CASE WHEN time_bucket(INTERVAL 5 MINUTE, ts) = ts THEN ts
      ELSE time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE END AS bar_ts FROM ticks) GROUP BY 1, 2"""


@query("e5_microstructure_block", cte("ticks", five=FIVE_SQL, steps=f"""
  SELECT *, sign(close - lag(close) OVER w) AS s, CASE WHEN bar_ts - lag(bar_ts) OVER w > INTERVAL 5 MINUTE THEN 0
    ELSE ln(close / lag(close) OVER w) END AS r FROM five WINDOW w AS ({W})""", sg=f"""
  SELECT *, coalesce(last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0) AS sgn FROM steps""",
  agg=f"""SELECT symbol, bar_ts, count(r) OVER a AS k, count(*) OVER a AS kk, sum(r * r) OVER a AS s2, avg(r) OVER a AS m1, avg(r * r) OVER a AS m2,
    avg(r * r * r) OVER a AS m3, sum(pow(ln(high / low), 2)) OVER a AS hl, sum(sgn * volume) OVER a AS sv FROM sg WINDOW a AS {_win(48)}""") + """
SELECT symbol, bar_ts, CASE WHEN k = 48 THEN s2 END AS rv, CASE WHEN kk = 48 THEN hl / (4 * ln(2) * 48) END AS parkinson,
  CASE WHEN k = 48 AND m2 - m1 * m1 > 0 THEN (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(m2 - m1 * m1, 1.5) END AS skew,
  CASE WHEN kk = 48 THEN sv END AS signed_volume,
  strftime(timezone('America/New_York', timezone('UTC', bar_ts)), '%H:%M') = '09:45' AS anchor FROM agg""",
       f8="rv parkinson skew signed_volume")
def e5(spark, sf):
    from tapeloom.functions import clock

    d = feat.gap_aware_block(numbered_bars(spark, sf, 5), 48, 5)
    hhmm = F.date_format(clock.local_time("bar_ts", clock.NEW_YORK), "HH:mm")
    return pick(d, "rv", "parkinson", "skew", "signed_volume", (hhmm == "09:45").alias("anchor"))


def numbered_daily(spark, sf):
    d = daily(spark, sf)
    return number_rows(d, ["symbol"], ["session"], chunk=F.trunc("session", "year"))


WD = "PARTITION BY symbol ORDER BY session"


@query("e6_sma_distance", cte("daily") + f"""
SELECT symbol, session, CASE WHEN count(*) OVER a = 50 THEN ln(close / avg(close) OVER a) END AS sma_dist_50,
  CASE WHEN count(*) OVER b = 200 THEN ln(close / avg(close) OVER b) END AS sma_dist_200
FROM daily WINDOW a AS ({WD} ROWS 49 PRECEDING), b AS ({WD} ROWS 199 PRECEDING)""", f8="sma_dist_50 sma_dist_200", dt="session")
def e6(spark, sf):
    d = feat.sma_distance(feat.sma_distance(numbered_daily(spark, sf), 50), 200)
    return d.select("symbol", "session", "sma_dist_50", "sma_dist_200")


@query("e7_rolling_garman_klass", cte("daily") + f"""
SELECT symbol, session, CASE WHEN count(*) OVER a = 20 THEN 0.5 * pow(ln(max(high) OVER a / min(low) OVER a), 2)
  - (2 * ln(2) - 1) * pow(ln(close / first_value(open) OVER a), 2) END AS gk_v1
FROM daily WINDOW a AS ({WD} ROWS 19 PRECEDING)""", f8="gk_v1", dt="session")
def e7(spark, sf):
    return feat.rolling_garman_klass(numbered_daily(spark, sf), 20).select("symbol", "session", "gk_v1")


@query("e8_rolling_slope", cte("daily", n="SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS pos FROM daily") + f"""
SELECT symbol, session, CASE WHEN count(*) OVER a = 20 THEN (20 * sum(pos * ln(close)) OVER a - sum(pos) OVER a * sum(ln(close)) OVER a)
  / (20 * sum(pos * pos) OVER a - pow(sum(pos) OVER a, 2)) END AS slope_v1 FROM n WINDOW a AS ({WD} ROWS 19 PRECEDING)""", f8="slope_v1", dt="session")
def e8(spark, sf):
    return feat.rolling_slope(numbered_daily(spark, sf), 20, F.log("close")).select("symbol", "session", "slope_v1")


@query("e9_yang_zhang", cte("bars", p=f"""SELECT symbol, bar_ts, ln(open / lag(close) OVER ({W})) AS o1, ln(close / open) AS c1,
  ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM bars""") + f"""
SELECT symbol, bar_ts, CASE WHEN count(o1) OVER a = 20 THEN sqrt(greatest(0, var_samp(o1) OVER a
  + 0.34 / (1.34 + 21 / 19.0) * var_samp(c1) OVER a + (1 - 0.34 / (1.34 + 21 / 19.0)) * avg(rs) OVER a)) END AS yz_v1
FROM p WINDOW a AS {_win(20)}""", f8="yz_v1")
def e9(spark, sf):
    return pick(feat.yang_zhang(numbered_bars(spark, sf), 20), "yz_v1")


@query("e10_lag_features", cte("rets") + f"""
SELECT symbol, bar_ts, r AS r_lag0, lag(r, 1) OVER w AS r_lag1, lag(r, 6) OVER w AS r_lag6, lag(r, 23) OVER w AS r_lag23
FROM rets WINDOW w AS ({W})""", f8="r_lag0 r_lag1 r_lag6 r_lag23")
def e10(spark, sf):
    d = feat.lag_features(feat.with_log_return(numbered_bars(spark, sf)), 24)
    return pick(d, "r_lag0", "r_lag1", "r_lag6", "r_lag23")


@query("e11_session_anchors", cte("bars", s="""
  SELECT symbol, CAST(bar_ts AS DATE) AS session, max(CASE WHEN hour(bar_ts) = 9 THEN close END) AS a,
    max(CASE WHEN hour(bar_ts) = 16 THEN close END) AS c, sum(close * volume) / nullif(sum(volume), 0) AS vwap,
    arg_min(open, bar_ts) AS f, arg_max(close, bar_ts) AS l FROM bars GROUP BY 1, 2""") + """
SELECT symbol, session, ln(l / vwap) AS vwap_dev, ln(a / lag(l) OVER w) AS overnight, ln(a / f) AS pre_open,
  ln(c / lag(vwap) OVER w) AS close_vs_prev_vwap FROM s WINDOW w AS (PARTITION BY symbol ORDER BY session)""",
       f8="vwap_dev overnight pre_open close_vs_prev_vwap", dt="session")
def e11(spark, sf):
    return feat.session_anchors(bars(spark, sf), F.to_date("bar_ts"), F.hour("bar_ts") == 9, F.hour("bar_ts") == 16)


@query("e12_session_features", cte("rets", v=f"""SELECT *, CAST(bar_ts AS DATE) AS session,
    CASE WHEN count(r) OVER a = 24 THEN sqrt(sum(r * r) OVER a / 24) * sqrt(252 * 390) END AS vol FROM rets WINDOW a AS {_win(24)}""",
  s="""SELECT symbol, session, arg_min(open, bar_ts) AS f, arg_max(close, bar_ts) AS l,
    arg_min(close, bar_ts) FILTER (WHERE hour(bar_ts) >= 10) AS e, arg_min_null(vol, bar_ts) FILTER (WHERE hour(bar_ts) >= 10) AS vol,
    arg_min(bar_ts, bar_ts) FILTER (WHERE hour(bar_ts) >= 10) AS et,
    arg_max(close, bar_ts) FILTER (WHERE hour(bar_ts) BETWEEN 4 AND 8) AS pre FROM v GROUP BY 1, 2""") + """
SELECT symbol, session, sign(ln(e / f)) AS first_sign, ln(f / lag(l) OVER w) AS gap, ln(pre / lag(l) OVER w) AS pre_ret, vol, et AS entry_ts
FROM s WINDOW w AS (PARTITION BY symbol ORDER BY session)""", f8="first_sign gap pre_ret vol", dt="session")
def e12(spark, sf):
    return feat.session_entry_features(numbered_bars(spark, sf), 24, F.to_date("bar_ts"),
                                       F.hour("bar_ts") >= 10, F.hour("bar_ts").between(4, 8))


@query("e13_rolling_apply_pit", cte("bars") + f"""
SELECT symbol, bar_ts, CASE WHEN count(*) OVER a >= 5 THEN stddev_samp(close) OVER a END AS sd,
  CASE WHEN count(*) OVER b >= 5 THEN max(close) OVER b - min(close) OVER b END AS span
FROM bars WINDOW a AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
       f8="sd span")
def e13(spark, sf):
    d = feat.rolling_apply_pit(numbered_bars(spark, sf), 20, F.stddev_samp, "close", "sd", 5)
    d = feat.rolling_apply_pit(d, 20, F.max, "close", "_hi", 5, include_current=True)
    d = feat.rolling_apply_pit(d, 20, F.min, "close", "_lo", 5, include_current=True)
    return pick(d, "sd", (F.col("_hi") - F.col("_lo")).alias("span"))


DONCHIAN = cte("bars", ch=f"""SELECT *, row_number() OVER ({W}) - 1 AS pos,
    CASE WHEN count(*) OVER a = 20 THEN max(close) OVER a END AS upper, CASE WHEN count(*) OVER a = 20 THEN min(close) OVER a END AS lower
  FROM bars WINDOW a AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
  ev="SELECT *, CASE WHEN close > upper THEN 1 WHEN close < lower THEN -1 ELSE 0 END AS event FROM ch")


@query("e14_donchian", DONCHIAN + "SELECT symbol, bar_ts, upper, lower FROM ev", f8="upper lower")
def e14(spark, sf):
    return pick(feat.donchian(numbered_bars(spark, sf), 20), "upper", "lower")


@query("e15_breakout_events", DONCHIAN + "SELECT symbol, bar_ts, event FROM ev", i8="event")
def e15(spark, sf):
    return pick(feat.donchian(numbered_bars(spark, sf), 20), "event")


@query("e16_first_fire", DONCHIAN + """, fires AS (
  SELECT symbol, event, min(pos) AS pos FROM ev WHERE event <> 0 GROUP BY 1, 2
  UNION ALL SELECT f.symbol, f.event, (SELECT min(e.pos) FROM ev e WHERE e.symbol = f.symbol AND e.event = f.event AND e.pos > f.pos + 10) AS pos
  FROM fires f WHERE f.pos IS NOT NULL)
SELECT e.symbol, e.bar_ts, coalesce(f.event, 0) AS fired FROM ev e LEFT JOIN fires f ON e.symbol = f.symbol AND e.pos = f.pos AND e.event = f.event""",
       i8="fired")
def e16(spark, sf):
    return pick(trend.first_fire(feat.donchian(numbered_bars(spark, sf), 20), 10), "fired")


@query("e17_trend_gate", DONCHIAN + f""", g AS (SELECT *, CASE WHEN count(*) OVER l = 50 THEN avg(close) OVER l END AS ml, avg(close) OVER s AS ms
  FROM ev WINDOW s AS {_win(10)}, l AS {_win(50)}),
k AS (SELECT *, CASE WHEN ms > ml * 1.001 THEN 1 WHEN ms < ml * 0.999 THEN -1 ELSE 0 END AS side FROM g)
SELECT symbol, bar_ts, CASE WHEN side = 0 OR event = side THEN event ELSE 0 END AS gated FROM k""", i8="gated")
def e17(spark, sf):
    d = trend.ma_cross(feat.donchian(numbered_bars(spark, sf), 20), 10, 50, 0.001)
    return pick(d, trend.agree(F.col("event"), F.col("side_d")).alias("gated"))


@query("e18_ts_momentum_side", cte("rets") + f"""
SELECT symbol, bar_ts, CASE WHEN count(r) OVER a >= 2 AND stddev_samp(r) OVER a > 0
  AND abs(ln(close / lag(close, 20) OVER ({W}))) > 0.5 * sqrt(20) * stddev_samp(r) OVER a
  THEN sign(ln(close / lag(close, 20) OVER ({W}))) ELSE 0 END AS side_a FROM rets WINDOW a AS {_win(20)}""", i8="side_a")
def e18(spark, sf):
    return pick(trend.ts_momentum(numbered_bars(spark, sf), 20, 0.5), "side_a")


_PM = "CASE WHEN u > d AND u > 0 THEN u ELSE 0 END"
_MM = "CASE WHEN d > u AND d > 0 THEN d ELSE 0 END"


@query("e19_adx_side", cte("bars", mv=f"""
  SELECT *, row_number() OVER ({W}) - 1 AS pos, high - lag(high) OVER ({W}) AS u, lag(low) OVER ({W}) - low AS d,
    greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr FROM bars""",
  x=f"""SELECT symbol, bar_ts, pos, {_PM} AS p, {_MM} AS m, tr FROM mv WHERE pos >= 1""",
  seed="SELECT symbol, sum(p) AS p, sum(m) AS m, sum(tr) AS tr, 14 AS pos FROM x WHERE pos <= 14 GROUP BY 1",
  sm="""SELECT symbol, pos::BIGINT AS pos, p, m, tr FROM seed UNION ALL
    SELECT s.symbol, x.pos, s.p - s.p / 14 + x.p, s.m - s.m / 14 + x.m, s.tr - s.tr / 14 + x.tr FROM sm s JOIN x ON x.symbol = s.symbol AND x.pos = s.pos + 1""",
  di="SELECT symbol, pos, 100 * p / tr AS pdi, 100 * m / tr AS mdi, 100 * abs(p - m) / (p + m) AS dx FROM sm",
  aseed="SELECT symbol, avg(dx) AS adx FROM di WHERE pos <= 27 GROUP BY 1",
  ax="""SELECT symbol, 27::BIGINT AS pos, adx FROM aseed UNION ALL
    SELECT a.symbol, d.pos, (a.adx * 13 + d.dx) / 14 FROM ax a JOIN di d ON d.symbol = a.symbol AND d.pos = a.pos + 1""") + """
SELECT b.symbol, b.bar_ts, a.adx, CASE WHEN a.adx > 20 AND pdi > mdi THEN 1 WHEN a.adx > 20 AND mdi > pdi THEN -1 ELSE 0 END AS side_b
FROM mv b LEFT JOIN ax a ON a.symbol = b.symbol AND a.pos = b.pos LEFT JOIN di ON di.symbol = b.symbol AND di.pos = b.pos""", f8="adx", i8="side_b")
def e19(spark, sf):
    return pick(trend.adx_side(numbered_bars(spark, sf), 14, 20.0), "adx", "side_b")


@query("e20_hac_slope_side", cte("rets", y=f"""SELECT symbol, bar_ts, count(*) OVER a AS k, list(ln(close)) OVER a AS ys, avg(ln(close)) OVER a AS m,
    regr_slope(ln(close), pos) OVER a AS b FROM rets WINDOW a AS {_win(20)}""",
  e="SELECT symbol, bar_ts, b, list_transform(ys, lambda v, i: v - m - b * (i - 1 - 9.5)) AS e FROM y WHERE k = 20",
  g="""SELECT symbol, bar_ts, b, """ + ", ".join(
      f"list_sum(list_transform(range(1, {21 - j}), lambda i: e[i] * e[i + {j}])) / 20 AS g{j}" for j in range(4)) + " FROM e",
  t="SELECT *, b / sqrt((g0 + 2 * (0.75 * g1 + 0.5 * g2 + 0.25 * g3)) / (20 * 399 / 12.0)) AS t FROM g WHERE g0 + 2 * (0.75 * g1 + 0.5 * g2 + 0.25 * g3) > 0") + """
SELECT r.symbol, r.bar_ts, t.t AS side_c_t, CASE WHEN abs(t.t) > 2 THEN sign(t.b) ELSE 0 END AS side_c
FROM rets r LEFT JOIN t ON t.symbol = r.symbol AND t.bar_ts = r.bar_ts""", f8="side_c_t", i8="side_c", digits=5)
def e20(spark, sf):
    return pick(trend.hac_slope_side(numbered_bars(spark, sf), 20, 2.0), "side_c_t", "side_c")


@query("e21_ma_cross_side", cte("bars", m=f"""SELECT *, CASE WHEN count(*) OVER l = 50 THEN avg(close) OVER l END AS ml, avg(close) OVER s AS ms
  FROM bars WINDOW s AS {_win(10)}, l AS {_win(50)}""") + """
SELECT symbol, bar_ts, CASE WHEN ms > ml * 1.01 THEN 1 WHEN ms < ml * 0.99 THEN -1 ELSE 0 END AS side_d FROM m""", i8="side_d")
def e21(spark, sf):
    return pick(trend.ma_cross(numbered_bars(spark, sf), 10, 50, 0.01), "side_d")


ATR_SQL = cte("bars", tr=f"""
  SELECT *, row_number() OVER ({W}) - 1 AS pos, greatest(high - low, coalesce(abs(high - lag(close) OVER ({W})), 0), coalesce(abs(low - lag(close) OVER ({W})), 0)) AS tr FROM bars""",
  atr="""SELECT symbol, 13::BIGINT AS pos, avg(tr) AS atr FROM tr WHERE pos <= 13 GROUP BY 1 UNION ALL
    SELECT a.symbol, t.pos, a.atr * 13 / 14 + t.tr / 14 FROM atr a JOIN tr t ON t.symbol = a.symbol AND t.pos = a.pos + 1""")


@query("e22_wilder_atr", ATR_SQL + """
SELECT t.symbol, t.bar_ts, t.tr, a.atr FROM tr t LEFT JOIN atr a ON a.symbol = t.symbol AND a.pos = t.pos""", f8="tr atr")
def e22(spark, sf):
    return pick(trend.atr(numbered_bars(spark, sf), 14), "tr", "atr")


RHO_SQL = """
  pr AS (SELECT a.symbol, a.pos, a.pos - b.pos AS k, CASE WHEN greatest(a.hi, b.hi) - least(a.lo, b.lo) > 0
      THEN greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / (greatest(a.hi, b.hi) - least(a.lo, b.lo))
      ELSE (a.lo = b.lo AND a.hi = b.hi)::INT END AS j
    FROM bd a JOIN bd b ON a.symbol = b.symbol AND b.pos BETWEEN a.pos - 4 AND a.pos - 1),
  rho AS (SELECT t.symbol, t.bar_ts, t.pos, avg(p.j) AS rho FROM bd t JOIN pr p ON p.symbol = t.symbol
    AND p.pos <= t.pos AND p.pos - p.k >= t.pos - 4 AND p.pos >= t.pos - 4 WHERE t.pos >= 4 GROUP BY 1, 2, 3)"""
BODY = "SELECT *, least(open, close) AS lo, greatest(open, close) AS hi FROM rets"


@query("e23_body_overlap", cte("rets", bd=BODY) + "," + RHO_SQL + """
SELECT b.symbol, b.bar_ts, rho.rho FROM bd b LEFT JOIN rho ON b.symbol = rho.symbol AND b.pos = rho.pos""", f8="rho")
def e23(spark, sf):
    return pick(trend.body_overlap(numbered_bars(spark, sf), 5), "rho")


SWING_SQL = f"""
  run AS (SELECT symbol, pos, low, high, lag(low, 3) OVER w > lag(low, 2) OVER w AND lag(low, 2) OVER w > lag(low) OVER w AND lag(low) OVER w > low AS dn,
    lag(high, 3) OVER w < lag(high, 2) OVER w AND lag(high, 2) OVER w < lag(high) OVER w AND lag(high) OVER w < high AS up FROM rets WINDOW w AS ({W})),
  cf AS (SELECT r.symbol, 1 AS side, r.pos AS swing_pos, n.pos AS confirm_pos, r.low AS limit_price,
      row_number() OVER (PARTITION BY r.symbol, r.pos ORDER BY n.pos) AS k FROM run r JOIN run n ON r.symbol = n.symbol AND n.pos BETWEEN r.pos + 1 AND r.pos + 5
      WHERE r.dn AND n.low > r.low
    UNION ALL SELECT r.symbol, -1, r.pos, n.pos, r.high, row_number() OVER (PARTITION BY r.symbol, r.pos ORDER BY n.pos)
      FROM run r JOIN run n ON r.symbol = n.symbol AND n.pos BETWEEN r.pos + 1 AND r.pos + 5 WHERE r.up AND n.high < r.high),
  st AS (SELECT symbol, side, swing_pos, confirm_pos, limit_price FROM cf WHERE k = 2)"""


@query("e24_swing_pivots", cte("rets") + "," + SWING_SQL + "SELECT * FROM st", f8="limit_price", i8="side")
def e24(spark, sf):
    return trend.pivot_setups(numbered_bars(spark, sf), 5)


LEVEL_SQL = f"""
  lv AS (SELECT symbol, confirm_pos AS pos, arg_max(limit_price, swing_pos) FILTER (WHERE side = 1) AS lo,
      arg_max(limit_price, swing_pos) FILTER (WHERE side = -1) AS hi FROM st GROUP BY 1, 2),
  ml AS (SELECT r.*, last_value(lv.lo IGNORE NULLS) OVER u AS swing_low, last_value(lv.hi IGNORE NULLS) OVER u AS swing_high
    FROM rets r LEFT JOIN lv ON r.symbol = lv.symbol AND r.pos = lv.pos WINDOW u AS (PARTITION BY r.symbol ORDER BY r.pos ROWS UNBOUNDED PRECEDING))"""


@query("e25_wick_reversal", cte("rets") + "," + SWING_SQL + "," + LEVEL_SQL + """
SELECT symbol, pos, 1 AS side, swing_low AS level, low AS limit_price, (least(open, close) - low) / abs(close - open) AS ratio FROM ml
WHERE abs(close - open) >= 1e-9 AND low < swing_low AND close >= swing_low AND least(open, close) > low AND (least(open, close) - low) / abs(close - open) >= 0.5
UNION ALL SELECT symbol, pos, -1, swing_high, high, (high - greatest(open, close)) / abs(close - open) FROM ml
WHERE abs(close - open) >= 1e-9 AND high > swing_high AND close <= swing_high AND high > greatest(open, close) AND (high - greatest(open, close)) / abs(close - open) >= 0.5""",
       f8="level limit_price ratio", i8="side")
def e25(spark, sf):
    return trend.wick_reversals(trend.with_swing_levels(stored_bars(spark, sf), 5), 0.5)


TOUCH_SQL = """SELECT user_id AS level, event_type AS fold, event_id, ts,
    CASE WHEN value > 150 THEN 'penetrate' ELSE 'reject' END AS kind FROM events"""


def touches(spark, sf):
    return load(spark, sf, "events").select(
        F.col("user_id").alias("level"), F.col("event_type").alias("fold"), "event_id", "ts",
        F.when(F.col("value") > 150, "penetrate").otherwise("reject").alias("kind"))


@query("e26_level_exhaustion", f"""
WITH t AS (SELECT *, count(*) FILTER (WHERE kind = 'penetrate') OVER (PARTITION BY level, fold ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dead FROM ({TOUCH_SQL})),
k AS (SELECT *, dead > 0 AND kind = 'reject' AS error, dead > 0 OR kind = 'penetrate' AS killed FROM t),
r AS (SELECT *, count(*) FILTER (WHERE kind = 'reject' AND NOT error) OVER (PARTITION BY level, fold ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS rejections FROM k)
SELECT event_id, rejections, killed, error, NOT killed AND rejections <= 3 AS permitted FROM r""")
def e26(spark, sf):
    t = number_rows(touches(spark, sf), ["level", "fold"], ["ts", "event_id"])
    return trend.level_states(t, 3).select("event_id", "rejections", "killed", "error", "permitted")


@query("e27_setup_gates", cte("rets", bd=BODY) + "," + RHO_SQL + "," + SWING_SQL + f""",
  mc AS (SELECT symbol, pos, bar_ts, CASE WHEN count(*) OVER l = 50 THEN avg(close) OVER l END AS ml, avg(close) OVER s AS ms FROM rets WINDOW s AS {_win(10)}, l AS {_win(50)}),
  g AS (SELECT st.*, mc.bar_ts, CASE WHEN ms > ml * 1.001 THEN 1 WHEN ms < ml * 0.999 THEN -1 ELSE 0 END AS trend, rho.rho
    FROM st JOIN mc ON mc.symbol = st.symbol AND mc.pos = st.confirm_pos LEFT JOIN rho ON rho.symbol = st.symbol AND rho.pos = st.confirm_pos),
  nw AS (SELECT g.*, EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'signup'
     AND e.ts BETWEEN g.bar_ts - INTERVAL 15 MINUTE AND g.bar_ts + INTERVAL 15 MINUTE) AS news FROM g)
SELECT symbol, side, swing_pos, confirm_pos, trend, rho, news, trend = side AND rho <= 0.5 AND NOT news AS passed FROM nw""",
       f8="rho", i8="side trend")
def e27(spark, sf):
    raw = stored_bars(spark, sf)
    b = trend.ma_cross(trend.body_overlap(raw, 5), 10, 50, 0.001)
    at = b.select("symbol", F.col(POS).alias("confirm_pos"), F.col("bar_ts").alias("ts"), F.col("side_d").alias("trend"), "rho")
    setups = trend.pivot_setups(raw, 5).join(at, ["symbol", "confirm_pos"])
    news = load(spark, sf, "events").filter("event_type = 'signup'").select("ts", "event_id")
    d = nearest_within(setups, news, [], "ts", "swing_pos", ["event_id"], 15 * 60 * 1_000_000)
    near = F.col("event_id").isNotNull()
    return d.select("symbol", "side", "swing_pos", "confirm_pos", "trend", "rho", near.alias("news"),
                    ((F.col("trend") == F.col("side")) & (F.col("rho") <= 0.5) & ~near).alias("passed"))


DRET = """SELECT symbol, session, close, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY session)) AS r,
    row_number() OVER (PARTITION BY symbol ORDER BY session) AS i FROM daily"""


@query("e28_tsmom_signal", cte("daily", d=DRET) + f"""
SELECT symbol, session, CASE WHEN count(r) OVER a = 126 THEN sign(sum(r) OVER a) ELSE 0 END AS signal
FROM d WINDOW a AS ({WD} ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING)""", f8="signal", dt="session")
def e28(spark, sf):
    return bk.tsmom(bk.daily_returns(daily(spark, sf)), 126).select("symbol", "session", "signal")


EWMA = """SELECT symbol, session, i, coalesce(r, 0) * coalesce(r, 0) AS v FROM d WHERE i = 1 UNION ALL
    SELECT d.symbol, d.session, d.i, e.v * (1 - 1 / 31.0::DOUBLE) + (1 / 31.0::DOUBLE) * d.r * d.r FROM ew e JOIN d ON d.symbol = e.symbol AND d.i = e.i + 1"""


@query("e29_ewma_vol", cte("daily", d=DRET, ew=EWMA) + f"""
SELECT symbol, session, sqrt(coalesce(lag(v) OVER ({WD}), v)) * sqrt(252) AS vol FROM ew""", f8="vol", dt="session")
def e29(spark, sf):
    return bk.ex_ante_vol(bk.daily_returns(daily(spark, sf)), 30).select("symbol", "session", "vol")


@query("e30_basket_return", cte("daily", d=DRET, ew=EWMA, s=f"""
  SELECT d.*, sqrt(coalesce(lag(v) OVER w, v)) * sqrt(252) AS vol, CASE WHEN count(r) OVER a = 126 THEN sign(sum(r) OVER a) ELSE 0 END AS signal
  FROM d JOIN ew USING (symbol, session) WINDOW w AS (PARTITION BY d.symbol ORDER BY session), a AS (PARTITION BY d.symbol ORDER BY session ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING)""",
  wt="""SELECT *, greatest(-0.01, least(0.01, CASE WHEN vol > 0 THEN 0.1 / vol * signal * 0.5 ELSE 0 END)) AS weight, dense_rank() OVER (ORDER BY session) AS day FROM s""",
  h="SELECT *, CASE WHEN lag(day) OVER w = day - 1 THEN lag(weight) OVER w ELSE 0 END AS held FROM wt WINDOW w AS (PARTITION BY symbol ORDER BY session)") + """
SELECT session, avg(held * coalesce(r, 0)) AS ret, count(*) AS active FROM h GROUP BY 1""", f8="ret", dt="session", digits=9)
def e30(spark, sf):
    d = bk.ex_ante_vol(bk.tsmom(bk.daily_returns(daily(spark, sf)), 126), 30)
    d = d.withColumn("weight", bk.vol_target_weight(F.col("signal"), F.col("vol"), F.lit(0.1), F.lit(0.5), F.lit(0.01)))
    return bk.basket(d, bk.session_index(d), []).select("session", "ret", "active")


@query("e31_equal_weight", cte("daily", d=DRET) + "SELECT session, avg(coalesce(r, 0)) AS ret, count(*) AS active FROM d GROUP BY 1",
       f8="ret", dt="session")
def e31(spark, sf):
    return bk.equal_weight(bk.daily_returns(daily(spark, sf)))


@query("e32_forecast_error_std", """
WITH m AS (SELECT o_orderstatus AS indicator, date_trunc('month', o_orderdate) AS month, avg(o_totalprice) / 1000 AS x FROM orders GROUP BY 1, 2),
d AS (SELECT *, x - lag(x) OVER (PARTITION BY indicator ORDER BY month) AS dx FROM m)
SELECT indicator, month, CASE WHEN count(dx) OVER a >= 10 THEN stddev_samp(dx) OVER a END AS dispersion
FROM d WINDOW a AS (PARTITION BY indicator ORDER BY month ROWS 39 PRECEDING)""", f8="dispersion", dt="month")
def e32(spark, sf):
    m = load(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("indicator"), F.trunc("o_orderdate", "MM").alias("month")
                                          ).agg((F.avg("o_totalprice") / 1000).alias("x"))
    return feat.forecast_error_std(m, 40)


@query("e33_trailing_volume", cte("ticks", c=CONTRACT_SQL, v="SELECT root, session, contract_id, sum(size) AS volume FROM c GROUP BY 1, 2, 3") + """
SELECT root, session, contract_id, sum(volume) OVER (PARTITION BY root, contract_id ORDER BY session ROWS 2 PRECEDING) AS trail FROM v""",
       i8="trail", dt="session")
def e33(spark, sf):
    return rolls.trailing_volume(ops.contract_volume(contracts(spark, sf)), 3).drop("volume")


ROLL_SQL = dict(c=CONTRACT_SQL, v="SELECT root, session, contract_id, sum(size) AS volume FROM c GROUP BY 1, 2, 3",
    tv="SELECT *, sum(volume) OVER (PARTITION BY root, contract_id ORDER BY session ROWS 2 PRECEDING) AS trail FROM v",
    fr="SELECT root, session, contract_id AS front FROM tv QUALIFY row_number() OVER (PARTITION BY root, session ORDER BY trail DESC, contract_id) = 1",
    ch="SELECT *, coalesce(front <> lag(front) OVER w, false)::INT AS new FROM fr WINDOW w AS (PARTITION BY root ORDER BY session)",
    ru="SELECT *, sum(new) OVER (PARTITION BY root ORDER BY session) AS run FROM ch",
    rl="SELECT *, count(*) OVER (PARTITION BY root, run) AS run_len, max(run) OVER (PARTITION BY root) AS last_run FROM ru",
    ef="""SELECT *, last_value(CASE WHEN run_len >= 3 OR run = 0 THEN front END IGNORE NULLS) OVER (PARTITION BY root ORDER BY session ROWS UNBOUNDED PRECEDING) AS effective FROM rl""",
    evt="""SELECT root, session, lag(session) OVER w AS prev_session, lag(effective) OVER w AS old, effective AS new_id
      FROM ef WINDOW w AS (PARTITION BY root ORDER BY session) QUALIFY old <> effective""",
    ed="SELECT root, contract_id, session, arg_min(price, seq) AS o, arg_max(price, seq) AS c FROM c GROUP BY 1, 2, 3",
    rt="""SELECT e.root, e.session, e.prev_session, e.old, e.new_id, n.o AS new_open, p.c AS old_close, n.o / p.c AS ratio FROM evt e
      LEFT JOIN ed n ON n.root = e.root AND n.contract_id = e.new_id AND n.session = e.session
      LEFT JOIN ed p ON p.root = e.root AND p.contract_id = e.old AND p.session = e.prev_session""",
    fa="""SELECT f.root, f.session, f.effective, coalesce(exp(sum(ln(r.ratio)) OVER (PARTITION BY f.root ORDER BY f.session
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1) AS factor, r.ratio IS NOT NULL AS roll_flag
      FROM ef f LEFT JOIN rt r ON f.root = r.root AND f.session = r.session""")


def roll_steps(spark, sf):
    c = contracts(spark, sf)
    at = F.col("ts")
    # Hourly bars of each contract.
    b = c.groupBy("root", "session", "contract_id", ops.bucket_end("ts", 60).alias("bar_ts")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return rolls.continuous_series(c, b, 3)


@query("e34_persistence_guard", cte("ticks", **ROLL_SQL) + """
SELECT root, session, front, effective, run_len, NOT (run_len >= 3 OR run = 0) AND front <> effective AND run < last_run AS rejected FROM ef""", dt="session")
def e34(spark, sf):
    return roll_steps(spark, sf)["effective"].select("root", "session", "front", "effective", "run_len", "rejected")


@query("e35_roll_events", cte("ticks", **ROLL_SQL) + "SELECT root, session, prev_session, old, new_id AS new FROM evt", dt="session prev_session")
def e35(spark, sf):
    return roll_steps(spark, sf)["events"]


@query("e36_roll_ratio", cte("ticks", **ROLL_SQL) + "SELECT root, session, old, new_id AS new, new_open, old_close, ratio FROM rt",
       f8="new_open old_close ratio", dt="session")
def e36(spark, sf):
    return roll_steps(spark, sf)["ratios"].drop("prev_session")


@query("e37_back_adjust", cte("ticks", **ROLL_SQL, hb="""SELECT root, session, contract_id, CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS bar_ts,
    arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(size) AS volume FROM c GROUP BY 1, 2, 3, 4""") + """
SELECT root, session, contract_id, bar_ts, open * factor AS open, high * factor AS high, low * factor AS low, close * factor AS close, volume,
  factor AS adjustment_factor, roll_flag, close AS unadjusted_close FROM hb JOIN fa USING (root, session) WHERE contract_id = effective""",
       f8="open high low close adjustment_factor unadjusted_close", i8="volume", dt="session")
def e37(spark, sf):
    return roll_steps(spark, sf)["bars"]


@query("e38_equity_drawdown", cte("returns", c="""SELECT symbol, session, sum(ret) OVER (PARTITION BY symbol ORDER BY session) AS cum FROM returns""") + """
SELECT symbol, session, exp(cum) AS equity, 1 - exp(cum - greatest(0, max(cum) OVER (PARTITION BY symbol ORDER BY session))) AS drawdown FROM c""",
       f8="equity drawdown", dt="session")
def e38(spark, sf):
    return equity_curve(returns(spark, sf), ["symbol"], ["session"], "ret", chunk=F.trunc("session", "year")).select(
        "symbol", "session", "equity", "drawdown")


@query("e39_lag1_benchmark", cte("returns") + """
SELECT symbol, session, sign(coalesce(lag(ret) OVER (PARTITION BY symbol ORDER BY session), 0)) * ret AS bench FROM returns""",
       f8="bench", dt="session", digits=9)
def e39(spark, sf):
    d = number_rows(returns(spark, sf), ["symbol"], ["session"], chunk=F.trunc("session", "year"))
    return feat.lag1_benchmark(d, "ret").select("symbol", "session", "bench")
