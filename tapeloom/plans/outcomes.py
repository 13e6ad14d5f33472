"""Labels (section L), splits (P) and ledger rules (R)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import clock
from tapeloom.operators import features as feat
from tapeloom.operators import labels, risk, splits, trend
from tapeloom.operators.scan import number_rows, stored
from tapeloom.plans.inputs import TRADE_KEY, ledger, numbered_bars, returns, stored_bars
from tapeloom.plans.registry import cte, query
from tapeloom.plans.windows import ATR_SQL, DONCHIAN, SWING_SQL, W, _win
from tapeloom.session import load

TK = ", ".join(TRADE_KEY)
YZ = f"""SELECT symbol, bar_ts, close, high, low, pos, CASE WHEN count(o1) OVER a = 20 THEN sqrt(greatest(0, var_samp(o1) OVER a
  + 0.34 / (1.34 + 21 / 19.0) * var_samp(c1) OVER a + (1 - 0.34 / (1.34 + 21 / 19.0)) * avg(rs) OVER a)) END AS v
FROM (SELECT symbol, bar_ts, close, high, low, row_number() OVER ({W}) - 1 AS pos, ln(open / lag(close) OVER ({W})) AS o1, ln(close / open) AS c1,
  ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM bars) WINDOW a AS {_win(20)}"""
TB_SQL = cte("bars", yz=YZ, hit=f"""
  SELECT e.symbol, e.bar_ts, e.v, max(f.bar_ts) AS last_ts, min(CASE WHEN f.high >= e.close * exp(0.5 * e.v) OR f.low <= e.close * exp(-0.5 * e.v) THEN f.bar_ts END) AS ht,
    arg_min(CASE WHEN f.high >= e.close * exp(0.5 * e.v) AND f.low <= e.close * exp(-0.5 * e.v) THEN 0 WHEN f.high >= e.close * exp(0.5 * e.v) THEN 1 ELSE -1 END, f.bar_ts)
      FILTER (WHERE f.high >= e.close * exp(0.5 * e.v) OR f.low <= e.close * exp(-0.5 * e.v)) AS lab
  FROM yz e LEFT JOIN bars f ON e.symbol = f.symbol AND f.bar_ts > e.bar_ts AND f.bar_ts <= e.bar_ts + INTERVAL 6 HOUR GROUP BY 1, 2, 3""") + """
SELECT symbol, bar_ts, CASE WHEN v > 0 THEN coalesce(lab, 0) ELSE 0 END AS label,
  CASE WHEN v > 0 THEN coalesce(ht, last_ts, bar_ts) ELSE bar_ts END AS horizon_end_ts,
  CASE WHEN v > 0 AND lab = 1 THEN 'pt' WHEN v > 0 AND lab = -1 THEN 'sl' ELSE 'vertical' END AS barrier_hit FROM hit"""


@query("l1_triple_barrier", TB_SQL, i8="label")
def l1(spark, sf):
    return labels.triple_barrier(numbered_bars(spark, sf), 0.5, 0.5, 360, 60, 20).select(
        "symbol", "bar_ts", "label", "horizon_end_ts", "barrier_hit")


@query("l1_triple_barrier_join", TB_SQL, i8="label")
def l1_join(spark, sf):
    return labels.triple_barrier_join(numbered_bars(spark, sf), 0.5, 0.5, 360, 360, 20)


@query("l2_label_horizon_bars", """
SELECT o_orderpriority, ceil(sum(o_orderkey % 97) / 60.0) AS bars FROM orders GROUP BY 1""", i8="bars")
def l2(spark, sf):
    return load(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.ceil(F.sum(F.col("o_orderkey") % 97) / 60.0).alias("bars"))


@query("l3_opening_range", cte("rets", d=f"""SELECT *, CAST(bar_ts AS DATE) AS session, hour(bar_ts) AS h, CASE WHEN count(r) OVER a >= 2 THEN stddev_samp(r) OVER a END AS sig
    FROM rets WINDOW a AS {_win(10)}""",
  s="""SELECT symbol, session, min(bar_ts) FILTER (WHERE h >= 10) AS et, arg_min(close, bar_ts) FILTER (WHERE h >= 10) AS ep,
    arg_min_null(sig, bar_ts) FILTER (WHERE h >= 10) AS sig, min(bar_ts) FILTER (WHERE h >= 15) AS st,
    coalesce(min(bar_ts) FILTER (WHERE h >= 20), max(bar_ts)) AS ct, min(bar_ts) AS ft FROM d GROUP BY 1, 2""",
  p="SELECT *, ep * exp(0.3 * sig * sqrt(10)) AS pt, ep * exp(-0.3 * sig * sqrt(10)) AS sl, et IS NOT NULL AND coalesce(sig > 0, false) AS ok FROM s",
  w="""SELECT p.symbol, p.session, d.bar_ts AS t, d.close AS c, CASE WHEN d.close >= p.pt THEN 'pt' WHEN d.close <= p.sl THEN 'sl' WHEN d.bar_ts = p.st THEN 'timestop' END AS why
    FROM p JOIN d USING (symbol, session) WHERE p.ok AND d.bar_ts > p.et AND d.bar_ts <= p.ct""",
  x="SELECT symbol, session, min(t) AS t, arg_min(c, t) AS c, arg_min(why, t) AS why FROM w WHERE why IS NOT NULL GROUP BY 1, 2",
  o="""SELECT p.*, x.t, x.why, coalesce(x.c, d.close) AS xp FROM p LEFT JOIN x USING (symbol, session) LEFT JOIN d ON d.symbol = p.symbol AND d.bar_ts = p.ct""") + """
SELECT symbol, session, CASE WHEN ok THEN et ELSE ft END AS entry_ts, CASE WHEN ok THEN ep END AS entry_price, CASE WHEN ok THEN sig * sqrt(252 * 24) END AS vol_at_entry,
  CASE WHEN ok THEN coalesce(t, ct) ELSE ft END AS exit_ts, CASE WHEN ok THEN xp END AS exit_price,
  CASE WHEN NOT ok THEN 'no_data' ELSE coalesce(why, 'hardclose') END AS exit_reason, CASE WHEN ok THEN ln(xp / ep) ELSE 0 END AS pnl_log FROM o""",
       f8="entry_price vol_at_entry exit_price pnl_log", dt="session")
def l3(spark, sf):
    return labels.opening_range(numbered_bars(spark, sf), F.to_date("bar_ts"), F.date_format("bar_ts", "HH:mm"),
                                "10:00", "15:00", "20:00", 10, 10, 0.3, 0.3, 24)


@query("l4_forward_return", cte("rets") + f"""
SELECT symbol, bar_ts, ln(lead(close, 5) OVER ({W}) / close) AS fwd_ret, coalesce(sign(ln(lead(close, 5) OVER ({W}) / close)), 0) AS fwd_sign FROM rets""",
       f8="fwd_ret", i8="fwd_sign")
def l4(spark, sf):
    return labels.forward_return(numbered_bars(spark, sf), 5).select("symbol", "bar_ts", "fwd_ret", "fwd_sign")


K5 = 5
L5_SQL = ATR_SQL + ", rets AS (SELECT * FROM tr)," + SWING_SQL + f""",
  s AS (SELECT st.*, atr.atr FROM st JOIN atr ON atr.symbol = st.symbol AND atr.pos = st.confirm_pos),
  fl AS (SELECT s.symbol, s.side, s.swing_pos, min(b.pos) AS fill_pos FROM s JOIN rets b ON b.symbol = s.symbol AND b.pos BETWEEN s.confirm_pos AND s.confirm_pos + {K5 - 1}
    AND CASE WHEN s.side = 1 THEN b.low <= s.limit_price ELSE b.high >= s.limit_price END GROUP BY 1, 2, 3),
  tg AS (SELECT s.*, fl.fill_pos, limit_price + s.side * 1.5 * atr AS tp, limit_price - s.side * 1.0 * atr AS sl FROM s LEFT JOIN fl USING (symbol, side, swing_pos)),
  ex AS (SELECT t.symbol, t.side, t.swing_pos, b.pos,
      CASE WHEN b.pos = t.fill_pos + {K5} THEN 'time_stop' WHEN CASE WHEN t.side = 1 THEN b.low <= sl ELSE b.high >= sl END THEN 'stop_loss'
        WHEN CASE WHEN t.side = 1 THEN b.high >= tp ELSE b.low <= tp END THEN 'profit_target' END AS why,
      CASE WHEN b.pos = t.fill_pos + {K5} THEN b.close WHEN CASE WHEN t.side = 1 THEN b.low <= sl ELSE b.high >= sl END THEN sl ELSE tp END AS px
    FROM tg t JOIN rets b ON b.symbol = t.symbol AND b.pos BETWEEN t.fill_pos + 1 AND t.fill_pos + {K5}),
  fx AS (SELECT symbol, side, swing_pos, min(pos) AS pos, arg_min(why, pos) AS why, arg_min(px, pos) AS px FROM ex WHERE why IS NOT NULL GROUP BY 1, 2, 3),
  en AS (SELECT symbol, max(pos) AS lp, arg_max(close, pos) AS lc FROM rets GROUP BY 1),
  o AS (SELECT t.*, coalesce(fx.pos, CASE WHEN fill_pos IS NOT NULL THEN lp END) AS exit_pos, coalesce(fx.px, CASE WHEN fill_pos IS NOT NULL THEN lc END) AS exit_price,
    CASE WHEN fill_pos IS NULL THEN 'never_filled' ELSE coalesce(fx.why, 'hard_close') END AS exit_reason
    FROM tg t LEFT JOIN fx USING (symbol, side, swing_pos) JOIN en USING (symbol))
SELECT symbol, side, swing_pos, confirm_pos, CAST(fill_pos AS DOUBLE) AS fill_pos, CAST(exit_pos AS DOUBLE) AS exit_pos, exit_price, exit_reason,
  CASE WHEN fill_pos IS NULL THEN 0 ELSE (exit_price - limit_price) * side END AS pnl,
  CASE WHEN fill_pos IS NULL THEN 0 ELSE (exit_price - limit_price) * side / atr END AS r_multiple FROM o"""


@query("l5_bracket_outcomes", L5_SQL, f8="fill_pos exit_pos exit_price pnl r_multiple", i8="side")
def l5(spark, sf):
    raw = stored_bars(spark, sf)
    b = trend.atr(raw, 14)
    at = b.filter(F.col("atr").isNotNull()).select("symbol", F.col("pos").alias("confirm_pos"), "atr")
    setups = stored(trend.pivot_setups(raw, 5).join(at, ["symbol", "confirm_pos"]))
    return labels.bracket_outcomes(setups, raw, K5, 1.5, 1.0, ["side", "swing_pos"])


@query("l6_breakout_outcomes", ATR_SQL + f""", ch AS (SELECT *, CASE WHEN count(*) OVER a = 20 THEN max(close) OVER a END AS upper,
    CASE WHEN count(*) OVER a = 20 THEN min(close) OVER a END AS lower FROM tr WINDOW a AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
  ev AS (SELECT ch.*, CASE WHEN close > upper THEN 1 WHEN close < lower THEN -1 ELSE 0 END AS event, CAST(bar_ts AS DATE) AS s,
    lead(open) OVER ({W}) AS eo, lead(CAST(bar_ts AS DATE)) OVER ({W}) AS ns FROM ch),
  en AS (SELECT ev.*, atr.atr, eo - event * 0.2 * atr.atr AS stop FROM ev JOIN atr ON ev.symbol = atr.symbol AND ev.pos = atr.pos WHERE event <> 0 AND eo IS NOT NULL),
  q AS (SELECT e.symbol, e.pos AS event_pos, b.pos, CASE
      WHEN CASE WHEN e.event = 1 THEN b.open < e.stop ELSE b.open > e.stop END THEN 'gap_through_stop'
      WHEN CASE WHEN e.event = 1 THEN b.low <= e.stop ELSE b.high >= e.stop END THEN 'stop_hit'
      WHEN b.event = -e.event THEN 'opposite_break' WHEN b.pos = e.pos + 13 THEN 'eod_flatten' WHEN b.ns IS NULL OR b.ns <> b.s THEN 'session_end' END AS why,
      CASE WHEN CASE WHEN e.event = 1 THEN b.open < e.stop ELSE b.open > e.stop END THEN b.open
      WHEN CASE WHEN e.event = 1 THEN b.low <= e.stop ELSE b.high >= e.stop END THEN e.stop ELSE b.close END AS px
    FROM en e JOIN ev b ON b.symbol = e.symbol AND b.pos BETWEEN e.pos + 1 AND e.pos + 13 AND b.s = e.ns),
  f AS (SELECT symbol, event_pos, min(pos) AS exit_pos, arg_min(px, pos) AS exit_price, arg_min(why, pos) AS exit_reason FROM q WHERE why IS NOT NULL GROUP BY 1, 2)
SELECT e.symbol, e.pos AS event_pos, e.event AS side, e.eo AS entry_price, exit_pos, exit_price, exit_reason, (exit_price - e.eo) * e.event / (0.2 * e.atr) AS r_multiple
FROM en e JOIN f ON f.symbol = e.symbol AND f.event_pos = e.pos""", f8="entry_price exit_price r_multiple", i8="side")
def l6(spark, sf):
    b = feat.donchian(trend.atr(numbered_bars(spark, sf), 14), 20)
    return labels.breakout_outcomes(stored(b), 0.2, 12, F.to_date("bar_ts"))


@query("l7_strategy_returns", cte("returns", d="SELECT *, lag(ret) OVER (PARTITION BY symbol ORDER BY session) AS yhat FROM returns",
  m="SELECT symbol, avg(ret) AS m FROM returns WHERE session < DATE '1998-01-01' GROUP BY 1") + """
SELECT symbol, session, CASE WHEN trades > 1 THEN coalesce(sign(yhat), 0) ELSE 0 END * ret - CASE WHEN trades > 1 THEN abs(coalesce(sign(yhat), 0)) ELSE 0 END * 0.0001 AS strategy,
  ret AS passive, sign(m) * ret AS train_mean FROM d JOIN m USING (symbol)""", f8="strategy passive train_mean", dt="session", digits=9)
def l7(spark, sf):
    # One row per session: a calendar bounds this window.
    w = Window.partitionBy("symbol").orderBy("session")
    d = returns(spark, sf).withColumn("yhat", F.lag("ret").over(w))
    return labels.strategy_returns(d, "yhat", "ret", F.col("session") < "1998-01-01", F.col("trades") > 1, 0.0001).select(
        "symbol", "session", "strategy", "passive", "train_mean")


OBS_SQL = """SELECT row_number() OVER (ORDER BY CAST(o_orderdate AS DATE)) - 1 AS idx, CAST(o_orderdate AS DATE) AS session,
  avg(o_totalprice) / 1000 AS y, count(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE)"""
# Session counts follow the calendar of the orders table.
WF = dict(train=500, test=100, step=100, horizon=5, embargo=10)
WF_SQL = """WITH obs AS (""" + OBS_SQL + """), n AS (SELECT count(*) AS n FROM obs),
  f AS (SELECT unnest(range(0, (n - 600) // 100 + 1)) AS fold_id, n FROM n),
  b AS (SELECT fold_id, n, fold_id * 100 AS lo, fold_id * 100 + 500 AS o, fold_id * 100 + 500 AS el, least(fold_id * 100 + 510, n) AS eh FROM f),
  seg AS (SELECT fold_id, 'train' AS role, lo, CASE WHEN fold_id > 0 AND el < eh THEN least(o - 5, el) ELSE o - 5 END AS hi FROM b
    UNION ALL SELECT fold_id, 'train', greatest(lo, eh), o - 5 FROM b WHERE fold_id > 0 AND el < eh
    UNION ALL SELECT fold_id, 'purge', o - 5, o FROM b UNION ALL SELECT fold_id, 'test', o, o + 100 FROM b
    UNION ALL SELECT fold_id, 'embargo', o + 100, least(o + 110, n) FROM b),
  sg AS (SELECT * FROM seg WHERE lo < hi),
  mem AS (SELECT s.fold_id, s.role, obs.* FROM sg s JOIN obs ON obs.idx >= s.lo AND obs.idx < s.hi)
"""


def sessions(spark, sf):
    """Numbered order days (one row per day)."""
    d = load(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("session")).agg(
        (F.avg("o_totalprice") / 1000).alias("y"), F.count(F.lit(1)).alias("n"))
    return number_rows(d, [], ["session"], chunk=F.trunc("session", "year"), pos="idx")


def stored_sessions(spark, sf):
    """Sessions as a stored frame: they are counted, and then joined."""
    return stored(sessions(spark, sf))


def wf_segments(spark, sf):
    return splits.walk_forward_split(spark, sessions(spark, sf).count(), **WF)


@query("p1_walk_forward_folds", WF_SQL + "SELECT * FROM sg", i8="fold_id lo hi")
def p1(spark, sf):
    return wf_segments(spark, sf)


@query("p1_walk_forward_members", WF_SQL + """
SELECT fold_id, role, count(*) AS days, sum(n) AS orders, avg(y) AS mean_y FROM mem GROUP BY 1, 2""", f8="mean_y", i8="orders")
def p1_members(spark, sf):
    return splits.members(sessions(spark, sf), wf_segments(spark, sf)).groupBy("fold_id", "role").agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("orders"), F.avg("y").alias("mean_y"))


BLOCK_SQL = """WITH obs AS (""" + OBS_SQL + """), n AS (SELECT count(*) AS n FROM obs),
  blk AS (SELECT k, n, k * (n // {k}) + least(k, n % {k}) AS lo, (k + 1) * (n // {k}) + least(k + 1, n % {k}) AS hi FROM n, range(0, {k}) AS t(k))"""


@query("p2_purged_kfold", BLOCK_SQL.format(k=5) + """
SELECT * FROM (SELECT k AS fold_id, 'test' AS role, lo, hi FROM blk UNION ALL SELECT k, 'train', 0, greatest(lo - 5, 0) FROM blk
  UNION ALL SELECT k, 'train', least(hi + 5 + 10, n), n FROM blk) WHERE lo < hi""", i8="fold_id lo hi")
def p2(spark, sf):
    return splits.purged_kfold_split(spark, sessions(spark, sf).count(), 5, 5, 10)


CPCV_SQL = BLOCK_SQL.format(k=6) + """,
  cb AS (SELECT row_number() OVER (ORDER BY a.k, b.k) - 1 AS fold_id, a.k AS a, b.k AS b FROM blk a JOIN blk b ON a.k < b.k),
  d AS (SELECT cb.fold_id, obs.idx, y, max((idx >= blk.lo AND idx < blk.hi)::INT) AS is_test,
      max((idx >= blk.lo - 5 AND idx < blk.hi + 15)::INT) AS banned FROM cb JOIN blk ON blk.k IN (cb.a, cb.b), obs GROUP BY 1, 2, 3)"""


@query("p3_cpcv_split", CPCV_SQL + """
SELECT fold_id, CASE WHEN is_test = 1 THEN 'test' ELSE 'train' END AS role, count(*) AS days, min(idx) AS first_idx, max(idx) AS last_idx, avg(y) AS mean_y
FROM d WHERE is_test = 1 OR banned = 0 GROUP BY 1, 2""", f8="mean_y")
def p3(spark, sf):
    obs = stored_sessions(spark, sf)
    seg = splits.cpcv_split(spark, obs.count(), 6, 2, 5, 10)
    return splits.members(obs, seg).groupBy("fold_id", "role").agg(
        F.count(F.lit(1)).alias("days"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.avg("y").alias("mean_y"))


@query("p4_calendar_split", """
SELECT CASE WHEN o_orderdate <= TIMESTAMP '1997-12-31' THEN 'train' WHEN o_orderdate <= TIMESTAMP '1998-12-31' THEN 'val' ELSE 'test' END AS part,
  count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1""", f8="total", digits=2)
def p4(spark, sf):
    d = load(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return splits.calendar_split(d, "day", "1997-12-31", "1998-12-31").groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("p4_session_folds", """WITH obs AS (""" + OBS_SQL + """), f AS (SELECT unnest(range(0, (count(*) - 252 - 1 - 60) // 60 + 1)) AS fold_id FROM obs),
  s AS (SELECT fold_id, 'train' AS role, fold_id * 60 AS lo, fold_id * 60 + 252 AS hi FROM f UNION ALL SELECT fold_id, 'test', fold_id * 60 + 253, fold_id * 60 + 313 FROM f)
SELECT fold_id, role, min(session) AS first_day, max(session) AS last_day, count(*) AS days FROM s JOIN obs ON idx >= lo AND idx < hi GROUP BY 1, 2""",
       dt="first_day last_day")
def p4_folds(spark, sf):
    obs = stored_sessions(spark, sf)
    return splits.members(obs, splits.session_folds(spark, obs.count(), 252, 60, 1)).groupBy("fold_id", "role").agg(
        F.min("session").alias("first_day"), F.max("session").alias("last_day"), F.count(F.lit(1)).alias("days"))


@query("p5_leak_checks", WF_SQL + """
SELECT fold_id, count(*) FILTER (WHERE idx + CASE WHEN idx % 7 = 0 THEN 12 ELSE 0 END >= fold_id * 100 + 500) AS leaks, count(*) AS n_train
FROM mem WHERE role = 'train' GROUP BY 1""")
def p5(spark, sf):
    at = F.col("idx") + F.when(F.col("idx") % 7 == 0, 12).otherwise(0)
    return splits.leak_counts(sessions(spark, sf), wf_segments(spark, sf), at)


@query("p6_fold_rollup", WF_SQL + """, h AS (SELECT fold_id, sha256(concat(count(*), '/', sum(n))) AS h FROM mem WHERE role = 'train' GROUP BY 1)
SELECT sha256(string_agg(concat(fold_id, ':', h, ';'), '' ORDER BY fold_id)) AS digest, count(*) AS folds FROM h""")
def p6(spark, sf):
    f = splits.members(sessions(spark, sf), wf_segments(spark, sf)).filter("role = 'train'").groupBy("fold_id").agg(
        F.sha2(F.concat_ws("/", F.count(F.lit(1)), F.sum("n")), 256).alias("h"))
    return splits.roll_up_hashes(f, F.col("h"))


@query("p7_fold_fit_predict", WF_SQL + """, fit AS (SELECT fold_id, regr_slope(y, idx) AS slope, regr_intercept(y, idx) AS ic, count(*) AS n_train FROM mem WHERE role = 'train' GROUP BY 1)
SELECT fold_id, n_train, slope, avg(pow(y - ic - slope * idx, 2)) AS mse, count(*) AS n_test FROM mem JOIN fit USING (fold_id) WHERE role = 'test' GROUP BY 1, 2, 3""",
       f8="slope mse")
def p7(spark, sf):
    d = splits.fit_predict_linear(sessions(spark, sf).withColumn("x", F.col("idx").cast("double")), wf_segments(spark, sf), "x", "y")
    return d.groupBy("fold_id", "n_train", "slope").agg(
        F.avg(F.pow(F.col("y") - F.col("yhat"), 2)).alias("mse"), F.count(F.lit(1)).alias("n_test"))


TRADE_SQL = cte("ledger", tr="""SELECT *, CASE k2 % 3 WHEN 0 THEN 'stop_hit' WHEN 1 THEN 'gap_through_stop' ELSE 'eod_flatten' END AS exit_reason,
  k3 % 3 - 1 AS trend_sign, price AS fill_price, price * (1 + (k4 % 5 - 2) / 100.0::DOUBLE) AS bar_open, price * 0.02 AS atr FROM ledger""")


def trades(spark, sf):
    return _traded(ledger(spark, sf))


def _traded(t):
    why = F.when(F.col("k2") % 3 == 0, "stop_hit").when(F.col("k2") % 3 == 1, "gap_through_stop").otherwise("eod_flatten")
    return t.withColumns({
        "exit_reason": why, "trend_sign": F.col("k3") % 3 - 1, "fill_price": F.col("price"),
        "bar_open": F.col("price") * (1 + (F.col("k4") % 5 - 2) / F.lit(100.0)), "atr": F.col("price") * 0.02})


ORDER = ["entry_ts", *TRADE_KEY]


def _stored_trades(spark, sf):
    """The trades from a stored ledger, which holds nothing that its other columns give."""
    t = stored(ledger(spark, sf).drop("price", "ret"))
    return _traded(t.withColumn("price", F.col("k5") / F.col("size")))


def _narrow(t, *more):
    """What an ordered scan of trades needs: every column that it carries is sorted and stored."""
    return t.select(*ORDER, *more)


def _losses(t):
    return _narrow(t, "session", F.round("pnl").alias("pnl"))


RULE_SQL = {
    "stop": "SELECT {k} FROM tr WHERE (exit_reason = 'stop_hit' AND r_multiple < -1.05) OR (exit_reason = 'gap_through_stop' AND r_multiple < -3)",
    "time_stop": "SELECT {k} FROM tr WHERE r_multiple < 0 AND exit_ts - entry_ts > INTERVAL 241 MINUTE",
    "overlap": f"SELECT {{k}} FROM tr QUALIFY entry_ts < lag(exit_ts) OVER (PARTITION BY symbol ORDER BY entry_ts, {TK})",
    "same_side": f"""SELECT {{k}} FROM tr QUALIFY max(exit_ts) OVER (PARTITION BY symbol, side ORDER BY entry_ts, {TK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > entry_ts""",
    "size_cap": "SELECT {k} FROM tr WHERE size > 48",
    "adverse": "SELECT {k} FROM tr WHERE trend_sign * side <= 0 AND (fill_price - bar_open) * side / atr < -0.5",
}


def _loss_sql(period, threshold):
    return f"""SELECT {{k}} FROM (SELECT *, sum(x) OVER (ORDER BY entry_ts, {TK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
      sum(x) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(x) OVER (PARTITION BY p) AS e FROM (SELECT *, round(pnl) AS x, {period} AS p FROM tr))
    WHERE coalesce(b, 0) - e < {threshold} * (100000 + e)"""


RULE_SQL |= {"daily_breaker": _loss_sql("session", -0.02), "weekly_breaker": _loss_sql("isoyear(session) * 100 + week(session)", -0.05)}


def rules(t):
    return {
        "stop": risk.stop_breaches(t),
        "time_stop": risk.time_stop_breaches(t, 240),
        "overlap": _adjacent(t),
        "same_side": _same_side(t),
        "size_cap": t.filter("size > 48"),
        "adverse": risk.adverse_entries(t),
    } | {f"{k}_breaker": v for k, v in risk.circuit_breakers(_losses(t), {
        "daily": (F.col("session"), -0.02), "weekly": (clock.iso_week_id("session"), -0.05)}, ORDER, 100_000.0).items()}


def _adjacent(t):
    from tapeloom.operators.joins import overlapping_adjacent

    return overlapping_adjacent(number_rows(_narrow(t, "symbol", "exit_ts"), ["symbol"], ORDER), ["symbol"])


def _same_side(t):
    return risk.same_side_overlaps(_narrow(t, "symbol", "side", "exit_ts"), ORDER)


def _keys(df):
    return df.select(*TRADE_KEY)


@query("r1_trade_stop", TRADE_SQL + RULE_SQL["stop"].format(k=TK))
def r1(spark, sf):
    return _keys(risk.stop_breaches(trades(spark, sf)))


@query("r2_time_stop", TRADE_SQL + RULE_SQL["time_stop"].format(k=TK))
def r2(spark, sf):
    return _keys(risk.time_stop_breaches(trades(spark, sf), 240))


@query("r3_overlap_adjacent", TRADE_SQL + RULE_SQL["overlap"].format(k=TK))
def r3(spark, sf):
    return _keys(_adjacent(trades(spark, sf)))


@query("r3_overlap_same_side", TRADE_SQL + RULE_SQL["same_side"].format(k=TK))
def r3_side(spark, sf):
    return _keys(_same_side(trades(spark, sf)))


@query("r4_static_position_cap", TRADE_SQL + RULE_SQL["size_cap"].format(k=TK))
def r4_static(spark, sf):
    return _keys(trades(spark, sf).filter("size > 48"))


def _inv_sql(key, amount, cap):
    return TRADE_SQL + f""", ev AS (SELECT {key} AS g, {TK}, entry_ts AS t, 1 AS k, {amount} AS d FROM tr UNION ALL SELECT {key}, {TK}, exit_ts, 0, -({amount}) FROM tr),
  run AS (SELECT *, sum(d) OVER (PARTITION BY g ORDER BY t, k, {TK} ROWS UNBOUNDED PRECEDING) AS open_amount FROM ev)
SELECT g, {TK}, open_amount FROM run WHERE k = 1 AND open_amount > {cap}"""


@query("r4_concurrent_position_cap", _inv_sql("symbol", "size", 200), f8="open_amount")
def r4(spark, sf):
    return risk.inventory_breaches(trades(spark, sf), ["symbol"], F.col("size"), F.lit(200.0), TRADE_KEY).withColumnRenamed("symbol", "g")


@query("r5_group_notional_cap", _inv_sql("substr(symbol, 1, 1)", "round(size * price)", 500000), f8="open_amount", digits=2)
def r5(spark, sf):
    t = trades(spark, sf).withColumn("g", F.substring("symbol", 1, 1))
    return risk.inventory_breaches(t, ["g"], F.round(F.col("size") * F.col("price")), F.lit(500000.0), TRADE_KEY)


def _breaker_sql(period, thr):
    return TRADE_SQL + f""", p AS (SELECT {TK}, {period} AS p, round(pnl) AS x, sum(round(pnl)) OVER (ORDER BY entry_ts, {TK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM tr),
  o AS (SELECT p, sum(sum(x)) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM p GROUP BY 1)
SELECT {TK} FROM p JOIN o USING (p) WHERE coalesce(b, 0) - coalesce(e, 0) < {thr} * (100000 + coalesce(e, 0))"""


@query("r6_daily_breaker", _breaker_sql("session", -0.02))
def r6(spark, sf):
    return _keys(risk.circuit_breaker(_losses(trades(spark, sf)), F.col("session"), ORDER, -0.02, 100_000.0))


@query("r6_weekly_breaker", _breaker_sql("isoyear(session) * 100 + week(session)", -0.05))
def r6_week(spark, sf):
    return _keys(risk.circuit_breaker(_losses(trades(spark, sf)), clock.iso_week_id("session"), ORDER, -0.05, 100_000.0))


@query("r7_adverse_entries", TRADE_SQL + RULE_SQL["adverse"].format(k=TK))
def r7(spark, sf):
    return _keys(risk.adverse_entries(trades(spark, sf)))


@query("r8_correlated_universe", cte("ledger") + """
SELECT f AS "full", m AS micro FROM (VALUES ('AF', 'AO'), ('NF', 'XX'), ('RF', 'RO')) AS t(f, m)
WHERE f IN (SELECT symbol FROM ledger) AND m IN (SELECT symbol FROM ledger)""")
def r8(spark, sf):
    pairs = spark.createDataFrame([("AF", "AO"), ("NF", "XX"), ("RF", "RO")], "full string, micro string")
    return risk.correlated_pairs(ledger(spark, sf).select("symbol"), pairs)


@query("r9_rule_report", TRADE_SQL + ", n AS (SELECT count(*) AS n_checked FROM tr) " + " UNION ALL ".join(
    f"SELECT '{r}' AS rule, (SELECT count(*) FROM ({s.format(k='k1')})) AS n_violations, n_checked, (SELECT count(*) FROM ({s.format(k='k1')})) = 0 AS passed FROM n"
    for r, s in RULE_SQL.items()))
def r9(spark, sf):
    t = _stored_trades(spark, sf)
    return risk.rule_report(t, rules(t))


@query("r9_rule_violations", TRADE_SQL + " UNION ALL ".join(f"SELECT '{r}' AS rule, {TK} FROM ({s.format(k=TK)})" for r, s in RULE_SQL.items()))
def r9_rows(spark, sf):
    return risk.rule_violations(rules(_stored_trades(spark, sf)), TRADE_KEY)
