"""Streams (section W); the SQL is the batch twin cut at the final watermark."""

from dataclasses import replace

from pyspark.sql import functions as F

from tapeloom.functions import clock
from tapeloom.operators.features import with_log_return
from tapeloom.operators.scan import stored
from tapeloom.plans.inputs import TRADE_KEY, ledger, numbered_bars, returns
from tapeloom.plans.registry import cte, query
from tapeloom.plans.windows import TOUCH_SQL
from tapeloom.session import load
from tapeloom.streaming import streams as st
from tapeloom.streaming.state import Detector, Limits, StepUp

TK = ", ".join(TRADE_KEY)


def _ticks(e):
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("seq"),
                    F.get_json_object("props", "$.k").cast("long").alias("size"), "user_id")


@query("w1_stream_bars", cte("bars") + """
SELECT * FROM bars WHERE bar_ts <= (SELECT max(ts) - INTERVAL 1 MICROSECOND - INTERVAL 1 HOUR FROM ticks)""", f8="open high low close", i8="volume n")
def w1(spark, sf):
    return st.stream_table(spark, sf, "events", lambda e: st.stream_bars(_ticks(e)), "bars")


@query("w2_stream_sliding_variance", cte("rets", p="SELECT symbol, bar_ts, r * r AS r2 FROM rets WHERE r IS NOT NULL",
  k="SELECT symbol, r2, unnest(range(date_trunc('hour', bar_ts) + INTERVAL 1 HOUR, date_trunc('hour', bar_ts) + INTERVAL 7 HOUR, INTERVAL 1 HOUR)) AS end_ts FROM p") + """
SELECT symbol, end_ts, sum(r2) AS rv, count(*) AS n FROM k WHERE end_ts <= (SELECT max(bar_ts) - INTERVAL 2 HOUR FROM p) GROUP BY 1, 2""", f8="rv")
def w2(spark, sf):
    r2 = with_log_return(numbered_bars(spark, sf)).filter(F.col("r").isNotNull()).select(
        "symbol", "bar_ts", (F.col("r") * F.col("r")).alias("r2"))
    # A week arrives at a time, so windows close as the watermark moves.
    weeks = st.frame_stream(r2, "r2", ["symbol"], F.date_trunc("week", "bar_ts"))
    return st.run_to_table(st.stream_sliding_variance(weeks, "6 hours", "1 hour", "2 hours"), "sliding")


@query("w3_stream_gap_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
  a AS (SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 3 HOUR AS end_ts, count(*) AS n FROM s GROUP BY user_id, k)
SELECT * FROM a WHERE end_ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def w3(spark, sf):
    return st.stream_table(spark, sf, "events", lambda e: st.stream_gap_sessions(e, ["user_id"], "3 hours", "1 hour"), "sessions")


@query("w4_stream_distinct", "SELECT DISTINCT event_type, ts FROM events")
def w4(spark, sf):
    return st.stream_table(spark, sf, "events", lambda e: st.stream_distinct(e, ["event_type", "ts"], "1 day"), "distinct")


@query("w5_stream_static_windows", """
WITH l AS (SELECT event_id, ts FROM events WHERE event_type <> 'signup'), r AS (SELECT event_id AS release_id, ts AS rts FROM events WHERE event_type = 'signup'),
  b AS (SELECT l.*, release_id AS b_id, rts AS b_ts FROM l ASOF LEFT JOIN r ON l.ts >= r.rts), f AS (SELECT b.*, release_id AS f_id, rts AS f_ts FROM b ASOF LEFT JOIN r ON b.ts <= r.rts),
  d AS (SELECT *, epoch_us(ts) - epoch_us(b_ts) AS db, epoch_us(f_ts) - epoch_us(ts) AS df FROM f),
  n AS (SELECT event_id, CASE WHEN df IS NULL OR db <= df THEN b_id ELSE f_id END AS release_id, least(db, df) AS distance_us FROM d WHERE least(db, df) <= 900000000)
SELECT n.*, (SELECT count(*) FROM r WHERE rts BETWEEN l.ts - INTERVAL 15 MINUTE AND l.ts + INTERVAL 15 MINUTE) AS n_releases FROM n JOIN l USING (event_id)""")
def w5(spark, sf):
    """Ticks of a stream near a release: the nearest one, its distance and the number of releases around."""
    rel = load(spark, sf, "events").filter("event_type = 'signup'").select(
        F.col("event_id").alias("release_id"), F.col("ts").alias("release_ts"))
    ticks = st.table_stream(spark, sf, "events").filter("event_type <> 'signup'").select("event_id", "ts")
    return st.run_each_batch(ticks, "windows", st.nearest_releases(ticks, rel, 15))


@query("w5_stream_interval_join", """
SELECT t.event_id, r.event_id AS release_id FROM events t JOIN events r ON r.event_type = 'signup' AND t.event_type <> 'signup' AND t.user_id = r.user_id
  AND t.ts BETWEEN r.ts - INTERVAL 60 MINUTE AND r.ts + INTERVAL 60 MINUTE""")
def w5_streams(spark, sf):
    def build(e):
        left = e.filter("event_type <> 'signup'").select("event_id", "user_id", "ts")
        right = st.table_stream(spark, sf, "events").filter("event_type = 'signup'").select(
            "user_id", F.col("event_id").alias("release_id"), F.col("ts").alias("release_ts"))
        return st.stream_interval_join(left, right, "user_id", 60, "2 hours").select("event_id", "release_id")
    return st.stream_table(spark, sf, "events", build, "interval")


DECAY = Detector(hazard=1 / 60, window=30, threshold=0.5, min_pause=10, kappa0=1.0, alpha0=2.0, beta0=1e-4)
BY_HAND = replace(DECAY, re_entry="manual")
STEPS = StepUp(detector=Detector(hazard=0.01, window=60, threshold=0.5))


def evidence_sql(x, cfg):
    """Expression over r (list of structs p, m, b by run length): log joint j of each run length with ``x``."""
    k, df = f"({cfg.kappa0} + i - 1)", f"({2 * cfg.alpha0} + i - 1)"
    s2 = f"(e.b * ({k} + 1) / ({df} / 2 * {k}))"
    return (f"list_transform(r, lambda e, i: {{'j': e.p + lgamma(({df} + 1) / 2::DOUBLE) - lgamma({df} / 2::DOUBLE) - 0.5 * ln({df} * pi() * {s2})"
            f" - ({df} + 1) / 2 * ln(1 + pow({x} - e.m, 2) / ({df} * {s2})), 'm': e.m, 'b': e.b}})")


def grown_sql(x, cfg):
    """The run lengths after ``x``: a new one, and each of j grown; t is the log of the sum of the joints."""
    k = f"({cfg.kappa0} + i - 1)"
    return (f"list_prepend({{'p': ln({cfg.hazard!r}::DOUBLE), 'm': {cfg.mu0}::DOUBLE, 'b': {cfg.beta0!r}::DOUBLE}}, list_transform(j, lambda e, i: "
            f"{{'p': e.j - t + ln(1 - {cfg.hazard!r}::DOUBLE), 'm': ({k} * e.m + {x}) / ({k} + 1), 'b': e.b + {k} * pow({x} - e.m, 2) / (2 * ({k} + 1))}}))")


def first_sql(cfg):
    return f"[{{'p': 0.0::DOUBLE, 'm': {cfg.mu0}::DOUBLE, 'b': {cfg.beta0!r}::DOUBLE}}]"


# The log of the sum of joints over rows (..., j).
TOP = "SELECT *, list_max(list_transform(j, lambda e: e.j)) AS top"
LOG_SUM = "top + ln(list_sum(list_transform(j, lambda e: exp(e.j - top))))"


def mass_sql(cfg):
    return f"list_sum(list_transform(g[1:{cfg.warm_up}], lambda e: exp(e.p)))"


def series_sql(src, x, cfg):
    """CTE fragments: ds holds (symbol, n, mass), the detector over ``src`` (symbol, n, ``x``) without pauses."""
    return f"""
  rs(symbol, n, r, mass) AS (SELECT DISTINCT symbol, 0::BIGINT, {first_sql(cfg)}, 0.0::DOUBLE FROM {src}
    UNION ALL SELECT symbol, n, g, {mass_sql(cfg)} FROM (SELECT symbol, n, {grown_sql('x', cfg)} AS g FROM (SELECT *, {LOG_SUM} AS t FROM ({TOP} FROM (
      SELECT rs.symbol, s.n, s.{x} AS x, {evidence_sql('s.' + x, cfg)} AS j FROM rs JOIN {src} s ON s.symbol = rs.symbol AND s.n = rs.n + 1))))),
  ds AS (SELECT symbol, n, mass FROM rs WHERE n > 0)"""


def pause_sql(cfg):
    """CTE fragments: signals holds one row per session (and one per order), the pause rule over num and orders."""
    done = {"posterior": f"mass < {cfg.re_entry_threshold}", "count": f"since + 1 >= {cfg.re_entry_count}", "manual": "false"}[cfg.re_entry]
    obeyed = "paused2 AND since2 >= " + str(cfg.min_pause) if cfg.re_entry == "manual" else "false"
    return f"""
  ps(symbol, n, session, r, paused, since, entered, entered_p, mass, event, was, was_p, duration, told, held, obeyed, long) AS (
    SELECT DISTINCT symbol, 0::BIGINT, NULL::DATE, {first_sql(cfg)}, false, 0::BIGINT, NULL::DATE, NULL::DOUBLE, 0.0::DOUBLE, '', NULL::DATE, NULL::DOUBLE,
      NULL::BIGINT, false, false, false, 0::BIGINT FROM num
    UNION ALL SELECT symbol, n, session, CASE WHEN leaves OR hand THEN {first_sql(cfg)} ELSE g END, paused2 AND NOT hand, CASE WHEN hand THEN 0 ELSE since2 END,
      CASE WHEN hand OR leaves THEN NULL ELSE entered2 END, CASE WHEN hand OR leaves THEN NULL ELSE entered_p2 END, mass,
      CASE WHEN enters THEN 'pause' WHEN leaves AND paused THEN 'resume' ELSE '' END, entered2, entered_p2,
      CASE WHEN leaves AND paused THEN since + 1 END, told, paused2, hand, since2
    FROM (SELECT *, told AND {obeyed} AS hand FROM (SELECT *, CASE WHEN enters THEN true WHEN leaves THEN false ELSE paused END AS paused2,
        CASE WHEN enters OR leaves THEN 0 WHEN NOT paused AND n >= {cfg.window // 2} THEN since ELSE since + 1 END AS since2,
        CASE WHEN enters THEN session ELSE entered END AS entered2, CASE WHEN enters THEN mass ELSE entered_p END AS entered_p2
      FROM (SELECT *, NOT paused AND n >= {cfg.window // 2} AND mass > {cfg.threshold} AS enters,
          (paused OR n < {cfg.window // 2}) AND since + 1 >= {cfg.min_pause} AND {done} AS leaves
        FROM (SELECT *, {mass_sql(cfg)} AS mass FROM (SELECT * EXCLUDE (j), {grown_sql('x', cfg)} AS g FROM (SELECT *, {LOG_SUM} AS t FROM ({TOP} FROM (
          SELECT ps.symbol, s.n, s.session, s.ret AS x, s.told, ps.paused, ps.since, ps.entered, ps.entered_p, {evidence_sql('s.ret', cfg)} AS j
          FROM ps JOIN num s ON s.symbol = ps.symbol AND s.n = ps.n + 1))))))))),
  signals AS (SELECT symbol, session, mass AS posterior, held AS paused, event, was AS entered, was_p AS entered_posterior, duration FROM ps WHERE n > 0
    UNION ALL SELECT symbol, session, mass, held AND NOT obeyed, CASE WHEN obeyed THEN 'manual' ELSE 'refused' END, was, was_p,
      CASE WHEN obeyed THEN long END FROM ps WHERE n > 0 AND told)"""


# An order to resume comes on the 15th of every month that has a session.
TOLD = {True: "day(session) = 15", False: "false"}


def once(sql, *names):
    """Have DuckDB compute these fragments once, not in every round of a recursion."""
    for n in names:
        sql = sql.replace(f"{n} AS (", f"{n} AS MATERIALIZED (")
    return sql


def signals_sql(cfg, told=False):
    return once(cte("returns", num=f"""SELECT symbol, session, ret, row_number() OVER (PARTITION BY symbol ORDER BY session) AS n,
  {TOLD[told]} AS told FROM returns"""), "num") + "," + pause_sql(cfg)


def session_returns(spark, sf):
    return returns(spark, sf).select("symbol", "session", "ret")


def by_year(df, name):
    """A session frame as a stream of years."""
    return st.frame_stream(df, name, ["symbol"], F.year("session"))


def orders_of(r):
    return r.filter(F.dayofmonth("session") == 15).select("symbol", "session")


SIGNALS = "SELECT * FROM signals"
DECAY_F8 = "posterior entered_posterior duration"


@query("w6_stream_decay", signals_sql(DECAY) + SIGNALS, f8=DECAY_F8, dt="session entered", digits=5)
def w6(spark, sf):
    """Pause and resume signals of the decay detector on session returns."""
    return st.run_to_table(st.stream_decay(by_year(session_returns(spark, sf), "returns"), DECAY), "decay")


@query("w6_batch_decay", signals_sql(DECAY) + SIGNALS, f8=DECAY_F8, dt="session entered", digits=5)
def w6_batch(spark, sf):
    return st.batch_decay(session_returns(spark, sf), DECAY)


@query("w6_stream_manual_resume", signals_sql(BY_HAND, True) + SIGNALS, f8=DECAY_F8, dt="session entered", digits=5)
def w6_manual(spark, sf):
    """Signals where only a second stream of operators' orders ends a pause; the orders come first and wait for their sessions."""
    r = stored(session_returns(spark, sf))
    return st.run_to_table(st.stream_decay(by_year(r, "returns"), BY_HAND, st.frame_stream(orders_of(r), "orders")), "by-hand")


@query("w6_pause_log", signals_sql(BY_HAND, True) + """
SELECT symbol, entered, entered_posterior, session AS exited, posterior AS exited_posterior, duration, event AS ended_by FROM signals WHERE duration IS NOT NULL""",
       f8="entered_posterior exited_posterior", dt="entered exited", digits=5)
def w6_log(spark, sf):
    r = stored(session_returns(spark, sf))
    return st.pause_log(st.batch_decay(r, BY_HAND, orders_of(r)))


@query("w6_pause_summary", signals_sql(DECAY) + """
SELECT symbol, count(duration) AS pauses, coalesce(sum(duration), 0) AS paused_sessions, coalesce(max(duration), 0) AS longest,
  count(*) FILTER (WHERE event = 'pause') > count(duration) AS paused_at_end, count(*) FILTER (WHERE event = 'refused') AS refused FROM signals GROUP BY 1""",
       i8="paused_sessions")
def w6_summary(spark, sf):
    return st.pause_summary(st.batch_decay(session_returns(spark, sf), DECAY))


NUM_SQL = once(cte("returns", num="SELECT symbol, session, ret, row_number() OVER (PARTITION BY symbol ORDER BY session) AS n FROM returns"), "num")


@query("w6_decay_summary", NUM_SQL + "," + series_sql("num", "ret", DECAY) + f""",
  z AS (SELECT symbol, n, session, CASE WHEN n <= {DECAY.window // 2} THEN 0 ELSE mass END AS p FROM ds JOIN num USING (symbol, n))
SELECT symbol, max(p) > {DECAY.threshold} AS decayed, min(session) FILTER (WHERE p > {DECAY.threshold}) AS first_session,
  min(n) FILTER (WHERE p > {DECAY.threshold}) AS first_n, max(p) AS max_posterior FROM z GROUP BY 1""", f8="first_n max_posterior", dt="first_session", digits=5)
def w6_series(spark, sf):
    """Whether, when and how surely each whole series changes, warm-up apart."""
    return st.decay_summary(st.decay_series(session_returns(spark, sf), DECAY))


@query("w7_stream_breakers", cte("ledger", t=f"""SELECT *, isoyear(session) * 100 + week(session) AS week, round(pnl) AS x,
    row_number() OVER (PARTITION BY symbol ORDER BY entry_ts, {TK}) AS n FROM ledger""",
  c="SELECT *, coalesce(sum(x) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM t",
  q="""SELECT *, first_value(cum) OVER (PARTITION BY symbol, session ORDER BY n) AS ds, first_value(cum) OVER (PARTITION BY symbol, week ORDER BY n) AS ws FROM c""") + f"""
SELECT symbol AS account, {TK}, CASE WHEN size > 45 THEN 'size_cap' WHEN cum - ds < -0.01 * (100000 + ds) THEN 'daily' WHEN cum - ws < -0.02 * (100000 + ws) THEN 'weekly' ELSE '' END AS reason FROM q""")
def w7(spark, sf):
    t = ledger(spark, sf).select(F.col("symbol").alias("account"), "entry_ts", *TRADE_KEY, "session",
                                 clock.iso_week_id("session").alias("week"), F.round("pnl").alias("pnl"), "size")
    s = st.stream_breakers(st.frame_stream(t, "trades", ["account"], F.year("session"), F.to_date("entry_ts")), ["entry_ts", *TRADE_KEY], 100_000.0, -0.01, -0.02, 45.0)
    return st.run_to_table(s, "breakers", states=st.ARRIVAL_PARTS).drop("entry_ts")


LIMITS = Limits(start=20_000.0, caps=(("AF", 45.0), ("RF", 40.0)), cap=48.0)
# One round of the recursion is one entry of every account: what has ended by then is realised, then the rules are asked in order.
GUARD_SQL = once(cte("ledger", num=f"""SELECT CAST(k4 % 50 AS BIGINT) AS account, symbol, {TK}, size, round(pnl) AS x, entry_ts, exit_ts, session AS es, isoyear(session) * 100 + week(session) AS ew,
    CAST(exit_ts AS DATE) AS xs, isoyear(CAST(exit_ts AS DATE)) * 100 + week(CAST(exit_ts AS DATE)) AS xw,
    row_number() OVER (PARTITION BY k4 % 50 ORDER BY entry_ts, {TK}) AS n FROM ledger"""), "num") + f""",
  gd(account, n, o, eq, es, e0, ep, ew, w0, wp, {TK}, reason) AS (
    SELECT DISTINCT account, 0::BIGINT, [{{'t': NULL::TIMESTAMP, 'y': '', 'x': 0::DOUBLE, 's': NULL::DATE, 'w': 0::BIGINT}}][1:0], {LIMITS.start}::DOUBLE, NULL::DATE, 0::DOUBLE, 0::DOUBLE, -1::BIGINT, 0::DOUBLE, 0::DOUBLE,
      {", ".join(f"any_value({k}) OVER ()" for k in TRADE_KEY)}, '' FROM num
    UNION ALL SELECT account, n, CASE WHEN reason = '' THEN list_append(o, {{'t': exit_ts, 'y': symbol, 'x': x, 's': xs, 'w': xw}}) ELSE o END, eq, es, e0, ep, ew, w0, wp, {TK}, reason
    FROM (SELECT *, CASE WHEN len(list_filter(o, lambda p: p.y = symbol)) > 0 THEN 'open' WHEN size > CASE symbol WHEN 'AF' THEN 45 WHEN 'RF' THEN 40 ELSE 48 END THEN 'cap'
        WHEN ep < {LIMITS.daily} * e0 THEN 'daily' WHEN wp < {LIMITS.weekly} * w0 THEN 'weekly' ELSE '' END AS reason
      FROM (SELECT account, n, {TK}, symbol, size, x, exit_ts, xs, xw, list_filter(o, lambda p: p.t > entry_ts) AS o, eq + coalesce(list_sum(list_transform(c, lambda p: p.x)), 0) AS eq, es, ew,
          CASE WHEN es = es_ THEN e0 ELSE eq + coalesce(list_sum(list_transform(list_filter(c, lambda p: p.s < es), lambda p: p.x)), 0) END AS e0,
          CASE WHEN es = es_ THEN ep ELSE 0 END + coalesce(list_sum(list_transform(list_filter(c, lambda p: p.s = es), lambda p: p.x)), 0) AS ep,
          CASE WHEN ew = ew_ THEN w0 ELSE eq + coalesce(list_sum(list_transform(list_filter(c, lambda p: p.w < ew), lambda p: p.x)), 0) END AS w0,
          CASE WHEN ew = ew_ THEN wp ELSE 0 END + coalesce(list_sum(list_transform(list_filter(c, lambda p: p.w = ew), lambda p: p.x)), 0) AS wp
        FROM (SELECT t.*, g.o, g.eq, g.e0, g.ep, g.w0, g.wp, g.es AS es_, g.ew AS ew_, list_filter(g.o, lambda p: p.t <= t.entry_ts) AS c
          FROM gd g JOIN num t ON t.account = g.account AND t.n = g.n + 1)))),
  guarded AS (SELECT account, {TK}, reason FROM gd WHERE n > 0)
"""


def guarded_trades(spark, sf):
    gone = F.to_date("exit_ts")
    return ledger(spark, sf).select(
        (F.col("k4") % 50).cast("long").alias("account"), "symbol", "entry_ts", "exit_ts", *TRADE_KEY, "session", clock.iso_week_id("session").alias("week"),
        gone.alias("exit_session"), clock.iso_week_id(gone).alias("exit_week"), F.round("pnl").alias("pnl"), "size")


@query("w7_stream_guard", GUARD_SQL + "SELECT * FROM guarded")
def w7_guard(spark, sf):
    """Entries of every account with the first rule that blocks them, from a stream of years."""
    t, order = guarded_trades(spark, sf), ["entry_ts", *TRADE_KEY]
    packs = st.frame_stream(t, "guard", ["account"], F.year("session"), F.to_date("entry_ts"), pack=lambda d: st.guard_packs(d, order))
    s = st.stream_guard(t, order, LIMITS, packs)
    return st.run_to_table(s, "guarded", states=st.ARRIVAL_PARTS)


@query("w7_trigger_counts", GUARD_SQL + """SELECT account, count(*) FILTER (WHERE reason = '') AS entered, count(*) FILTER (WHERE reason = 'open') AS n_open,
  count(*) FILTER (WHERE reason = 'cap') AS n_cap, count(*) FILTER (WHERE reason = 'daily') AS n_daily, count(*) FILTER (WHERE reason = 'weekly') AS n_weekly,
  bool_or(reason <> '') AS active FROM guarded GROUP BY 1""")
def w7_counts(spark, sf):
    return st.trigger_counts(st.batch_guard(guarded_trades(spark, sf), ["entry_ts", *TRADE_KEY], LIMITS), LIMITS)


@query("w8_stream_levels", f"""
WITH t AS (SELECT *, count(*) FILTER (WHERE kind = 'penetrate') OVER (PARTITION BY level, fold ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dead FROM ({TOUCH_SQL})),
k AS (SELECT *, dead > 0 AND kind = 'reject' AS error, dead > 0 OR kind = 'penetrate' AS killed FROM t),
r AS (SELECT *, count(*) FILTER (WHERE kind = 'reject' AND NOT error) OVER (PARTITION BY level, fold ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS rejections FROM k)
SELECT level, fold, event_id, rejections, killed, error, NOT killed AND rejections <= 3 AS permitted FROM r""")
def w8(spark, sf):
    def build(e):
        t = e.select(F.col("user_id").alias("level"), F.col("event_type").alias("fold"), "event_id", "ts",
                     F.when(F.col("value") > 150, "penetrate").otherwise("reject").alias("kind"))
        return st.stream_levels(t, 3)
    return st.stream_table(spark, sf, "events", build, "levels")


_D = STEPS.detector
LADDER_SQL = once(cte("returns", num=f"""SELECT symbol, session, row_number() OVER w AS k, avg(ln(1 + ret)) OVER (w ROWS {STEPS.mppm_window - 1} PRECEDING) * 252 AS v,
    min(ret) OVER (w ROWS {STEPS.mppm_window - 1} PRECEDING) AS least FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY session)""",
  path=f"SELECT symbol, k, v, row_number() OVER (PARTITION BY symbol ORDER BY k) AS n FROM num WHERE k >= {STEPS.mppm_window} AND least > -1"), "num", "path") + "," + series_sql(
  "path", "v", _D) + f""",
  bad AS (SELECT symbol, min(k) AS first_bad FROM ds JOIN path USING (symbol, n) WHERE n > {_D.window // 2} AND mass > {_D.threshold} GROUP BY 1),
  due AS MATERIALIZED (SELECT symbol, session, k, k // {STEPS.every} AS turn, (SELECT count(*) FROM path p WHERE p.symbol = num.symbol AND p.k <= num.k) < {_D.window} AS warm,
    coalesce(k >= first_bad, false) AS decayed FROM num LEFT JOIN bad USING (symbol) WHERE k % {STEPS.every} = 0),
  st(symbol, turn, session, idx, action) AS (SELECT DISTINCT symbol, 0::BIGINT, NULL::DATE, {STEPS.grid.index(STEPS.start)}, '' FROM num
    UNION ALL SELECT d.symbol, d.turn, d.session, CASE WHEN warm THEN idx WHEN decayed THEN greatest(idx - 1, 0) ELSE least(idx + 1, {len(STEPS.grid) - 1}) END,
      CASE WHEN warm THEN 'warmup_hold' WHEN decayed AND idx > 0 THEN 'halve' WHEN decayed THEN 'hold_min' WHEN idx + 1 < {len(STEPS.grid)} THEN 'step_up' ELSE 'hold_max' END
    FROM st JOIN due d ON d.symbol = st.symbol AND d.turn = st.turn + 1)
SELECT symbol, session, CAST({list(STEPS.grid)} AS DOUBLE[])[idx + 1] AS multiplier, action FROM st WHERE turn > 0"""


@query("w9_stream_ladder", LADDER_SQL, f8="multiplier", dt="session")
def w9(spark, sf):
    """Sizing steps of the ladder on session returns."""
    return st.run_to_table(st.stream_ladder(by_year(session_returns(spark, sf), "returns"), STEPS), "ladder")


@query("w9_batch_ladder", LADDER_SQL, f8="multiplier", dt="session")
def w9_batch(spark, sf):
    return st.batch_ladder(session_returns(spark, sf), STEPS)
