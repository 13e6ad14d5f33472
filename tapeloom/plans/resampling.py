"""Aggregations (section D)."""

from pyspark.sql import functions as F

from tapeloom.functions import clock
from tapeloom.operators import archetypes, trend
from tapeloom.operators import bars as ops
from tapeloom.operators import features as feat
from tapeloom.operators.joins import asof_join
from tapeloom.operators.scan import exact_quantiles, number_rows, rolling
from tapeloom.plans.inputs import bars, ledger, numbered_bars, returns, ticks
from tapeloom.plans.projections import SURVEY_SQL, survey
from tapeloom.plans.registry import cte, query
from tapeloom.session import load

DAY = "CAST(ts AS DATE)"


@query("d1_resample_ohlcv", cte("bars") + "SELECT * FROM bars", f8="open high low close", i8="volume n")
def d1(spark, sf):
    return bars(spark, sf)


@query("d1_resample_5min_left", cte("ticks") + """
SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS bar_ts, arg_min(price, seq) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, seq) AS close, sum(size) AS volume, count(*) AS n FROM ticks GROUP BY 1, 2""",
       f8="open high low close", i8="volume")
def d1_left(spark, sf):
    return ops.resample_ohlcv(ticks(spark, sf), 5, label="left", closed="left", at="seq")


@query("d2_session_ohlc", cte("ticks") + f"""
SELECT symbol, {DAY} AS session, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, seq) AS close, sum(size) AS volume, count(*) AS n
FROM ticks GROUP BY 1, 2 HAVING count(*) >= 65""", f8="open high low close", i8="volume", dt="session")
def d2(spark, sf):
    return ops.session_ohlc(ticks(spark, sf), 65, F.to_date("ts"), tie=None, at="seq")


@query("d3_daily_close", cte("ticks") + f"""
SELECT symbol, {DAY} AS session, arg_max(price, seq) AS close, count(*) AS n_bars FROM ticks WHERE hour(ts) <= 20
GROUP BY 1, 2""", f8="close", dt="session")
def d3(spark, sf):
    return ops.daily_close(ticks(spark, sf), 20, tie=None, at="seq")


@query("d4_session_vwap", cte("ticks") + f"""
SELECT symbol, {DAY} AS session, sum(price * size) / nullif(sum(size), 0) AS vwap, sum(size) AS volume
FROM ticks GROUP BY 1, 2""", f8="vwap", i8="volume", dt="session")
def d4(spark, sf):
    return ops.session_vwap(ticks(spark, sf), F.to_date("ts"))


SIGNED_SQL = cte("bars", steps="""SELECT *, row_number() OVER w - 1 AS pos, sign(close - lag(close) OVER w) AS s
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)""", signed="""
  SELECT *, coalesce(last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER
    (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING), 0) AS sgn FROM steps""")


@query("d5_mediator_block", SIGNED_SQL + """
, g AS (SELECT symbol, CAST(bar_ts AS DATE) AS block, ln(arg_max(close, bar_ts) / arg_min(open, bar_ts)) AS ret,
  ln(max(high) / min(low)) AS span, sum(volume) AS volume, sum(sgn * volume) AS signed_volume, count(*) AS n
  FROM signed GROUP BY 1, 2 HAVING count(*) = 23)
SELECT symbol, block, ret, 0.5 * span * span - (2 * ln(2) - 1) * ret * ret AS range_var, volume, signed_volume, n FROM g""",
       f8="ret range_var signed_volume", i8="volume", dt="block")
def d5(spark, sf):
    return ops.mediator_block(feat.tick_sign(numbered_bars(spark, sf)), F.to_date("bar_ts"), 23)


@query("d6_bin_profile", cte("rets", cells="""
  SELECT symbol, hour(bar_ts) AS bin, CAST(bar_ts AS DATE) AS session, sum(r) AS ret FROM rets GROUP BY 1, 2, 3""",
  lagged="SELECT *, lag(ret) OVER (PARTITION BY symbol, bin ORDER BY session) AS prev FROM cells",
  prof="""SELECT symbol, bin, stddev_samp(ret) AS sigma, corr(ret, prev) AS rho1, count(ret) AS sessions
    FROM lagged GROUP BY 1, 2""") + """
SELECT symbol, bin, sigma, rho1, sessions, sigma / median(sigma) OVER (PARTITION BY symbol) AS ratio FROM prof""",
       f8="sigma rho1 ratio", i8="bin")
def d6(spark, sf):
    return ops.bin_profile(feat.with_log_return(numbered_bars(spark, sf)), F.hour("bar_ts"), F.to_date("bar_ts"))


@query("d7_survey_consensus", f"""
SELECT forecast_date, indicator, median(value) AS median, CASE WHEN count(*) > 1 THEN stddev_samp(value) END AS std,
  count(*) AS n FROM ({SURVEY_SQL}) GROUP BY 1, 2""", f8="median std", dt="forecast_date")
def d7(spark, sf):
    return ops.survey_consensus(survey(spark, sf))


CONTRACT_SQL = """SELECT symbol AS root, CAST(ts + INTERVAL 7 HOUR AS DATE) AS session, user_id % 3 AS contract_id,
  ts, price, size, seq FROM ticks"""


def contracts(spark, sf):
    return ops.contract_ticks(ticks(spark, sf))


@query("d8_contract_volume", cte("ticks", contracts=CONTRACT_SQL) + """
SELECT root, session, contract_id, sum(size) AS volume FROM contracts GROUP BY 1, 2, 3""", i8="volume", dt="session")
def d8(spark, sf):
    return ops.contract_volume(contracts(spark, sf))


@query("d9_session_pnl", cte("ledger") + """
SELECT session, sum(pnl) AS pnl, sum(ln(1 + ret)) AS log_ret, count(*) AS n FROM ledger GROUP BY 1""",
       f8="pnl log_ret", dt="session", digits=4)
def d9(spark, sf):
    return ledger(spark, sf).groupBy("session").agg(
        F.sum("pnl").alias("pnl"), F.sum(F.log1p("ret")).alias("log_ret"), F.count(F.lit(1)).alias("n"))


REASON_SQL = """CASE WHEN r_multiple < -0.5 THEN 'stop' WHEN r_multiple > 1.5 THEN 'target' ELSE 'time' END"""


def reason():
    return F.when(F.col("r_multiple") < -0.5, "stop").when(F.col("r_multiple") > 1.5, "target").otherwise("time")


@query("d10_exit_histogram", cte("ledger") + f"""
SELECT symbol, count(*) FILTER (WHERE {REASON_SQL} = 'stop') AS stop, count(*) FILTER (WHERE {REASON_SQL} = 'target') AS target,
  count(*) FILTER (WHERE {REASON_SQL} = 'time') AS time, count(*) FILTER (WHERE pnl > 0) AS wins,
  count(*) FILTER (WHERE pnl < 0) AS losses, count(*) FILTER (WHERE pnl = 0) AS zeros FROM ledger GROUP BY 1""")
def d10(spark, sf):
    from tapeloom.operators.metrics import exit_histogram

    return exit_histogram(ledger(spark, sf).withColumn("reason", reason()), ["symbol"], ["stop", "target", "time"])


@query("d11_kpi_table", cte("ledger", cells="""
  SELECT k2 % 3 AS config, symbol, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, sum(pnl) / 100000 AS roi,
    avg(r_multiple) AS mean_r FROM ledger GROUP BY 1, 2""") + """
SELECT config, coalesce(symbol, 'basket') AS symbol, CAST(sum(n) AS BIGINT) AS n, CAST(sum(wins) AS BIGINT) AS wins,
  avg(roi) AS roi, sum(mean_r * n) / sum(n) AS mean_r FROM cells GROUP BY GROUPING SETS ((config, symbol), (config))""",
       f8="roi mean_r", i8="config", digits=4)
def d11(spark, sf):
    from tapeloom.operators.metrics import kpi_table

    return kpi_table(ledger(spark, sf).withColumn("config", F.col("k2") % 3), 100_000.0)


@query("d12_subwindow_metrics", cte("returns", cut="""
  SELECT *, sum(ret) OVER (PARTITION BY symbol ORDER BY session) AS c FROM returns
  WHERE session BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'""", dd="""
  SELECT *, 1 - exp(c) / exp(greatest(0, max(c) OVER (PARTITION BY symbol ORDER BY session))) AS d FROM cut""") + """
SELECT symbol, exp(sum(ret)) - 1 AS roi, max(d) AS max_dd, count(*) AS n FROM dd GROUP BY 1""", f8="roi max_dd")
def d12(spark, sf):
    from tapeloom.operators.metrics import drawdown_summary

    sub = returns(spark, sf).filter(F.col("session").between("1997-01-01", "1998-06-30"))
    return drawdown_summary(sub, ["symbol"], ["session"], "ret").select(
        "symbol", F.expm1("total").alias("roi"), "max_dd", "n")


@query("d13_regime_eras", cte("returns", steps="""
  SELECT symbol, session AS step FROM returns WHERE trades >= 12""") + """
SELECT symbol, era, count(*) AS n, sum(ret) AS total, CASE WHEN count(*) > 1 AND stddev_samp(ret) > 0
  THEN avg(ret) / stddev_samp(ret) * sqrt(252) END AS sharpe, min(session) AS first_day, max(session) AS last_day
FROM (SELECT r.symbol, r.session, r.ret, s.step AS era FROM returns r ASOF JOIN steps s
      ON r.symbol = s.symbol AND r.session >= s.step) GROUP BY 1, 2""", f8="total sharpe", dt="era first_day last_day", digits=5)
def d13(spark, sf):
    r = returns(spark, sf).withColumn("at", F.to_timestamp("session"))
    steps = r.filter("trades >= 12").select("symbol", "at", F.col("session").alias("era"))
    j = asof_join(r, steps, ["symbol"], "at", "session", ["era"], chunk=F.trunc("_on", "year"))
    sd = F.stddev_samp("ret")
    return j.filter(F.col("era").isNotNull()).groupBy("symbol", "era").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total"),
        F.when(sd > 0, F.avg("ret") / sd * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.min("session").alias("first_day"), F.max("session").alias("last_day"))


@query("d14_concentration_share", cte("returns", folds="""
  SELECT symbol, year(session) AS fold, sum(ret) AS ret FROM returns GROUP BY 1, 2""") + """
SELECT symbol, sum(ret) FILTER (WHERE fold < 1998) / sum(ret) AS early_share, count(*) FILTER (WHERE ret > 0) AS positive,
  quantile_cont(ret, 0.5) AS median, avg(ret) AS mean FROM folds GROUP BY 1""", f8="early_share median mean", digits=5)
def d14(spark, sf):
    folds = returns(spark, sf).groupBy("symbol", F.year("session").alias("fold")).agg(F.sum("ret").alias("ret"))
    return folds.groupBy("symbol").agg(
        F.try_divide(F.sum(F.when(F.col("fold") < 1998, F.col("ret"))), F.sum("ret")).alias("early_share"),
        F.count_if(F.col("ret") > 0).alias("positive"), F.percentile("ret", 0.5).alias("median"),
        F.avg("ret").alias("mean"))


MED_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  (l_discount - l_tax) AS m_ret, l_quantity / 50 AS m_range, (l_linenumber - 4) / 3.0 AS m_flow, l_quantity FROM lineitem"""
ARCH_SQL = f"""WITH m AS ({MED_SQL}),
s AS (SELECT stddev_samp(abs(m_ret)) AS s1, stddev_samp(m_range) AS s2, stddev_samp(abs(m_flow)) AS s3, count(*) AS n FROM m),
a AS (SELECT abs(m_ret) AS v, row_number() OVER (ORDER BY abs(m_ret)) - 1 AS i FROM m),
b AS (SELECT m_range AS v, row_number() OVER (ORDER BY m_range) - 1 AS i FROM m),
q AS (SELECT (SELECT max(v) FROM a WHERE i = floor((n - 1) * 0.2 + 0.5)) AS q20,
  (SELECT max(v) FROM a WHERE i = floor((n - 1) * 0.8 + 0.5)) AS q80,
  (SELECT max(v) FROM b WHERE i = floor((n - 1) * 0.5 + 0.5)) AS q50, * FROM s),
cells AS (SELECT m.*, (m_ret > 0)::BIGINT AS ax1, CASE WHEN abs(m_ret) <= q20 THEN 0 WHEN abs(m_ret) <= q80 THEN 1 ELSE 2 END AS ax2,
  CASE WHEN m_range <= q50 THEN 0 ELSE 1 END AS ax3,
  CASE WHEN abs(m_flow) < 0.05 * s3 THEN 0 WHEN m_flow > 0 THEN 1 ELSE 2 END AS ax4 FROM m, q)
"""


def mediators(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        (F.col("l_discount") - F.col("l_tax")).alias("m_ret"), (F.col("l_quantity") / 50).alias("m_range"),
        ((F.col("l_linenumber") - 4) / 3.0).alias("m_flow"))


@query("d15_conditional_frequency", ARCH_SQL + """
SELECT ax1, ax2, ax3, ax4, count(*) AS n, avg((l_quantity > 25)::INT) AS p_up, avg(l_quantity) AS mean_y
FROM cells GROUP BY 1, 2, 3, 4""", f8="p_up mean_y", i8="ax2 ax3 ax4")
def d15(spark, sf):
    m = mediators(spark, sf)
    rule = archetypes.fit_thresholds(m)
    return m.withColumns(archetypes.axes(rule)).groupBy(*archetypes.AXES).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("l_quantity") > 25).cast("int")).alias("p_up"),
        F.avg("l_quantity").alias("mean_y"))


@query("d16_archetype_cells", ARCH_SQL + "SELECT ax1, ax2, ax3, ax4, count(*) AS n FROM cells GROUP BY 1, 2, 3, 4",
       i8="ax2 ax3 ax4")
def d16_cells(spark, sf):
    m = mediators(spark, sf)
    return archetypes.cell_counts(m, archetypes.fit_thresholds(m))


# The merging of cells: l lists the groups left (size, first cell, members); the smallest joins the nearest group of
# 44 rows or more, or the largest group where none has that many, until seven are left.
RULE_SQL = ARCH_SQL.replace("WITH m AS", "WITH RECURSIVE m AS") + """,
cn AS MATERIALIZED (SELECT concat(ax1, ax2, ax3, ax4) AS c, count(*) AS n FROM cells GROUP BY 1),
mg(l) AS (SELECT list_sort(list({'n': n, 'c': c, 'm': [c]})) FROM cn
  UNION ALL SELECT list_sort(list_transform(l[2:len(l)], lambda e: CASE WHEN e.c = t
      THEN {'n': e.n + l[1].n, 'c': e.c, 'm': list_concat(e.m, l[1].m)} ELSE e END)) FROM (
    SELECT l, coalesce(list_sort(list_transform(list_filter(l[2:len(l)], lambda e: e.n >= 44),
        lambda e: {'h': hamming(e.c, l[1].c), 'n': -e.n, 'c': e.c}))[1].c,
      list_sort(list_transform(l[2:len(l)], lambda e: {'n': -e.n, 'c': e.c}))[1].c) AS t FROM mg WHERE len(l) > 7)),
gp AS (SELECT row_number() OVER (ORDER BY e.c) - 1 AS archetype, unnest(e.m) AS c FROM (SELECT unnest(l) AS e FROM mg WHERE len(l) = 7)),
al AS (SELECT a.v AS ax1, b.v AS ax2, d.v AS ax3, e.v AS ax4, concat(a.v, b.v, d.v, e.v) AS c FROM range(0, 2) AS a(v), range(0, 3) AS b(v), range(0, 2) AS d(v), range(0, 3) AS e(v)),
rt AS (SELECT ax1, ax2, ax3, ax4, archetype, gp.c = al.c AS seen FROM al, gp
  QUALIFY row_number() OVER (PARTITION BY al.c ORDER BY hamming(al.c, gp.c), gp.c) = 1)
"""


@query("d16_archetype_rule", RULE_SQL + "SELECT * FROM rt")
def d16(spark, sf):
    """Cells after merging down to seven archetypes."""
    return archetypes.rule_table(spark, archetypes.fit_archetypes(mediators(spark, sf), 7))


@query("d17_archetype_apply", RULE_SQL + """
SELECT archetype, count(*) AS n, avg(m_ret) AS mean_ret FROM cells JOIN rt USING (ax1, ax2, ax3, ax4) GROUP BY 1""", f8="mean_ret")
def d17(spark, sf):
    m = mediators(spark, sf)
    hit = archetypes.apply_archetypes(m, archetypes.fit_archetypes(m, 7))
    return hit.groupBy("archetype").agg(F.count(F.lit(1)).alias("n"), F.avg("m_ret").alias("mean_ret"))


SCORE_SQL = """SELECT doc_id, source, lang, least(n_chars / 4000.0, 1.0) AS p, quality AS d FROM documents JOIN labels USING (doc_id)"""


def scores(spark, sf):
    return load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang"), "doc_id").select(
        "doc_id", "source", "lang", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("p"), F.col("quality").alias("d"))


@query("d18_reliability_slope", f"""
WITH s AS ({SCORE_SQL}), e AS (SELECT quantile_cont(p, [i / 10.0 for i in range(0, 11)]) AS edges FROM s),
b AS (SELECT p, d, (SELECT max(i) FROM range(0, 10) AS t(i) WHERE p >= edges[i + 1]) AS bin FROM s, e),
g AS (SELECT bin, avg(p) AS mp, avg(d) AS md FROM b GROUP BY 1 HAVING count(*) >= 5)
SELECT CASE WHEN count(*) >= 3 THEN regr_slope(md, mp) END AS slope, count(*) AS bins FROM g""", f8="slope")
def d18(spark, sf):
    from tapeloom.operators.metrics import reliability_slope

    return reliability_slope(scores(spark, sf), "p", "d", 10)


@query("d19_brier_skill", f"""
WITH s AS ({SCORE_SQL}), c AS (SELECT avg(d) AS clim FROM s)
SELECT lang, count(*) AS n, avg(pow(p - d, 2)) AS brier, 1 - avg(pow(p - d, 2)) / avg(pow(clim - d, 2)) AS skill
FROM s, c GROUP BY 1""", f8="brier skill")
def d19(spark, sf):
    from tapeloom.operators.metrics import brier_skill

    return brier_skill(scores(spark, sf), ["lang"], "p", "d")


RULES = [("mom20", 20, 0.5), ("mom20", 20, 1.0), ("mom60", 60, 0.5), ("ma", 10, 50), ("ma", 20, 100)]
_MOM = """CASE WHEN pos >= {n} AND sig{n} > 0 AND abs(lc - lag(lc, {n}) OVER w) > {tau} * sqrt({n}) * sig{n}
  THEN sign(lc - lag(lc, {n}) OVER w) ELSE 0 END AS {name}"""
TREND_SQL = cte("rets", sig="""SELECT *, ln(close) AS lc,
    CASE WHEN count(r) OVER a >= 2 THEN stddev_samp(r) OVER a END AS sig20,
    CASE WHEN count(r) OVER b >= 2 THEN stddev_samp(r) OVER b END AS sig60,
    CASE WHEN count(*) OVER s50 = 50 THEN avg(close) OVER s50 END AS m50, CASE WHEN count(*) OVER s100 = 100 THEN avg(close) OVER s100 END AS m100,
    avg(close) OVER s10 AS m10, avg(close) OVER s20 AS m20
  FROM rets WINDOW a AS (PARTITION BY symbol ORDER BY bar_ts ROWS 19 PRECEDING), b AS (PARTITION BY symbol ORDER BY bar_ts ROWS 59 PRECEDING),
    s10 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 9 PRECEDING), s20 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 19 PRECEDING),
    s50 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 49 PRECEDING), s100 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 99 PRECEDING)""",
  sides="SELECT *, " + ", ".join([
      _MOM.format(n=20, tau=0.5, name="a1"), _MOM.format(n=20, tau=1.0, name="a2"), _MOM.format(n=60, tau=0.5, name="a3"),
      "CASE WHEN m10 > m50 * 1.001 THEN 1 WHEN m10 < m50 * 0.999 THEN -1 ELSE 0 END AS d1",
      "CASE WHEN m20 > m100 * 1.001 THEN 1 WHEN m20 < m100 * 0.999 THEN -1 ELSE 0 END AS d2",
      "sign(lead(lc, 5) OVER w - lc) AS ahead"]) + " FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)")


@query("d20_trend_competition", TREND_SQL + """
, long AS (SELECT symbol, rule, side, ahead, pos, need FROM (
    SELECT symbol, pos, ahead, 'a1' AS rule, a1 AS side, 20 AS need FROM sides UNION ALL SELECT symbol, pos, ahead, 'a2', a2, 20 FROM sides
    UNION ALL SELECT symbol, pos, ahead, 'a3', a3, 60 FROM sides UNION ALL SELECT symbol, pos, ahead, 'd1', d1, 50 FROM sides
    UNION ALL SELECT symbol, pos, ahead, 'd2', d2, 100 FROM sides)),
sc AS (SELECT symbol, rule, avg(pow(side - ahead, 2)) AS brier, count(*) AS n FROM long WHERE ahead <> 0 AND pos >= need GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY brier, rule) = 1 AS best FROM sc""", f8="brier")
def d20(spark, sf):
    from tapeloom.operators.metrics import rule_competition

    b = numbered_bars(spark, sf)
    b = trend.ts_momentum(b, 20, 0.5, out="a1")
    b = trend.ts_momentum(b, 20, 1.0, out="a2")
    b = trend.ts_momentum(b, 60, 0.5, out="a3")
    b = trend.ma_cross(b, 10, 50, 0.001, out="d1")
    b = trend.ma_cross(b, 20, 100, 0.001, out="d2")
    return rule_competition(b, {"a1": 20, "a2": 20, "a3": 60, "d1": 50, "d2": 100}, 5)


@query("d21_latest_version", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, count(*) AS versions FROM orders GROUP BY 1""")
def d21(spark, sf):
    ver = F.struct("o_orderdate", "o_orderkey")
    return load(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", ver).alias("o_orderkey"), F.max_by("o_totalprice", ver).alias("o_totalprice"),
        F.count(F.lit(1)).alias("versions"))
