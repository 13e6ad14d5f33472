"""Projections and filters (section B) and scalar functions (section G)."""

from pyspark.sql import functions as F

from tapeloom.functions import clock, numeric
from tapeloom.functions.hashing import counter_hash, frame_fingerprint, row_sha256
from tapeloom.operators.bars import survey_consensus
from tapeloom.operators.scan import number_rows, prefix
from tapeloom.plans.inputs import TRADE_KEY, ledger, returns, ticks
from tapeloom.plans.registry import cte, query
from tapeloom.session import load

CT = "timezone('America/Chicago', timezone('UTC', ts))"


@query("b1_contract_id_full", "SELECT event_id, concat(event_type, '_', year(ts)) AS contract_id FROM events")
def b1(spark, sf):
    return load(spark, sf, "events").select(
        "event_id", clock.contract_id_full("event_type", "ts").alias("contract_id"))


@query("b2_month_code", """
SELECT p_partkey, regexp_extract(code, '^.+([FGHJKMNQUVXZ])[0-9]+$', 1) AS letter,
       regexp_extract(code, '^.+([FGHJKMNQUVXZ])[0-9]+$', 1) = '' AS malformed
FROM (SELECT p_partkey, concat(substr(p_type, 1, 2), substr('FGHJKMNQUVXZABC', 1 + p_size % 15, 1),
      p_partkey % 10) AS code FROM part)""")
def b2(spark, sf):
    letters = F.lit("FGHJKMNQUVXZABC")
    code = F.concat(F.substring("p_type", 1, 2), F.substr(letters, 1 + F.col("p_size") % 15, F.lit(1)),
                    (F.col("p_partkey") % 10).cast("string"))
    m = clock.month_code(code)
    return load(spark, sf, "part").select(
        "p_partkey", F.coalesce(m, F.lit("")).alias("letter"), m.isNull().alias("malformed"))


@query("b3_session_date", f"""
SELECT event_id, CAST({CT} + INTERVAL 7 HOUR AS DATE) AS session FROM events""", dt="session")
def b3(spark, sf):
    return load(spark, sf, "events").select(
        "event_id", clock.session_date("ts", clock.CHICAGO).alias("session"))


@query("b4_root_symbol", """
SELECT p_partkey, CASE WHEN starts_with(p_type, 'ECO') THEN 'ECO' WHEN starts_with(p_type, 'PRO') THEN 'PRO'
  WHEN starts_with(p_type, 'EC') THEN 'EC' WHEN starts_with(p_type, 'ST') THEN 'ST' ELSE p_type END AS root
FROM part""")
def b4(spark, sf):
    return load(spark, sf, "part").select(
        "p_partkey", clock.root_symbol("p_type", ["EC", "ST", "ECO", "PRO"]).alias("root"))


@query("b5_local_clock_window", """
SELECT event_id, CAST(lt AS DATE) AS local_date, hour(lt) AS local_hour, minute(lt) AS local_minute,
       strftime(lt, '%H:%M') AS local_hhmm
FROM (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS lt FROM events)
WHERE strftime(lt, '%H:%M') BETWEEN '09:31' AND '16:15'""", dt="local_date", i8="local_hour local_minute")
def b5(spark, sf):
    df = clock.with_local_clock(load(spark, sf, "events").select("event_id", "ts"), clock.NEW_YORK)
    return clock.in_clock_window(df, "09:31", "16:15").drop("ts")


EARLY = {"2024-01-15": "12:00", "2024-02-19": "12:00", "2024-03-29": "08:15"}


@query("b6_session_of", f"""
SELECT event_id, CASE
    WHEN CAST(lt AS DATE) = DATE '2024-01-01' THEN 'HALT'
    WHEN isodow(lt) = 6 THEN 'HALT'
    WHEN isodow(lt) = 7 THEN CASE WHEN CAST(lt AS TIME) < TIME '17:00:00' THEN 'HALT' ELSE 'OVN' END
    WHEN isodow(lt) = 5 AND CAST(lt AS TIME) >= TIME '16:00:00' THEN 'HALT'
    WHEN CAST(lt AS TIME) >= TIME '16:00:00' AND CAST(lt AS TIME) < TIME '17:00:00' THEN 'HALT'
    WHEN CAST(lt AS DATE) = DATE '2024-01-15' AND CAST(lt AS TIME) >= TIME '12:00:00' THEN 'HALT'
    WHEN CAST(lt AS TIME) >= TIME '08:30:00' AND CAST(lt AS TIME) < TIME '15:15:00' THEN 'RTH'
    WHEN isodow(lt) = 1 AND CAST(lt AS TIME) < TIME '08:30:00' THEN 'OVN'
    ELSE 'ETH' END AS phase
FROM (SELECT event_id, {CT} AS lt FROM events)""")
def b6(spark, sf):
    return load(spark, sf, "events").select("event_id", clock.session_of("ts", EARLY).alias("phase"))


@query("b7_trading_day", f"""
SELECT event_id, (SELECT min(d) FROM (SELECT CAST(target + CAST(k AS INTEGER) AS DATE) AS d
    FROM (SELECT unnest(range(0, 11)) AS k)) WHERE isodow(d) < 6 AND d <> DATE '2024-01-01') AS day
FROM (SELECT event_id, CAST(lt AS DATE) + CAST(CASE
    WHEN isodow(lt) = 5 AND CAST(lt AS TIME) >= TIME '16:00:00' THEN 3
    WHEN isodow(lt) = 6 THEN 2 WHEN isodow(lt) = 7 THEN 1
    WHEN isodow(lt) < 5 AND CAST(lt AS TIME) >= TIME '17:00:00' THEN 1 ELSE 0 END AS INTEGER) AS target
  FROM (SELECT event_id, {CT} AS lt FROM events))""", dt="day")
def b7(spark, sf):
    return load(spark, sf, "events").select("event_id", clock.trading_day("ts").alias("day"))


@query("b8_energy_session", f"""
SELECT event_id, CASE WHEN isodow(lt) = 6 THEN 'WEEKEND_CLOSED'
    WHEN isodow(lt) = 7 AND CAST(lt AS TIME) < TIME '17:00:00' THEN 'WEEKEND_CLOSED'
    WHEN isodow(lt) = 5 AND CAST(lt AS TIME) > TIME '16:00:00' THEN 'WEEKEND_CLOSED'
    WHEN isodow(lt) < 5 AND CAST(lt AS TIME) > TIME '16:00:00' AND CAST(lt AS TIME) < TIME '17:00:00'
      THEN 'MAINTENANCE_BREAK' ELSE 'ACTIVE' END AS phase
FROM (SELECT event_id, {CT} AS lt FROM events)""")
def b8(spark, sf):
    return load(spark, sf, "events").select("event_id", clock.energy_session("ts").alias("phase"))


@query("b9_iso_week_id", "SELECT o_orderkey, isoyear(o_orderdate) * 100 + week(o_orderdate) AS week_id FROM orders")
def b9(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", clock.iso_week_id("o_orderdate").alias("week_id"))


@query("b10_et_to_utc", """
SELECT o_orderkey, timezone('UTC', timezone('America/New_York', date_trunc('day', o_orderdate)
       + INTERVAL 1 HOUR * CASE WHEN o_orderstatus = 'F' THEN 8 ELSE 14 END + INTERVAL 30 MINUTE)) AS release_ts
FROM orders""")
def b10(spark, sf):
    hour = F.when(F.col("o_orderstatus") == "F", 8).otherwise(14)
    return load(spark, sf, "orders").select(
        "o_orderkey", clock.et_to_utc(F.to_date("o_orderdate"), hour, 30).alias("release_ts"))


@query("b11_return_conventions", cte("ledger") + """
SELECT k1, k2, k3, k4, k5, exp(ret) - 1 AS arith, ln(1 + ret) AS logret FROM ledger""", f8="arith logret", digits=9)
def b11(spark, sf):
    return ledger(spark, sf).select(*TRADE_KEY, numeric.log_to_arithmetic("ret").alias("arith"),
                                    numeric.arithmetic_to_log("ret").alias("logret"))


@query("b12_pit_cutoff", "SELECT event_id, ts, value FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'")
def b12(spark, sf):
    return numeric.pit_cutoff(load(spark, sf, "events"), F.lit("2024-01-15 12:00:00").cast("timestamp")).select(
        "event_id", "ts", "value")


@query("b13_drop_non_finite", """
SELECT l_returnflag, count(*) AS n, sum(ln(l_discount / l_tax)) AS total FROM lineitem
WHERE l_tax > 0 AND l_discount > 0 GROUP BY 1""", f8="total", digits=4)
def b13(spark, sf):
    x = F.when(F.col("l_tax") > 0, F.col("l_discount") / F.col("l_tax")).otherwise(F.lit(float("nan")))
    li = load(spark, sf, "lineitem").withColumn(
        "x", F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).otherwise(x))
    return numeric.drop_non_finite(li, ["x"]).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


@query("b14_dow_onehot", """
SELECT o_orderkey, (isodow(o_orderdate) = 1)::BIGINT AS mon, (isodow(o_orderdate) = 2)::BIGINT AS tue,
       (isodow(o_orderdate) = 3)::BIGINT AS wed, (isodow(o_orderdate) = 4)::BIGINT AS thu FROM orders""")
def b14(spark, sf):
    return load(spark, sf, "orders").select(
        "o_orderkey", *[c.alias(n) for n, c in clock.dow_onehot("o_orderdate").items()])


SURVEY_SQL = """SELECT date_trunc('month', l_shipdate) AS forecast_date, l_returnflag AS indicator,
  l_discount AS value FROM lineitem"""


def survey(spark, sf):
    return load(spark, sf, "lineitem").select(
        F.trunc("l_shipdate", "MM").alias("forecast_date"), F.col("l_returnflag").alias("indicator"),
        F.col("l_discount").alias("value"))


@query("b15_surprise_z", f"""
WITH c AS (SELECT forecast_date, indicator, median(value) AS m, CASE WHEN count(*) > 1 THEN stddev_samp(value) END AS s,
  max(value) AS actual FROM ({SURVEY_SQL}) GROUP BY 1, 2)
SELECT forecast_date, indicator, CASE WHEN s IS NOT NULL AND s <> 0 THEN (actual - m) / s END AS z FROM c""",
       f8="z", dt="forecast_date")
def b15(spark, sf):
    s = survey(spark, sf)
    actual = s.groupBy("forecast_date", "indicator").agg(F.max("value").alias("actual"))
    return survey_consensus(s).join(actual, ["forecast_date", "indicator"]).select(
        "forecast_date", "indicator", numeric.surprise_z("actual", "median", "std").alias("z"))


# Dollars per side; commission, exchange fee, levy, slippage prior.
FEES = [("AF", 0.35, 1.2, 0.02, 6.25), ("AO", 0.35, 1.2, 0.02, 6.25), ("NF", 0.25, 0.35, 0.02, 1.25),
        ("NO", 0.25, 0.35, 0.02, 1.25), ("RF", 0.35, 1.5, 0.02, 10.0), ("RO", 0.35, 1.5, 0.02, 10.0)]
FEES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', {c}, {e}, {v}, {p})" for s, c, e, v, p in FEES) + ") AS f(symbol, commission, exchange, levy, slippage)"


def fees(spark):
    return F.broadcast(spark.createDataFrame(
        FEES, "symbol string, commission double, exchange double, levy double, slippage double"))


@query("b16_round_trip_cost", cte("ledger", fees=FEES_SQL) + """
SELECT k1, k2, k3, k4, k5, 2 * size * (commission + exchange + levy + slip * 1.5) AS cost,
       ln(1 - 2 * size * (commission + exchange + levy + slip * 1.5) / (price * size * 100)) AS drag
FROM (SELECT *, CASE WHEN side = 1 THEN slippage ELSE 2.5 END AS slip FROM ledger JOIN fees USING (symbol))""",
       f8="cost drag")
def b16(spark, sf):
    measured = F.when(F.col("side") == -1, 2.5)
    cost = numeric.round_trip_cost("size", F.col("commission") + F.col("exchange") + F.col("levy"),
                                   "slippage", 1.5, measured)
    return ledger(spark, sf).join(fees(spark), "symbol").select(
        *TRADE_KEY, cost.alias("cost"),
        numeric.cost_log_drag(cost, F.col("price") * F.col("size") * 100).alias("drag"))


@query("b17_fee_breakdown", cte("ledger", fees=FEES_SQL) + """
SELECT symbol, trades, commission, exchange, levy, slippage,
       commission + exchange + levy + slippage AS per_side,
       2 * (commission + exchange + levy + slippage) AS round_trip,
       sz * 2 * (commission + exchange + levy + slippage) AS paid
FROM (SELECT symbol, count(*) AS trades, sum(size) AS sz FROM ledger GROUP BY 1) JOIN fees USING (symbol)""", f8="commission exchange levy slippage per_side round_trip paid",
       digits=4)
def b17(spark, sf):
    side = F.col("commission") + F.col("exchange") + F.col("levy") + F.col("slippage")
    use = ledger(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.sum("size").alias("sz"))
    return use.join(fees(spark), "symbol").select(
        "symbol", "trades", "commission", "exchange", "levy", "slippage", side.alias("per_side"),
        (2 * side).alias("round_trip"), (F.col("sz") * 2 * side).alias("paid"))


@query("b18_floored_equity", cte("returns", steps="""
  SELECT symbol, session, pnl / 10 AS x, row_number() OVER (PARTITION BY symbol ORDER BY session) AS i FROM returns""",
  walk="""SELECT symbol, session, i, greatest(0, 20000 + x) AS equity FROM steps WHERE i = 1
  UNION ALL SELECT s.symbol, s.session, s.i, greatest(0, w.equity + s.x)
  FROM walk w JOIN steps s ON s.symbol = w.symbol AND s.i = w.i + 1""") + """
SELECT symbol, session, equity, least(equity, 20000) AS capped, greatest(equity, 5000) AS current FROM walk""",
       f8="equity capped current", dt="session", digits=6)
def b18(spark, sf):
    from tapeloom.operators.risk import floored_equity

    eq = floored_equity(returns(spark, sf).withColumn("x", F.col("pnl") / 10), ["symbol"], ["session"], "x", 20000.0)
    return eq.select("symbol", "session", "equity",
                     numeric.equity_for_sizing("min_of_current_and_starting", "equity", 20000.0).alias("capped"),
                     numeric.equity_for_sizing("current", "equity", 20000.0, 0.25).alias("current"))


@query("b19_position_size", cte("ledger") + """
SELECT k1, k2, k3, k4, k5, floor(least(0.01 * 1000000 / (2.0 * (price * 0.02) * 5),
  greatest(least(0.8 * 0.25, 2.5), 0) * 1000000 / (price * 5), 3 + k2)) AS contracts FROM ledger""", i8="contracts")
def b19(spark, sf):
    return ledger(spark, sf).select(
        *TRADE_KEY, numeric.position_size(F.lit(1e6), F.col("price") * 0.02, 5.0, "price", 0.8, F.col("k2") + 3,
                                          2.0, 0.01, 0.25).cast("long").alias("contracts"))


@query("b20_r_multiple", cte("ledger") + """
SELECT k1, k2, k3, k4, k5, pnl / (price * 0.05 * size) AS r FROM ledger""", f8="r")
def b20(spark, sf):
    return ledger(spark, sf).select(
        *TRADE_KEY, numeric.r_multiple("pnl", F.col("price") * 0.05, "size", 1.0).alias("r"))


@query("b21_kpi_annotations", cte("returns", k="""
  SELECT symbol, session, ret, ret - 0.004 AS lo, ret + 0.004 AS hi, trades, ret * 100 AS t3 FROM returns""") + """
SELECT symbol, session,
  CASE WHEN ret < 0 THEN 'negative' WHEN abs(ret) < 1e-9 THEN 'flat' WHEN lo > 0 OR hi < 0 THEN 'positive' ELSE 'marginal' END AS sharpe,
  CASE WHEN trades / 4.0 >= 1 THEN 'adequate' WHEN trades / 4.0 >= 0.5 THEN 'marginal' ELSE 'low' END AS power,
  CASE WHEN t3 > 0.1 AND t3 - 0.15 > 0.1 THEN 'skew-positive' WHEN t3 > 0.1 THEN 'skew-positive-marginal'
       WHEN t3 < -0.1 AND t3 + 0.15 < -0.1 THEN 'skew-negative' WHEN t3 < -0.1 THEN 'skew-negative-marginal' ELSE 'skew-flat' END AS payoff,
  CASE WHEN abs(lo) / hi < 0.9 THEN 'favorable' WHEN abs(lo) / hi <= 1.1 THEN 'comparable' ELSE 'adverse' END AS drawdown,
  CASE WHEN trades / 2.0 > 1 THEN 'super' ELSE 'kelly' END AS kelly
FROM k WHERE hi > 0""", dt="session")
def b21(spark, sf):
    d = returns(spark, sf).withColumns({"lo": F.col("ret") - 0.004, "hi": F.col("ret") + 0.004,
                                        "t3": F.col("ret") * 100}).filter("hi > 0")
    return d.select(
        "symbol", "session", numeric.annotate_sharpe("ret", "lo", "hi").alias("sharpe"),
        numeric.annotate_power("trades", 4)[1].alias("power"),
        numeric.annotate_payoff("t3", F.col("t3") - 0.15, F.col("t3") + 0.15).alias("payoff"),
        numeric.annotate_drawdown_ratio(F.abs(F.col("lo")), "hi")[1].alias("drawdown"),
        F.when(numeric.annotate_kelly(F.col("trades") / 2.0).contains("+super"), "super").otherwise("kelly").alias("kelly"))


@query("b22_e_value", """
WITH e AS (SELECT p_type, exp(avg(p_size) / 25 - 1) AS rr, exp(avg(p_size) / 25 - 1 - 0.01) AS lo,
  exp(avg(p_size) / 25 - 1 + 0.01) AS hi FROM part GROUP BY 1),
f AS (SELECT *, CASE WHEN rr < 1 THEN 1 / rr ELSE rr END AS x,
  CASE WHEN lo <= 1 AND hi >= 1 THEN 1 WHEN rr > 1 THEN lo ELSE 1 / hi END AS y FROM e)
SELECT p_type, rr, x + sqrt(x * (x - 1)) AS ev, y + sqrt(y * (y - 1)) AS ev_limit, exp(0.91 * rr) AS smd FROM f""",
       f8="rr ev ev_limit smd")
def b22(spark, sf):
    d = load(spark, sf, "part").groupBy("p_type").agg((F.avg("p_size") / 25 - 1).alias("a"))
    d = d.select("p_type", F.exp("a").alias("rr"), F.exp(F.col("a") - 0.01).alias("lo"), F.exp(F.col("a") + 0.01).alias("hi"))
    ev, limit = numeric.e_value("rr", "lo", "hi")
    return d.select("p_type", "rr", ev.alias("ev"), limit.alias("ev_limit"), numeric.smd_to_rr("rr").alias("smd"))


@query("g1_numeric_functions", """
SELECT l_returnflag, l_linestatus, sum(ln(1 + l_tax)) AS a, sum(exp(l_discount) - 1) AS b, sum(sqrt(l_quantity)) AS c,
  sum(sign(l_discount - l_tax)) AS d, sum(abs(l_discount - l_tax)) AS e, sum(greatest(least(l_quantity, 40), 10)) AS f,
  sum(floor(l_extendedprice / 100)) AS g, sum(ceil(l_quantity / 3)) AS h, sum(pow(l_discount, 2)) AS i
FROM lineitem GROUP BY 1, 2""", f8="a b c d e f g h i", digits=4)
def g1(spark, sf):
    edge = F.col("l_discount") - F.col("l_tax")
    return load(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.log1p("l_tax")).alias("a"), F.sum(F.expm1("l_discount")).alias("b"),
        F.sum(F.sqrt("l_quantity")).alias("c"), F.sum(F.signum(edge)).alias("d"), F.sum(F.abs(edge)).alias("e"),
        F.sum(numeric.clip("l_quantity", 10, 40)).alias("f"), F.sum(F.floor(F.col("l_extendedprice") / 100)).alias("g"),
        F.sum(F.ceil(F.col("l_quantity") / 3)).alias("h"), F.sum(F.pow("l_discount", F.lit(2.0))).alias("i"))


_Z = "(l_quantity - 25.5) / 14.4"
_T = f"(1 / (1 + 0.2316419 * abs({_Z})))"
_TAIL = (f"(exp(-({_Z}) * ({_Z}) / 2) / sqrt(2 * pi()) * {_T} * (0.319381530 + {_T} * (-0.356563782 + {_T} * "
         f"(1.781477937 + {_T} * (-1.821255978 + {_T} * 1.330274429)))))")


@query("g2_normal_functions", f"""
SELECT l_quantity, count(*) AS n, CASE WHEN {_Z} >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END AS p,
  1.959963984540054 * {_Z} AS half FROM lineitem GROUP BY l_quantity""", f8="p half")
def g2(spark, sf):
    z = (F.col("l_quantity") - 25.5) / 14.4
    return load(spark, sf, "lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n")).select(
        "l_quantity", "n", numeric.normal_cdf(z).alias("p"), (numeric.normal_quantile(0.975) * z).alias("half"))


@query("g3_string_functions", """
SELECT p_partkey, starts_with(p_type, 'ECO') AS eco, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded,
  regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, split_part(p_name, ' ', 1) AS head, upper(trim(p_name)) AS up
FROM part""")
def g3(spark, sf):
    return load(spark, sf, "part").select(
        "p_partkey", F.col("p_type").startswith("ECO").alias("eco"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"), F.upper(F.trim("p_name")).alias("up"))


@query("g4_time_functions", """
SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS ny, date_trunc('hour', ts) AS hr,
  ts + INTERVAL 90 MINUTE AS later, CAST(ts AS DATE) AS d, hour(ts) AS h, minute(ts) AS m, week(ts) AS w FROM events""",
       dt="d", i8="h m w")
def g4(spark, sf):
    return load(spark, sf, "events").select(
        "event_id", clock.local_time("ts", clock.NEW_YORK).alias("ny"), F.date_trunc("hour", "ts").alias("hr"),
        (F.col("ts") + F.make_dt_interval(mins=F.lit(90))).alias("later"), F.to_date("ts").alias("d"),
        F.hour("ts").alias("h"), F.minute("ts").alias("m"), F.weekofyear("ts").alias("w"))


@query("g5_array_functions", """
SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) AS norm2,
  len(list_filter(embedding, lambda x: x > 0)) AS positive, list_max(embedding) AS top, embedding[2] - embedding[1] AS step
FROM embeddings""", f8="norm2 top step", i8="positive")
def g5(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return load(spark, sf, "embeddings").select(
        "vec_id", F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x).alias("norm2"),
        F.size(F.filter(e, lambda x: x > 0)).alias("positive"), F.array_max("embedding").alias("top"),
        (F.element_at("embedding", 2) - F.element_at("embedding", 1)).alias("step"))


@query("g6_json_fields", """
SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total,
  count(json_extract_string(props, '$.missing')) AS missing FROM events GROUP BY 1""", i8="total")
def g6(spark, sf):
    p = F.from_json("props", "k bigint, missing string")
    return load(spark, sf, "events").groupBy("event_type").agg(
        F.sum(p["k"]).alias("total"), F.count(p["missing"]).alias("missing"))


@query("g7_row_sha256", """
SELECT o_orderkey, sha256(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), o_orderpriority, o_orderstatus)) AS digest FROM orders""")
def g7(spark, sf):
    return load(spark, sf, "orders").select(
        "o_orderkey", row_sha256(["o_custkey", "o_orderpriority", "o_orderstatus"]).alias("digest"))


@query("g7_frame_fingerprint", """
WITH h AS (SELECT o_orderstatus, sha256(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), o_orderpriority)) AS d FROM orders)
SELECT o_orderstatus, count(*) AS n,
  CAST(sum(CAST(('0x' || substr(d, 1, 15)) AS BIGINT)::HUGEINT) % 18446744073709551616 AS VARCHAR) AS lane1,
  CAST(sum(CAST(('0x' || substr(d, 16, 15)) AS BIGINT)::HUGEINT) % 18446744073709551616 AS VARCHAR) AS lane2
FROM h GROUP BY 1""")
def g7_frame(spark, sf):
    return frame_fingerprint(load(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"], ["o_orderstatus"])


@query("g7_counter_hash", """
SELECT event_id, ((((event_id * 104729 + 42) % 2147483647) * 48271) % 2147483647 * 69621) % 2147483647 AS h FROM events""")
def g7_counter(spark, sf):
    return load(spark, sf, "events").select("event_id", counter_hash(F.col("event_id"), F.lit(0), 42).alias("h"))
