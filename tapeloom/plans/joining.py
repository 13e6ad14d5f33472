"""Joins (section C), selections (F6) and set operations."""

from pyspark.sql import functions as F

from tapeloom.operators import archetypes, joins, sets
from tapeloom.operators import bars as ops
from tapeloom.operators import features as feat
from tapeloom.operators.scan import number_rows, rolling
from tapeloom.plans.inputs import TRADE_KEY, bars, ledger, numbered_bars, returns, ticks
from tapeloom.plans.registry import cte, query
from tapeloom.plans.resampling import ARCH_SQL, CONTRACT_SQL, contracts, mediators
from tapeloom.plans.windows import ROLL_SQL, roll_steps
from tapeloom.session import load

TK = ", ".join(TRADE_KEY)


@query("c1_inner_join_multi_key", cte("ticks", **ROLL_SQL) + """
SELECT c.root, c.session, count(*) AS n, sum(c.size) AS size, max(c.price) AS high FROM c JOIN ef
  ON c.root = ef.root AND c.session = ef.session AND c.contract_id = ef.effective GROUP BY 1, 2""", f8="high", i8="size", dt="session")
def c1(spark, sf):
    front = roll_steps(spark, sf)["effective"].select("root", "session", F.col("effective").alias("contract_id"))
    return contracts(spark, sf).join(front, ["root", "session", "contract_id"]).groupBy("root", "session").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max("price").alias("high"))


@query("c2_left_join_coalesce", """
SELECT c.c_custkey, coalesce(o.med, c.c_acctbal, 0) AS value, o.med IS NULL AS proxied FROM customer c
LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS med FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey""", f8="value")
def c2(spark, sf):
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("med"))
    d = joins.left_coalesce(load(spark, sf, "customer").select("c_custkey", "c_acctbal"), o, ["c_custkey"], "value",
                            ["med", "c_acctbal", F.lit(0.0)])
    return d.select("c_custkey", "value", F.col("med").isNull().alias("proxied"))


@query("c3_full_outer_features", """
WITH a AS (SELECT CAST(ts AS DATE) AS session, avg(value) AS mean_px FROM events GROUP BY 1),
b AS (SELECT CAST(o_orderdate AS DATE) AS session, sum(o_totalprice) AS vol FROM orders GROUP BY 1),
c AS (SELECT CAST(l_shipdate AS DATE) AS session, count(*) AS trades FROM lineitem GROUP BY 1)
SELECT * FROM a FULL JOIN b USING (session) FULL JOIN c USING (session)""", f8="mean_px vol trades", dt="session", digits=4)
def c3(spark, sf):
    """Daily features of three sources whose days overlap only in part."""
    def day(table, at, what, name):
        return load(spark, sf, table).groupBy(F.to_date(at).alias("session")).agg(what.alias(name))

    return joins.outer_merge([day("events", "ts", F.avg("value"), "mean_px"), day("orders", "o_orderdate", F.sum("o_totalprice"), "vol"),
                              day("lineitem", "l_shipdate", F.count(F.lit(1)), "trades")], ["session"])


def _purchases(spark, sf):
    return load(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.col("user_id").alias("user_id"), "ts", F.col("value").alias("last_px"), F.col("event_id").alias("last_id"))


@query("c4_asof_join", """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'),
r AS (SELECT event_id AS last_id, user_id, ts, value AS last_px FROM events WHERE event_type = 'purchase')
SELECT l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 1 DAY THEN last_px END AS last_px,
  CASE WHEN l.ts - r.ts <= INTERVAL 1 DAY THEN CAST(last_id AS DOUBLE) END AS last_id
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""", f8="last_px last_id")
def c4(spark, sf):
    left = load(spark, sf, "events").filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof_join(left, _purchases(spark, sf), ["user_id"], "ts", "event_id", ["last_px", "last_id"],
                           tolerance_us=86_400_000_000).select("event_id", "last_px", "last_id")


@query("c5_news_window_join", """
WITH l AS (SELECT event_id, ts FROM events WHERE event_type <> 'signup'), r AS (SELECT event_id AS rel, ts AS rts FROM events WHERE event_type = 'signup')
SELECT event_id, rel, abs(epoch_us(ts) - epoch_us(rts)) AS distance_us FROM (
  SELECT event_id, ts, unnest([b, f]) AS p FROM (
    SELECT l.event_id, l.ts, (SELECT max(rts) FROM r WHERE rts <= l.ts) AS b, (SELECT min(rts) FROM r WHERE rts >= l.ts) AS f FROM l))
  JOIN r ON r.rts = p WHERE abs(epoch_us(ts) - epoch_us(rts)) <= 900000000
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(rts)), rts) = 1""")
def c5(spark, sf):
    ev = load(spark, sf, "events")
    left = ev.filter("event_type <> 'signup'").select("event_id", "ts")
    right = ev.filter("event_type = 'signup'").select("ts", F.col("event_id").alias("rel"))
    return joins.nearest_within(left, right, [], "ts", "event_id", ["rel"], 900_000_000).filter(
        F.col("rel").isNotNull()).select("event_id", "rel", "distance_us")


@query("c5_band_counts", """
WITH r AS (SELECT ts AS rts FROM events WHERE event_type = 'signup')
SELECT event_id, (SELECT count(*) FROM r WHERE rts BETWEEN ts - INTERVAL 15 MINUTE AND ts + INTERVAL 15 MINUTE) AS n_near
FROM events WHERE event_type = 'error'""")
def c5_counts(spark, sf):
    ev = load(spark, sf, "events")
    return joins.band_counts(ev.filter("event_type = 'error'").select("event_id", "ts"),
                             ev.filter("event_type = 'signup'").select("ts"), "ts", 900_000_000).select("event_id", "n_near")


@query("c6_overlapping_adjacent", cte("ledger") + f"""
SELECT {TK} FROM ledger QUALIFY entry_ts < lag(exit_ts) OVER (PARTITION BY symbol ORDER BY entry_ts, {TK})""")
def c6(spark, sf):
    d = number_rows(ledger(spark, sf), ["symbol"], ["entry_ts", *TRADE_KEY])
    return joins.overlapping_adjacent(d, ["symbol"]).select(*TRADE_KEY)


@query("c6_overlap_counts", cte("ledger", ev=f"""
  SELECT symbol, {TK}, entry_ts AS t, 1 AS kind FROM ledger UNION ALL SELECT symbol, {TK}, exit_ts, 0 FROM ledger""",
  run=f"""SELECT *, sum(CASE WHEN kind = 1 THEN 1 ELSE -1 END) OVER (PARTITION BY symbol ORDER BY t, kind, {TK}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_before FROM ev""") + f"""
SELECT symbol, {TK}, coalesce(open_before, 0) AS open_before FROM run WHERE kind = 1""", i8="open_before")
def c6_counts(spark, sf):
    return joins.overlap_counts(ledger(spark, sf), ["symbol"], TRADE_KEY)


@query("c7_regular_grid", cte("bars") + """, e AS (SELECT symbol, min(bar_ts) AS lo, max(bar_ts) AS hi FROM bars GROUP BY 1),
g AS (SELECT symbol, unnest(range(lo, hi + INTERVAL 1 MINUTE, INTERVAL 30 MINUTE)) AS bar_ts FROM e)
SELECT symbol, bar_ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS close_filled,
  volume IS NULL AS gap FROM g LEFT JOIN bars USING (symbol, bar_ts)""", f8="close_filled")
def c7(spark, sf):
    return joins.regular_grid(bars(spark, sf).select("symbol", "bar_ts", "close", "volume"), 30, "bar_ts", ["close"]).select(
        "symbol", "bar_ts", "close_filled", F.col("volume").isNull().alias("gap"))


@query("c8_semi_anti_membership", """
SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS train FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
   OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def c8(spark, sf):
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    build, pos = c.filter("c_mktsegment = 'BUILDING'"), c.filter("c_acctbal > 0")
    train = o.join(build, "o_custkey", "left_semi").select("o_orderkey", F.lit(True).alias("train"))
    test = o.join(build, "o_custkey", "left_anti").join(pos, "o_custkey", "left_anti").select("o_orderkey", F.lit(False).alias("train"))
    return train.unionByName(test)


@query("c9_nearest_cell", ARCH_SQL + """, seen AS (SELECT DISTINCT ax1, ax2, ax3, ax4 FROM cells WHERE ax1 + ax3 <> 2),
pr AS (SELECT DISTINCT c.ax1, c.ax2, c.ax3, c.ax4, s.ax1 * 1000 + s.ax2 * 100 + s.ax3 * 10 + s.ax4 AS near,
  (c.ax1 <> s.ax1)::INT + (c.ax2 <> s.ax2)::INT + (c.ax3 <> s.ax3)::INT + (c.ax4 <> s.ax4)::INT AS dist FROM cells c, seen s),
nr AS (SELECT ax1, ax2, ax3, ax4, arg_min(near, (dist, near)) AS near FROM pr GROUP BY 1, 2, 3, 4)
SELECT near, count(*) AS n, avg(m_ret) AS mean_ret FROM cells JOIN nr USING (ax1, ax2, ax3, ax4) GROUP BY 1""", f8="mean_ret", i8="near")
def c9(spark, sf):
    m = mediators(spark, sf)
    d = m.withColumns(archetypes.axes(archetypes.fit_thresholds(m)))
    # At most 36 cells on either side.
    kinds = d.select(*archetypes.AXES).distinct()
    seen = kinds.filter("ax1 + ax3 <> 2").select(*[F.col(a).alias(f"s_{a}") for a in archetypes.AXES])
    dist = sum((F.col(a) != F.col(f"s_{a}")).cast("int") for a in archetypes.AXES)
    key = F.col("s_ax1") * 1000 + F.col("s_ax2") * 100 + F.col("s_ax3") * 10 + F.col("s_ax4")
    near = kinds.join(F.broadcast(seen)).groupBy(*archetypes.AXES).agg(
        F.min_by(key, F.struct(dist.alias("d"), key.alias("k"))).alias("near"))
    return d.join(F.broadcast(near), archetypes.AXES).groupBy("near").agg(
        F.count(F.lit(1)).alias("n"), F.avg("m_ret").alias("mean_ret"))


@query("c10_parameter_grid", cte("returns") + """, g AS (SELECT k, c FROM (VALUES (0.5, 0.0), (1.0, 0.0), (1.0, 0.0005), (2.0, 0.001)) AS t(k, c))
SELECT symbol, k, c, avg(ret * k - c) AS mean_ret, count(*) FILTER (WHERE ret * k > c) AS wins FROM returns, g GROUP BY 1, 2, 3""", f8="k c mean_ret", digits=8)
def c10(spark, sf):
    grid = spark.createDataFrame([(0.5, 0.0), (1.0, 0.0), (1.0, 0.0005), (2.0, 0.001)], "k double, c double")
    net = F.col("ret") * F.col("k") - F.col("c")
    return joins.cross_grid(returns(spark, sf), grid).groupBy("symbol", "k", "c").agg(
        F.avg(net).alias("mean_ret"), F.count_if(F.col("ret") * F.col("k") > F.col("c")).alias("wins"))


@query("f1_group_argmax", cte("ticks", c=CONTRACT_SQL, v="SELECT root, session, contract_id, sum(size) AS volume FROM c GROUP BY 1, 2, 3") + """
SELECT root, session, contract_id, volume FROM v QUALIFY row_number() OVER (PARTITION BY root, session ORDER BY volume DESC, contract_id) = 1""",
       f8="volume", dt="session")
def f1(spark, sf):
    v = ops.contract_volume(contracts(spark, sf)).withColumn("volume", F.col("volume").cast("double"))
    return sets.best_row(v, ["root", "session"], "volume", ["contract_id"], ["contract_id"])


@query("f2_best_grid_cell", cte("returns") + """, g AS (SELECT k, i FROM (VALUES (0.5, 0), (1.0, 1), (2.0, 2), (20.0, 3)) AS t(k, i)),
m AS (SELECT symbol, k, i, avg(CASE WHEN 1 + ret * k * 40 > 0 THEN ln(1 + ret * k * 40) END) AS score,
  bool_and(1 + ret * k * 40 > 0) AS ok FROM returns, g GROUP BY 1, 2, 3)
SELECT symbol, score, k FROM m WHERE ok QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, i) = 1""", f8="score k")
def f2(spark, sf):
    grid = spark.createDataFrame([(0.5, 0), (1.0, 1), (2.0, 2), (20.0, 3)], "k double, i int")
    x = 1 + F.col("ret") * F.col("k") * 40
    m = joins.cross_grid(returns(spark, sf), grid).groupBy("symbol", "k", "i").agg(
        F.when(F.min(x) > 0, F.avg(F.when(x > 0, F.log(x)))).alias("score"))
    return sets.best_row(m, ["symbol"], "score", ["i"], ["k"])


@query("f3_leaderboard", """
SELECT row_number() OVER (ORDER BY spent DESC NULLS LAST, c_custkey) AS rank, c_custkey, spent
FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""",
       f8="spent", digits=3)
def f3(spark, sf):
    s = load(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("spent"))
    d = load(spark, sf, "customer").select("c_custkey").join(s, "c_custkey", "left")
    return sets.leaderboard(d, [("spent", True), ("c_custkey", False)])


@query("f3_leaderboard_top", """
SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""", f8="o_totalprice")
def f3_top(spark, sf):
    return sets.leaderboard(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
                            [("o_totalprice", True), ("o_orderkey", False)], top=25)


@query("f4_total_order", cte("ledger") + f"""
SELECT symbol, {TK}, pnl FROM ledger ORDER BY symbol, {TK}, pnl""", f8="pnl")
def f4(spark, sf):
    return sets.total_order(ledger(spark, sf).select("symbol", *TRADE_KEY, "pnl"), ["symbol"])


@query("f5_union_frames", """
SELECT event_type AS src, count(*) AS n, sum(value) AS total FROM (
  SELECT event_type, value FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT event_type, value FROM events WHERE value > 100)
GROUP BY 1""", f8="total", digits=4)
def f5(spark, sf):
    e = load(spark, sf, "events").select("event_type", "value")
    parts = [e.filter(F.col("event_type") == k) for k in ("view", "click")] + [e.filter("value > 100")]
    return sets.union_all(parts).groupBy(F.col("event_type").alias("src")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("f6_merge_calendars", """
SELECT event_type AS indicator, date_trunc('hour', ts) AS release_ts FROM events WHERE event_type = 'signup'
UNION SELECT event_type, date_trunc('hour', ts) FROM events WHERE value > 50""")
def f6(spark, sf):
    e = load(spark, sf, "events").select("event_type", "value", F.col("event_type").alias("indicator"),
                                         F.date_trunc("hour", "ts").alias("release_ts"))
    return sets.merge_distinct(e.filter("event_type = 'signup'"), e.filter("value > 50"), ["indicator", "release_ts"])


@query("f7_keep_first", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
       f8="o_totalprice")
def f7(spark, sf):
    return sets.keep_first(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"),
                           ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


RANGE_SQL = """SELECT o_custkey AS k, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS lo,
  date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 + o_custkey % 3 AS hi FROM orders"""


def _ranges(spark, sf, cond):
    d = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    return load(spark, sf, "orders").filter(cond).select(
        F.col("o_custkey").alias("k"), d.alias("lo"), (d + 1 + F.col("o_custkey") % 3).alias("hi"), "o_orderkey")


@query("f8_union_ranges", f"""
WITH r AS ({RANGE_SQL}), m AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM m)
SELECT k, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY k, isl""", i8="lo hi")
def f8(spark, sf):
    return sets.union_ranges(_ranges(spark, sf, F.lit(True)), ["k"], ["o_orderkey"])


@query("f8_subtract_ranges", f"""
WITH r AS ({RANGE_SQL} WHERE o_orderstatus <> 'F'), c AS ({RANGE_SQL} WHERE o_orderstatus = 'F'),
d AS (SELECT DISTINCT k, unnest(range(lo, hi)) AS d FROM r EXCEPT SELECT DISTINCT k, unnest(range(lo, hi)) FROM c),
g AS (SELECT k, d, d - row_number() OVER (PARTITION BY k ORDER BY d) AS grp FROM d)
SELECT k, min(d) AS lo, max(d) + 1 AS hi FROM g GROUP BY k, grp""", i8="lo hi")
def f8_subtract(spark, sf):
    return sets.subtract_ranges(_ranges(spark, sf, "o_orderstatus <> 'F'"), _ranges(spark, sf, "o_orderstatus = 'F'"), ["k"])


@query("f9_row_difference", cte("ticks", **ROLL_SQL) + """
SELECT root, count(*) AS dropped FROM (SELECT c.root, c.seq FROM c EXCEPT ALL SELECT c.root, c.seq FROM c JOIN ef
  ON c.root = ef.root AND c.session = ef.session AND c.contract_id = ef.effective) GROUP BY 1""")
def f9(spark, sf):
    c = contracts(spark, sf)
    front = roll_steps(spark, sf)["effective"].select("root", "session", F.col("effective").alias("contract_id"))
    kept = c.join(front, ["root", "session", "contract_id"])
    return sets.rows_missing(c.select("root", "seq"), kept.select("root", "seq")).groupBy("root").agg(
        F.count(F.lit(1)).alias("dropped"))
