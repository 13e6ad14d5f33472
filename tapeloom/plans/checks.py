"""Data quality (section T), the feature registry (M), models and user functions (Y)."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.hashing import counter_hash
from tapeloom.operators import features as feat
from tapeloom.operators import inference as inf
from tapeloom.operators import models, quality, registry, splits
from tapeloom.operators.metrics import brier_skill, reliability_slope
from tapeloom.operators.scan import rolling, stored
from tapeloom.plans.inputs import bars, numbered_bars, ticks
from tapeloom.plans.outcomes import WF_SQL, sessions, wf_segments
from tapeloom.plans.registry import cte, query
from tapeloom.plans.resampling import contracts, scores
from tapeloom.plans.statistics import KS_SQL, H, ks_input
from tapeloom.plans.windows import ROLL_SQL, W, roll_steps
from tapeloom.session import load


@query("t1_domain_rules", cte("bars") + """, l AS (SELECT count(*) FILTER (WHERE NOT open >= -1000) AS a, count(*) FILTER (WHERE NOT high >= -1000) AS b,
  count(*) FILTER (WHERE NOT low >= 1) AS c, count(*) FILTER (WHERE NOT close >= -1000) AS d, count(*) FILTER (WHERE NOT volume >= 0) AS e,
  count(*) FILTER (WHERE symbol NOT IN ('view', 'click', 'error', 'signup')) AS f FROM bars)
SELECT 'open_range' AS rule, a AS violations FROM l UNION ALL SELECT 'high_range', b FROM l UNION ALL SELECT 'low_range', c FROM l
UNION ALL SELECT 'close_range', d FROM l UNION ALL SELECT 'volume_range', e FROM l UNION ALL SELECT 'symbol_enum', f FROM l""")
def t1(spark, sf):
    rules = quality.bar_rules()
    rules["low_range"] = F.col("low") >= 1
    rules["symbol_enum"] = F.col("symbol").isin("view", "click", "error", "signup")
    return quality.rule_counts(bars(spark, sf), rules)


@query("t2_unique_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def t2(spark, sf):
    return quality.duplicate_keys(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("t2_unique_ticks", "SELECT copies, count(*) AS keys FROM (SELECT event_type, ts, count(*) AS copies FROM events GROUP BY 1, 2) GROUP BY 1")
def t2_ticks(spark, sf):
    """How often each (event_type, ts) occurs: once, which lets bars order by time alone."""
    e = load(spark, sf, "events").groupBy("event_type", "ts").agg(F.count(F.lit(1)).alias("copies"))
    return e.groupBy("copies").agg(F.count(F.lit(1)).alias("keys"))


@query("t3_ohlc_consistency", cte("bars") + """
SELECT 'low_not_above' AS rule, count(*) FILTER (WHERE NOT low <= least(open, high, close)) AS violations FROM bars
UNION ALL SELECT 'high_not_below', count(*) FILTER (WHERE NOT high >= greatest(open, close)) FROM bars""")
def t3(spark, sf):
    return quality.rule_counts(bars(spark, sf), quality.ohlc_rules())


@query("t4_monotonic_time", """SELECT o_orderpriority, count(*) FILTER (WHERE p > o_orderdate) AS reversals, count(*) AS n FROM (
  SELECT *, lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1""")
def t4(spark, sf):
    return quality.time_reversals(load(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate"),
                                  ["o_orderpriority"], ["o_orderkey"], "o_orderdate")


@query("t5_roll_invariants", cte("ticks", **ROLL_SQL, hb="""SELECT root, session, contract_id, CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS bar_ts,
    arg_max(price, seq) AS close FROM c GROUP BY 1, 2, 3, 4""") + """
SELECT 'midnight_bars_spoiled' AS rule, count(*) FILTER (WHERE abs(close * factor * 1.01 - close * factor) > 1e-9 * abs(close * factor * 1.01)) AS violations
  FROM hb JOIN fa USING (root, session) WHERE contract_id = effective AND hour(bar_ts) = 0
UNION ALL SELECT 'adjusted_is_raw_times_factor' AS rule, CAST(0 AS BIGINT) AS violations
UNION ALL SELECT 'newest_factor_is_one', count(*) FILTER (WHERE abs(f - 1) > 1e-12) FROM (SELECT arg_max(factor, session) AS f FROM fa GROUP BY root)
UNION ALL SELECT 'rolls_chain', count(*) FILTER (WHERE p <> old) FROM (SELECT old, lag(new_id) OVER (PARTITION BY root ORDER BY session) AS p FROM evt)
UNION ALL SELECT 'one_bar_per_step', count(*) FROM (SELECT root, session, contract_id, CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS b, count(DISTINCT session) AS k FROM c GROUP BY 1, 2, 3, 4) WHERE k > 1""")
def t5(spark, sf):
    """Counts of broken promises; bars whose close is spoiled on purpose are found by the first of them."""
    s = roll_steps(spark, sf)
    midnight = F.hour("bar_ts") == 0
    spoiled = s["bars"].withColumn("close", F.when(midnight, F.col("close") * 1.01).otherwise(F.col("close")))
    found = quality.roll_invariants(spoiled, s["factors"], s["events"]).filter("rule = 'adjusted_is_raw_times_factor'")
    return quality.roll_invariants(s["bars"], s["factors"], s["events"]).unionByName(
        found.withColumn("rule", F.lit("midnight_bars_spoiled")))


@query("t6_roll_codes", """SELECT code, count(*) AS n FROM (SELECT upper(substr(event_type, 1, 1)) AS code FROM events) WHERE code NOT IN ('V', 'C', 'E') GROUP BY 1""")
def t6(spark, sf):
    allowed = spark.createDataFrame([("V",), ("C",), ("E",)], "code string")
    return quality.codes_outside(load(spark, sf, "events").select(F.upper(F.substring("event_type", 1, 1)).alias("code")), "code", allowed)


@query("t6_adjacent_years", """WITH y AS (SELECT DISTINCT o_custkey % 400 AS code, year(o_orderdate) AS y FROM orders)
SELECT code, count(*) FILTER (WHERE y - p = 1) AS adjacent, count(*) AS years FROM (SELECT *, lag(y) OVER (PARTITION BY code ORDER BY y) AS p FROM y) GROUP BY 1""")
def t6_years(spark, sf):
    d = load(spark, sf, "orders").withColumn("code", F.col("o_custkey") % 400)
    return quality.adjacent_year_codes(d, "code", F.year("o_orderdate"))


@query("t7_drift_alert", KS_SQL + """SELECT "column", d, p_adj, p_adj < 1e-6 AS alert FROM r""", f8="d p_adj")
def t7(spark, sf):
    d, third = ks_input(spark, sf)
    return inf.ks_two_sample(d, ["l_discount", "l_extendedprice", "l_quantity"], third, 1e-6).select("column", "d", "p_adj", "alert")


@query("t8_provenance", """
WITH h AS (SELECT sha256(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), o_orderstatus)) AS d FROM orders)
SELECT 'orders' AS dataset, '2026-01-01' AS snapshot, 'r1' AS run_id, sha256('a.csv' || chr(10) || 'b.csv') AS sources_hash, count(*) AS row_count,
  concat_ws('-', CAST(sum(CAST(('0x' || substr(d, 1, 15)) AS BIGINT)::HUGEINT) % 18446744073709551616 AS VARCHAR), CAST(sum(CAST(('0x' || substr(d, 16, 15)) AS BIGINT)::HUGEINT) % 18446744073709551616 AS VARCHAR)) AS frame_hash FROM h""")
def t8(spark, sf):
    return quality.provenance_record(load(spark, sf, "orders"), "orders", "2026-01-01", ["o_orderkey", "o_custkey", "o_orderstatus"],
                                     ["b.csv", "a.csv"], "r1")


# --- registry --------------------------------------------------------------------

def _numbered(fn):
    from tapeloom.operators.scan import number_rows

    return lambda panel: fn(number_rows(panel, ["symbol"], ["bar_ts"], chunk=F.trunc("bar_ts", "MM")))


RV = registry.register_feature(registry.Feature(
    "rv", 1, ("symbol", "bar_ts", "close"), 12, ("rv_v1",), ("rv_v1",), _numbered(lambda d: feat.rv_realized(d, 12))))
PARK = registry.register_feature(registry.Feature(
    "parkinson", 1, ("symbol", "bar_ts", "high", "low"), 12, ("parkinson_v1",), ("parkinson_v1",),
    _numbered(lambda d: feat.rv_parkinson(d, 12))))
OFI = registry.register_feature(registry.Feature(
    "ofi", 1, ("symbol", "bar_ts", "close", "volume"), 12, ("ofi_v1",), ("ofi_v1",), _numbered(lambda d: feat.ofi_tick_rule(d, 12))))
SKEW = registry.register_feature(registry.Feature(
    "skew", 1, ("symbol", "bar_ts", "close"), 24, ("skew_v1",), ("skew_v1",), _numbered(lambda d: feat.realized_skew(d, 24))))
NOW = "2024-01-15 12:00:00"


@query("m1_feature_panel", cte("rets") + f"""
SELECT symbol, bar_ts, CASE WHEN count(r) OVER a = 12 THEN sum(r * r) OVER a END AS rv_v1,
  CASE WHEN count(*) OVER a = 12 THEN avg(pow(ln(high / low), 2)) OVER a / (4 * ln(2)) END AS parkinson_v1
FROM rets WHERE bar_ts <= TIMESTAMP '{NOW}' WINDOW a AS ({W} ROWS 11 PRECEDING)""", f8="rv_v1 parkinson_v1")
def m1(spark, sf):
    from tapeloom.operators.joins import outer_merge

    now = F.lit(NOW).cast("timestamp")
    frames = [registry.compute_feature(registry.lookup_feature(k), bars(spark, sf), now) for k in ("rv@v1", "parkinson@v1")]
    return outer_merge(frames, ["symbol", "bar_ts"])


# Two features that know too much: the next close, and the distance from a mean over all time. They are not registered.
PEEK = registry.Feature("peek", 1, ("symbol", "bar_ts", "close"), 0, ("peek_v1",), ("peek_v1",), _numbered(
    lambda d: rolling(d, ["symbol"], 0, lambda x, w: x.withColumn("peek_v1", F.lead("close").over(w)), lookahead=1)))
CENTRED = registry.Feature("centred", 1, ("symbol", "bar_ts", "close"), 0, ("centred_v1",), (), lambda d: d.join(
    d.groupBy("symbol").agg(F.avg("close").alias("_m")), "symbol").withColumn("centred_v1", F.col("close") - F.col("_m")))


def _pit_sql(name, value):
    """Rows in which a value over all bars and over those up to NOW differ, both ways."""
    part = f"SELECT symbol, bar_ts, round({value}, 9) AS v FROM"
    known = f"(SELECT * FROM rets WHERE bar_ts <= TIMESTAMP '{NOW}')"
    full = f"SELECT * FROM ({part} rets) WHERE bar_ts <= TIMESTAMP '{NOW}'"
    return f"""SELECT '{name}' AS feature, (SELECT count(*) FROM (({full}) EXCEPT ALL ({part} {known}))) + (SELECT count(*) FROM (({part} {known}) EXCEPT ALL ({full}))) AS differences"""


@query("m2_pit_equality", cte("rets") + " UNION ALL ".join([
    _pit_sql("rv@v1", f"CASE WHEN count(r) OVER ({W} ROWS 11 PRECEDING) = 12 THEN sum(r * r) OVER ({W} ROWS 11 PRECEDING) END"),
    _pit_sql("peek@v1", f"lead(close) OVER ({W})"), _pit_sql("centred@v1", "close - avg(close) OVER (PARTITION BY symbol)"),
    "SELECT f, CAST(0 AS BIGINT) FROM (VALUES ('ofi@v1'), ('skew@v1')) AS t(f)"]))
def m2(spark, sf):
    """Differences between values from all bars and from those known by a time; the last two features leak and are found out."""
    now = F.lit(NOW).cast("timestamp")
    out = None
    for f in (*map(registry.lookup_feature, ("ofi@v1", "rv@v1", "skew@v1")), PEEK, CENTRED):
        d = registry.pit_differences(f, bars(spark, sf), now).agg(
            F.count(F.lit(1)).alias("differences")).select(F.lit(f.key).alias("feature"), "differences")
        out = d if out is None else out.unionByName(d)
    return out


@query("m3_null_counts", cte("rets") + f"""
SELECT 'rv_v1' AS "column", count(*) FILTER (WHERE k < 12) AS nulls, true AS may_be_null FROM (SELECT count(r) OVER ({W} ROWS 11 PRECEDING) AS k FROM rets)""")
def m3(spark, sf):
    f = registry.lookup_feature("rv@v1")
    return registry.null_counts(f, registry.compute_feature(f, bars(spark, sf)))


# --- models ----------------------------------------------------------------------

FEATURES = ["x1", "x2", "x3"]


def model_rows(spark, sf):
    d = load(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"),
        (F.col("l_extendedprice") / 1000).alias("y"), "l_shipdate", "l_orderkey")
    # Contiguous blocks of time.
    days = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date"))
    return d.withColumn("block", F.least(F.lit(4), F.greatest(F.lit(0), F.floor(days / 520))).cast("int"))


CELLS = {f"a{a}_l{l}": (a, l) for a in (0.01, 0.1) for l in (0.0, 0.5)}


def _sweep_sql():
    """The three coefficients after one pass, each from the newest values of the others."""
    out, new = [], {}
    for j in (1, 2, 3):
        others = " - ".join(f"g{min(j, k)}{max(j, k)} * {new.get(k, f'b{k}')}" for k in (1, 2, 3) if k != j)
        r = f"(c{j} - {others})"
        out.append(f"SELECT *, sign{r} * greatest(abs({r}) - alpha * l1, 0) / (1 + alpha * (1 - l1)) AS n{j}")
        new[j] = f"n{j}"
    return out


_N1, _N2, _N3 = _sweep_sql()
Y1_SQL = f"""WITH RECURSIVE d AS (SELECT l_quantity::DOUBLE AS x1, l_discount::DOUBLE AS x2, l_tax::DOUBLE AS x3, l_extendedprice / 1000 AS y,
    CAST(least(4, greatest(0, floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 520))) AS INTEGER) AS block FROM lineitem),
  t AS MATERIALIZED (SELECT f.k, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, stddev_pop(x3) AS s3, corr(x1, x2) AS g12, corr(x1, x3) AS g13,
    corr(x2, x3) AS g23, covar_pop(x1, y) / stddev_pop(x1) AS c1, covar_pop(x2, y) / stddev_pop(x2) AS c2, covar_pop(x3, y) / stddev_pop(x3) AS c3
    FROM range(0, 5) AS f(k) JOIN d ON abs(d.block - f.k) > 1 GROUP BY 1),
  cl(cell, alpha, l1) AS (VALUES {", ".join(f"('{n}', {a}::DOUBLE, {l}::DOUBLE)" for n, (a, l) in CELLS.items())}),
  b(cell, k, i, b1, b2, b3) AS (SELECT cell, k, 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM cl, t UNION ALL SELECT cell, k, i + 1, n1, n2, n3 FROM (
    {_N3} FROM ({_N2} FROM ({_N1} FROM (SELECT b.*, alpha, l1, g12, g13, g23, c1, c2, c3 FROM b JOIN t USING (k) JOIN cl USING (cell) WHERE i < 100))))),
  e AS (SELECT cell, b.k, avg(pow(y - my - b1 / s1 * (x1 - m1) - b2 / s2 * (x2 - m2) - b3 / s3 * (x3 - m3), 2)) AS mse
    FROM b JOIN t ON t.k = b.k JOIN d ON d.block = b.k WHERE i = 100 GROUP BY 1, 2),
  a AS (SELECT cell, avg(mse) AS mse FROM e GROUP BY 1)
SELECT cell, mse, row_number() OVER (ORDER BY mse, cell) = 1 AS best FROM a"""


@query("y1_elastic_net", Y1_SQL, f8="mse")
def y1(spark, sf):
    """Grid of elastic-net cells scored on purged time blocks."""
    return models.elastic_net_grid(model_rows(spark, sf), FEATURES, "y", F.col("block"), 5, CELLS)[1]


@query("y2_boosted_trees")
def y2(spark, sf):
    """Grid of boosted-tree cells scored on purged time blocks."""
    makers = {f"t{t}_d{d}": (lambda t=t, d=d: models.boosted_trees(t, d)) for t, d in ((10, 3), (20, 3))}
    return models.purged_grid_search(model_rows(spark, sf), FEATURES, "y", F.col("block"), 5, makers)[1]


# Steps by the largest least mean: over all starts at or before a score, of all ends at or after it.
ISO_SQL = f"""WITH s AS (SELECT doc_id, least(n_chars / 4000.0, 1.0)::DOUBLE AS p, quality::DOUBLE AS d, CAST(({H('doc_id', '0', 3)}) % 4 AS INTEGER) AS block
    FROM documents JOIN labels USING (doc_id)),
  c AS (SELECT f.k, p AS x, count(*) AS n, sum(d) AS s FROM s JOIN range(1, 4) AS f(k) ON s.block < f.k GROUP BY 1, 2),
  u AS (SELECT k, x, row_number() OVER w AS i, sum(n) OVER w AS w1, sum(s) OVER w AS s1, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0,
    coalesce(sum(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM c WINDOW w AS (PARTITION BY k ORDER BY x)),
  m AS (SELECT a.k, a.i AS a, z.i AS z, min((z.s1 - a.s0) / (z.w1 - a.w0)) OVER (PARTITION BY a.k, a.i ORDER BY z.i DESC) AS least FROM u a JOIN u z ON z.k = a.k AND z.i >= a.i),
  v AS (SELECT k, x, v FROM u JOIN (SELECT k, z AS i, max(least) AS v FROM m GROUP BY 1, 2) USING (k, i)),
  q AS (SELECT s.*, (SELECT max(x) FROM v WHERE v.k = s.block AND v.x <= s.p) AS xa, (SELECT min(x) FROM v WHERE v.k = s.block AND v.x >= s.p) AS xz FROM s WHERE block >= 1),
  cal AS (SELECT q.doc_id, q.p, q.d, q.block, CASE WHEN xa IS NULL THEN vz.v WHEN xz IS NULL OR xa = xz THEN va.v ELSE va.v + (vz.v - va.v) * (q.p - xa) / (xz - xa) END AS calibrated
    FROM q LEFT JOIN v va ON va.k = q.block AND va.x = q.xa LEFT JOIN v vz ON vz.k = q.block AND vz.x = q.xz)"""


def calibrated(spark, sf):
    s = scores(spark, sf).withColumns({"d": F.col("d").cast("double"), "p": F.col("p").cast("double")})
    return models.isotonic_out_of_fold(s, "p", "d", (counter_hash(F.col("doc_id"), F.lit(0), 3) % 4).cast("int"), 4)


@query("y3_calibrated_scores", ISO_SQL + " SELECT doc_id, block, p, calibrated FROM cal", f8="p calibrated", i8="block")
def y3_scores(spark, sf):
    """Every score with its value by the steps of the earlier blocks."""
    return calibrated(spark, sf).select("doc_id", "block", "p", "calibrated")


@query("y3_isotonic_calibration", ISO_SQL + """,
  cm AS (SELECT avg(d) AS clim FROM cal), two AS (SELECT 'raw' AS score, p AS v, d FROM cal UNION ALL SELECT 'calibrated', calibrated, d FROM cal),
  br AS (SELECT score, count(*) AS n, avg(pow(v - d, 2)) AS brier, 1 - avg(pow(v - d, 2)) / avg(pow(clim - d, 2)) AS skill FROM two, cm GROUP BY 1),
  ed AS (SELECT quantile_cont(calibrated, [i / 10.0 for i in range(0, 10)]) AS edges FROM cal),
  bn AS (SELECT calibrated, d, list_sum([(calibrated >= e)::INT for e in edges]) AS bin FROM cal, ed),
  gr AS (SELECT bin, avg(calibrated) AS mp, avg(d) AS md FROM bn GROUP BY 1 HAVING count(*) >= 5),
  sl AS (SELECT CASE WHEN count(*) >= 3 THEN regr_slope(md, mp) END AS slope, count(*) AS bins FROM gr)
SELECT * FROM br, sl""", f8="brier skill slope", digits=5)
def y3(spark, sf):
    """Brier score and reliability of scores calibrated on earlier blocks only."""
    cal = stored(calibrated(spark, sf))
    raw = brier_skill(cal, [], "p", "d").select(F.lit("raw").alias("score"), "n", "brier", "skill")
    new = brier_skill(cal, [], "calibrated", "d").select(F.lit("calibrated").alias("score"), "n", "brier", "skill")
    return raw.unionByName(new).crossJoin(reliability_slope(cal, "calibrated", "d", 10))


@F.pandas_udf(T.DoubleType())
def iqr(v: pd.Series) -> float:
    v = v.dropna()
    return float(v.quantile(0.75) - v.quantile(0.25)) if len(v) else None


@query("y4_pandas_window_function", cte("bars") + f"""
SELECT symbol, bar_ts, CASE WHEN count(*) OVER a >= 5 THEN quantile_cont(close, 0.75) OVER a - quantile_cont(close, 0.25) OVER a END AS iqr
FROM bars WINDOW a AS ({W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""", f8="iqr")
def y4(spark, sf):
    return feat.rolling_apply_pit(numbered_bars(spark, sf), 12, iqr, "close", "iqr", 5).select("symbol", "bar_ts", "iqr")


@query("y5_fold_callbacks", WF_SQL + """
SELECT fold_id, idx, (SELECT avg(t.y) FROM mem t WHERE t.fold_id = m.fold_id AND t.role = 'train') AS yhat, y FROM mem m WHERE role = 'test'""", f8="yhat y", digits=9)
def y5(spark, sf):
    def fit(train):
        return train.groupBy("fold_id").agg(F.avg("y").alias("yhat"))

    def predict(model, test):
        return test.join(model, "fold_id").select("fold_id", "idx", "yhat", "y")

    return splits.run_folds(sessions(spark, sf), wf_segments(spark, sf), fit, predict)


@query("y6_fitness_callback", cte("ledger") + """, g AS (SELECT i, m FROM (VALUES (0, 0.5), (1, 1.0), (2, 2.0)) AS t(i, m)),
  f AS (SELECT symbol, i, m, avg(r_multiple * m) - 0.2 * var_samp(r_multiple * m) AS fit FROM ledger, g GROUP BY 1, 2, 3)
SELECT symbol, fit AS fitness, m AS multiplier FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fit DESC, i) = 1""", f8="fitness multiplier")
def y6(spark, sf):
    from tapeloom.operators.bootstrap import multiplier_by_grid
    from tapeloom.plans.inputs import ledger

    return multiplier_by_grid(ledger(spark, sf), ["symbol"], "r_multiple", [0.5, 1.0, 2.0],
                              lambda x: F.avg(x) - 0.2 * F.var_samp(x))


@query("y7_grid_expansion", cte("returns") + """
SELECT symbol, h, k, count(*) FILTER (WHERE trades >= h) AS n, sum(ret * k) AS total FROM returns, range(1, 4) AS t(h), (VALUES (0.5::DOUBLE), (1.0), (1.5)) AS v(k) GROUP BY 1, 2, 3""", f8="k total")
def y7(spark, sf):
    from tapeloom.operators.joins import cross_grid
    from tapeloom.plans.inputs import returns

    grid = spark.range(1, 4).select(F.col("id").alias("h"), F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 1.5)])).alias("k"))
    return cross_grid(returns(spark, sf), grid).groupBy("symbol", "h", "k").agg(
        F.count_if(F.col("trades") >= F.col("h")).alias("n"), F.sum(F.col("ret") * F.col("k")).alias("total"))
