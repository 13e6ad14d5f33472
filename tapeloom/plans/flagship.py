"""Trend-following basket, walk-forward: 72 parameter cells, the best one of each
training window measured on the test window after it."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.operators import basket as bk
from tapeloom.operators import inference as inf
from tapeloom.operators import splits
from tapeloom.operators.bootstrap import path_drawdown
from tapeloom.operators.scan import number_rows, recurrence
from tapeloom.operators.sets import best_row
from tapeloom.plans.inputs import daily
from tapeloom.plans.registry import cte, query
from tapeloom.session import cut_lineage

# The parameter grid and the fold sizes.
LOOKBACKS, COMS = (126, 252), (30, 60)
TARGETS, KELLY = (0.05, 0.10, 0.15), (0.25, 0.5, 1.0, 1.5, 2.0, 2.5)
CAP, TRAIN, TEST, EMBARGO = 0.02, 252, 60, 1
CELLS = [(i, lb, com, vt, k) for i, (lb, com, vt, k) in enumerate(
    (lb, com, vt, k) for lb in LOOKBACKS for com in COMS for vt in TARGETS for k in KELLY)]


def held_inputs(closes):
    """Per symbol and session: return, and the signals and volatilities of the session before.

    A weight depends on nothing else, so lags are taken once, before the grid
    multiplies the rows.
    """
    d = bk.daily_returns(closes)
    for lb in LOOKBACKS:
        d = bk.tsmom(d, lb, f"s{lb}")
    d = number_rows(d.withColumn("r", F.coalesce("r", F.lit(0.0))), ["symbol"], ["session"], chunk=F.trunc("session", "year"))
    x, first = F.col("r") * F.col("r"), F.col("pos") == 0
    d = recurrence(d, ["symbol"], {
        f"v{c}": (1 - 1 / (1 + c), F.when(first, x).otherwise(x / (1 + c))) for c in COMS})
    days = bk.session_index(d)
    d = d.join(F.broadcast(days), "session")
    w = Window.partitionBy("symbol").orderBy("day")
    prev = F.lag("day").over(w) == F.col("day") - 1
    cols = {f"h{lb}": F.when(prev, F.lag(f"s{lb}").over(w)) for lb in LOOKBACKS}
    # Volatility known at t-1 is that of the variance at t-2 (the first value stands in).
    for c in COMS:
        v = F.coalesce(F.lag(f"v{c}", 2).over(w), F.lag(f"v{c}", 1).over(w))
        cols[f"u{c}"] = F.when(prev, F.sqrt(v) * F.sqrt(F.lit(252.0)))
    return d.withColumns(cols).select("symbol", "session", "day", "r", *cols)


def basket_returns(closes):
    """(cell, day, session, ret): every cell in one grouped average."""
    spark = closes.sparkSession
    grid = F.broadcast(spark.createDataFrame(CELLS, "cell int, lookback int, com int, target double, kelly double"))
    d = held_inputs(closes).crossJoin(grid)
    sig = F.when(F.col("lookback") == 126, F.col("h126")).otherwise(F.col("h252"))
    vol = F.when(F.col("com") == 30, F.col("u30")).otherwise(F.col("u60"))
    w = F.coalesce(bk.vol_target_weight(sig, vol, F.col("target"), F.col("kelly"), F.lit(CAP)), F.lit(0.0))
    return d.groupBy("cell", "day", "session").agg(F.avg(w * F.col("r")).alias("ret"))


def walk_forward(closes):
    spark = closes.sparkSession
    rets = cut_lineage(basket_returns(closes).withColumn("idx", (F.col("day") - 1).cast("long")))
    n = rets.agg(F.max("day")).first()[0] or 0
    seg = splits.session_folds(spark, n, TRAIN, TEST, EMBARGO)
    m = splits.members(rets, seg)
    # Cells whose weights are all capped earn the same; rounding lets the first one win
    # whatever the order of summation.
    train = inf.mppm(m.filter("role = 'train'"), ["fold_id", "cell"], "ret").select(
        "fold_id", "cell", F.round("mppm", 9).alias("mppm_train"))
    best = best_row(train, ["fold_id"], "mppm_train", ["cell"], ["cell"])
    oos = m.filter("role = 'test'").join(F.broadcast(best), ["fold_id", "cell"])
    perf = inf.sharpe(oos, ["fold_id"], "ret").join(
        path_drawdown(oos, ["fold_id"], "ret", "day").select("fold_id", "total", "max_dd"), "fold_id")
    grid = F.broadcast(spark.createDataFrame(CELLS, "cell int, lookback int, com int, target double, kelly double"))
    return best.join(grid, "cell").join(perf, "fold_id").select(
        "fold_id", "cell", "lookback", "com", "target", "kelly", "mppm_train", "n", "total", "sharpe", "max_dd")


def _ew(com):
    return f"""SELECT symbol, session, i, r * r AS v FROM d WHERE i = 1 UNION ALL
    SELECT d.symbol, d.session, d.i, e.v * (1 - 1 / {com + 1}.0::DOUBLE) + d.r * d.r / {com + 1}.0::DOUBLE FROM ew{com} e JOIN d ON d.symbol = e.symbol AND d.i = e.i + 1"""


_GRID = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {lb}, {c}, {t}::DOUBLE, {k}::DOUBLE)" for i, lb, c, t, k in CELLS) + ") AS g(cell, lookback, com, target, kelly)"
SQL = cte("daily", d0="""SELECT symbol, session, ln(close / lag(close) OVER w) AS r0, row_number() OVER w AS i, dense_rank() OVER (ORDER BY session) AS day FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY session)""",
  d="SELECT *, coalesce(r0, 0) AS r FROM d0", ew30=_ew(30), ew60=_ew(60),
  s="""SELECT d.*, a.v AS v30, b.v AS v60, CASE WHEN count(r0) OVER l1 = 126 THEN sign(sum(r0) OVER l1) ELSE 0 END AS s126, CASE WHEN count(r0) OVER l2 = 252 THEN sign(sum(r0) OVER l2) ELSE 0 END AS s252
    FROM d JOIN ew30 a USING (symbol, i) JOIN ew60 b USING (symbol, i) WINDOW l1 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING), l2 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)""",
  v="""SELECT *, sqrt(coalesce(lag(v30) OVER w, v30)) * sqrt(252) AS u30, sqrt(coalesce(lag(v60) OVER w, v60)) * sqrt(252) AS u60 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY i)""",
  g=_GRID,
  wt=f"""SELECT symbol, day, session, r, cell, greatest(-{CAP}, least({CAP}, CASE WHEN CASE com WHEN 30 THEN u30 ELSE u60 END > 0
      THEN target / CASE com WHEN 30 THEN u30 ELSE u60 END * CASE lookback WHEN 126 THEN s126 ELSE s252 END * kelly ELSE 0 END)) AS w FROM v, g""",
  h="SELECT *, CASE WHEN lag(day) OVER x = day - 1 THEN lag(w) OVER x ELSE 0 END AS held FROM wt WINDOW x AS (PARTITION BY symbol, cell ORDER BY day)",
  b="SELECT cell, day, session, avg(held * r) AS ret FROM h GROUP BY 1, 2, 3",
  f=f"SELECT unnest(range(0, (max(day) - {TRAIN + EMBARGO + TEST}) // {TEST} + 1)) AS fold_id FROM b",
  t=f"""SELECT fold_id, cell, round(avg(ln(1 + ret)) * 252, 9) AS mppm_train FROM f JOIN b ON day > fold_id * {TEST} AND day <= fold_id * {TEST} + {TRAIN} GROUP BY 1, 2 HAVING min(ret) > -1""",
  bs="SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY mppm_train DESC, cell) = 1",
  o=f"""SELECT fold_id, cell, mppm_train, b.day, b.ret, sum(b.ret) OVER (PARTITION BY fold_id ORDER BY b.day) AS c FROM bs JOIN b USING (cell) WHERE b.day > fold_id * {TEST} + {TRAIN + EMBARGO} AND b.day <= fold_id * {TEST} + {TRAIN + EMBARGO + TEST}""",
  dd="SELECT *, 1 - exp(c - greatest(0, max(c) OVER (PARTITION BY fold_id ORDER BY day))) AS x FROM o") + """
SELECT fold_id, cell, lookback, com, target, kelly, mppm_train, count(*) AS n, sum(ret) AS total, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, max(x) AS max_dd
FROM dd JOIN g USING (cell) GROUP BY 1, 2, 3, 4, 5, 6, 7"""


@query("flagship_trend_basket", SQL, f8="target kelly mppm_train total sharpe max_dd", i8="fold_id cell lookback com")
def flagship(spark, sf):
    return walk_forward(daily(spark, sf))
