"""Ordered scans against plain loops, with blocks far shorter than the series."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.operators import scan, trend
from tapeloom.operators.scan import exact_quantiles, full, number_rows, prefix, recurrence, rolling, running


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    rows = []
    # One key holds most rows.
    for key, n in (("a", 3), ("b", 1), ("hot", 211)):
        for i in range(n):
            v = None if rng.random() < 0.2 else float(rng.normal())
            rows.append((key, int(i * 3 + rng.integers(0, 3)), v))
    return pd.DataFrame(rows, columns=["k", "t", "v"])


@pytest.fixture()
def numbered(spark, series):
    df = spark.createDataFrame(series.sample(frac=1, random_state=1), "k string, t long, v double")
    return number_rows(df, ["k"], ["t"])


def test_number_rows_range(numbered, series):
    got = numbered.toPandas().sort_values(["k", "t"])
    want = series.sort_values(["k", "t"]).groupby("k").cumcount()
    assert (got["pos"].to_numpy() == want.to_numpy()).all()


def test_number_rows_chunk(spark, series):
    df = spark.createDataFrame(series, "k string, t long, v double")
    got = number_rows(df, ["k"], ["t"], chunk=F.floor(F.col("t") / 50)).toPandas().sort_values(["k", "t"])
    want = series.sort_values(["k", "t"]).groupby("k").cumcount()
    assert (got["pos"].to_numpy() == want.to_numpy()).all()


def test_rolling_over_block_edges(numbered, series):
    def build(d, w):
        f = w.rowsBetween(-4, 0)
        return d.withColumns({"m": F.max("v").over(f), "g": full(F.sum("v").over(f), 5, F.col("v"), f),
                              "ahead": F.lead("t", 2).over(w), "behind": F.lag("t", 3).over(w)})
    got = rolling(numbered, ["k"], 4, build, lookahead=2, block=9).toPandas().sort_values(["k", "pos"])
    assert len(got) == len(series)
    for k, g in got.groupby("k"):
        src = series[series.k == k].sort_values("t").reset_index(drop=True)
        r = src.v.rolling(5, min_periods=1)
        np.testing.assert_allclose(g.m.to_numpy(), r.max().to_numpy())
        want = src.v.rolling(5, min_periods=5).sum()
        np.testing.assert_allclose(g.g.to_numpy(), want.to_numpy())
        np.testing.assert_allclose(g.ahead.to_numpy(dtype=float), src.t.shift(-2).to_numpy())
        np.testing.assert_allclose(g.behind.to_numpy(dtype=float), src.t.shift(3).to_numpy())


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_prefix_all_functions(numbered, series, block):
    specs = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")),
             "n": ("count", F.col("v")), "last": ("last", F.col("v"))}
    inc = prefix(numbered, ["k"], specs, block=block).toPandas().sort_values(["k", "pos"])
    exc = prefix(numbered, ["k"], specs, block=block, inclusive=False).toPandas().sort_values(["k", "pos"])
    back = prefix(numbered, ["k"], {"nxt": ("last", F.col("v"))}, block=block, reverse=True).toPandas().sort_values(["k", "pos"])
    for k, g in inc.groupby("k"):
        v = series[series.k == k].sort_values("t").v.reset_index(drop=True)
        want = v.ffill()
        np.testing.assert_allclose(g["last"].to_numpy(dtype=float), want.to_numpy())
        np.testing.assert_allclose(g.n.to_numpy(dtype=float), v.notna().cumsum().to_numpy())
        csum = v.fillna(0).cumsum().where(v.notna().cumsum() > 0)
        np.testing.assert_allclose(g.s.to_numpy(dtype=float), csum.to_numpy(), atol=1e-12)
        np.testing.assert_allclose(g.hi.to_numpy(dtype=float), v.cummax().ffill().to_numpy())
        np.testing.assert_allclose(g.lo.to_numpy(dtype=float), v.cummin().ffill().to_numpy())
        e = exc[exc.k == k]
        np.testing.assert_allclose(e["last"].to_numpy(dtype=float), want.shift(1).to_numpy())
        np.testing.assert_allclose(e.s.to_numpy(dtype=float), csum.shift(1).to_numpy(), atol=1e-12)
        np.testing.assert_allclose(back[back.k == k].nxt.to_numpy(dtype=float), v.bfill().to_numpy())


@pytest.mark.parametrize("rates", [[0.3], [13 / 14], [0.995], [0.1, 0.5, 0.97, 0.999], [0.999, 1e-60], [30 / 31, 60 / 61]])
def test_recurrence_against_loop(spark, rates):
    rng = np.random.default_rng(5)
    x = rng.normal(size=2500) + 1
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, pos long, x double")
    got = recurrence(df, ["k"], {f"y{j}": (a, F.col("x")) for j, a in enumerate(rates)}).orderBy("pos").toPandas()
    assert list(got.columns) == ["k", "pos", "x", *[f"y{j}" for j in range(len(rates))]]
    for j, a in enumerate(rates):
        want, y = [], 0.0
        for v in x:
            y = a * y + v
            want.append(y)
        np.testing.assert_allclose(got[f"y{j}"].to_numpy(), want, rtol=1e-10, atol=1e-9)


def test_recurrence_carries_over_many_blocks(spark):
    # Six blocks of the slowest rate would be 180,000 rows; 0.97 has as many in 6,000.
    df = spark.range(6000).select(F.lit("s").alias("k"), F.col("id").alias("pos"), F.lit(1.0).alias("x"))
    last = recurrence(df, ["k"], {"slow": (0.9999, F.col("x")), "mid": (0.97, F.col("x")), "fast": (0.1, F.col("x"))}).filter("pos = 5999").first()
    for name, a in (("slow", 0.9999), ("mid", 0.97), ("fast", 0.1)):
        assert last[name] == pytest.approx((1 - a ** 6000) / (1 - a), rel=1e-10)


def test_exact_quantiles(spark):
    v = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    df = spark.createDataFrame([("x", a) for a in v], "k string, v double")
    r = exact_quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.95}).first()
    assert [r["lo"], r["mid"], r["hi"]] == pytest.approx(list(np.quantile(v, [0.1, 0.5, 0.95])))


def _greedy(events, h):
    out, last = [], {1: -10**9, -1: -10**9}
    for i, e in enumerate(events):
        if e and i - last[e] > h:
            last[e] = i
            out.append(e)
        else:
            out.append(0)
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 1, -1]), min_size=30, max_size=80), st.integers(1, 9))
def test_first_fire_against_loop(events, h):
    from tapeloom.session import local_session

    spark = local_session(4, 4)
    df = spark.createDataFrame([("s", i, e) for i, e in enumerate(events)], "symbol string, pos long, event int")
    got = [r["fired"] for r in trend.first_fire(df, h, block=11).orderBy("pos").collect()]
    assert got == _greedy(events, h)


def test_small_blocks_leave_queries_unchanged(spark, duck, monkeypatch):
    """Queries keep their oracle results when a series is cut into many blocks."""
    from tests.test_oracle import compare

    monkeypatch.setattr(scan, "BLOCK", 40)
    for name in ("e1_rv_realized", "e4_ofi_tickrule", "e13_rolling_apply_pit", "e19_adx_side", "e23_body_overlap", "e25_wick_reversal",
                 "c4_asof_join", "c5_news_window_join", "c5_band_counts", "c7_regular_grid", "l1_triple_barrier", "r3_overlap_same_side",
                 "r4_concurrent_position_cap", "r6_daily_breaker", "b18_floored_equity", "f8_subtract_ranges", "q9_ks_benjamini_hochberg",
                 "q26_annual_return_pareto"):
        compare(spark, duck, name)


def test_positions_join_their_starts_without_another_shuffle(spark):
    """Every row was shuffled once more to meet a few starts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).selectExpr("id % 3 AS k", "id * 7 % 1000 AS v")
        plan = number_rows(df, ["k"], ["v"])._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("block", [2, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_by_chunks_and_by_blocks(spark, series, monkeypatch, block, inclusive):
    monkeypatch.setattr(scan, "BLOCK", block)
    df = spark.createDataFrame(series, "k string, t long, v double")
    specs = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "n": ("count", F.col("v"))}
    got = running(df, ["k"], ["t"], specs, F.floor(F.col("t") / 50), inclusive)
    assert set(got.columns) == {"k", "t", "v", *specs}
    got = got.toPandas().sort_values(["k", "t"])
    assert len(got) == len(series)
    for k, g in got.groupby("k"):
        v = series[series.k == k].sort_values("t").v.reset_index(drop=True)
        some = v.notna().cumsum()
        want = {"s": v.fillna(0).cumsum().where(some > 0), "hi": v.cummax().ffill(), "lo": v.cummin().ffill(), "n": some}
        for name, w in want.items():
            if not inclusive:
                w = w.shift(1, fill_value=0) if name == "n" else w.shift(1)
            np.testing.assert_allclose(g[name].to_numpy(dtype=float), w.to_numpy(dtype=float), atol=1e-12)


def test_trades_of_short_days_are_shuffled_once(spark):
    """Trades were sorted, stored and shuffled again to get a running sum."""
    from tapeloom.operators import joins, risk

    t = spark.range(200).selectExpr("id AS k1", "'s' AS symbol", "1 AS side", "1.0D AS pnl", "current_date() AS session",
                                    "timestamp_seconds(id * 3600) AS entry_ts", "timestamp_seconds(id * 3600 + 9000) AS exit_ts")
    order = ["entry_ts", "k1"]
    for d in (joins.overlap_counts(t, ["symbol"], ["k1"]), risk.inventory_breaches(t, ["symbol"], F.lit(1.0), F.lit(2.0), ["k1"]),
              risk.same_side_overlaps(t, order), risk.circuit_breaker(t, F.col("session"), order, -0.02, 100.0)):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        # Trades come from their source; what is stored has no key of a trade.
        assert "Range (0, 200" in plan and not any("k1#" in line for line in plan.split("\n") if "LogicalRDD" in line)
    assert [r["open_before"] for r in joins.overlap_counts(t, ["symbol"], ["k1"]).orderBy("k1").collect()] == [0, 1, *[2] * 198]
