"""Hand-worked cases."""

import datetime as dt
import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import clock, numeric
from tapeloom.functions.hashing import counter_hash, frame_fingerprint
from tapeloom.operators import archetypes, bars, bootstrap, inference, joins, labels, metrics, quality, registry, risk, rolls, sets, splits, trend
from tapeloom.operators.scan import number_rows
from tapeloom.sources import files, pages
from tapeloom.streaming import streams
from tapeloom.streaming.state import Detector, StepUp, fresh, observe


def ts(text):
    return dt.datetime.fromisoformat(text)


# --- clock -----------------------------------------------------------------------

@pytest.mark.parametrize("utc,phase", [
    ("2024-01-01 15:00:00", "HALT"),   # holiday
    ("2024-01-06 15:00:00", "HALT"),   # Saturday
    ("2024-01-07 22:59:59", "HALT"),   # Sunday before 17:00
    ("2024-01-07 23:00:00", "OVN"),
    ("2024-01-05 22:00:00", "HALT"),   # Friday 16:00
    ("2024-01-03 22:30:00", "HALT"),   # maintenance
    ("2024-01-03 14:30:00", "RTH"),
    ("2024-01-03 21:15:00", "ETH"),    # 15:15 is out
    ("2024-01-08 14:29:59", "OVN"),    # Monday before the open
    ("2024-07-03 13:30:00", "RTH"),    # summer time
    ("2024-03-29 13:15:00", "HALT"),   # early close 08:15
])
def test_session_of(spark, utc, phase):
    df = spark.createDataFrame([(ts(utc),)], "ts timestamp")
    assert df.select(clock.session_of("ts", {"2024-03-29": "08:15"})).first()[0] == phase


@pytest.mark.parametrize("utc,day", [
    ("2024-01-03 22:59:00", "2024-01-03"), ("2024-01-03 23:00:00", "2024-01-04"), ("2024-01-05 22:00:00", "2024-01-08"),
    ("2024-01-06 12:00:00", "2024-01-08"), ("2023-12-31 23:30:00", "2024-01-02"), ("2024-12-24 23:30:00", "2024-12-26")])
def test_trading_day(spark, utc, day):
    df = spark.createDataFrame([(ts(utc),)], "ts timestamp")
    assert str(df.select(clock.trading_day("ts")).first()[0]) == day


def test_energy_session_edges(spark):
    rows = [("2024-01-03 22:00:00", "ACTIVE"), ("2024-01-03 22:00:01", "MAINTENANCE_BREAK"), ("2024-01-03 23:00:00", "ACTIVE"),
            ("2024-01-05 22:00:00", "ACTIVE"), ("2024-01-05 22:00:01", "WEEKEND_CLOSED"), ("2024-01-07 23:00:00", "ACTIVE")]
    df = spark.createDataFrame([(ts(a), b) for a, b in rows], "ts timestamp, want string")
    assert df.filter(clock.energy_session("ts") != F.col("want")).count() == 0


def test_et_to_utc_follows_summer_time(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2024, 7, 31),)], "d date")
    got = [r[0].hour for r in df.select(clock.et_to_utc("d", 14, 0).alias("t")).collect()]
    assert got == [19, 18]


def test_month_code(spark):
    rows = [("ESH5", "H"), ("NQZ24", "Z"), ("MCLF5", "F"), ("H5", None), ("ESA5", None), ("ES", None), (" MGCG25 ", "G")]
    df = spark.createDataFrame(rows, "c string, want string")
    assert [r[0] for r in df.select(clock.month_code("c")).collect()] == [w for _, w in rows]


def test_root_symbol_prefers_long_prefix(spark):
    df = spark.createDataFrame([("MESH5",), ("ESH5",), ("XYZ",)], "c string")
    assert [r[0] for r in df.select(clock.root_symbol("c", files.ROOTS)).collect()] == ["MES", "ES", "XYZ"]


# --- bars and scalars --------------------------------------------------------------

def test_tick_on_the_edge_belongs_to_the_bar_that_ends_there(spark):
    df = spark.createDataFrame([("s", ts("2024-01-01 09:45:00"), 1.0, 1, 5), ("s", ts("2024-01-01 09:45:00.000001"), 2.0, 2, 5)],
                               "symbol string, ts timestamp, price double, seq long, size long")
    got = {str(r["bar_ts"]): r["close"] for r in bars.resample_ohlcv(df, 1).collect()}
    assert got == {"2024-01-01 09:45:00": 1.0, "2024-01-01 09:46:00": 2.0}


def test_log_ratio_of_bad_prices_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (-1.0, -2.0), (2.0, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(numeric.log_ratio("a", "b")).collect()]
    assert got[:3] == [None] * 3 and got[3] == pytest.approx(math.log(2))


def test_e_value(spark):
    df = spark.createDataFrame([(2.0, 1.5, 3.0), (0.5, 0.3, 0.8), (1.2, 0.9, 1.6)], "rr double, lo double, hi double")
    p, lim = numeric.e_value("rr", "lo", "hi")
    got = df.select(p.alias("p"), lim.alias("l")).collect()
    assert got[0]["p"] == pytest.approx(2 + math.sqrt(2)) and got[0]["l"] == pytest.approx(1.5 + math.sqrt(0.75))
    assert got[1]["l"] == pytest.approx(1.25 + math.sqrt(1.25 * 0.25)) and got[2]["l"] == 1.0


def test_fingerprint_ignores_row_order(spark):
    rows = [(i, f"x{i}" if i % 3 else None) for i in range(50)]
    a = frame_fingerprint(spark.createDataFrame(rows, "a long, b string"), ["a", "b"]).first()
    b = frame_fingerprint(spark.createDataFrame(rows[::-1], "a long, b string").repartition(3), ["b", "a"]).first()
    c = frame_fingerprint(spark.createDataFrame([*rows[:-1], (49, "y")], "a long, b string"), ["a", "b"]).first()
    assert a == b and a != c


# --- rolls -----------------------------------------------------------------------

def _guard(raw, w):
    """Sequential rule: a challenger needs w sessions in a row, back-dated."""
    out, inc, ch, start = [], None, None, 0
    for i, x in enumerate(raw):
        if inc is None:
            inc = x
        elif x == inc:
            ch = None
        else:
            if x != ch:
                ch, start = x, i
            if i - start + 1 >= w:
                out[start:i] = [x] * (i - start)
                inc, ch = x, None
        out.append(inc)
    return out


def test_persistence_guard_against_loop(spark):
    rng = np.random.default_rng(2)
    day0 = dt.date(2024, 1, 1)
    rows, want = [], {}
    for root in range(12):
        raw = [int(v) for v in np.repeat(rng.integers(0, 3, 14), rng.integers(1, 5, 14))]
        want[str(root)] = _guard(raw, 3)
        rows += [(str(root), day0 + dt.timedelta(days=i), v) for i, v in enumerate(raw)]
    got = rolls.persistence_guard(spark.createDataFrame(rows, "root string, session date, front int"), 3).orderBy("root", "session").collect()
    for root, seq in want.items():
        assert [r["effective"] for r in got if r["root"] == root] == seq


def test_adjustment_factor_of_one_roll(spark):
    eff = spark.createDataFrame([("r", dt.date(2024, 1, d), 0 if d < 3 else 1) for d in (1, 2, 3, 4)], "root string, session date, effective int")
    ratios = spark.createDataFrame([("r", dt.date(2024, 1, 3), 4020 / 4000)], "root string, session date, ratio double")
    got = [round(r["factor"], 9) for r in rolls.adjustment_factors(eff, ratios).orderBy("session").collect()]
    assert got == [1.005, 1.005, 1.0, 1.0]


# --- joins and sets -----------------------------------------------------------------

def test_asof_strict_and_tolerance(spark):
    left = spark.createDataFrame([("k", ts("2024-01-01 00:00:10"), 1), ("k", ts("2024-01-01 00:05:00"), 2)], "k string, ts timestamp, id int")
    right = spark.createDataFrame([("k", ts("2024-01-01 00:00:10"), 7.0), ("k", ts("2024-01-01 00:00:01"), 6.0)], "k string, ts timestamp, v double")
    got = {r["id"]: r["v"] for r in joins.asof_join(left, right, ["k"], "ts", "id", ["v"]).collect()}
    assert got == {1: 7.0, 2: 7.0}
    strict = {r["id"]: r["v"] for r in joins.asof_join(left, right, ["k"], "ts", "id", ["v"], 60_000_000, strict=True).collect()}
    assert strict == {1: 6.0, 2: None}


def test_nearest_within_takes_the_earlier_of_two(spark):
    left = spark.createDataFrame([(ts("2024-01-01 00:10:00"), 1), (ts("2024-01-01 01:00:00"), 2)], "ts timestamp, id int")
    right = spark.createDataFrame([(ts("2024-01-01 00:05:00"), "a"), (ts("2024-01-01 00:15:00"), "b")], "ts timestamp, r string")
    got = {r["id"]: (r["r"], r["distance_us"]) for r in joins.nearest_within(left, right, [], "ts", "id", ["r"], 300_000_000).collect()}
    assert got == {1: ("a", 300_000_000), 2: (None, None)}


def test_subtract_ranges_against_sets(spark):
    rng = np.random.default_rng(4)
    base = [(int(a), int(a + b)) for a, b in zip(rng.integers(0, 80, 9), rng.integers(1, 20, 9))]
    cuts = [(int(a), int(a + b)) for a, b in zip(rng.integers(0, 80, 6), rng.integers(1, 8, 6))]
    make = lambda r: spark.createDataFrame([("k", a, b) for a, b in r], "k string, lo long, hi long")
    left = set(itertools.chain(*[range(a, b) for a, b in base])) - set(itertools.chain(*[range(a, b) for a, b in cuts]))
    got = sets.subtract_ranges(make(base), make(cuts), ["k"]).orderBy("lo").collect()
    assert set(itertools.chain(*[range(r["lo"], r["hi"]) for r in got])) == left
    assert all(a["hi"] < b["lo"] for a, b in zip(got, got[1:]))


def test_leaderboard_puts_nulls_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "id string, v double")
    got = sets.leaderboard(df, [("v", True)]).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["c", "a", "b"]


# --- labels and outcomes ------------------------------------------------------------

def test_barrier_ties_and_horizon(spark):
    start = ts("2024-01-01 00:00:00")
    rng = np.random.default_rng(1)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 80)))
    rows = [("s", start + dt.timedelta(hours=i), i, float(p), float(p * 1.01), float(p * 0.99), float(p)) for i, p in enumerate(px)]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp, pos long, open double, high double, low double, close double")
    a = labels.triple_barrier(df, 1.0, 1.0, 300, 60, 10).orderBy("pos").collect()
    b = labels.triple_barrier_join(df, 1.0, 1.0, 300, 120, 10).orderBy("bar_ts").collect()
    assert [(r["label"], r["barrier_hit"], r["horizon_end_ts"]) for r in a] == [(r["label"], r["barrier_hit"], r["horizon_end_ts"]) for r in b]
    assert all(r["label"] == 0 and r["horizon_end_ts"] == r["bar_ts"] for r in a[:10])
    assert {r["label"] for r in a} >= {-1, 1}
    assert labels.label_horizon_bars(125, 60) == 3


def test_bracket_stop_comes_first(spark):
    rows = [(10, 11, 9, 10), (10, 10.5, 8, 10), (10, 14, 5, 12), (12, 12, 12, 12)]
    b = spark.createDataFrame([("s", i, *map(float, r)) for i, r in enumerate(rows)], "symbol string, pos long, open double, high double, low double, close double")
    s = spark.createDataFrame([("s", 1, 0, 0, 9.0, 1.0)], "symbol string, side int, swing_pos long, confirm_pos long, limit_price double, atr double")
    r = labels.bracket_outcomes(s, b, 2, 2.0, 1.0, ["side", "swing_pos"]).first()
    assert (r["fill_pos"], r["exit_pos"], r["exit_reason"], r["exit_price"], r["r_multiple"]) == (0, 1, "stop_loss", 8.0, -1.0)


# --- splits ----------------------------------------------------------------------

def _segments(df, fold, role):
    return [(r["lo"], r["hi"]) for r in df.filter(f"fold_id = {fold} AND role = '{role}'").orderBy("lo").collect()]


def test_walk_forward_embargo_of_the_fold_before(spark):
    s = splits.walk_forward_split(spark, 30, 10, 5, 3, 2, 4)
    assert _segments(s, 0, "train") == [(0, 8)] and _segments(s, 0, "test") == [(10, 15)]
    # Fold 1 starts at 13; the band [15, 19) after the first test block is out of its training rows.
    assert _segments(s, 1, "train") == [(3, 11)]
    assert _segments(s, 2, "train") == [(6, 14)]
    e = splits.walk_forward_split(spark, 60, 10, 2, 10, 1, 3, mode="expanding")
    assert _segments(e, 1, "train") == [(0, 12), (15, 19)]


@pytest.mark.parametrize("kw", [dict(train=30), dict(horizon=10), dict(purge=1, horizon=2), dict(mode="x"), dict(test=0)])
def test_walk_forward_refuses(spark, kw):
    args = dict(n=30, train=10, test=5, step=5, horizon=2, embargo=0, mode="rolling") | kw
    with pytest.raises(ValueError):
        splits.walk_forward_split(spark, **args)


def test_kfold_and_cpcv_segments(spark):
    k = splits.purged_kfold_split(spark, 23, 4, 2, 3)
    assert [_segments(k, i, "test")[0] for i in range(4)] == [(0, 6), (6, 12), (12, 18), (18, 23)]
    assert _segments(k, 1, "train") == [(0, 4), (17, 23)]
    c = splits.cpcv_split(spark, 40, 5, 2, 1, 1)
    assert c.select("fold_id").distinct().count() == math.comb(5, 2)
    assert _segments(c, 0, "test") == [(0, 16)] and _segments(c, 0, "train") == [(18, 40)]


# --- metrics and inference ------------------------------------------------------------

def test_drawdown_counts_from_the_start(spark):
    df = spark.createDataFrame([("s", 1, math.log(0.9)), ("s", 2, math.log(1.2)), ("s", 3, math.log(0.5))], "symbol string, t int, r double")
    r = metrics.drawdown_summary(df, ["symbol"], ["t"], "r").first()
    assert r["max_dd"] == pytest.approx(0.5)
    up = metrics.calmar(df.withColumn("r", F.lit(0.01)), ["symbol"], ["t"], "r").first()
    assert up["calmar"] == float("inf")


def test_profit_factor_edges(spark):
    df = spark.createDataFrame([("w", 1.0), ("l", -1.0), ("z", 0.0)], "k string, p double")
    got = {r["k"]: r["pf"] for r in df.groupBy("k").agg(inference.profit_factor("p").alias("pf")).collect()}
    assert got == {"w": float("inf"), "l": 0.0, "z": 0.0}


def test_bootstrap_indices_are_blocks(spark):
    sizes = spark.createDataFrame([("s", 50)], "k string, n long")
    p = bootstrap.stationary_indices(sizes, ["k"], 40, 5.0, 1).toPandas().sort_values(["rep", "t"])
    assert p.groupby("rep").size().eq(50).all() and p.idx.between(0, 49).all()
    same = ((p.idx.diff() - 1) % 50 == 0) & (p.t > 0)
    # About four of five steps go on to the next position.
    assert 0.7 < same[p.t > 0].mean() < 0.9
    again = bootstrap.stationary_indices(sizes, ["k"], 40, 5.0, 1).toPandas().sort_values(["rep", "t"])
    assert (again.idx.to_numpy() == p.idx.to_numpy()).all()


def test_partial_r2_and_pc1(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = x @ [1.0, 0.5] + rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    r = inference.partial_r2(df, ["a"], ["b"], "y").first()

    def r2(cols):
        z = np.column_stack([np.ones(400), x[:, cols]])
        e = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
        return 1 - e.var() / y.var()
    assert r["r2_base"] == pytest.approx(r2([0])) and r["r2_full"] == pytest.approx(r2([0, 1]))


def test_block_length_of_persistent_series(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(size=1500)
    x = np.zeros(1500)
    for i in range(1, 1500):
        x[i] = 0.7 * x[i - 1] + e[i]
    rows = [("iid", i, float(v)) for i, v in enumerate(e)] + [("ar", i, float(v)) for i, v in enumerate(x)]
    got = {r["k"]: r["block_length"] for r in inference.block_length(spark.createDataFrame(rows, "k string, pos long, x double"), ["k"], "x").collect()}
    assert got["ar"] > 8 > got["iid"] >= 1


def test_pareto_against_pairs(spark):
    rng = np.random.default_rng(8)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 9, (60, 2)))]
    got = {r["i"]: r["efficient"] for r in inference.pareto(spark.createDataFrame(pts, "i int, x double, y double"), "x", "y").collect()}
    want = {i: not any(c >= x and d >= y and (c > x or d > y) for _, c, d in pts) for i, x, y in pts}
    assert got == want


# --- archetypes --------------------------------------------------------------------

def test_merge_cells_sends_rare_cells_to_near_dense_ones():
    counts = {(0, 0, 0, 0): 50, (0, 0, 0, 1): 40, (1, 2, 1, 2): 45, (1, 2, 1, 1): 3}
    groups = archetypes.merge_cells(counts, 3, 30)
    assert groups[(1, 2, 1, 1)] == groups[(1, 2, 1, 2)] and len(set(groups.values())) == 3
    with pytest.raises(ValueError):
        archetypes.merge_cells(counts, 5, 30)
    assert archetypes.cochran_ok([5, 6, 7, 8, 1]) and not archetypes.cochran_ok([5, 0])


# --- quality, registry, sources ------------------------------------------------------

def test_schema_differences(spark):
    df = spark.createDataFrame([(1, "x")], "ts_event long, extra string")
    out = quality.check_schema(df, quality.RAW_BAR)
    assert "unexpected extra" in out and any(o.startswith("ts_event") for o in out) and "missing close" in out


def test_features_register_once():
    from tapeloom.plans import checks  # noqa: F401

    f = registry.lookup_feature("rv@v1")
    with pytest.raises(ValueError):
        registry.register_feature(f)
    with pytest.raises(KeyError):
        registry.lookup_feature("rv@v2")


def test_broker_ledger(spark, tmp_path):
    p = tmp_path / "Performance.csv"
    p.write_text("symbol,_priceFormat,_priceFormatType,_tickSize,buyFillId,sellFillId,qty,buyPrice,sellPrice,pnl,boughtTimestamp,soldTimestamp,duration\n"
                 "MESM6,-2,0,0.25,11,12,1,5300.25,5305.75,$28.00,04/01/2026 09:31:05,04/01/2026 09:58:45,27min 40sec\n"
                 'MESM6,-2,0,0.25,13,14,2,5300.25,5299.75,"$(1,004.50)",04/01/2026 10:00:00,04/01/2026 11:00:01,1hr 1sec\n')
    r = files.read_ledger(spark, str(p)).orderBy("buy_id").collect()
    assert [x["pnl"] for x in r] == [28.0, -1004.5] and [x["held_s"] for x in r] == [1660, 3601]
    assert str(r[0]["bought_ts"]) == "2026-04-01 09:31:05"


def test_survey_vintages_and_index(spark, tmp_path):
    s = tmp_path / "Individual_PAYEMS.csv"
    s.write_text("YEAR,QUARTER,ID,PAYEMS1,PAYEMS2\n2024,3,7,150.5,#N/A\n2024,x,8,1.0,2.0\n")
    r = files.read_survey(spark, str(s), ["PAYEMS1", "PAYEMS2"]).collect()
    assert [(str(x["forecast_date"]), x["indicator"], x["forecaster_id"], x["value"]) for x in r] == [("2024-07-01", "PAYEMS", "7", 150.5)]
    v = tmp_path / "GDP.json"
    v.write_text(json.dumps({"units": "lin", "observations": [
        {"realtime_start": "2024-02-01", "realtime_end": "9999-12-31", "date": "2024-01-01", "value": "1.5"},
        {"realtime_start": "2024-03-01", "realtime_end": "9999-12-31", "date": "2024-02-01", "value": "."}]}, indent=1))
    assert [(x["series"], x["value"]) for x in files.read_vintages(spark, str(v)).collect()] == [("GDP", 1.5)]
    i = tmp_path / "vix.csv"
    i.write_text("DATE,VIXCLS\n2024-01-02,13.2\n2024-01-03,.\n")
    assert [x["close"] for x in files.read_daily_index(spark, str(i)).collect()] == [13.2]


def test_only_checked_and_published_versions_are_read(spark, tmp_path, monkeypatch):
    """A failed check and a writer that dies before publishing leave readers what they had."""
    path, shape = str(tmp_path / "t"), "symbol string, day string, open double, volume long"
    rules = {"volume": F.col("volume") >= 0}

    def put(*rows):
        return files.write_partitioned(spark.createDataFrame(list(rows), shape), path, ["symbol"], ["day"], rules=rules)

    def read():
        schema = spark.createDataFrame([], shape).schema
        return sorted((r["symbol"] or "", r["day"], r["volume"]) for r in files.read_published(spark, path, schema).collect())

    with pytest.raises(ValueError):
        put(("s", "2024-01-01", 1.0, -5))
    with pytest.raises(ValueError):
        read()
    assert put(("s", "2024-01-01", 1.0, 5), ("t", "2024-01-01", 1.0, 6), (None, "2024-01-01", 1.0, 7)) == 3
    first = [("", "2024-01-01", 7), ("s", "2024-01-01", 5), ("t", "2024-01-01", 6)]
    assert read() == first
    with monkeypatch.context() as m:
        def dies(*args):
            raise RuntimeError("lost")

        m.setattr(files, "publish", dies)
        with pytest.raises(RuntimeError):
            put(("s", "2024-01-02", 1.0, 8))
    assert read() == first
    assert put(("s", "2024-01-03", 1.0, 9), (None, "2024-01-03", 1.0, 10)) == 2
    assert read() == [("", "2024-01-03", 10), ("s", "2024-01-03", 9), ("t", "2024-01-01", 6)]
    with pytest.raises(ValueError):
        files.publish(spark, path + "/data", path, 1)


def test_checksums_and_unknown_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    got = files.file_checksums(spark, str(tmp_path / "*.csv")).first()
    assert got["checksum"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    (tmp_path / "dim.json").write_text('{"symbol": "ES", "tick_size": 0.25, "colour": "red"}\n')
    with pytest.raises(ValueError):
        files.load_instruments(spark, str(tmp_path / "dim.json"))


def test_page_container_and_legacy_id():
    html = ('<html><head><title>no</title></head><body><nav>skip</nav><div class="a col-8 b"><p>One &amp; <b>two</b></p>'
            '<div>three<script>var x = "</p>";</script></div></div><div id="leftText">old</div><footer>end</footer></body></html>')
    assert pages.page_text(html, frozenset({"col-8"}), frozenset()) == "One & two three"
    assert pages.page_text(html, frozenset({"zz"}), frozenset({"leftText"})) == "old"
    assert pages.page_text(html, frozenset({"zz"}), frozenset()) == "One & two three old"
    assert pages.page_text("<p>x</p>", frozenset(), frozenset()) == ""


# --- risk and state ------------------------------------------------------------------

def test_floored_equity_against_loop(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(-5, 60, 200)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "symbol string, t int, pnl double")
    got = [r["equity"] for r in risk.floored_equity(df, ["symbol"], ["t"], "pnl", 100.0).orderBy("t").collect()]
    want, e = [], 100.0
    for v in x:
        e = max(0.0, e + v)
        want.append(e)
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_detector_sees_a_shift():
    cfg = Detector(hazard=1 / 100, window=20, kappa0=1.0, alpha0=2.0, beta0=1.0)
    rng = np.random.default_rng(0)
    run, mass = fresh(cfg), []
    for x in np.r_[rng.normal(0, 1, 80), rng.normal(6, 1, 30)]:
        run, m = observe(run, float(x), cfg)
        mass.append(m)
    assert max(mass[30:79]) < 0.5 < max(mass[80:90])
    assert float(np.exp(run[0]).sum()) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        Detector(re_entry_threshold=0.6)


def shifted_returns(spark):
    rng = np.random.default_rng(9)
    day0 = dt.date(2020, 1, 1)
    rows = [(s, day0 + dt.timedelta(days=i), float(v)) for s in ("a", "b") for i, v in enumerate(
        np.r_[rng.normal(0, 0.01, 150), rng.normal(0.08, 0.01, 100)])]
    return spark.createDataFrame(rows, "symbol string, session date, ret double"), day0


def in_files(df, day0, days, path):
    """Rows in files of ``days`` sessions, in time order."""
    for k in range(-(-250 // days)):
        part = df.filter((F.col("session") >= day0 + dt.timedelta(days=days * k)) & (F.col("session") < day0 + dt.timedelta(days=days * (k + 1))))
        part.coalesce(1).write.mode("append").parquet(path)


def test_ladder_stream_equals_its_batch_twin_over_several_files(spark):
    """The state goes on from one micro-batch to the next."""
    from tapeloom.session import scratch_path

    df, day0 = shifted_returns(spark)
    ladder = StepUp(every=20, mppm_window=10, detector=Detector(hazard=0.02, window=20, alpha0=2.0, beta0=1e-2))
    path = scratch_path(spark, "twin")
    in_files(df, day0, 90, path)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    a = streams.run_to_table(streams.stream_ladder(src, ladder), "twin-out").orderBy("symbol", "session").toPandas()
    b = streams.batch_ladder(df, ladder).orderBy("symbol", "session").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert (a["action"] != "").all() and len(a) > 4


@pytest.mark.parametrize("mode,after", [("posterior", "fresh"), ("count", "kept"), ("manual", "fresh")])
def test_decay_stream_in_five_batches_with_a_restart(spark, mode, after):
    """One batch, five batches with a restart in between, and the batch twin give the same signals and pause log."""
    from tapeloom.session import scratch_path

    df, day0 = shifted_returns(spark)
    cfg = Detector(hazard=1 / 60, window=20, min_pause=5, alpha0=2.0, beta0=1e-4, re_entry=mode, after=after, re_entry_count=8)
    given = [("a", d) for d in (3, 156, 162, 240)] + [("b", 249), ("b", 170), ("b", 171)]
    orders = spark.createDataFrame([(s, day0 + dt.timedelta(days=d)) for s, d in given], "symbol string, session date")
    late, ahead = scratch_path(spark, "returns"), scratch_path(spark, "orders")
    # All orders are there before the first return; they wait for their sessions.
    orders.coalesce(1).write.parquet(ahead)
    in_files(df.filter(F.col("session") < day0 + dt.timedelta(days=150)), day0, 50, late)

    def live(files):
        src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(late)
        return streams.stream_decay(src, cfg, spark.readStream.schema(orders.schema).parquet(ahead))

    def sort(frame):
        return frame.toPandas().sort_values(["symbol", "session", "event"], ignore_index=True)

    place = scratch_path(spark, "decay")
    streams.run_to_table(live(1), "decay", place)
    in_files(df.filter(F.col("session") >= day0 + dt.timedelta(days=150)), day0, 50, late)
    five = sort(streams.run_to_table(live(1), "decay", place))
    one = sort(streams.run_to_table(live(99), "once"))
    signals = streams.batch_decay(df, cfg, orders)
    batch = sort(signals)
    pd.testing.assert_frame_equal(five, batch)
    pd.testing.assert_frame_equal(one, batch)
    log = streams.pause_log(signals).toPandas()
    assert len(log) > 0 and (log["duration"] >= cfg.min_pause).all() and (log["entered"] < log["exited"]).all()
    assert set(log["ended_by"]) == {"manual" if mode == "manual" else "resume"}
    summary = {r["symbol"]: r for r in streams.pause_summary(signals).collect()}
    assert sum(r["pauses"] for r in summary.values()) == len(log)
    assert sum(r["refused"] for r in summary.values()) + (mode == "manual") * len(log) == len(given)


def test_decay_series_is_silent_in_warm_up(spark):
    df, _ = shifted_returns(spark)
    cfg = Detector(hazard=1 / 60, window=20, alpha0=2.0, beta0=1e-4)
    s = streams.decay_series(df, cfg)
    assert s.filter("n <= 10").agg(F.max("posterior")).first()[0] == 0.0
    got = {(r["symbol"], r["n"]): r["posterior"] for r in s.collect()}
    for symbol in ("a", "b"):
        run = fresh(cfg)
        for n, r in enumerate(df.filter(F.col("symbol") == symbol).orderBy("session").collect(), 1):
            run, mass = observe(run, r["ret"], cfg)
            assert got[symbol, n] == (0.0 if n <= 10 else pytest.approx(mass, rel=1e-12))
    assert all(max(got[k, n] for n in range(151, 166)) > 0.9 for k in ("a", "b"))
    for r in streams.decay_summary(s).collect():
        assert r["decayed"] and r["first_n"] > 10 and r["max_posterior"] > 0.9


def test_nearest_releases_in_five_batches_with_a_restart(spark):
    from tapeloom.session import scratch_path

    t0 = ts("2024-01-01 00:00:00")
    rng = np.random.default_rng(14)
    at = np.sort(rng.integers(0, 5 * 3600, 200))
    ticks = spark.createDataFrame([(i, t0 + dt.timedelta(seconds=int(a))) for i, a in enumerate(at)], "event_id long, ts timestamp")
    rel_at = np.unique(rng.integers(0, 6 * 3600, 40))
    rel = spark.createDataFrame([(1000 + i, t0 + dt.timedelta(seconds=int(a))) for i, a in enumerate(rel_at)], "release_id long, release_ts timestamp")
    path, place = scratch_path(spark, "ticks"), scratch_path(spark, "near")

    def add(hours):
        for h in hours:
            ticks.filter(F.hour("ts") == h).coalesce(1).write.mode("append").parquet(path)

    def live(files):
        return spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", files).parquet(path)

    add(range(3))
    streams.run_each_batch(live(1), "near", streams.nearest_releases(ticks, rel, 5), place)
    add(range(3, 5))
    five = streams.run_each_batch(live(1), "near", streams.nearest_releases(ticks, rel, 5), place)
    one = streams.run_each_batch(live(99), "near", streams.nearest_releases(ticks, rel, 5))
    want = []
    for i, a in enumerate(at):
        d = min((abs(int(r) - int(a)), int(r), k) for k, r in enumerate(rel_at))
        if d[0] <= 300:
            want.append((i, 1000 + d[2], d[0] * 1_000_000, int((abs(rel_at - a) <= 300).sum())))
    assert sorted(map(tuple, five.collect())) == sorted(map(tuple, one.collect())) == want and len(want) > 50


def test_late_ticks_are_dropped_from_stream_bars(spark):
    from tapeloom.session import scratch_path

    path = scratch_path(spark, "late")
    schema = "symbol string, ts timestamp, price double, seq long, size long"
    one = [("s", ts("2024-01-01 00:30:00"), 1.0, 1, 1), ("s", ts("2024-01-01 05:30:00"), 2.0, 2, 1)]
    # Lateness is judged by the watermark of the micro-batch before.
    mid = [("s", ts("2024-01-01 05:40:00"), 2.5, 3, 1)]
    two = [("s", ts("2024-01-01 00:40:00"), 9.0, 4, 1), ("s", ts("2024-01-01 09:00:00"), 3.0, 5, 1)]
    for part in (one, mid, two):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {str(r["bar_ts"]): r["close"] for r in streams.run_to_table(streams.stream_bars(src), "late-out").collect()}
    assert got == {"2024-01-01 01:00:00": 1.0, "2024-01-01 06:00:00": 2.5}


def test_counter_hash_is_an_integer_of_its_inputs(spark):
    r = spark.range(1).select(counter_hash(F.lit(7), F.lit(9), 42)).first()[0]
    m = 2_147_483_647
    assert r == (7 * 104_729 + 9 * 15_487_469 + 42) % m * 48_271 % m * 69_621 % m


def test_swing_needs_strict_falls(spark):
    lows = [5, 4, 3, 2, 2.5, 2.2, 1, 1, 2, 3]
    df = spark.createDataFrame([("s", i, float(v), float(v + 100 - i)) for i, v in enumerate(lows)], "symbol string, pos long, low double, high double")
    got = [(r["side"], r["swing_pos"], r["confirm_pos"]) for r in trend.pivot_setups(df, 3).filter("side = 1").collect()]
    assert got == [(1, 3, 5)]


def test_numbering_has_no_gaps_for_many_keys(spark):
    df = spark.range(5000).select((F.col("id") % 37).alias("k"), F.col("id").alias("t"))
    n = number_rows(df, ["k"], ["t"]).groupBy("k").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count_distinct("pos").alias("c"))
    assert n.filter("a <> 0 OR b + 1 <> c").count() == 0


@pytest.mark.parametrize("rules", [("open", "cap", "daily", "weekly"), ("cap", "weekly"), ("daily",)])
def test_guard_in_one_and_five_batches_with_a_restart(spark, rules):
    """Stream, restarted stream and batch twin against a plain walk over the entries."""
    from tapeloom.session import scratch_path
    from tapeloom.streaming.state import Limits

    rng = np.random.default_rng(17)
    t0 = ts("2024-01-01 00:00:00")
    rows = []
    for i in range(400):
        a = t0 + dt.timedelta(minutes=int(rng.integers(0, 5 * 7 * 1440)))
        b = a + dt.timedelta(minutes=int(rng.integers(0, 2 * 1440)))
        rows.append((f"acc{i % 3}", f"s{rng.integers(0, 4)}", a, b, i, float(rng.integers(1, 6)), float(rng.integers(-300, 200)),
                     a.date(), a.isocalendar()[0] * 100 + a.isocalendar()[1], b.date(), b.isocalendar()[0] * 100 + b.isocalendar()[1]))
    df = spark.createDataFrame(rows, "account string, symbol string, entry_ts timestamp, exit_ts timestamp, id long, size double, pnl double, "
                                     "session date, week long, exit_session date, exit_week long")
    cfg = Limits(start=10_000.0, rules=rules, caps=(("s1", 2.0),), cap=4.0, daily=-0.01, weekly=-0.02)

    want = {}
    for name in ("acc0", "acc1", "acc2"):
        held, done = [], []
        for r in sorted((r for r in rows if r[0] == name), key=lambda r: (r[2], r[4])):
            now = r[2]
            done += sorted((h for h in held if h[3] <= now), key=lambda h: h[3])
            held = [h for h in held if h[3] > now]
            past = lambda k, v: 10_000.0 + sum(h[6] for h in done if h[k] < v)
            lost = lambda k, v: sum(h[6] for h in done if h[k] == v)
            fires = {"open": any(h[1] == r[1] for h in held), "cap": r[5] > (2.0 if r[1] == "s1" else 4.0),
                     "daily": lost(9, r[7]) < -0.01 * past(9, r[7]), "weekly": lost(10, r[8]) < -0.02 * past(10, r[8])}
            want[r[4]] = next((k for k in rules if fires[k]), "")
            if not want[r[4]]:
                held.append(r)
    assert {w for w in want.values()} == {"", *rules}

    path, place = scratch_path(spark, "trades"), scratch_path(spark, "guard")

    def add(weeks):
        for w in weeks:
            lo, hi = t0 + dt.timedelta(days=7 * w), t0 + dt.timedelta(days=7 * w + 7)
            df.filter((F.col("entry_ts") >= lo) & (F.col("entry_ts") < hi)).coalesce(1).write.mode("append").parquet(path)

    def live(files):
        src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
        return streams.stream_guard(src, ["entry_ts", "id"], cfg)

    add(range(3))
    streams.run_to_table(live(1), "guard", place)
    add(range(3, 5))
    five = {r["id"]: r["reason"] for r in streams.run_to_table(live(1), "guard", place).collect()}
    one = {r["id"]: r["reason"] for r in streams.run_to_table(live(99), "guard").collect()}
    batch = streams.batch_guard(df, ["entry_ts", "id"], cfg)
    assert five == one == {r["id"]: r["reason"] for r in batch.collect()} == want
    counts = streams.trigger_counts(batch, cfg).collect()
    assert sum(r["entered"] for r in counts) == sum(not v for v in want.values()) and all(r["active"] for r in counts)


def test_limits_are_checked():
    from tapeloom.streaming.state import Limits

    for bad in ({"rules": ("open", "open")}, {"rules": ("other",)}, {"daily": 0.1}, {"start": 0}):
        with pytest.raises(ValueError):
            Limits(**bad)


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from tapeloom.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        sc = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None)
        with pytest.raises(ValueError):
            shared_dir(SimpleNamespace(sparkContext=sc))


def test_a_stream_of_slices_takes_one_slice_at_a_time(spark):
    """A slice of few keys has fewer files than there are partitions; a long slice is cut at its days."""
    from pathlib import Path

    from tapeloom.session import scratch_path

    day = dt.date(2020, 12, 1)
    rows = [("one", day + dt.timedelta(days=d), i) for d in range(60) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, session date, i long")

    def batches(**cut):
        place = scratch_path(spark, "slices")
        src = streams.frame_stream(df, "slices", ["k"], F.year("session"), **cut)
        out = streams.run_to_table(src, "slices", place)
        assert sorted(map(tuple, out.collect())) == sorted(rows)
        return len([p for p in Path(place.removeprefix("file:"), "log", "offsets").iterdir() if p.name.isdigit()])

    assert batches() == 2
    # 31 days of 10 rows, then 29: four arrivals of up to 100 rows, and three.
    assert batches(finer=F.col("session"), rows=100) == 7


def test_a_price_of_zero_makes_ranges_infinite(spark):
    """a low of zero was left out of the ranges and so of every window over it."""
    from tapeloom.operators import features

    at = dt.datetime(2024, 1, 1)
    rows = [("s", at + dt.timedelta(minutes=5 * i), i, 4.0, 5.0, 0.0 if i == 4 else 3.0, 4.5, 10) for i in range(9)]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp, pos long, open double, high double, low double, close double, volume long")
    inf = float("inf")
    for build, name, seen in ((lambda d: features.rv_parkinson(d, 3), "parkinson_v1", [4, 5, 6]), (lambda d: features.yang_zhang(d, 3), "yz_v1", [4, 5, 6]),
                              (lambda d: features.gap_aware_block(d, 3, 5), "parkinson", [4, 5, 6])):
        got = {r["pos"]: r[name] for r in build(df).collect()}
        assert [p for p in sorted(got) if got[p] == inf] == seen, name
        assert got[7] is not None and math.isfinite(got[7])
    a = spark.createDataFrame([(0.0, 2.0), (2.0, 0.0), (0.0, 0.0), (-1.0, 2.0)], "a double, b double").coalesce(1)
    low, high, none, below = (r[0] for r in a.select(numeric.wide_log_ratio("a", "b")).collect())
    assert (low, high, below) == (-inf, inf, None) and math.isnan(none)


def test_a_reference_without_its_semicolon_is_text():
    """F2"""
    page = "<body>a &amp b &amp&amp; c&ampd &lt;e&gt; &amp;lt; &#65; &#65 &</body>"
    assert pages.page_text(page, frozenset(), frozenset()) == "a &amp b &amp& c&ampd <e> &lt; A &#65 &"


def test_the_guard_of_a_ledger_holds_no_whole_account(spark):
    """a worker got all trades of an account at once; now Arrow batches of any size give the same reasons."""
    from tapeloom.streaming.state import Limits

    t0 = dt.datetime(2024, 1, 1)
    day = t0.date()
    rows = [(a, "s", t0 + dt.timedelta(minutes=(7 * i) % 40), t0 + dt.timedelta(minutes=(7 * i) % 40 + 3), i, 1.0, -40.0, day, 202401, day, 202401)
            for a in (None, 1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "account long, symbol string, entry_ts timestamp, exit_ts timestamp, id long, size double, pnl double, "
                                     "session date, week long, exit_session date, exit_week long")
    cfg = Limits(start=10_000.0)
    plan = streams.batch_guard(df, ["entry_ts", "id"], cfg)._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan

    def reasons():
        return sorted((str(r["account"]), r["id"], r["reason"]) for r in streams.batch_guard(df, ["entry_ts", "id"], cfg).collect())

    whole = reasons()
    assert len(whole) == 120 and {r[2] for r in whole} == {"", "open", "daily"}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert reasons() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trades_reach_the_guard_in_packs_and_few_states(spark, monkeypatch):
    """the worker got every trade as an object of its own, and every micro-batch had a task for each of all shuffle partitions."""
    from pathlib import Path

    import pyarrow as pa

    from tapeloom.session import scratch_path, shared_dir
    from tapeloom.streaming.state import Limits

    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        a = t0 + dt.timedelta(hours=2 * i)
        rows.append((i % 7, f"s{i % 2}", a, a + dt.timedelta(hours=40), i, float(i % 5), -150.0 - i % 3, a.date(), 202400 + i // 84, a.date(), 202400 + i // 84))
    df = spark.createDataFrame(rows, "account long, symbol string, entry_ts timestamp, exit_ts timestamp, id long, size double, pnl double, "
                                     "session date, week long, exit_session date, exit_week long")
    packs = streams._packed(df.withColumn("account", F.when(F.col("account") > 0, F.col("account"))).coalesce(1), "account").collect()
    held = {p["account"]: pa.ipc.open_stream(bytes(p["trades"])).read_all()["id"].to_pylist() for p in packs}
    assert len(packs) == 7 and held == {k or None: list(range(k, 600, 7)) for k in range(7)}

    cfg = Limits(start=10_000.0, cap=3.0)
    want = sorted(map(tuple, streams.batch_guard(df, ["entry_ts", "id"], cfg).collect()))
    assert {w[2] for w in want} >= {"", "open", "cap", "weekly"}
    monkeypatch.setattr(streams, "ARRIVAL_PARTS", 3)
    shared = Path(shared_dir(spark).removeprefix("file:"))
    older = set(shared.glob("packs-*"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        src = streams.frame_stream(df, "packs", ["account"], F.weekofyear("session"))
        place = scratch_path(spark, "guarded")
        got = streams.run_to_table(streams.stream_guard(src, ["entry_ts", "id"], cfg), "guarded", place, states=4)
        assert sorted(map(tuple, got.collect())) == want
        # Days of the weeks as arrivals whose rows are packed before they are dealt to files.
        days = streams.frame_stream(df, "days", ["account"], F.weekofyear("session"), F.col("session"), rows=50,
                                    pack=lambda d: streams.guard_packs(d, ["entry_ts", "id"]))
        assert days.columns == ["account", "trades"]
        got = streams.run_to_table(streams.stream_guard(df, ["entry_ts", "id"], cfg, days), "guarded", states=2)
        assert sorted(map(tuple, got.collect())) == want
        assert spark.conf.get("spark.sql.shuffle.partitions") == "16"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    states = [d for d in Path(place.removeprefix("file:"), "log", "state", "0").iterdir() if d.name.isdigit()]
    assert len(states) == 4
    arrived = [f for d in set(shared.glob("packs-*")) - older if "held" not in d.name for f in d.glob("*.parquet")]
    weeks = len({r[7].isocalendar()[1] for r in rows})
    assert 0 < len(arrived) <= 3 * weeks


def test_many_levels_share_a_state(spark, monkeypatch):
    """every level had a state and a call of its own."""
    from tapeloom.session import scratch_path

    monkeypatch.setattr(streams, "LEVEL_BUCKETS", 2)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(None if n == 3 else n, "f" if n % 2 else None, i * 9 + n, t0 + dt.timedelta(minutes=i), "penetrate" if (i * 5 + n) % 11 == 0 else "reject")
            for i in range(12) for n in range(9)]
    df = spark.createDataFrame(rows, "level long, fold string, event_id long, ts timestamp, kind string")
    want, seen = {}, {}
    for level, fold, event, _, kind in rows:
        count, dead = seen.get((level, fold), (0, False))
        error, pen = dead and kind == "reject", kind == "penetrate"
        count += kind == "reject" and not error
        seen[level, fold] = (count, dead or pen)
        want[event] = (level, fold, count, dead or pen, error, not (dead or pen) and count <= 3)
    path = scratch_path(spark, "touches")
    for part in (F.col("event_id") < 60, F.col("event_id") >= 60):
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = streams.run_to_table(streams.stream_levels(src, 3), "levels").collect()
    assert {r["event_id"]: (r["level"], r["fold"], r["rejections"], r["killed"], r["error"], r["permitted"]) for r in got} == want


def test_gains_without_a_loss_have_no_ratio(spark):
    """a replicate without a loss was infinite and moved the interval."""
    df = spark.createDataFrame([("w", 1.0), ("l", -1.0), ("z", 0.0), ("m", 3.0), ("m", -2.0)], "k string, p double")
    got = {r["k"]: r["pf"] for r in df.groupBy("k").agg(inference.gain_loss_ratio("p").alias("pf")).collect()}
    assert got == {"w": None, "l": None, "z": None, "m": 1.5}
    d = spark.createDataFrame([("k", i, -0.001 if i == 3 else 0.01 * (i + 1)) for i in range(12)], "k string, pos long, pnl double")
    ci = bootstrap.metric_ci(d, ["k"], ["pnl"], {"pf": inference.gain_loss_ratio("pnl")}, 60, 3.0, 2).first()
    assert 0 < ci["pf_lo"] < ci["pf_hi"] < float("inf")


def test_a_block_with_a_low_of_zero_has_an_infinite_range(spark):
    """F4"""
    at = dt.datetime(2024, 1, 1)
    rows = [(s, at + dt.timedelta(hours=i), 4.0, 5.0, 0.0 if s == "z" and i == 1 else 3.0, 4.5, 10, 1.0) for s in "az" for i in range(3)]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp, open double, high double, low double, close double, volume long, sign double")
    got = {r["symbol"]: r["range_var"] for r in bars.mediator_block(df, F.to_date("bar_ts"), 3).collect()}
    assert got["z"] == float("inf") and 0 < got["a"] < 1


def test_bars_may_be_ordered_by_sequence(spark):
    """ticks of one instant gave any of their prices."""
    at = dt.datetime(2024, 1, 1, 0, 30)
    df = spark.createDataFrame([("s", at, float(i), i, 1) for i in (3, 1, 4, 2)], "symbol string, ts timestamp, price double, seq long, size long")
    r = bars.resample_ohlcv(df, 60, tie=None, at="seq").first()
    assert (r["open"], r["close"]) == (1.0, 4.0)
