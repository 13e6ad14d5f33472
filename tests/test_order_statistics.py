"""Order statistics from counted values: ties, skew, small keys."""

import numpy as np
import pytest

from tapeloom.operators import archetypes, inference
from tapeloom.operators.scan import exact_quantiles, value_cells


def table(spark):
    """Key a: 99 of 100 rows hold one value; b: all equal; c: one row; d: only nulls."""
    rng = np.random.default_rng(2)
    a = np.where(np.arange(3000) % 100 == 0, rng.normal(0, 1, 3000), 0.25)
    rows = [("a", float(x)) for x in a] + [("b", 7.0)] * 40 + [("c", -1.0)] + [("d", None)] * 3
    return spark.createDataFrame(rows, "k string, v double").repartition(6), a


def test_cells_count_before_they_order(spark):
    df, a = table(spark)
    rows = value_cells(df, ["k"], "v").collect()
    of_a = sorted((r["_v"], r["_k"], r["_from"], r["_n"]) for r in rows if r["k"] == "a")
    assert len(of_a) == 31 and [x[2] for x in of_a] == np.concatenate(([0], np.cumsum([x[1] for x in of_a])[:-1])).tolist()
    assert {x[3] for x in of_a} == {3000} and {r["k"] for r in rows} == {"a", "b", "c"}
    plan = value_cells(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.split("Scan ExistingRDD")[0]


def test_quantiles_and_l_moments_of_ties(spark):
    df, a = table(spark)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"lo": 0.003, "mid": 0.5, "hi": 0.9971, "top": 1.0}).collect()}
    assert [got["a"][c] for c in ("lo", "mid", "hi", "top")] == pytest.approx(np.quantile(a, [0.003, 0.5, 0.9971, 1.0]).tolist(), rel=1e-12)
    assert got["b"]["mid"] == 7.0 and got["c"]["lo"] == -1.0
    m = {r["k"]: r for r in inference.l_moments(df, ["k"], "v").collect()}
    s, n = np.sort(a), len(a)
    i = np.arange(n)
    b0, b1, b2 = s.mean(), (s * i / (n - 1)).mean(), (s * i * (i - 1) / ((n - 1) * (n - 2))).mean()
    want = (b0, 2 * b1 - b0, 6 * b2 - 6 * b1 + b0)
    assert [m["a"][f"lambda{j}"] for j in (1, 2, 3)] == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert m["b"]["lambda2"] == pytest.approx(0) and m["c"]["lambda1"] == -1.0 and m["c"]["lambda2"] is None


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 1, 2]], "v double")
    assert archetypes.nearest_quantiles(df, "v", {"a": 0.2, "b": 0.5, "c": 0.8}).first() == (1.0, 1.0, 2.0)
