"""Elastic net from block sums and isotonic calibration by pooling, against plain versions on the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import models


def rows(spark, n=400):
    rng = np.random.default_rng(8)
    x = rng.normal(0, [1.0, 5.0, 0.1], (n, 3)) + [1e4, -3.0, 0.0]
    y = 2 * (x[:, 0] - 1e4) - 0.3 * x[:, 1] + rng.normal(0, 1, n) + 50
    block = np.sort(rng.integers(0, 5, n))
    data = [(*map(float, r), float(v), int(b)) for r, v, b in zip(x, y, block)]
    df = spark.createDataFrame(data + [(None, 1.0, 1.0, 1.0, 2), (1.0, float("nan"), 1.0, 1.0, 2)], "x1 double, x2 double, x3 double, y double, b int")
    return df, x, y, block


def test_grid_errors_are_those_of_fits_on_the_rows(spark):
    df, x, y, block = rows(spark)
    cells = {"ridge": (0.5, 0.0), "mixed": (0.2, 0.5), "lasso": (0.3, 1.0)}
    best, table = models.elastic_net_grid(df, ["x1", "x2", "x3"], "y", F.col("b"), 5, cells)
    got = {r["cell"]: r["mse"] for r in table.collect()}
    for name, (alpha, l1) in cells.items():
        errors = []
        for k in range(5):
            on, off = abs(block - k) > 1, block == k
            mx, sd, my = x[on].mean(0), x[on].std(0), y[on].mean()
            z, t = (x[on] - mx) / sd, y[on] - my
            b = models.elastic_net((float(on.sum()), np.append(mx, my), np.cov(np.column_stack([x[on], y[on]]).T, bias=True) * on.sum()), alpha, l1)[1] * sd
            # What a minimum must satisfy: the gradient of the smooth part lies in the subgradient of the penalty.
            grad = z.T @ (t - z @ b) / len(t) - alpha * (1 - l1) * b
            assert np.allclose(grad[b != 0], alpha * l1 * np.sign(b[b != 0]), atol=1e-8) and (abs(grad[b == 0]) <= alpha * l1 + 1e-8).all()
            errors.append(((y[off] - my - (x[off] - mx) / sd @ b) ** 2).mean())
        assert got[name] == pytest.approx(np.mean(errors), rel=1e-8)
    assert best == min(got, key=got.get)


def test_constant_features_and_missing_blocks(spark):
    df = spark.createDataFrame([(1.0, float(i), 2.0 * i, 3 * (i // 10)) for i in range(20)], "c double, x double, y double, b int")
    best, table = models.elastic_net_grid(df, ["c", "x"], "y", F.col("b"), 5, {"a": (1e-6, 0.5)})
    assert best == "a" and table.first()["mse"] < 1e-3
    with pytest.raises(ValueError):
        models.elastic_net_grid(df.filter("b = 0"), ["c", "x"], "y", F.col("b"), 5, {"a": (0.1, 0.5)})


def plain_pools(x, y):
    order = np.argsort(x, kind="stable")
    g = pd.DataFrame({"x": x[order], "y": y[order]}).groupby("x")["y"].agg(["size", "sum"]).reset_index()
    n = len(g)
    w, s = np.concatenate(([0], g["size"].cumsum())), np.concatenate(([0], g["sum"].cumsum()))
    # The largest over starts of the least mean over ends.
    v = [max(min((s[b + 1] - s[a]) / (w[b + 1] - w[a]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    return g["x"].to_numpy(), np.array(v)


def test_isotonic_matches_the_max_min_rule(spark):
    rng = np.random.default_rng(12)
    x = np.round(rng.uniform(0, 1, 500), 2)
    y = (rng.uniform(0, 1, 500) < 0.2 + 0.6 * x**2).astype(float)
    block = rng.integers(0, 4, 500)
    data = [(i, float(a), float(b), int(k)) for i, (a, b, k) in enumerate(zip(x, y, block))]
    extra = [(900, None, 1.0, 2), (901, -5.0, 0.0, 3), (902, 5.0, 0.0, 1), (903, 0.335, None, 2)]
    df = spark.createDataFrame(data + extra, "id long, x double, y double, k int")
    df = df.repartition(7).withColumn("fold", F.lit("clash")).withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: r["calibrated"] for r in models.isotonic_out_of_fold(df, "x", "y", F.col("k"), 4).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {d[0] for d in data + extra if d[3] > 0}
    for k in (1, 2, 3):
        on = block < k
        xs, ys = x[on], y[on]
        if k >= 2:  # row 902 belongs to block 1
            xs, ys = np.append(xs, 5.0), np.append(ys, 0.0)
        px, pv = plain_pools(xs, ys)
        for i, a, _, b in data + extra:
            if b == k:
                want = None if a is None else float(np.interp(a, px, pv))
                assert got[i] == (want if want is None else pytest.approx(want, rel=1e-12)), (k, i)


def test_isotonic_of_nothing(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, 0)], "id long, x double, y double, k int")
    assert models.isotonic_out_of_fold(df, "x", "y", F.col("k"), 3).count() == 0


def test_boosted_trees_read_cells_and_fit_as_on_rows(spark):
    """every fit read every row; rows of a block with equal features are one weighted row."""
    rng = np.random.default_rng(11)
    n = 2_400
    x1, x2 = rng.integers(0, 9, n), rng.integers(0, 4, n)
    y = np.sin(x1) * (1 + x2) + rng.normal(0, 0.3, n)
    rows = [(float(a), float(b), float(c), int(k)) for a, b, c, k in zip(x1, x2, y, rng.integers(0, 4, n))]
    d = spark.createDataFrame(rows, "x1 double, x2 double, y double, k int").coalesce(2)
    seen = []

    class Trees(models.GBTRegressor):
        def _fit(self, dataset):
            seen.append(dataset.count())
            return super()._fit(dataset)

    got = models.purged_grid_search(d, ["x1", "x2"], "y", F.col("k"), 4, {"a": lambda: Trees(
        featuresCol="features", labelCol="y", maxIter=3, maxDepth=2, seed=7)})[1].first()
    errors = []
    for k in range(4):
        m = models.fit_arm(d.filter(F.abs(F.col("k") - k) > 1), ["x1", "x2"], lambda: models.GBTRegressor(
            featuresCol="features", labelCol="y", maxIter=3, maxDepth=2, seed=7))
        errors.append(m.transform(d.filter(F.col("k") == k)).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).first()[0])
    assert got["mse"] == pytest.approx(np.mean(errors), rel=1e-9) and got["best"]
    assert max(seen) <= 2 * 36
