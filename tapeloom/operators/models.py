"""Model arms: elastic net from sums, boosted trees on MLlib, isotonic calibration by pooling.

The elastic net reads the rows once for all cells and folds; the calibration sorts counted
scores once for all folds. Boosted trees are a loop of distributed fits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.scan import number_rows, prefix
from tapeloom.session import cut_lineage


def _scaled(features: Sequence[str], estimator) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True), estimator])


# Passes of the coordinate descent; a fit that has converged stays where it is.
SWEEPS = 100


def block_moments(df: DataFrame, features: Sequence[str], y: str, block: Column) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per block: rows, means and centred cross-products of the features and y, in one pass.

    Rows with a null or a NaN are left out. A block's figures are p x p numbers, however many rows it has.
    """
    cols = [*features, y]
    k = len(cols)
    ok = df.select(block.alias("_b"), *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    agg = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)] + [
        F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    out = {}
    for r in ok.groupBy("_b").agg(*agg).collect():
        c = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        out[r["_b"]] = (float(r["n"]), np.array([r[f"m{i}"] for i in range(k)]), c * r["n"])
    return out


def merged(parts: Sequence[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments of several blocks together; nothing is a difference of large sums."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


def elastic_net(moments: tuple[float, np.ndarray, np.ndarray], alpha: float, l1: float, sweeps: int = SWEEPS) -> tuple[float, np.ndarray]:
    """Intercept and coefficients that minimise half the mean squared error plus alpha times
    (l1 |b| + (1 - l1) b^2 / 2), b on features of unit variance; a constant feature gets 0."""
    n, mean, c = moments
    p = len(mean) - 1
    sd = np.sqrt(np.maximum(np.diag(c)[:p] / n, 0))
    unit = np.where(sd > 0, sd, 1.0)
    g, xy = c[:p, :p] / n / np.outer(unit, unit), c[:p, p] / n / unit
    b = np.zeros(p)
    for _ in range(sweeps):
        for j in range(p):
            if sd[j] > 0:
                r = xy[j] - g[j] @ b + g[j, j] * b[j]
                b[j] = np.sign(r) * max(abs(r) - alpha * l1, 0.0) / (g[j, j] + alpha * (1 - l1))
    b = b / unit
    return float(mean[p] - b @ mean[:p]), b


def squared_error(moments: tuple[float, np.ndarray, np.ndarray], intercept: float, b: np.ndarray) -> float:
    """Mean squared error of a linear fit on the rows that the moments stand for."""
    n, mean, c = moments
    w = np.append(-b, 1.0)
    return float(w @ c @ w / n + (w @ mean - intercept) ** 2)


def elastic_net_grid(df: DataFrame, features: Sequence[str], y: str, block: Column, blocks: int,
                     cells: Mapping[str, tuple[float, float]]) -> tuple[str, DataFrame]:
    """Mean squared error of every (alpha, l1) cell over contiguous blocks, with the blocks next to
    the test block left out of training; the best cell by name order on ties.

    One pass gives the moments of each block; every training set is a sum of some of them.
    """
    m = block_moments(df, features, y, block)
    folds = [(merged([m[j] for j in m if abs(j - k) > 1]), m[k]) for k in range(blocks) if k in m and any(abs(j - k) > 1 for j in m)]
    if not folds:
        raise ValueError("no test block has blocks to train on")
    rows = []
    for name, (alpha, l1) in cells.items():
        fits = [(elastic_net(train, alpha, l1), test) for train, test in folds]
        rows.append((name, sum(squared_error(test, *f) for f, test in fits) / len(folds)))
    best = min(rows, key=lambda r: (r[1] if math.isfinite(r[1]) else math.inf, r[0]))[0]
    return best, df.sparkSession.createDataFrame([(n, e, n == best) for n, e in rows], "cell string, mse double, best boolean")


def boosted_trees(trees: int, depth: int, y: str = "y", seed: int = 7) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol=y, maxIter=trees, maxDepth=depth, seed=seed)


# Cells that one task holds of a table of cells.
CELL_ROWS = 50_000


def _cells(df: DataFrame, features: Sequence[str], y: str, block: Column) -> DataFrame:
    """Rows of one block with equal features as one row: mean of y, ``_w`` rows, ``_within`` squares around the mean.

    A fit by squared error sees no difference, as every split keeps such rows together; the squares
    belong to the error of any model. Features that never repeat leave the rows as they are.
    """
    spark = df.sparkSession
    d = cut_lineage(df.select(*features, F.col(y).cast("double").alias(y), block.alias("_b")).groupBy(*features, "_b").agg(
        F.avg(y).alias("_m"), F.count(y).cast("double").alias("_w"), (F.var_pop(y) * F.count(y)).alias("_within"))
        .filter("_w > 0").withColumnRenamed("_m", y))
    # Every fit reads the cells again: spread over all tasks where they are many.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(d.repartition(min(tasks, -(-d.count() // CELL_ROWS) or 1)))


def purged_grid_search(df: DataFrame, features: Sequence[str], y: str, block: Column, blocks: int,
                       makers: dict[str, Callable[[], object]]) -> tuple[str, DataFrame]:
    """Mean squared error of every grid cell over contiguous blocks, with the blocks
    next to the test block left out of training; the best cell by name order on ties."""
    d = _cells(df, features, y, block)
    scored = F.pow(F.col("prediction") - F.col(y), 2) * F.col("_w") + F.col("_within")
    rows = []
    for name, make in makers.items():
        errors = []
        for k in range(blocks):
            train, test = d.filter(F.abs(F.col("_b") - k) > 1), d.filter(F.col("_b") == k)
            model = _scaled(features, make().setWeightCol("_w")).fit(train)
            errors.append(model.transform(test).agg(F.sum(scored) / F.sum("_w")).first()[0])
        rows.append((name, float(sum(errors) / len(errors))))
    best = min(rows, key=lambda r: (r[1] if math.isfinite(r[1]) else math.inf, r[0]))[0]
    return best, df.sparkSession.createDataFrame(
        [(n, m, n == best) for n, m in rows], "cell string, mse double, best boolean")


def fit_arm(train: DataFrame, features: Sequence[str], maker: Callable[[], object]):
    return _scaled(features, maker()).fit(train)


def pooled(pools: pd.DataFrame) -> pd.DataFrame:
    """Adjacent pools (lo, hi, n, s), in order, merged until their means rise."""
    out: list[list[float]] = []
    for lo, hi, n, s in zip(pools["lo"], pools["hi"], pools["n"], pools["s"]):
        out.append([lo, hi, n, s])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, hi, n, s = out.pop()
            out[-1][1:] = [hi, out[-1][2] + n, out[-1][3] + s]
    return pd.DataFrame(out, columns=["lo", "hi", "n", "s"], dtype=float)


def isotonic_pools(df: DataFrame, score: str, outcome: str, block: Column, blocks: int) -> DataFrame:
    """(fold, lo, hi, value): the rising steps of the outcome over the score, fold k from the blocks before k.

    Scores are counted first; each task pools its range of them, and what is left of all ranges
    is pooled again (pooling is associative). For 0/1 outcomes the rising steps of n rows number
    at most about n^(2/3), so the second pooling stays small while the rows grow.
    """
    ok = df.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull()).select(
        block.alias("_b"), F.col(score).cast("double").alias("x"), F.col(outcome).cast("double").alias("_y"))
    cells = ok.groupBy("_b", "x").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("s"))
    later = cells.filter(F.col("_b") < blocks - 1).withColumn("fold", F.explode(F.sequence(F.col("_b") + 1, F.lit(blocks - 1))))
    sums = later.groupBy("fold", "x").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    spread = cut_lineage(sums.repartitionByRange("fold", "x").withColumn("_part", F.spark_partition_id()))

    def of_range(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pooled(pdf.sort_values("x").rename(columns={"x": "lo"}).assign(hi=lambda d: d["lo"]))
        return p.assign(fold=int(pdf["fold"].iloc[0]))[["fold", "lo", "hi", "n", "s"]]

    def of_fold(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pooled(pdf.sort_values("lo"))
        return pd.DataFrame({"fold": int(pdf["fold"].iloc[0]), "lo": p["lo"], "hi": p["hi"], "value": p["s"] / p["n"]})

    parts = spread.groupBy("fold", "_part").applyInPandas(of_range, "fold int, lo double, hi double, n double, s double")
    return parts.groupBy("fold").applyInPandas(of_fold, "fold int, lo double, hi double, value double")


def isotonic_out_of_fold(df: DataFrame, score: str, outcome: str, order_block: Column, blocks: int) -> DataFrame:
    """Calibrated scores: block k is calibrated on the blocks strictly before it.

    Between two steps the value runs on a line, beyond them it stays; a null score has none.
    The first block has nothing before it and stays out. Rows and step ends form one series, so
    a block of any size is calibrated by carried values, not by sending the steps around.
    """
    d = cut_lineage(df.withColumn("block", order_block.cast("int")))
    steps = isotonic_pools(d, score, outcome, F.col("block"), blocks)
    ends = steps.select("fold", F.explode(F.array(F.struct(F.col("lo").alias("x"), F.col("value").alias("v")),
                                                  F.struct(F.col("hi").alias("x"), F.col("value").alias("v")))).alias("_p"))
    row = F.struct(*d.columns)
    empty = F.lit(None)
    points = ends.select("fold", F.col("_p.x").alias("_x"), F.lit(0).alias("_side"), F.col("_p").alias("_p"), empty.cast(d.select(row.alias("_r")).schema["_r"].dataType).alias("_r"))
    asked = d.filter(F.col("block").between(1, blocks - 1)).select(
        F.col("block").alias("fold"), F.col(score).cast("double").alias("_x"), F.lit(1).alias("_side"),
        empty.cast(ends.schema["_p"].dataType).alias("_p"), row.alias("_r"))
    line = number_rows(points.unionByName(asked), ["fold"], ["_x", "_side"])
    line = prefix(line, ["fold"], {"_a": ("last", F.col("_p"))})
    line = prefix(line, ["fold"], {"_z": ("last", F.col("_p"))}, reverse=True)
    run = F.col("_z.x") - F.col("_a.x")
    between = F.col("_a.v") + (F.col("_z.v") - F.col("_a.v")) * (F.col("_x") - F.col("_a.x")) / run
    value = F.when(F.col("_x").isNull(), None).when(F.col("_a").isNull(), F.col("_z.v")).when(
        F.col("_z").isNull() | (F.col("_a.x") == F.col("_x")), F.col("_a.v")).otherwise(between)
    return line.filter("_side = 1").select("_r.*", value.alias("calibrated"))
