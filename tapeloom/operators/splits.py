"""Walk-forward, purged k-fold and combinatorial splits as interval tables.

A split table has rows (fold_id, role, lo, hi) with half-open index ranges; role
is train, test, purge or embargo. Membership is a bucketed interval join.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = "fold_id long, role string, lo long, hi long"


def _rows(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("lo < hi")


def _seg(df: DataFrame, role: str, lo, hi) -> DataFrame:
    return df.select("fold_id", F.lit(role).alias("role"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def walk_forward_split(spark: SparkSession, n: int, train: int, test: int, step: int, horizon: int, embargo: int,
                       mode: str = "rolling", purge: int | None = None, max_folds: int | None = None) -> DataFrame:
    cut = horizon if purge is None else purge
    if min(n, train, test, step) <= 0:
        raise ValueError("sizes must be positive")
    if mode not in ("rolling", "expanding"):
        raise ValueError(f"unknown mode {mode!r}")
    if horizon > cut:
        raise ValueError("the purge window is shorter than the label horizon")
    if train + test > n:
        raise ValueError("no fold fits")
    if cut >= train:
        raise ValueError("the purge removes the whole training block")
    folds = (n - train - test) // step + 1
    folds = folds if max_folds is None else min(folds, max_folds)
    o = F.col("fold_id") * step + train
    f = spark.range(folds).select(F.col("id").alias("fold_id"))
    lo = o - train if mode == "rolling" else F.lit(0)
    hi = o - cut
    # The band after the test block of the fold before is not trained on.
    e_lo = o - step + test
    e_hi = F.least(e_lo + embargo, F.lit(n))
    has = (F.col("fold_id") > 0) & (e_lo < e_hi)
    return _rows([
        _seg(f, "train", lo, F.when(has, F.least(hi, e_lo)).otherwise(hi)),
        _seg(f.filter(has), "train", F.greatest(lo, e_hi), hi),
        _seg(f, "purge", hi, o),
        _seg(f, "test", o, o + test),
        _seg(f, "embargo", o + test, F.least(o + test + embargo, F.lit(n))),
    ])


def block_bounds(n: int, k: int) -> list[tuple[int, int]]:
    """k blocks of nearly equal length, the longer ones first."""
    base, extra = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        width = base + (i < extra)
        out.append((at, at + width))
        at += width
    return out


def _blocks_split(spark, n, combos, bounds, cut, embargo) -> DataFrame:
    rows = [(f, *bounds[b]) for f, combo in enumerate(combos) for b in combo]
    t = spark.createDataFrame(rows, "fold_id long, lo long, hi long")
    ban_lo, ban_hi = F.greatest(F.col("lo") - cut, F.lit(0)), F.least(F.col("hi") + cut + embargo, F.lit(n))
    w = Window.partitionBy("fold_id").orderBy("blo", "bhi")
    bans = t.select("fold_id", ban_lo.alias("blo"), ban_hi.alias("bhi"))
    # At most one ban per block: training is what lies between them.
    reach = F.coalesce(F.max("bhi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = bans.select("fold_id", reach.alias("lo"), F.col("blo").alias("hi"))
    tail = bans.groupBy("fold_id").agg(F.max("bhi").alias("lo"), F.lit(n).cast("long").alias("hi"))
    train = gaps.unionByName(tail).select("fold_id", F.lit("train").alias("role"), "lo", "hi").filter("lo < hi")
    merged = t.withColumn("_new", F.coalesce(
        F.col("lo") > F.max("hi").over(Window.partitionBy("fold_id").orderBy("lo").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    merged = merged.withColumn("_i", F.sum("_new").over(Window.partitionBy("fold_id").orderBy("lo")))
    test = merged.groupBy("fold_id", "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # A combination that leaves nothing to train on is no fold.
    live = train.select("fold_id").distinct()
    return train.unionByName(test.join(live, "fold_id", "left_semi").select(
        "fold_id", F.lit("test").alias("role"), "lo", "hi"))


def purged_kfold_split(spark, n: int, k: int, horizon: int, embargo: int, purge: int | None = None) -> DataFrame:
    cut = horizon if purge is None else purge
    if k < 2 or k > n or horizon > cut:
        raise ValueError("need 2 <= k <= n and a purge window of at least the label horizon")
    return _blocks_split(spark, n, [(i,) for i in range(k)], block_bounds(n, k), cut, embargo)


def cpcv_split(spark, n: int, groups: int, test_groups: int, horizon: int, embargo: int,
               purge: int | None = None) -> DataFrame:
    cut = horizon if purge is None else purge
    if not 0 < test_groups < groups <= n or horizon > cut:
        raise ValueError("need 0 < test groups < groups <= n")
    combos = list(itertools.combinations(range(groups), test_groups))
    return _blocks_split(spark, n, combos, block_bounds(n, groups), cut, embargo)


def session_folds(spark, n: int, train: int, test: int, embargo: int) -> DataFrame:
    """Rolling folds at session grain: train, a gap of ``embargo`` sessions, test."""
    folds = (n - train - embargo - test) // test + 1
    f = spark.range(max(folds, 0)).select(F.col("id").alias("fold_id"))
    s = F.col("fold_id") * test
    return _rows([_seg(f, "train", s, s + train),
                  _seg(f, "test", s + train + embargo, s + train + embargo + test)])


def calendar_split(df: DataFrame, day: str, train_end: str, val_end: str) -> DataFrame:
    d = F.col(day)
    return df.withColumn("part", F.when(d <= F.lit(train_end).cast("date"), "train")
                         .when(d <= F.lit(val_end).cast("date"), "val").otherwise("test"))


def members(obs: DataFrame, segments: DataFrame, idx: str = "idx", width: int = 256) -> DataFrame:
    """Observations with every fold and role that holds them.

    Segments are laid over buckets of the index, which makes the interval join
    an equi-join of at most ``width`` observations per bucket and fold.
    """
    s = segments.withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    o = obs.withColumn("_b", F.floor(F.col(idx) / width))
    return o.join(s, "_b").filter((F.col(idx) >= F.col("lo")) & (F.col(idx) < F.col("hi"))).drop("_b", "lo", "hi")


def leak_counts(obs: DataFrame, segments: DataFrame, feature_at: Column, idx: str = "idx") -> DataFrame:
    """Training rows per fold whose feature time is at or after the first test row."""
    first = segments.filter("role = 'test'").groupBy("fold_id").agg(F.min("lo").alias("_first"))
    m = members(obs.withColumn("_fa", feature_at), segments.filter("role = 'train'"), idx)
    return m.join(F.broadcast(first), "fold_id").groupBy("fold_id").agg(
        F.count_if(F.col("_fa") >= F.col("_first")).alias("leaks"), F.count(F.lit(1)).alias("n_train"))


def fold_ledger(segments: DataFrame) -> DataFrame:
    """One row per fold: bounds and sizes."""
    def edge(role, col, fn):
        return fn(F.when(F.col("role") == role, F.col(col)))

    size = F.col("hi") - F.col("lo")
    return segments.groupBy("fold_id").agg(
        edge("train", "lo", F.min).alias("train_start"), edge("train", "hi", F.max).alias("train_end"),
        edge("test", "lo", F.min).alias("test_start"), edge("test", "hi", F.max).alias("test_end"),
        edge("purge", "lo", F.min).alias("purge_start"), edge("purge", "hi", F.max).alias("purge_end"),
        edge("embargo", "lo", F.min).alias("embargo_start"), edge("embargo", "hi", F.max).alias("embargo_end"),
        F.sum(F.when(F.col("role") == "train", size)).alias("n_train"),
        F.sum(F.when(F.col("role") == "test", size)).alias("n_test"))


def roll_up_hashes(folds: DataFrame, model_hash: Column) -> DataFrame:
    """One digest over the folds in order (a row per fold, so the list is short)."""
    pairs = folds.select("fold_id", model_hash.alias("_h"))
    body = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("fold_id", "_h"))),
        lambda p: F.concat(p["fold_id"].cast("string"), F.lit(":"), p["_h"], F.lit(";"))), "")
    return pairs.agg(F.sha2(body, 256).alias("digest"), F.count(F.lit(1)).alias("folds"))


def fit_predict_linear(obs: DataFrame, segments: DataFrame, x: str, y: str, idx: str = "idx") -> DataFrame:
    """Fit a line on the training rows of every fold and predict its test rows.

    The fit is one grouped aggregate over all folds; nothing loops.
    """
    m = members(obs, segments.filter("role in ('train', 'test')"), idx)
    fit = m.filter("role = 'train'").groupBy("fold_id").agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.count(F.lit(1)).alias("n_train"))
    return m.filter("role = 'test'").join(fit, "fold_id").withColumn(
        "yhat", F.col("intercept") + F.col("slope") * F.col(x)).drop("role")


def run_folds(obs: DataFrame, segments: DataFrame, fit, predict, idx: str = "idx") -> DataFrame:
    """Fit/predict callbacks over all folds at once.

    ``fit(train) -> models`` gets the training rows of every fold with their fold_id and
    returns one row per fold; ``predict(models, test)`` joins them on it. Nothing loops.
    """
    m = members(obs, segments.filter("role in ('train', 'test')"), idx)
    return predict(fit(m.filter("role = 'train'")), m.filter("role = 'test'"))
