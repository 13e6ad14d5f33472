"""Selections, set operations and interval unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.scan import POS, number_rows, prefix, rolling


def best_row(df: DataFrame, keys: Sequence[str], metric: str, tie: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Row of the highest finite metric per key; ties go to the smallest ``tie``.

    A grouped minimum combines before the shuffle, so a hot key costs one row per task.
    """
    m = F.col(metric)
    ok = m.isNotNull() & ~F.isnan(m) & (F.abs(m) < F.lit(float("inf")))
    order = F.struct((-m).alias("_m"), *tie)
    return df.filter(ok).groupBy(*keys).agg(F.min_by(F.struct(metric, *keep), order).alias("_b")).select(*keys, "_b.*")


def leaderboard(df: DataFrame, order: Sequence[tuple[str, bool]], top: int | None = None) -> DataFrame:
    """Rank rows by (column, descending) pairs, nulls last.

    With ``top`` the report is a top-k, which each task shortens before the merge.
    """
    cols = [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in order]
    if top is not None:
        cut = df.orderBy(*cols).limit(top)
        return cut.withColumn("rank", F.row_number().over(Window.orderBy(*cols)))
    # A whole ranking is a distributed sort; nulls get a flag, as the sort key is plain.
    keyed = df
    names = []
    for i, (c, desc) in enumerate(order):
        keyed = keyed.withColumn(f"_k{i}n", F.col(c).isNull()).withColumn(
            f"_k{i}", -F.col(c) if desc else F.col(c))
        names += [f"_k{i}n", f"_k{i}"]
    ranked = number_rows(keyed, [], names, pos="_p")
    return ranked.withColumn("rank", F.col("_p") + 1).drop("_p", *names)


def total_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sort by the keys, then by all other columns in name order."""
    rest = sorted(c for c in df.columns if c not in keys)
    return df.orderBy(*keys, *rest)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def merge_distinct(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of two calendars without repeated (key) entries."""
    return a.select(*keys).union(b.select(*keys)).distinct()


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in an explicit order."""
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_f")
    ).select(*keys, "_f.*")


def union_ranges(ranges: DataFrame, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Merge overlapping or touching half-open ranges [lo, hi) of each key."""
    d = number_rows(ranges.filter("lo < hi"), keys, ["lo", "hi", *tie])
    d = prefix(d, keys, {"_reach": ("max", F.col("hi"))}, inclusive=False)
    d = d.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("lo") > F.col("_reach")), 1).otherwise(0))
    d = prefix(d, keys, {"_island": ("sum", F.col("_new"))})
    return d.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def subtract_ranges(base: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of the base ranges that no cut covers.

    Coverage is counted along the endpoints of both sides; a piece between two
    endpoints stays where a base range is open and no cut is.
    """
    def ends(df, b, c):
        return df.filter("lo < hi").select(*keys, F.explode(F.array(
            F.struct(F.col("lo").alias("x"), F.lit(b).alias("b"), F.lit(c).alias("c")),
            F.struct(F.col("hi").alias("x"), F.lit(-b).alias("b"), F.lit(-c).alias("c")))).alias("_e")).select(*keys, "_e.*")

    # Endpoints at one place are summed first, which also makes the order unique.
    e = ends(base, 1, 0).unionByName(ends(cuts, 0, 1)).groupBy(*keys, "x").agg(
        F.sum("b").alias("b"), F.sum("c").alias("c"))
    d = number_rows(e, keys, ["x"])
    d = prefix(d, keys, {"_b": ("sum", F.col("b")), "_c": ("sum", F.col("c"))})
    d = rolling(d, keys, 0, lambda r, w: r.withColumn("hi", F.lead("x").over(w)), lookahead=1)
    piece = d.filter((F.col("_b") > 0) & (F.col("_c") == 0) & F.col("hi").isNotNull())
    return union_ranges(piece.select(*keys, F.col("x").alias("lo"), "hi"), keys, [])


def rows_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks, counting repeats."""
    return a.exceptAll(b)
