"""Schema, domain, key, order and roll checks; drift and provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.hashing import frame_fingerprint
from tapeloom.operators.scan import number_rows, rolling

# The strict column lists of the two bar tables.
RAW_BAR = T.StructType([
    T.StructField("ts_event", T.TimestampType()), T.StructField("rtype", T.LongType()),
    T.StructField("publisher_id", T.LongType()), T.StructField("instrument_id", T.LongType()),
    T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()), T.StructField("contract_symbol", T.StringType()),
    T.StructField("symbol", T.StringType())])
CONTINUOUS_BAR = T.StructType([
    T.StructField("ts_event", T.TimestampType()), T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()), T.StructField("volume", T.LongType()),
    T.StructField("symbol", T.StringType()), T.StructField("front_contract_symbol", T.StringType()),
    T.StructField("adjustment_factor", T.DoubleType()), T.StructField("unadjusted_close", T.DoubleType()),
    T.StructField("roll_flag", T.BooleanType())])
PRICE_FLOOR = -1000.0


def check_schema(df: DataFrame, want: T.StructType) -> list[str]:
    """Differences in names and types; nullability is left to ``rule_counts``."""
    have = {f.name: f.dataType for f in df.schema.fields}
    need = {f.name: f.dataType for f in want.fields}
    out = [f"missing {c}" for c in need if c not in have]
    out += [f"unexpected {c}" for c in have if c not in need]
    out += [f"{c}: {have[c].simpleString()} is not {need[c].simpleString()}"
            for c in need if c in have and have[c] != need[c]]
    return out


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, in one pass; an unknown outcome breaks it."""
    one = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(k) for k, ok in rules.items()])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("_r")).select("_r.*")


def bar_rules(prices: Sequence[str] = ("open", "high", "low", "close")) -> dict[str, Column]:
    rules = {f"{c}_range": F.col(c) >= PRICE_FLOOR for c in prices}
    rules["volume_range"] = F.col("volume") >= 0
    return rules


def ohlc_rules() -> dict[str, Column]:
    return {"low_not_above": F.col("low") <= F.least("open", "high", "close"),
            "high_not_below": F.col("high") >= F.greatest("open", "close")}


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def time_reversals(df: DataFrame, keys: Sequence[str], arrival: Sequence[str], ts: str) -> DataFrame:
    """Rows whose time lies before that of the row that arrived just before, per key."""
    d = number_rows(df, keys, arrival)
    d = rolling(d, keys, 1, lambda x, w: x.withColumn("_prev", F.lag(ts).over(w)))
    return d.groupBy(*keys).agg(F.count_if(F.col("_prev") > F.col(ts)).alias("reversals"),
                                F.count(F.lit(1)).alias("n"))


def roll_invariants(bars: DataFrame, factors: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of broken promises of a rolled series."""
    adj = bars.agg(F.count_if(
        F.abs(F.col("close") - F.col("unadjusted_close") * F.col("adjustment_factor")) > 1e-9 * F.abs(F.col("close"))
    ).alias("violations")).select(F.lit("adjusted_is_raw_times_factor").alias("rule"), "violations")
    newest = factors.groupBy("root").agg(F.max_by("factor", "session").alias("f")).agg(
        F.count_if(F.abs(F.col("f") - 1) > 1e-12).alias("violations")).select(
        F.lit("newest_factor_is_one").alias("rule"), "violations")
    w = Window.partitionBy("root").orderBy("session")
    chain = events.withColumn("_p", F.lag("new").over(w)).agg(
        F.count_if(F.col("_p") != F.col("old")).alias("violations")).select(F.lit("rolls_chain").alias("rule"), "violations")
    one = duplicate_keys(bars, ["root", "bar_ts", "contract_id"]).agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit("one_bar_per_step").alias("rule"), "violations")
    return adj.unionByName(newest).unionByName(chain).unionByName(one)


def codes_outside(df: DataFrame, code: str, allowed: DataFrame) -> DataFrame:
    """Codes that are not in the allowed list, with their rows."""
    return df.join(allowed.select(code), code, "left_anti").groupBy(code).agg(F.count(F.lit(1)).alias("n"))


def adjacent_year_codes(df: DataFrame, code: str, year: Column) -> DataFrame:
    """Codes seen in two years in a row (their year digit is ambiguous)."""
    y = df.select(code, year.alias("_y")).distinct()
    w = Window.partitionBy(code).orderBy("_y")
    d = y.withColumn("_p", F.lag("_y").over(w))
    return d.groupBy(code).agg(F.count_if(F.col("_y") - F.col("_p") == 1).alias("adjacent"),
                               F.count(F.lit(1)).alias("years"))


def provenance_record(df: DataFrame, dataset: str, snapshot: str, cols: Sequence[str], sources: Sequence[str],
                      run_id: str) -> DataFrame:
    """One row that names a dataset, its sources, its row count and its order-free digest."""
    return frame_fingerprint(df, list(cols)).select(
        F.lit(dataset).alias("dataset"), F.lit(snapshot).alias("snapshot"), F.lit(run_id).alias("run_id"),
        F.sha2(F.lit("\n".join(sorted(sources))), 256).alias("sources_hash"), F.col("n").alias("row_count"),
        F.concat_ws("-", "lane1", "lane2").alias("frame_hash"))
