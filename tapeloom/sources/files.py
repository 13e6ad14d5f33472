"""Readers and writers of market files. Schemas are declared; nothing is inferred."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.clock import root_symbol
from tapeloom.operators.quality import check_schema, rule_counts

# Product roots, long before short by length.
ROOTS = ["ES", "NQ", "MES", "MNQ", "MCL", "MGC", "SIL"]

BAR_TEXT = "ts_event string, rtype string, publisher_id string, instrument_id string, open string, high string, " \
           "low string, close string, volume string, symbol string"


def read_bars_csv(spark: SparkSession, paths: str | list[str], roots: Sequence[str] = tuple(ROOTS)) -> DataFrame:
    """Vendor bars: ISO times to UTC, prices and ids cast, root symbol from the contract code."""
    raw = spark.read.schema(BAR_TEXT).csv(paths, header=True)
    return raw.select(
        F.to_timestamp("ts_event").alias("ts_event"),
        *[F.col(c).try_cast("long").alias(c) for c in ("rtype", "publisher_id", "instrument_id")],
        *[F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").try_cast("long").alias("volume"),
        F.col("symbol").alias("contract_symbol"), root_symbol("symbol", list(roots)).alias("symbol"))


def read_survey(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Wide survey file to long answers; what is not a number is dropped.

    ``columns`` are the target columns after YEAR, QUARTER and ID. The indicator
    comes from the name of the csv file or folder.
    """
    heads = ["YEAR", "QUARTER", "ID", *columns]
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in heads)).csv(path, header=True)
    raw = raw.withColumn("indicator", F.regexp_replace(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv(?:/|$)", 1), "^Individual_", ""))
    long = raw.unpivot(["YEAR", "QUARTER", "ID", "indicator"], list(columns), "variable", "raw")
    d = long.select(
        F.make_date(F.col("YEAR").try_cast("int"), (F.col("QUARTER").try_cast("int") - 1) * 3 + 1, F.lit(1)).alias("forecast_date"),
        "indicator", F.trim("ID").alias("forecaster_id"), "variable", F.trim("raw").try_cast("double").alias("value"))
    return d.filter(F.col("value").isNotNull() & F.col("forecast_date").isNotNull())


VINTAGE = "realtime_start string, realtime_end string, observation_start string, units string, " \
          "observations array<struct<realtime_start: string, realtime_end: string, date: string, value: string>>"


def read_vintages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Vintage observations; a value that is not a number drops its row."""
    raw = spark.read.schema(VINTAGE).json(path, multiLine=multi_line)
    o = raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json(?:/|$)", 1).alias("series"),
                   F.explode("observations").alias("o"))
    return o.select("series", F.to_date("o.date").alias("date"), F.to_date("o.realtime_start").alias("vintage"),
                    F.col("o.value").try_cast("double").alias("value")).filter(F.col("value").isNotNull())


def read_daily_index(spark: SparkSession, path: str) -> DataFrame:
    """Two-column daily index, whatever its header names; '.' drops the row."""
    raw = spark.read.schema("a string, b string").csv(path, header=False)
    return raw.select(F.col("a").try_cast("date").alias("date"), F.trim("b").try_cast("double").alias("close")).dropna()


def money(text: Column) -> Column:
    """'$28.00' or '$(4.50)' as a signed number."""
    plain = F.regexp_replace(text, r"[$(),\s]", "").try_cast("double")
    return F.when(text.contains("("), -plain).otherwise(plain)


def seconds_of(text: Column) -> Column:
    """'1hr 27min 40sec' as seconds."""
    def part(unit):
        return F.coalesce(F.regexp_extract(text, rf"(\d+)\s*{unit}", 1).try_cast("long"), F.lit(0))
    return part("hr") * 3600 + part("min") * 60 + part("sec")


LEDGER_TEXT = "symbol string, _priceFormat string, _priceFormatType string, _tickSize string, buyFillId string, " \
              "sellFillId string, qty string, buyPrice string, sellPrice string, pnl string, boughtTimestamp string, " \
              "soldTimestamp string, duration string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Broker ledger: money text, US timestamps and duration text."""
    raw = spark.read.schema(LEDGER_TEXT).csv(path, header=True)
    form = "MM/dd/yyyy HH:mm:ss"
    return raw.select(
        "symbol", F.col("qty").try_cast("long").alias("qty"), F.col("buyFillId").try_cast("long").alias("buy_id"),
        F.col("buyPrice").try_cast("double").alias("buy_price"), F.col("sellPrice").try_cast("double").alias("sell_price"),
        money(F.col("pnl")).alias("pnl"), F.try_to_timestamp("boughtTimestamp", F.lit(form)).alias("bought_ts"),
        F.try_to_timestamp("soldTimestamp", F.lit(form)).alias("sold_ts"), seconds_of(F.col("duration")).alias("held_s"))


SIDECAR = "run_id string, hypothesis string, per_fold array<struct<symbol: string, fold_id: long, test_start: string, " \
          "test_end: string, metrics: map<string, double>>>, results map<string, double>"


def read_sidecars(spark: SparkSession, path: str, metrics: Sequence[str], multi_line: bool = True) -> DataFrame:
    """Run sidecars as fold rows; a fold whose metrics are not finite is skipped."""
    raw = spark.read.schema(SIDECAR).json(path, multiLine=multi_line)
    d = raw.select("run_id", F.explode("per_fold").alias("f")).select(
        "run_id", "f.symbol", "f.fold_id", F.to_date("f.test_start").alias("test_start"), F.to_date("f.test_end").alias("test_end"),
        *[F.col("f.metrics")[m].alias(m) for m in metrics])
    ok = F.lit(True)
    for m in metrics:
        ok = ok & F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) < F.lit(float("inf")))
    return d.filter(ok)


# --- partitioned tables -------------------------------------------------------------

def _folder(spark: SparkSession, path: str):
    """The file system of a path and the path as it names it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Names of the published manifests, oldest first."""
    fs, where = _folder(spark, f"{path}/manifest")
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def publish(spark: SparkSession, staged: str, path: str, number: int) -> None:
    """Make a staged manifest the newest one: one rename, which readers see wholly or not at all."""
    fs, target = _folder(spark, f"{path}/manifest/{number:08d}")
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(_folder(spark, staged)[1], target):
        raise ValueError(f"manifest {number} of {path} was published by another writer")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str],
                      schema: T.StructType | None = None, rules: dict[str, Column] | None = None) -> int:
    """Write the partitions of ``df`` as a new version, check what was written, then publish it.

    Rows are range-partitioned once on partition and sort columns, so that a partition that
    holds a third of all rows is written by several tasks. A manifest lists the version of every
    partition; a new one takes the touched partitions from the new version and the others from
    where they were. A writer that dies before publishing leaves readers the old table. One
    writer at a time; a second one is refused when it publishes.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    keys, data = [*by, *sort], f"{path}/data/version={version}"
    published = _manifests(spark, path)
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy(*by).parquet(data)
    back = spark.read.schema(df.schema).parquet(data)
    problems = check_schema(back, schema) if schema is not None else []
    if rules:
        problems += [f"{r['rule']}: {r['violations']}" for r in rule_counts(back, rules).filter("violations > 0").collect()]
    if problems:
        fs, where = _folder(spark, data)
        fs.delete(where, True)
        raise ValueError("staged data was not published: " + "; ".join(problems))
    n = back.count()
    entries = back.select(*by).distinct().withColumn("version", F.lit(version))
    if published:
        old, new = spark.read.parquet(f"{path}/manifest/{published[-1]}").alias("o"), entries.alias("n")
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in by]
        entries = entries.unionByName(old.join(new, same, "left_anti"))
    staged = f"{path}/staged-{version}"
    entries.coalesce(1).write.parquet(staged)
    publish(spark, staged, path, int(published[-1]) + 1 if published else 0)
    return n


def read_published(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table as the newest manifest lists it; filters on partition columns prune folders."""
    published = _manifests(spark, path)
    if not published:
        raise ValueError(f"nothing is published at {path}")
    entries = spark.read.parquet(f"{path}/manifest/{published[-1]}").alias("m")
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.StringType())])).parquet(f"{path}/data").alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in entries.columns if c != "version"]
    return rows.join(entries, [F.col("d.version") == F.col("m.version"), *same], "left_semi").drop("version")


def load_bars(spark: SparkSession, path: str, symbols: Sequence[str], start: str, end: str, columns: Sequence[str],
              schema: T.StructType, ts: str = "bar_ts") -> DataFrame:
    """Bars of some symbols and an inclusive time range from a published table; symbols prune
    partitions, the range skips row groups, and only the named columns are read."""
    return read_published(spark, path, schema).filter(
        F.col("symbol").isin(list(symbols)) & F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    ).select("symbol", ts, *columns)


FOLD_LEDGER = T.StructType([T.StructField(c, T.LongType()) for c in (
    "fold_id", "train_start", "train_end", "test_start", "test_end", "purge_start", "purge_end", "embargo_start",
    "embargo_end", "n_train", "n_test")] + [T.StructField("model_hash", T.StringType())])


def write_fold_ledger(folds: DataFrame, path: str) -> None:
    """Fold table with its fixed columns (a row per fold: one file)."""
    folds.select(*[F.col(f.name).cast(f.dataType) for f in FOLD_LEDGER.fields]).coalesce(1).write.mode("overwrite").parquet(path)


def read_fold_ledger(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    problems = check_schema(df, FOLD_LEDGER)
    if problems:
        raise ValueError("not a fold ledger: " + "; ".join(problems))
    return df


# --- manifests and dimensions ----------------------------------------------------------

def merge_sources(canonical: DataFrame, extra: DataFrame, name: str = "filename") -> DataFrame:
    """Both source lists; where a file is in both, the canonical entry counts."""
    return canonical.unionByName(extra.join(canonical.select(name), name, "left_anti"))


def file_checksums(spark: SparkSession, glob: str) -> DataFrame:
    """Digest of every file, computed where it is read."""
    return spark.read.format("binaryFile").load(glob).select(
        F.col("path").alias("filename"), F.sha2("content", 256).alias("checksum"))


def changed_sources(files: DataFrame, provenance: DataFrame, force: bool = False) -> DataFrame:
    """Files whose checksum is not the one last recorded for them (all of them if forced)."""
    if force:
        return files
    last = provenance.groupBy("filename").agg(F.max_by("checksum", "recorded_at").alias("checksum"))
    return files.join(last, ["filename", "checksum"], "left_anti")


def unchanged_sources(files: DataFrame, provenance: DataFrame) -> DataFrame:
    last = provenance.groupBy("filename").agg(F.max_by("checksum", "recorded_at").alias("checksum"))
    return files.join(last, ["filename", "checksum"], "left_semi")


INSTRUMENT = "symbol string, tick_size double, tick_value double, multiplier double, session string, roll_rule string, fee double"


def load_instruments(spark: SparkSession, path: str) -> DataFrame:
    """Instrument dimension from JSON lines; fields that are not declared are refused."""
    known = {f.split()[0] for f in INSTRUMENT.split(", ")}
    extra = set(spark.read.json(path).columns) - known
    if extra:
        raise ValueError(f"unknown instrument fields: {sorted(extra)}")
    return F.broadcast(spark.read.schema(INSTRUMENT).json(path))
