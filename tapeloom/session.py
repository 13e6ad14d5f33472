"""Session helpers: table loading, the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tapeloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach (``spark.checkpoint.dir``).

    Only where the session names none (tests on one machine) is one made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage so that later readers see one fixed result."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def utc_schema(spark: SparkSession, sf_dir: str, name: str) -> T.StructType:
    """Schema of a table with zone-less timestamps declared as UTC instants.

    The reader then delivers instants, where a cast would hide the column from the
    filters it pushes into the scan.
    """
    fields = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema.fields
    return T.StructType([
        T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType)
        for f in fields])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; zone-less timestamps become UTC instants."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(utc_schema(spark, sf_dir, name)).parquet(f"{sf_dir}/{name}.parquet")
